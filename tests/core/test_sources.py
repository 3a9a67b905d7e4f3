import json

import pytest

from sluice.sources import readers
from sluice.streaming import coordination


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "tx.csv").write_text("txid,wallet,role,amount,timestamp,fee,script_type\na,w1,input,2.5,2024-01-01T00:01:00,0.1,P2TR\na,w2,change,2.4,2024-01-01T00:01:00,,P2TR\n")
    rows = readers.legs(spark, str(tmp_path / "tx.csv")).orderBy("seq").collect()
    assert [(r["wallet"], r["role"], r["t"], r["fee"]) for r in rows] == [("w1", "input", 1704067260, 0.1), ("w2", "output", 1704067260, 0.0)]
    (tmp_path / "truth.json").write_text(json.dumps([{"entity_id": "e", "entity_type": "x", "is_illicit": True, "wallets": ["w1", "w2"]}], indent=1))
    assert [r["wallet"] for r in readers.ground_truth(spark, str(tmp_path / "truth.json")).collect()] == ["w1", "w2"]
    (tmp_path / "cj.json").write_text('["a",\n "b"]')
    assert [r["txid"] for r in readers.coinjoin_truth(spark, str(tmp_path / "cj.json")).collect()] == ["a", "b"]
    (tmp_path / "geo.csv").write_text("1.0.0.0,1.0.0.255,AU\n2001:200::,2001:200::ff,JP\n300.1.1.1,1.1.1.1,XX\n10.0.0.0,10.0.0.9,NA\n")
    assert [tuple(r) for r in readers.geo_country(spark, str(tmp_path / "geo.csv")).collect()] == [(16777216, 16777471, "AU"), (167772160, 167772169, "NA")]
    readers.write_csv(spark.range(2), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_wide_features(spark, tmp_path):
    (tmp_path / "names.txt").write_text("F1\nF2\n\n")
    assert readers.feature_list(spark, str(tmp_path / "names.txt")) == ["F1", "F2"]
    (tmp_path / "bad.txt").write_text("F1\nF3912\n")
    with pytest.raises(ValueError, match="F3912"):
        readers.feature_list(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "wide.csv").write_text("id,F1,F2,F3,F3924\n1,0.5,red,9,0\n2,,blue,9,1\n3,2,red,9,1\n")
    got = readers.wide_features(spark, str(tmp_path / "wide.csv"), ["F1", "F2"]).orderBy("account_id").collect()
    assert [(r["account_id"], r["F1"], r["F2"], r["target"]) for r in got] == [("1", 0.5, 0.0, 0), ("2", 0.0, 1.0, 1), ("3", 2.0, 0.0, 1)]


def test_stream_of_bursts(spark, tmp_path):
    spark.sql("SELECT timestamp_seconds(60 * id) AS ts, id % 3 AS user_id, 1.0D AS value FROM range(600)").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, user_id long, value double").parquet(str(tmp_path / "in"))
    query = coordination.start(source, str(tmp_path / "out"), str(tmp_path / "cp"), late="0 seconds")
    assert query.awaitTermination(90)
    # the last window is still open
    assert sorted((r["n"], r["senders"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(120, 3)] * 4
    assert coordination.coordinated_bursts(spark.read.parquet(str(tmp_path / "in"))).count() == 5
