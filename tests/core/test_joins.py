import pytest
from pyspark.sql import functions as F

from sluice.operators import joins


@pytest.mark.parametrize("most", [1000, 3])
def test_hot_groups_get_their_figures(spark, most, monkeypatch):
    monkeypatch.setattr(joins, "HOT_GROUPS", most)
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id % 700) END AS k")
    groups = rows.where("k <> 'k5'").groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("least"))
    got = {(r["id"], r["k"], r["least"]) for r in joins.join_back(rows, groups, ["k"], 4000).collect()}
    least, want = {}, []
    for r in rows.collect():
        if r["k"] is not None and r["k"] != "k5":
            least[r["k"]] = min(least.get(r["k"], r["id"]), r["id"])
            want.append((r["id"], r["k"]))
    assert got == {(i, k, least[k]) for i, k in want}
    # a hot group's rows are spread by the join
    sizes = joins.join_back(rows, groups, ["k"], 4000).where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 or most == 3
