from sluice.plans import registry
from sluice.sources import generator, readers


def test_written_data_set(spark, tmp_path):
    paths = generator.write_dataset(spark, str(tmp_path))
    legs, relay = readers.legs(spark, paths["legs"]).cache(), readers.relay(spark, paths["relay"]).cache()
    truth, mixes = readers.ground_truth(spark, paths["truth"]).cache(), readers.coinjoin_truth(spark, paths["coinjoin"]).cache()
    assert legs.where("t IS NULL OR amount <= 0 OR fee <= 0 OR NOT wallet RLIKE '^bc1q[0-9a-f]{20}$'").count() == 0
    assert legs.selectExpr("txid").distinct().count() == relay.count() == relay.selectExpr("txid").distinct().count()
    assert {r["gap"] for r in registry.run(spark, "tx_balance", legs=legs).collect()} == {0.0}
    assert truth.groupBy("entity_type").agg({"entity_id": "count"}).count() == 6 and truth.selectExpr("wallet").distinct().count() == truth.count()
    tables = {"legs": legs, "relay": relay}
    # what was planted is found, and nothing else
    assert {r["txid"] for r in registry.run(spark, "coinjoin_shape", **tables).collect()} == {r["txid"] for r in mixes.collect()} and mixes.count() == 6
    kind = {r["wallet"]: r["entity_type"] for r in truth.collect()}
    chains = [kind.get(r["root"]) for r in registry.run(spark, "peeling_chains", **tables).collect()]
    assert (chains.count("peeling_chain_sloppy"), chains.count("peeling_chain_careful"), len(chains)) == (15, 12, 27)
    assert [kind.get(r["vault"]) for r in registry.run(spark, "darknet_sweeps", **tables).collect()] == ["darknet_vendor"] * 10
    assert [kind.get(r["wallet"]) for r in registry.run(spark, "ransom_fingerprint", **tables).collect()] == ["ransomware_collector"] * 8


def test_seed_decides(spark):
    rows = lambda seed, parts: sorted(map(tuple, generator.dataset(spark, {"legit_individual": 20, "mixer_coinjoin": 2}, seed)["legs"].repartition(parts).collect()))
    assert rows(1, 1) == rows(1, 5) != rows(2, 1)
    alone = generator.dataset(spark, {"legit_individual": 0, "mixer_coinjoin": 2}, 1)
    assert alone["coinjoin"].count() == 2 and alone["truth"].selectExpr("explode(wallets)").count() == 0
