"""Queries that SQL can't express: learned scores, neighbours over fingerprints, paths."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import graph, ml
from sluice.operators.components import components
from sluice.plans import registry
from sluice.session import shared_dir, written
from sluice.sources import generator, readers

WALLET = ["total_in", "total_out", "net_flow", "num_in_txns", "num_out_txns", "avg_amount_in", "avg_amount_out", "std_amount", "time_span_hrs", "avg_inter_tx_hrs", "unique_counterparties", "fee_ratio", "script_type_diversity"]
ALT = ["in_degree", "out_degree", "total_in_value", "total_out_value", "value_ratio", "avg_amount", "amount_std", "unique_counterparties", "time_span_hours", "avg_fee", "script_type_diversity"]
ACCOUNT = ["total_outgoing", "total_incoming", "num_outgoing", "num_incoming", "unique_receivers", "unique_senders", "unique_ips", "unique_cities", "forwarding_ratio", "rapid_transfer", "smurfing_score", "ip_concentration", "avg_outgoing_amount", "avg_incoming_amount", "max_single_transfer"]
BEHAVIOUR = ["event_count", "interval_mean", "interval_std", "amount_entropy", "round_ratio", "fanout_ratio", "ip_reuse_degree", "hour_concentration"]
#: Trees of each forest of the nested cross-validation.
NESTED_TREES = 150

#: Least score, level and what is recommended.
LADDER = (
    (70, "CRITICAL", "Immediate freeze + STR filing + ED/CBI referral"),
    (55, "HIGH", "Account freeze + investigation + police referral"),
    (50, "MEDIUM", "Enhanced monitoring + bank outreach + customer interview"),
    (30, "LOW", "Watch list + periodic review"),
)

_ask = registry._registered


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sluice-{uuid.uuid4().hex}"


def _labelled(spark: SparkSession, sf_dir: str, by: str = "cv_folds") -> DataFrame:
    return written(_of_accounts(spark, sf_dir, "acct_features").join(_of_accounts(spark, sf_dir, by), "id"))


def _of_accounts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation over the features of accounts, which are worked out once for all that a model reads of them."""
    registry.kept(spark, sf_dir, "feature_rows")
    return _ask(spark, sf_dir, name)


def iforest_api(spark, sf_dir):
    return ml.isolation_scores(_ask(spark, sf_dir, "wallet_features_api"), "wallet", WALLET)


def iforest_alt(spark, sf_dir):
    return ml.isolation_scores(_ask(spark, sf_dir, "wallet_features_alt"), "wallet", ALT, trees=200, contamination=0.05)


def iforest_legacy(spark, sf_dir):
    return ml.isolation_scores(_of_accounts(spark, sf_dir, "acct_features"), "id", ACCOUNT, trees=100, contamination=0.1)


def explain_topk(spark, sf_dir):
    return ml.explain(_ask(spark, sf_dir, "wallet_features_api"), "wallet", WALLET)


def anomaly_explanation(spark, sf_dir):
    return explain_topk(spark, sf_dir).where("wallet = 'wp0_0'").join(iforest_api(spark, sf_dir).select("wallet", F.round("scaled", 2).alias("anomaly_score")), "wallet")


def smote(spark, sf_dir):
    return ml.oversample(_labelled(spark, sf_dir), ACCOUNT, "id")


def ensemble_wide(spark, sf_dir):
    rows = _labelled(spark, sf_dir, "stratified_split")
    return ml.predict_ensemble(ml.train_ensemble(rows.where("NOT held_out"), ACCOUNT), rows, "id")


def ensemble(spark, sf_dir):
    return ml.with_isolation(ensemble_wide(spark, sf_dir), iforest_legacy(spark, sf_dir), "id")


def _rates(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list:
    """Precision, recall and their harmonic mean; 0 where there is nothing to divide by."""
    rate = lambda a, b, name: F.coalesce(F.try_divide(a, b), F.lit(0.0)).alias(name)
    hit = F.col(tp).cast("double")
    return [rate(hit, hit + F.col(fp), "precision"), rate(hit, hit + F.col(fn), "recall"), rate(2 * hit, 2 * hit + F.col(fp) + F.col(fn), "f1")]


def validation_summary(spark, sf_dir):
    found = ml.cross_validate(_labelled(spark, sf_dir), ACCOUNT, "id")
    sums = found.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], *[F.avg(c).alias(c) for c in ("brier", "auroc", "auprc", "ece")])
    return sums.select("*", *_rates())


def ensemble_levels(spark, sf_dir):
    """Every account by the blend of ensemble and isolation forest: level, kind of mule, action and flags."""
    scores = ensemble(spark, sf_dir).select("id", F.round("final", 2).alias("score"))
    ratios = _of_accounts(spark, sf_dir, "acct_features").select("id", "forwarding_ratio", "rapid_transfer")
    return levels_of(scores.join(ratios, "id")).join(_of_accounts(spark, sf_dir, "flags_ml"), "id")


def levels_of(scores: DataFrame) -> DataFrame:
    """(id, score, level, action, mule_type) of (id, score, forwarding_ratio, rapid_transfer)."""
    level, action = F.lit("CLEAR"), F.lit("No action, continue standard monitoring")
    for least, name, what in reversed(LADDER):
        level, action = F.when(F.col("score") >= least, name).otherwise(level), F.when(F.col("score") >= least, what).otherwise(action)
    willing = (F.col("forwarding_ratio") > 0.9) & (F.col("rapid_transfer") == 1)
    mule = F.when(F.col("score") < 50, "N/A").when(willing, "WILLING").otherwise("UNWITTING")
    return scores.select("id", "score", level.alias("level"), action.alias("action"), mule.alias("mule_type"))


def anomaly_blend(spark, sf_dir):
    """Every wallet's risk, its oddness of 0 to 100 (0 where there is none), both blended, and where its addresses are."""
    odd = iforest_api(spark, sf_dir).select("wallet", F.round("scaled", 2).alias("anomaly_score"), "is_anomaly")
    places = _ask(spark, sf_dir, "wallet_geo")
    out = _ask(spark, sf_dir, "final_scores").join(odd, "wallet", "left").join(places, "wallet", "left")
    out = out.fillna({"anomaly_score": 0.0, "is_anomaly": False, "send_countries": "", "recv_countries": "", "asns": ""})
    return out.withColumn("blended", F.round(0.7 * F.col("final") + 0.3 * F.col("anomaly_score"), 2))


def anomaly_truth(spark, sf_dir):
    """Oddness of known wallets by whether they are illicit: mean, and how many are called odd."""
    odd = iforest_api(spark, sf_dir).join(_ask(spark, sf_dir, "illicit_wallets"), "wallet")
    return odd.groupBy("illicit").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("scaled"), 4).alias("mean_score"), F.count(F.when(F.col("is_anomaly"), 1)).alias("n_odd"))


def nested_cv(spark, sf_dir):
    return ml.cross_validate(_labelled(spark, sf_dir), ACCOUNT, "id", trees=NESTED_TREES, depth_choices=(3, 6))


def elliptic_bench(spark, sf_dir):
    rows = written(_ask(spark, sf_dir, "bench_rows").where("class <> 'unknown'").withColumn("label", (F.col("class") == "1").cast("int")))
    columns = ["f_0", "f_1", "f_2", "f_3"]
    models = ml.train_ensemble(rows.where("time_step <= 34"), columns)
    test = rows.where("time_step > 34")
    judged = [(name, model.transform(test).select("label", (F.col("prediction") == 1).alias("hit"))) for name, model in zip(("boosted", "deep", "forest"), models, strict=True)]
    odd = ml.isolation_scores(test, "txid", columns, contamination=0.1).select("txid", F.col("is_anomaly").alias("hit"))
    judged.append(("isolation", test.select("txid", "label").join(odd, "txid").select("label", "hit")))
    out = None
    for name, rows in judged:
        hit, y = F.col("hit"), F.col("label") == 1
        one = rows.agg(F.lit(name).alias("model"), F.count(F.when(hit & y, 1)).alias("tp"), F.count(F.when(hit & ~y, 1)).alias("fp"), F.count(F.when(~hit & y, 1)).alias("fn"), F.count(F.when(~hit & ~y, 1)).alias("tn"))
        out = one if out is None else out.unionByName(one)
    return out.select("*", *_rates())


def sink_elliptic_results(spark, sf_dir):
    """The benchmark's figures as a CSV table, and what it says."""
    path, found = _folder(spark), elliptic_bench(spark, sf_dir)
    readers.write_csv(found, path)
    return spark.read.schema(found.schema).csv(path, header=True)


def _wide_table(spark: SparkSession, sf_dir: str) -> str:
    """A wide table of accounts as CSV beside the list of its features, as an external data set comes."""
    path = _folder(spark)
    rows = _labelled(spark, sf_dir).select("id", *ACCOUNT, F.col("label").alias(readers.TARGET), F.lit(1).alias(readers.LEAKING[0]))
    readers.write_csv(rows, f"{path}/wide")
    spark.createDataFrame([(c,) for c in ACCOUNT], "value string").coalesce(1).write.text(f"{path}/names")
    return path


def src_feature_list(spark, sf_dir):
    names = readers.feature_list(spark, f"{_wide_table(spark, sf_dir)}/names")
    return spark.createDataFrame([(n,) for n in names], "feature string")


def src_wide_features(spark, sf_dir):
    path = _wide_table(spark, sf_dir)
    return readers.wide_features(spark, f"{path}/wide", readers.feature_list(spark, f"{path}/names"))


def embed(spark, sf_dir):
    return ml.embed(_ask(spark, sf_dir, "fingerprints"), BEHAVIOUR, "wallet").select("wallet", F.size("embedding").alias("dims"), F.round(F.col("embedding")[0], 4).alias("first"))


def shadow_cluster(spark, sf_dir):
    """Components of the links of all vectors at the threshold: single linkage. Vectors without a link are in no cluster."""
    cut = _ask(spark, sf_dir, "sim_level").first()["cut"]
    vectors = _ask(spark, sf_dir, "vectors").select(F.col("vec_id").alias("id"), "v")
    links = ml.links_at(vectors, cut) if cut is not None else ml.links_at(vectors.limit(0), 1.0)
    return components(links).withColumnRenamed("component", "cluster")


def shadow_entities(spark, sf_dir):
    clusters = shadow_cluster(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("node")), "|").alias("members"))
    return clusters.where("n >= 3").orderBy(F.col("n").desc(), "cluster").limit(50)


def shadow_pipeline(spark, sf_dir):
    """Fingerprints with enough events, embedded; for every such wallet those of its five nearest that reach the
    similarity threshold, and its cluster, named by its smallest wallet. Fewer than five wallets give nothing."""
    some = written(_ask(spark, sf_dir, "fingerprints").where("event_count >= 3"))
    if some.count() < 5:
        return spark.createDataFrame([], "wallet string, match string, sim double, cluster string")
    vectors = written(ml.embed(some, BEHAVIOUR, "wallet").select(F.xxhash64("wallet").alias("id"), "wallet", F.col("embedding").alias("v")))
    cut = ml.similarity_cut(vectors)
    found = ml.nearest_others(vectors, 5, cut)
    members = written(components(ml.links_at(vectors, cut)).withColumnRenamed("node", "id").join(vectors.select("id", "wallet"), "id"))
    clusters = members.join(members.groupBy("component").agg(F.min("wallet").alias("cluster")), "component").select("id", "wallet", "cluster")
    names = vectors.select(F.col("id").alias("other"), F.col("wallet").alias("match"))
    return found.join(clusters, "id").join(names, "other").select("wallet", "match", F.round("sim", 4).alias("sim"), "cluster")


def path_bfs(spark, sf_dir):
    edges = _ask(spark, sf_dir, "transfers").select("seq", F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst"))
    return graph.path_bfs(edges, "ACC11", "ACC97")


def gen_dataset(spark, sf_dir):
    """The generated data set, written and read again: how many rows each table has."""
    paths = generator.write_dataset(spark, _folder(spark))
    read = {"legs": readers.legs, "relay": readers.relay, "truth": readers.ground_truth, "coinjoin": readers.coinjoin_truth}
    out = None
    for name, reader in read.items():
        one = reader(spark, paths[name]).agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def shadow_account(spark, sf_dir):
    """The look-alikes of wallet ``wp0_0`` and its cluster: the wallet itself and no cluster if there are none."""
    one = spark.createDataFrame([("wp0_0",)], "wallet string")
    return one.join(shadow_pipeline(spark, sf_dir), "wallet", "left").fillna({"cluster": "-1", "sim": 0.0})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (iforest_api, iforest_alt, iforest_legacy, explain_topk, anomaly_explanation, smote, ensemble_wide, ensemble, validation_summary, ensemble_levels, anomaly_blend, anomaly_truth, nested_cv, elliptic_bench, sink_elliptic_results, src_feature_list, src_wide_features, embed, shadow_cluster, shadow_entities, shadow_pipeline, shadow_account, path_bfs, gen_dataset)
}
