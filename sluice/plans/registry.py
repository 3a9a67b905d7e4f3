"""The relations that are registered as queries, and what stands in for the recursive ones on Spark."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sluice.operators.evaluation  # noqa: F401  each module registers its relations
import sluice.operators.transfers  # noqa: F401
import sluice.operators.utxo  # noqa: F401
import sluice.sources.fixtures  # noqa: F401
from sluice.operators import graph, similarity
from sluice.operators.components import components
from sluice.operators.transfers import ACCOUNT
from sluice.operators.utxo import PPR_CHECKED
from sluice.plans.relations import RELATIONS, dialect, duckdb_sql, query, reached
from sluice.session import drop, written

#: Registered under the first name, the second is answered: the same with its figures rounded.
ROUNDED = {"value_flow_edges": "flow_weights", "score_chain": "chain_scores", "score_sweep": "sweep_scores", "jaccard": "jaccards"}
#: Steps on the way, that no analyst asks for by themselves or whose unrounded sums depend on the order of adding.
INTERNAL = {"event_windows", "event_runs", "run_gaps", "sent", "received", "feature_rows", "passed_on", "gap_means", "wallet_sums", "hour_counts", "feature_moments", "ranks", "score_parts"}
INTERNAL |= {"restarts", "transition", "chain_gaps", "tx_shape", "peel_candidates", "peel_ranked", "ece_bins", "scored_truth", "hub_in", "hub_out", "sent_stats", "cluster_purity"}
INTERNAL |= {"vectors", "query_vectors", "shadow_pairs", "shadow_ranked", "sim_level", "nums", "owners", "steps", "legs_raw", "relay_raw", "n_customers", "accounts_geo", "ordered_items", "placed_orders", "transfers_numbered", "urgencies", "transfers_raw", "owner_reach", "path_steps", "trail_1", "trail_2", "trail_3", "trail_4", "trail_5", "event_times", "received_bins", "read_items", "read_orders", "own_watched", "ratio_ranks", "anomaly_ranks", "value_ranks", "known_values", "tie_ranks", "feature_sums", "binary_counts", "score_levels", "level_sums", "score_curves", "coinjoin_counts", "own_address", "filter_transfers_edges", "filter_sender_edges", "judged_accounts", "account_alerts", "account_chains", "tx_wallets", "wallet_txs", "co_many", "ip_sets", "ip_set_members", "ip_set_reach", *(f"rank_{i}" for i in range(1, PPR_CHECKED + 1))}


#: Global ranks: the relation whose rows are numbered, and the order.
NUMBERED = {"ratio_ranks": ("risk_ratio", ("ratio", "wallet")), "anomaly_ranks": ("wallet_features_api", ("-total_in", "wallet")), "value_ranks": ("known_values", ("feature", "value", "wallet"))}

#: Tables derived from the test tables: the relation that numbers their rows, that of the rows, and the order in its SQL.
SERIAL = {
    "legs": ("legs", "legs_raw", ("minutes", "txid", "role", "wallet", "amount")),
    "relay": ("relay", "relay_raw", ("minutes", "txid")),
    "transfers": ("transfers_numbered", "transfers_raw", ("t", "CAST(a_key AS STRING)", "CAST(b_key AS STRING)", "amount")),
}


def _serial(spark: SparkSession, step: str, sf_dir: str | None, given: dict[str, DataFrame], ask: Callable[..., DataFrame]) -> DataFrame:
    """A derived table, written. Its rows are numbered by ranges; the rest is its SQL."""
    numbering, source, order = SERIAL[step]
    rows = graph.numbered(ask(name=source), *[F.expr(c) for c in order])
    window = f"row_number() OVER (ORDER BY {', '.join(order)})"
    text = dialect(RELATIONS[numbering], 0)
    if window not in text:
        raise ValueError(f"{numbering} is numbered in another order")
    text = text.replace(window, "n").replace(f"FROM {source}", "FROM {source}")
    table = spark.sql(text, source=rows)
    out = written(table if numbering == step else query(spark, step, sf_dir, **given, **{numbering: table}))
    drop(rows)
    return out


def iterative(spark: SparkSession, name: str, sf_dir: str | None, given: dict[str, DataFrame], ppr_rounds: int, memo: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables for what is recursive in SQL, worked out by the graph algorithms instead; only those that ``name`` rests
    on. ``memo`` keeps them for the next call over the same tables."""
    found = dict(given)
    for step in reached(name, frozenset(given)):
        if step in found:
            continue
        if step in memo:
            found[step] = memo[step]
            continue
        ask = partial(run, spark, sf_dir=sf_dir, ppr_rounds=ppr_rounds, memo=memo, **found)
        if step in SERIAL and SERIAL[step][0] not in given:  # derived from the test tables once, like a loaded file
            found[step] = _serial(spark, step, sf_dir, found, ask)
        elif step in SERIAL:
            found[step] = written(query(spark, step, sf_dir, **found))
        elif step == "components":
            found[step] = components(ask(name="owner_edges")).withColumnRenamed("node", "wallet")
        elif step == "chain_steps":
            found[step] = graph.walk(ask(name="find_peel_hops"))
        elif step == "ranks":
            found[step] = graph.personalized_pagerank(ask(name="transition"), ask(name="restarts"), ppr_rounds)
        elif step == "reverse_chain":
            found[step] = graph.longest_trails(ask(name="transfers").select("seq", F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst")), ACCOUNT)
        elif step == "sim_level" and "shadow_pairs" not in given:
            found[step] = similarity.level_of(ask(name="vectors"), ask(name="query_vectors"))
        elif step == "shadow_ranked" and step != name and "shadow_pairs" not in given:  # others ask for the five most alike
            found[step] = similarity.nearest(ask(name="vectors"), ask(name="query_vectors"))
        elif step in NUMBERED:
            source, order = NUMBERED[step]
            found[step] = graph.numbered(ask(name=source), *[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order])
        elif step == "reach_three":
            if step == name:  # others ask for the counts only
                found[step] = graph.pairs_within(ask(name="pairs"))
            else:
                continue
        elif step == "two_hops" and step == name:
            found[step] = graph.pairs_within(ask(name="pairs"), 2, 2)
        elif step == "convergence" and "reach_three" not in given:
            found[step] = graph.reached_from(ask(name="pairs")).where("sources >= 3")
        else:
            continue
        memo[step] = found[step]
    return found


def run(spark: SparkSession, name: str, sf_dir: str | None = None, ppr_rounds: int = graph.ROUNDS, memo: dict[str, DataFrame] | None = None, **given: DataFrame) -> DataFrame:
    """Any relation, over the test tables in ``sf_dir`` or over ``given`` DataFrames: legs, relay, transfers, truth, ..."""
    tables = iterative(spark, name, sf_dir, given, ppr_rounds, {} if memo is None else memo)
    return tables[name] if name in tables else query(spark, name, sf_dir, **tables)


_MEMOS: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _memo(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _MEMOS.setdefault((spark.sparkContext.applicationId, sf_dir), {})


def _registered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Of the test tables, which don't change, derived tables are kept for the session. Ranks take all their rounds, and
    so does the SQL."""
    return run(spark, name, sf_dir, graph.ROUNDS, _memo(spark, sf_dir))


def kept(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation of the test tables that much rests on: worked out once, written, and kept like the derived tables."""
    memo = _memo(spark, sf_dir)
    if name not in memo:
        memo[name] = written(_registered(spark, sf_dir, name))
    return memo[name]


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_registered, name=ROUNDED.get(name, name)) for name in RELATIONS if name not in INTERNAL}


def oracles() -> dict[str, str]:
    return {name: duckdb_sql(ROUNDED.get(name, name)) for name in RELATIONS if name not in INTERNAL}
