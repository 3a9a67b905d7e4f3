"""A seeded data set of known entities: legs and relay events as CSV, the truth about them as JSON.

Every draw is a hash of the seed, its purpose and the row it is for, so that the same seed gives the same rows whatever the
number of tasks. Amounts are whole units of 1e-8 until they are written: inputs are outputs plus fee exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources import readers

#: How many entities of each kind there are by default.
COUNTS = {"legit_individual": 400, "legit_business": 25, "ransomware_collector": 8, "peeling_chain_sloppy": 15, "peeling_chain_careful": 12, "mixer_coinjoin": 6, "darknet_vendor": 10}
ILLICIT = ("ransomware_collector", "peeling_chain_sloppy", "peeling_chain_careful", "mixer_coinjoin", "darknet_vendor")
START, MINUTES = 1704067200, 60 * 24 * 60
COIN = 100_000_000
#: Entities in a file of the truth.
IN_A_FILE = 1000


def _draw(seed: int, what: str, lowest: int, highest: int, of: str = "e") -> str:
    return f"CAST({lowest} + pmod(xxhash64({seed}, '{what}', {of}), {highest - lowest + 1}) AS BIGINT)"


def _leg(wallet: str, amount: str) -> str:
    return f"named_struct('wallet', {wallet}, 'amount', CAST({amount} AS BIGINT))"


def _wallet(i: str, part: str = "w") -> str:
    return f"concat('{part}', e, '_', {i})"


def transactions(spark: SparkSession, counts: dict[str, int] = COUNTS, seed: int = 42) -> DataFrame:
    """(e, kind, n, h, minute, ip, ins, outs): one row for each transaction of each entity, as arrays of (wallet, amount)."""
    first, rows = 0, []
    for kind, count in counts.items():
        rows.append((kind, first, count))
        first += count
    entities = spark.createDataFrame(rows, "kind string, first long, count long").where("count > 0").selectExpr("kind", "explode(sequence(first, first + count - 1)) AS e")
    n = f"""CASE kind WHEN 'legit_individual' THEN {_draw(seed, "n", 3, 8)} WHEN 'legit_business' THEN {_draw(seed, "n", 5, 12)} WHEN 'ransomware_collector' THEN {_draw(seed, "n", 6, 15)}
      WHEN 'mixer_coinjoin' THEN {_draw(seed, "n", 5, 10)} WHEN 'darknet_vendor' THEN {_draw(seed, "n", 9, 20)} ELSE {_draw(seed, "n", 6, 14)} END"""
    sized = entities.selectExpr("*", f"{n} AS n", f"{_draw(seed, 'base', 0, MINUTES)} AS base", f"{_draw(seed, 'start', 5, 50)} * {COIN} AS amount", f"{_draw(seed, 'keep', 90, 96)} / 100D AS keep")
    steps = sized.selectExpr("*", "explode(sequence(0L, CASE kind WHEN 'mixer_coinjoin' THEN 0L WHEN 'darknet_vendor' THEN n ELSE n - 1 END)) AS h")
    steps = steps.selectExpr("*", f"{_draw(seed, 'fee', 1000, 9000, 'e, h')} AS fee", f"{_draw(seed, 'paid', 30, 50, 'e, h')} AS paid", "CAST(floor(amount * power(keep, h)) AS BIGINT) AS had", "CAST(floor(amount * power(keep, h + 1)) AS BIGINT) AS rest")
    own, nxt, paid = _wallet("h"), _wallet("h + 1"), f"h * {COIN} + paid * {COIN // 10}"
    pool = counts.get("legit_individual", 0)
    # a mixer borrows wallets of people, seven apart
    mixed_in = f"transform(sequence(0L, n - 1), j -> {_leg(f'concat("w", pmod(e * 31 + j * 7, {pool}), "_0")' if pool else _wallet('j', 'b'), 'amount + 1000')})"
    mixed_out = f"transform(sequence(0L, n - 1), j -> {_leg(_wallet('j', 'm'), 'amount')})"
    swept = f"transform(sequence(0L, n - 1), j -> {_leg(_wallet('j'), f'(j + 1) * {COIN}')})"
    shapes = {
        "legit_individual": (f"array({_leg(own, f'{2 * COIN} + fee')})", f"array({_leg(_wallet('h', 'x'), f'paid * {COIN // 50}')}, {_leg(nxt, f'{2 * COIN} - paid * {COIN // 50}')})"),
        "legit_business": (f"array({_leg(_wallet('2 * h'), paid)}, {_leg(_wallet('2 * h + 1'), f'{COIN} + fee')})", f"array({_leg(_wallet('h', 'x'), paid)}, {_leg(_wallet('0'), str(COIN))})"),
        "ransomware_collector": (f"array({_leg(_wallet('h', 'v'), 'amount + fee')})", f"array({_leg(_wallet('0'), 'amount')})"),
        "mixer_coinjoin": (mixed_in, mixed_out),
        "darknet_vendor": (f"CASE WHEN h = n THEN {swept} ELSE array({_leg(_wallet('h', 'b'), f'(h + 1) * {COIN} + fee')}) END", f"CASE WHEN h = n THEN array({_leg(_wallet('n'), f'n * (n + 1) / 2 * {COIN} - fee')}) ELSE array({_leg(own, f'(h + 1) * {COIN}')}) END"),
        "peeling": (f"array({_leg(own, 'had')})", f"array({_leg(nxt, 'rest')}, {_leg(_wallet('h', 's'), 'had - rest - fee')})"),
    }
    case = lambda i: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in shapes.items() if k != "peeling") + f" ELSE {shapes['peeling'][i]} END"
    gap = f"CASE kind WHEN 'peeling_chain_sloppy' THEN 20 WHEN 'peeling_chain_careful' THEN 150 WHEN 'darknet_vendor' THEN 90 ELSE 600 END"
    # the sloppy, the collectors' victims and the vendors' buyers share few addresses
    shared = f"CASE kind WHEN 'peeling_chain_sloppy' THEN pmod(h, 2) WHEN 'ransomware_collector' THEN pmod(h, 2) WHEN 'darknet_vendor' THEN pmod(h, 3) ELSE h + {_draw(seed, 'far', 10, 180, 'e, h')} END"
    ip = f"concat('10.', pmod(e, 250), '.', CAST(floor(e / 250) AS BIGINT) % 250, '.', {shared})"
    return steps.selectExpr("e", "kind", "n", "h", f"base + h * ({gap}) + {_draw(seed, 'late', 0, 9, 'e, h')} AS minute", f"{ip} AS ip", f"{case(0)} AS ins", f"{case(1)} AS outs")


def dataset(spark: SparkSession, counts: dict[str, int] = COUNTS, seed: int = 42) -> dict[str, DataFrame]:
    """The four tables as they are written: legs, relay, truth (an entity a row) and coinjoin."""
    name = lambda raw: F.concat(F.lit("bc1q"), F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), raw), 256), 1, 20))
    txs = transactions(spark, counts, seed).withColumn("txid", F.concat(F.lit("tx_"), F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "e", F.lit(":"), "h"), 256), 1, 16)))
    txs = txs.withColumn("timestamp", F.date_format(F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, {START} + 60 * minute)"), "yyyy-MM-dd'T'HH:mm:ss"))
    total = lambda legs: F.aggregate(legs, F.lit(0).cast("long"), lambda a, x: a + x["amount"])
    txs = txs.withColumn("fee", total("ins") - total("outs"))
    side = lambda legs, role: F.transform(legs, lambda x: F.struct(F.lit(role).alias("role"), x["wallet"].alias("raw"), x["amount"].alias("amount")))
    sides = F.concat(side("ins", "input"), side("outs", "output"))
    script = F.element_at(F.array(*map(F.lit, ["P2PKH"] * 10 + ["P2WPKH"] * 7 + ["P2TR"] * 3)), (F.pmod(F.xxhash64(F.lit(seed), F.lit("script"), "leg.raw"), F.lit(20)) + 1).cast("int"))
    legs = txs.withColumn("leg", F.explode(sides)).select("txid", name(F.col("leg.raw")).alias("wallet"), "leg.role", (F.col("leg.amount") / COIN).alias("amount"), "timestamp", (F.col("fee") / COIN).alias("fee"), script.alias("script_type"))
    port = 1024 + F.pmod(F.xxhash64(F.lit(seed), F.lit("port"), "e", "h"), F.lit(60000))
    relay = txs.select("txid", "timestamp", F.col("ip").alias("src_ip"), F.lit("10.255.0.1").alias("dst_ip"), port.cast("int").alias("src_port"), F.lit(8333).alias("dst_port"))
    raws = F.expr(f"""CASE kind WHEN 'mixer_coinjoin' THEN array() WHEN 'ransomware_collector' THEN array(concat('w', e, '_0'))
      ELSE transform(sequence(0L, CASE kind WHEN 'legit_business' THEN 2 * n - 1 ELSE n END), i -> concat('w', e, '_', i)) END""")
    truth = txs.where("h = 0").select("e", F.format_string("%05d", "e").alias("entity_id"), F.col("kind").alias("entity_type"), F.col("kind").isin(*ILLICIT).alias("is_illicit"), F.transform(raws, name).alias("wallets"), F.when(F.col("kind") == "mixer_coinjoin", F.array("txid")).alias("coinjoin_txids"))
    return {"legs": legs, "relay": relay, "truth": truth, "coinjoin": txs.where("kind = 'mixer_coinjoin'").select("e", "txid")}


def write_dataset(spark: SparkSession, folder: str, counts: dict[str, int] = COUNTS, seed: int = 42) -> dict[str, str]:
    """Write the data set: two CSV tables and two of JSON arrays, one array of at most IN_A_FILE entities in each file. The paths."""
    tables = dataset(spark, counts, seed)
    paths = {"legs": f"{folder}/bitcoin_transactions.csv", "relay": f"{folder}/relay_events.csv", "truth": f"{folder}/ground_truth.json", "coinjoin": f"{folder}/coinjoin_ground_truth.json"}
    for name in ("legs", "relay"):
        readers.write_csv(tables[name], paths[name])
    for name, row in (("truth", F.struct("entity_id", "entity_type", "is_illicit", "wallets", "coinjoin_txids")), ("coinjoin", F.col("txid"))):
        arrays = tables[name].groupBy(F.floor(F.col("e") / IN_A_FILE).alias("file")).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("value"))
        arrays.write.mode("overwrite").partitionBy("file").text(paths[name])
    return paths
