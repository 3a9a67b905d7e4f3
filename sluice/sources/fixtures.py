"""Transaction legs, relay events, truth and transfers derived from the test tables by arithmetic on their keys."""

from __future__ import annotations

from sluice.plans.relations import relation

START = 1704067200  # 2024-01-01 00:00:00 UTC


def s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def ip_number(dotted: str) -> int:
    a, b, c, d = map(int, dotted.split("."))
    return a << 24 | b << 16 | c << 8 | d


relation("nums", "SELECT i FROM (VALUES " + ", ".join(f"({i})" for i in range(24)) + ") AS n(i)")
relation("owners", "SELECT c_custkey AS ck, c_custkey % 20 AS k FROM customer")
relation("steps", "SELECT o.ck, o.k, CAST(n.i AS BIGINT) AS h FROM owners o CROSS JOIN nums n")


def _leg(tx: str, role: str, wallet: str, amount: str, minutes: str, where: str) -> str:
    return f"SELECT ck, h, {tx} AS txid, '{role}' AS role, {wallet} AS wallet, CAST({amount} AS DOUBLE) AS amount, {minutes} AS minutes FROM steps WHERE {where}"


def _id(prefix: str, *parts: str) -> str:
    return f"'{prefix}' || " + " || '_' || ".join(s(p) for p in parts)


_PEEL = ("ck + h * CASE WHEN ck % 40 = 0 THEN 60 ELSE 600 END", "k = 0 AND h < 6 + ck % 8")
_RANSOM = ("ck + 300 * h", "k = 1 AND h < 5 + ck % 6")
_DEPOSIT = ("ck + 120 * h", "k = 2 AND h < 16")
_SWEEP = ("ck + 2400", "k = 2 AND h < 16")
_LEGIT = ("ck + 1000 * h + 10", "k >= 4 AND h < 4")
_ROUND = ("ck + 7", "k = 3 AND h < 6")
_LEGS = [
    _leg(_id("P", "ck", "h"), "input", _id("wp", "ck", "h"), "1000 + ck - 40 * h", *_PEEL),
    _leg(_id("P", "ck", "h"), "output", _id("wp", "ck", "h + 1"), "1000 + ck - 40 * (h + 1)", *_PEEL),
    _leg(_id("P", "ck", "h"), "output", _id("xp", "ck", "h"), "40", *_PEEL),
    _leg(_id("R", "ck", "h"), "input", _id("xr", "ck", "h"), "500", *_RANSOM),
    _leg(_id("R", "ck", "h"), "output", _id("wr", "ck"), "495", *_RANSOM),
    _leg(_id("V", "ck", "h"), "input", _id("xv", "ck", "h"), "20 + h", *_DEPOSIT),
    _leg(_id("V", "ck", "h"), "output", _id("wv", "ck", "h % 8"), "19 + h", *_DEPOSIT),
    _leg(_id("VS", "ck"), "input", _id("wv", "ck", "h % 8"), "19 + h", *_SWEEP),
    _leg(_id("VS", "ck"), "output", "'wv' || " + s("ck") + " || '_vault'", "400", _SWEEP[0], "k = 2 AND h = 0"),
    _leg(_id("M", "ck"), "input", "'wl' || " + s("ck + 4 + 2 * h") + " || '_0'", "101", *_ROUND),
    _leg(_id("M", "ck"), "output", _id("xm", "ck", "h"), "100 + CAST(h AS DOUBLE) / 10", *_ROUND),
    _leg(_id("L", "ck", "h"), "input", _id("wl", "ck", "h"), "100 + ck % 50", *_LEGIT),
    _leg(_id("L", "ck", "h"), "output", _id("wl", "ck", "h + 1"), "CAST(100 + ck % 50 AS DOUBLE) * CAST(0.5 AS DOUBLE)", *_LEGIT),
    _leg(_id("L", "ck", "h"), "output", _id("xl", "ck", "h"), "CAST(100 + ck % 50 AS DOUBLE) * CAST(0.4 AS DOUBLE)", *_LEGIT),
]
relation("legs_raw", "\nUNION ALL ".join(_LEGS))
relation(
    "legs",
    f"""
SELECT CAST(row_number() OVER (ORDER BY minutes, txid, role, wallet, amount) AS BIGINT) AS seq, txid, wallet, role, amount,
  {START} + 60 * minutes AS t,
  round(sum(CASE WHEN role = 'input' THEN amount ELSE -amount END) OVER (PARTITION BY txid), 8) AS fee,
  CASE (ck + h) % 3 WHEN 0 THEN 'P2PKH' WHEN 1 THEN 'P2WPKH' ELSE 'P2TR' END AS script_type
FROM legs_raw""",
)
_IP = f"""CASE k WHEN 0 THEN CASE WHEN ck % 40 = 0 THEN '10.1.' || {s("ck % 200")} || '.1' ELSE '10.2.0.' || {s("h % 5")} END
  WHEN 1 THEN '10.3.' || {s("ck % 200")} || '.1' WHEN 2 THEN '10.4.0.' || {s("h % 4")} WHEN 3 THEN '10.8.' || {s("ck % 200")} || '.1'
  ELSE '10.9.' || {s("ck % 200")} || '.' || {s("h")} END"""
_TX = f"""CASE k WHEN 0 THEN {_id("P", "ck", "h")} WHEN 1 THEN {_id("R", "ck", "h")} WHEN 2 THEN {_id("V", "ck", "h")}
  WHEN 3 THEN {_id("M", "ck")} ELSE {_id("L", "ck", "h")} END"""
relation(
    "relay_raw",
    f"""
SELECT ck, h, {_TX} AS txid, {_IP} AS src_ip,
  CASE k WHEN 0 THEN {_PEEL[0]} WHEN 1 THEN {_RANSOM[0]} WHEN 2 THEN {_DEPOSIT[0]} WHEN 3 THEN {_ROUND[0]} ELSE {_LEGIT[0]} END AS minutes
FROM steps WHERE ({_PEEL[1]}) OR ({_RANSOM[1]}) OR ({_DEPOSIT[1]}) OR (k = 3 AND h = 0) OR ({_LEGIT[1]})
UNION ALL SELECT ck, h, {_id("VS", "ck")}, '10.4.0.9', ck + 2400 FROM steps WHERE k = 2 AND h = 0""",
)
relation("relay", f"SELECT CAST(row_number() OVER (ORDER BY minutes, txid) AS BIGINT) AS seq, txid, {START} + 60 * minutes AS t, src_ip, '10.0.0.1' AS dst_ip, CAST(1024 + ck % 50000 AS BIGINT) AS src_port, CAST(8333 AS BIGINT) AS dst_port FROM relay_raw")
relation(
    "truth",
    f"""
SELECT 'E' || {s("ck")} AS entity_id,
  CASE k WHEN 0 THEN CASE WHEN ck % 40 = 0 THEN 'peeling_chain_sloppy' ELSE 'peeling_chain_careful' END
    WHEN 1 THEN 'ransomware_collector' WHEN 2 THEN 'darknet_vendor' ELSE 'legit_individual' END AS entity_type,
  k <= 2 AS is_illicit,
  CASE k WHEN 0 THEN {_id("wp", "ck", "h")} WHEN 1 THEN {_id("wr", "ck")}
    WHEN 2 THEN CASE WHEN h = 8 THEN 'wv' || {s("ck")} || '_vault' ELSE {_id("wv", "ck", "h")} END ELSE {_id("wl", "ck", "h")} END AS wallet
FROM steps WHERE (k = 0 AND h <= 6 + ck % 8) OR (k = 1 AND h = 0) OR (k = 2 AND h <= 8) OR (k >= 4 AND h <= 4)""",
)
relation("truth_coinjoin", f"SELECT {_id('M', 'ck')} AS txid FROM owners WHERE k = 3")


def _ranges(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"CAST({ip_number(v)} AS BIGINT)" if i < 2 else f"'{v}'" for i, v in enumerate(r)) + ")" for r in rows)


_COVERED = [("10.1.0.0", "10.1.255.255"), ("10.2.0.0", "10.2.0.255"), ("10.3.0.0", "10.3.255.255"), ("10.4.0.0", "10.4.0.127"), ("10.9.0.0", "10.9.99.255")]
relation("geo_country", "SELECT * FROM (VALUES " + _ranges([(*r, c) for r, c in zip(_COVERED, ("AA", "BB", "CC", "DD", "NA"), strict=True)]) + ") AS g(start_int, end_int, country)")
relation("geo_asn", "SELECT * FROM (VALUES " + _ranges([(*r, f"AS{64500 + i}", f"Network {i}") for i, r in enumerate(_COVERED)]) + ") AS g(start_int, end_int, asn, asn_org)")

relation("read_items", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag FROM lineitem")
relation("read_orders", "SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders")
#: Accounts of the test data that stand for an analyst's own watch list.
relation("own_watched", "SELECT * FROM (VALUES ('ACC7', 'Suspected crypto gateway'), ('ACC13', 'Suspected crypto gateway')) AS w(id, exchange)")
relation("n_customers", "SELECT count(*) AS n FROM customer")
relation(
    "ordered_items",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_returnflag || CAST(l_linenumber AS STRING) = 'R' || CAST(l_linenumber AS STRING) THEN 1 ELSE 0 END AS returned,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS s FROM read_items""",
)
# the keys beside the flags keep the oracle from working on dictionary codes, where its engine fails at times;
# only numbers pass through the joins and the numbering; names are put to them at the end
relation("placed_orders", "SELECT o_orderkey, o_custkey, $EPOCH[o_orderdate] AS day_t, CAST(substring(o_orderpriority || CAST(o_orderkey AS STRING), 1, 1) AS BIGINT) AS urgency FROM read_orders")
relation(
    "transfers_raw",
    f"""
SELECT a.c_custkey AS a_key, b.c_custkey AS b_key, a.c_nationkey AS a_nation, b.c_nationkey AS b_nation, urgency, returned,
  CAST(CASE WHEN l_linenumber = 1 OR l_partkey % 50 = 0 THEN floor(l_extendedprice / 10000) * 10000 + 10000 ELSE l_extendedprice END AS DOUBLE) AS amount,
  day_t + (o_orderkey * 37 + s * 600) % 86400 AS t
FROM ordered_items JOIN placed_orders ON l_orderkey = o_orderkey CROSS JOIN n_customers
JOIN customer a ON o_custkey = a.c_custkey JOIN customer b ON l_partkey % n = b.c_custkey""",
)
relation("transfers_numbered", f"SELECT *, CAST(row_number() OVER (ORDER BY t, {s('a_key')}, {s('b_key')}, amount) AS BIGINT) AS seq FROM transfers_raw")
relation("urgencies", "SELECT * FROM (VALUES (1, '1-URGENT'), (2, '2-HIGH'), (3, '3-MEDIUM'), (4, '4-NOT SPECIFIED'), (5, '5-LOW')) AS u(code, case_id)")
relation(
    "transfers",
    f"""
SELECT f.seq, f.amount, 'ACC' || {s("f.a_key")} AS sender_id, 'ACC' || {s("f.b_key")} AS receiver_id, f.t,
  '10.0.' || {s("f.a_key % 97")} || '.' || {s("f.a_nation")} AS sender_ip, '10.0.' || {s("f.b_key % 97")} || '.' || {s("f.b_nation")} AS receiver_ip,
  '9' || {s("1000000 + f.a_key")} AS sender_phone, n.n_name AS sender_city, u.case_id, CASE WHEN f.returned = 1 THEN 'SUSPECTED_CASH' ELSE 'DIGITAL' END AS transfer_type
FROM transfers_numbered f JOIN nation n ON f.a_nation = n.n_nationkey JOIN urgencies u ON f.urgency = u.code""",
)
