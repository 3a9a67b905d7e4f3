"""Account-layer analytics over ``transfers``: aggregates, shared identities, hubs, rules, temporal patterns, responses."""

from __future__ import annotations

from sluice.plans.relations import relation

ROUND, SMALL, WINDOW = 10000, 50000, 7200
#: The account that single-account relations are about.
ACCOUNT = "ACC11"

# scans, filters, set operations
relation("src_transfers", "SELECT seq, sender_id, receiver_id, amount, t, sender_ip, receiver_ip, sender_phone, sender_city, case_id, transfer_type FROM transfers")
relation("sink_neo4j", "SELECT sender_id AS id FROM transfers UNION SELECT receiver_id FROM transfers")
relation("all_accounts", "SELECT id FROM sink_neo4j")
relation("scan_graph", "SELECT seq, sender_id, receiver_id, amount, t, case_id, transfer_type FROM transfers")
relation("filter_case", "SELECT seq, sender_id, receiver_id, amount, transfer_type FROM transfers WHERE case_id = '1-URGENT'")
# the filters of a case and an address, and of a telephone and a city: what passes as edges, and its accounts as nodes
relation("own_address", f"SELECT max(ip) AS ip FROM own_ip WHERE id = '{ACCOUNT}'")
for _name, _where in (
    ("filter_transfers", "case_id = '2-HIGH' AND (sender_ip = (SELECT ip FROM own_address) OR receiver_ip = (SELECT ip FROM own_address))"),
    ("filter_sender", f"CAST(sender_phone AS STRING) = '91000011' AND lower(sender_city) = lower((SELECT max(city) FROM own_city WHERE id = '{ACCOUNT}'))"),
):
    relation(f"{_name}_edges", f"SELECT seq, sender_id, receiver_id, amount, transfer_type FROM transfers WHERE {_where}")
    relation(
        _name,
        f"""
SELECT 'edge' AS kind, seq, sender_id AS a, receiver_id AS b, amount, transfer_type FROM {_name}_edges
UNION ALL SELECT 'node', NULL, id, NULL, NULL, NULL FROM (SELECT sender_id AS id FROM {_name}_edges UNION SELECT receiver_id FROM {_name}_edges)""",
    )
relation("filter_exclude_ids", "SELECT id FROM all_accounts WHERE id NOT IN ('ACC0', 'ACC1', 'ACC2')")
relation("union_all_events", "SELECT sender_id AS id, t, amount, 'out' AS side, seq FROM transfers UNION ALL SELECT receiver_id, t, amount, 'in', seq FROM transfers")
relation("account_totals", "SELECT id, count_if(side = 'in') AS n_in, count_if(side = 'out') AS n_out, round(sum(CASE WHEN side = 'in' THEN amount ELSE 0 END), 4) AS total_in, round(sum(CASE WHEN side = 'out' THEN amount ELSE 0 END), 4) AS total_out FROM union_all_events GROUP BY id")
relation("timeline", f"SELECT seq, side, CAST(floor(t / 60) AS BIGINT) AS minute, amount FROM union_all_events WHERE id = '{ACCOUNT}'")
relation("graph_nodes_edges", "SELECT 'edge' AS kind, sender_id AS a, receiver_id AS b, count(*) AS n FROM transfers GROUP BY sender_id, receiver_id UNION ALL SELECT 'node', id, NULL, n_in + n_out FROM account_totals")

# dashboards
relation("city_totals", "SELECT sender_city, round(sum(amount), 4) AS total FROM transfers GROUP BY sender_city")
relation("daily_totals", "SELECT $DAY[t] AS day, round(sum(amount), 4) AS total, count(*) AS n FROM transfers GROUP BY $DAY[t]")
relation("edge_total", "SELECT round(sum(amount), 3) AS total, count(*) AS n FROM transfers")
relation("own_city", "SELECT sender_id AS id, max_by(sender_city, seq) AS city FROM transfers GROUP BY sender_id")
relation("city_flow_lookup", "SELECT f.seq, f.sender_city AS from_city, coalesce(c.city, f.sender_city) AS to_city, f.amount, f.transfer_type FROM transfers f LEFT JOIN own_city c ON f.receiver_id = c.id")
relation("city_all_flows", "SELECT seq, from_city, to_city, amount FROM city_flow_lookup")
#: The constant flows that a dashboard always shows.
_DEMO = "(VALUES ('Mumbai', 'Delhi', 195000), ('Chennai', 'Mumbai', 210000), ('Hyderabad', 'Bangalore', 188000), ('Kolkata', 'Delhi', 165000), ('Bangalore', 'Kolkata', 143000)) AS d(from_city, to_city, total)"
relation("demo_flows", f"SELECT from_city, to_city, CAST(total AS DOUBLE) AS total FROM {_DEMO}")
relation("city_pair_flows", "SELECT from_city, to_city, round(sum(amount), 4) AS total, count(*) AS n, 'data' AS origin FROM city_flow_lookup WHERE from_city <> to_city GROUP BY from_city, to_city UNION ALL SELECT d.from_city, d.to_city, d.total, 1, 'demo' FROM demo_flows d LEFT JOIN (SELECT DISTINCT from_city, to_city FROM city_flow_lookup) c ON d.from_city = c.from_city AND d.to_city = c.to_city WHERE c.from_city IS NULL")
relation("city_map_totals", "SELECT city, round($EXACT[total], 2) AS total FROM (SELECT from_city AS city, amount AS total FROM city_flow_lookup UNION ALL SELECT from_city, total FROM demo_flows) GROUP BY city")
relation("filter_country_city", "SELECT from_city, to_city, total FROM city_pair_flows WHERE from_city = 'CHINA' OR to_city = 'CHINA'")
relation("flow_type", "SELECT from_city, to_city, CASE WHEN avg(CASE WHEN transfer_type = 'SUSPECTED_CASH' THEN CAST(1 AS DOUBLE) ELSE 0 END) >= 0.5 THEN 'cash' ELSE 'digital' END AS kind FROM city_flow_lookup GROUP BY from_city, to_city")

# hubs and shared identities
relation("community", "SELECT receiver_id AS hub, count(*) AS inbound_count, $SHA[$LIST[sender_id]] AS senders_sha, CASE WHEN count(*) >= 4 THEN 'CRITICAL' ELSE 'HIGH' END AS threat FROM transfers GROUP BY receiver_id HAVING count(*) >= 2")
relation("cypher_topk", "SELECT hub, inbound_count, threat FROM community ORDER BY inbound_count DESC, hub LIMIT 10")
relation("recruitment", "SELECT sender_ip AS ip, count(DISTINCT sender_id) AS n_accounts, $SET[sender_id] AS accounts, $SET[sender_city] AS cities FROM transfers GROUP BY sender_ip HAVING count(DISTINCT sender_id) >= 2")
relation("ip_users", "SELECT DISTINCT sender_ip, sender_id FROM transfers")
relation("identity_fusion", "SELECT a.sender_id AS account1, b.sender_id AS account2, a.sender_ip AS shared_ip FROM ip_users a JOIN ip_users b ON a.sender_ip = b.sender_ip AND a.sender_id < b.sender_id")
relation("hub_in", "SELECT receiver_id AS id, count(DISTINCT sender_id) AS unique_senders, $EXACT[amount] AS total_in FROM transfers GROUP BY receiver_id")
relation("hub_out", "SELECT sender_id AS id, count(DISTINCT receiver_id) AS unique_receivers, $EXACT[amount] AS total_out FROM transfers GROUP BY sender_id")
relation(
    "hawala",
    """
SELECT i.id, i.unique_senders, coalesce(o.unique_receivers, 0) AS unique_receivers, $INT[i.total_in] AS inflow, $INT[coalesce(o.total_out, 0)] AS outflow,
  round(coalesce(o.total_out, 0) / (i.total_in + 1), 6) AS ratio, CASE WHEN i.unique_senders >= 4 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
FROM hub_in i LEFT JOIN hub_out o ON i.id = o.id WHERE i.unique_senders >= 3 AND coalesce(o.total_out, 0) / (i.total_in + 1) >= 0.95""",
)
relation(
    "shell_company",
    f"""
SELECT receiver_id AS id, count(*) AS n, $INT[$EXACT[amount]] AS total, round(avg(CASE WHEN amount % {ROUND} = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS round_share, count(DISTINCT sender_id) AS senders,
  CASE WHEN avg(CASE WHEN amount % {ROUND} = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM transfers GROUP BY receiver_id HAVING count(*) >= 2 AND avg(CASE WHEN amount % {ROUND} = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) >= 0.5 AND count(DISTINCT sender_id) >= 2""",
)
#: Watched accounts. An analyst's own are added.
_WATCHED = "('CRYPTO_BTC1', 'Binance BTC deposit'), ('CRYPTO_ETH1', 'Coinbase ETH deposit'), ('CRYPTO_USDT1', 'WazirX USDT deposit'), ('CRYPTO_BNB1', 'Binance BNB deposit'), ('DEALER1', 'Suspected crypto gateway'), ('DEALER2', 'Suspected crypto gateway')"
relation("watched", f"SELECT id, exchange FROM (VALUES {_WATCHED}) AS w(id, exchange) UNION ALL SELECT id, exchange FROM own_watched")
relation("crypto_gateway", "SELECT f.seq, f.sender_id, f.receiver_id, w.exchange, $INT[f.amount] AS amount, CAST(floor($INT[f.amount] / 1000) AS BIGINT) AS thousands FROM transfers f JOIN watched w ON f.receiver_id = w.id")
relation("pairs", "SELECT DISTINCT sender_id AS src, receiver_id AS dst FROM transfers")
relation("two_hops", "SELECT DISTINCT a.src, b.dst FROM pairs a JOIN pairs b ON a.dst = b.src")
relation("reach_three", "SELECT src, dst FROM pairs UNION SELECT src, dst FROM two_hops UNION SELECT a.src, b.dst FROM two_hops a JOIN pairs b ON a.dst = b.src")
relation("convergence", "SELECT dst AS id, count(*) AS sources FROM reach_three GROUP BY dst HAVING count(*) >= 3")
#: The ten longest trails to an account. A trail's key is the numbers of its transfers from the account back, so in the order
#: of keys all that grows from an earlier trail comes before what grows from a later one: the first BEAM of each length give the first of the next.
BEAM, TOP_TRAILS = 1000, 10
_SEQ = "lpad(CAST({0} AS STRING), 14, '0')"
relation("trail_1", f"SELECT {_SEQ.format('seq')} AS k, sender_id || '|' || receiver_id AS nodes, sender_id AS head, CAST(1 AS BIGINT) AS n_hops FROM transfers WHERE receiver_id = '{ACCOUNT}' AND sender_id <> receiver_id ORDER BY k LIMIT {BEAM}")
for _i in range(2, 6):
    relation(
        f"trail_{_i}",
        f"""
SELECT b.k || {_SEQ.format("f.seq")} AS k, f.sender_id || '|' || b.nodes AS nodes, f.sender_id AS head, b.n_hops + 1 AS n_hops
FROM trail_{_i - 1} b JOIN transfers f ON b.head = f.receiver_id WHERE position('|' || f.sender_id || '|' IN '|' || b.nodes || '|') = 0 ORDER BY k LIMIT {BEAM}""",
    )
relation("reverse_chain", "SELECT nodes, n_hops FROM (" + " UNION ALL ".join(f"SELECT * FROM trail_{i}" for i in range(1, 6)) + f") ORDER BY n_hops DESC, k LIMIT {TOP_TRAILS}")

# windows in time
# a row's window reaches into the next bucket at most, so each row is in its own bucket and, for those before it, in the previous one
relation("event_times", f"SELECT event_id, user_id, value, t, CAST(floor(t / {WINDOW}) AS BIGINT) AS bucket FROM (SELECT event_id, user_id, value, $EPOCH[ts] AS t FROM events)")
relation(
    "event_windows",
    f"""
SELECT event_id, user_id, t, value, n, total FROM (
  SELECT *, count(*) OVER w AS n, sum(value) OVER w AS total FROM (
    SELECT event_id, user_id, value, t, bucket, 1 AS own FROM event_times UNION ALL SELECT event_id, user_id, value, t, bucket - 1, 0 FROM event_times)
  WINDOW w AS (PARTITION BY bucket ORDER BY t RANGE BETWEEN CURRENT ROW AND {WINDOW} FOLLOWING))
WHERE own = 1""",
)
relation("coordination", "SELECT hour, n, round(total, 4) AS total FROM (SELECT CAST(floor(t / 3600) AS BIGINT) AS hour, n, total, row_number() OVER (PARTITION BY CAST(floor(t / 3600) AS BIGINT) ORDER BY t, event_id) AS r FROM event_windows WHERE n >= 3) WHERE r = 1")
relation("sent_stats", "SELECT sender_id AS id, count(*) AS n, (max(t) - min(t)) / CAST(3600 AS DOUBLE) AS span FROM transfers GROUP BY sender_id")
relation("sent_windows", f"SELECT sender_id AS id, seq, t, count(*) OVER (PARTITION BY sender_id ORDER BY t RANGE BETWEEN CURRENT ROW AND {WINDOW} FOLLOWING) AS n FROM transfers")
relation("velocity_spike", "SELECT id, t, n FROM (SELECT w.id, w.t, w.n, row_number() OVER (PARTITION BY w.id ORDER BY w.t, w.seq) AS r FROM sent_windows w JOIN sent_stats s ON w.id = s.id WHERE s.n >= 3 AND s.span > 0 AND w.n / CAST(2 AS DOUBLE) >= 2.5 * s.n / s.span AND w.n >= 2) WHERE r = 1")
relation(
    "event_runs",
    """
SELECT id, t, seq, side, amount, lag(t) OVER o AS before_t, count(*) OVER (PARTITION BY id) AS n_all,
  avg(amount) OVER (PARTITION BY id ORDER BY t RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS avg_after, count(*) OVER (PARTITION BY id ORDER BY t RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n_after,
  avg(amount) OVER (PARTITION BY id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS avg_before
FROM union_all_events WINDOW o AS (PARTITION BY id ORDER BY t, side, seq)""",
)
relation("run_gaps", "SELECT r.*, lag(r.avg_before) OVER (PARTITION BY id ORDER BY t, side, seq) AS avg_earlier FROM event_runs r")
relation("dormant_reactivation", "SELECT id, t, days, n_after FROM (SELECT id, t, n_after, CAST(floor((t - before_t) / 86400) AS BIGINT) AS days, row_number() OVER (PARTITION BY id ORDER BY t, side, seq) AS r FROM run_gaps WHERE n_all >= 3 AND t - before_t >= 30 * 86400 AND n_after >= 2 AND (avg_after > 1.5 * coalesce(avg_earlier, 0) OR coalesce(avg_earlier, 0) = 0)) WHERE r = 1")
# what is received is passed on within the same fortnight or the next: the join is on the account and the fortnight
FORTNIGHT = 336 * 3600
relation("received_bins", f"SELECT receiver_id, seq, t, amount, CAST(floor(t / {FORTNIGHT}) AS BIGINT) AS bin FROM transfers UNION ALL SELECT receiver_id, seq, t, amount, CAST(floor(t / {FORTNIGHT}) AS BIGINT) + 1 FROM transfers")
relation(
    "passed_on",
    f"""
SELECT i.receiver_id AS id, i.seq AS in_seq, o.seq AS out_seq, (o.t - i.t) / CAST(3600 AS DOUBLE) AS delay, o.amount / (i.amount + 1) AS ratio
FROM received_bins i JOIN (SELECT sender_id, seq, t, amount, CAST(floor(t / {FORTNIGHT}) AS BIGINT) AS bin FROM transfers) o
ON i.receiver_id = o.sender_id AND i.bin = o.bin AND o.t > i.t AND o.t <= i.t + {FORTNIGHT}""",
)
relation("delayed_layering", "SELECT id, in_seq, out_seq, round(delay, 6) AS delay, round(ratio, 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY in_seq, out_seq) AS r FROM passed_on WHERE delay >= 1 AND ratio BETWEEN 0.7 AND 1.0) WHERE r = 1")
relation("rapid_forward", "SELECT id, in_seq, out_seq, round(delay, 6) AS delay FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY in_seq, out_seq) AS r FROM passed_on WHERE delay <= 6) WHERE r = 1")
relation("smurfing_sequence", f"SELECT sender_id AS id, count_if(amount < {SMALL}) AS small, $INT[$EXACT[CASE WHEN amount < {SMALL} THEN amount ELSE 0 END]] AS total FROM transfers GROUP BY sender_id HAVING count(*) >= 3 AND count_if(amount < {SMALL}) >= 3 AND count_if(amount < {SMALL}) / CAST(count(*) AS DOUBLE) >= 0.6")
relation("temporal_hits", " UNION ALL ".join(f"SELECT id, '{p}' AS pattern FROM {p}" for p in ("dormant_reactivation", "delayed_layering", "velocity_spike", "smurfing_sequence", "rapid_forward")))
relation("temporal_score", "SELECT id, CAST(least(25 * count(*), 100) AS BIGINT) AS score, count(*) AS n, $LIST[pattern] AS patterns FROM temporal_hits GROUP BY id")
relation("temporal_level", "SELECT id, score, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'CLEAR' END AS level FROM temporal_score")

# features and rules
relation("sent", f"SELECT sender_id AS id, count(*) AS n, $EXACT[amount] AS total, $EXACT[amount] / count(*) AS mean, count(DISTINCT receiver_id) AS partners, count(DISTINCT sender_city) AS cities, min(t) AS first_t, max(t) AS last_t, count_if(amount % {ROUND} = 0) AS n_round FROM transfers GROUP BY sender_id")
relation("received", f"SELECT receiver_id AS id, count(*) AS n, $EXACT[amount] AS total, $EXACT[amount] / count(*) AS mean, count(DISTINCT sender_id) AS partners, count(DISTINCT sender_city) AS cities, count(DISTINCT sender_ip) AS ips, max(t) AS last_t, count_if(amount % {ROUND} = 0) AS n_round FROM transfers GROUP BY receiver_id")
relation(
    "feature_rows",
    """
SELECT a.id, coalesce(s.total, 0) AS total_outgoing, coalesce(r.total, 0) AS total_incoming, coalesce(s.n, 0) AS num_outgoing, coalesce(r.n, 0) AS num_incoming,
  coalesce(s.partners, 0) AS unique_receivers, coalesce(r.partners, 0) AS unique_senders, coalesce(r.ips, 0) AS unique_ips, coalesce(s.cities, 0) AS unique_cities,
  coalesce(s.total, 0) / (coalesce(r.total, 0) + 1) AS forwarding_ratio,
  CASE WHEN (s.n >= 2 AND s.last_t - s.first_t <= 7200) OR (s.first_t - r.last_t BETWEEN 0 AND 7200) THEN 1 ELSE 0 END AS rapid_transfer,
  CASE WHEN s.n >= 3 AND s.mean < 50000 THEN 1 ELSE 0 END AS smurfing_score, CASE WHEN r.ips = 1 AND r.n >= 2 THEN 1 ELSE 0 END AS ip_concentration,
  coalesce(s.mean, 0) AS avg_outgoing, coalesce(r.mean, 0) AS avg_incoming, greatest(coalesce(s.total, 0), coalesce(r.total, 0)) AS max_single_transfer,
  (s.last_t - s.first_t) / 60 AS out_minutes, coalesce(r.cities, 0) AS in_cities, coalesce(s.n_round, 0) + coalesce(r.n_round, 0) AS n_round
FROM all_accounts a LEFT JOIN sent s ON a.id = s.id LEFT JOIN received r ON a.id = r.id""",
)
relation(
    "acct_features",
    "SELECT id, round(total_outgoing, 4) AS total_outgoing, round(total_incoming, 4) AS total_incoming, num_outgoing, num_incoming, unique_receivers, unique_senders, unique_ips, unique_cities, round(forwarding_ratio, 6) AS velocity_ratio, round(forwarding_ratio, 6) AS forwarding_ratio, rapid_transfer, smurfing_score, ip_concentration, round(avg_outgoing, 8) AS avg_outgoing_amount, round(avg_incoming, 8) AS avg_incoming_amount, round(max_single_transfer, 4) AS max_single_transfer FROM feature_rows",
)
relation("weak_labels", "SELECT id, CASE WHEN (forwarding_ratio > 0.8 AND num_outgoing >= 2) OR (unique_senders >= 2 AND unique_receivers >= 2 AND forwarding_ratio > 0.6) OR (num_incoming >= 1 AND num_outgoing >= 2 AND forwarding_ratio > 0.5) OR ip_concentration = 1 THEN 1 ELSE 0 END AS label FROM feature_rows")
relation("stratified_split", "SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY $SHA['42:' || id], id) <= floor(0.2 * count(*) OVER (PARTITION BY label)) AS held_out FROM weak_labels")
relation("cv_folds", "SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY $SHA['42:' || id], id) - 1) % 5 AS BIGINT) AS fold FROM weak_labels")
relation("shared_addresses", "SELECT DISTINCT i.receiver_id AS id FROM (SELECT DISTINCT receiver_id, sender_ip FROM transfers) i JOIN (SELECT DISTINCT sender_id, sender_ip FROM transfers) o ON i.receiver_id = o.sender_id AND i.sender_ip = o.sender_ip")
relation(
    "rule_points",
    """
SELECT f.id, CASE WHEN unique_receivers >= 3 THEN 35 WHEN unique_receivers >= 2 THEN 20 ELSE 0 END AS fan_out, CASE WHEN unique_senders >= 3 THEN 20 WHEN unique_senders >= 2 THEN 10 ELSE 0 END AS fan_in,
  CASE WHEN num_incoming < 2 THEN 0 WHEN unique_ips = 1 THEN 30 WHEN unique_ips < num_incoming THEN 15 ELSE 0 END AS same_ip, CASE WHEN s.id IS NOT NULL THEN 20 ELSE 0 END AS own_ip,
  CASE WHEN num_outgoing < 2 THEN 0 WHEN out_minutes <= 30 THEN 25 WHEN out_minutes <= 120 THEN 15 ELSE 0 END AS burst,
  CASE WHEN num_outgoing < 2 THEN 0 WHEN unique_cities >= 3 THEN 15 WHEN unique_cities >= 2 THEN 8 ELSE 0 END AS spread_out, CASE WHEN num_incoming < 2 THEN 0 WHEN in_cities >= 3 THEN 15 WHEN in_cities >= 2 THEN 8 ELSE 0 END AS spread_in,
  CASE WHEN total_incoming <= 0 OR total_outgoing <= 0 THEN 0 WHEN total_outgoing / nullif(total_incoming, 0) >= 0.9 THEN 20 WHEN total_outgoing / nullif(total_incoming, 0) >= 0.7 THEN 10 ELSE 0 END AS forwards,
  CASE WHEN total_outgoing > 300000 THEN 15 WHEN total_outgoing > 100000 THEN 8 ELSE 0 END AS volume,
  CASE WHEN num_incoming + num_outgoing >= 2 AND n_round / CAST(num_incoming + num_outgoing AS DOUBLE) >= 0.8 THEN 10 ELSE 0 END AS rounded
FROM feature_rows f LEFT JOIN shared_addresses s ON f.id = s.id""",
)
_POINTS = ("fan_out", "fan_in", "same_ip", "own_ip", "burst", "spread_out", "spread_in", "forwards", "volume", "rounded")
relation("rule_sums", f"SELECT id, {' + '.join(_POINTS)} AS points, {' + '.join(f'CASE WHEN {p} > 0 THEN 1 ELSE 0 END' for p in _POINTS)} AS n_flags FROM rule_points")
relation("rule_risk", "SELECT id, CAST(least(points, 100) AS BIGINT) AS score, CAST(n_flags AS BIGINT) AS n_flags, CASE WHEN points >= 70 THEN 'CRITICAL' WHEN points >= 50 THEN 'HIGH' WHEN points >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM rule_sums")
#: What an account's name says of its role, and the level and score that each screen gives to the role.
_ROLES = {
    "CRIMINAL": "contains({0}, 'CRIMINAL')",
    "DEALER": "(contains({0}, 'DEALER') OR contains({0}, 'COLLECTOR'))",
    "CRYPTO": "contains({0}, 'CRYPTO')",
    "HAWALA": "(contains({0}, 'HAWALA') OR contains({0}, 'SHELL'))",
    "RECRUITER": "contains({0}, 'RECR')",
    "ACC_": "substring({0}, 1, 4) = 'ACC_'",
}
_USUAL = {"CRIMINAL": ("CRITICAL", 92), "DEALER": ("HIGH", 75), "CRYPTO": ("CRITICAL", 88), "HAWALA": ("MEDIUM", 58), "RECRUITER": ("MEDIUM", 55), "ACC_": ("CLEAR", 15)}
OVERRIDES = {
    "account": _USUAL,
    "filter": _USUAL,
    "dashboard": _USUAL,
    "graph": _USUAL | {"DEALER": ("CRITICAL", 88), "CRYPTO": ("HIGH", 78)},
    "temporal": dict(reversed((_USUAL | {"DEALER": ("CRITICAL", 90), "CRYPTO": ("HIGH", 75)}).items())),
}
#: What a screen shows of an account whose name says nothing, if it isn't the account's own: (condition, level, score).
_OTHERWISE = {"dashboard": ("1 = 1", "'CLEAR'", 15), "graph": ("level = 'LOW'", "'CLEAR'", 15)}


def _overridden(screen: str, risks: str) -> str:
    """The first role of the screen that the name shows, in the order of its table, decides."""
    cases = [(_ROLES[role].format("upper(id)"), f"'{level}'", score) for role, (level, score) in OVERRIDES[screen].items()]
    cases += [_OTHERWISE[screen]] if screen in _OTHERWISE else []
    pick = lambda i, own: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[i]}" for c in cases) + f" ELSE {own} END"
    return f"SELECT '{screen}' AS screen, id, CAST({pick(2, 'score')} AS BIGINT) AS score, {pick(1, 'level')} AS level FROM {risks}"


relation("name_override", " UNION ALL ".join(_overridden(s, "temporal_level" if s == "temporal" else "rule_risk") for s in OVERRIDES))
relation("classify_ml", "SELECT r.id, CASE WHEN r.score >= 70 THEN 'CRITICAL' WHEN r.score >= 55 THEN 'HIGH' WHEN r.score >= 50 THEN 'MEDIUM' WHEN r.score >= 30 THEN 'LOW' ELSE 'CLEAR' END AS level, CASE WHEN r.score < 50 THEN 'N/A' WHEN f.forwarding_ratio > 0.9 AND f.rapid_transfer = 1 THEN 'WILLING' ELSE 'UNWITTING' END AS mule_type FROM rule_risk r JOIN feature_rows f ON r.id = f.id")
relation(
    "flags_ml",
    "SELECT id, CASE WHEN forwarding_ratio > 0.8 THEN 'full forwarding;' ELSE '' END || CASE WHEN rapid_transfer = 1 THEN 'rapid transfers;' ELSE '' END || CASE WHEN smurfing_score = 1 THEN 'smurfing;' ELSE '' END || CASE WHEN ip_concentration = 1 THEN 'shared address;' ELSE '' END || CASE WHEN unique_cities >= 3 THEN CAST(unique_cities AS STRING) || ' cities;' ELSE '' END || CASE WHEN unique_receivers >= 3 THEN CAST(unique_receivers AS STRING) || ' receivers;' ELSE '' END AS flags FROM feature_rows",
)
relation("dashboard_totals", "SELECT (SELECT round(sum(amount), 3) FROM transfers) AS volume, (SELECT count(*) FROM transfers) AS n, (SELECT count(*) FROM rule_risk WHERE level = 'HIGH') AS high, (SELECT count(*) FROM rule_risk WHERE level = 'MEDIUM') AS medium")
relation("level_counts", "SELECT level, count(*) AS n FROM classify_ml GROUP BY level")
relation("dashboard_top10", "SELECT id, score FROM rule_risk ORDER BY score DESC, id LIMIT 10")
relation("alerts_top4", "SELECT id, score, level FROM rule_risk WHERE level IN ('CRITICAL', 'HIGH') ORDER BY score DESC, id LIMIT 4")

# responses: the ladder is a table
relation("ladder", "SELECT * FROM (VALUES (85, 101, 'CRITICAL', 'Within 1 hour', 4), (70, 85, 'HIGH', 'Within 24 hours', 3), (50, 70, 'MEDIUM', 'Within 72 hours', 2), (30, 50, 'LOW', 'Weekly review', 1), (0, 30, 'CLEAR', 'Standard cycle', 0)) AS l(lo, hi, response, due, n_notified)")
relation("graduated_response", "SELECT r.id, r.score, l.response, l.due, l.n_notified FROM rule_risk r JOIN ladder l ON r.score >= l.lo AND r.score < l.hi")
relation("alert_bodies", "SELECT * FROM (VALUES (70, 'I4C', 'HIGH'), (70, 'NCRP', 'HIGH'), (85, 'ED/CBI Referral', 'CRITICAL'), (85, 'RBI Crypto Watchlist', 'HIGH')) AS b(least_score, body, priority)")
relation("regulatory_alerts", "SELECT r.id, b.body, b.priority, r.score >= 50 AS str_required, r.score >= 85 AS freeze_required FROM rule_risk r JOIN alert_bodies b ON r.score >= b.least_score")
relation("ml_account", f"SELECT * FROM graduated_response WHERE id = '{ACCOUNT}'")
relation("own_ip", "SELECT a.id, coalesce(s.ip, r.ip) AS ip FROM all_accounts a LEFT JOIN (SELECT sender_id AS id, min_by(sender_ip, seq) AS ip FROM transfers GROUP BY sender_id) s ON a.id = s.id LEFT JOIN (SELECT receiver_id AS id, min_by(receiver_ip, seq) AS ip FROM transfers GROUP BY receiver_id) r ON a.id = r.id")
relation(
    "account_detail",
    f"""
SELECT a.*, o.ip, r.score, r.level, coalesce(s.receivers, '') AS sent_to, coalesce(g.senders, '') AS received_from
FROM account_totals a JOIN own_ip o ON a.id = o.id JOIN name_override r ON a.id = r.id AND r.screen = 'account'
LEFT JOIN (SELECT sender_id AS id, $LIST[receiver_id || '#' || CAST(seq AS STRING)] AS receivers FROM transfers WHERE sender_id = '{ACCOUNT}' GROUP BY sender_id) s ON a.id = s.id
LEFT JOIN (SELECT receiver_id AS id, $LIST[sender_id || '#' || CAST(seq AS STRING)] AS senders FROM transfers WHERE receiver_id = '{ACCOUNT}' GROUP BY receiver_id) g ON a.id = g.id
WHERE a.id = '{ACCOUNT}'""",
)
relation("sink_export_accounts", "SELECT c.id, c.level, r.score, f.flags, CASE WHEN h.id IS NOT NULL THEN 1 ELSE 0 END AS hawala, CASE WHEN s.id IS NOT NULL THEN 1 ELSE 0 END AS shell FROM classify_ml c JOIN rule_risk r ON c.id = r.id JOIN flags_ml f ON c.id = f.id LEFT JOIN hawala h ON c.id = h.id LEFT JOIN shell_company s ON c.id = s.id WHERE c.level <> 'CLEAR'")
relation("chain_of_custody", "SELECT replace(nodes, '|', ' → ') AS chain, n_hops FROM reverse_chain")
# documents are JSON; what depends on the clock is left to the caller
#: What is recommended at each level.
_ACTIONS = "CASE c.level WHEN 'CRITICAL' THEN 'Immediate freeze + STR filing + ED/CBI referral' WHEN 'HIGH' THEN 'Account freeze + investigation + police referral' WHEN 'MEDIUM' THEN 'Enhanced monitoring + bank outreach + customer interview' WHEN 'LOW' THEN 'Watch list + periodic review' ELSE 'No action, continue standard monitoring' END"
relation("judged_accounts", f"SELECT c.id, c.level, c.mule_type, r.score, f.flags, {_ACTIONS} AS action FROM classify_ml c JOIN rule_risk r ON c.id = r.id JOIN flags_ml f ON c.id = f.id")
relation(
    "str_report",
    """
SELECT id, $JSON['str_type', 'Mule Account Detection', 'subject_account', id, 'risk_score', score, 'risk_level', level, 'suspicious_indicators', flags, 'regulatory_body', 'FIU-IND',
  'status', 'AUTO-GENERATED, requires human review before submission'] AS document FROM judged_accounts""",
)
relation(
    "fir_summary",
    f"""
SELECT id, 'SUBJECT ACCOUNT: ' || id || chr(10) || 'CLASSIFICATION: ' || level || ', ' || mule_type || chr(10) || 'RISK SCORE: ' || CAST(score AS STRING) || '/100' || chr(10)
  || 'SUSPICIOUS BEHAVIOR DETECTED: ' || flags || chr(10) || 'FUND FLOW CHAINS IDENTIFIED: ' || CAST((SELECT count(*) FROM reverse_chain) AS STRING) || chr(10) || 'RECOMMENDED ACTION: ' || action AS summary
FROM judged_accounts WHERE id = '{ACCOUNT}'""",
)
relation("account_alerts", f"SELECT $LIST[body || ':' || priority] AS alerts FROM regulatory_alerts WHERE id = '{ACCOUNT}'")
relation("account_chains", "SELECT $LIST[chain] AS chains, count(*) AS n FROM chain_of_custody")
relation(
    "evidence_package",
    f"""
SELECT j.id, $JSON['account_summary', $OBJECT['account_id', j.id, 'risk_score', j.score, 'risk_level', j.level, 'mule_classification', j.mule_type, 'recommended_action', j.action],
  'analysis', $OBJECT['behavioral_flags', j.flags, 'incoming', t.n_in, 'outgoing', t.n_out],
  'graph_intelligence', $OBJECT['inbound_hub', coalesce(h.threat, 'NONE'), 'shared_addresses', (SELECT count(*) FROM identity_fusion WHERE account1 = '{ACCOUNT}' OR account2 = '{ACCOUNT}')],
  'chain_of_custody', $OBJECT['total_chains', k.n, 'fund_flow_chains', k.chains], 'regulatory_output', a.alerts, 'str_report', s.document, 'fir_summary', f.summary] AS document
FROM judged_accounts j JOIN account_totals t ON j.id = t.id JOIN str_report s ON j.id = s.id JOIN fir_summary f ON j.id = f.id LEFT JOIN community h ON j.id = h.hub
CROSS JOIN account_chains k CROSS JOIN account_alerts a WHERE j.id = '{ACCOUNT}'""",
)
relation("full_intelligence", " UNION ALL ".join(f"SELECT '{r}' AS report, count(*) AS n FROM {r}" for r in ("community", "coordination", "recruitment", "convergence", "identity_fusion", "hawala", "shell_company", "crypto_gateway", "reverse_chain")))
relation("scalar_samples", "SELECT id, upper(id) AS up, lower(id) AS low, substring(id, 4, 3) AS part, CAST(length(id) AS BIGINT) AS len, round(forwarding_ratio, 3) AS r3, CAST(floor(total_outgoing / 10000) AS BIGINT) AS tens, $INT[total_outgoing] AS whole, round(log2(total_incoming + 1), 6) AS bits, round(sqrt(abs(total_outgoing - total_incoming)), 4) AS root, least(forwarding_ratio, 10) < 1 AS below FROM feature_rows")
