"""Transaction-leg analytics: shapes, ownership hints, peel chains, sweeps, shared infrastructure, seeds and scores.

Inputs are ``legs`` (one row per input or output) and ``relay`` (who announced a transaction). Legs are bags: repeated inputs count.
"""

from __future__ import annotations

from sluice.plans.relations import relation

#: Fixed values of the detectors.
MIN_ROUND, MAX_ROUND_CV = 5, 0.05
SKEW, MIN_HOPS, LONG_GAP = 0.20, 3, 6 * 3600
MIN_SWEEP, MAX_IPS, MIN_REUSE = 5, 5, 2.0

# sources and set operations
relation("src_tx_csv", "SELECT seq, txid, wallet, CASE WHEN role = 'input' THEN 'input' ELSE 'output' END AS role, amount, t FROM legs")
relation("src_tx_raw", "SELECT seq, txid, wallet, role, amount, t, fee + 0 AS fee, script_type FROM legs")
relation("src_relay_csv", "SELECT txid, max_by(src_ip, seq) AS ip FROM relay GROUP BY txid")
relation("src_ground_truth", "SELECT entity_id, entity_type, is_illicit, count(*) AS n_wallets FROM truth GROUP BY entity_id, entity_type, is_illicit")
relation("src_coinjoin_truth", "SELECT txid FROM truth_coinjoin")
relation("src_geo_country", "SELECT start_int, end_int, country FROM geo_country WHERE start_int >= 0")
relation("src_geo_asn", "SELECT start_int, end_int, asn, asn_org FROM geo_asn WHERE start_int >= 0")
relation("all_wallets", "SELECT DISTINCT wallet FROM legs")
relation("unique_ips", "SELECT src_ip AS ip FROM relay WHERE src_ip IS NOT NULL UNION SELECT dst_ip FROM relay WHERE dst_ip IS NOT NULL")
relation("intersect_wallets", "SELECT wallet FROM legs WHERE role = 'input' INTERSECT SELECT wallet FROM legs WHERE role <> 'input'")
relation("except_wallets", "SELECT wallet FROM legs WHERE role <> 'input' EXCEPT SELECT wallet FROM legs WHERE role = 'input'")

# shapes
relation(
    "tx_shape",
    """
SELECT txid, min(seq) AS seq, min(t) AS t, count_if(role = 'input') AS n_in, count_if(role <> 'input') AS n_out,
  stddev_pop(CASE WHEN role <> 'input' THEN amount END) AS out_std, avg(CASE WHEN role <> 'input' THEN amount END) AS out_avg,
  min_by(wallet, CASE WHEN role = 'input' THEN seq END) AS first_input
FROM legs GROUP BY txid""",
)
relation("coinjoin_shape", f"SELECT txid FROM tx_shape WHERE n_in >= {MIN_ROUND} AND n_out >= {MIN_ROUND} AND out_avg <> 0 AND out_std / nullif(out_avg, 0) < {MAX_ROUND_CV}")
relation("plain_legs", "SELECT l.* FROM legs l LEFT JOIN coinjoin_shape c ON l.txid = c.txid WHERE c.txid IS NULL")
relation("first_seen", "SELECT wallet, min(t) AS first_t FROM plain_legs GROUP BY wallet")
relation("ever_spent", "SELECT DISTINCT wallet FROM plain_legs WHERE role = 'input'")
relation(
    "change_candidate",
    """
SELECT l.seq, l.txid, l.wallet, l.amount, l.t, f.first_t = l.t AS is_fresh, s.wallet IS NOT NULL AS is_spent, f.first_t = l.t AND s.wallet IS NOT NULL AS candidate
FROM plain_legs l JOIN first_seen f ON l.wallet = f.wallet LEFT JOIN ever_spent s ON l.wallet = s.wallet WHERE l.role <> 'input'""",
)
relation("tx_balance", "SELECT txid, round(sum(CASE WHEN role = 'input' THEN amount ELSE -amount END) - max(fee), 6) + 0 AS gap FROM legs GROUP BY txid")

# ownership
relation("common_inputs", "SELECT DISTINCT x.first_input AS a, l.wallet AS b, l.txid, 'common_input' AS reason FROM plain_legs l JOIN tx_shape x ON l.txid = x.txid WHERE l.role = 'input' AND l.wallet <> x.first_input")
relation(
    "change_links",
    """
SELECT x.first_input AS a, max(CASE WHEN c.candidate THEN c.wallet END) AS b, x.txid, 'change_address' AS reason
FROM change_candidate c JOIN tx_shape x ON c.txid = x.txid WHERE x.n_out = 2 AND x.n_in > 0
GROUP BY x.txid, x.first_input HAVING count_if(c.candidate) = 1""",
)
relation("owner_links", "SELECT a, b, txid, reason FROM common_inputs UNION ALL SELECT a, b, txid, reason FROM change_links")
relation("reasons_audit", "SELECT a, b, $LIST[reason || ':' || txid] AS reasons, count(*) AS n FROM owner_links GROUP BY a, b")
relation("owner_edges", "SELECT DISTINCT a, b FROM owner_links WHERE a <> b")
relation(
    "owner_reach",
    """
SELECT a AS node, a AS reached FROM owner_edges UNION SELECT b, b FROM owner_edges
UNION SELECT r.node, CASE WHEN e.a = r.reached THEN e.b ELSE e.a END FROM owner_reach r JOIN owner_edges e ON r.reached = e.a OR r.reached = e.b""",
)
relation("components", "SELECT node AS wallet, min(reached) AS component FROM owner_reach GROUP BY node")
relation("cluster_entities", "SELECT component, count(*) AS n_wallets, min(wallet) AS first_wallet, max(wallet) AS last_wallet FROM components GROUP BY component")

# peel chains
relation(
    "peel_candidates",
    f"""
SELECT x.txid, x.seq, x.t, x.first_input AS src, max(CASE WHEN c.candidate THEN c.wallet END) AS next_wallet,
  max(CASE WHEN NOT c.candidate THEN c.wallet END) AS peel_sink, max(CASE WHEN NOT c.candidate THEN c.amount END) AS peeled,
  max(CASE WHEN c.candidate THEN c.amount END) AS remainder
FROM tx_shape x JOIN change_candidate c ON x.txid = c.txid WHERE x.n_in = 1 AND x.n_out = 2
GROUP BY x.txid, x.seq, x.t, x.first_input HAVING count_if(c.candidate) = 1 AND count(DISTINCT c.wallet) = 2""",
)
relation("peel_ranked", f"SELECT *, least(peeled, remainder) / nullif(greatest(peeled, remainder), 0) AS ratio FROM peel_candidates WHERE greatest(peeled, remainder) <> 0")
relation(
    "find_peel_hops",
    f"""
SELECT src, txid, t, next_wallet, peel_sink, peeled, remainder, round(ratio, 4) AS skew FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY seq DESC) AS n FROM peel_ranked WHERE ratio < {SKEW}) WHERE n = 1""",
)
relation(
    "path_steps",
    """
SELECT h.src AS root, CAST(0 AS BIGINT) AS pos, h.src, h.txid, h.t, h.next_wallet, h.peel_sink, h.skew, '|' || h.src || '|' AS path
FROM find_peel_hops h LEFT JOIN (SELECT DISTINCT next_wallet FROM find_peel_hops) n ON h.src = n.next_wallet WHERE n.next_wallet IS NULL
UNION ALL
SELECT c.root, c.pos + 1, h.src, h.txid, h.t, h.next_wallet, h.peel_sink, h.skew, c.path || h.src || '|'
FROM path_steps c JOIN find_peel_hops h ON c.next_wallet = h.src WHERE position('|' || h.src || '|' IN c.path) = 0""",
)
relation("chain_steps", "SELECT root, pos, src, txid, t, next_wallet, peel_sink, skew FROM path_steps")
relation("walk_chains", "SELECT root, count(*) AS n_hops, $PATH[src ;; pos] AS sources, $PATH[peel_sink ;; pos] AS sinks, max_by(next_wallet, pos) AS last_wallet FROM chain_steps GROUP BY root")
relation("hop_timing", "SELECT root, pos, t - lag(t) OVER (PARTITION BY root ORDER BY pos) AS gap FROM chain_steps")
relation("chain_gaps", f"SELECT root, avg(CASE WHEN gap IS NULL THEN NULL WHEN gap > {LONG_GAP} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS slow_share FROM hop_timing GROUP BY root")
relation(
    "score_chain",
    f"""
SELECT s.root, s.n_hops, s.avg_skew, 0.45 * least(s.n_hops / CAST(8 AS DOUBLE), 1) + 0.30 * greatest(0, 1 - s.skew_std / {SKEW}) + 0.25 * coalesce(1 - g.slow_share, 0.5) AS confidence
FROM (SELECT root, CAST(count(*) AS DOUBLE) AS n_hops, avg(skew) AS avg_skew, stddev_pop(skew) AS skew_std FROM chain_steps GROUP BY root) s JOIN chain_gaps g ON s.root = g.root""",
)
relation("chain_scores", "SELECT root, CAST(n_hops AS BIGINT) AS n_hops, round(avg_skew, 6) AS avg_skew, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM score_chain")
relation(f"peeling_chains", f"SELECT c.root, w.n_hops, c.avg_skew, c.confidence, w.sources, w.last_wallet, w.sinks FROM chain_scores c JOIN walk_chains w ON c.root = w.root WHERE w.n_hops >= {MIN_HOPS}")
relation("topn_chains", "SELECT root, n_hops, confidence FROM peeling_chains ORDER BY confidence DESC, root LIMIT 25")
relation("filter_min_conf", "SELECT root, confidence FROM peeling_chains WHERE confidence >= 0.8")
relation("chain_wallets", "SELECT DISTINCT p.root, x.wallet, x.part, p.confidence FROM peeling_chains p JOIN (SELECT root, src AS wallet, 'chain' AS part FROM chain_steps UNION ALL SELECT root, next_wallet, 'chain' FROM chain_steps UNION ALL SELECT root, peel_sink, 'sink' FROM chain_steps) x ON p.root = x.root")
relation("filter_member", "SELECT root, wallet, part FROM chain_wallets WHERE wallet IN ('wp0_0', 'wp0_1', 'xp0_2')")
relation(
    "ip_diversity",
    """
SELECT p.root, p.n_hops, count(DISTINCT r.ip) AS n_ips, round(count(DISTINCT r.ip) / CAST(max(p.n_hops) AS DOUBLE), 4) AS ratio,
  CASE WHEN count(DISTINCT r.ip) <= 2 THEN 'sloppy_like' ELSE 'careful_like' END AS guess
FROM peeling_chains p JOIN chain_steps c ON p.root = c.root LEFT JOIN src_relay_csv r ON c.txid = r.txid GROUP BY p.root, p.n_hops""",
)

# shared infrastructure
relation("wallet_ip_send", "SELECT DISTINCT l.wallet, r.ip FROM legs l JOIN src_relay_csv r ON l.txid = r.txid WHERE l.role = 'input' AND r.ip IS NOT NULL")
relation("wallet_ip_recv", "SELECT DISTINCT l.wallet, r.ip FROM legs l JOIN src_relay_csv r ON l.txid = r.txid WHERE l.role <> 'input' AND r.ip IS NOT NULL")
relation("ip_sharing", "SELECT ip, count(*) AS n_wallets, $SHA[$SET[wallet]] AS wallets_sha FROM wallet_ip_send GROUP BY ip HAVING count(*) >= 2")
relation(
    "inbound_senders",
    """
SELECT o.wallet, x.first_input AS sender, max_by(r.ip, x.seq) AS ip FROM legs o JOIN tx_shape x ON o.txid = x.txid JOIN src_relay_csv r ON o.txid = r.txid
WHERE o.role <> 'input' AND x.n_in = 1 AND r.ip IS NOT NULL GROUP BY o.wallet, x.first_input""",
)
relation("sender_counts", "SELECT wallet, count(*) AS n_senders FROM inbound_senders GROUP BY wallet")
relation("ransom_ips", "SELECT wallet, max(n) AS most FROM (SELECT wallet, ip, count(*) AS n FROM inbound_senders GROUP BY wallet, ip) GROUP BY wallet")
relation("ransom_fingerprint", "SELECT s.wallet, s.n_senders, i.most, CAST(0.9 AS DOUBLE) AS weight FROM sender_counts s JOIN ransom_ips i ON s.wallet = i.wallet WHERE s.n_senders >= 3 AND i.most >= 3")

# sweeps
relation("incoming_index", "SELECT wallet, txid, t FROM legs WHERE role <> 'input'")
relation("sweep_shape", f"SELECT txid, t, n_in FROM tx_shape WHERE n_in >= {MIN_SWEEP} AND n_out = 1")
relation(
    "sweep_deposits",
    """
SELECT s.txid, i.wallet, d.txid AS deposit, r.ip FROM sweep_shape s JOIN legs i ON s.txid = i.txid AND i.role = 'input'
JOIN incoming_index d ON i.wallet = d.wallet AND d.t < s.t JOIN src_relay_csv r ON d.txid = r.txid WHERE r.ip IS NOT NULL""",
)
relation(
    "sweep_candidates",
    f"""
SELECT s.txid, s.n_in AS input_count, d.n_deposits, d.n_ips, d.n_deposits / CAST(d.n_ips AS DOUBLE) AS reuse, v.wallet AS vault, v.amount AS total
FROM sweep_shape s JOIN (SELECT txid, count(*) AS n_deposits, count(DISTINCT ip) AS n_ips FROM sweep_deposits GROUP BY txid) d ON s.txid = d.txid
JOIN legs v ON s.txid = v.txid AND v.role <> 'input' WHERE d.n_ips <= {MAX_IPS} AND d.n_deposits / CAST(d.n_ips AS DOUBLE) >= {MIN_REUSE}""",
)
relation(
    "score_sweep",
    "SELECT *, 0.5 * least(input_count / CAST(15 AS DOUBLE), 1) + 0.5 * (0.5 * (1 - n_ips / CAST(greatest(input_count, 1) AS DOUBLE)) + 0.5 * least(reuse / 5, 1)) AS score FROM sweep_candidates",
)
relation("darknet_sweeps", "SELECT txid, vault, input_count, n_deposits, n_ips, round(reuse, 4) AS reuse, total, round(CAST(score AS DOUBLE), 6) AS confidence FROM score_sweep")
relation("sweep_scores", "SELECT txid, round(CAST(score AS DOUBLE), 6) AS score FROM score_sweep")
relation("topn_sweeps", "SELECT txid, vault, confidence FROM darknet_sweeps ORDER BY confidence DESC, txid LIMIT 25")
relation("sweep_wallets", "SELECT DISTINCT d.txid, l.wallet, d.confidence FROM darknet_sweeps d JOIN legs l ON d.txid = l.txid")

# seeds, graph and scores
relation(
    "direct_seeds",
    """
SELECT wallet, max(weight) AS weight FROM (
  SELECT wallet, CASE WHEN part = 'chain' THEN confidence ELSE round(confidence * 0.75, 4) END AS weight FROM chain_wallets
  UNION ALL SELECT wallet, confidence FROM sweep_wallets UNION ALL SELECT wallet, CAST(weight AS DOUBLE) FROM ransom_fingerprint) GROUP BY wallet""",
)
relation("seeded_ips", "SELECT DISTINCT i.ip FROM inbound_senders i JOIN direct_seeds d ON i.wallet = d.wallet")
relation(
    "ip_crossref",
    """
SELECT DISTINCT i.wallet, CAST(0.6 AS DOUBLE) AS weight FROM inbound_senders i JOIN seeded_ips p ON i.ip = p.ip JOIN sender_counts c ON i.wallet = c.wallet
LEFT JOIN direct_seeds d ON i.wallet = d.wallet WHERE d.wallet IS NULL AND c.n_senders < 3""",
)
relation("seeds", "SELECT wallet, CAST(weight AS DOUBLE) AS weight FROM direct_seeds UNION ALL SELECT wallet, weight FROM ip_crossref")
relation(
    "value_flow_edges",
    """
SELECT i.wallet AS src, o.wallet AS dst, sum(o.amount / x.n_in) AS weight FROM legs i JOIN legs o ON i.txid = o.txid AND o.role <> 'input' JOIN tx_shape x ON i.txid = x.txid
WHERE i.role = 'input' AND i.wallet <> o.wallet GROUP BY i.wallet, o.wallet""",
)
relation("flow_weights", "SELECT src, dst, round(weight, 6) AS weight FROM value_flow_edges")
relation("transition", "SELECT e.src, e.dst, e.weight / s.total AS p FROM value_flow_edges e JOIN (SELECT src, sum(weight) AS total FROM value_flow_edges GROUP BY src) s ON e.src = s.src WHERE s.total > 0")
relation("dangling", "SELECT w.wallet FROM all_wallets w LEFT JOIN (SELECT DISTINCT src FROM transition) s ON w.wallet = s.src WHERE s.src IS NULL")
relation(
    "restarts",
    """
SELECT w.wallet, coalesce(s.weight, 0) / CASE WHEN z.total > 0 THEN z.total ELSE 1 END + CASE WHEN z.total > 0 THEN 0 ELSE CAST(1 AS DOUBLE) / z.n END AS seeded, CAST(1 AS DOUBLE) / z.n AS flat
FROM all_wallets w LEFT JOIN seeds s ON w.wallet = s.wallet CROSS JOIN (SELECT coalesce((SELECT sum(weight) FROM seeds), 0) AS total, (SELECT count(*) FROM all_wallets) AS n) z""",
)
PPR_CHECKED = 60
for _i in range(PPR_CHECKED):
    _prev = f"rank_{_i}" if _i else "(SELECT wallet, seeded, flat FROM restarts)"
    relation(
        f"rank_{_i + 1}",
        f"""
SELECT r.wallet, 0.85 * coalesce(g.seeded, 0) + (0.15 + 0.85 * z.seeded) * r.seeded AS seeded, 0.85 * coalesce(g.flat, 0) + (0.15 + 0.85 * z.flat) * r.flat AS flat
FROM restarts r LEFT JOIN (SELECT e.dst, sum(e.p * v.seeded) AS seeded, sum(e.p * v.flat) AS flat FROM transition e JOIN {_prev} v ON e.src = v.wallet GROUP BY e.dst) g ON r.wallet = g.dst
CROSS JOIN (SELECT coalesce(sum(v.seeded), 0) AS seeded, coalesce(sum(v.flat), 0) AS flat FROM {_prev} v JOIN dangling d ON v.wallet = d.wallet) z""",
    )
relation("ranks", f"SELECT wallet, CAST(seeded AS DOUBLE) AS seeded, CAST(flat AS DOUBLE) AS flat FROM rank_{PPR_CHECKED}")
relation("ppr", "SELECT wallet, round(seeded, 8) AS seeded, round(flat, 8) AS flat FROM ranks")
relation("risk_ratio", "SELECT wallet, round(seeded / greatest(flat, 1e-12), 7) AS ratio FROM ranks")
relation("ratio_ranks", "SELECT wallet, ratio, row_number() OVER (ORDER BY ratio, wallet) AS n, count(*) OVER () AS total FROM risk_ratio")
relation("percentile_rank", "SELECT wallet, ratio, CASE WHEN total > 1 THEN (n - 1) / CAST(greatest(total - 1, 1) AS DOUBLE) ELSE 1 END AS pct FROM ratio_ranks")
relation("score_parts", "SELECT p.wallet, 100 * coalesce(s.weight, 0) AS direct, 100 * p.pct AS spread, round(CAST(60 * coalesce(s.weight, 0) + 40 * p.pct AS DOUBLE), 2) AS final FROM percentile_rank p LEFT JOIN seeds s ON p.wallet = s.wallet")
relation(
    "final_scores",
    """
SELECT wallet, round(CAST(direct AS DOUBLE), 2) AS direct, round(CAST(spread AS DOUBLE), 2) AS spread, final,
  CASE WHEN final >= 75 THEN 'CRITICAL' WHEN final >= 50 THEN 'HIGH' WHEN final >= 25 THEN 'MEDIUM' ELSE 'CLEAR' END AS tier FROM score_parts""",
)
relation("classify_tier", "SELECT tier, min(final) AS lowest, max(final) AS highest FROM final_scores GROUP BY tier")
relation("tier_counts", "SELECT tier, count(*) AS n FROM final_scores GROUP BY tier")
relation("topn_risk", "SELECT wallet, final, tier FROM final_scores ORDER BY final DESC, wallet LIMIT 100")
#: The page of the risk table that is registered.
PAGE, PAGE_FROM = 50, 50
relation(
    "page_risk",
    f"""
SELECT wallet, final, tier, total, total > {PAGE_FROM + PAGE} AS has_more, CASE WHEN total > {PAGE_FROM + PAGE} THEN CAST({PAGE_FROM + PAGE} AS BIGINT) END AS next_offset
FROM (SELECT wallet, final, tier, (SELECT count(*) FROM final_scores) AS total FROM final_scores ORDER BY final DESC, wallet LIMIT {PAGE} OFFSET {PAGE_FROM})""",
)
relation("top10_critical", "SELECT wallet, final FROM final_scores WHERE tier = 'CRITICAL' ORDER BY final DESC, wallet LIMIT 10")
relation("filter_tier", "SELECT wallet, final FROM final_scores WHERE tier = upper('high')")
relation("filter_wallet_regex", "SELECT wallet, $LIKE['bc1q' || substring($SHA[wallet], 1, 20) ;; ^bc1[a-z0-9]{10,80}$] AS valid, $LIKE[wallet ;; ^bc1[a-z0-9]{10,80}$] AS raw_valid FROM all_wallets")
relation("membership_counts", "SELECT w.wallet, coalesce(c.n, 0) AS n_chains, coalesce(s.n, 0) AS n_sweeps FROM all_wallets w LEFT JOIN (SELECT wallet, count(DISTINCT root) AS n FROM chain_wallets GROUP BY wallet) c ON w.wallet = c.wallet LEFT JOIN (SELECT wallet, count(DISTINCT txid) AS n FROM sweep_wallets GROUP BY wallet) s ON w.wallet = s.wallet")
relation("export_membership", "SELECT f.wallet, f.final, f.tier, m.n_chains, m.n_sweeps FROM final_scores f JOIN membership_counts m ON f.wallet = m.wallet")
#: The wallet that single-wallet relations are about.
WALLET = "wp0_0"
# its score, its chains and its sweeps; a wallet that is unknown has no rows
relation(
    "wallet_detail",
    f"""
SELECT 'score' AS part, tier AS ref, final AS value, CAST(1 AS BIGINT) AS n FROM final_scores WHERE wallet = '{WALLET}'
UNION ALL SELECT 'chain', p.root, p.confidence, p.n_hops FROM peeling_chains p JOIN (SELECT DISTINCT root FROM chain_wallets WHERE wallet = '{WALLET}') c ON p.root = c.root
UNION ALL SELECT 'sweep', d.txid, d.confidence, d.input_count FROM darknet_sweeps d JOIN (SELECT DISTINCT txid FROM sweep_wallets WHERE wallet = '{WALLET}') s ON d.txid = s.txid
UNION ALL SELECT 'senders', wallet, CAST(n_senders AS DOUBLE), n_senders FROM sender_counts WHERE wallet = '{WALLET}'""",
)
relation("status_counts", "SELECT 'transactions' AS what, count(*) AS n FROM tx_shape UNION ALL SELECT 'wallets', count(*) FROM all_wallets UNION ALL SELECT 'chains', count(*) FROM peeling_chains UNION ALL SELECT 'sweeps', count(*) FROM darknet_sweeps")
relation(
    "flow_roles",
    """
SELECT wallet, max(severity) AS severity FROM (
  SELECT src AS wallet, 0 AS severity FROM chain_steps WHERE pos = 0 UNION ALL SELECT src, 1 FROM chain_steps UNION ALL SELECT next_wallet, 1 FROM chain_steps
  UNION ALL SELECT peel_sink, 2 FROM chain_steps UNION ALL SELECT wallet, 2 FROM sweep_wallets UNION ALL SELECT vault, 3 FROM darknet_sweeps) GROUP BY wallet""",
)
relation("layout_tier", "SELECT wallet, CASE severity WHEN 0 THEN 'source' WHEN 1 THEN 'hop' WHEN 2 THEN 'sink' ELSE 'vault' END AS role, severity AS lane FROM flow_roles")
relation(
    "flow_graph",
    """
SELECT c.src, c.next_wallet AS dst, 'CHAIN_CONTINUE' AS kind FROM chain_steps c JOIN peeling_chains p ON c.root = p.root
UNION SELECT c.src, c.peel_sink, 'PEELED_OFF' FROM chain_steps c JOIN peeling_chains p ON c.root = p.root
UNION SELECT w.wallet, d.vault, 'SWEEP_CONVERGE' FROM sweep_wallets w JOIN darknet_sweeps d ON w.txid = d.txid WHERE w.wallet <> d.vault""",
)
relation("flow_graph_asis", "SELECT src, dst, kind FROM flow_graph WHERE kind = 'SWEEP_CONVERGE'")
relation("project_short_label", "SELECT wallet, CASE WHEN length(wallet) > 12 THEN substring(wallet, 1, 6) || '...' || substring(wallet, length(wallet) - 3, 4) ELSE wallet END AS label FROM all_wallets")

# where addresses are
_NUMBER = "TRY_CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + TRY_CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + TRY_CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + TRY_CAST(split_part({0}, '.', 4) AS BIGINT)"
_OCTET = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
relation("ip_numbers", f"SELECT ip, CASE WHEN $LIKE[ip ;; ^{_OCTET}([.]{_OCTET}){{3}}$] THEN {_NUMBER.format('ip')} END AS n FROM unique_ips")
# a range is spread over the /16 blocks that it touches, at most 65,536 more rows than ranges that don't overlap: looking up is an equi-join, with the bounds as a residual
for _t in ("country", "asn"):
    relation(f"{_t}_blocks", f"SELECT g.*, $STEPS[CAST(floor(g.start_int / 65536) AS BIGINT) ;; CAST(floor(g.end_int / 65536) AS BIGINT)] AS block FROM geo_{_t} g WHERE g.start_int <= g.end_int")
relation("geo_range_country", "SELECT i.ip, g.country FROM ip_numbers i LEFT JOIN country_blocks g ON CAST(floor(i.n / 65536) AS BIGINT) = g.block AND i.n BETWEEN g.start_int AND g.end_int")
relation("geo_range_asn", "SELECT i.ip, g.asn, g.asn_org FROM ip_numbers i LEFT JOIN asn_blocks g ON CAST(floor(i.n / 65536) AS BIGINT) = g.block AND i.n BETWEEN g.start_int AND g.end_int")
relation("ip_places", "SELECT c.ip, c.country, a.asn, a.asn_org FROM geo_range_country c JOIN geo_range_asn a ON c.ip = a.ip")
relation("enrich_relay", "SELECT r.txid, r.src_ip, s.country AS src_country, s.asn AS src_asn, s.asn_org AS src_org, r.dst_ip, d.country AS dst_country, d.asn AS dst_asn, d.asn_org AS dst_org FROM relay r LEFT JOIN ip_places s ON r.src_ip = s.ip LEFT JOIN ip_places d ON r.dst_ip = d.ip")
relation("wallet_places", "SELECT w.wallet, w.side, p.country, p.asn FROM (SELECT wallet, ip, 'send' AS side FROM wallet_ip_send UNION ALL SELECT wallet, ip, 'recv' FROM wallet_ip_recv) w JOIN ip_places p ON w.ip = p.ip")
relation("wallet_geo", "SELECT wallet, $SET[CASE WHEN side = 'send' THEN country END] AS send_countries, $SET[CASE WHEN side = 'recv' THEN country END] AS recv_countries, $SET[asn] AS asns FROM wallet_places GROUP BY wallet")
relation("wallet_geo_lookup", "SELECT * FROM wallet_geo WHERE wallet = 'wp0_1'")

# features
relation("inter_tx_gap", "SELECT wallet, t, (t - lag(t) OVER (PARTITION BY wallet ORDER BY t, seq)) / CAST(3600 AS DOUBLE) AS gap FROM legs")
# a wallet of one transaction shares it with all others of it: only wallets of several need the distinct others
relation("tx_wallets", "SELECT DISTINCT txid, wallet FROM legs")
relation("wallet_txs", "SELECT wallet, count(*) AS n_txs, min(txid) AS txid FROM tx_wallets GROUP BY wallet")
relation("co_many", "SELECT a.wallet, count(DISTINCT b.wallet) AS n FROM wallet_txs w JOIN tx_wallets a ON w.wallet = a.wallet JOIN tx_wallets b ON a.txid = b.txid WHERE w.n_txs > 1 GROUP BY a.wallet")
relation("co_wallets", "SELECT w.wallet, coalesce(m.n, z.n) - 1 AS n FROM wallet_txs w JOIN (SELECT txid, count(*) AS n FROM tx_wallets GROUP BY txid) z ON w.txid = z.txid LEFT JOIN co_many m ON w.wallet = m.wallet WHERE coalesce(m.n, z.n) > 1")
relation("gap_means", "SELECT wallet, avg(gap) AS g, stddev_pop(gap) AS g_std FROM inter_tx_gap GROUP BY wallet")
relation(
    "wallet_features_api",
    """
SELECT l.wallet, round(sum(CASE WHEN role <> 'input' THEN amount ELSE 0 END), 6) AS total_in, round(sum(CASE WHEN role = 'input' THEN amount ELSE 0 END), 6) AS total_out,
  round(sum(CASE WHEN role <> 'input' THEN amount ELSE -amount END), 6) AS net_flow, count_if(role <> 'input') AS num_in_txns, count_if(role = 'input') AS num_out_txns,
  round(coalesce(avg(CASE WHEN role <> 'input' THEN amount END), 0), 6) AS avg_amount_in, round(coalesce(avg(CASE WHEN role = 'input' THEN amount END), 0), 6) AS avg_amount_out,
  round(coalesce(stddev_samp(amount), 0), 5) AS std_amount, round((max(t) - min(t)) / CAST(3600 AS DOUBLE), 6) AS time_span_hrs, round(coalesce(max(g.g), 0), 6) AS avg_inter_tx_hrs,
  CAST(0 AS BIGINT) AS unique_counterparties_asis, coalesce(max(c.n), 0) AS unique_counterparties,
  round(CASE WHEN sum(CASE WHEN role = 'input' THEN amount ELSE 0 END) > 0 THEN sum(fee) / nullif(sum(CASE WHEN role = 'input' THEN amount ELSE 0 END), 0) ELSE 0 END, 6) AS fee_ratio,
  count(DISTINCT script_type) AS script_type_diversity
FROM legs l LEFT JOIN gap_means g ON l.wallet = g.wallet LEFT JOIN co_wallets c ON l.wallet = c.wallet GROUP BY l.wallet""",
)
relation(
    "wallet_features_alt",
    """
SELECT l.wallet, count(DISTINCT CASE WHEN role = 'input' THEN txid END) AS in_degree, count(DISTINCT CASE WHEN role <> 'input' THEN txid END) AS out_degree,
  round(sum(CASE WHEN role = 'input' THEN amount ELSE 0 END), 6) AS total_in_value, round(sum(CASE WHEN role <> 'input' THEN amount ELSE 0 END), 6) AS total_out_value,
  round(least(sum(CASE WHEN role <> 'input' THEN amount ELSE 0 END) / (sum(CASE WHEN role = 'input' THEN amount ELSE 0 END) + 1e-9), 10), 6) AS value_ratio,
  round(avg(amount), 6) AS avg_amount, round(stddev_pop(amount), 5) AS amount_std, coalesce(max(c.n), 0) AS unique_counterparties,
  round((max(t) - min(t)) / CAST(3600 AS DOUBLE), 6) AS time_span_hours, round(avg(fee), 6) AS avg_fee, count(DISTINCT script_type) AS script_type_diversity
FROM legs l LEFT JOIN co_wallets c ON l.wallet = c.wallet GROUP BY l.wallet""",
)
# likewise for addresses: wallets of one address need its size only, those of several the size of the union, once for each distinct set
relation("wallet_ips", "SELECT DISTINCT l.wallet, r.ip FROM legs l JOIN src_relay_csv r ON l.txid = r.txid WHERE r.ip IS NOT NULL")
relation("ip_sets", "SELECT wallet, $SET[ip] AS ips, count(*) AS n_ips, min(ip) AS ip FROM wallet_ips GROUP BY wallet")
relation("ip_set_members", "SELECT DISTINCT s.ips, w.ip FROM ip_sets s JOIN wallet_ips w ON s.wallet = w.wallet WHERE s.n_ips > 1")
relation("ip_set_reach", "SELECT m.ips, count(DISTINCT w.wallet) AS n FROM ip_set_members m JOIN wallet_ips w ON m.ip = w.ip GROUP BY m.ips")
relation("ip_reuse", "SELECT s.wallet, coalesce(r.n, z.n) - 1 AS n FROM ip_sets s JOIN (SELECT ip, count(*) AS n FROM wallet_ips GROUP BY ip) z ON s.ip = z.ip LEFT JOIN ip_set_reach r ON s.ips = r.ips WHERE coalesce(r.n, z.n) > 1")
relation("hour_counts", "SELECT wallet, sum(CAST(n AS DOUBLE) * n) / (CAST(sum(n) AS DOUBLE) * sum(n)) AS herfindahl FROM (SELECT wallet, CAST(floor(t / 3600) AS BIGINT) % 24 AS hour, count(*) AS n FROM legs GROUP BY wallet, CAST(floor(t / 3600) AS BIGINT) % 24) GROUP BY wallet")
relation("wallet_sums", "SELECT wallet, sum(amount) AS total FROM legs GROUP BY wallet")
relation(
    "fingerprints",
    """
SELECT l.wallet, count(*) AS event_count, round(coalesce(max(g.g) * 3600, 0), 4) AS interval_mean, round(coalesce(max(g.g_std) * 3600, 0), 4) AS interval_std,
  round(-sum(CASE WHEN s.total > 0 THEN amount / nullif(s.total, 0) * log2(amount / nullif(s.total, 0) + 1e-12) ELSE 0 END), 6) + 0 AS amount_entropy,
  round(avg(CASE WHEN amount > 0 AND round(amount, 4) = round(amount, 2) THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS round_ratio,
  round(count_if(role <> 'input') / CAST(count(*) AS DOUBLE), 6) AS fanout_ratio, coalesce(max(i.n), 0) AS ip_reuse_degree, round(max(h.herfindahl), 6) AS hour_concentration
FROM legs l JOIN wallet_sums s ON l.wallet = s.wallet JOIN hour_counts h ON l.wallet = h.wallet LEFT JOIN gap_means g ON l.wallet = g.wallet LEFT JOIN ip_reuse i ON l.wallet = i.wallet GROUP BY l.wallet""",
)
relation("filter_min_events", "SELECT wallet, event_count, event_count >= 3 AS included FROM fingerprints")
relation("join_left_features", "SELECT f.wallet, f.event_count, coalesce(a.total_in, 0) AS total_in, coalesce(a.std_amount, 0) AS std_amount FROM fingerprints f LEFT JOIN (SELECT * FROM wallet_features_api WHERE num_in_txns > 1) a ON f.wallet = a.wallet")
FEATURES = ("total_in", "total_out", "net_flow", "num_in_txns", "num_out_txns", "avg_amount_in", "avg_amount_out", "std_amount", "time_span_hrs", "avg_inter_tx_hrs", "unique_counterparties", "fee_ratio", "script_type_diversity")
relation("feature_moments", "SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s, min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in FEATURES) + " FROM wallet_features_api")
relation("standardize", "SELECT wallet, " + ", ".join(f"round(({c} - {c}_m) / CASE WHEN {c}_s > 1e-9 THEN {c}_s ELSE 1 END, 5) AS {c}" for c in FEATURES) + " FROM wallet_features_api CROSS JOIN feature_moments")
relation("minmax", "SELECT wallet, " + ", ".join(f"round(({c} - {c}_lo) / CAST(CASE WHEN {c}_hi > {c}_lo THEN {c}_hi - {c}_lo ELSE 1 END AS DOUBLE), 6) AS {c}" for c in FEATURES) + " FROM wallet_features_api CROSS JOIN feature_moments")
relation("anomaly_ranks", "SELECT wallet, total_in, row_number() OVER (ORDER BY total_in DESC, wallet) AS n, count(*) OVER () AS total FROM wallet_features_api")
relation("anomaly_top_pct", "SELECT wallet, total_in FROM anomaly_ranks WHERE n <= greatest(1, floor(total * 0.05))")
relation("score_enrich", "SELECT f.wallet, f.final, coalesce(z.total_in, 0) AS anomaly_like, coalesce(g.send_countries, '') AS geo_countries, coalesce(g.asns, '') AS asns FROM final_scores f LEFT JOIN standardize z ON f.wallet = z.wallet LEFT JOIN wallet_geo g ON f.wallet = g.wallet")
relation("ml_blend", "SELECT f.wallet, round(0.7 * f.final + 0.3 * 100 * m.total_out, 6) AS blended FROM final_scores f JOIN minmax m ON f.wallet = m.wallet")
relation("sink_export_flagged", "SELECT e.wallet, e.final, e.tier, e.n_chains, e.n_sweeps, coalesce(g.send_countries, '') AS geo_countries, coalesce(g.asns, '') AS asns FROM export_membership e LEFT JOIN wallet_geo g ON e.wallet = g.wallet WHERE e.tier <> 'CLEAR'")
relation("top_abs_features", "SELECT wallet, feature, z FROM (SELECT wallet, feature, z, row_number() OVER (PARTITION BY wallet ORDER BY abs(z) DESC, feature) AS n FROM (" + " UNION ALL ".join(f"SELECT wallet, '{c}' AS feature, {c} AS z FROM standardize" for c in FEATURES) + ")) WHERE n <= 5")
relation("bar_norm", "SELECT feature, round(100 * m / max(m) OVER (), 4) AS pct FROM (SELECT feature, avg(abs(z)) AS m FROM top_abs_features GROUP BY feature)")
relation("top_shap", "SELECT feature, m FROM (SELECT feature, round(avg(abs(z)), 5) AS m FROM top_abs_features GROUP BY feature) ORDER BY m DESC, feature LIMIT 15")
