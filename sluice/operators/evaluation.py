"""Detections held against known entities."""

from __future__ import annotations

from sluice.operators.utxo import FEATURES
from sluice.plans.relations import relation

PRECISION = "round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6)"
RECALL = "round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6)"
F1 = "round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6)"

relation("truth_sizes", "SELECT entity_id, entity_type, is_illicit, count(*) AS n FROM truth GROUP BY entity_id, entity_type, is_illicit")
relation("cluster_overlap", "SELECT c.component, t.entity_id, count(*) AS n FROM components c JOIN truth t ON c.wallet = t.wallet GROUP BY c.component, t.entity_id")
relation("cluster_purity", "SELECT component, max(n) AS best, sum(n) AS known, count(*) AS entities FROM cluster_overlap GROUP BY component")
relation("eval_clusters", "SELECT round(sum(best) / CAST(sum(known) AS DOUBLE), 7) AS weighted_purity, CAST(sum(known) AS BIGINT) AS covered, (SELECT count(*) FROM truth) AS known_wallets FROM cluster_purity")
relation("recall_by_type", "SELECT t.entity_type, round(avg(coalesce(b.best, 0) / CAST(t.n AS DOUBLE)), 6) AS recall FROM truth_sizes t LEFT JOIN (SELECT entity_id, max(n) AS best FROM cluster_overlap GROUP BY entity_id) b ON t.entity_id = b.entity_id GROUP BY t.entity_type")
relation("coinjoin_counts", "SELECT count_if(d.txid IS NOT NULL AND t.txid IS NOT NULL) AS tp, count_if(t.txid IS NULL) AS fp, count_if(d.txid IS NULL) AS fn FROM coinjoin_shape d FULL OUTER JOIN truth_coinjoin t ON d.txid = t.txid")
relation("eval_coinjoin", f"SELECT tp, fp, fn, {PRECISION} AS precision, {RECALL} AS recall FROM coinjoin_counts")
relation("detected_sets", "SELECT 'chain' AS kind, root AS det, wallet FROM chain_wallets WHERE part = 'chain' UNION ALL SELECT 'sweep', txid, wallet FROM sweep_wallets")
relation("detected_sizes", "SELECT kind, det, count(*) AS n FROM detected_sets GROUP BY kind, det")
relation("truth_overlap", "SELECT d.kind, d.det, t.entity_id, t.entity_type, count(*) AS n FROM detected_sets d JOIN truth t ON d.wallet = t.wallet GROUP BY d.kind, d.det, t.entity_id, t.entity_type")
relation("jaccard", "SELECT o.kind, o.det, o.entity_id, o.entity_type, o.n / CAST(d.n + t.n - o.n AS DOUBLE) AS j FROM truth_overlap o JOIN detected_sizes d ON o.kind = d.kind AND o.det = d.det JOIN truth_sizes t ON o.entity_id = t.entity_id")
relation("jaccards", "SELECT kind, det, entity_id, round(j, 6) AS j FROM jaccard")
relation("best_match", "SELECT kind, det, entity_id, entity_type, round(j, 6) AS j FROM (SELECT *, row_number() OVER (PARTITION BY kind, det ORDER BY j DESC, entity_id) AS r FROM jaccard) WHERE r = 1")
for _kind, _key, _least, _types in (("chain", "eval_chains", 0.8, "'peeling_chain_sloppy', 'peeling_chain_careful'"), ("sweep", "eval_sweeps", 0.5, "'darknet_vendor'")):
    relation(
        _key,
        f"""
SELECT (SELECT count(*) FROM detected_sizes WHERE kind = '{_kind}') AS detected, (SELECT count(*) FROM best_match WHERE kind = '{_kind}' AND j >= {_least} AND entity_type IN ({_types})) AS matched,
  (SELECT count(DISTINCT entity_id) FROM best_match WHERE kind = '{_kind}' AND j >= {_least} AND entity_type IN ({_types})) AS found, (SELECT count(*) FROM truth_sizes WHERE entity_type IN ({_types})) AS entities""",
    )
relation("eval_ip_diversity", "SELECT count(*) AS judged, count_if((b.entity_type = 'peeling_chain_sloppy') = (d.guess = 'sloppy_like')) AS correct FROM ip_diversity d JOIN best_match b ON b.kind = 'chain' AND b.det = d.root AND b.j >= 0.8")
relation("eval_ransom", "SELECT count(*) AS collectors, count(r.wallet) AS recovered FROM truth t LEFT JOIN ransom_fingerprint r ON t.wallet = r.wallet WHERE t.entity_type = 'ransomware_collector'")
relation("illicit_wallets", "SELECT wallet, max(CASE WHEN is_illicit THEN 1 ELSE 0 END) AS illicit FROM truth GROUP BY wallet")
relation("eval_tiers", "SELECT f.tier, count(*) AS known, CAST(sum(i.illicit) AS BIGINT) AS illicit, round(avg(CAST(i.illicit AS DOUBLE)), 6) AS share FROM final_scores f JOIN illicit_wallets i ON f.wallet = i.wallet GROUP BY f.tier")
relation("eval_anomaly", "SELECT i.illicit, round(avg(s.total_in), 5) AS mean_score, count(*) AS n, count(a.wallet) AS in_top FROM illicit_wallets i JOIN standardize s ON i.wallet = s.wallet LEFT JOIN anomaly_top_pct a ON i.wallet = a.wallet GROUP BY i.illicit")
relation("scored_truth", "SELECT f.wallet, f.final / 100 AS p, i.illicit AS y FROM final_scores f JOIN illicit_wallets i ON f.wallet = i.wallet")
relation("binary_counts", "SELECT count_if(p >= 0.5 AND y = 1) AS tp, count_if(p >= 0.5 AND y = 0) AS fp, count_if(p < 0.5 AND y = 1) AS fn, count_if(p < 0.5 AND y = 0) AS tn FROM scored_truth")
# scores have two decimals of a hundred: there are at most 10,001 levels, so the windows over them are small
relation("score_levels", "SELECT p, count(*) AS n, count_if(y = 1) AS pos FROM scored_truth GROUP BY p")
relation("level_sums", "SELECT p, n, pos, CAST(sum(n) OVER (ORDER BY p DESC) AS DOUBLE) AS at_least, CAST(sum(pos) OVER (ORDER BY p DESC) AS DOUBLE) AS hits FROM score_levels")
relation(
    "score_curves",
    """
SELECT sum((n - pos) * (hits - pos / CAST(2 AS DOUBLE))) / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(n - pos) AS DOUBLE), 0) AS auroc, sum(pos * hits / at_least) / nullif(CAST(sum(pos) AS DOUBLE), 0) AS auprc
FROM level_sums""",
)
relation("eval_binary", f"SELECT tp, fp, fn, tn, {PRECISION} AS precision, {RECALL} AS recall, {F1} AS f1, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM binary_counts CROSS JOIN score_curves")
relation("brier", "SELECT round(avg((p - y) * (p - y)), 7) AS brier FROM scored_truth")
relation("ece_bins", "SELECT CASE WHEN p <= 0 THEN 1 ELSE CAST(ceil(p * 10) AS BIGINT) END AS bin, count(*) AS n, avg(p) AS conf, avg(CAST(y AS DOUBLE)) AS acc FROM scored_truth GROUP BY CASE WHEN p <= 0 THEN 1 ELSE CAST(ceil(p * 10) AS BIGINT) END")
relation("ece", "SELECT round(sum(n * abs(conf - acc)) / sum(n), 7) AS ece FROM ece_bins")
relation("freeze_tier", "SELECT count(*) AS n, coalesce(CAST(sum(y) AS BIGINT), 0) AS hits FROM scored_truth WHERE p >= 0.9")
# every column by itself: rows are numbered by column and value at once, and a column's numbers count from its first
relation("known_values", " UNION ALL ".join(f"SELECT z.wallet, '{c}' AS feature, z.{c} + 0 AS value, i.illicit FROM standardize z JOIN illicit_wallets i ON z.wallet = i.wallet" for c in FEATURES))
relation("value_ranks", "SELECT wallet, feature, value, illicit, row_number() OVER (ORDER BY feature, value, wallet) AS n FROM known_values")
relation("tie_ranks", "SELECT feature, value, avg(CAST(n AS DOUBLE)) AS r, min(n) AS first_n, count(*) AS n, count_if(illicit = 1) AS pos FROM value_ranks GROUP BY feature, value")
relation("feature_sums", "SELECT feature, sum(pos * r) AS rank_total, CAST(min(first_n) - 1 AS DOUBLE) AS before, CAST(sum(pos) AS DOUBLE) AS n1, CAST(sum(n - pos) AS DOUBLE) AS n0 FROM tie_ranks GROUP BY feature")
relation("univariate_auc", "SELECT feature, round(greatest(a, 1 - a), 7) AS auc FROM (SELECT feature, (rank_total - before * n1 - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0) AS a FROM feature_sums)")
relation("missed", "SELECT t.wallet, t.entity_type FROM truth t JOIN final_scores f ON t.wallet = f.wallet WHERE t.is_illicit AND f.tier NOT IN ('CRITICAL', 'HIGH')")
relation("gap_diag_peel", "SELECT CASE WHEN h.src IS NOT NULL THEN 'hop, chain too short' WHEN s.wallet IS NULL THEN 'never spent' WHEN p.first_input IS NULL THEN 'no single-input spend' ELSE 'spend forms no hop' END AS bucket, count(DISTINCT m.wallet) AS n FROM missed m LEFT JOIN find_peel_hops h ON m.wallet = h.src LEFT JOIN ever_spent s ON m.wallet = s.wallet LEFT JOIN (SELECT DISTINCT first_input FROM tx_shape WHERE n_in = 1) p ON m.wallet = p.first_input WHERE m.entity_type LIKE 'peeling%' GROUP BY 1")
relation("gap_diag_ransom", "SELECT CASE WHEN c.wallet IS NULL THEN 'no relayed sender' WHEN c.n_senders < 3 THEN 'fewer than 3 senders' WHEN i.most < 3 THEN 'no shared address' ELSE 'seeded, score below HIGH' END AS bucket, count(DISTINCT m.wallet) AS n FROM missed m LEFT JOIN sender_counts c ON m.wallet = c.wallet LEFT JOIN ransom_ips i ON m.wallet = i.wallet WHERE m.entity_type = 'ransomware_collector' GROUP BY 1")
