import json
import random

from sluice.plans import registry

NAMES = ["criminal_1", "ACC_DEALER", "my_collector", "CRYPTO_CRIMINAL", "ACC_7", "hawala9", "SHELL_RECRUITER", "recr2", "bob", "ACCOUNT"]


def expected(screen, name, score, level):
    """The rules in plain Python, one screen after the other."""
    up = name.upper()
    usual = [("CRIMINAL",), ("DEALER", "COLLECTOR"), ("CRYPTO",), ("HAWALA", "SHELL"), ("RECRUITER", "RECR")]
    values = {
        "graph": [("CRITICAL", 92), ("CRITICAL", 88), ("HIGH", 78), ("MEDIUM", 58), ("MEDIUM", 55)],
        "temporal": [("CRITICAL", 92), ("CRITICAL", 90), ("HIGH", 75), ("MEDIUM", 58), ("MEDIUM", 55)],
    }.get(screen, [("CRITICAL", 92), ("HIGH", 75), ("CRITICAL", 88), ("MEDIUM", 58), ("MEDIUM", 55)])
    tests = list(zip(usual, values, strict=True))
    if screen == "temporal":
        if up.startswith("ACC_"):
            return "CLEAR", 15
        tests.reverse()
    for needles, value in tests:
        if any(n in up for n in needles):
            return value
    if up.startswith("ACC_") or screen == "dashboard" or screen == "graph" and level == "LOW":
        return "CLEAR", 15
    return level, score


def test_each_screen_has_its_overrides(spark):
    risks = [(n, 10 * i, ("LOW", "MEDIUM", "HIGH")[i % 3]) for i, n in enumerate(NAMES)]
    table = spark.createDataFrame(risks, "id string, score long, level string")
    got = {(r["screen"], r["id"]): (r["level"], r["score"]) for r in registry.run(spark, "name_override", rule_risk=table, temporal_level=table).collect()}
    assert got == {(s, n): expected(s, n, score, level) for s in ("account", "filter", "dashboard", "graph", "temporal") for n, score, level in risks}


def test_curves_against_all_pairs_and_all_thresholds(spark):
    rng = random.Random(3)
    rows = [(f"w{i}", rng.randrange(0, 21) / 20, int(rng.random() < 0.3)) for i in range(200)]
    got = registry.run(spark, "eval_binary", scored_truth=spark.createDataFrame(rows, "wallet string, p double, y int")).first()
    ones, zeros = [p for _, p, y in rows if y], [p for _, p, y in rows if not y]
    auroc = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    auprc, before = 0.0, 0
    for cut in sorted({p for _, p, _ in rows}, reverse=True):
        hits, chosen = sum(p >= cut for p in ones), sum(p >= cut for _, p, _ in rows)
        auprc, before = auprc + (hits - before) / len(ones) * hits / chosen, hits
    tp, fp = sum(p >= 0.5 for p in ones), sum(p >= 0.5 for p in zeros)
    assert (got["tp"], got["fp"], got["auroc"], got["auprc"]) == (tp, fp, round(auroc, 6), round(auprc, 6))
    assert got["f1"] == round(2 * tp / (2 * tp + fp + len(ones) - tp), 6) and got["precision"] == round(tp / (tp + fp), 6)
    empty = registry.run(spark, "eval_binary", scored_truth=spark.createDataFrame([], "wallet string, p double, y int")).first()
    assert (empty["tp"], empty["precision"], empty["auroc"]) == (0, 0, None)


def test_every_column_by_itself(spark):
    rng = random.Random(4)
    rows = [(f"w{i}", f, float(rng.randrange(0, 9)), i % 4 == 0) for i in range(80) for f in ("a", "b")]
    table = spark.createDataFrame([(w, f, v, int(y)) for w, f, v, y in rows], "wallet string, feature string, value double, illicit int")
    got = {r["feature"]: r["auc"] for r in registry.run(spark, "univariate_auc", known_values=table).collect()}
    for f in ("a", "b"):
        ones, zeros = [v for _, g, v, y in rows if g == f and y], [v for _, g, v, y in rows if g == f and not y]
        a = sum((x > z) + (x == z) / 2 for x in ones for z in zeros) / (len(ones) * len(zeros))
        assert got[f] == round(max(a, 1 - a), 7)


def test_documents(spark, sf):
    document = json.loads(registry.run(spark, "evidence_package", sf).first()["document"])
    assert document["account_summary"]["account_id"] == "ACC11" and document["chain_of_custody"]["total_chains"] == 10
    assert json.loads(document["str_report"])["subject_account"] == "ACC11" and document["fir_summary"].startswith("SUBJECT ACCOUNT: ACC11\n")
