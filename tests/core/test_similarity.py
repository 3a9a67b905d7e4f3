import numpy as np
import pytest

from sluice.operators import similarity
from sluice.plans import registry, relations


@pytest.mark.parametrize("case", ["plain", "odd", "none"])
def test_pairs_are_judged_without_being_made(spark, monkeypatch, case):
    """What blocks of queries find equals the SQL over all pairs; the plans on Spark have no join of queries and vectors."""
    monkeypatch.setattr(similarity, "QUERIES", 10)
    x = np.random.default_rng(12).normal(0, 1, (1250, 6))
    x[100:160] = x[100]  # copies: ties are settled by the ids
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    if case == "odd":
        rows = [(0, [0.0] * 6), (1, None), (50, [1.0] * 4), (150, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (200, rows[200][1]), (200, rows[201][1]), (None, rows[7][1]), *rows[300:320], *rows[1000:1250]]
    if case == "none":
        rows = rows[1:3]
    tables = {"embeddings": spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)}
    for name in ("sim_threshold", "shadow_topk", "shadow_matches", "shadow_links"):
        found = registry.run(spark, name, **tables)
        assert sorted(map(str, found.collect())) == sorted(map(str, relations.query(spark, name, **tables).collect())), name
    plan = registry.run(spark, "shadow_topk", **tables)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_not_a_number_is_the_highest_level(spark):
    nan = float("nan")
    rows = [(i, [1.0, float(i)]) for i in range(60)] + [(60, [nan, 1.0])]
    tables = {"embeddings": spark.createDataFrame(rows, "vec_id long, embedding array<double>")}
    for name in ("sim_threshold", "shadow_topk"):
        assert sorted(map(str, registry.run(spark, name, **tables).collect())) == sorted(map(str, relations.query(spark, name, **tables).collect())), name
