"""Cosine threshold self-join against all pairs."""
import numpy as np
import pytest

from parley.operators import cosine_join as J


def groups(seed, n=900, dims=16, tight=0.05):
    """Tight groups, one of them a third of all rows, some exact copies, some loose rows."""
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(12, dims))
    which = np.where(rnd.random(n) < 0.33, 0, rnd.integers(0, 12, n))
    m = centers[which] + tight * rnd.normal(size=(n, dims))
    m[::5] = rnd.normal(size=(len(m[::5]), dims))
    m[3::9] = m[3]
    m[4::50] *= 2.5  # the same direction
    return m


def frame(spark, m, extra=()):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + list(extra)
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(4)


def similar(m, t):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9) >= t
    np.fill_diagonal(s, False)
    return s


@pytest.mark.parametrize("t,pivots,cell,block", [(0.95, 1024, 512, 1024), (0.95, 40, 8, 50), (0.6, 30, 10, 64), (0.0, 8, 8, 100), (1.0, 25, 8, 30)])
def test_links_equal_all_pairs(spark, t, pivots, cell, block):
    m = groups(1)
    want = similar(m, t)
    same = np.array([min(np.flatnonzero((m == v).all(1))) for v in m])
    want |= same[:, None] == same[None]
    np.fill_diagonal(want, False)
    odd = [(10_000, None), (10_001, [0.0] * 16), (10_002, [float("nan")] * 16), (10_003, [None] * 16), (10_004, [])]
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in J.cosine_links(frame(spark, m, odd), "id", "vec", t, pivots, cell, block).collect()}
    assert got == {**{i: (int(same[i]), int(want[i].sum())) for i in range(len(m))}, **{i: (i, 0) for i, _ in odd}}


def test_pairs_of_classes(spark):
    m = groups(2, 400)
    same = np.array([min(np.flatnonzero((m == v).all(1))) for v in m])
    a, b = np.nonzero(np.triu(similar(m, 0.9)))
    want = {(int(min(x, y)), int(max(x, y))) for x, y in zip(same[a], same[b]) if x != y}
    got = [tuple(r) for r in J.cosine_pairs(frame(spark, m), "id", "vec", 0.9, 20, 10, 40).collect()]
    assert set(got) == want and len(got) == len(want)
    assert J.cosine_pairs(frame(spark, m[:0]), "id", "vec").count() == 0
    with pytest.raises(ValueError):
        J.cosine_links(frame(spark, m), "id", "vec", -0.1)


def test_grouped_vectors_visit_few_cells(spark):
    rnd = np.random.default_rng(3)
    centers = rnd.normal(size=(30, 64))
    m = centers[rnd.integers(0, 30, 3000)] + 0.02 * rnd.normal(size=(3000, 64))
    classes = J.vector_classes(frame(spark, m), "id", "vec")
    rows = J.dealt(classes, 0.95, pivots=30, cell_rows=10)
    assert rows.filter("home").count() == 3000
    assert rows.count() <= 2 * 3000
    plan = J.cosine_links(frame(spark, m), "id", "vec")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_loose_vectors_are_not_dealt_to_many_cells(spark):
    rnd = np.random.default_rng(4)
    classes = J.vector_classes(frame(spark, rnd.normal(size=(3000, 16))), "id", "vec")
    rows = J.dealt(classes, 0.3, pivots=300, cell_rows=10)
    assert rows.filter("home").count() == 3000
    assert rows.count() <= 4 * 3000
