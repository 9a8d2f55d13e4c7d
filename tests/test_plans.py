"""Plan-shape checks: the scale properties the operators rely on show up in the plans."""
from pyspark.sql import functions as F

from parley.plans.registry import QUERIES
from conftest import SF001
from parley.operators import sampling as W


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_per_stratum_is_a_partial_top_n_before_the_shuffle(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    p = plan(W.per_stratum(d.select("doc_id", "lang"), "lang", "doc_id", 3))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_scan_reads_only_needed_columns_and_pushes_filters(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    p = plan(d.filter(F.col("lang") == "de").select("doc_id").orderBy("doc_id").limit(5))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in p
    assert "TakeOrderedAndProject" in p


def test_global_totals_are_scalar_subqueries_not_windows(spark):
    from parley.operators.aggregates import value_counts
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    p = plan(value_counts(d, "lang"))
    assert "Subquery" in p and "Window" not in p


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_meets_in_cells(spark):
    for name in ("v3_dense_topk", "v4_keyed_dense_topk", "g2_gates"):
        plan = _plan(QUERIES[name](spark, SF001))
        assert "FlatMapCoGroupsInArrow" in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "WindowGroupLimit" in plan, name


def test_evaluation_scans_its_rows_once(spark):
    """Scans of documents in the plan before reuse: one, or two where labels join them."""
    for name, most in (("e1_per_class_accuracy", 1), ("e2_e3_blended", 2), ("e5_e6_prevalence", 1), ("e13_rollup", 4)):
        assert _plan(QUERIES[name](spark, SF001)).count("documents.parquet") <= most, name
    assert _plan(QUERIES["e7_weighted_kappa"](spark, SF001)).count("labels.parquet") == 1


def test_components_query_holds_no_pair_of_all(spark):
    plan = _plan(QUERIES["v6_components"](spark, SF001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_grid_copies_rows_by_the_size_of_their_own_key(spark):
    """500 keys, one with a third of the rows: rows after replication are at most twice the input."""
    from parley.operators import grid
    rows = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("key"))
    seen = []
    repartition = type(rows).repartition
    try:
        type(rows).repartition = lambda self, *a: (seen.append(self.count()), repartition(self, *a))[1]
        grid.cells(rows, rows, "id", "id", ["key"], 4096, 4096)
    finally:
        type(rows).repartition = repartition
    assert len(seen) == 2 and all(9000 <= n <= 18000 for n in seen), seen


def test_keyed_top_k_with_many_null_and_one_sided_keys(spark):
    from parley.operators.vectors import topk_dense
    import numpy as np
    rnd = np.random.default_rng(1)
    m = rnd.normal(size=(400, 8))
    key = [None if i % 7 == 0 else f"k{i % 40}" for i in range(400)]
    df = spark.createDataFrame([(i, [float(x) for x in v], k) for i, (v, k) in enumerate(zip(m, key))], "id long, vec array<double>, key string")
    pool = df.filter("key is null or key <> 'k3'")
    got = sorted((r["q_id"], r["rank"], r["n_id"]) for r in topk_dense(df, pool, 2, key_col="key", q_rows=5, p_rows=3).collect())
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = []
    for i in range(400):
        near = sorted((-round(float(u[i] @ u[j]), 9), j) for j in range(400) if j != i and key[j] == key[i] and key[j] != "k3")[:2]
        want += [(i, r, j) for r, (_, j) in enumerate(near)]
    assert got == sorted(want)


def test_agreement_gathers_a_bounded_list(spark):
    from parley.operators.evaluate import rater_agreement
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    p = _plan(rater_agreement(d.select(F.col("n_chars").alias("a"), F.col("n_chars").alias("b")), "a", "b"))
    assert "GlobalLimit" in p or "LocalLimit" in p
