"""Invariants of samplers, evaluation and routing, plus partition-count invariance."""
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from parley.functions import patterns as P
from parley.operators import evaluate as E
from parley.operators import retrieval as RT
from parley.operators import routing as RO
from parley.operators import sampling as W


def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


def test_caps_never_exceeded(spark):
    d = docs(spark)
    capped = W.cap_per_cluster(d, "lang", "doc_id", 3)
    assert capped.groupBy("lang").count().agg(F.max("count")).first()[0] <= 3
    dc = W.dual_cap(d, "doc_id", "source", F.col("lang") == "fr", 40, 0.15)
    cap = int(40 * 0.15)
    assert dc.count() <= 40
    assert dc.groupBy("source").count().agg(F.max("count")).first()[0] <= cap
    assert dc.filter(F.col("lang") == "fr").count() <= cap


def test_quota_draw_respects_flag_ceiling(spark):
    d = docs(spark)
    out = W.quota_draw(d, "doc_id", F.col("n_chars") > 3000, 20, 3)
    assert out.count() <= 20
    assert out.filter(F.col("n_chars") > 3000).count() <= 3


def test_hard_and_random_sets_are_disjoint(spark):
    d = docs(spark)
    s = W.hard_case_set(d, "doc_id", F.col("n_chars") > 5000, "lang", 5, 10)
    assert s.groupBy("doc_id").count().filter("count > 1").count() == 0


def test_anti_join_leaves_no_leak(spark):
    d = docs(spark)
    lab = spark.read.parquet(f"{SF001}/labels.parquet")
    pool = d.join(lab, "doc_id", "left_anti")
    assert pool.join(lab, "doc_id", "inner").count() == 0


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partition_count_invariance(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        d = docs(spark).repartition(parts)
        got = sorted(r.doc_id for r in W.per_stratum(d, "lang", "doc_id", 3).collect())
        got2 = sorted(r.doc_id for r in W.sample_n(d, "doc_id", 10).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    base = docs(spark)
    assert got == sorted(r.doc_id for r in W.per_stratum(base, "lang", "doc_id", 3).collect())
    assert got2 == sorted(r.doc_id for r in W.sample_n(base, "doc_id", 10).collect())


def test_reweighting_self_check(spark):
    rows = [(f"c{i}", "software_feature_defect", "software_feature_defect") for i in range(100)]
    rows += [(f"r{i}", "ios_version_downgrade", P.RESIDUAL) for i in range(20)]
    preds = spark.createDataFrame(rows, "id string, truth string, pred string")
    dom = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(P.PREVALENCE.items())],
                                "cls string, ord int, prod_share double")
    tbl = {r.cls: r for r in E.per_class(preds, dom).collect()}
    assert tbl["software_feature_defect"].accuracy == 1.0
    assert tbl["ios_version_downgrade"].accuracy == 0.0
    assert tbl["battery_drain"].n == 0 and tbl["battery_drain"].accuracy is None
    b = E.blended_and_reweighted(preds, dom).first()
    assert abs(b.naive - 100 / 120) < 1e-6
    assert b.reweighted > b.naive and b.reweighted > 0.98


def test_reweighted_equals_naive_when_weights_are_sample_shares(spark):
    rows = [("a", "x", "x"), ("b", "x", "y"), ("c", "y", "y"), ("d", "y", "y")]
    preds = spark.createDataFrame(rows, "id string, truth string, pred string")
    dom = spark.createDataFrame([("x", 0, 0.5), ("y", 1, 0.5)], "cls string, ord int, prod_share double")
    b = E.blended_and_reweighted(preds, dom).first()
    assert abs(b.naive - b.reweighted) < 1e-9


def test_kappa_identical_raters_is_one_and_index_weights(spark):
    df = spark.createDataFrame([(1, 1), (3, 3), (5, 5), (3, 3)], "a int, b int")
    r = E.rater_agreement(df, "a", "b").first()
    assert r.kappa_w == 1.0 and r.exact == 1.0
    df2 = spark.createDataFrame([(1, 3), (3, 5), (5, 1), (3, 3)], "a int, b int")
    r2 = E.rater_agreement(df2, "a", "b").first()
    # brute-force reference on index weights over the union {1,3,5}
    idx = {1: 0, 3: 1, 5: 2}
    pairs = [(1, 3), (3, 5), (5, 1), (3, 3)]
    n = len(pairs)
    obs = sum(abs(idx[a] - idx[b]) / 2 for a, b in pairs) / n
    pa = {v: sum(1 for a, _ in pairs if a == v) / n for v in idx}
    pb = {v: sum(1 for _, b in pairs if b == v) / n for v in idx}
    exp = sum(abs(idx[i] - idx[j]) / 2 * pa[i] * pb[j] for i in idx for j in idx)
    assert abs(r2.kappa_w - round(1 - obs / exp, 6)) < 1e-6


def test_gates_and_grounding_choice(spark):
    pol = RT.policy_table(spark)
    c = spark.createDataFrame([
        ("q1", "software_feature_defect", 0, 0.9, "n1", "battery_drain", "self_contained_answer", False),
        ("q1", "software_feature_defect", 1, 0.5, "n2", "software_feature_defect", "self_contained_answer", False),
        ("q1", "software_feature_defect", 2, 0.5, "n3", "software_feature_defect", "answer_with_dm_followup", False),
        ("q1", "software_feature_defect", 3, 0.1, "n4", "software_feature_defect", "self_contained_answer", False),
        ("q2", "billing_account", 0, 0.8, "n5", "billing_account", "dm_handoff", True),
        ("q3", "non_english", 0, 0.8, "n6", "non_english", "other_channel_redirect", True),
    ], "q_id string, q_class string, rank int, cos double, n_id string, n_class string, n_type string, n_template boolean")
    g = RT.apply_gates(c, pol, 0.2)
    assert g.filter(F.col("gated_score") > F.col("cos")).count() == 0
    u = {(r.q_id, r.n_id): r.usable for r in g.collect()}
    assert u[("q1", "n1")] is False      # G3 topic
    assert u[("q1", "n4")] is False      # G1 similarity
    assert u[("q2", "n5")] is False      # G4 template
    assert u[("q3", "n6")] is True       # G4 exempt class
    pick = {r.q_id: r for r in RT.pick_grounding(g).collect()}
    assert pick["q1"].grounded_on == "n2" and pick["q1"].grounding_rank == 1   # tie -> lower rank
    assert pick["q1"].n_usable == 2
    assert pick["q2"].grounded_on is None and pick["q2"].n_usable == 0


def test_every_escalation_has_a_reason_and_no_draft(spark):
    q = spark.createDataFrame([
        ("a", "software_feature_defect", "my screen went black"),
        ("b", "non_english", "hola"),
        ("c", "battery_drain", "battery dies fast"),
        ("d", "ios_version_downgrade", "go back please"),
        ("e", "software_feature_defect", "camera crashes"),
        ("f", "billing_account", "charged twice"),
    ], "id string, intent string, text string")
    d = RO.decide(RO.draft_checks(RO.route(q, None, "id", "intent", "text"), "intent"), "intent")
    rows = {r.id: r for r in d.collect()}
    assert rows["a"].route == "escalate_override" and rows["a"].reason.startswith("safety_override:physical")
    assert rows["b"].route == "no_draft_policy"
    assert rows["c"].route == "policy_fact" and rows["c"].reason == "canned_template:battery_drain"
    assert rows["c"].final_draft == P.TEMPLATES["battery_drain"] and rows["c"].unsupported == []
    assert rows["d"].reason == "stated_policy_fact:ios_version_downgrade"
    assert rows["e"].route == "no_usable_grounding"
    assert rows["f"].route == "escalate_override" and "account_or_payment_action" in rows["f"].reason
    for r in rows.values():
        if r.action == "escalate":
            assert r.reason and r.final_draft is None


def test_unknown_route_fails_the_job(spark):
    df = spark.createDataFrame([("x", "billing_account", "weird")], "id string, intent string, route string") \
        .withColumn("draft", F.lit(None).cast("string")).withColumn("override", F.lit(None).cast("string")) \
        .withColumn("grounded_on", F.lit(None).cast("string")).withColumn("grounding_rank", F.lit(None).cast("int")) \
        .withColumn("gated_score", F.lit(None).cast("double"))
    with pytest.raises(Exception):
        RO.decide(df, "intent").collect()


def test_prevalence_correction_external_precision_and_override(spark):
    # 10 rows predicted: a x4, b x2, c x2 (external precision), d x2 (no information)
    known = {0: "a", 1: "b", 4: "b", 5: "b"}
    preds = spark.createDataFrame(
        [(i, p, known.get(i, "a"), i in known) for i, p in enumerate(["a"] * 4 + ["b"] * 2 + ["c"] * 2 + ["d"] * 2)],
        "id int, pred string, truth string, checked boolean")
    rows = E.corrected_prevalence(preds, "checked", external_precision={"c": 0.5}, residual="b", direct={"z": 0.1}).collect()
    prev = {r.cls: r.prevalence for r in rows}
    assert all(abs(r.dropped_share - 0.2) < 1e-9 for r in rows)
    # raw mass: a = .4*.5 = .2; b = .4*.5 + .2*1 + .2*.5 = .5; c = .2*.5 = .1; z = .1 (direct);
    # d has neither confusion nor external precision and is dropped; total .9
    assert set(prev) == {"a", "b", "c", "z"}
    assert abs(prev["a"] - 0.2 / 0.9) < 1e-9 and abs(prev["b"] - 0.5 / 0.9) < 1e-9
    assert abs(prev["c"] - 0.1 / 0.9) < 1e-9 and abs(prev["z"] - 0.1 / 0.9) < 1e-9
    assert abs(sum(prev.values()) - 1) < 1e-9


def test_shuffle_partition_sizing():
    from parley.session import suggest_shuffle_partitions
    assert suggest_shuffle_partitions(10 * 1024 ** 2, cores=8) == 8                 # small input: one per core
    assert suggest_shuffle_partitions(100 * 1024 ** 4, cores=8000) == 824000        # 100 TB at 128 MB, rounded to cores
    assert suggest_shuffle_partitions(1024 ** 3, cores=8, expansion=2.0) == 16


def test_rater_agreement_refuses_a_column_that_is_no_rubric(spark):
    df = spark.range(200).select((F.col("id")).cast("int").alias("a"), (F.col("id") + 1).cast("int").alias("b"))
    with pytest.raises(Exception, match="too many labels"):
        E.rater_agreement(df, "a", "b").collect()
    assert E.rater_agreement(df.limit(0), "a", "b").first().n == 0


def test_crosstab_counts_every_row(spark):
    from parley.operators import aggregates as A
    df = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", None), ("y", "zzz"), ("y", "other")], "r string, c string")
    got = {r.r: tuple(r)[1:] for r in A.crosstab(df, "r", "c", ["a", "b"]).collect()}
    assert got == {"x": (1, 1, 0, 1), "y": (0, 0, 2, 0)}


def test_class_outside_the_policy_fails(spark):
    from parley.operators import retrieval as RT
    c = spark.createDataFrame([(1, "no_such_class", 0, 0.9, 2, "x", "y", False)],
                              "q_id long, q_class string, rank int, cos double, n_id long, n_class string, n_type string, n_template boolean")
    with pytest.raises(Exception, match="outside the policy"):
        RT.apply_gates(c, RT.policy_table(spark, {"a": ("required", ["y"])})).collect()


def test_accents_of_extended_latin(spark):
    from parley.functions import text as T
    df = spark.createDataFrame([("šžčřğşőÉñ ø ß",)], "t string")
    assert df.select(T.strip_accents("t").alias("t")).first().t == "szcrgsoEn ø ß"


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace as N
    from parley import session
    conf = N(get=lambda k, d=None: d)
    spark = N(conf=conf, sparkContext=N(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(spark)
