"""Gated retrieval (G1-G5): per-class pools, the four gates, hit summaries and the
grounding choice.

Candidates are long rows ``(q_id, q_class, rank, cos, n_id, n_class, n_type,
n_template, tau)``; the policy is a small rule table ``(cls, policy, types, pool_key)``
joined by broadcast (its size is the number of classes).
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..session import keep
from . import sampling as W
from . import vectors as V


def policy_table(spark: SparkSession, policy: dict[str, tuple[str, Sequence[str]]] | None = None) -> DataFrame:
    """Class -> (policy, acceptable types, pool_key). Classes whose type sets are equal
    share one ``pool_key`` so each distinct pool is built once (V4)."""
    policy = policy or P.POLICY
    rows = [(cls, pol, sorted(types), "|".join(sorted(types)) or None) for cls, (pol, types) in policy.items()]
    return spark.createDataFrame(rows, "cls string, policy string, types array<string>, pool_key string")


def known_class(known: str, cls: str, value):
    """``value`` where the flag column ``known`` is set; a class outside the policy fails the
    job, for it would otherwise fall through to a branch it was never meant for (Q2)."""
    return F.when(F.col(known), value).otherwise(
        F.raise_error(F.concat(F.lit("class outside the policy: "), F.coalesce(F.col(cls), F.lit("NULL")))).cast("string"))


# G1 ---------------------------------------------------------------------------
def class_pools(corpus: DataFrame, policy: DataFrame, eval_ids: DataFrame | None, id_col: str, type_col: str,
                cluster_col: str, cap: int = P.MAX_REPS, seed=0) -> DataFrame:
    """One pool per distinct ``pool_key``: corpus rows whose type is acceptable, minus the
    evaluation ids, if given (anti-join), at most ``cap`` rows per near-duplicate cluster."""
    keys = policy.filter((F.col("policy") != "none") & (F.size("types") > 0)) \
        .select("pool_key", F.explode("types").alias("_type")).distinct()
    pool = corpus if eval_ids is None else corpus.join(eval_ids.select(id_col), id_col, "left_anti")
    pool = pool.join(F.broadcast(keys), pool[type_col] == keys["_type"]).drop("_type")
    return W.per_stratum(pool, ["pool_key", cluster_col], id_col, cap, seed)


# G2 ---------------------------------------------------------------------------
def apply_gates(c: DataFrame, policy: DataFrame, tau=P.TAU, template_exempt: str = "non_english") -> DataFrame:
    """G1 similarity >= tau (a number or a per-row column), G2 neighbour type acceptable
    for the query class, G3 neighbour class equals query class, G4 not a redirect
    template unless the query class is exempt; usable = all four; gated score."""
    pol = F.broadcast(policy.select(F.col("cls").alias("q_class"), F.col("types").alias("_types"),
                                    F.lit(True).alias("_known")))
    c = c.join(pol, "q_class", "left").withColumn("q_class", known_class("_known", "q_class", F.col("q_class"))).drop("_known")
    tau_c = F.col(tau) if isinstance(tau, str) else F.lit(float(tau))
    c = c.withColumn("g1_lexical", F.col("cos") >= tau_c) \
        .withColumn("g2_form", F.coalesce(F.array_contains("_types", F.col("n_type")), F.lit(False))) \
        .withColumn("g3_topic", F.coalesce(F.col("n_class") == F.col("q_class"), F.lit(False))) \
        .withColumn("g4_template", ~F.coalesce(F.col("n_template"), F.lit(False))
                    | (F.col("q_class") == template_exempt)) \
        .drop("_types")
    usable = F.col("g1_lexical") & F.col("g2_form") & F.col("g3_topic") & F.col("g4_template")
    return c.withColumn("usable", usable) \
        .withColumn("gated_score", F.when(usable, F.col("cos")).otherwise(F.lit(0.0)))


def gate_by_pool(queries: DataFrame, corpus: DataFrame, policy: DataFrame, id_col: str, vec_col: str, cls: str, type_col: str,
                 template: str, k: int = P.TOP_K, pairs: int = P.RANDOM_PAIRS, pctile: float = P.TAU_PCTILE, seed=0,
                 template_exempt: str = "non_english") -> DataFrame:
    """Candidates of every query from the pool of its class's acceptable types, gated at the
    threshold of that pool: the ``pctile`` similarity of random pairs inside it. Classes that
    accept the same types share a pool and its threshold; classes of policy ``none`` have no
    pool and no candidates. A pool too small for a pair has no threshold and passes nothing."""
    keys = policy.filter((F.col("policy") != "none") & (F.size("types") > 0))
    types = F.broadcast(keys.select("pool_key", F.explode("types").alias("_type")).distinct())
    pool = keep(corpus.join(types, corpus[type_col] == types["_type"]).select("pool_key", id_col, vec_col, cls, type_col, template))
    tau = V.calibrate(pool, id_col, vec_col, pairs, pctile, seed, key_col="pool_key").select("pool_key", "tau")
    known = F.broadcast(keys.select(F.col("cls").alias("_cls"), "pool_key"))
    q = queries.join(known, queries[cls] == known["_cls"]).select("pool_key", id_col, vec_col, cls)
    c = V.topk_dense(q, pool, k, id_col, vec_col, key_col="pool_key")
    c = c.join(q.select(F.col(id_col).alias("q_id"), F.col(cls).alias("q_class"), "pool_key"), "q_id") \
        .join(pool.select("pool_key", F.col(id_col).alias("n_id"), F.col(cls).alias("n_class"), F.col(type_col).alias("n_type"),
                          F.col(template).alias("n_template")), ["pool_key", "n_id"])
    c = c.join(F.broadcast(tau), "pool_key", "left")  # one row per pool
    g = apply_gates(c, policy, "tau", template_exempt)
    return g.withColumn("g1_lexical", F.coalesce("g1_lexical", F.lit(False))).withColumn("usable", F.coalesce("usable", F.lit(False)))


# G3 ---------------------------------------------------------------------------
def hit_table(c: DataFrame, queries: DataFrame, q_id: str = "q_id") -> DataFrame:
    """Per query: old hit (any candidate passing G1) and new hit (any usable), reindexed
    to the full query list with missing queries as False (J9)."""
    h = c.groupBy(q_id).agg(F.bool_or("g1_lexical").alias("old_hit"), F.bool_or("usable").alias("new_hit"))
    return queries.join(h, q_id, "left") \
        .withColumn("old_hit", F.coalesce("old_hit", F.lit(False))) \
        .withColumn("new_hit", F.coalesce("new_hit", F.lit(False)))


def summarize(hits: DataFrame, policy: DataFrame, cls: str = "q_class") -> DataFrame:
    """Old vs gated hit@k per class with the policy group, percentages and the gap."""
    pol = F.broadcast(policy.select(F.col("cls").alias(cls), "policy"))
    return hits.join(pol, cls, "left").groupBy(cls, "policy").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(100 * F.avg(F.col("old_hit").cast("int")), 6).alias("old_hit_pct"),
        F.round(100 * F.avg(F.col("new_hit").cast("int")), 6).alias("new_hit_pct"),
    ).withColumn("gap_pp", F.round(F.col("new_hit_pct") - F.col("old_hit_pct"), 6))


def summarize_groups(hits: DataFrame, policy: DataFrame, cls: str = "q_class") -> DataFrame:
    """Old vs gated hit@k per policy group, and over all queries (null group)."""
    pol = F.broadcast(policy.select(F.col("cls").alias(cls), "policy"))
    return hits.join(pol, cls, "left").rollup("policy").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(100 * F.avg(F.col("old_hit").cast("int")), 6).alias("old_hit_pct"),
        F.round(100 * F.avg(F.col("new_hit").cast("int")), 6).alias("new_hit_pct"))


# G4 ---------------------------------------------------------------------------
def retrieval_metrics(c: DataFrame, q_id: str = "q_id") -> DataFrame:
    per_q = c.groupBy(q_id).agg(F.bool_or("usable").alias("_hit"),
                                F.bool_or(F.col("usable") & (F.col("rank") == 0)).alias("_hit1"),
                                F.count_if("usable").alias("_nu"), F.count(F.lit(1)).alias("_nc"))
    return per_q.agg(F.count(F.lit(1)).alias("queries"),
                     F.round(F.avg(F.col("_hit").cast("int")), 6).alias("hit_at_k"),
                     F.round(F.avg(F.col("_hit1").cast("int")), 6).alias("hit_at_1"),
                     F.round(F.sum("_nu") / F.sum("_nc"), 6).alias("precision_at_k"),
                     F.round(F.avg("_nu"), 6).alias("mean_usable"))


def fail_by_rank(c: DataFrame) -> DataFrame:
    """Share of candidates that fail the gates, by rank."""
    return c.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((~F.col("usable")).cast("int")), 6).alias("fail_rate"))


# P4 ---------------------------------------------------------------------------
def label_neighbours(c: DataFrame, labeler: Callable[[DataFrame], DataFrame] | None = None,
                     log: DataFrame | None = None, label: str = "label") -> DataFrame:
    """Candidates with a ``label`` for each neighbour. A labeler is any function from the
    distinct neighbours ``(n_id)`` to ``(n_id, label)``; the default joins a label log."""
    asked = c.select("n_id").distinct()
    got = labeler(asked) if labeler is not None else asked.join(log.select("n_id", label), "n_id")
    return c.join(got.select("n_id", F.col(label).alias("label")), "n_id", "left")


# G5 / T3 ----------------------------------------------------------------------
def pick_grounding(c: DataFrame, q_id: str = "q_id") -> DataFrame:
    """Best gated candidate per query (highest gated score, lowest rank on ties) among
    usable ones, plus the usable and candidate counts. One aggregation by query."""
    best = F.max_by(F.struct("n_id", "rank", "gated_score"),
                    F.when(F.col("usable"), F.struct(F.col("gated_score"), -F.col("rank"))))
    return c.groupBy(q_id).agg(best.alias("_best"), F.count_if("usable").alias("n_usable"),
                               F.count(F.lit(1)).alias("n_candidates")) \
        .select(q_id, F.when(F.col("n_usable") > 0, F.col("_best.n_id")).alias("grounded_on"),
                F.when(F.col("n_usable") > 0, F.col("_best.rank")).alias("grounding_rank"),
                F.when(F.col("n_usable") > 0, F.col("_best.gated_score")).alias("gated_score"),
                "n_usable", "n_candidates")
