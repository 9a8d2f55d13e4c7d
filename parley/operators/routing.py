"""Routing and decisions (R8, G6-G9): one projection over queries joined to their
grounding choice. No per-query loop: the candidate table is reduced once by
``pick_grounding`` (a single aggregation by query) and joined back.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rules as R
from ..functions import text as T
from .retrieval import pick_grounding


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


# G6 / G7 ---------------------------------------------------------------------------
def route(queries: DataFrame, candidates: DataFrame | None, id_col: str, intent_col: str, text_col: str,
          drafts: DataFrame | None = None) -> DataFrame:
    """Route cascade, first match wins: safety override, no-draft policy, canned
    template, stated policy fact, no usable grounding, grounded. Drafts are the policy
    string, the template, or externally supplied text joined by (id, route) and reused
    only when the route is unchanged."""
    if candidates is not None:
        pick = pick_grounding(candidates.withColumnRenamed("q_id", id_col), id_col)
        q = queries.join(pick, id_col, "left")
    else:
        q = queries.select("*", F.lit(None).cast("long").alias("grounded_on"),
                           F.lit(None).cast("int").alias("grounding_rank"),
                           F.lit(None).cast("double").alias("gated_score"),
                           F.lit(0).cast("long").alias("n_usable"), F.lit(0).cast("long").alias("n_candidates"))
    q = q.withColumn("n_usable", F.coalesce("n_usable", F.lit(0)).cast("long")) \
        .withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)).cast("long"))
    intent = F.col(intent_col)
    fired = R.check_overrides(F.col(text_col), intent)
    q = q.withColumn("_fired", fired)
    rt = R.cascade([
        ("escalate_override", F.size("_fired") > 0),
        ("no_draft_policy", intent.isin(list(P.NO_DRAFT))),
        ("policy_fact", intent.isin(list(P.TEMPLATES))),
        ("policy_fact", intent.isin(list(P.POLICY_FACTS))),
        ("no_usable_grounding", F.col("n_usable") == 0),
    ], "grounded")
    q = q.withColumn("route", rt)
    keep_grounding = F.col("route") == "grounded"
    grounded_on = F.when(keep_grounding, F.col("grounded_on").cast("string")) \
        .when(intent.isin(list(P.TEMPLATES)) & (F.col("route") == "policy_fact"), F.lit("TEMPLATE")) \
        .when(F.col("route") == "policy_fact", F.lit("POLICY_FACT"))
    q = q.withColumn("override", F.when(F.col("route") == "escalate_override", F.array_join("_fired", ","))) \
        .withColumn("grounded_on", grounded_on) \
        .withColumn("grounding_rank", F.when(keep_grounding, F.col("grounding_rank"))) \
        .withColumn("gated_score", F.when(keep_grounding, F.col("gated_score")))
    fixed = F.when(F.col("route") == "escalate_override", F.lit(P.ESCALATE_OVERRIDE)) \
        .when(F.col("route") == "no_draft_policy", _map(P.NO_DRAFT)[intent]) \
        .when(F.col("route") == "policy_fact", _map(P.TEMPLATES)[intent]) \
        .when(F.col("route") == "no_usable_grounding", F.lit(P.NO_GROUNDING))
    if drafts is not None:
        ext = drafts.select(F.col(id_col).alias("_did"), F.col("route").alias("_droute"),
                            F.col("draft").alias("_dtext"))
        q = q.join(ext, (q[id_col] == ext["_did"]) & (q["route"] == ext["_droute"]), "left") \
            .drop("_did", "_droute")
        q = q.withColumn("draft", F.coalesce(fixed, F.col("_dtext"))).drop("_dtext")
    else:
        q = q.withColumn("draft", fixed)
    return q.drop("_fired")


# G8 ---------------------------------------------------------------------------
def draft_checks(d: DataFrame, intent_col: str, grounding_text: Column | None = None) -> DataFrame:
    """Abstained, length, link, unsupported specifics, era terms. Template and policy
    rows compare against their own stated text, so their result is vacuous for
    templates by construction."""
    draft = F.col("draft")
    src = F.when(F.col("route") == "policy_fact",
                 F.coalesce(_map(P.POLICY_FACTS)[F.col(intent_col)], _map(P.TEMPLATES)[F.col(intent_col)], F.lit("")))
    if grounding_text is not None:
        src = src.when(F.col("route") == "grounded", grounding_text)
    uns = F.when(F.col("route").isin("policy_fact", "grounded"), T.unsupported_specifics(draft, src)) \
        .otherwise(F.array().cast("array<string>"))
    uns = F.coalesce(uns, F.array().cast("array<string>"))
    era = F.coalesce(T.term_hits(draft), F.array().cast("array<string>"))
    return d.withColumn("abstained", F.coalesce(F.lower(draft).startswith("escalate"), F.lit(False))) \
        .withColumn("chars", F.length(draft)) \
        .withColumn("has_link", T.has_link(draft)) \
        .withColumn("unsupported", uns).withColumn("flagged", F.size("unsupported") > 0) \
        .withColumn("era_violation", era).withColumn("era_flagged", F.size("era_violation") > 0)


# G9 ---------------------------------------------------------------------------
def decide(d: DataFrame, intent_col: str) -> DataFrame:
    """Action and a non-empty stated reason per route; an unknown route fails the job."""
    rt, intent = F.col("route"), F.col(intent_col)
    kind = F.when(intent.isin(list(P.TEMPLATES)), F.lit("canned_template")).otherwise(F.lit("stated_policy_fact"))
    grounded = F.concat(F.lit("grounded:thread="), F.col("grounded_on"), F.lit(",rank="),
                        F.col("grounding_rank").cast("int").cast("string"), F.lit(",gated_score="),
                        T.fmt2("gated_score"))
    action = F.when(rt.isin("escalate_override", "no_draft_policy", "no_usable_grounding"), F.lit("escalate")) \
        .when(rt.isin("policy_fact", "grounded"), F.lit("auto_handle")) \
        .otherwise(F.raise_error(F.concat(F.lit("unmapped route: "), F.coalesce(rt, F.lit("NULL")))))
    reason = F.when(rt == "escalate_override", F.concat(F.lit("safety_override:"), F.col("override"))) \
        .when(rt == "no_draft_policy", _map(P.NO_DRAFT)[intent]) \
        .when(rt == "no_usable_grounding", F.lit(P.NO_USABLE_REASON)) \
        .when(rt == "policy_fact", F.concat(kind, F.lit(":"), intent)) \
        .when(rt == "grounded", grounded)
    out = d.withColumn("action", action).withColumn("reason", reason) \
        .withColumn("quality_flags", T.quality_flags(F.coalesce(F.col("draft"), F.lit(""))))
    return out.withColumn("final_draft", F.when(F.col("action") == "auto_handle", F.col("draft")))
