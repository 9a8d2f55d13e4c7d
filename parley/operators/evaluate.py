"""Evaluation operators.

Inputs are long frames of ``(truth, pred)`` per row. Everything is a grouped aggregate
with map-side combine; the only windows run over class-level results whose size is
the number of class pairs.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rules as R
from ..functions import text as T
from .aggregates import answered_at_most, describe_by, pivot_counts

MAX_LEVELS = 40  # labels of a rubric


def pair_counts(preds: DataFrame, truth="truth", pred="pred", *more: str) -> DataFrame:
    """(truth, pred, more..., n): the one pass over the rows. All measures of classes are
    computed from this table, whose size is the number of class pairs."""
    return preds.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred"), *more).agg(F.count(F.lit(1)).alias("n"))


def _by_truth(preds: DataFrame, truth, pred) -> DataFrame:
    return pair_counts(preds, truth, pred).groupBy(F.col("truth").alias("_t")).agg(
        F.sum("n").alias("_n"), F.sum(F.when(F.col("pred") == F.col("truth"), F.col("n")).otherwise(0)).alias("_c"))


# E1 ---------------------------------------------------------------------------
def per_class(preds: DataFrame, domain: DataFrame, truth="truth", pred="pred") -> DataFrame:
    """Per-class n, correct, accuracy (null when n = 0), sample share, production share
    and over-sampling factor, over the full class domain ``(cls, ord, prod_share)``."""
    g = _by_truth(preds, truth, pred).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    j = domain.join(g, domain["cls"] == g["_t"], "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    tot = F.max("_all").over(Window.partitionBy())  # one row per class
    return j.select("cls", "ord", n.cast("bigint").alias("n"),
                    F.coalesce(F.col("_c"), F.lit(0)).cast("bigint").alias("correct"),
                    F.round(F.col("_c") / F.col("_n"), 6).alias("accuracy"),
                    F.round(n / tot, 6).alias("sample_share"), "prod_share",
                    F.round(n / tot / F.col("prod_share"), 6).alias("over_sampling"))


# E2 / E3 -------------------------------------------------------------------------
def blended_and_reweighted(preds: DataFrame, domain: DataFrame, truth="truth", pred="pred") -> DataFrame:
    """Naive accuracy, and accuracy reweighted to production prevalence with the weights
    renormalized over the classes present."""
    t = _by_truth(preds, truth, pred).join(domain.select(F.col("cls").alias("_t"), "prod_share"), "_t", "left")
    return t.agg(F.round(F.sum("_c") / F.sum("_n"), 6).alias("naive"),
                 F.round(F.sum(F.col("_c") / F.col("_n") * F.col("prod_share")) / F.sum("prod_share"), 6).alias("reweighted"))


# E4 ---------------------------------------------------------------------------
def confusion_long(preds: DataFrame, truth="truth", pred="pred") -> DataFrame:
    return preds.groupBy(F.col(pred).alias("predicted"), F.col(truth).alias("true")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(preds: DataFrame, classes: Sequence[str], truth="truth", pred="pred") -> DataFrame:
    """Counts per true class and predicted class; predictions outside ``classes`` count
    under ``other``, missing ones under ``none``."""
    return pivot_counts(preds, truth, pred, classes)


# E5 / E6 -------------------------------------------------------------------------
def corrected_prevalence(preds: DataFrame, checked: str, truth="truth", pred="pred",
                         external_precision: dict[str, float] | None = None,
                         residual: str | None = None, direct: dict[str, float] | None = None) -> DataFrame:
    """(cls, prevalence, dropped_share): prev(k) = sum_j share(j) * P(true = k | pred = j),
    with P estimated on the hand-checked rows, those whose flag ``checked`` is true.
    Predicted classes with no checked rows may carry an external precision (miss mass goes
    to ``residual``); ``direct`` overrides a class outright. Classes with neither are
    dropped, their share of the rows is reported, and the result is renormalized
    (unrounded). One pass over the rows; the rest works on class pairs."""
    flag = F.coalesce(F.col(checked), F.lit(False))
    c = pair_counts(preds.withColumn("_checked", flag), truth, pred, "_checked")
    mine = Window.partitionBy("pred")
    c = c.select("truth", "pred", (F.sum("n").over(mine) / F.sum("n").over(Window.partitionBy())).alias("share"),
                 F.when(F.col("_checked"), F.col("n")).alias("n"))
    c = c.withColumn("known", F.sum("n").over(mine))
    ext = F.create_map(*[x for k, v in (external_precision or {"": 0.0}).items() for x in (F.lit(k), F.lit(float(v)))])
    prec = F.when(F.col("known").isNull(), ext[F.col("pred")])
    part = lambda cls, v: F.struct(cls.cast("string").alias("cls"), v.alias("v"))
    # classes without a checked row have one or several (truth, pred) pairs: the first speaks for all
    first = F.row_number().over(mine.orderBy(F.col("truth").asc_nulls_first())) == 1
    parts = F.when(F.col("n").isNotNull(), F.array(part(F.col("truth"), F.col("share") * F.col("n") / F.col("known")))) \
        .when(F.col("known").isNull() & first, F.array(
            part(F.when(prec.isNotNull(), F.col("pred")), F.col("share") * F.coalesce(prec, F.lit(1.0))),
            part(F.when(prec.isNotNull(), F.lit(residual)), F.col("share") * (1 - F.coalesce(prec, F.lit(1.0))))))
    raw = c.select(parts.alias("p")).select(F.explode("p").alias("p")).groupBy("p.cls").agg(F.sum("p.v").alias("v"))
    raw = raw.withColumn("dropped_share", F.sum(F.when(F.col("cls").isNull(), F.col("v")).otherwise(0.0)).over(Window.partitionBy()))
    raw = raw.filter(F.col("cls").isNotNull())
    if direct:
        given = preds.sparkSession.createDataFrame(list(direct.items()), "cls string, v double")
        raw = raw.filter(~F.col("cls").isin(list(direct))).unionByName(given, allowMissingColumns=True) \
            .withColumn("dropped_share", F.max("dropped_share").over(Window.partitionBy()))
    return raw.select("cls", (F.col("v") / F.sum("v").over(Window.partitionBy())).alias("prevalence"), "dropped_share")


def delta_vs(prev: DataFrame, prior: DataFrame) -> DataFrame:
    """Change against a previous estimate ``(cls, prior)``, in percentage points."""
    return prev.join(prior, "cls").select(
        "cls", F.round("prevalence", 6).alias("prevalence"), "prior",
        F.round(100 * (F.col("prevalence") - F.col("prior")), 6).alias("delta_pp"))


# E7 ---------------------------------------------------------------------------
def rater_agreement(df: DataFrame, a: str, b: str, weights: str = "index") -> DataFrame:
    """Exact and within-one agreement, linear-weighted Cohen kappa, means and bias on
    rows scored by both raters.

    Weights are label-index distances over the union of labels used (``index``, the
    reference's behaviour) or raw value distances (``value``). One pass counts the pairs of
    labels; the rest is arithmetic on that list, which a rubric keeps short: more than
    ``MAX_LEVELS`` labels fail the job."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")) \
        .agg(F.count(F.lit(1)).alias("c"))
    # one pair more than a rubric can have is gathered at most; the check below then fails
    one = pairs.limit(MAX_LEVELS ** 2 + 1).agg(F.collect_list(F.struct("a", "b", "c")).alias("p"))
    labels = lambda side: F.transform("p", lambda x: x[side])
    one = one.withColumn("lv", F.array_sort(F.array_union(labels("a"), labels("b"))))
    one = one.withColumn("p", F.when(F.size("lv") <= MAX_LEVELS, F.col("p")).otherwise(
        F.from_json(F.raise_error(F.lit("too many labels for a rubric")).cast("string"), dict(one.dtypes)["p"])))
    at = (lambda v: F.array_position("lv", v).cast("double")) if weights == "index" else (lambda v: v.cast("double"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda acc, x: acc + f(x).cast("double"))
    n = F.nullif(total(lambda x: x["c"]), F.lit(0.0))
    obs = total(lambda x: F.abs(at(x["a"]) - at(x["b"])) * x["c"]) / n
    # marginals: every a with its count against every b with its count
    exp = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + F.aggregate(
        "p", F.lit(0.0), lambda acc2, y: acc2 + F.abs(at(x["a"]) - at(y["b"])) * x["c"] * y["c"])) / (n * n)
    one = one.select(
        F.coalesce(n, F.lit(0.0)).cast("bigint").alias("n"),
        (total(lambda x: F.when(x["a"] == x["b"], x["c"]).otherwise(0)) / n).alias("e"),
        (total(lambda x: F.when(F.abs(x["a"] - x["b"]) <= 1, x["c"]).otherwise(0)) / n).alias("w"),
        (total(lambda x: x["a"] * x["c"]) / n).alias("ma"), (total(lambda x: x["b"] * x["c"]) / n).alias("mb"),
        obs.alias("obs"), exp.alias("exp"))
    kappa = F.when((F.col("n") >= 2) & (F.col("exp") != 0), F.lit(1) - F.col("obs") / F.nullif("exp", F.lit(0.0)))
    return one.select("n", F.round("e", 6).alias("exact"), F.round("w", 6).alias("within1"), F.round(kappa, 6).alias("kappa_w"),
                      F.round("ma", 6).alias("mean_a"), F.round("mb", 6).alias("mean_b"),
                      F.round(F.col("ma") - F.col("mb"), 6).alias("bias"))


# E8 ---------------------------------------------------------------------------
def concordance(df: DataFrame, first: str, second: str, by: str | Sequence[str]) -> DataFrame:
    """Agreement of two labelings per group, per prefix of the groups, and overall (rollup
    rows with null keys)."""
    by = [by] if isinstance(by, str) else list(by)
    return df.rollup(*by).agg(F.count(F.lit(1)).alias("n"),
                              F.round(F.avg((F.col(first) == F.col(second)).cast("int")), 6).alias("agree"))


def disagreements(df: DataFrame, first: str, second: str) -> DataFrame:
    """The rows on which two labelings differ, a missing label counting as one."""
    return df.filter(~F.col(first).eqNullSafe(F.col(second)))


# E9 ---------------------------------------------------------------------------
def expected_action(intent: Column, text: Column) -> tuple[Column, Column]:
    """Expected action from the taxonomy, and whether it is circular (decided by the same
    override rule the router uses). Unknown intents yield null (checked by A16)."""
    exp = F.create_map(*[x for k, v in P.EXPECTED_ACTION.items() for x in (F.lit(k), F.lit(v))])[intent]
    physical = R.matches(text, dict(P.OVERRIDES)["physical_or_hardware"])
    circular = (intent == F.lit("battery_drain")) & physical
    return F.when(circular, F.lit("escalate")).otherwise(exp), circular


def conformance(df: DataFrame, action: str, expected: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.count_if(F.col(action) == F.col(expected)).alias("agree"),
                  F.round(F.avg((F.col(action) == F.col(expected)).cast("int")), 6).alias("agreement"))


# E10 --------------------------------------------------------------------------
def flagged_mean(df: DataFrame, flag: str, value: str) -> DataFrame:
    return df.groupBy(flag).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean_quality"))


# E11 --------------------------------------------------------------------------
def detector_precision(df: DataFrame, by: str, pred: str, truth: str, cls: str) -> DataFrame:
    fl = F.col(pred) == cls
    ok = fl & (F.col(truth) == cls)
    return df.groupBy(by).agg(F.count_if(fl).alias("flagged"), F.count_if(ok).alias("accepted"),
                              F.round(F.count_if(ok) / F.count_if(fl), 6).alias("precision"))


# E12 --------------------------------------------------------------------------
def rule_counters(df: DataFrame, text: str, label: str, final: str) -> DataFrame:
    thin = T.is_thin(text)
    return df.agg(
        F.count_if(thin).alias("thin"),
        F.count_if((F.col(label) == "ios_version_downgrade") & (F.col(final) == P.RESIDUAL) & ~thin)
        .alias("downgrade_rejected"),
        F.count_if(R.looks_non_english(text)).alias("non_english_rule"),
        F.count_if(F.col(final) == P.OUT_OF_SCOPE).alias("rerouted"))


# E13 --------------------------------------------------------------------------
def _long(df: DataFrame, section: str, part: str | Column, key: Column, **values: Column) -> DataFrame:
    """(section, part, key, value): one row per given value, its name behind the key."""
    part = F.lit(part) if isinstance(part, str) else part
    pairs = F.array(*[F.struct(F.concat_ws(":", key, F.lit(name)).alias("key"), v.cast("double").alias("value")) for name, v in values.items()])
    return df.select(F.lit(section).alias("section"), part.cast("string").alias("part"), F.explode(pairs).alias("x")) \
        .select("section", "part", "x.key", F.round("x.value", 6).alias("value"))


def dims_long(scores: DataFrame, dims: Sequence[str], *more: str) -> DataFrame:
    """(more.., dim, score) of all scores that are numbers."""
    cells = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).try_cast("double").alias("score")) for d in dims])
    return scores.select(*more, F.explode(cells).alias("x")).select(*more, "x.dim", "x.score").filter(F.col("score").isNotNull())


def score_parts(scores: DataFrame, part: str, dims: Sequence[str], hi: float = 4, lo: float = 2) -> DataFrame:
    """Mean, median, share of high and of low scores, and number per dimension."""
    s = describe_by(dims_long(scores, dims), "dim", "score", hi, lo)
    return _long(s, "C", part, F.col("dim"), mean=F.col("mean"), median=F.col("median"), share_hi=F.col("share_hi"), share_lo=F.col("share_lo"), n=F.col("n"))


def full_rollup(preds: DataFrame, domain: DataFrame, decisions: DataFrame, human: DataFrame, judge: DataFrame,
                dims: Sequence[str], buckets: Sequence[tuple[str, Column, bool]], id_col: str = "id") -> DataFrame:
    """The whole evaluation as (section, part, key, value).

    A, labels: accuracy per class, naive and reweighted accuracy, confusion counts (E1-E4).
    B, actions: agreement with the expected action, circular rows, counts by expected and taken
    action (E9). C, replies: scores of a person on random rows, their means on all rows, and
    their weighted kappa with the judge's (A8, E7); the judge's scores, means per route, means
    on flagged and other drafts (E10), and how often each anchor is used (A9). D: what
    auto-handled rows got, and how many at most were answered (A13).

    ``preds`` (truth, pred); ``decisions`` (id, intent, text, route, action, flagged);
    ``human`` (id, sample_type, dims..) with scores as text; ``judge`` (id, dims..). Each input
    is reduced to counts or grouped means before anything is joined or united."""
    exp, circ = expected_action(F.col("intent"), F.col("text"))
    act = decisions.withColumn("expected", exp).withColumn("circular", circ)
    per, counts = per_class(preds, domain), pair_counts(preds)
    pairs = act.groupBy("expected", "action").agg(F.count(F.lit(1)).alias("n"), F.count_if("circular").alias("c"))
    agree = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("expected") == F.col("action"), F.col("n")).otherwise(0)).alias("ok"), F.sum("c").alias("c"))
    both = dims_long(human, dims, id_col).withColumnRenamed("score", "h").join(dims_long(judge, dims, id_col).withColumnRenamed("score", "j"), [id_col, "dim"])
    routed = dims_long(judge, dims, id_col).join(decisions.select(id_col, "route", "flagged"), id_col)
    by_route = routed.groupBy("route", "dim").agg(F.avg("score").alias("m"))
    crossed = routed.groupBy("flagged", "dim").agg(F.avg("score").alias("m"), F.count(F.lit(1)).alias("n"))
    anchors = dims_long(judge, dims).groupBy("dim", F.col("score").cast("int").alias("anchor")).agg(F.count(F.lit(1)).alias("n"))
    people = dims_long(human, dims).groupBy("dim").agg(F.avg("score").alias("m"))
    auto = answered_at_most(decisions.filter(F.col("action") == "auto_handle"), buckets)
    parts = [
        _long(per, "A", "per_class", F.col("cls"), accuracy=F.col("accuracy"), n=F.col("n")),
        _long(blended_and_reweighted(preds, domain), "A", "blended", F.lit("all"), naive=F.col("naive"), reweighted=F.col("reweighted")),
        _long(counts, "A", "confusion", F.concat_ws(">", "truth", "pred"), n=F.col("n")),
        _long(agree, "B", "conformance", F.lit("all"), n=F.col("n"), agree=F.col("ok"), agreement=F.col("ok") / F.col("n"), circular=F.col("c")),
        _long(pairs, "B", "crosstab", F.concat_ws(">", "expected", "action"), n=F.col("n")),
        score_parts(human.filter(F.col("sample_type") == "random"), "human_random", dims),
        _long(people, "C", "human_all", F.col("dim"), mean=F.col("m")),
        score_parts(judge, "judge", dims),
        _long(by_route, "C", "judge_by_route", F.concat_ws(":", "route", "dim"), mean=F.col("m")),
        _long(crossed, "C", "judge_cross_check", F.concat_ws(":", F.when(F.col("flagged"), "flagged").otherwise("unflagged"), "dim"), mean=F.col("m"), n=F.col("n")),
        _long(anchors, "C", "anchors", F.concat_ws(":", "dim", F.col("anchor").cast("string")), n=F.col("n")),
        _long(auto, "D", "auto_handle", F.lit("rows"), **{c: F.col(c) for c in auto.columns}),
    ]
    for dim in dims:
        k = rater_agreement(both.filter(F.col("dim") == dim).select("h", "j"), "h", "j")
        parts.append(_long(k, "C", "agreement", F.lit(dim), n=F.col("n"), exact=F.col("exact"), within1=F.col("within1"), kappa_w=F.col("kappa_w"), bias=F.col("bias")))
    return reduce(DataFrame.unionByName, parts)
