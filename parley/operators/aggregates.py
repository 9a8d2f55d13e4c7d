"""Aggregations (A1-A17). All are single-pass, map-side-combinable aggregates; window
totals use an unpartitioned ``sum() over ()`` only on already-aggregated (small) frames.
"""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import grouped_quantiles


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# A1 ---------------------------------------------------------------------------
def value_counts(df: DataFrame, col: str, null_as: str | None = None) -> DataFrame:
    """Counts and share of total. The total is a scalar subquery over the grouped counts, so
    the table is scanned once and no window gathers the groups into one task."""
    key = F.coalesce(F.col(col), F.lit(null_as)) if null_as is not None else F.col(col)
    g = df.groupBy(key.alias(col)).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n")).scalar()
    return g.withColumn("share", F.round(F.col("n") / total, 6))


# A2 ---------------------------------------------------------------------------
def domain_counts(df: DataFrame, col: str, domain: DataFrame, domain_col: str | None = None) -> DataFrame:
    """Counts over a fixed domain: every domain value appears, zero when absent."""
    dc = domain_col or col
    g = df.groupBy(F.col(col).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return domain.join(g, domain[dc] == g["_k"], "left") \
        .withColumn("n", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint")).drop("_k", "_n")


def pivot_counts(df: DataFrame, row: str, col: str, values: Sequence[str], null_as: str = "none") -> DataFrame:
    values = [v for v in values if v not in ("other", null_as)]
    c = F.col(col).cast("string")
    named = F.when(c.isNull(), F.lit(null_as)).when(c.isin(values) | (c == null_as), c).otherwise(F.lit("other"))
    cols = [*values, "other", null_as]
    out = df.withColumn(col, named).groupBy(row).pivot(col, cols).count()
    return out.na.fill(0, cols)


# A3 ---------------------------------------------------------------------------
def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str], null_as: str = "none") -> DataFrame:
    """Two-way contingency table with an explicit column list (stable schema): values that
    are not listed count under ``other``, nulls under ``null_as``."""
    return pivot_counts(df, row, col, values, null_as)


# A6 ---------------------------------------------------------------------------
def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    f = F.approx_count_distinct(col) if approx else F.countDistinct(col)
    return df.agg(f.alias("n_distinct"))


# A7 ---------------------------------------------------------------------------
def any_per_group(df: DataFrame, key: str, flag: Column, name: str = "any_flag") -> DataFrame:
    return df.groupBy(key).agg(F.bool_or(flag).alias(name), F.count(F.lit(1)).alias("n"))


# A8 ---------------------------------------------------------------------------
def describe_by(df: DataFrame, key: str, value: str, hi: float, lo: float) -> DataFrame:
    """Mean, exact median, min, max and shares at/over ``hi`` and at/under ``lo``;
    nulls skipped. The median comes from counts (``grouped_quantiles``), not from a buffer."""
    v = F.col(value)
    stats = df.groupBy(key).agg(
        F.count(v).alias("n"),
        F.round(F.avg(v), 6).alias("mean"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.round(F.avg(F.when(v.isNotNull(), (v >= hi).cast("double"))), 6).alias("share_hi"),
        F.round(F.avg(F.when(v.isNotNull(), (v <= lo).cast("double"))), 6).alias("share_lo"),
    )
    median = grouped_quantiles(df, [key], value, [0.5]).select(F.col(key).alias("_key"), F.round("q0", 6).alias("median"))
    return stats.join(median, F.col(key).eqNullSafe(F.col("_key"))) \
        .select(key, "n", "mean", "median", "min", "max", "share_hi", "share_lo")


# A9 ---------------------------------------------------------------------------
def score_histogram(df: DataFrame, dims: Sequence[str], anchors: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Unpivot score columns, count each anchor per dimension, and list the distinct
    anchors used."""
    stack = "stack({n}, {pairs}) as (dim, score)".format(
        n=len(dims), pairs=", ".join(f"'{d}', cast(`{d}` as int)" for d in dims))
    long = df.selectExpr(stack)
    counts = [F.count_if(F.col("score") == a).alias(f"s{a}") for a in anchors]
    return long.groupBy("dim").agg(
        *counts, F.array_join(F.array_sort(F.collect_set("score")), ",").alias("anchors_used"))


# A10 ---------------------------------------------------------------------------
def explode_count(df: DataFrame, arr: Column, name: str = "item") -> DataFrame:
    return df.select(F.explode(arr).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


# A11 ---------------------------------------------------------------------------
def prefix_rollup(df: DataFrame, col: str, sep: str = ":") -> DataFrame:
    return df.groupBy(F.substring_index(F.col(col), sep, 1).alias("prefix")) \
        .agg(F.count(F.lit(1)).alias("n"))


# A12 ---------------------------------------------------------------------------
def gate_attrition(df: DataFrame, gates: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of candidates failing each gate, one pass."""
    aggs = [F.round(F.avg((~F.col(g)).cast("double")), 6).alias(f"{g}_fail") for g in gates]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs) if by else \
        df.agg(F.count(F.lit(1)).alias("n"), *aggs)


# A13 ---------------------------------------------------------------------------
def decomposition(df: DataFrame, buckets: Sequence[tuple[str, Column]], total_name="total") -> DataFrame:
    """Count per named bucket plus the total and the unassigned remainder. Buckets are
    made mutually exclusive by order (first match wins)."""
    assigned = F.lit(False)
    aggs = []
    for name, cond in buckets:
        aggs.append(F.count_if(cond & ~assigned).alias(name))
        assigned = assigned | cond
    aggs.append(F.count_if(~assigned).alias("unassigned"))
    aggs.append(F.count(F.lit(1)).alias(total_name))
    return df.agg(*aggs)


def answered_at_most(df: DataFrame, buckets: Sequence[tuple[str, Column, bool]], total_name="total") -> DataFrame:
    """``decomposition`` for (name, condition, answers) with two columns more: ``answered_at_most``,
    the rows in buckets that answer anything, and ``resolves_nothing``, the others. The rest that
    no bucket takes counts as answered, so the bound holds whatever it is."""
    out = decomposition(df, [(name, cond) for name, cond, _ in buckets], total_name)
    silent = sum((F.col(name) for name, _, answers in buckets if not answers), F.lit(0))
    return out.withColumn("answered_at_most", (F.col(total_name) - silent).cast("bigint")) \
        .withColumn("resolves_nothing", silent.cast("bigint"))


# A14 ---------------------------------------------------------------------------
def cluster_sizes(df: DataFrame, cluster: str, id_col: str, text_col: str, top: int | None = None) -> DataFrame:
    g = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"),
                                F.min_by(F.col(text_col), F.col(id_col)).alias("example"))
    g = g.orderBy(F.desc("size"), cluster)
    return g.limit(top) if top else g


# A15 ---------------------------------------------------------------------------
def row_min(*cols) -> Column:
    return F.least(*[_c(c) for c in cols])


# A16 ---------------------------------------------------------------------------
def violations(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row of violation counts; every count must be zero."""
    return df.agg(*[F.count_if(cond).alias(name) for name, cond in checks])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("dup_keys"))


def assert_zero(row_df: DataFrame) -> None:
    """Fail the job when any violation count is non-zero (a one-row driver read)."""
    r = row_df.first().asDict()
    bad = {k: v for k, v in r.items() if v}
    if bad:
        raise AssertionError(f"constraint violations: {bad}")


# A17 ---------------------------------------------------------------------------
def null_counts(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    cols = list(cols)
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols],
                  F.count_if(F.coalesce(*[F.col(c) for c in cols]).isNotNull()).alias("rows_with_any"))
