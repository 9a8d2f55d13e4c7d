"""Deterministic samplers.

A seeded RNG cannot be replayed by a distributed engine, so every draw orders rows by
``md5(seed ':' id)``: uniform, seeded, and independent of partitioning and re-runs.

Scale rules followed throughout:
- per-stratum draws are ``row_number() <= literal`` filters, which Spark plans as a
  ``WindowGroupLimit`` (partial top-n before the shuffle), so a stratum holding a third
  of the data ships at most ``n`` rows per map partition;
- stratum sizes come from grouped aggregates (map-side combine) joined back on the
  stratum key, never from an unbounded window over the stratum;
- global totals are scalar subqueries, never a window over the whole table.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str | Column, seed: int | str = 0) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def with_order(df: DataFrame, id_col: str, seed=0, name="_ord") -> DataFrame:
    return df.withColumn(name, hash_order(id_col, seed))


def _top_n_per(df: DataFrame, keys: Sequence[str], bound: int, order: Sequence, rn="_rn") -> DataFrame:
    """Rank inside ``keys`` and keep ranks ``<= bound`` (static, so WindowGroupLimit
    applies). With no keys it is a bounded top-n (TakeOrderedAndProject)."""
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= bound)
    top = df.orderBy(*order).limit(bound)
    return top.withColumn(rn, F.row_number().over(Window.orderBy(*order)))


# W1 ---------------------------------------------------------------------------
def sample_n(df: DataFrame, id_col: str, n: int, seed=0) -> DataFrame:
    """Simple random n: top-n by hash order."""
    return with_order(df, id_col, seed).orderBy("_ord", id_col).limit(n).drop("_ord")


# W2 ---------------------------------------------------------------------------
def per_stratum(df: DataFrame, stratum: str | Sequence[str], id_col: str, n: int | Column,
                seed=0, bound: int | None = None, rank_name: str | None = None) -> DataFrame:
    """``min(n, size)`` rows per stratum. ``n`` may be a per-row quota column, in which
    case ``bound`` (the largest quota) keeps the rank filter static."""
    keys = [stratum] if isinstance(stratum, str) else list(stratum)
    o = with_order(df, id_col, seed)
    if isinstance(n, Column):
        if bound is None:
            raise ValueError("a quota column needs a static bound")
        out = _top_n_per(o, keys, bound, ["_ord", id_col]).filter(F.col("_rn") <= n)
    else:
        out = _top_n_per(o, keys, n, ["_ord", id_col])
    if rank_name:
        out = out.withColumn(rank_name, F.col("_rn"))
    return out.drop("_ord", "_rn")


# W3 ---------------------------------------------------------------------------
def cap_per_cluster(df: DataFrame, cluster: str, id_col: str, cap: int = 3, seed=0) -> DataFrame:
    return per_stratum(df, cluster, id_col, cap, seed)


def cap_report(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.agg(F.count(F.lit(1)).alias("before"))
    a = after.agg(F.count(F.lit(1)).alias("after")).scalar()
    return b.select("before", a.alias("after")).withColumn(
        "pct_removed", F.round(100.0 * (1 - F.col("after") / F.col("before")), 6))


# W4 ---------------------------------------------------------------------------
def dual_cap(df: DataFrame, id_col: str, cluster: str, tag: Column, n: int, cap_share: float,
             seed=0) -> DataFrame:
    """Target ``n`` rows with no cluster and no tagged stratum above ``cap_share * n``.

    Cascaded bounded ranks: keep the first ``cap`` rows of each cluster, then at most ``cap``
    tagged survivors, then the first ``n`` in hash order. Never exceeds either cap; a tagged
    row that is dropped still used its cluster's slot, so it may pick fewer rows than
    ``dual_cap_exact``."""
    cap = int(n * cap_share)
    o = with_order(df, id_col, seed).withColumn("_tag", F.coalesce(tag, F.lit(False)))
    o = _top_n_per(o, [cluster], cap, ["_ord", id_col]).drop("_rn")
    tagged = o.filter(F.col("_tag")).orderBy("_ord", id_col).limit(cap)
    rest = o.filter(~F.col("_tag"))
    return tagged.unionByName(rest).orderBy("_ord", id_col).limit(n).drop("_ord", "_tag")


def dual_cap_exact(df: DataFrame, id_col: str, cluster: str, tag: Column, n: int, cap_share: float,
                   seed=0) -> DataFrame:
    """The rows that one walk in hash order accepts: a row is passed over if ``cap`` rows of
    its cluster are in, or if it is tagged and ``cap`` tagged rows are in; the walk ends at
    ``n``. Ids are unique; null clusters are one cluster, a null tag is no tag.

    Two rank passes give the walk without walking. Before the tagged cap is full it rejects
    nobody, so there a row is in if its rank in its cluster is at most ``cap``; the cap-th
    tagged row of those is the turning point. After it no tagged row gets in, so tagged rows
    behind it are taken out before clusters are ranked again: those left take the slots.
    Both ranks are bounded filters; nothing passes the driver."""
    cap = int(n * cap_share)
    o = with_order(df, id_col, seed).withColumn("_tag", F.coalesce(tag, F.lit(False)))
    order = ["_ord", id_col]
    first = _top_n_per(o.select("_ord", id_col, cluster, "_tag"), [cluster], cap, order).filter("_tag").orderBy(*order).limit(cap)
    turn = first.agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(*order)).alias("_at")) \
        .select(F.when(F.col("_n") >= cap, F.col("_at")).alias("_at")).select("_at.*")
    to, at = turn.select("_ord").scalar(), turn.select(id_col).scalar()
    open_ = o.filter(~F.col("_tag") | to.isNull() | (F.col("_ord") < to) | ((F.col("_ord") == to) & (F.col(id_col) <= at)))
    return _top_n_per(open_, [cluster], cap, order).orderBy(*order).limit(n).drop("_ord", "_tag", "_rn")


# W5 ---------------------------------------------------------------------------
def quota_draw(df: DataFrame, id_col: str, flag: Column, n: int, max_flagged: int | None,
               seed=0, by: Sequence[str] = ()) -> DataFrame:
    """``n`` rows (per ``by`` group) with at most ``max_flagged`` flagged ones. A
    shortfall of flagged rows is filled with clean rows up to what exists; a shortfall
    of clean rows is not filled with flagged ones."""
    by = list(by)
    o = with_order(df, id_col, seed)
    order = ["_ord", id_col]
    if max_flagged is None:
        return _top_n_per(o, by, n, order).drop("_ord", "_rn")
    o = o.withColumn("_f", F.coalesce(flag, F.lit(False)))
    fk = _top_n_per(o.filter(F.col("_f")), by, min(max_flagged, n), order)
    ck = _top_n_per(o.filter(~F.col("_f")), by, n, order)
    if by:
        nb = fk.groupBy(*by).agg(F.count(F.lit(1)).alias("_nb"))
        ck = ck.join(nb, by, "left").withColumn("_nb", F.coalesce("_nb", F.lit(0)))
    else:
        ck = ck.withColumn("_nb", fk.agg(F.count(F.lit(1))).scalar())
    ck = ck.filter(F.col("_rn") <= F.lit(n) - F.col("_nb")).drop("_nb")
    return fk.unionByName(ck).drop("_ord", "_f", "_rn")


# W6 ---------------------------------------------------------------------------
def assemble_strata(df: DataFrame, stratum: str, id_col: str, flag: Column,
                    quotas: Sequence[tuple[str, int, int | None]], seed=0) -> DataFrame:
    """Draw every stratum by its quota ``(stratum, n, max_flagged)`` in one pass. The
    quota is a hand-written rule table, compiled into map lookups; ranks are bounded by
    the largest quota."""
    qn = F.create_map(*[x for s, n, _ in quotas for x in (F.lit(s), F.lit(n))])
    qm = F.create_map(*[x for s, n, m in quotas for x in (F.lit(s), F.lit(n if m is None else m))])
    bound = max(n for _, n, _ in quotas)
    o = with_order(df.filter(F.col(stratum).isin([s for s, _, _ in quotas])), id_col, seed)
    o = o.withColumn("_f", F.coalesce(flag, F.lit(False))) \
        .withColumn("_qn", qn[F.col(stratum)]).withColumn("_qm", qm[F.col(stratum)])
    ranked = _top_n_per(o, [stratum, "_f"], bound, ["_ord", id_col])
    fk = ranked.filter(F.col("_f") & (F.col("_rn") <= F.least("_qm", "_qn")))
    nb = fk.groupBy(stratum).agg(F.count(F.lit(1)).alias("_nb"))
    ck = ranked.filter(~F.col("_f")).join(nb, stratum, "left") \
        .filter(F.col("_rn") <= F.col("_qn") - F.coalesce("_nb", F.lit(0))).drop("_nb")
    return fk.unionByName(ck).drop("_ord", "_f", "_rn", "_qn", "_qm")


# W7 ---------------------------------------------------------------------------
def balanced_overdraw(df: DataFrame, kind: str, id_col: str, target: int, n_kinds: int,
                      seed=0) -> DataFrame:
    """``max(1, target // n_kinds)`` per kind, then the whole draw capped at ``target``."""
    per = max(1, target // max(1, n_kinds))
    return sample_n(per_stratum(df, kind, id_col, per, seed), id_col, target, seed)


# W8 ---------------------------------------------------------------------------
def proportional(df: DataFrame, stratum: str, id_col: str, total: int, seed=0) -> DataFrame:
    """``max(1, round_half_even(total * share))`` rows per stratum. Stratum sizes are a
    grouped aggregate; the quota joins back on the stratum key."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_sz"))
    all_n = df.agg(F.count(F.lit(1))).scalar()
    quota = sizes.select(stratum, F.greatest(F.lit(1), F.bround(
        F.lit(float(total)) * F.col("_sz") / all_n, 0).cast("int")).alias("_q"))
    return per_stratum(df.join(quota, stratum, "inner"), stratum, id_col, F.col("_q"), seed,
                       bound=max(1, total)).drop("_q")


# W9 ---------------------------------------------------------------------------
def hard_case_set(df: DataFrame, id_col: str, hard: Column, stratum: str, n_hard: int,
                  n_random: int, seed=0) -> DataFrame:
    """Up to ``n_hard`` flagged rows plus a proportional random set from the rest
    (disjoint by anti-join), tagged by ``sample_type``."""
    hard_rows = sample_n(df.filter(F.coalesce(hard, F.lit(False))), id_col, n_hard, seed) \
        .withColumn("sample_type", F.lit("hard"))
    rest = df.join(hard_rows.select(id_col), id_col, "left_anti")
    rand = proportional(rest, stratum, id_col, n_random, seed).withColumn("sample_type", F.lit("random"))
    return rand.unionByName(hard_rows)


# W10 ---------------------------------------------------------------------------
def hard_easy_mix(df: DataFrame, cls: str, id_col: str, is_hard: Column, quotas: dict[str, int],
                  max_hard: int = 2) -> DataFrame:
    """Per class: up to ``max_hard`` hard rows first, then easy rows, ``n`` in total.
    Within a kind rows go by id (the reference takes the head)."""
    q = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    bound = max(quotas.values())
    o = df.withColumn("_h", F.coalesce(is_hard, F.lit(False))).withColumn("_n", q[F.col(cls)])
    o = o.filter(F.col("_n").isNotNull())
    hard = _top_n_per(o.filter(F.col("_h")), [cls], max_hard, [id_col]) \
        .filter(F.col("_rn") <= F.col("_n"))
    nh = hard.groupBy(cls).agg(F.count(F.lit(1)).alias("_nh"))
    easy = _top_n_per(o.filter(~F.col("_h")), [cls], bound, [id_col]).join(nh, cls, "left") \
        .filter(F.col("_rn") <= F.col("_n") - F.coalesce("_nh", F.lit(0))).drop("_nh")
    return hard.unionByName(easy).drop("_h", "_n", "_rn")


# W11 ---------------------------------------------------------------------------
def blind_sheet(df: DataFrame, keep: Sequence[str], score_cols: Sequence[str],
                renames: dict[str, str] | None = None) -> DataFrame:
    renames = renames or {}
    return df.select(*[F.col(c).alias(renames.get(c, c)) for c in keep],
                     *[F.lit("").alias(s) for s in score_cols])


# W12 ---------------------------------------------------------------------------
def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key under ``order`` (rank filter ``= 1``, a WindowGroupLimit)."""
    keys = [key] if isinstance(key, str) else list(key)
    return _top_n_per(df, keys, 1, order).drop("_rn")


# W13 ---------------------------------------------------------------------------
def dedup_first(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Exact dedup keeping the smallest id (``dropDuplicates`` keeps an arbitrary row)."""
    return latest_per_key(df, key, [F.col(id_col).asc()])


# W14 ---------------------------------------------------------------------------
def accepted(df: DataFrame, handcheck: DataFrame, id_col: str) -> DataFrame:
    """Rows accepted in a hand-check table ``(id, accepted)``, by id (never position)."""
    ok = handcheck.filter(F.col("accepted")).select(id_col)
    return df.join(ok, id_col, "left_semi")
