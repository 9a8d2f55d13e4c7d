"""Query catalog: each operator bound to the driver tables, with its DuckDB twin.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``SQL[name]`` is the equivalent ANSI SQL
over the same tables (absent for operators checked rows-only). Every query reads whole
tables; limits appear only where a top-k or a sample is the operator itself.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rules as R
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import sampling as W
from ..operators import threads as TH
from ..session import spread
from ..sources.io import table
from .sqlre import arr, collapse, fold, q, rcount, re2, rmatch, rreplace, strip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def tb(spark, d, name):
    return table(spark, d, name)


def texts(spark, d, *columns):
    """Columns of the documents, dealt evenly to tasks for the rule cascades."""
    return spread(tb(spark, d, "documents").select(*columns))


def msgs(spark, d):
    return TH.messages_from_turns(tb(spark, d, "conversations"))


# Reply-graph view of ``conversations`` used by the SQL twins.
SQL_MSGS = """(select conv_id, turn, role as author_id, role = 'user' as inbound, text,
    conv_id::varchar || ':' || turn::varchar as tweet_id,
    case when lead(turn) over w is not null then conv_id::varchar || ':' || (lead(turn) over w)::varchar end as response_tweet_id,
    case when lag(turn) over w is not null then conv_id::varchar || ':' || (lag(turn) over w)::varchar end as in_response_to_tweet_id
  from conversations window w as (partition by conv_id order by turn))"""

# Rule/config values bound to the driver tables (chosen for the facts of the synthetic data).
INCIDENTS = [("jan_outage", "2024-01-10", "2024-01-12"), ("jan_followup", "2024-01-20", "2024-01-21")]
SOURCES_POLICY = ["src0", "src3", "src7", "src11"]
LANGS = ["en", "fr", "de", "es"]
SRC_DOMAIN = [f"src{i}" for i in range(20)]


# ---------------------------------------------------------------------------
# Threads, filters, joins
# ---------------------------------------------------------------------------
@register("f2_conversation_shape", f"""
select author_id, count(*)::bigint as n,
  count(*) filter (where in_response_to_tweet_id is null)::bigint as openers,
  count(*) filter (where response_tweet_id is not null and not contains(response_tweet_id, ','))::bigint as single_reply,
  count(*) filter (where response_tweet_id is null)::bigint as terminal
from {SQL_MSGS} m group by author_id""")
def f2_conversation_shape(spark, d):
    m = msgs(spark, d)
    return m.groupBy("author_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(TH.is_opener(F.col("in_response_to_tweet_id"))).alias("openers"),
        F.count_if(TH.has_single_reply(F.col("response_tweet_id"))).alias("single_reply"),
        F.count_if(TH.is_terminal(F.col("response_tweet_id"))).alias("terminal"))


@register("j1_strict_threads", f"""
with m as {SQL_MSGS}
select r.tweet_id, r.author_id, r.in_response_to_tweet_id as parent_id, r.conv_id
from m r join m o on r.in_response_to_tweet_id = o.tweet_id and o.response_tweet_id = r.tweet_id
where not r.inbound and r.response_tweet_id is null and r.in_response_to_tweet_id is not null
  and o.inbound and o.in_response_to_tweet_id is null and o.response_tweet_id is not null
  and not contains(o.response_tweet_id, ',')""")
def j1_strict_threads(spark, d):
    return TH.strict_pairs(msgs(spark, d)).select("tweet_id", "author_id", "parent_id", "conv_id")


@register("j2_parent_lookup", f"""
with m as {SQL_MSGS}
select r.tweet_id, r.author_id, r.in_response_to_tweet_id as parent_id, p.author_id as parent_author,
  md5(p.text) as parent_text_md5
from m r left join m p on r.in_response_to_tweet_id = p.tweet_id
where not r.inbound and r.in_response_to_tweet_id is not null""")
def j2_parent_lookup(spark, d):
    m = msgs(spark, d)
    replies = m.filter(~F.col("inbound") & F.col("in_response_to_tweet_id").isNotNull())
    j = TH.with_parent(replies, m, cols=("text", "author_id"))
    return j.select("tweet_id", "author_id", F.col("in_response_to_tweet_id").alias("parent_id"),
                    F.col("parent_author_id").alias("parent_author"),
                    F.md5("parent_text").alias("parent_text_md5"))


SQL_PAIRS = """(select conv_id, q_turn, r_turn, customer_text, brand_text from (
  select conv_id, turn as q_turn, role, text as customer_text,
    lead(role) over w as nrole, lead(turn) over w as r_turn, lead(text) over w as brand_text
  from conversations window w as (partition by conv_id order by turn)) x
  where role = 'user' and nrole = 'assistant')"""


@register("j2_adjacent_pairs", f"""
select conv_id, q_turn, r_turn, md5(customer_text) as q_md5, md5(brand_text) as r_md5 from {SQL_PAIRS} p""")
def j2_adjacent_pairs(spark, d):
    p = TH.adjacent_pairs(tb(spark, d, "conversations"))
    return p.select("conv_id", "q_turn", "r_turn", F.md5("customer_text").alias("q_md5"),
                    F.md5("brand_text").alias("r_md5"))


@register("a4_author_profile", f"""
with m as {SQL_MSGS},
clean as (
  select r.author_id, count(*) as c
  from m r join m o on r.in_response_to_tweet_id = o.tweet_id and o.response_tweet_id = r.tweet_id
  where not r.inbound and r.response_tweet_id is null and o.inbound and o.in_response_to_tweet_id is null
    and o.response_tweet_id is not null and not contains(o.response_tweet_id, ',')
  group by 1),
vol as (select author_id, count(*) as replies from m where not inbound group by 1)
select v.author_id, v.replies::bigint as replies, coalesce(c.c, 0)::bigint as clean_threads,
  round(coalesce(c.c, 0) / v.replies, 6) as clean_rate
from vol v left join clean c using (author_id) order by replies desc, author_id limit 20""")
def a4_author_profile(spark, d):
    return TH.author_profile(msgs(spark, d), 20)


@register("a5_top_word", """
select token, count(*)::bigint as n from (select unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) as token from documents)
group by token order by n desc, token limit 2""")
def a5_top_word(spark, d):
    docs = tb(spark, d, "documents").select(F.lower("text").alias("t"))
    return TH.top_tokens(docs, "t", "([a-z]+)", 1, 2)


SQL_EVENT_FLAGS = f"""(select event_id, event_type = 'error' as bug_kw,
  case when ts::date between date '{INCIDENTS[0][1]}' and date '{INCIDENTS[0][2]}' then '{INCIDENTS[0][0]}'
       when ts::date between date '{INCIDENTS[1][1]}' and date '{INCIDENTS[1][2]}' then '{INCIDENTS[1][0]}' end as wtag
  from events)"""


def event_flags(spark, d):
    ev = tb(spark, d, "events")
    return TH.incident_flags(ev, "event_type", "ts", INCIDENTS, keyword=F.col("event_type") == "error")


@register("f4_incident_tag", f"""
select event_id, bug_kw, wtag is not null as in_window,
  case when bug_kw or wtag is not null then coalesce(wtag, '{INCIDENTS[0][0]}') end as incident_window
from {SQL_EVENT_FLAGS} e""")
def f4_incident_tag(spark, d):
    return event_flags(spark, d).select("event_id", "bug_kw", "in_window", "incident_window")


@register("f5_flag_overlap", f"""
select count(*) filter (where w or k)::bigint as tagged, count(*) filter (where w and not k)::bigint as a_only,
  count(*) filter (where not w and k)::bigint as b_only, count(*) filter (where w and k)::bigint as both,
  count(*) filter (where not (w or k))::bigint as neither
from (select wtag is not null as w, bug_kw as k from {SQL_EVENT_FLAGS} e) x""")
def f5_flag_overlap(spark, d):
    return TH.flag_overlap(event_flags(spark, d))


@register("f3_window_counts", f"""
select coalesce(wtag, 'none') as window_tag, count(*)::bigint as n from {SQL_EVENT_FLAGS} e group by 1""")
def f3_window_counts(spark, d):
    ev = tb(spark, d, "events")
    tag = R.cascade([(t, T.in_window(F.col("ts"), lo, hi)) for t, lo, hi in INCIDENTS], None)
    return ev.groupBy(F.coalesce(tag, F.lit("none")).alias("window_tag")).agg(F.count(F.lit(1)).alias("n"))


@register("f6_silent_rows", f"""
select count(*)::bigint as n from documents where lang = 'en' and {rmatch('text', P.ACCENTED, folded=False)}""")
def f6_silent_rows(spark, d):
    docs = tb(spark, d, "documents")
    return docs.filter((F.col("lang") == "en") & R.matches("text", P.ACCENTED)).agg(F.count(F.lit(1)).alias("n"))


@register("f7_pool_filter", f"""
select doc_id, lang, source from documents where source in ({', '.join(q(s) for s in SOURCES_POLICY)})""")
def f7_pool_filter(spark, d):
    docs = tb(spark, d, "documents")
    pol = spark.createDataFrame([(s,) for s in SOURCES_POLICY], "source string")
    return docs.join(F.broadcast(pol), "source", "left_semi").select("doc_id", "lang", "source")


@register("j3_left_merge", """
select d.doc_id, d.lang, l.quality as l_quality, l.toxic as l_toxic
from documents d left join labels l on d.doc_id = l.doc_id""")
def j3_left_merge(spark, d):
    docs = tb(spark, d, "documents").select("doc_id", "lang")
    lab = tb(spark, d, "labels").select("doc_id", F.col("quality").alias("l_quality"),
                                        F.col("toxic").alias("l_toxic"))
    return docs.join(lab, "doc_id", "left")


@register("j4_leak_exclusion", """
select d.doc_id, d.lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)""")
def j4_leak_exclusion(spark, d):
    return tb(spark, d, "documents").join(tb(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@register("j5_membership_split", """
select o_orderkey, case when exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R')
  then 'with_return' else 'without_return' end as side from orders o""")
def j5_membership_split(spark, d):
    o = tb(spark, d, "orders").select("o_orderkey")
    r = tb(spark, d, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    w = o.join(r, "o_orderkey", "left_semi").withColumn("side", F.lit("with_return"))
    wo = o.join(r, "o_orderkey", "left_anti").withColumn("side", F.lit("without_return"))
    return w.unionByName(wo)


@register("j7_dimension_lookup", """
select c.c_custkey, n.n_name, r.r_name from customer c join nation n on c.c_nationkey = n.n_nationkey
join region r on n.n_regionkey = r.r_regionkey""")
def j7_dimension_lookup(spark, d):
    c = tb(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = tb(spark, d, "nation")
    r = tb(spark, d, "region")
    # nation (25 rows) and region (5 rows) are fixed-size dimensions: broadcast is bounded.
    # A key without its dimension row fails the job instead of dropping the fact.
    must = lambda key, name, what: F.when(key.isNotNull(), name).otherwise(F.raise_error(F.lit(f"unknown {what} key")).cast("string"))
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left") \
        .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey, "left") \
        .select("c_custkey", must(n.n_nationkey, n.n_name, "nation").alias("n_name"), must(r.r_regionkey, r.r_name, "region").alias("r_name"))


SQL_NORM = """regexp_replace(trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(text,
  'https?://\\S+', ' ', 'g'), '@(BRAND|USER)', ' ', 'g')), '\\s+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g')), '^ +| +$', '', 'g')"""


def docs_norm(spark, d):
    return tb(spark, d, "documents").withColumn("norm", T.normalize_for_dedup("text"))


@register("x4_normalize", f"""select doc_id, md5({SQL_NORM}) as norm_md5, length({SQL_NORM})::bigint as norm_len from documents""")
def x4_normalize(spark, d):
    return docs_norm(spark, d).select("doc_id", F.md5("norm").alias("norm_md5"),
                                      F.length("norm").cast("bigint").alias("norm_len"))


@register("j8_cluster_map_back", f"""
with n as (select doc_id, {SQL_NORM} as norm from documents),
c as (select norm, min(doc_id) as cluster from n group by norm)
select n.doc_id, c.cluster from n join c using (norm)""")
def j8_cluster_map_back(spark, d):
    n = docs_norm(spark, d).select("doc_id", "norm")
    c = n.groupBy("norm").agg(F.min("doc_id").alias("cluster"))
    return n.join(c, "norm").select("doc_id", "cluster")


@register("j9_reindex_default", """
select o.o_orderkey, coalesce(h.hit, false) as hit from orders o left join
 (select l_orderkey, bool_or(l_discount >= 0.1) as hit from lineitem group by 1) h on o.o_orderkey = h.l_orderkey""")
def j9_reindex_default(spark, d):
    o = tb(spark, d, "orders").select("o_orderkey")
    h = tb(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")) \
        .agg(F.bool_or(F.col("l_discount") >= 0.1).alias("hit"))
    return o.join(h, "o_orderkey", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("hit"))


@register("j12_rater_pairs", """
select a.doc_id, a.quality as rater_a, b.toxic as rater_b from labels a join labels b on a.doc_id = b.doc_id
where a.quality is not null and b.toxic is not null""")
def j12_rater_pairs(spark, d):
    lab = tb(spark, d, "labels")
    a = lab.filter(F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("rater_a"))
    b = lab.filter(F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").alias("rater_b"))
    return a.join(b, "doc_id", "inner")


# ---------------------------------------------------------------------------
# Aggregations
# ---------------------------------------------------------------------------
@register("a1_lang_counts", """
select lang, count(*)::bigint as n, round(count(*) / (select count(*) from documents), 6) as share from documents group by lang""")
def a1_lang_counts(spark, d):
    return A.value_counts(tb(spark, d, "documents"), "lang")


@register("a2_region_domain", """
select r.r_name, coalesce(x.n, 0)::bigint as n from region r left join (
  select n.n_regionkey, count(*) as n from customer c join nation n on c.c_nationkey = n.n_nationkey
  where c.c_acctbal < -900 group by 1) x on r.r_regionkey = x.n_regionkey""")
def a2_region_domain(spark, d):
    c = tb(spark, d, "customer").filter(F.col("c_acctbal") < -900)
    n = tb(spark, d, "nation")
    cr = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select("n_regionkey")
    out = A.domain_counts(cr, "n_regionkey", tb(spark, d, "region"), "r_regionkey")
    return out.select("r_name", "n")


@register("a3_lang_source_crosstab", "select lang, " + ", ".join(
    f"count(*) filter (where source = '{s}')::bigint as {s}" for s in SRC_DOMAIN[:15])
    + ", count(*) filter (where source is not null and source not in (" + ", ".join(f"'{s}'" for s in SRC_DOMAIN[:15])
    + "))::bigint as other, count(*) filter (where source is null)::bigint as none from documents group by lang")
def a3_lang_source_crosstab(spark, d):
    return A.crosstab(tb(spark, d, "documents"), "lang", "source", SRC_DOMAIN[:15])


@register("a6_distinct_counts", f"""
select count(distinct lang)::bigint as n_lang, count(distinct {SQL_NORM})::bigint as n_norm from documents""")
def a6_distinct_counts(spark, d):
    return docs_norm(spark, d).agg(F.countDistinct("lang").alias("n_lang"), F.countDistinct("norm").alias("n_norm"))


@register("a7_order_any", """
select l_orderkey, bool_or(l_returnflag = 'R') as any_return, count(*)::bigint as n from lineitem group by 1""")
def a7_order_any(spark, d):
    return A.any_per_group(tb(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", "any_return")


@register("a8_event_stats", """
select event_type, count(value)::bigint as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median,
  min(value) as min, max(value) as max,
  round(avg(case when value is not null then (value >= 40)::int::double end), 6) as share_hi,
  round(avg(case when value is not null then (value <= 5)::int::double end), 6) as share_lo
from events group by 1""")
def a8_event_stats(spark, d):
    return A.describe_by(tb(spark, d, "events"), "event_type", "value", 40.0, 5.0)


@register("a9_score_histogram", """
with s as (select least(5, greatest(1, ceil(p_size / 10)))::int as size_score,
                  least(5, greatest(1, ceil(p_retailprice / 400)))::int as price_score from part),
l as (select 'size_score' as dim, size_score as score from s union all select 'price_score', price_score from s)
select dim, count(*) filter (where score = 1)::bigint as s1, count(*) filter (where score = 2)::bigint as s2,
  count(*) filter (where score = 3)::bigint as s3, count(*) filter (where score = 4)::bigint as s4,
  count(*) filter (where score = 5)::bigint as s5, array_to_string(list_sort(list_distinct(list(score))), ',') as anchors_used
from l group by dim""")
def a9_score_histogram(spark, d):
    p = tb(spark, d, "part").select(
        F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(F.col("p_size") / 10))).cast("int").alias("size_score"),
        F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(F.col("p_retailprice") / 400))).cast("int").alias("price_score"))
    return A.score_histogram(p, ["size_score", "price_score"])


@register("a13_status_decomposition", """
select count(*) filter (where o_orderstatus = 'F')::bigint as fulfilled,
  count(*) filter (where o_orderstatus = 'O')::bigint as open,
  count(*) filter (where o_orderstatus not in ('F', 'O') and o_totalprice >= 100000)::bigint as large_partial,
  count(*) filter (where not (o_orderstatus in ('F', 'O') or o_totalprice >= 100000))::bigint as unassigned,
  count(*)::bigint as total from orders""")
def a13_status_decomposition(spark, d):
    st = F.col("o_orderstatus")
    return A.decomposition(tb(spark, d, "orders"), [
        ("fulfilled", st == "F"), ("open", st == "O"), ("large_partial", F.col("o_totalprice") >= 100000)])


@register("a14_cluster_sizes", f"""
select norm_md5, size, md5(example) as example_md5 from (
  select md5(norm) as norm_md5, count(*)::bigint as size, arg_min(text, doc_id) as example from
  (select doc_id, text, {SQL_NORM} as norm from documents) group by norm) order by size desc, norm_md5 limit 10""")
def a14_cluster_sizes(spark, d):
    n = docs_norm(spark, d).withColumn("norm_md5", F.md5("norm"))
    out = A.cluster_sizes(n, "norm_md5", "doc_id", "text", top=10)
    return out.select("norm_md5", "size", F.md5("example").alias("example_md5"))


@register("a15_row_min", """
select l_orderkey, l_linenumber, round(least(l_quantity, l_extendedprice / 1000, l_tax * 100), 6) as m from lineitem""")
def a15_row_min(spark, d):
    li = tb(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(A.row_min(
        F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_tax") * 100), 6).alias("m"))


@register("a16_uniqueness", """
select (select count(*) from (select doc_id from documents group by 1 having count(*) > 1))::bigint as dup_ids,
  count(*) filter (where text is null)::bigint as null_text,
  count(*) filter (where lang is null or lang = '')::bigint as blank_lang from documents""")
def a16_uniqueness(spark, d):
    docs = tb(spark, d, "documents")
    dup = docs.groupBy("doc_id").count().filter("count > 1").agg(F.count(F.lit(1))).scalar()
    v = A.violations(docs, [("null_text", F.col("text").isNull()),
                            ("blank_lang", F.col("lang").isNull() | (F.col("lang") == ""))])
    return v.select(dup.alias("dup_ids"), "null_text", "blank_lang")


@register("a17_null_counts", """
select count(*) filter (where l.quality is null)::bigint as null_quality, count(*) filter (where l.toxic is null)::bigint as null_toxic,
  count(*) filter (where coalesce(l.quality, l.toxic) is not null)::bigint as rows_with_any
from documents d left join labels l on d.doc_id = l.doc_id""")
def a17_null_counts(spark, d):
    j = j3_left_merge(spark, d).select(F.col("l_quality").alias("quality"), F.col("l_toxic").alias("toxic"))
    return A.null_counts(j, ["quality", "toxic"])


# ---------------------------------------------------------------------------
# Sampling (md5 hash order; identical in both engines)
# ---------------------------------------------------------------------------
def ORD(seed, col):
    return f"md5('{seed}:' || {col}::varchar)"


@register("w1_sample_docs", f"""select doc_id, lang from documents order by {ORD(0, 'doc_id')}, doc_id limit 50""")
def w1_sample_docs(spark, d):
    return W.sample_n(tb(spark, d, "documents").select("doc_id", "lang"), "doc_id", 50, 0)


@register("w2_per_lang", f"""
select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by {ORD(0, 'doc_id')}, doc_id) rn
 from documents) where rn <= 3""")
def w2_per_lang(spark, d):
    return W.per_stratum(tb(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 3, 0)


@register("w3_cluster_cap", f"""
select doc_id from (select doc_id, row_number() over (partition by norm order by {ORD(0, 'doc_id')}, doc_id) rn
 from (select doc_id, {SQL_NORM} as norm from documents)) where rn <= 2""")
def w3_cluster_cap(spark, d):
    return W.cap_per_cluster(docs_norm(spark, d).select("doc_id", "norm"), "norm", "doc_id", 2, 0).select("doc_id")


@register("w3_cap_report", f"""
select before, after, round(100.0 * (1 - after / before), 6) as pct_removed from (
select count(*)::bigint as before, (select count(*) from (select row_number() over (partition by {SQL_NORM} order by {ORD(0, 'doc_id')}, doc_id) rn
  from documents) where rn <= 2)::bigint as after from documents)""")
def w3_cap_report(spark, d):
    n = docs_norm(spark, d).select("doc_id", "norm")
    return W.cap_report(n, W.cap_per_cluster(n, "norm", "doc_id", 2, 0))


@register("w4_dual_cap", f"""
with o as (select doc_id, lang = 'fr' as tag, {ORD(0, 'doc_id')} as ord, {SQL_NORM} as norm from documents),
c as (select * from (select *, row_number() over (partition by norm order by ord, doc_id) crn from o) where crn <= 15),
t as (select * from c where tag order by ord, doc_id limit 15)
select doc_id from (select doc_id, ord from t union all select doc_id, ord from c where not tag) order by ord, doc_id limit 100""")
def w4_dual_cap(spark, d):
    n = docs_norm(spark, d).select("doc_id", "lang", "norm")
    return W.dual_cap(n, "doc_id", "norm", F.col("lang") == "fr", 100, 0.15, 0).select("doc_id")


SQL_LABELED = "(select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic from documents d join labels l on d.doc_id = l.doc_id)"


@register("w5_quota_draw", f"""
with o as (select doc_id, toxic = 1 as f, {ORD(0, 'doc_id')} as ord from {SQL_LABELED} x),
fk as (select doc_id from o where f order by ord, doc_id limit 5),
ck as (select doc_id, row_number() over (order by ord, doc_id) rn from o where not f)
select doc_id from fk union all select doc_id from ck where rn <= 50 - (select count(*) from fk)""")
def w5_quota_draw(spark, d):
    x = tb(spark, d, "documents").join(tb(spark, d, "labels"), "doc_id")
    return W.quota_draw(x, "doc_id", F.col("toxic") == 1, 50, 5, 0).select("doc_id")


STRATA = [("en", 20, 3), ("fr", 10, 2), ("de", 10, None), ("es", 5, 1)]


@register("w6_assemble_strata", f"""
with o as (select doc_id, lang, n_chars > 5000 as f, {ORD(0, 'doc_id')} as ord from documents),
q as (select * from (values {', '.join(f"('{s}', {n}, {n if m is None else m})" for s, n, m in STRATA)}) q(s, qn, qm)),
r as (select o.*, q.qn, q.qm, row_number() over (partition by lang, f order by ord, doc_id) rn from o join q on o.lang = q.s),
fk as (select * from r where f and rn <= least(qm, qn)),
nb as (select lang, count(*) nb from fk group by 1)
select doc_id, lang from fk union all
select r.doc_id, r.lang from r left join nb using (lang) where not r.f and r.rn <= r.qn - coalesce(nb.nb, 0)""")
def w6_assemble_strata(spark, d):
    docs = tb(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return W.assemble_strata(docs, "lang", "doc_id", F.col("n_chars") > 5000, STRATA, 0).select("doc_id", "lang")


@register("w7_balanced_overdraw", f"""
select doc_id, source from (select doc_id, source, row_number() over (partition by source order by {ORD(0, 'doc_id')}, doc_id) rn
 from documents) where rn <= greatest(1, 60 // (select count(distinct source) from documents)) order by {ORD(0, 'doc_id')}, doc_id limit 60""")
def w7_balanced_overdraw(spark, d):
    docs = tb(spark, d, "documents").select("doc_id", "source")
    n_kinds = docs.select("source").distinct().count()   # one scalar: the quota per kind
    return W.balanced_overdraw(docs, "source", "doc_id", 60, n_kinds=n_kinds, seed=0)


@register("w8_proportional", f"""
with s as (select lang, greatest(1, round_even(40.0 * count(*) / (select count(*) from documents), 0))::int as q from documents group by 1)
select doc_id, lang from (select d.doc_id, d.lang, s.q, row_number() over (partition by d.lang order by {ORD(0, 'd.doc_id')}, d.doc_id) rn
 from documents d join s using (lang)) where rn <= q""")
def w8_proportional(spark, d):
    return W.proportional(tb(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 40, 0)


SQL_HARD = f"""(with x as {SQL_LABELED},
h as (select doc_id, lang, 'hard' as sample_type from x where toxic = 1 or quality = 0 order by {ORD(0, 'doc_id')}, doc_id limit 12),
rest as (select * from x where doc_id not in (select doc_id from h)),
s as (select lang, greatest(1, round_even(24.0 * count(*) / (select count(*) from rest), 0))::int as q from rest group by 1),
r as (select doc_id, lang, 'random' as sample_type from (select rest.doc_id, rest.lang, s.q,
  row_number() over (partition by rest.lang order by {ORD(0, 'rest.doc_id')}, rest.doc_id) rn from rest join s using (lang)) where rn <= q)
select * from r union all select * from h)"""


@register("w9_hard_case_set", f"select doc_id, lang, sample_type from {SQL_HARD} z")
def w9_hard_case_set(spark, d):
    x = tb(spark, d, "documents").join(tb(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")
    out = W.hard_case_set(x, "doc_id", (F.col("toxic") == 1) | (F.col("quality") == 0), "lang", 12, 24, 0)
    return out.select("doc_id", "lang", "sample_type")


@register("w11_blind_sheet", f"select doc_id, sample_type, lang, '' as h_quality, '' as h_toxic, '' as h_notes from {SQL_HARD} z")
def w11_blind_sheet(spark, d):
    return W.blind_sheet(w9_hard_case_set(spark, d), ["doc_id", "sample_type", "lang"],
                         ["h_quality", "h_toxic", "h_notes"])


@register("w10_hard_easy_mix", """
with o as (select doc_id, lang, n_chars > 10000 as h from documents),
q as (select * from (values ('en', 4), ('fr', 4), ('de', 2), ('es', 2)) q(lang, n)),
hard as (select * from (select o.doc_id, o.lang, q.n, row_number() over (partition by o.lang order by doc_id) rn
  from o join q using (lang) where h) where rn <= 2 and rn <= n),
nh as (select lang, count(*) nh from hard group by 1),
easy as (select * from (select o.doc_id, o.lang, q.n, row_number() over (partition by o.lang order by doc_id) rn
  from o join q using (lang) where not h) e left join nh using (lang) where rn <= n - coalesce(nh, 0))
select doc_id, lang from hard union all select doc_id, lang from easy""")
def w10_hard_easy_mix(spark, d):
    docs = tb(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return W.hard_easy_mix(docs, "lang", "doc_id", F.col("n_chars") > 10000,
                           {"en": 4, "fr": 4, "de": 2, "es": 2}).select("doc_id", "lang")


@register("w12_latest_event", """
select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn
 from events) where rn = 1""")
def w12_latest_event(spark, d):
    ev = tb(spark, d, "events")
    return W.latest_per_key(ev, "user_id", [F.col("ts").desc(), F.col("event_id").desc()]) \
        .select("user_id", "event_id", "event_type")


@register("w13_exact_dedup", f"""
select doc_id from (select doc_id, row_number() over (partition by {SQL_NORM} order by doc_id) rn from documents) where rn = 1""")
def w13_exact_dedup(spark, d):
    return W.dedup_first(docs_norm(spark, d).select("doc_id", "norm"), "norm", "doc_id").select("doc_id")


@register("w14_accepted", """select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)""")
def w14_accepted(spark, d):
    hc = tb(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("accepted"))
    return W.accepted(tb(spark, d, "documents").select("doc_id", "lang"), hc, "doc_id")


# ---------------------------------------------------------------------------
# Sorts, limits, set operations
# ---------------------------------------------------------------------------
@register("t1_top_sources", """select source, count(*)::bigint as n from documents group by 1 order by n desc, source limit 5""")
def t1_top_sources(spark, d):
    return tb(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), "source").limit(5)


@register("t6_majority_class", """select lang, count(*)::bigint as n from documents group by 1 order by n desc, lang limit 1""")
def t6_majority_class(spark, d):
    return tb(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), "lang").limit(1)


@register("t7_best_examples", """select event_id, value from events order by value desc, event_id limit 5""")
def t7_best_examples(spark, d):
    return tb(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(5)


@register("t8_partial_run", """select doc_id from documents where lang = 'de' order by doc_id limit 25""")
def t8_partial_run(spark, d):
    return tb(spark, d, "documents").filter(F.col("lang") == "de").select("doc_id").orderBy("doc_id").limit(25)


@register("u1_union_strata", f"""
select doc_id, lang, null::varchar as source from (select doc_id, lang, row_number() over (partition by lang order by {ORD(1, 'doc_id')}, doc_id) rn from documents) where rn <= 2
union all
select doc_id, null::varchar as lang, source from (select doc_id, source, row_number() over (partition by source order by {ORD(2, 'doc_id')}, doc_id) rn from documents) where rn <= 1""")
def u1_union_strata(spark, d):
    docs = tb(spark, d, "documents")
    a = W.per_stratum(docs.select("doc_id", "lang"), "lang", "doc_id", 2, 1)
    b = W.per_stratum(docs.select("doc_id", "source"), "source", "doc_id", 1, 2)
    return a.unionByName(b, allowMissingColumns=True).select("doc_id", "lang", "source")


@register("u2_except_ids", """select doc_id from documents except all select doc_id from labels""")
def u2_except_ids(spark, d):
    return tb(spark, d, "documents").select("doc_id").exceptAll(tb(spark, d, "labels").select("doc_id"))


# ---------------------------------------------------------------------------
# Plain text functions
# ---------------------------------------------------------------------------
SQL_USERIZE = "regexp_replace(text, '@[\\p{L}\\p{N}_]+', '@USER', 'g')"


@register("x1_anonymize", f"""
select doc_id, md5({strip(collapse(SQL_USERIZE))}) as anon_md5,
  len(regexp_extract_all({strip(collapse(SQL_USERIZE))}, '@USER'))::bigint as n_user
from documents""")
def x1_anonymize(spark, d):
    docs = tb(spark, d, "documents")
    a = T.anonymize("text")
    return docs.select("doc_id", F.md5(a).alias("anon_md5"),
                       F.regexp_count(a, F.lit("@USER")).cast("bigint").alias("n_user"))


@register("x1_anonymize_all", f"""
select doc_id, md5({strip(collapse(SQL_USERIZE))}) as anon_md5,
  len(regexp_extract_all({strip(collapse(SQL_USERIZE))}, '@USER'))::bigint as n_user
from documents""")
def x1_anonymize_all(spark, d):
    a = T.anonymize("text")
    return tb(spark, d, "documents").select("doc_id", F.md5(a).alias("anon_md5"),
                                            F.regexp_count(a, F.lit("@USER")).cast("bigint").alias("n_user"))


@register("x3_foreign_links", f"""
select count(*) filter (where len(list_filter(regexp_extract_all(url, 'https?://\\S+'), lambda x: not list_contains({arr(P.DM_LINKS)}, x))) > 0)::bigint as n_foreign,
  count(*)::bigint as n from pages""")
def x3_foreign_links(spark, d):
    p = tb(spark, d, "pages")
    return p.agg(F.count_if(T.has_foreign_link("url")).alias("n_foreign"), F.count(F.lit(1)).alias("n"))


@register("x5_real_words", f"""
select doc_id, len(list_filter(regexp_extract_all({rreplace('text', P.STRIP_TOKENS, ' ', ci=False).replace("'(", "'(", 1)}, '[A-Za-z'']+'), lambda w: length(w) > 1))::bigint as real_words
from documents""")
def x5_real_words(spark, d):
    return tb(spark, d, "documents").select("doc_id", T.real_words("text").cast("bigint").alias("real_words"))


@register("x6_thin_by_role", f"""
select role, count(*) filter (where len(list_filter(regexp_extract_all({rreplace('text', P.STRIP_TOKENS, ' ', ci=False)}, '[A-Za-z'']+'), lambda w: length(w) > 1)) <= 6)::bigint as thin,
  count(*)::bigint as n from conversations group by role""")
def x6_thin_by_role(spark, d):
    c = tb(spark, d, "conversations")
    return c.groupBy("role").agg(F.count_if(T.is_thin("text")).alias("thin"), F.count(F.lit(1)).alias("n"))


SQL_TOKENS = ("list_transform(list_filter(regexp_extract_all(" + rreplace("translate(text, '‘’ʼ`', '''''''''')", P.STRIP_TOKENS, " ", ci=False)
              + ", '[A-Za-z'']+'), lambda w: length(w) > 1), lambda w: replace(lower(w), '''', ''))")


@register("x7_tokens", f"""select doc_id, len({SQL_TOKENS})::bigint as n_tokens, md5(array_to_string({SQL_TOKENS}, ' ')) as tokens_md5 from documents""")
def x7_tokens(spark, d):
    t = T.word_tokens("text")
    return tb(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"),
                                            F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@register("x8_strip_urls", f"""
select page_id, {strip(rreplace('url', P.URL_OR_SHORT, P.LINK_MARKER))} as stripped,
  {rmatch('url', P.URL_OR_SHORT, folded=False)} as has_link from pages""")
def x8_strip_urls(spark, d):
    p = tb(spark, d, "pages")
    return p.select("page_id", T.strip_urls("url").alias("stripped"), T.has_link("url").alias("has_link"))


@register("x10_length_guard", f"""
select doc_id, array_to_string(list_filter([case when length(text) > 280 then 'over_length:' || length(text)::varchar end,
  case when {rmatch('text', P.NARRATION)} then 'narration' end], lambda x: x is not null), ',') as flags from documents""")
def x10_length_guard(spark, d):
    return tb(spark, d, "documents").select("doc_id", F.array_join(T.quality_flags("text"), ",").alias("flags"))


@register("x11_residual_words", f"""
select doc_id, {rcount(rreplace(fold('text'), P.GENERIC, ''), r'\w+', ci=False, folded=False)}::bigint as residual_words from documents""")
def x11_residual_words(spark, d):
    return tb(spark, d, "documents").select("doc_id", T.residual_word_count("text").cast("bigint").alias("residual_words"))


DOC_TERMS = ["MIT License", "Apache", "SPDX", "Copyright", "password", "token", "secret"]


@register("x12_term_hits", f"""
select doc_id, array_to_string(list_filter({arr(DOC_TERMS)}, lambda t: contains(lower(text), lower(t))), '|') as hits
from documents where len(list_filter({arr(DOC_TERMS)}, lambda t: contains(lower(text), lower(t)))) > 0""")
def x12_term_hits(spark, d):
    h = T.term_hits("text", DOC_TERMS)
    return tb(spark, d, "documents").select("doc_id", h.alias("h")).filter(F.size("h") > 0) \
        .select("doc_id", F.array_join("h", "|").alias("hits"))


PARSE_CLASSES = [f"src{i}" for i in range(20)]


@register("x14_parse_label", f"""
select doc_id, list_filter({arr(PARSE_CLASSES)}, lambda k: contains(lower(regexp_replace(' label: ' || source || '. ', '^[.`"''\\s]+|[.`"''\\s]+$', '', 'g')), k))[1] as parsed
from documents""")
def x14_parse_label(spark, d):
    raw = F.concat(F.lit(" label: "), F.col("source"), F.lit(". "))
    return tb(spark, d, "documents").select("doc_id", T.parse_label(raw, PARSE_CLASSES).alias("parsed"))


@register("x15_lenient_props", """
select event_id, case when round_even(try_cast(json_extract_string(props, '$.k') as double), 0) between 1 and 5
  then round_even(try_cast(json_extract_string(props, '$.k') as double), 0)::int end as k_score from events""")
def x15_lenient_props(spark, d):
    return tb(spark, d, "events").select("event_id", T.lenient_scores("props", ["k"])["k"].alias("k_score"))


@register("s3_try_cast", """
select event_id, try_cast(json_extract_string(props, '$.k') as int) as k, try_cast(event_type as int) as type_num from events""")
def s3_try_cast(spark, d):
    ev = tb(spark, d, "events")
    k = F.from_json("props", "k string")["k"]
    return ev.select("event_id", T.lenient_int(k).alias("k"), T.lenient_int(F.col("event_type")).alias("type_num"))


@register("x16_reason_format", """
select event_id, 'grounded:event=' || event_id::varchar || ',gated_score=' || printf('%.2f', value) as reason from events""")
def x16_reason_format(spark, d):
    ev = tb(spark, d, "events")
    return ev.select("event_id", F.concat(F.lit("grounded:event="), F.col("event_id").cast("string"),
                                          F.lit(",gated_score="), T.fmt2("value")).alias("reason"))


@register("x17_prompt_assembly", f"""
select conv_id, q_turn, md5(concat_ws(chr(10), 'customer: ' || customer_text, 'reference reply: ' || brand_text)) as prompt_md5
from {SQL_PAIRS} p""")
def x17_prompt_assembly(spark, d):
    p = TH.adjacent_pairs(tb(spark, d, "conversations"))
    return p.select("conv_id", "q_turn", F.md5(T.assemble(("customer", F.col("customer_text")),
                                                          ("reference reply", F.col("brand_text")))).alias("prompt_md5"))


@register("x19_status_share", """
select o_orderstatus, round(count(*) / (select count(*) from orders), 6) as share,
  round(100.0 * (count(*) / (select count(*) from orders) - 1.0 / 3), 6) as delta_pp from orders group by 1""")
def x19_status_share(spark, d):
    o = tb(spark, d, "orders")
    tot = o.agg(F.count(F.lit(1))).scalar()
    g = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return g.select("o_orderstatus", F.round(F.col("n") / tot, 6).alias("share"),
                    F.round(100.0 * (F.col("n") / tot - F.lit(1.0) / 3), 6).alias("delta_pp"))


@register("x21_strip_accents", """select doc_id, md5(strip_accents(text)) as folded_md5 from documents""")
def x21_strip_accents(spark, d):
    return tb(spark, d, "documents").select("doc_id", F.md5(T.strip_accents("text")).alias("folded_md5"))
