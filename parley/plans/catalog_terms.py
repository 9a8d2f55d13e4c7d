"""Exact dual cap (W4) and term hits from a table of terms (X12), bound to the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as W
from ..operators import term_table as TT
from .catalog import DOC_TERMS, ORD, register, tb

W4_N, W4_SHARE = 100, 0.15
W4_CAP = int(W4_N * W4_SHARE)


@register("w4_dual_cap_exact", f"""
with recursive o as (select doc_id, lang = 'fr' as tag, coalesce(source, '') as c,
  row_number() over (order by {ORD(0, 'doc_id')}, doc_id) as i from documents),
walk(i, ids, cs, tags) as (
  select 0::bigint, []::bigint[], []::varchar[], 0::bigint
  union all
  select o.i, case when ok then list_append(ids, o.doc_id) else ids end,
    case when ok then list_append(cs, o.c) else cs end, tags + (ok and o.tag)::bigint
  from (select w.ids, w.cs, w.tags, o.i, o.doc_id, o.c, coalesce(o.tag, false) as tag,
      not (coalesce(o.tag, false) and w.tags >= {W4_CAP}) and len(list_filter(w.cs, lambda x: x = o.c)) < {W4_CAP} as ok
    from walk w join o on o.i = w.i + 1 where len(w.ids) < {W4_N}) o)
select unnest(ids) as doc_id from (select ids from walk order by i desc limit 1)""")
def w4_dual_cap_exact(spark, d):
    """The walk over all documents: clusters are sources, French documents are tagged."""
    docs = tb(spark, d, "documents").select("doc_id", "lang", F.coalesce("source", F.lit("")).alias("source"))
    return W.dual_cap_exact(docs, "doc_id", "source", F.col("lang") == "fr", W4_N, W4_SHARE, 0).select("doc_id")


SQL_TERMS = f"""(select item_id * 1000 + pos as term_no, term from (
  select item_id, unnest(ts) as term, generate_subscripts(ts, 1) as pos from (
    select item_id, string_split(replace(text, chr(10), ' '), '.') as ts from benchmark))
  where trim(term) <> '' union all
  select -{len(DOC_TERMS)} + i, t from (values {', '.join(f"({i}, '{t}')" for i, t in enumerate(DOC_TERMS))}) v(i, t))"""


@register("x12_term_table", f"""
select doc_id, count(*)::bigint as n_hits, md5(string_agg(trim(term), '|' order by term_no)) as hits_md5
from documents d join {SQL_TERMS} t on contains(lower(d.text), lower(trim(t.term))) group by doc_id""")
def x12_term_table(spark, d):
    """Sentences of all benchmark items and a few short terms, in all documents."""
    at = F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\.")).alias("pos", "term")
    terms = tb(spark, d, "benchmark").select("item_id", at).select(
        (F.col("item_id") * 1000 + F.col("pos") + 1).alias("term_no"), F.trim("term").alias("term")).filter("term <> ''")
    few = spark.createDataFrame([(i - len(DOC_TERMS), t) for i, t in enumerate(DOC_TERMS)], "term_no long, term string")
    hits = TT.term_hits(tb(spark, d, "documents"), terms.unionByName(few), "doc_id", "text", "term_no", "term")
    return hits.select("doc_id", F.size("hits").cast("long").alias("n_hits"), F.md5(F.array_join("hits", "|")).alias("hits_md5"))
