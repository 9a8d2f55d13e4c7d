"""One query per operator. Each applies its operator, with production parameters, to its
whole table; ``SQL`` holds the DuckDB form where SQL can express the result.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_prefix, chat, circulant, ecoc, importance, line_chunks, maxscore, periodic_runs, prefix_doubling,
               recompression, source_mix, target_resampling, templates)

TOKENIZERS = os.environ.get("PARLEY_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    return recompression.repeated_passages(table(spark, sf_dir, "documents"), digest=True)


def op2_exact_topk(spark, sf_dir):
    v = maxscore.integer_vectors(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(v.filter(F.col("vec_id") % 20 == 0), v)


def op3_line_dedup(spark, sf_dir):
    out = line_chunks.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_suffix_array_dedup(spark, sf_dir):
    return prefix_doubling.repeated_spans(table(spark, sf_dir, "documents"), digest=True)


def op5_quality_classifier(spark, sf_dir):
    return importance.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark, sf_dir):
    return circulant.near_duplicates(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digest(turns.unionByName(probe))


def op8_language_id(spark, sf_dir):
    return ecoc.identify(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark, sf_dir):
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bpe_codec(spark, sf_dir):
    return bpe_prefix.encode_decode(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", digest=True)


def op11_importance_resampling(spark, sf_dir):
    return target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.run_digest(table(spark, sf_dir, "documents"), plant=True)


def op13_source_mix(spark, sf_dir):
    return source_mix.mix_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_exact_topk, op3_line_dedup, op4_suffix_array_dedup, op5_quality_classifier,
    op6_minhash_near_dedup, op7_chat_formatting, op8_language_id, op9_benchmark_decontamination, op10_bpe_codec,
    op11_importance_resampling, op12_periodic_runs, op13_source_mix,
)}

SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
h AS (
  SELECT doc_id, pos, word, md5(string_agg(word, ' ') OVER f) AS h, count(*) OVER f AS c
  FROM u WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT h FROM h WHERE c = 35 GROUP BY h HAVING count(*) > 1),
m AS (SELECT h.doc_id, pos, word, (c = 35 AND r.h IS NOT NULL)::INTEGER AS starts FROM h LEFT JOIN r ON h.h = r.h),
x AS (
  SELECT doc_id, pos, word, max(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (
  SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM x GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op4_suffix_array_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
u AS (SELECT doc_id, unnest(b) AS b, generate_subscripts(b, 1) AS pos FROM d),
h AS (
  SELECT doc_id, pos, b, string_agg(b, '') OVER f AS h, count(*) OVER f AS c
  FROM u WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
r AS (SELECT h, min(doc_id) AS first FROM h WHERE c = 50 GROUP BY h HAVING min(doc_id) < max(doc_id)),
m AS (SELECT h.doc_id, pos, b, coalesce(c = 50 AND r.first < h.doc_id, false)::INTEGER AS starts FROM h LEFT JOIN r ON h.h = r.h),
x AS (
  SELECT doc_id, pos, b, max(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
y AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 AS opens FROM x),
k AS (
  SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (opens) AS n_spans,
         string_agg(b, '' ORDER BY pos) FILTER (gone = 0) AS kept FROM y GROUP BY doc_id)
SELECT d.doc_id, len(d.b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op6_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, len(w) AS words, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
g AS (
  SELECT doc_id, words, pos, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS c
  FROM u WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
sh AS (SELECT DISTINCT doc_id, s FROM g WHERE c = 5 OR (words < 5 AND pos = 1)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk(node, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT walk.node, e.b FROM walk JOIN e ON walk.reached = e.a),
c AS (SELECT node, min(reached) AS component_id FROM walk GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON c.node = d.doc_id""",
    "op2_exact_topk": """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum([x[1] * x[2] FOR x IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 20""",
    "op7_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER w AS rn, lag(coalesce(role, '')) OVER w AS prev
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
e AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_chars,
         length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length('<|im_start|>') + length('<|im_sep|>') AS open_chars,
         length('<|im_end|>') + 1 AS end_chars FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY rn), '')) AS loss_sha256,
  (sum(text_chars + CASE WHEN rn = 1 THEN open_chars WHEN prev = role THEN length('<|im_sep|>')
                         ELSE end_chars + open_chars END) + max(end_chars))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op11_importance_resampling": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (
  SELECT doc_id, false AS target, unnest(flatten([w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
                         list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])])) AS g FROM d
  UNION ALL
  SELECT NULL, true, unnest(flatten([w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
                         list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])])) FROM e),
c AS (SELECT doc_id, target, g, count(*) AS n FROM f GROUP BY ALL),
b AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(encode(g)), '..'),
      lambda x: [('0x' || x[2])::BIGINT, ('0x' || x[1])::BIGINT]))), lambda c, n: xor(c >> 4, [0, 498536548, 997073096, 651767980,
      1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012,
      2685067896, 3183342108][(xor(c, n) & 15) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT g FROM c)),
k AS (SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target), 0)::DOUBLE AS t FROM c JOIN b USING (g) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM k) + 10000) / ((s + 1) * ((SELECT sum(t) FROM k) + 10000))))::BIGINT AS gain FROM k),
w AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM c JOIN b USING (g) JOIN gain USING (bucket) WHERE NOT target GROUP BY doc_id),
x AS (
  SELECT doc_id, len(w) AS words, (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features,
         coalesce(weight, 0) AS weight, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN w USING (doc_id)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE words >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN r.rank <= 5 * n // 100 THEN r.rank END AS rank
FROM y LEFT JOIN r ON r.doc_id = y.doc_id""",
    "op12_periodic_runs": r"""
WITH t AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'),
      lambda x: [('0x' || x[2])::BIGINT, ('0x' || x[1])::BIGINT]))), lambda c, n: xor(c >> 4, [0, 498536548, 997073096, 651767980,
      1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012,
      2685067896, 3183342108][(xor(c, n) & 15) + 1])), 4294967295) AS h
  FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w
    ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS w FROM p),
u AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
s AS (
  SELECT doc_id, q AS period, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (
  SELECT * FROM s WHERE NOT EXISTS (
    SELECT 1 FROM s z WHERE z.doc_id = s.doc_id AND z.period < s.period AND z.start <= s.start AND z.start + z.length >= s.start + s.length)),
b AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
    first({'s': start, 'l': length, 'p': period} ORDER BY (length::DECIMAL(38,0) * 1000000000000) // period DESC, start, period) AS best
  FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.i = u.i
      WHERE gone.i IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
  (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
}
