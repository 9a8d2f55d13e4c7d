"""X12 with a table of terms: which terms each text contains, at a cost that does not grow with
terms times texts.

A term is cut at white space. Where it has three pieces or more, the inner ones stand in a
text only as whole words, so its longest inner piece is its anchor, and the anchor is joined
with the words of the corpus by equality. A term of one or two pieces may start or end inside
a word: its longest piece is looked for inside the distinct words of the corpus, found by an
equi-join on the piece's first letters. Words that hold an anchor lead to their texts, and only
those (text, term) pairs are compared in full.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep, spread

#: Letters of a piece by which it is looked up inside words; shorter pieces use all they have.
GRAM = 4
SPACE = r"\s+"


def _pieces(c):
    return F.filter(F.split(F.lower(c), SPACE), lambda w: F.length(w) > 0)


def _longest(pieces):
    """The longest piece; of several, the first in string order."""
    return F.array_min(F.transform(pieces, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))["w"]


def anchors(terms: DataFrame, term_no: str, term: str) -> DataFrame:
    """(term_no, term, anchor, whole): the lower-cased terms that hold a letter. ``whole``: the
    anchor stands in texts as a whole word only."""
    p = F.col("_p")
    return terms.select(F.col(term_no).alias("term_no"), F.col(term).alias("term"), _pieces(F.col(term)).alias("_p")) \
        .filter(F.size(p) > 0).select(
            "term_no", "term", (F.size(p) >= 3).alias("whole"),
            F.when(F.size(p) >= 3, _longest(F.slice(p, 2, F.size(p) - 2))).otherwise(_longest(p)).alias("anchor"))


def _words_of_anchors(words: DataFrame, found: DataFrame) -> DataFrame:
    """(anchor, whole, word): the words of the corpus that an anchor leads to."""
    whole = found.filter("whole").select("anchor").distinct()
    part = found.filter(~F.col("whole")).select("anchor", F.substring("anchor", 1, GRAM).alias("gram")).distinct()
    sizes = sorted(r[0] for r in part.select(F.length("gram")).distinct().collect())  # GRAM values at most
    out = whole.join(words, F.col("anchor") == F.col("word")).select("anchor", F.lit(True).alias("whole"), "word")
    for n in sizes:
        starts = F.sequence(F.lit(1), F.length("word") - n + 1)
        grams = words.filter(F.length("word") >= n).select(
            "word", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("word"), i, F.lit(n))))).alias("gram"))
        held = grams.join(part.filter(F.length("gram") == n), "gram").filter(F.contains("word", "anchor"))
        out = out.unionByName(held.select("anchor", F.lit(False).alias("whole"), "word"))
    return out


def term_hits(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, term_no: str, term: str) -> DataFrame:
    """(id, hits): for every id with a hit the terms that its text contains whatever the case,
    in the order of ``term_no``, as they are spelled in the table.

    Null texts and ids, null terms and terms of white space alone have no hit. An id that
    several rows share has the hits of all of them, each once; a term listed under several
    numbers is reported under each. Other columns of either table are not read."""
    rows = texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_id is not null and _text is not null")
    found = keep(anchors(terms, term_no, term))
    spoken = keep(spread(rows).select("_id", F.explode(F.array_distinct(_pieces(F.col("_text")))).alias("word")))
    leads = keep(_words_of_anchors(spoken.select("word").distinct(), found))
    reached = spoken.join(leads, "word").select("_id", "anchor", "whole").distinct()
    pairs = reached.join(found, ["anchor", "whole"]).select("_id", "term_no", "term")
    hits = pairs.join(rows, "_id").filter(F.contains(F.lower("_text"), F.lower("term"))).select("_id", "term_no", "term").distinct()
    return hits.groupBy(F.col("_id").alias(id_col)).agg(
        F.array_sort(F.collect_list(F.struct("term_no", "term"))).alias("_h")).select(id_col, F.col("_h.term").alias("hits"))
