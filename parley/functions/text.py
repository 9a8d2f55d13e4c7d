"""Text functions (X1-X21) as Catalyst Column expressions.

Every function takes and returns ``Column`` so it composes into one projection and stays
inside the JVM: no Python runs per row.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _alt(words: Iterable[str]) -> str:
    """Regex alternation of literal words."""
    import re
    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)


def py_strip(c) -> Column:
    """Strip leading/trailing whitespace of any kind (``str.strip``; ``F.trim`` only
    removes the space character)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def collapse_spaces(c) -> Column:
    """Runs of two or more whitespace characters become one space."""
    return F.regexp_replace(_c(c), r"(?U)\s{2,}", " ")


# X1 ---------------------------------------------------------------------------
def anonymize(c, brand_alias=None, brand_handles: Iterable[str] = ()) -> Column:
    """Brand handle or the brand's numeric alias becomes ``@BRAND``, any other mention
    ``@USER``; whitespace runs collapse; the result is stripped.

    ``brand_alias`` may be a literal or a Column (an alias derived per brand)."""
    c = _c(c)
    handles = list(brand_handles)
    sentinel = "\u0001"
    if handles:
        c = F.regexp_replace(c, r"(?U)@(?:" + _alt(handles) + r")(?!\w)", "@" + sentinel)
    if brand_alias is not None:
        alias = brand_alias if isinstance(brand_alias, Column) else F.lit(str(brand_alias))
        pat = F.concat(F.lit(r"(?U)@\Q"), alias, F.lit(r"\E(?!\w)"))
        c = F.when(alias.isNull(), c).otherwise(F.regexp_replace(c, pat, F.lit("@" + sentinel)))
    c = F.regexp_replace(c, r"(?U)@\w+", "@USER")
    c = F.regexp_replace(c, "@" + sentinel, "@BRAND")
    return py_strip(collapse_spaces(c))


# X2 ---------------------------------------------------------------------------
def _dm_link_pattern() -> str:
    # A DM link counts only when the whole https?://\S+ match equals it.
    return "(?:" + _alt(P.DM_LINKS) + r")(?!\S)"


def strip_dm_links(c) -> Column:
    """Remove the allow-listed boilerplate links, collapse whitespace, strip."""
    return py_strip(collapse_spaces(F.regexp_replace(_c(c), _dm_link_pattern(), "")))


def links(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(P.LINK), 0)


# X3 ---------------------------------------------------------------------------
def has_foreign_link(c, allow: Iterable[str] = tuple(P.DM_LINKS)) -> Column:
    """Any link that is not in the allow-list."""
    allow_arr = F.array(*[F.lit(a) for a in allow]) if allow else F.array().cast("array<string>")
    return F.exists(links(c), lambda u: ~F.array_contains(allow_arr, u))


# X4 ---------------------------------------------------------------------------
def normalize_for_dedup(c) -> Column:
    """Drop URLs and placeholders, lower, collapse whitespace, non ``[a-z0-9 ]`` to a
    space, strip. Whitespace collapses before punctuation becomes spaces, so double
    spaces can remain inside (kept deliberately)."""
    s = F.regexp_replace(_c(c), P.LINK, " ")
    s = F.regexp_replace(s, "@(BRAND|USER)", " ")
    # one pass for both: a run of whitespace that is not one plain space already, or of neither
    return F.trim(F.regexp_replace(F.lower(s), r"(?U) \s+|[\s&&[^ ]]\s*|[^a-z0-9\s]+", " "))


# X5 / X6 -------------------------------------------------------------------------
def _strip_placeholders(c) -> Column:
    return F.regexp_replace(_c(c), P.uni(P.STRIP_TOKENS), " ")


def real_words(c) -> Column:
    """Count of ``[A-Za-z']+`` words longer than one character once URLs, placeholders
    and hashtags are removed."""
    words = F.regexp_extract_all(_strip_placeholders(c), F.lit(P.REAL_WORD), 0)
    return F.size(F.filter(words, lambda w: F.length(w) > 1))


def is_thin(c, max_words: int = P.THIN_MAX_WORDS) -> Column:
    return real_words(c) <= F.lit(max_words)


# X7 ---------------------------------------------------------------------------
def word_tokens(c) -> Column:
    """Lower-cased words with apostrophes removed; curly apostrophes fold to ``'``
    first and the length-above-one test runs before the apostrophe is dropped."""
    folded = F.translate(_c(c), P.CURLY_APOSTROPHES, "'" * len(P.CURLY_APOSTROPHES))
    words = F.regexp_extract_all(_strip_placeholders(folded), F.lit(P.REAL_WORD), 0)
    return F.transform(F.filter(words, lambda w: F.length(w) > 1),
                       lambda w: F.regexp_replace(F.lower(w), "'", ""))


# X8 ---------------------------------------------------------------------------
def strip_urls(c) -> Column:
    return py_strip(F.regexp_replace(_c(c), "(?i)" + P.URL_OR_SHORT, P.LINK_MARKER))


def has_link(c) -> Column:
    return F.coalesce(_c(c).rlike("(?i)" + P.URL_OR_SHORT), F.lit(False))


# X9 ---------------------------------------------------------------------------
def has_bug_keyword(c) -> Column:
    return F.coalesce(_c(c).rlike(P.ci(P.BUG)), F.lit(False))


# F3 / F4 ---------------------------------------------------------------------
def in_window(ts, lo: str = P.INCIDENT_WINDOW[0], hi: str = P.INCIDENT_WINDOW[1]) -> Column:
    """UTC calendar date of ``ts`` within ``[lo, hi]``, both ends inclusive."""
    return F.to_date(_c(ts)).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))


def incident_tag(keyword: Column, window: Column, tag: str = P.INCIDENT_TAG) -> Column:
    return F.when(keyword | window, F.lit(tag))


# X10 --------------------------------------------------------------------------
def quality_flags(c, max_chars: int = P.MAX_CHARS) -> Column:
    """``over_length:N`` when longer than ``max_chars`` and ``narration`` when the text
    narrates itself, in that order."""
    c = _c(c)
    n = F.length(c)
    return F.filter(F.array(
        F.when(n > max_chars, F.concat(F.lit("over_length:"), n.cast("string"))),
        F.when(c.rlike(P.ci(P.NARRATION)), F.lit("narration")),
    ), lambda x: x.isNotNull())


# X11 --------------------------------------------------------------------------
def residual_word_count(c) -> Column:
    """Words left once the generic acknowledgement phrases are removed."""
    core = F.regexp_replace(_c(c), P.ci(P.GENERIC), "")
    return F.regexp_count(core, F.lit(r"(?U)\w+"))


# X12 --------------------------------------------------------------------------
def term_hits(c, terms: Iterable[str] | Column = tuple(P.BANNED_ERA_TERMS)) -> Column:
    """Terms contained in the text, case-insensitively, in the list's order."""
    arr = terms if isinstance(terms, Column) else F.array(*[F.lit(t) for t in terms])
    low = F.lower(_c(c))
    return F.filter(arr, lambda t: F.contains(low, F.lower(t)))


# X13 --------------------------------------------------------------------------
def unsupported_specifics(draft, grounding) -> Column:
    """Settings paths, version numbers and named features in ``draft`` absent from
    ``grounding``; sorted, distinct. Paths compare trimmed and lower-cased, versions
    compare raw."""
    d, g = _c(draft), F.lower(F.coalesce(_c(grounding), F.lit("")))
    paths = F.regexp_extract_all(d, F.lit("(?iU)" + P.SETTINGS_PATH), 0)
    paths = F.transform(
        F.filter(paths, lambda m: (F.length(py_strip(m)) > 0)
                 & ~F.contains(g, F.lower(py_strip(m)))),
        lambda m: F.concat(F.lit("path:"), py_strip(m)))
    versions = F.regexp_extract_all(d, F.lit(P.uni(P.VERSION)), 0)
    versions = F.transform(F.filter(versions, lambda v: ~F.contains(g, v)),
                           lambda v: F.concat(F.lit("version:"), v))
    low = F.lower(d)
    feats = F.filter(F.array(*[F.lit(f) for f in P.FEATURES]),
                     lambda f: F.contains(low, F.lower(f)) & ~F.contains(g, F.lower(f)))
    feats = F.transform(feats, lambda f: F.concat(F.lit("feature:"), f))
    return F.array_sort(F.array_distinct(F.concat(paths, versions, feats)))


# X14 --------------------------------------------------------------------------
def parse_label(raw, classes: Iterable[str] = tuple(P.PARSE_ORDER)) -> Column:
    """First class (in list order) contained in the stripped, lower-cased raw text."""
    got = F.lower(F.regexp_replace(_c(raw), r"(?U)^[.`\"'\s]+|[.`\"'\s]+$", ""))
    arr = F.array(*[F.lit(x) for x in classes])
    return F.try_element_at(F.filter(arr, lambda k: F.contains(got, k)), F.lit(1))


# X15 --------------------------------------------------------------------------
def lenient_scores(raw, dims: Iterable[str] = tuple(P.RUBRIC_DIMS)) -> Column:
    """Parse model scores: whole JSON, else the first ``{...}`` span; each dimension is
    rounded half-even and kept only within 1..5; texts are truncated."""
    dims = list(dims)
    schema = ", ".join(f"`{d}` string" for d in dims) + ", justification string"
    whole = F.from_json(_c(raw), schema, {"mode": "PERMISSIVE"})
    inner = F.from_json(F.regexp_extract(_c(raw), r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"})
    fields = []
    for d in dims:
        v = F.coalesce(whole[d], inner[d])
        n = F.bround(v.try_cast("double"), 0).try_cast("int")
        fields.append(F.when(n.between(1, 5), n).alias(d))
    just = F.coalesce(whole["justification"], inner["justification"], F.lit(""))
    fields.append(F.substring(just, 1, 300).alias("justification"))
    fields.append(F.substring(_c(raw), 1, 400).alias("raw"))
    return F.struct(*fields)


# X16 --------------------------------------------------------------------------
def fmt2(c) -> Column:
    return F.format_string("%.2f", _c(c))


# X17 --------------------------------------------------------------------------
def assemble(*parts: tuple[str, Column]) -> Column:
    """Labelled evidence block: ``label: value`` lines, skipping null values."""
    return F.concat_ws("\n", *[F.when(_c(v).isNotNull(), F.concat(F.lit(f"{k}: "), _c(v)))
                               for k, v in parts])


# X18 --------------------------------------------------------------------------
def parse_tweet_time(c) -> Column:
    """``EEE MMM dd HH:mm:ss Z yyyy`` to a UTC timestamp. The day name is dropped first
    because Spark rejects ``EEE`` in parse patterns."""
    return F.try_to_timestamp(F.substr(_c(c), F.lit(5)), F.lit("MMM dd HH:mm:ss Z yyyy"))


# X21 --------------------------------------------------------------------------
def strip_accents(c) -> Column:
    return F.translate(_c(c), P.ACCENT_FROM, P.ACCENT_TO)


# S3 ---------------------------------------------------------------------------
def lenient_int(c) -> Column:
    return _c(c).try_cast("int")


# F1 ---------------------------------------------------------------------------
def text_flag(c) -> Column:
    return F.lower(py_strip(_c(c))) == F.lit("true")
