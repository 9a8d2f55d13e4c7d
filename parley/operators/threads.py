"""Thread reconstruction over a reply graph.

The message table follows the reply-graph layout: ``tweet_id, author_id, inbound,
response_tweet_id`` (comma-separated children) and ``in_response_to_tweet_id``.
``messages_from_turns`` derives that layout from a turn-numbered conversation table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def messages_from_turns(conv: DataFrame, conv_col="conv_id", turn_col="turn",
                        role_col="role", text_col="text", customer_role="user") -> DataFrame:
    """Conversation turns to the reply-graph layout: each turn answers the previous one
    and is answered by the next one. The next turn is found with ``lead`` inside the
    conversation (one shuffle on ``conv_id``)."""
    w = Window.partitionBy(conv_col).orderBy(turn_col)
    mid = lambda c, t: F.concat_ws(":", F.col(c).cast("string"), t.cast("string"))
    nxt = F.lead(turn_col).over(w)
    prv = F.lag(turn_col).over(w)
    return conv.select(
        mid(conv_col, F.col(turn_col)).alias("tweet_id"),
        F.col(role_col).alias("author_id"),
        (F.col(role_col) == customer_role).alias("inbound"),
        F.when(nxt.isNotNull(), mid(conv_col, nxt)).alias("response_tweet_id"),
        F.when(prv.isNotNull(), mid(conv_col, prv)).alias("in_response_to_tweet_id"),
        F.col(text_col).alias("text"),
        F.col(conv_col), F.col(turn_col),
    )


# F2 ---------------------------------------------------------------------------
def is_opener(parent: Column) -> Column:
    return parent.isNull()


def has_single_reply(children: Column) -> Column:
    return children.isNotNull() & ~F.coalesce(F.contains(children, F.lit(",")), F.lit(False))


def is_terminal(children: Column) -> Column:
    return children.isNull()


def n_children(children: Column) -> Column:
    return F.when(children.isNull(), F.lit(0)).otherwise(F.size(F.split(children, ",")))


# J1 ---------------------------------------------------------------------------
def strict_pairs(msgs: DataFrame, brand: str | None = None) -> DataFrame:
    """Replies that close a strict two-turn thread: a customer opener with exactly one
    reply, that reply by the brand (any non-customer author when ``brand`` is None),
    nothing after it, and both pointers agree. One equi-join carries both the
    semi-join and the mutual-pointer check; both sides are filtered first."""
    openers = msgs.filter(F.col("inbound") & is_opener(F.col("in_response_to_tweet_id"))
                          & has_single_reply(F.col("response_tweet_id"))) \
        .select(F.col("tweet_id").alias("_o_id"), F.col("response_tweet_id").alias("_o_resp"))
    cond = ~F.col("inbound") & is_terminal(F.col("response_tweet_id")) \
        & F.col("in_response_to_tweet_id").isNotNull()
    if brand is not None:
        cond = cond & (F.col("author_id") == brand)
    replies = msgs.filter(cond)
    j = replies.join(openers, (replies.in_response_to_tweet_id == openers._o_id)
                     & (replies.tweet_id == openers._o_resp), "inner")
    return j.drop("_o_id", "_o_resp").withColumn("parent_id", F.col("in_response_to_tweet_id"))


# J2 ---------------------------------------------------------------------------
def with_parent(replies: DataFrame, msgs: DataFrame, cols=("text",), prefix="parent_") -> DataFrame:
    """Left join each reply to its parent message on the unique id, pulling columns
    with a prefix."""
    par = msgs.select(F.col("tweet_id").alias("_p_id"),
                      *[F.col(c).alias(prefix + c) for c in cols])
    return replies.join(par, replies.in_response_to_tweet_id == par._p_id, "left").drop("_p_id")


def adjacent_pairs(conv: DataFrame, customer_role="user", reply_role="assistant") -> DataFrame:
    """Each customer turn with the reply turn that directly follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = conv.select("conv_id", "turn", "role", "text",
                    F.lead("role").over(w).alias("_nrole"),
                    F.lead("turn").over(w).alias("_nturn"),
                    F.lead("text").over(w).alias("_ntext"))
    return t.filter((F.col("role") == customer_role) & (F.col("_nrole") == reply_role)) \
        .select("conv_id", F.col("turn").alias("q_turn"), F.col("_nturn").alias("r_turn"),
                F.col("text").alias("customer_text"), F.col("_ntext").alias("brand_text"))


# A4 ---------------------------------------------------------------------------
def author_profile(msgs: DataFrame, top_n: int = 20) -> DataFrame:
    """Per non-customer author: reply volume, strict-thread count and rate; one pass
    over all authors instead of one thread join per author."""
    vol = msgs.filter(~F.col("inbound")).groupBy("author_id").agg(F.count(F.lit(1)).alias("replies"))
    clean = strict_pairs(msgs).groupBy("author_id").agg(F.count(F.lit(1)).alias("clean_threads"))
    return vol.join(clean, "author_id", "left") \
        .select("author_id", "replies",
                F.coalesce("clean_threads", F.lit(0)).alias("clean_threads"),
                F.round(F.coalesce("clean_threads", F.lit(0)) / F.col("replies"), 6).alias("clean_rate")) \
        .orderBy(F.desc("replies"), "author_id").limit(top_n)


# A5 ---------------------------------------------------------------------------
def top_tokens(df: DataFrame, col: str, pattern: str, group: int = 1, n: int = 2) -> DataFrame:
    """Most frequent extracted token(s) with counts, ties by token."""
    toks = df.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(pattern), group)).alias("token"))
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), "token").limit(n)


def brand_alias(df: DataFrame, col: str = "customer_text") -> str | None:
    """The most-mentioned numeric handle; a single small driver round trip."""
    r = top_tokens(df, col, r"@(\d+)", 1, 1).collect()
    return r[0]["token"] if r else None


# F3-F5 ------------------------------------------------------------------------
def incident_flags(df: DataFrame, text_col: str, ts_col: str,
                   incidents: list[tuple[str, str, str]] | None = None,
                   keyword: Column | None = None) -> DataFrame:
    """``bug_kw``, ``in_window`` and ``incident_window`` (tag when keyword OR window,
    null when neither). ``incidents`` is a rule table of ``(tag, lo, hi)`` date windows,
    compiled to one CASE expression (first window wins); no join is needed."""
    from ..functions.rules import cascade
    kw = keyword if keyword is not None else T.has_bug_keyword(F.col(text_col))
    incidents = incidents or [(T.P.INCIDENT_TAG, *T.P.INCIDENT_WINDOW)]
    wtag = cascade([(tag, T.in_window(F.col(ts_col), lo, hi)) for tag, lo, hi in incidents], None)
    kw_tag = F.lit(incidents[0][0])
    return df.withColumn("bug_kw", kw) \
        .withColumn("in_window", wtag.isNotNull()) \
        .withColumn("incident_window", F.when(F.col("bug_kw") | F.col("in_window"),
                                              F.coalesce(wtag, kw_tag)))


def flag_overlap(df: DataFrame, a: str = "in_window", b: str = "bug_kw") -> DataFrame:
    """2x2 overlap of two flags in one aggregation."""
    A, B = F.col(a), F.col(b)
    return df.agg(
        F.count_if(A | B).alias("tagged"),
        F.count_if(A & ~B).alias("a_only"),
        F.count_if(~A & B).alias("b_only"),
        F.count_if(A & B).alias("both"),
        F.count_if(~(A | B)).alias("neither"),
    )
