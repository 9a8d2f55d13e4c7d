"""Rule queries whose every class and branch occurs.

The documents' own words set off few of the rules, so here each document opens with one of a
few messages (and gets one of a few replies), picked by its id; every second one goes on with
its own text. The rows and their number come from ``documents``; the rules are the
production ones, and each query has its DuckDB twin.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rules as R
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import evaluate as E
from ..operators import routing as RO
from ..session import checkpoint_dir, keep
from . import jobs
from .catalog import SQL_MSGS, msgs, register, tb, texts
from .catalog_more import SQL_DECISIONS, _sql_map
from .catalog_rules import (SQL_PRED, lang_predictions, sql_label_intent, sql_looks_non_english, sql_oos_kind, sql_overrides, sql_real_words,
                            sql_resolution_type, sql_resolve, sql_unsupported)
from .sqlre import arr, collapse, q, rmatch, strip

MESSAGES = [
    "how can I downgrade to the old one",
    "my battery dies by noon and the phone was too hot to hold",
    "I was charged twice for the subscription and then the phone went black",
    "the camera app keeps crashing on my phone",
    "apple pay is great and this is fine with me",
    "hola necesito ayuda con mi telefono por favor",
    "is this email real or a scam, who did send it to me",
    "how much is the warranty for my phone after two years",
    "thanks, I love this phone so much and you should know",
    "why is there a limit of 280 characters on this account",
    "my screen is cracked and the back has gone black since I dropped it",
    "please book an appointment for my phone at the store today",
    "I want a refund for what I never bought and my account is locked out",
    "my keyboard turns every i into a question mark since the update",
    "the battery drains so fast since the update, what can I do",
    "so it is",
]
REPLIES = [
    "Our billing support folks can sort this out for you.",
    "Please see https://help.example.com/x and DM us after.",
    "Steps are listed at https://help.example.com/steps",
    "Send us a DM and we'll continue there.",
    "https://t.co/GDrqU22YpT",
    "Which model are you using right now?",
    "Open Settings > Battery now, then turn on Low Power Mode and update to 11.2",
    "Thanks for reaching out.",
    "as an ai I will draft a reply with Dark Mode and Screen Time in mind",
]
#: Labels a model might give, in turn.
GUESSES = ["ios_version_downgrade", "battery_drain", "billing_account", "software_feature_defect", P.RESIDUAL, "non_english"]


def probes(spark, d):
    """(doc_id, text, reply, guess) for every document."""
    pick = lambda items: F.element_at(F.array(*[F.lit(x) for x in items]), (F.col("doc_id") % len(items)).cast("int") + 1)
    own = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.col("text"))).otherwise(F.lit(""))
    return texts(spark, d, "doc_id", "text").select(
        "doc_id", F.concat(pick(MESSAGES), own).alias("text"), pick(REPLIES).alias("reply"), pick(GUESSES).alias("guess"))


def _pick(items):
    return f"{arr(items)}[(doc_id % {len(items)} + 1)::integer]"


PROBES = (f"(select doc_id, {_pick(MESSAGES)} || case when doc_id % 2 = 0 then ' ' || text else '' end as text, "
          f"{_pick(REPLIES)} as reply, {_pick(GUESSES)} as guess from documents)")
PROBE_DECISIONS = SQL_DECISIONS.replace("from documents)", f"from {PROBES} pr)", 1)


@register("r3_probe_intents", f"select doc_id, {sql_label_intent('text', 'reply')} as intent from {PROBES} p")
def r3_probe_intents(spark, d):
    return probes(spark, d).select("doc_id", R.label_intent("text", F.col("reply")).alias("intent"))


@register("r1_probe_resolution", f"select doc_id, {sql_resolution_type('reply')} as rtype from {PROBES} p")
def r1_probe_resolution(spark, d):
    return probes(spark, d).select("doc_id", R.resolution_type("reply").alias("rtype"))


@register("r5_probe_resolve", f"select doc_id, guess, {sql_resolve('text', 'guess')} as label from {PROBES} p")
def r5_probe_resolve(spark, d):
    return probes(spark, d).select("doc_id", "guess", R.resolve("text", "guess").alias("label"))


@register("r6_r7_probe_scope", f"""
select doc_id, kind, blind and kind is null as blind from (select doc_id, {sql_oos_kind('text')} as kind,
  {rmatch('text', P.BLIND)} and {sql_real_words('text')} > {P.THIN_MAX_WORDS} as blind from {PROBES} p)""")
def r6_r7_probe_scope(spark, d):
    return probes(spark, d).select("doc_id", R.oos_kind("text").alias("kind"), R.blind_spot("text").alias("blind"))


@register("f8_probe_provenance", f"""
select provenance, count(*)::bigint as n, round(avg((quality = 1)::int), 6) as quality_rate from (
  select p.doc_id, l.quality, case when {sql_oos_kind('p.text')} is not null then 'circular' else 'independent' end as provenance
  from {PROBES} p join labels l on p.doc_id = l.doc_id) group by provenance""")
def f8_probe_provenance(spark, d):
    p = probes(spark, d).select("doc_id", F.when(R.oos_kind("text").isNotNull(), "circular").otherwise("independent").alias("provenance"))
    return p.join(tb(spark, d, "labels"), "doc_id").groupBy("provenance").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("quality") == 1).cast("int")), 6).alias("quality_rate"))


@register("r8_u3_probe_overrides", f"""
select doc_id, array_to_string({sql_overrides('text', sql_label_intent('text', 'reply'))}, ',') as labels from {PROBES} p""")
def r8_u3_probe_overrides(spark, d):
    return probes(spark, d).select("doc_id", F.array_join(
        R.check_overrides("text", R.label_intent("text", F.col("reply"))), ",").alias("labels"))


@register("a10_probe_override_counts", f"""
select item, count(*)::bigint as n from (select unnest({sql_overrides('text')}) as item from {PROBES} p) group by item""")
def a10_probe_override_counts(spark, d):
    return A.explode_count(probes(spark, d), R.check_overrides("text"), "item")


@register("x13_u4_probe_unsupported", f"""
select doc_id, array_to_string({sql_unsupported('reply', 'text')}, '|') as findings from {PROBES} p""")
def x13_u4_probe_unsupported(spark, d):
    return probes(spark, d).select("doc_id", F.array_join(T.unsupported_specifics("reply", "text"), "|").alias("findings"))


@register("x9_x10_probe_flags", f"""
select doc_id, {rmatch('text', P.BUG)} as bug, array_to_string(list_filter([
  case when length(text) > {P.MAX_CHARS} then 'over_length:' || length(text)::varchar end,
  case when {rmatch('reply', P.NARRATION)} then 'narration' end], lambda x: x is not null), ',') as flags from {PROBES} p""")
def x9_x10_probe_flags(spark, d):
    long = F.filter(T.quality_flags("text"), lambda x: x.startswith("over_length"))
    told = F.filter(T.quality_flags("reply"), lambda x: x == "narration")
    return probes(spark, d).select("doc_id", T.has_bug_keyword("text").alias("bug"), F.array_join(F.concat(long, told), ",").alias("flags"))


def probe_decisions(spark, d):
    p = probes(spark, d).select("doc_id", "text", R.label_intent("text").alias("intent"))
    return RO.decide(RO.draft_checks(RO.route(p, None, "doc_id", "intent", "text"), "intent"), "intent")


@register("g9_f9_probe_decisions", f"""
select doc_id, intent, route, action, reason, action = 'auto_handle' and draft is not null as has_final_draft,
  array_to_string(coalesce(unsupported, []), '|') as unsupported from {PROBE_DECISIONS} z""")
def g9_f9_probe_decisions(spark, d):
    return probe_decisions(spark, d).select(
        "doc_id", "intent", "route", "action", "reason", F.col("final_draft").isNotNull().alias("has_final_draft"),
        F.array_join("unsupported", "|").alias("unsupported"))


_CONFORM = f"""(select *, case when circular then 'escalate' else {_sql_map(P.EXPECTED_ACTION, 'intent')} end as expected from (
  select *, intent = 'battery_drain' and {rmatch('text', dict(P.OVERRIDES)['physical_or_hardware'])} as circular from {PROBE_DECISIONS} z0))"""


@register("e9_probe_conformance", f"""
select intent, expected, action, circular, count(*)::bigint as n from {_CONFORM} x group by all""")
def e9_probe_conformance(spark, d):
    """Agreement with the expected action by class; rows with expected <> action are the
    disagreements, circular ones were decided by the rule that routes them."""
    exp, circ = E.expected_action(F.col("intent"), F.col("text"))
    return probe_decisions(spark, d).groupBy("intent", exp.alias("expected"), "action", circ.alias("circular")).agg(F.count(F.lit(1)).alias("n"))


@register("e9_probe_disagreements", f"select doc_id, intent, action, expected from {_CONFORM} x where action <> expected")
def e9_probe_disagreements(spark, d):
    exp, _ = E.expected_action(F.col("intent"), F.col("text"))
    # written before the filter, which would otherwise run the cascades a second time
    x = keep(probe_decisions(spark, d).select("doc_id", "intent", "action", exp.alias("expected")))
    return x.filter(F.col("action") != F.col("expected"))


@register("a13_probe_decomposition", f"""
select count(*) filter (where intent = {q(P.RESIDUAL)})::bigint as diagnostic_question,
  count(*) filter (where intent = 'ios_version_downgrade')::bigint as policy_fact,
  count(*) filter (where intent = 'battery_drain')::bigint as canned_template,
  count(*) filter (where intent not in ({q(P.RESIDUAL)}, 'ios_version_downgrade', 'battery_drain'))::bigint as unassigned,
  count(*)::bigint as total from {PROBE_DECISIONS} z where action = 'auto_handle'""")
def a13_probe_decomposition(spark, d):
    it = F.col("intent")
    return A.decomposition(probe_decisions(spark, d).filter(F.col("action") == "auto_handle"), [
        ("diagnostic_question", it == P.RESIDUAL), ("policy_fact", it == "ios_version_downgrade"), ("canned_template", it == "battery_drain")])


@register("r9_script_evidence", f"select doc_id, {sql_looks_non_english('text')} as non_english from {PROBES} p")
def r9_script_evidence(spark, d):
    return probes(spark, d).select("doc_id", R.looks_non_english("text").alias("non_english"))


@register("x2_dm_links", """
select doc_id, regexp_replace(regexp_replace(regexp_replace(reply, 'https://t\\.co/GDrqU(22YpT|2kzhr)(\\s|$)', '\\2', 'g'), '\\s{2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as kept
from """ + PROBES + " p")
def x2_dm_links(spark, d):
    return probes(spark, d).select("doc_id", T.strip_dm_links("reply").alias("kept"))


@register("x18_message_time", "select o_orderkey, date_trunc('second', o_orderdate) as ts from orders")
def x18_message_time(spark, d):
    """Order dates written the way messages carry them, and read back."""
    said = F.date_format("o_orderdate", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    return tb(spark, d, "orders").select("o_orderkey", T.parse_tweet_time(said).alias("ts"))


@register("f1_text_flag", """
select doc_id, case doc_id % 4 when 0 then quality = 1 when 1 then toxic = 1 when 2 then quality = 1 end as flag from labels""")
def f1_text_flag(spark, d):
    """Label flags written as text in the spellings that occur, and read back."""
    yes = F.when(F.when(F.col("doc_id") % 4 == 1, F.col("toxic")).otherwise(F.col("quality")) == 1, "true").otherwise("false")
    said = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("  "), F.initcap(yes), F.lit(" "))).when(
        F.col("doc_id") % 4 == 1, F.upper(yes)).when(F.col("doc_id") % 4 == 2, yes)
    return tb(spark, d, "labels").select("doc_id", T.text_flag(said).alias("flag"))


# The corpus job over the reply graph of the conversations. Customers there mention nobody, so
# each message gets a numeric alias of the brand, another user and the brand's handle, and a
# date around the incident.
ALIAS, OTHER, BRAND = "115858", "Helper9", "assistant"
_RAW = f"""(select *, case when inbound then '@{ALIAS}  ' || text || ' cc @{OTHER} and @{BRAND}' else '@{OTHER} ' || text end as said,
  timestamp '2017-10-28 12:00:00' + to_days((conv_id % 20)::integer) as created_at from {SQL_MSGS} m)"""


def _sql_anon(e):
    named = f"replace(replace({e}, '@{ALIAS}', '@' || chr(1)), '@{BRAND}', '@' || chr(1))"
    return strip(collapse(f"replace(regexp_replace({named}, '@[\\p{{L}}\\p{{N}}_]+', '@USER', 'g'), '@' || chr(1), '@BRAND')"))


@register("corpus_job", f"""
with m as {_RAW},
p as (select r.tweet_id, {_sql_anon('o.said')} as customer_text, {_sql_anon('r.said')} as brand_text, o.created_at
  from m r join m o on r.in_response_to_tweet_id = o.tweet_id and o.response_tweet_id = r.tweet_id
  where not r.inbound and r.author_id = '{BRAND}' and r.response_tweet_id is null and o.inbound and o.in_response_to_tweet_id is null)
select tweet_id, md5(customer_text) as customer_md5, md5(brand_text) as brand_md5, {sql_resolution_type('brand_text')} as res_type,
  {rmatch('customer_text', P.BUG)} as bug_kw, created_at::date between date '{P.INCIDENT_WINDOW[0]}' and date '{P.INCIDENT_WINDOW[1]}' as in_window,
  case when {rmatch('customer_text', P.BUG)} or created_at::date between date '{P.INCIDENT_WINDOW[0]}' and date '{P.INCIDENT_WINDOW[1]}' then '{P.INCIDENT_TAG}' end as incident_window
from p""")
def corpus_job(spark, d):
    m = msgs(spark, d)
    said = F.when(F.col("inbound"), F.concat(F.lit(f"@{ALIAS}  "), "text", F.lit(f" cc @{OTHER} and @{BRAND}"))).otherwise(
        F.concat(F.lit(f"@{OTHER} "), "text"))
    day = F.date_add(F.lit("2017-10-28").cast("date"), (F.col("conv_id") % 20).cast("int"))
    m = m.withColumn("text", said).withColumn("created_at", day.cast("timestamp") + F.expr("interval 12 hours"))
    out = jobs.corpus_job(spark, m, BRAND, f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}")
    return out.select("tweet_id", F.md5("customer_text").alias("customer_md5"), F.md5("brand_text").alias("brand_md5"),
                      "res_type", "bug_kw", "in_window", "incident_window")


@register("e8_second_pass_pairs", f"""
with p as {SQL_PRED}
select source, truth, count(*)::bigint as n, round(avg((truth = pred)::int), 6) as agree from p group by rollup(source, truth)""")
def e8_second_pass_pairs(spark, d):
    """Agreement per sub-stratum and class, per sub-stratum, and overall."""
    return E.concordance(lang_predictions(spark, d), "truth", "pred", ["source", "truth"])


@register("e8_disagreements", f"with p as {SQL_PRED} select doc_id, truth, pred from p where truth <> pred")
def e8_disagreements(spark, d):
    return E.disagreements(lang_predictions(spark, d), "truth", "pred").select("doc_id", "truth", "pred")
