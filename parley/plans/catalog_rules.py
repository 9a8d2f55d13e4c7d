"""Rule cascades, multi-label rules and evaluation queries bound to the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rules as R
from ..functions import text as T
from ..operators import evaluate as E
from ..operators import threads as TH
from .catalog import SQL_PAIRS, SQL_TOKENS, register, tb, texts
from .sqlre import arr, collapse, fold, q, rcount, re2, rmatch, rreplace, strip

# ---------------------------------------------------------------------------
# SQL twins of the library's rule expressions
# ---------------------------------------------------------------------------
# FOREIGN alternatives that are single words; the two multi-word ones are counted with
# a regex. ``\b(alt)\b`` on a single word matches exactly a whole word token.
FOREIGN_WORDS = ["que", "não", "nao", "para", "meu", "minha", "mais", "muito", "com", "você", "voce",
                 "está", "esta", "pra", "porque", "obrigado", "obrigada", "mis", "muy", "pero", "gracias",
                 "hola", "como", "cuando", "ahora", "nada", "hace", "ajuda", "favor", "ayuda", "quiero",
                 "necesito", "gostaria", "preciso", "aiuto", "ich", "nicht", "mein", "meine", "bitte",
                 "und", "ist", "kein", "habe", "auch", "je", "mon", "les", "une", "pas", "avec", "très",
                 "tres", "bir", "çok", "için", "daha"]


def sql_foreign_hits(e):
    toks = f"regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}_]+')"
    single = f"len(list_filter({toks}, lambda t: list_contains({arr(FOREIGN_WORDS)}, t)))"
    multi = rcount(e, r"\b(c'est|per favore)\b")
    return f"({single} + {multi})"


def sql_is_non_english(e, brand=None):
    hits = sql_foreign_hits(e)
    no_stop = f"not {rmatch(e, P.ENGLISH_STOP)}"
    red = rmatch(brand, P.LANG_REDIRECT) if brand else "false"
    return (f"({red} or {hits} >= 2 or ({hits} >= 1 and {no_stop}) "
            f"or ({rmatch(e, P.ACCENTED, folded=False)} and {no_stop}))")


def sql_label_intent(e, brand=None):
    masked = rreplace(fold(e), P.APPLE_PAY, " ")
    return (f"case when {sql_is_non_english(e, brand)} then 'non_english' "
            f"when {rmatch(e, P.DOWNGRADE)} then 'ios_version_downgrade' "
            f"when {rmatch(e, P.BATTERY)} then 'battery_drain' "
            f"when {rmatch(masked, P.BILLING, folded=False)} then 'billing_account' "
            f"when {rmatch(e, P.COMPONENT)} and {rmatch(e, P.SYMPTOM)} then 'software_feature_defect' "
            f"else '{P.RESIDUAL}' end")


def sql_tokens(e):
    return SQL_TOKENS.replace("translate(text,", f"translate({e},")


def sql_looks_non_english(e):
    toks = sql_tokens(e)
    return (f"(case when coalesce(regexp_matches({e}, {q(re2(P.NON_LATIN, ci=False))}), false) then true "
            f"when {rmatch(e, P.DOWNGRADE_EVIDENCE)} then false "
            f"else len({toks}) >= {P.FW_MIN_WORDS} and not list_has_any({toks}, {arr(P.ENGLISH_FW)}) end)")


def sql_real_words(e):
    return (f"len(list_filter(regexp_extract_all({rreplace(e, P.STRIP_TOKENS, ' ', ci=False)}, "
            f"'[A-Za-z'']+'), lambda w: length(w) > 1))")


def sql_resolve(e, lab):
    return (f"(case when {sql_looks_non_english(e)} then 'non_english' "
            f"when {lab} = 'ios_version_downgrade' then case when {rmatch(e, P.DOWNGRADE_EVIDENCE)} then {lab} else '{P.RESIDUAL}' end "
            f"when {sql_real_words(e)} <= {P.THIN_MAX_WORDS} then '{P.RESIDUAL}' "
            f"when {lab} = 'non_english' then '{P.OUT_OF_SCOPE}' else {lab} end)")


def sql_oos_kind(e):
    return "(case " + " ".join(f"when {rmatch(e, p)} then '{k}'" for k, p in P.OOS_KINDS) + " end)"


def sql_overrides(e, intent=None):
    fired = ("list_filter([" + ", ".join(f"case when {rmatch(e, p)} then '{k}' end" for k, p in P.OVERRIDES)
             + "], lambda x: x is not null)")
    if intent is None:
        return fired
    cases = " ".join(f"when {intent} = '{k}' then list_sort(list_distinct(list_append({fired}, '{v}')))"
                     for k, v in P.POLICY_ESCALATE_INTENTS.items())
    return f"(case {cases} else {fired} end)"


def sql_resolution_type(e):
    dm_links = "(" + "|".join(re2(u, ci=False).replace(".", "\\.") for u in P.DM_LINKS) + ")"
    txt = strip(collapse(f"regexp_replace({e}, '{dm_links}(\\s|$)', '\\2', 'g')"))
    says_dm = rmatch(txt, P.DM)
    instruct = rmatch(txt, P.INSTRUCT)
    foreign_link = (f"len(list_filter(regexp_extract_all({e}, 'https?://\\S+'), "
                    f"lambda x: not list_contains({arr(P.DM_LINKS)}, x))) > 0")
    residual = rcount(rreplace(fold(txt), P.GENERIC, ""), r"\w+", ci=False, folded=False)
    return (f"(case when {rmatch(txt, P.REDIRECT)} then 'other_channel_redirect' "
            f"when {foreign_link} then case when {says_dm} then 'answer_with_dm_followup' else 'self_contained_answer' end "
            f"when {says_dm} or {txt} <> {e} then 'dm_handoff' "
            f"when contains({txt}, '?') and not {instruct} then 'clarifying_question' "
            f"when {instruct} or {residual} >= 8 then 'self_contained_answer' else 'other' end)")


# ---------------------------------------------------------------------------
# Cascades over the driver tables
# ---------------------------------------------------------------------------
@register("r1_resolution_type", f"""
select rtype, count(*)::bigint as n from (select {sql_resolution_type('text')} as rtype from conversations where role = 'assistant') group by rtype""")
def r1_resolution_type(spark, d):
    c = tb(spark, d, "conversations").filter(F.col("role") == "assistant")
    return c.groupBy(R.resolution_type("text").alias("rtype")).agg(F.count(F.lit(1)).alias("n"))


@register("r2_non_english_vs_lang", f"""
select lang, {sql_is_non_english('text')} as predicted_non_english, count(*)::bigint as n from documents group by all""")
def r2_non_english_vs_lang(spark, d):
    docs = tb(spark, d, "documents")
    return docs.groupBy("lang", R.is_non_english("text").alias("predicted_non_english")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("r2_foreign_hits", f"""select doc_id, {sql_foreign_hits('text')}::bigint as hits from documents""")
def r2_foreign_hits(spark, d):
    return tb(spark, d, "documents").select("doc_id", R.foreign_hits("text").cast("bigint").alias("hits"))


@register("r3_first_pass_intent", f"""select doc_id, {sql_label_intent('text')} as intent from documents""")
def r3_first_pass_intent(spark, d):
    return texts(spark, d, "doc_id", "text").select("doc_id", R.label_intent("text").alias("intent"))


@register("r3_pair_intent", f"""
select conv_id, q_turn, {sql_label_intent('customer_text', 'brand_text')} as intent from {SQL_PAIRS} p""")
def r3_pair_intent(spark, d):
    p = TH.adjacent_pairs(tb(spark, d, "conversations"))
    return p.select("conv_id", "q_turn", R.label_intent("customer_text", F.col("brand_text")).alias("intent"))


@register("r4_script_rule_vs_lang", f"""
select lang, {sql_looks_non_english('text')} as looks_non_english, count(*)::bigint as n from documents group by all""")
def r4_script_rule_vs_lang(spark, d):
    docs = tb(spark, d, "documents")
    return docs.groupBy("lang", R.looks_non_english("text").alias("looks_non_english")) \
        .agg(F.count(F.lit(1)).alias("n"))


MODEL_LABEL_SQL = ("case when l.toxic = 1 then 'non_english' when l.quality = 0 then 'ios_version_downgrade' "
                   "else 'software_feature_defect' end")


def model_labels(spark, d):
    """The label log stand-in: a model label per document derived from ``labels``."""
    lab = tb(spark, d, "labels")
    ml = F.when(F.col("toxic") == 1, "non_english").when(F.col("quality") == 0, "ios_version_downgrade") \
        .otherwise("software_feature_defect")
    return lab.select("doc_id", ml.alias("model_label"))


@register("r5_resolve", f"""
select d.doc_id, {MODEL_LABEL_SQL} as model_label, {sql_resolve('d.text', MODEL_LABEL_SQL)} as final_label
from documents d join labels l on d.doc_id = l.doc_id""")
def r5_resolve(spark, d):
    j = tb(spark, d, "documents").join(model_labels(spark, d), "doc_id")
    return j.select("doc_id", "model_label", R.resolve("text", "model_label").alias("final_label"))


@register("r6_oos_kind", f"""select coalesce({sql_oos_kind('text')}, 'none') as kind, count(*)::bigint as n from documents group by 1""")
def r6_oos_kind(spark, d):
    return tb(spark, d, "documents").groupBy(F.coalesce(R.oos_kind("text"), F.lit("none")).alias("kind")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("r7_blind_spot", f"""
select count(*) filter (where {rmatch('text', P.BLIND)} and {sql_real_words('text')} > {P.THIN_MAX_WORDS} and {sql_oos_kind('text')} is null)::bigint as blind_spot,
  count(*)::bigint as n from documents""")
def r7_blind_spot(spark, d):
    return tb(spark, d, "documents").agg(F.count_if(R.blind_spot("text")).alias("blind_spot"),
                                         F.count(F.lit(1)).alias("n"))


@register("r8_overrides", f"""
select doc_id, array_to_string({sql_overrides('text', sql_label_intent('text'))}, ',') as overrides from documents""")
def r8_overrides(spark, d):
    docs = tb(spark, d, "documents").select("doc_id", "text", R.label_intent("text").alias("intent"))
    return docs.select("doc_id", F.array_join(R.check_overrides("text", F.col("intent")), ",").alias("overrides"))


DOC_RULES = R.RuleTable(name="doc_content", rules=[
    R.Rule("licence", include=[r"licen[cs]e|copyright|spdx"]),
    R.Rule("secret", include=[r"token|password|secret|api[_ ]?key"]),
    R.Rule("contact", include=[r"@[a-z0-9]+\.example|\+\d|\d{3}[- ]\d{4}"]),
    R.Rule("table", include=[r"\|"], exclude=[r"licen[cs]e"]),
], default="prose")


def sql_rule_table(tbl, e):
    parts = []
    for r in tbl.rules:
        cond = " and ".join([rmatch(e, p) for p in r.include] + [f"not {rmatch(e, p)}" for p in r.exclude]) or "true"
        parts.append(f"when {cond} then '{r.label}'")
    return f"(case {' '.join(parts)} else '{tbl.default}' end)"


SQL_R0 = f"""select label, count(*)::bigint as n from (select {sql_rule_table(DOC_RULES, 'text')} as label from documents) group by 1"""


def r0_rule_table(spark, d):
    return tb(spark, d, "documents").groupBy(DOC_RULES.compile("text").alias("label")).agg(F.count(F.lit(1)).alias("n"))


register("r0_rule_table", SQL_R0)(r0_rule_table)


@register("r10_gap_fill", f"""
select d.doc_id, coalesce(case when l.doc_id is not null then {MODEL_LABEL_SQL} end, {sql_label_intent('d.text')}, '{P.RESIDUAL}') as final_label
from documents d left join labels l on d.doc_id = l.doc_id""")
def r10_gap_fill(spark, d):
    j = tb(spark, d, "documents").join(model_labels(spark, d), "doc_id", "left")
    return j.select("doc_id", R.gap_fill("model_label", R.label_intent("text")).alias("final_label"))


@register("u3_sorted_union", f"""
select p.conv_id, p.q_turn, array_to_string({sql_overrides('customer_text', "'billing_account'")}, ',') as labels from {SQL_PAIRS} p""")
def u3_sorted_union(spark, d):
    p = TH.adjacent_pairs(tb(spark, d, "conversations"))
    return p.select("conv_id", "q_turn",
                    F.array_join(R.check_overrides("customer_text", F.lit("billing_account")), ",").alias("labels"))


SQL_VERSIONS = "regexp_extract_all({f}, '\\b\\d{{1,2}}\\.\\d(\\.\\d)?\\b')"


def sql_unsupported(draft, grounding):
    g = f"lower(coalesce({grounding}, ''))"
    paths = (f"list_transform(list_filter(regexp_extract_all({draft}, {q(re2(P.SETTINGS_PATH))}), "
             f"lambda m: length({strip('m')}) > 0 and not contains({g}, lower({strip('m')}))), lambda m: 'path:' || {strip('m')})")
    vers = (f"list_transform(list_filter({SQL_VERSIONS.format(f=fold(draft))}, lambda v: not contains({g}, v)), "
            f"lambda v: 'version:' || v)")
    feats = (f"list_transform(list_filter({arr(P.FEATURES)}, lambda f: contains(lower({draft}), lower(f)) and not contains({g}, lower(f))), "
             f"lambda f: 'feature:' || f)")
    return f"list_sort(list_distinct(list_concat({paths}, {vers}, {feats})))"


@register("x13_unsupported_claims", f"""
select conv_id, q_turn, array_to_string(u, '|') as unsupported from (
  select conv_id, q_turn, {sql_unsupported('brand_text', 'customer_text')} as u from {SQL_PAIRS} p) where len(u) > 0""")
def x13_unsupported_claims(spark, d):
    p = TH.adjacent_pairs(tb(spark, d, "conversations"))
    u = T.unsupported_specifics("brand_text", "customer_text")
    return p.select("conv_id", "q_turn", u.alias("u")).filter(F.size("u") > 0) \
        .select("conv_id", "q_turn", F.array_join("u", "|").alias("unsupported"))


@register("u4_sorted_findings", f"""
select conv_id, q_turn, array_to_string({sql_unsupported('customer_text', 'brand_text')}, '|') as findings from {SQL_PAIRS} p""")
def u4_sorted_findings(spark, d):
    p = TH.adjacent_pairs(tb(spark, d, "conversations"))
    return p.select("conv_id", "q_turn",
                    F.array_join(T.unsupported_specifics("customer_text", "brand_text"), "|").alias("findings"))


@register("u5_no_function_words", f"""
select lang, count(*) filter (where not list_has_any({sql_tokens('text')}, {arr(P.ENGLISH_FW)}))::bigint as no_fw, count(*)::bigint as n
from documents group by lang""")
def u5_no_function_words(spark, d):
    fw = F.array(*[F.lit(w) for w in P.ENGLISH_FW])
    return tb(spark, d, "documents").groupBy("lang").agg(
        F.count_if(~F.arrays_overlap(T.word_tokens("text"), fw)).alias("no_fw"), F.count(F.lit(1)).alias("n"))


@register("x9_bug_keyword", f"""select count(*) filter (where {rmatch('text', P.BUG)})::bigint as bug_kw, count(*)::bigint as n from conversations""")
def x9_bug_keyword(spark, d):
    return tb(spark, d, "conversations").agg(F.count_if(T.has_bug_keyword("text")).alias("bug_kw"),
                                             F.count(F.lit(1)).alias("n"))


@register("f8_provenance_split", f"""
select provenance, count(*)::bigint as n, round(avg((l.quality = 1)::int), 6) as quality_rate
from (select d.doc_id, case when {sql_oos_kind('d.text')} is not null then 'circular' else 'independent' end as provenance
      from documents d) x join labels l on x.doc_id = l.doc_id group by provenance""")
def f8_provenance_split(spark, d):
    docs = tb(spark, d, "documents").select("doc_id", F.when(R.oos_kind("text").isNotNull(), "circular")
                                            .otherwise("independent").alias("provenance"))
    j = docs.join(tb(spark, d, "labels"), "doc_id")
    return j.groupBy("provenance").agg(F.count(F.lit(1)).alias("n"),
                                       F.round(F.avg((F.col("quality") == 1).cast("int")), 6).alias("quality_rate"))


# ---------------------------------------------------------------------------
# Evaluation over documents.lang (true label) with the R2 prediction
# ---------------------------------------------------------------------------
LANG_CLASSES = [("english", 0.55), ("non_english", 0.45)]   # ordered domain + production prevalence


def lang_predictions(spark, d):
    docs = texts(spark, d, "doc_id", "source", "lang", "text")
    return docs.select("doc_id", "source",
                       F.when(F.col("lang") == "en", "english").otherwise("non_english").alias("truth"),
                       F.when(R.is_non_english("text"), "non_english").otherwise("english").alias("pred"))


SQL_PRED = f"""(select doc_id, source, case when lang = 'en' then 'english' else 'non_english' end as truth,
  case when {sql_is_non_english('text')} then 'non_english' else 'english' end as pred from documents)"""
SQL_DOMAIN = "(select * from (values " + ", ".join(
    f"('{k}', {i}, {w}::double)" for i, (k, w) in enumerate(LANG_CLASSES)) + ") t(cls, ord, prod_share))"


def lang_domain(spark):
    return spark.createDataFrame([(k, i, float(w)) for i, (k, w) in enumerate(LANG_CLASSES)],
                                 "cls string, ord int, prod_share double")


@register("e1_per_class_accuracy", f"""
with p as {SQL_PRED}, tot as (select count(*) as t from p),
g as (select truth, count(*) as n, count(*) filter (where pred = truth) as correct from p group by 1)
select c.cls, coalesce(g.n, 0)::bigint as n, coalesce(g.correct, 0)::bigint as correct,
  round(g.correct / g.n, 6) as accuracy, round(coalesce(g.n, 0) / (select t from tot), 6) as sample_share,
  c.prod_share, round(coalesce(g.n, 0) / (select t from tot) / c.prod_share, 6) as over_sampling
from {SQL_DOMAIN} c left join g on c.cls = g.truth""")
def e1_per_class_accuracy(spark, d):
    return E.per_class(lang_predictions(spark, d), lang_domain(spark)).drop("ord")


@register("e2_e3_blended", f"""
with p as {SQL_PRED}, tot as (select count(*) as t from p),
g as (select truth, count(*) as n, count(*) filter (where pred = truth) as correct from p group by 1),
t as (select c.cls, c.prod_share, g.n, g.correct / g.n as acc from {SQL_DOMAIN} c left join g on c.cls = g.truth)
select round((select avg((pred = truth)::int) from p), 6) as naive,
  round(sum(acc * prod_share) filter (where n > 0) / sum(prod_share) filter (where n > 0), 6) as reweighted from t""")
def e2_e3_blended(spark, d):
    p = lang_predictions(spark, d)
    return E.blended_and_reweighted(p, E.per_class(p, lang_domain(spark)))


@register("e4_confusion", """
with p as """ + SQL_PRED + """ select truth, count(*) filter (where pred = 'english')::bigint as english,
  count(*) filter (where pred = 'non_english')::bigint as non_english,
  count(*) filter (where pred not in ('english', 'non_english'))::bigint as other, count(*) filter (where pred is null)::bigint as none
from p group by truth""")
def e4_confusion(spark, d):
    return E.confusion_matrix(lang_predictions(spark, d), [k for k, _ in LANG_CLASSES])


PRIOR = {"english": 0.6, "non_english": 0.4}


@register("e5_e6_prevalence", f"""
with p as {SQL_PRED},
share as (select pred, count(*) / (select count(*) from p) as s from p group by 1),
conf as (select x.pred, x.truth, count(*) as n from p x join labels l on x.doc_id = l.doc_id group by 1, 2),
cond as (select pred, truth, n / sum(n) over (partition by pred) as pt from conf),
raw as (select c.truth as cls, sum(s.s * c.pt) as v from share s join cond c on s.pred = c.pred group by 1),
prev as (select cls, v / sum(v) over () as prevalence from raw),
prior as (select * from (values {', '.join(f"('{k}', {v}::double)" for k, v in PRIOR.items())}) t(cls, prior))
select prev.cls, round(prevalence, 6) as prevalence, prior.prior, round(100 * (prevalence - prior.prior), 6) as delta_pp
from prev join prior on prev.cls = prior.cls""")
def e5_e6_prevalence(spark, d):
    p = lang_predictions(spark, d)
    checked = tb(spark, d, "labels").select("doc_id").distinct().withColumn("checked", F.lit(True))
    prev = E.corrected_prevalence(p.join(checked, "doc_id", "left"), "checked")
    prior = spark.createDataFrame(list(PRIOR.items()), "cls string, prior double")
    return E.delta_vs(prev, prior)


@register("e7_weighted_kappa", """
with m as (select quality as a, toxic as b from labels where quality is not null and toxic is not null),
lv as (select v, dense_rank() over (order by v) - 1 as idx from (select a as v from m union select b from m)),
k as (select count(*) - 1 as km from lv), n as (select count(*) as n from m),
o as (select a, b, count(*) / (select n from n) as p from m group by 1, 2),
ma as (select a, count(*) / (select n from n) as p from m group by 1),
mb as (select b, count(*) / (select n from n) as p from m group by 1),
wo as (select sum(abs(la.idx - lb.idx) / (select km from k) * o.p) as s from o join lv la on o.a = la.v join lv lb on o.b = lb.v),
we as (select sum(abs(la.idx - lb.idx) / (select km from k) * ma.p * mb.p) as s from ma cross join mb join lv la on ma.a = la.v join lv lb on mb.b = lb.v)
select (select n from n)::bigint as n, round(avg((a = b)::int), 6) as exact, round(avg((abs(a - b) <= 1)::int), 6) as within1,
  round(1 - (select s from wo) / (select s from we), 6) as kappa_w, round(avg(a), 6) as mean_a, round(avg(b), 6) as mean_b,
  round(avg(a) - avg(b), 6) as bias from m""")
def e7_weighted_kappa(spark, d):
    lab = tb(spark, d, "labels")
    return E.rater_agreement(lab.select(F.col("quality").alias("a"), F.col("toxic").alias("b")), "a", "b")


@register("e8_second_pass", f"""
with p as (select lang, {sql_is_non_english('text')} as first, {sql_looks_non_english('text')} as second from documents)
select lang, count(*)::bigint as n, round(avg((first = second)::int), 6) as agree from p group by rollup(lang)""")
def e8_second_pass(spark, d):
    docs = tb(spark, d, "documents").select("lang", R.is_non_english("text").alias("first"),
                                            R.looks_non_english("text").alias("second"))
    return E.concordance(docs, "first", "second", "lang")


@register("e10_cross_check", f"""
select ({sql_oos_kind('d.text')} is not null or {rmatch('d.text', r'licen[cs]e|copyright|spdx')}) as flagged,
  count(*)::bigint as n, round(avg(l.quality), 6) as mean_quality
from documents d join labels l on d.doc_id = l.doc_id group by 1""")
def e10_cross_check(spark, d):
    docs = tb(spark, d, "documents")
    flag = R.oos_kind("text").isNotNull() | R.matches("text", r"licen[cs]e|copyright|spdx")
    j = docs.select("doc_id", flag.alias("flagged")).join(tb(spark, d, "labels"), "doc_id")
    return E.flagged_mean(j, "flagged", "quality")


@register("e11_detector_precision", f"""
with p as {SQL_PRED}
select source, count(*) filter (where pred = 'non_english')::bigint as flagged,
  count(*) filter (where pred = 'non_english' and truth = 'non_english')::bigint as accepted,
  round(count(*) filter (where pred = 'non_english' and truth = 'non_english') / nullif(count(*) filter (where pred = 'non_english'), 0), 6) as precision
from p group by source""")
def e11_detector_precision(spark, d):
    return E.detector_precision(lang_predictions(spark, d), "source", "pred", "truth", "non_english")


@register("e12_rule_counters", f"""
with x as (select d.text, {MODEL_LABEL_SQL} as lab, {sql_resolve('d.text', MODEL_LABEL_SQL)} as fin
           from documents d join labels l on d.doc_id = l.doc_id)
select count(*) filter (where {sql_real_words('text')} <= {P.THIN_MAX_WORDS})::bigint as thin,
  count(*) filter (where lab = 'ios_version_downgrade' and fin = '{P.RESIDUAL}' and {sql_real_words('text')} > {P.THIN_MAX_WORDS})::bigint as downgrade_rejected,
  count(*) filter (where {sql_looks_non_english('text')})::bigint as non_english_rule,
  count(*) filter (where fin = '{P.OUT_OF_SCOPE}')::bigint as rerouted from x""")
def e12_rule_counters(spark, d):
    j = tb(spark, d, "documents").join(model_labels(spark, d), "doc_id")
    j = j.withColumn("final", R.resolve("text", "model_label"))
    return E.rule_counters(j, "text", "model_label", "final")


@register("t4_weakest_class", f"""
with p as {SQL_PRED},
g as (select truth, count(*) as n, count(*) filter (where pred = truth) / count(*) as acc from p group by 1)
select c.cls, g.n::bigint as n, round(g.acc, 6) as accuracy from {SQL_DOMAIN} c join g on c.cls = g.truth
where g.n > 0 order by g.acc, c.ord limit 1""")
def t4_weakest_class(spark, d):
    tbl = E.per_class(lang_predictions(spark, d), lang_domain(spark))
    return tbl.filter(F.col("n") > 0).orderBy("accuracy", "ord").limit(1).select("cls", "n", "accuracy")


@register("a10_override_counts", f"""
select item, count(*)::bigint as n from (select unnest({sql_overrides('text', sql_label_intent('text'))}) as item from documents) group by item""")
def a10_override_counts(spark, d):
    from ..operators import aggregates as A
    docs = texts(spark, d, "text").select("text", R.label_intent("text").alias("intent"))
    return A.explode_count(docs, R.check_overrides("text", F.col("intent")), "item")
