"""Expression-level tests: one example per rule class, own strings."""
from pyspark.sql import functions as F

from conftest import eval1, evalmany
from parley.functions import rules as R
from parley.functions import text as T
from parley.functions import patterns as P


def test_bug_keyword_anchor(spark):
    pos = ["I️ can't type", "my keyboard is odd", "autocorrect broke", "the letter 'i' turns weird",
           "a question mark box appears", "since 11.1.1"]
    neg = ["love it ❤️", "great ☺️ day", "new phone", "typing is fine"]
    assert all(evalmany(spark, T.has_bug_keyword, pos))
    assert not any(evalmany(spark, T.has_bug_keyword, neg))


def test_resolution_types_one_per_class(spark):
    cases = {
        "Our billing support folks can sort this out for you.": "other_channel_redirect",
        "Please see https://help.example.com/x and DM us after.": "answer_with_dm_followup",
        "Steps are listed at https://help.example.com/steps": "self_contained_answer",
        "Send us a DM and we'll continue there.": "dm_handoff",
        "https://t.co/GDrqU22YpT": "dm_handoff",
        "Which model are you using right now?": "clarifying_question",
        "Open Settings and switch the option off, then check again.": "self_contained_answer",
        "Thanks for reaching out.": "other",
    }
    got = evalmany(spark, R.resolution_type, list(cases))
    assert got == list(cases.values())


def test_team_up_is_not_a_redirect(spark):
    got = evalmany(spark, R.resolution_type, ["Our devices team up nicely with cases?"])
    assert got == ["clarifying_question"]


def test_dm_link_with_trailing_punctuation_is_content(spark):
    got = evalmany(spark, R.resolution_type, ["see https://t.co/GDrqU22YpT."])
    assert got == ["self_contained_answer"]


def test_anonymize_query_returns_every_document(spark):
    from conftest import SF001
    from parley.plans.registry import QUERIES
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(QUERIES["x1_anonymize_all"](spark, SF001)) == ids(spark.read.parquet(f"{SF001}/documents.parquet"))


def test_anonymize(spark):
    df = spark.createDataFrame([("hi @Acme and @778899, cc @someone!  ok ",)], "t string")
    out = df.select(T.anonymize("t", "778899", ["Acme", "AcmeHelp"]).alias("o")).first()["o"]
    assert out == "hi @BRAND and @BRAND, cc @USER! ok"


def test_window_inclusive(spark):
    df = spark.sql("""select * from values
        (timestamp'2017-11-02 00:00:00'), (timestamp'2017-11-12 23:59:59'),
        (timestamp'2017-11-01 23:59:00'), (timestamp'2017-11-13 00:00:00') as t(ts)""")
    got = [r[0] for r in df.select(T.in_window("ts")).collect()]
    assert got == [True, True, False, False]


def test_incident_tag_or(spark):
    df = spark.sql("select * from values (true,false),(false,true),(false,false) as t(k,w)")
    got = [r[0] for r in df.select(T.incident_tag(F.col("k"), F.col("w"))).collect()]
    assert got == [P.INCIDENT_TAG, P.INCIDENT_TAG, None]


def test_first_pass_intents(spark):
    cases = {
        "how can I downgrade to the old one": "ios_version_downgrade",
        "my battery dies by noon": "battery_drain",
        "I was charged twice for the subscription": "billing_account",
        "the camera app keeps crashing": "software_feature_defect",
        "apple pay is great": "general_complaint_nonactionable",
        "this is so annoying": "general_complaint_nonactionable",
        "hola necesito ayuda con mi telefono": "non_english",
    }
    assert evalmany(spark, R.label_intent, list(cases)) == list(cases.values())


def test_apple_pay_masked_before_billing(spark):
    assert evalmany(spark, R.label_intent, ["apple pay wont open"]) == ["software_feature_defect"]


def test_thin_and_real_words(spark):
    thin = ["@BRAND @USER https://t.co/abc", "@BRAND fix it now please ok",
            "Wow! https://x.y/z #tag"]
    not_thin = ["@BRAND the screen flickers after every single update I install"]
    assert all(evalmany(spark, T.is_thin, thin))
    assert not any(evalmany(spark, T.is_thin, not_thin))
    assert evalmany(spark, T.real_words, ["@BRAND @USER https://t.co/abc #Phone"]) == [0]
    # boundary: 6 words thin, 7 not
    assert evalmany(spark, T.is_thin, ["aa bb cc dd ee ff", "aa bb cc dd ee ff gg"]) == [True, False]


def test_looks_non_english(spark):
    foreign = ["la actualizacion acabo con mi telefono digan que hacer",
               "Здравствуйте у меня проблема",
               "アップデート"]
    english = ["what should I do about this charge ؟؟",
               "FIX YOUR COMPASS",
               "it won’t load and I don’t know why",
               "let me go back to version ten plz"]
    assert all(evalmany(spark, R.looks_non_english, foreign))
    assert not any(evalmany(spark, R.looks_non_english, english))


def test_resolve_precedence(spark):
    df = spark.createDataFrame([
        ("@BRAND @USER https://t.co/x", "non_english", P.RESIDUAL),
        ("@BRAND ME AJUDA POR FAVOR AGORA MESMO", P.RESIDUAL, "non_english"),
        ("can I downgrade my tablet to the earlier version", "ios_version_downgrade", "ios_version_downgrade"),
        ("please send a new update for my old phone soon", "ios_version_downgrade", P.RESIDUAL),
        ("I think this offer is a scam and you should know", "non_english", P.OUT_OF_SCOPE),
        ("my messages app keeps crashing since the update", "battery_drain", "battery_drain"),
    ], "t string, l string, want string")
    for r in df.select(R.resolve("t", "l").alias("got"), "want").collect():
        assert r.got == r.want


def test_overrides(spark):
    got = evalmany(spark, R.check_overrides, [
        "the back has gone black", "stop charging me for nothing", "is this a scam email?",
        "my messages app keeps crashing"])
    assert got == [["physical_or_hardware"], ["account_or_payment_action"],
                   ["phishing_or_scam"], []]
    df = spark.createDataFrame([("the screen is cracked", "billing_account")], "t string, i string")
    assert df.select(R.check_overrides("t", "i")).first()[0] == [
        "account_or_payment_action", "physical_or_hardware"]


def test_unsupported_specifics(spark):
    df = spark.createDataFrame([
        ("Open Settings > Display. Then update to 12.1", "open settings > display"),
        ("Try Low Power Mode", "low power mode helps"),
    ], "d string, g string")
    got = [r[0] for r in df.select(T.unsupported_specifics("d", "g")).collect()]
    assert got[0] == ["version:12.1"]
    assert got[1] == []
    df2 = spark.createDataFrame([("Open Settings > Battery now", "nothing")], "d string, g string")
    assert df2.select(T.unsupported_specifics("d", "g")).first()[0] == ["path:Settings > Battery now"]


def test_quality_flags_and_era(spark):
    long = "x" * 400
    assert evalmany(spark, T.quality_flags, [long, "Let's draft a reply", "ok"]) == [
        ["over_length:400"], ["narration"], []]
    assert evalmany(spark, T.term_hits, ["check Settings > Battery > Battery Health"]) == [["Battery Health"]]
    tmpl = P.TEMPLATES["battery_drain"]
    assert evalmany(spark, T.term_hits, [tmpl]) == [[]]
    assert evalmany(spark, T.has_link, [tmpl, "see https://t.co/x"]) == [False, True]
    assert len(tmpl) <= P.MAX_CHARS


def test_parse_label_and_scores(spark):
    assert evalmany(spark, T.parse_label, ["  Battery_Drain. ", "I think `out_of_scope`", "dunno"]) == [
        "battery_drain", "out_of_scope", None]
    df = spark.createDataFrame([('{"relevance": 4.5, "groundedness": "2", "tone": 9, "correctness": null, "justification": "ok"}',),
                                ('Sure! {"relevance": 3, "tone": 5} trailing',), ("garbage",)], "r string")
    rows = df.select(T.lenient_scores("r").alias("s")).select("s.*").collect()
    assert (rows[0].relevance, rows[0].groundedness, rows[0].tone, rows[0].correctness) == (4, 2, None, None)
    assert (rows[1].relevance, rows[1].tone) == (3, 5)
    assert rows[2].relevance is None


def test_tweet_time_and_flags(spark):
    df = spark.createDataFrame([("Tue Oct 31 22:10:47 +0100 2017", " True "), ("bad", "false")], "c string, f string")
    rows = df.select(T.parse_tweet_time("c").cast("string").alias("ts"), T.text_flag("f").alias("b")).collect()
    assert rows[0].ts == "2017-10-31 21:10:47" and rows[0].b is True
    assert rows[1].ts is None and rows[1].b is False


def test_normalize_keeps_inner_double_spaces(spark):
    assert evalmany(spark, T.normalize_for_dedup, ["Hi @USER -- see https://x.y  NOW!"]) == ["hi   see now"]


def test_rule_table_version_stable():
    assert R.FIRST_PASS.version() == R.FIRST_PASS.version()
    assert len(R.FIRST_PASS.version()) == 16


def test_grouped_patterns_match_the_same_texts(spark):
    import random
    import re

    rnd = random.Random(1)
    table = {n: getattr(P, n) for n in ("DOWNGRADE", "BILLING", "SYMPTOM", "COMPONENT", "FOREIGN", "REDIRECT", "INSTRUCT", "BLIND", "DOWNGRADE_EVIDENCE")}
    table |= dict(P.OVERRIDES) | dict(P.OOS_KINDS) | {"odd": r"ab?|a|[|)]x|\bcat|\b(do|dot)\b|x+y|\|z|(?:ab|ac)?d"}
    pieces = sorted({w for p in table.values() for w in re.findall(r"[\w']+", p)} | set("abcdoty.?|)ıİſ") | {"don't", "per favore", "c'est"})
    texts = ["".join(rnd.choice(pieces).upper() if rnd.random() < 0.1 else rnd.choice(pieces) + rnd.choice([" ", "", " ", "-"]) for _ in range(rnd.randint(0, 4)))
             for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = {n: F.count_if(F.col("t").rlike(P.ci(p)) != F.col("t").rlike(P.ci(P.grouped(p)))) for n, p in table.items()}
    wrong["count"] = F.count_if(F.regexp_count("t", F.lit(P.ci(P.FOREIGN))) != R.foreign_hits("t"))
    assert not any(df.select(*[c.alias(f"c{i}") for i, c in enumerate(wrong.values())]).first())
    # first letters are shared: far fewer alternatives are tried at each place
    assert len(P._alternatives(P.grouped(P.SYMPTOM))) * 2 < len(P._alternatives(P.SYMPTOM))


def test_cascades_over_one_row_group_run_in_many_tasks(spark, scratch):
    from parley.plans.catalog import texts
    rows = [(i, "the battery drains" if i % 2 else "où est ma facture") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{scratch}/documents.parquet")
    df = texts(spark, scratch, "doc_id", "text")
    assert df.rdd.getNumPartitions() >= 8
    assert sorted(map(tuple, df.collect())) == rows
