"""Quality classifier, chat formatting, language ID, decontamination, BPE, the pipeline."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import corpus, hard_rows, near, sha
from llm_helpers import frame, rows_of  # noqa: F401
from pyspark.sql import functions as F

from parley.llm import bpe_prefix, chat, common, ecoc, importance, queries, templates

SF = "/root/testdata/sf0.01"
BPE = f"{queries.TOKENIZERS}/word_bpe_49k.json"


# quality classifier

def quality_rows(seed=1, n=600):
    rnd = random.Random(seed)
    vocab = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(6):
                w.insert(rnd.randrange(len(w)), "dreck")
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_classifier_rejects_bad_and_keeps_clean(spark, frame):
    rows, labels = quality_rows()
    l = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in importance.classify(frame(rows), l).collect()}
    assert kept == {i for i, _ in rows if i % 5}
    assert {r["doc_id"] for r in importance.select(frame(rows), l).collect()} == kept


def test_gumbel_top_k_takes_exactly_k(spark):
    rnd = random.Random(2)
    keys = [rnd.gauss(0, 5) for _ in range(3000)] + [1.5] * 40
    df = spark.createDataFrame([(k,) for k in keys], "key double")
    order = sorted(keys, reverse=True)
    for k in (1, 2, 17, 1000, 2999, 3040):
        assert importance.kth_key(df, k) == order[k - 1]
    assert importance.kth_key(df, 0) == float("inf")


def test_classifier_edges(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = frame(hard_rows())
    assert importance.select(df, none).count() == df.count()  # nothing is known: all stay
    assert importance.select(df, none).columns == df.columns
    assert importance.classify(spark.createDataFrame([], df.schema), none).count() == 0


def test_classifier_on_given_labels(spark):
    d, l = (queries.table(spark, SF, t) for t in ("documents", "labels"))
    kept = importance.classify(d, l).select("doc_id")
    clean = l.filter("quality = 1 and toxic = 0")
    bad = l.filter("quality = 0 or toxic = 1")
    assert clean.join(kept, "doc_id", "left_anti").count() == 0
    assert bad.join(kept, "doc_id", "left_anti").count() > 0.7 * bad.count()


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_classifier_keeps_clean_at_any_size(spark, sf):
    d, l = (queries.table(spark, sf, t) for t in ("documents", "labels"))
    l = l.filter("quality is not null and toxic is not null")
    clean, bad = l.filter("quality = 1 and toxic = 0").select("doc_id"), l.filter("quality = 0 or toxic = 1").select("doc_id")
    kept = {r["doc_id"] for r in importance.classify(d, l).select("doc_id").collect()}
    good = {r["doc_id"] for r in clean.collect()}
    assert len(good - kept) <= 0.001 * len(good)
    bad = {r["doc_id"] for r in bad.collect()}
    assert len(bad - kept) > 0.7 * len(bad)
    # documents whose labels the fit does not see
    seen = importance.classify(d, l.filter("doc_id % 2 = 0")).select("doc_id")
    kept = {r["doc_id"] for r in seen.collect()}
    assert len(good - kept) <= 0.01 * len(good)


def test_noise_lifts_no_row_over_a_higher_level():
    import numpy as np
    noise = np.arange(200_000)
    low, high = importance._key(np.full(len(noise), -0.01), noise), importance._key(np.zeros(len(noise)), noise)
    assert low.max() < high.min()


def test_noise_draws_rows_of_the_boundary_level(spark, frame, monkeypatch):
    """Below the cut stay as many rows as good ones are expected there; the noise says which."""
    rows, labels = quality_rows(n=8000)
    l = spark.createDataFrame(labels[::4], "doc_id long, quality int, toxic int")
    bad = " ".join(["dreck"] * 9)
    docs = frame([(i, t if i % 5 else bad) for i, t in rows])
    clean, drawn = {i for i, _ in rows if i % 5}, []
    key = importance._key
    for seed in (0, 1):
        monkeypatch.setattr(importance, "_key", lambda s, noise, seed=seed: key(s, noise + seed))
        kept = {r["doc_id"] for r in importance.classify(docs, l).collect()}
        assert clean <= kept and len(kept) - len(clean) == int(importance.MAX_LOSS * len(clean)) == 6
        assert {r["doc_id"] for r in importance.select(docs, l).collect()} == kept
        drawn.append(kept - clean)
    assert drawn[0] != drawn[1]


def test_texts_go_to_python_in_small_batches(spark, frame):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows, labels = quality_rows(n=3000)
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs, before = frame(rows).coalesce(1), spark.conf.get(common.BATCH)
    try:
        for chosen, most in (("10000", common.BATCH_ROWS), ("700", 700)):
            spark.conf.set(common.BATCH, chosen)
            importance.select(docs, l)
            got = [r["n"] for r in common.store(docs.mapInArrow(sizes, "n long"), "sizes").collect()]
            assert sum(got) == 3000 and max(got) == most
    finally:
        spark.conf.set(common.BATCH, before)


# chat

def plain_chat(rows):
    out = {}
    low = lambda x: (x is not None, x)
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: tuple((x is not None, x or "" if isinstance(x, str) or x is None else x) for x in r[1:]))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[c] = (len(turns), sha(said.encode()), len(loss), sha(loss.encode()))
    return out


def test_chat_round_trip(spark):
    bad = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", bad), (-1, 1, "assistant", bad), (1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", None),
            (1, 4, "assistant", "x<|im_sep|>y\\"), (2, None, None, "\\<|\\\\|"), (2, 0, "assistant", ""), (None, 0, "we<|im_sep|>ird\n", "<"),
            (3, 5, "user", "tie"), (3, 5, "user", "tie"), (3, 5, "assistant", "|im_end|>\n"), (4, 0, "assistant", "日本\n<|im_end|>\n")]
    rows += [(9, k, "assistant" if k % 3 else "user", "long " * 2000) for k in range(60)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string, pieces string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digest(df).collect()}
    assert got == plain_chat(rows)
    full = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert full[1]["formatted"].startswith("<|im_start|>user<|im_sep|>a<|im_sep|>b<|im_end|>\n<|im_start|>assistant")
    for r in full.values():
        assert "".join(p["text"] for p in r["pieces"]) == r["formatted"]
    assert chat.digest(df.limit(0)).count() == 0


def test_chat_plan_has_no_python(spark):
    plan = queries.op7_chat_formatting(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# language ID

def test_language_held_out_accuracy(spark):
    d = queries.table(spark, SF, "documents")
    got = ecoc.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count() > 100
    assert got.filter("score < 0 or score > 1").count() == 0


def test_code_words_correct_errors():
    for n in (2, 3, 4, 5, 7, 8, 20, 100):
        w = ecoc.code_words(n)
        apart = [(w[i] != w[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= max(1, w.shape[1] // 2)


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, held_out string, score string"
    rows = [(i, ("the cat and dog " if i % 2 else "der hund und katze ") * 5, "en" if i % 2 else "de", "x", "x") for i in range(60)]
    odd = [(100, None, "en", "x", "x"), (101, "", None, "x", "x"), (102, "12 !?", "de", "x", "x"), (None, "der hund und", "de", "x", "x"),
           (103, "the dog " * 50_000, None, "x", "x"), (103, "the dog", None, "x", "x")]
    got = ecoc.identify(spark.createDataFrame(rows + odd, schema)).collect()
    assert len(got) == 66
    said = {}
    for r in got:
        said.setdefault(r["doc_id"], []).append(r)
    assert all(said[i][0]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60))
    assert {said[i][0]["lang_pred"] for i in (100, 101, 102)} == {"und"} and {x["lang_pred"] for x in said[103]} == {"en"}
    assert said[None][0]["lang_pred"] == "de" and not said[None][0]["held_out"]
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    none = ecoc.identify(spark.createDataFrame([(1, "text", None, "", ""), (2, None, None, "", "")], schema)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    one = ecoc.identify(spark.createDataFrame(rows[:1] * 3 + [(2, "hund", "de", "", "")], schema)).collect()
    assert {r["lang_pred"] for r in one} == {"de"}
    assert ecoc.identify(spark.createDataFrame([], schema)).count() == 0


# decontamination

def test_templates(spark):
    item = "A train with 240 seats leaves the old station and then Anna walks 3 km to meet Anna near the quiet harbour."
    moved = item.replace("240", "77").replace("Anna", "Boris").replace("3 km", "12 miles")
    broken = moved.replace("Boris near", "Carla near")
    b = spark.createDataFrame([(1, item, "x"), (2, "too short", "x"), (3, None, "x"), (None, "seven plain words stand alone right here", "x"),
                               (5, item, "x")], "item_id long, text string, block string")
    far = "Some other words come first. "
    rows = [(1, far + item), (2, far * 3 + moved + far), (3, far + item.upper() + far), (4, far + broken), (5, far * 9), (6, None), (7, ""),
            (8, "before seven plain words stand alone right here after"), (None, item), (9, "too short"), (10, far * 20_000 + item)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, items string")
    got = {}
    for r in templates.leaks(df, b).collect():
        got.setdefault(r["doc_id"], {})[r["item_id"]] = (r["n_windows"], r["reparameterised"])
    assert set(got) == {1, 2, 4, 8, None, 10, 3} or set(got) == {1, 2, 4, 8, None, 10}
    assert got[1][1][0] >= 10 and not got[1][1][1] and got[2][1][1] and got[8] == {None: (1, False)}
    assert got[4][1][0] < got[2][1][0]  # windows that hold both names are inconsistent
    assert got[1] == {k: got[1][1] for k in (1, 5)}
    kept = templates.clean(df, b)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - set(got)
    assert templates.leaks(df, b.limit(0)).count() == 0 and templates.leaks(df.limit(0), b).count() == 0


def test_templates_find_exact_text(spark):
    numbers = "What is 12 + 7 * 3 - 4 / 2 + 9 * 5 ?"
    b = spark.createDataFrame([(1, numbers), (2, "What is the capital of France today?"), (3, "Name the largest moon"),
                               (4, "Anna Berg met Carl Dorn and Emil Frank near Graz")], "item_id long, text string")
    rows = [(1, f"Some text. {numbers} More text."), (2, 'She asked, "What is the capital of France today?" Then she left.'),
            (3, "please name the largest moon of all"), (4, "so anna berg met carl dorn and emil frank near graz again"),
            (5, "WHAT IS THE CAPITAL OF FRANCE TODAY"), (6, "what is 13 + 8 * 4 - 5 / 3 + 1 * 6"), (7, "the largest moon has a name")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in templates.leaks(df, b).collect()}
    assert {g[:2] for g in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 2)} and not any(g[3] for g in got)
    assert {r["doc_id"] for r in templates.clean(df, b).collect()} == {6, 7}


def test_templates_flag_names_and_numbers(spark):
    base = "A train with 240 seats leaves the old station and then Anna walks 3 km to meet Anna near the quiet harbour."
    b = spark.createDataFrame([(1, base), (2, "Solve 3x + 7 = 22 for x"), (3, "The shop sold 1,250 jars at 3.5 euros each before Łukasz Čech closed its wide doors")],
                              "item_id long, text string")
    rows = [(1, base.replace("240", "77"), 1), (2, base.replace("km", "kilometres"), 1), (3, base, 1), (4, "now solve 5x + 9 = 34 for x please", 2),
            (5, "so the shop sold 80 jars at 12 euros each before Ann closed its wide doors", 3),
            (6, "so the shop sold 2,000,000 jars at 0.25 euros each before Ann Mary Lee closed its wide doors", 3),
            (7, "A plain text with 240 seats, 3 km and Anna in it, that solves x for 5.", None), (8, ",5.", None), (9, "7", None), (10, "1,", None), (11, "5,", None)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(1)
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in templates.leaks(df, b).collect()}
    assert got == {(d, i): d != 3 for d, _, i in rows if i}


def plain_template(text):
    """The tokens of a text as (type, literal), written out word by word."""
    import re
    out, last = [], None
    for m in re.finditer(r"[^\W_]+", text or ""):
        w, before = m.group(), (text[:m.start()]).rstrip()
        opens = not before or before[-1] in "!.:?" or "\n" in text[len(before):m.start()]
        kind = "number" if any("0" <= c <= "9" for c in w) else "unit" if w.lower() in templates.UNITS else \
            "name" if w[0].isupper() and not opens else ""
        gap = text[last:m.start()] if last else None
        if out and out[-1][0] == kind and ((kind == "number" and gap in (".", ",") and text[last - 1].isdigit() and w[0].isdigit()) or (kind == "name" and gap == " ")):
            out[-1] = (kind, out[-1][1] + gap + w.lower())
        else:
            out.append((kind, w.lower()))
        last = m.end()
    return out


def test_template_recall_of_other_values(spark):
    """Every number of an item gets another value: at least 0.9 of the copies are found, and
    template windows agree with a version written word by word."""
    import re
    b = queries.table(spark, SF, "benchmark").collect()
    copies = []
    for r in b:
        other = re.sub(r"\d+", lambda m: str(int(m.group()) * 3 + 1), r["text"])
        if other != r["text"]:
            copies.append((len(copies), "some words stand before. " + other + " and more follow", r["item_id"]))
    made = [(1000 + k, f"In {k + 3} days {n} pays {k + 10} dollars for {k + 2} kg of rice and then gives {n} the change at home", 10_000)
            for k, n in enumerate(["Ann", "Bo Li", "Čeněk", "Łukasz Maj"] * 50)]
    item = "In 9 days Eve pays 44 dollars for 5 kg of rice and then gives Eve the change at home"
    bench = spark.createDataFrame([(r["item_id"], r["text"]) for r in b] + [(10_000, item)], "item_id long, text string")
    rows = copies + made
    got = {(r["doc_id"], r["item_id"]) for r in templates.leaks(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), bench).collect()}
    assert sum((d, i) in got for d, _, i in rows) >= 0.9 * len(rows) and len(rows) >= 200
    for _, text, _ in rows[::7]:
        data = np.frombuffer(text.encode(), np.uint8)
        _, (literal, kind, _, at) = templates.canonical(data, np.array([0, len(data)]))
        want = plain_template(text)
        assert [{0: "", 1: "number", 2: "name", 3: "unit"}[k] for k in kind.tolist()] == [k for k, _ in want]
        assert len(set(zip(literal.tolist(), want))) == len(set(want)) and at.tolist() == [0, len(want)]


def test_templates_in_blocks(spark, monkeypatch):
    d, b = (queries.table(spark, SF, t) for t in ("documents", "benchmark"))
    whole = rows_of(templates.leaks(d, b))
    monkeypatch.setattr(templates, "BLOCK_TOKENS", 600)
    assert rows_of(templates.leaks(d, b)) == whole


def test_templates_against_brute_force(spark):
    import re
    d, b = (queries.table(spark, SF, t) for t in ("documents", "benchmark"))
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = set()
    for r in b.collect():
        w = tokens(r["text"])
        grams.update(tuple(w[k:k + 10]) for k in range(len(w) - 9))
    want = {r["doc_id"] for r in d.collect() for w in [tokens(r["text"])] if any(tuple(w[k:k + 10]) in grams for k in range(len(w) - 9))}
    assert {r["doc_id"] for r in templates.leaks(d, b).collect()} == want


# BPE

def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BPE)


ODD = ["", " ", None, "Héllo  WORLD's 12 á<|endoftext|> x<|startoftext|>y. 　z 日本 İ ǅ ΑΣ σς é \x1c a\x1cb ½²ª 'sso ''re '",
       "<|endoftext|>" * 3 + "<|end", "a" * 5000, "é" * 300 + "日" * 50, "\x00\x01 ﻿ ​", "zzz " * 40_000, "퟿\U0010ffff é"]


def test_bpe_equals_library(spark):
    rnd = random.Random(1)
    alphabets = [range(32, 127), range(0x180), range(0x3000), range(0x1F300, 0x1F700)]
    texts = ODD + ["".join(chr(rnd.choice(rnd.choice(alphabets))) for _ in range(150)) for _ in range(300)]
    texts += ["".join(rnd.choice("abcdeothein ") for _ in range(200)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (9005, "again"), (9005, "again")]
    lib = library()
    want = {}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (ids, lib.decode(ids, skip_special_tokens=False))
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, ids string, decoded string").repartition(3)
    full = bpe_prefix.encode_decode(df, BPE).collect()
    assert len(full) == len(rows)
    for r in full:
        assert (r["ids"], r["decoded"]) == want[r["doc_id"]]
    for r in bpe_prefix.encode_decode(df, BPE, digest=True).collect():
        ids, text = want[r["doc_id"]]
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe_prefix.encode_decode(df.limit(0), BPE).count() == 0


def test_bpe_word_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe_prefix, "CACHE_WORDS", 10)
    model, lib = bpe_prefix.PrefixBPE(BPE), library()
    cache = ({}, {})
    for _, t in corpus(3, 20, 100):
        ids, _ = bpe_prefix._encoded(model, cache, t)
        assert ids == " ".join(map(str, lib.encode(t, add_special_tokens=False).ids))


# pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    docs = queries.table(spark, SF, "documents")
    labels, bench = (queries.table(spark, SF, t) for t in ("labels", "benchmark"))
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        given = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= given and len(ids) == out.count()
        if k < 4:
            assert out.columns == columns
            assert out.filter("n_chars <> length(text)").count() == 0
        if name == "quality":
            clean = {r["doc_id"] for r in labels.filter("quality = 1 and toxic = 0").collect()}
            assert given & clean <= ids < given
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
            assert ids == {c for _, _, c in near(rows, percent=80)}
        if name == "decontamination":
            assert given - ids == {r["doc_id"] for r in templates.leaks(docs, bench).collect()}
        if name == "bpe":
            assert ids == given
        docs = out
    assert 0 < docs.count() < before


def test_pipeline_without_rows(spark):
    import corpus_pipeline
    docs = queries.table(spark, SF, "documents").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if k < 4 else docs


def test_queries_match_sql(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        got = queries.QUERIES[name](spark, SF)
        cols = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql}) q").fetchall()
        assert rows_of(got.select(cols)) == sorted(want, key=repr), name
