"""Problems 7 to 9: encoding, leaks and languages."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveloom.llm import contamination as K
from sieveloom.llm import encode as E
from sieveloom.llm import language as L
from sieveloom.llm.words import words

needs_vocabulary = pytest.mark.skipif(not os.path.exists(E.DEFAULT_FILE), reason="no vocabulary")
HARD = ["", " ", "\n\n  x", "it's we'll they'd I'm", "a  b   c\t\n", "３．１４ ｱｲｳ", "漢字かな交じり文", "한국어 문장입니다.", "👩‍🔬🔍", "<|endoftext|> <s>", "e\u0301é", "\u200b\ufeff", "x" * 500, "!?" * 300, "1234567890" * 40, " " * 99, "don''s 's", "\u2028\r\n", "ß" * 33 + "'s" * 20]


# ---- 7 ------------------------------------------------------------------------------------------


@needs_vocabulary
class TestEncoding:
    @pytest.fixture(scope="class")
    def vocabulary(self):
        with open(E.DEFAULT_FILE, "rb") as f:
            return E.Vocabulary(f.read())

    @pytest.fixture(scope="class")
    def reference(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(E.DEFAULT_FILE)
        t.encode_special_tokens = True
        return lambda s: t.encode(s, add_special_tokens=False).ids

    @pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
    def test_same_ids_in_any_pieces(self, vocabulary, reference, chunk):
        for t in HARD:
            assert E.Encoder(vocabulary).encode(t, chunk) == reference(t)

    def test_long_runs_keep_a_bounded_rest(self, vocabulary, reference):
        rng = random.Random(5)
        for alphabet in ("aeiounrst", "x", "漢字", " ", "-'", "01"):
            text = "".join(rng.choice(alphabet) for _ in range(12_000))
            enc, out, most = E.Encoder(vocabulary), [], 0
            for i in range(0, len(text), 100):
                out += enc.feed(text[i : i + 100])
                most = max(most, len(enc.rest))
            assert out + enc.finish() == reference(text)
            assert most <= 4 * vocabulary.lookahead + 200

    @pytest.mark.parametrize("unit", ["'", "'''-", " '"])
    def test_apostrophes_keep_a_bounded_rest(self, vocabulary, reference, unit):
        text = unit * (1_000_000 // len(unit)) + "'s it's"
        enc, out, most = E.Encoder(vocabulary), [], 0
        for i in range(0, len(text), 5000):
            out += enc.feed(text[i : i + 5000])
            most = max(most, len(enc.rest))
        assert out + enc.finish() == reference(text) and most <= 4 * vocabulary.lookahead + 5000

    def test_decoder_waits_for_whole_characters(self, vocabulary):
        d = E.Decoder(vocabulary)
        ids = [vocabulary.byte_id[b] for b in "é好".encode()]
        assert [d.feed([i]) for i in ids] == ["", "é", "", "", "好"] and d.finish() == ""
        assert d.feed([vocabulary.byte_id[0xE5]]) == "" and d.finish() == "\ufffd"

    def test_columns_and_round_trip(self, spark, reference):
        texts = [*HARD, None]
        df = spark.createDataFrame([(i % 5 if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
        got = [(r["doc_id"], r["ids"]) for r in E.encode_column(df, "doc_id", "text").collect()]
        assert sorted(map(str, got)) == sorted(str((i % 5 if i else None, reference(t) if t else [])) for i, t in enumerate(texts))
        keyed = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        back = {r["doc_id"]: r["text"] for r in E.decode_column(E.encode_column(keyed, "doc_id", "text"), "doc_id", "ids").collect()}
        assert back == {i: t or "" for i, t in enumerate(texts)}
        assert E.encode_column(df.limit(0), "doc_id", "text").count() == 0


# ---- 8 ------------------------------------------------------------------------------------------

ITEM = "Crop FF-7296 spans 600 by 7505 px and overlaps mask FV-5876 by 3.35 percent after a shift of 730 px today."


def variants(ws):
    yield " ".join(ws)
    yield " ".join(ws).upper()
    yield "\u200b  ".join(ws)
    yield "\n> ".join(ws)
    yield " ".join(f"**{w}**" for w in ws)
    yield " ".join(f"<b>{w}</b>" for w in ws)
    yield " | ".join(ws)
    yield "".join(chr(ord(c) + 0xFEE0) if c.isalnum() and c.isascii() else c for c in " ".join(ws))


def test_ten_words_in_any_form_and_nine_not(spark):
    ws = ITEM.split()
    docs, want = [], set()
    for start in (0, 4, len(ws) - 10):
        for v in variants(ws[start : start + 10]):
            want.add(len(docs))
            docs.append((len(docs), f"Some words before it, {v} and words after.", "x"))
        docs.append((len(docs), f"Some words before it, {' '.join(ws[start : start + 9])} quite other words", "x"))
    edited = " ".join(w if i % 6 else "changed" for i, w in enumerate(ws))
    docs += [(len(docs), edited, "x"), (len(docs) + 1, None, "x"), (len(docs) + 2, "", "x"), (len(docs) + 3, " \n", "x"), (None, ITEM, "x")]
    docs.append((900, "word " * 50_000 + ITEM + " end" * 50_000, "x"))
    want.add(900)
    df = spark.createDataFrame(docs, "doc_id long, text string, words string")
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    got = {r["doc_id"]: r for r in K.leaks(df, items).collect()}
    assert {d for d, r in got.items() if r["words"] >= 10} == want
    assert got[0]["share"] > 0.4 and got[900]["share"] == 1.0
    assert K.leaks(df.limit(0), items).count() == 0 and K.leaks(df, items.limit(0)).count() == 0


def test_leaks_match_brute_force(spark):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(25))) for i in range(12)]
    docs = []
    for i in range(150):
        body = [rng.choice(pool) for _ in range(40)]
        if i % 3 == 0:
            src, n = rng.choice(items)[1].split(), rng.randint(7, 13)
            a, b = rng.randrange(25 - n), rng.randrange(30)
            body[b:b] = src[a : a + n]
        docs.append((i, " ".join(body)))
    want = {(d, i) for d, t in docs for i, x in items if any(f" {' '.join(x.split()[k : k + 10])} " in f" {t} " for k in range(16))}
    got = K.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect() if r["words"] >= 10} == want and want


def test_edited_copies_are_found(spark):
    """A word in seven changed, dropped or added: nine in ten copies and more come out, unrelated texts don't."""
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(30))) for i in range(40)]
    docs, want = [], set()
    for i in range(400):
        body = [rng.choice(pool) for _ in range(60)]
        if i % 2:
            k, copy = rng.randrange(40), []
            for j, w in enumerate(items[k][1].split()):
                edit = rng.choice("cda") if j % 7 == i % 7 else ""
                copy += {"c": [rng.choice(pool)], "d": [], "a": [w, rng.choice(pool)], "": [w]}[edit]
            body[20:20] = copy
            want.add((i, k))
        docs.append((i, " ".join(body)))
    got = {(r["doc_id"], r["item_id"]) for r in K.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(K, "BITS", (64, 64))
    items = spark.createDataFrame([(i, " ".join(f"t{i}x{j}" for j in range(40))) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "before it " + " ".join(f"t{i}x{j}" for j in range(12)) + " and after") for i in range(30)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["words"]) for r in K.leaks(docs, items).collect()} == {(i, i, 12) for i in range(30)}


def test_alignment_by_definition():
    def slow(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (K.MATCH if a[i - 1] == b[j - 1] else K.MISMATCH), h[i - 1, j] + K.GAP, h[i, j - 1] + K.GAP)
        return h.max()

    rng = np.random.default_rng(0)
    for _ in range(30):
        a, bs = rng.integers(0, 4, rng.integers(0, 12)), [rng.integers(0, 4, rng.integers(0, 15)) for _ in range(5)]
        for cells in (1, 40, 1 << 19):
            assert K.smith_waterman(a, bs, cells).tolist() == [slow(a, b) for b in bs]


def test_words():
    assert words("Ｆｕｌｌ-Width <b>Bold</b> a&amp;b so\u00adft") == ["full", "width", "bold", "a", "b", "soft"]
    assert words(None) == words("") == []


# ---- 9 ------------------------------------------------------------------------------------------

SAMPLES = "/root/testdata/sf0.001/language_samples.parquet"


def test_label_notations(spark):
    labels = ["en", "EN", "en-US", "en_GB", "eng", "English", "zh-Hans", "kor", "日本語", "xx", "und", "", None, "sv"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(L.label_code(F.col("l"))).collect()] == ["en"] * 6 + ["zh", "ko", "ja"] + [None] * 5


def test_sentences_and_what_is_none():
    t = "Open at 3.14 mm. Next one!\nstill the same line ends here? 次の文。\n- item two of it."
    assert [x for a, b in L.sentences(t) if (x := t[a:b].strip())] == ["Open at 3.14 mm.", "Next one!", "still the same line ends here?", "次の文。", "- item two of it."]
    for none in ("GX-12 4.5 99.", "hairline scratch", "`x = np.clip(a[3], 0, 1)`.", '{"k": 1}', "", "it's we'll they'd I'm you've"):
        assert L.candidates(none) == []


def test_no_text_costs_more_than_its_length():
    import time

    n = 200_000
    for t in ("." * n + "x", "a" * n, "\r" * n + "x", "漢" * n, "a." * n, "<a " * n, "`" * n, "a@" * n, "1" * n, "!" * n + " ", "_" * n):
        began = time.perf_counter()
        L.candidates(t)
        assert time.perf_counter() - began < 5


@pytest.mark.skipif(not os.path.exists(SAMPLES), reason="no test data")
class TestLanguages:
    @pytest.fixture(scope="class")
    def table(self, spark):
        return spark.read.parquet(SAMPLES)

    def test_held_out_sentences(self, table):
        rows = table.collect()
        model = L.fit([(r["lang"], r["text"]) for r in rows if r["sample_no"] % 2])
        pairs = [(r["lang"], s) for r in rows if not r["sample_no"] % 2 for _, s in L.candidates(r["text"])]
        lang, conf = model.classify([s for _, s in pairs])
        right = np.mean([k >= 0 and model.langs[k] == x for k, (x, _) in zip(lang, pairs)])
        assert right > 0.97 and ((conf >= 0) & (conf <= 1)).all()

    def test_other_languages_are_rejected(self, table):
        model = L.fit([(r["lang"], r["text"]) for r in table.collect()])
        foreign = [
            "wczoraj po południu zauważyliśmy nową rysę na powierzchni blachy i zatrzymaliśmy linię",
            "a tegnapi műszakban három új karcolást találtunk a lemez felületén és leállítottuk a gépet",
            "ieri după amiază am observat o zgârietură nouă pe suprafața tablei și am oprit linia",
            "eilen iltapäivällä huomasimme uuden naarmun levyn pinnassa ja pysäytimme linjan",
            "dün öğleden sonra sacın yüzeyinde yeni bir çizik fark ettik ve hattı durdurduk",
            "вчера после обеда мы заметили новую царапину на поверхности листа",
            "xkq zvbt wplr mnjd ghtr qzxv bnmk lkjh",
        ]
        lang, conf = model.classify(foreign)
        assert lang.tolist() == [-1] * len(foreign) and not conf.any()

    def test_all_centroids_are_compared_in_any_company(self, table):
        rows = table.collect()
        model = L.fit([(r["lang"], r["text"]) for r in rows])
        texts = [s for r in rows for _, s in L.candidates(r["text"])][:60]
        sid, h, w = model.vectors(texts)
        dense = np.zeros((len(texts), 1 << L.BITS), dtype=np.float32)
        dense[sid, h] = w
        want = np.stack([(dense @ model.centroids)[:, model.lang_of == k].max(axis=1) for k in range(len(model.langs))], axis=1)
        assert np.allclose(model.cosines(texts), want, atol=1e-5) and np.allclose(model.cosines(texts, most=7, letters=90), want, atol=1e-5)

    def test_a_language_more(self, spark, table):
        sv = ["Operatören stoppade bandet och skrev in stoppet i loggen.", "Provet visade en spricka som följer kanten på plåten.", "Vi bytte lampan igår men bilden är fortfarande för mörk."]
        more = table.select("lang", "text").unionByName(spark.createDataFrame([("sv", x) for x in sv], "lang string, text string"))
        langs = L.known(more)
        df = spark.createDataFrame([("sv",), ("sv-SE",), ("English",), ("xx",)], "l string")
        assert [r[0] for r in df.select(L.label_code(F.col("l"), langs)).collect()] == ["sv", "sv", "en", None]
        docs = spark.createDataFrame([(1, sv[0], "sv")], "doc_id long, text string, lang string")
        assert [r["langs"] for r in L.detect(docs, more).collect()] == [["sv"]]

    def test_documents(self, spark, table):
        de = "Der Hintergrund ist zu unruhig, deshalb wirkt eine offene Pore dort nicht glaubwürdig."
        en = "We decided to lower the line speed after 510 false alarms in one hour."
        ja = "候補は732個ありましたが、本当の欠陥はわずかでした。"
        docs = [(1, en, "de"), (2, f"{de} {en}", "de"), (3, f"{en} (Rostfleck) `{de}`", "en"), (4, None, "en"), (5, "", None), (6, "12 AB-3 4.5", "und"), (7, f"{ja}{ja}", None), (8, f"- {de}\n- {ja}\n{en}", "x"), (None, de, "de"), (9, (en + " ") * 3000 + de, "en")]
        out = L.detect(spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, lang string, langs string"), table)
        got = {r["doc_id"]: r for r in out.collect()}
        assert {k: r["langs"] for k, r in got.items()} == {1: ["en"], 2: ["de", "en"], 3: ["en"], 4: [], 5: [], 6: [], 7: ["ja"], 8: ["de", "en", "ja"], None: ["de"], 9: ["de", "en"]}
        p = got[2]["passages"]
        assert docs[1][1][p[0]["start"] : p[0]["end"]] == de and p[1]["lang"] == "en"
        assert got[9]["lang"] == "en" and got[4]["lang"] is None and got[4]["confidence"] == 0
        assert L.detect(spark.createDataFrame([], "doc_id long, text string, lang string"), table).count() == 0
