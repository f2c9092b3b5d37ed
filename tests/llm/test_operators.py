"""The training-data operators against brute force, and on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import bpe, extraction, fingerprints, jaccard_join, language_id, licenses, mixing, neighbours, quality, secrets
from paperloom.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"
ODD = [(1, "all rights reserved. CC-BY " * 3, "en", "a", "x"), (2, None, "en", None, "x"), (3, "", None, "b", "x"), (3, "", None, "b", "x"), (4, "12 34!", "fr", "a", "x"), (5, "word " * 40_000, "en", "b", "x"), (None, "No id here.", "en", "a", "x")]
SCHEMA = "doc_id long, text string, lang string, source string, language string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language_held_out_and_mixed(spark, docs):
    got = language_id.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
    model = language_id.fit_language_model(docs)
    by = {r.lang: r.text for r in docs.where("length(text) > 1500").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    a, b = sorted(by)[:2]
    spans = language_id.label_texts([by[a][:1500] + "\n" + by[b][:1500]], model)[0]["spans"]
    assert {a, b} <= {s["lang"] for s in spans} and all(x["end"] <= y["start"] for x, y in zip(spans, spans[1:]))


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(40):
        s, p = rng.normal(size=(7, 3)), float(rng.uniform(0, 2))
        best = max((sum(s[i, l] for i, l in enumerate(path)) - p * sum(x != y for x, y in zip(path, path[1:])) for path in np.ndindex(*[3] * 7)))
        path = language_id.viterbi(s, p)
        assert math.isclose(best, s[np.arange(7), path].sum() - p * (np.diff(path) != 0).sum(), abs_tol=1e-9)


def test_language_odd_rows(odd, none):
    model = language_id.fit_language_model(odd)
    got = language_id.label_languages(odd, model).collect()
    assert len(got) == len(ODD) and all(r.language == "x" and 0 <= r.language_.score <= 1 for r in got)
    labels = language_id.label_texts([r[1] for r in ODD], model)
    assert [x["lang"] for x in labels[1:5]] == ["und"] * 4 and all(0 <= x["score"] <= 1 for x in labels)
    assert language_id.label_texts(["text"], language_id.fit_language_model(none))[0]["lang"] == "und"
    assert language_id.label_languages(none, model).count() == 0


def test_scripts_narrow_candidates(spark):
    words = {"en": "the cat and the dog went home", "fr": "le chat et le chien sont partis", "ru": "кошка и собака ушли домой", "uk": "кішка і собака пішли додому", "el": "η γάτα και ο σκύλος έφυγαν"}
    rows = [(i * 5 + k, f"{t} {i % 7}", lang) for i in range(40) for k, (lang, t) in enumerate(words.items())]
    model = language_id.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names = lambda script: [model.languages[i] for i in model.candidates(language_id.SCRIPTS.index(script))]
    assert (names("latin"), names("cyrillic"), names("greek"), names("thai")) == (["en", "fr"], ["ru", "uk"], ["el"], model.languages)
    text = "the dog and собака ушли και σκύλος ไทย le chien"
    w = language_id.words_of([text], model.bits)
    scores = model.word_scores(w)
    letters = len(w.owner)
    for i in range(len(w.start)):
        own = [w.feature[j] for j in range(letters) if w.owner[j] == i] + [w.feature[letters + i]]
        for k in range(len(model.languages)):
            want = model.weights[own, k].astype(float).sum() if k in model.candidates(w.script[i]) else language_id.FOREIGN_SCRIPT
            assert math.isclose(scores[i, k], want, abs_tol=1e-4)
    spans = language_id.label_texts(["the cat and the dog went home кошка и собака ушли домой"], model)[0]["spans"]
    assert [s["lang"] for s in spans] == ["en", "ru"]


def test_most_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    rows = [(i, "word " * 5, f"l{int(i ** 0.5)}") for i in range(100)]
    assert language_id.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["l7", "l8", "l9"]


def test_licenses(odd, none):
    got = {r.doc_id: r.license for r in licenses.scan_licenses(odd.where("doc_id is not null")).collect()}
    assert got[1].n_words == 15 and got[1].found.base_labels == "cc-by,reserved" and len(got[1].found.base) == 6
    assert got[2].n_words == got[3].n_words == 0 and got[5].n_words == 40_000
    assert licenses.scan_licenses(none).count() == 0


def test_license_places(spark):
    got = {r.doc_id: r for r in licenses.op3_license_scan(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.encode().lower().decode())
        at = [(i, label) for label, key in (("cc-by", ["cc", "by"]), ("gpl", ["general", "public", "license"]), ("reserved", ["all", "rights", "reserved"])) for i in range(len(w)) if w[i : i + len(key)] == key]
        x = got[r.doc_id]
        assert (x.n_words, x.n_base, x.base_labels) == (len(w), len(at), ",".join(sorted({label for _, label in at})))
        assert (x.first_word, x.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))


def test_extraction(spark):
    page = "<html><head><title>T</title></head><body><nav>menu</nav><div class='cookie-notice'>no</div><article><h1>Head</h1><p>One &amp; <b>two<p>three<br>four<div class=comments>bad</div></article><footer>f</footer>"
    rows = [(1, "http://a.b/c", page, "x"), (2, None, None, "x"), (3, "", "", "x"), (4, "http://a.b", "plain &lt; text", "x"), (4, "http://a.b", "plain &lt; text", "x")]
    got = [(r.page_id, r.text) for r in extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).orderBy("page_id").collect()]
    assert got == [(1, "Head\nOne & two\nthree four"), (2, ""), (3, ""), (4, "plain < text"), (4, "plain < text")]


def test_extraction_cuts_repeated_branches(spark):
    rows = [(i, "http://h.x/p", f"<div class=top>Same everywhere</div><div class=text><p>Own words {i}.</p></div>") for i in range(30)]
    got = extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Own words {i}." for i in range(30)}


def test_fingerprints(spark, none):
    text = [f"line {i} of one\nsecond {i % 3}\n" * (i + 1) for i in range(12)] + ["", None]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(text)], "doc_id long, text string, digests string")
    got = {r.doc_id: r for r in fingerprints.with_next(rows).collect()}
    assert got[5].next_text == text[4] and got[0].next_text == "" and len(got) == len(text)
    assert fingerprints.with_next(none).count() == 0


def _brute(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_join(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for n in (3, 8, 60, 150):
        base = list(rng.choice(vocab, n))
        for edits in [0, 0, *range(7)]:
            w = list(base)
            for i in rng.integers(0, n, edits):
                w[i] = "Z" + str(rng.integers(1e6))
            texts.append(" ".join(w))
    passage = " ".join(rng.choice(vocab, 55))
    texts += [" ".join(rng.choice(vocab, 70)) + " " + passage for _ in range(30)] + [None, "", "   ", "One", "one "]
    got = jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == dict(enumerate(_brute(texts)))


def test_jaccard_join_odd(none, odd):
    assert jaccard_join.near_duplicates(none).count() == 0
    assert jaccard_join.near_duplicates(odd).count() == len(ODD)


def test_shingles_break_at_texts():
    a, b = shingle_sets(pa.array(["a b c d e f", "A B  c d e\nF"])), shingle_sets(pa.array([None, "", "x"]))
    x, y = a
    assert (x == y).all() and len(x) == 2 and [len(z) for z in b] == [0, 0, 1]


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    rows = [(i, v.tolist(), 0.0) for i, v in enumerate(x)] + [(600 + i, x[7].tolist(), 0.0) for i in range(30)] + [(700, None, 0.0), (701, [0.0] * 16, 0.0), (702, [float("nan")] * 16, 0.0), (703, [None] * 16, 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, d double")
    got = defaultdict(dict)
    for r in neighbours.nearest(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    own = {i: np.asarray(v, float) for i, v, _ in rows[:630]}
    hits = total = 0
    assert set(got) == set(range(0, 630, 50))
    for q in got:
        true = sorted((np.sqrt(((own[q] - v) ** 2).sum()), i) for i, v in own.items() if i != q)[:10]
        hits += len({i for _, i in true} & {i for i, _ in got[q].values()})
        total += 10
        assert list(got[q]) and all(math.isclose(s, np.sqrt(((own[q] - own[i]) ** 2).sum()), abs_tol=1e-9) for i, s in got[q].values())
    assert hits >= 0.9 * total
    few = neighbours.nearest(df.where("vec_id < 5"), "vec_id", "embedding", F.lit(True)).collect()
    assert len(few) == 20
    assert neighbours.nearest(df.where("vec_id > 690"), "vec_id", "embedding", F.lit(True)).count() == 0


def test_bpe_against_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    tok, spec = tokenizers.Tokenizer.from_file(bpe.tokenizer_path()), bpe.load_spec(bpe.tokenizer_path())
    tok.no_truncation()
    tok.no_padding()
    texts = [r.text for r in docs.collect()] + ["İstanbul ΣΑΣ", "é ́x", "<|endoftext|>hi", "don't", "😀 汉字", "a\x1cb", "x" * 3000, "", "½²\x85"]
    words = sorted({w.lower() for t in texts[:50] for w in re.findall("[a-z]+", t.lower())})
    merger = bpe.Merger(spec)
    codec = bpe.Codec(merger, bpe.build_lexicon(words, merger))
    assert all(codec.lexicon.lookup(w.encode()) == merger.ids(w) for w in words) and codec.lexicon.lookup(b"zzqzz") is None and codec.lexicon.lookup(b"") is None
    want = []
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((ids, tok.decode(ids, skip_special_tokens=False)))
        assert codec.encode(t) == want[-1]
        assert codec.decode(ids) == codec.encode(t)[1]
    for some in (codec, bpe.Codec(merger)):  # with a lexicon and without
        ids, counts, shown = some.encode_batch(texts)
        ends = np.cumsum(counts)
        assert [(ids[b - n : b].tolist(), x) for b, n, x in zip(ends, counts, shown)] == want


def test_bpe_random_texts_against_library():
    tokenizers = pytest.importorskip("tokenizers")
    tok, merger = tokenizers.Tokenizer.from_file(bpe.tokenizer_path()), bpe.Merger(bpe.load_spec(bpe.tokenizer_path()))
    rng = np.random.default_rng(9)
    every = list("abcdefghijklmnopqrstuvwxyz") * 4 + list("ABÉéßÀΣσςİıſ'’.,;:-_#%&$*()0123456789½²Ⅷ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u200b\u0301\u0345\ufeff漢字かなКирאבעر한😀🏽\U0001d400") + ["'s", "'re", "the", "tion", "<|endoftext|>", "<|", "|>"]
    texts = ["".join(rng.choice(every, int(rng.integers(0, 120)))) for _ in range(4_000)]
    ids, counts, shown = bpe.Codec(merger, bpe.build_lexicon(["the", "tion", "thetion", "a"], merger)).encode_batch(texts)
    ends = np.cumsum(counts)
    for t, b, n, x in zip(texts, ends, counts, shown):
        want = tok.encode(t, add_special_tokens=False).ids
        assert ids[b - n : b].tolist() == want and x == tok.decode(want, skip_special_tokens=False)


def test_bpe_odd(odd, none):
    got = {r.text: r.bpe for r in bpe.encode_texts(odd, bpe.tokenizer_path()).collect()}
    assert got[None].n_tokens == got[""].n_tokens == 0 and got["word " * 40_000].n_tokens == 40_000
    assert bpe.encode_texts(none, bpe.tokenizer_path()).count() == 0


def test_mixing(spark, docs, none, odd):
    got = mixing.mix_sources(docs).collect()
    size = Counter()
    for r in got:
        size[r.source] += r.size
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    total, target, free = sum(size.values()), {}, set(size)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 3 * size[s]}
        if not above:
            break
        target |= {s: 3 * size[s] for s in above}
        free -= above
    target |= {s: level * weight[s] for s in free}
    taken, largest = Counter(), Counter()
    for r in got:
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9) and r.source_size == size[r.source] and r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in size)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}
    assert mixing.mix_sources(none).count() == 0 and mixing.mix_sources(odd).count() == len(ODD)


def test_secrets(odd, none):
    texts = ['password = "hunter2x" AKIA' + "A" * 16, "token:ab\nAPI_KEY: abcdef0123456789abcdef01", "é" * 5 + "deadbeef" * 4, None, "ſecret=abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "secret=abc, passwd:'longenough'"]
    base = [(k, re.compile(p, re.A | (re.I if i else 0)), g, n) for k, p, i, g, n in ((r.kind, r.pattern, r.ignore_case, r.group, r.least) for r in secrets.RULES[:3])]
    scan = secrets.scanner()
    for t, spans in zip(texts, scan(texts)):
        want = sorted((m.start(), j, m.end()) for j, (_, p, g, n) in enumerate(base) for m in p.finditer(t or "") if len(m[g]) >= n)
        assert [(a, k, b) for a, b, k in spans if k < 3] == want
    assert secrets.trigram_query(secrets.RULES[2]) == [] and all(secrets.trigram_query(r) for r in secrets.RULES if r.kind != "hex")
    assert secrets.find_secrets(none).count() == 0 and secrets.find_secrets(odd).count() == len(ODD)
    assert secrets.scanner()(["x " * 10 + texts[0]])[0]


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op1_quality(spark, sf).withColumnRenamed("quality", "p").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r.p for r in got if r.quality == 1], [r.p for r in got if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9 and np.mean([p >= quality.KEEP for p in good]) > 0.98


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify_quality(odd, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == len(ODD) and all(0 <= r.quality <= 1 for r in got)
    assert quality.classify_quality(none, labels, F.col("source"), F.col("lang")).count() == 0


def test_edited_text(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(rows, reverse=True)
    for r in fingerprints.op5_fingerprints(spark, SF).collect():
        text, after = rows[r.doc_id], rows[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        sets = [{p.rstrip(" ") for p in re.findall(fingerprints.PARAGRAPH, t)} for t in (text, edited, after)]
        like = [(len(sets[0]) + len(s) - len(sets[0] ^ s)) / (len(sets[0]) + len(s) + len(sets[0] ^ s)) for s in sets[1:]]
        assert math.isclose(r.near_edited, like[0]) and math.isclose(r.near_next, like[1])
