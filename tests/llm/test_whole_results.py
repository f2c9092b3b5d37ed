"""Whole results against plain versions, and odd rows through every operator and stage."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import bpe, extraction, fingerprints, jaccard_join, language_id, licenses, mixing, neighbours, quality, secrets

SF = "/root/testdata/sf0.001"


def test_all_spans_without_an_index():
    """Rules applied to each text, without trigrams, give the same spans."""
    rng = np.random.default_rng(12)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "A" * 16, "9Z" * 9, "deadbeef" * 3, "0f" * 11, "hunter2", "x", "\n", "é", "ghp_" + "a1" * 18, "xoxb-123456789012", "eyJhbGciOi.", "eyJzdWIiOi.", "c2ln", "Bearer ", "abc.def-ghi_jkl/mno+pqr", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "MIIEpAIBAAKCAQEA"]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 25)))) for _ in range(4_000)] + [None, ""]
    rules = [(k, r.compiled(), r) for k, r in enumerate(secrets.RULES)]
    found = 0
    for t, spans in zip(texts, secrets.scanner()(texts)):
        want = sorted((m.start(), k, m.end()) for k, pattern, r in rules for m in pattern.finditer(t or "") if len(m[r.group]) >= r.least)
        assert [(a, k, b) for a, b, k in spans] == want
        found += len(want)
    assert found > 3_000


def test_all_labels_and_scores(spark):
    """Labels, places and scores of every template from word lists."""
    rng = np.random.default_rng(13)
    words = sorted({w for t in licenses.TEMPLATES for w in t.words}) + ["x", "Y", "zz"]
    rows = []
    for i in range(250):
        parts = []
        for _ in range(int(rng.integers(0, 6))):
            t = licenses.TEMPLATES[int(rng.integers(len(licenses.TEMPLATES)))].words
            a, b = sorted(int(v) for v in rng.integers(0, len(t) + 1, 2))
            parts += t[a:b] if rng.random() < 0.5 else t if rng.random() < 0.6 else list(rng.choice(words, 4))
        rows.append((i, "., ".join(parts).upper() if i % 2 else " ".join(parts), "keep"))
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()}
    for i, text, _ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        labels, base, score = set(), [], 0.0
        for t in licenses.TEMPLATES:
            places = [s for s in range(len(w)) if w[s : s + len(t.key_words)] == t.key_words]
            if places:
                labels.add(t.label)
                base += places if t.base else []
                at = lambda s, j, t=t: 0 <= s - t.key_at + j < len(w) and w[s - t.key_at + j] == t.words[j]
                part = {s: sum(at(s, j) for j in range(len(t.words))) / len(t.words) for s in places}
                score = max(score, *part.values()) if len(places) == 1 or len(t.words) == len(t.key_words) else max(score, min(part.values()))
        found = got[i].license_.found
        assert got[i].license == "keep" and got[i].license_.n_words == len(w)
        assert (found.labels if found else "") == ",".join(sorted(labels))
        assert sorted(found.base if found else []) == sorted(base) and (found.score if found else 0.0) >= score - 1e-9


def test_which_documents_are_taken(spark):
    """Epochs from sorted keys and running sums."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weight = F.when(F.col("doc_id") % 4 == 0, 0.9).when(F.col("doc_id") % 4 == 1, F.lit(None)).when(F.col("doc_id") % 4 == 2, float("nan")).otherwise(0.3)
    got = {r.doc_id: r for r in mixing.mix_sources(docs, quality=weight).collect()}
    u = (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    by = defaultdict(list)
    for r in docs.select("doc_id", "source", u.alias("u"), "text").collect():
        q = (0.9, mixing.LEAST_QUALITY, mixing.LEAST_QUALITY, 0.3)[r.doc_id % 4]
        by[r.source].append((-math.log(r.u) / q, r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))))
    for rows in by.values():
        total = sum(n for _, _, n in rows)
        full = min(math.floor(got[rows[0][1]].target / total), 3) if total else 0
        rest, upto = got[rows[0][1]].target - full * total, 0
        for _, i, n in sorted(rows):
            upto += n
            assert got[i].size == n and got[i].epochs == (full + (full < 3 and upto - n / 2 <= rest) if n else 0)


def test_posteriors(spark):
    """Rates without the own document, shrunken from path to host to all."""
    rng = np.random.default_rng(14)
    rows = [(i, f"h{int(rng.integers(3))}" if i % 20 else None, f"p{int(rng.integers(2))}", float(rng.random() < 0.7)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, host string, path string, p double")
    sites = {(r.host, r.path): r for r in quality.site_posteriors(df.select("host", "path", "p")).collect()}
    mean = sum(r[3] for r in rows) / len(rows)
    for (host, path), s in sites.items():
        inside = [r[3] for r in rows if r[1] == host]
        here = [r[3] for r in rows if (r[1], r[2]) == (host, path)]
        assert (s.n, s.h_n) == (len(here), len(inside)) and math.isclose(s.good, sum(here)) and math.isclose(s.h_good, sum(inside)) and math.isclose(s["mean"], mean)
    one = spark.createDataFrame([sites["h1", "p0"]]).select(*[c.alias(n) for c, n in zip((*quality.shrunken(), *quality.shrunken(F.lit(1.0))), "abcd")]).head()
    s = sites["h1", "p0"]
    host, less = (s.h_good + s.s_host * mean) / (s.h_n + s.s_host), (s.h_good - 1 + s.s_host * mean) / (s.h_n - 1 + s.s_host)
    want = (host, (s.good + s.s_path * host) / (s.n + s.s_path), less, (s.good - 1 + s.s_path * less) / (s.n - 1 + s.s_path))
    assert all(math.isclose(x, y) for x, y in zip(one, want))


def test_odds_are_calibrated():
    rng = np.random.default_rng(15)
    x = rng.normal(size=4_000)
    slope, offset = quality._calibrated(x, (rng.random(4_000) < 1 / (1 + np.exp(-(3 * x - 1)))).astype(float), 0.0)
    assert abs(slope - 3) < 0.4 and abs(offset + 1) < 0.2 and quality._calibrated(x[:5], np.ones(5), 0.4) == (quality.SLOPE, 0.4)


LONG = "all rights reserved password = hunter2hunter2 " * 20_000
ODD = [(1, "One text. All rights reserved.", "en", "a", 30), (1, "One text. All rights reserved.", "en", "a", 30), (1, "Another text of id one, quite different from the first.", None, "a", 0), (None, "Text without an id, token: abcdef12.", "en", None, None), (None, None, None, None, None), (2, "", "fr", "b", 0), (3, None, "fr", "b", None), (4, "   \n ", "fr", "b", 5), (5, "123 !!", "de", "c", 6), (6, LONG, "en", "a", len(LONG)), (7, "é 😀 \u0000 ﷽", "fr", "b", 9)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("bpe", "language", "license", "secrets", "normal", "class", "token", "key", "bucket", "size", "p", "n", "_text")
OPERATORS = {
    "op1": lambda s, d: quality.classify_quality(d, s.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1)], "doc_id long, quality int"), F.col("source"), F.col("lang")),
    "op2": lambda s, d: language_id.label_languages(d, language_id.fit_language_model(d)),
    "op3": lambda s, d: licenses.scan_licenses(d),
    "op5": lambda s, d: fingerprints.fingerprint_pairs(d),
    "op6": lambda s, d: jaccard_join.near_duplicates(d),
    "op8": lambda s, d: bpe.encode_texts(d, bpe.tokenizer_path()),
    "op9": lambda s, d: mixing.mix_sources(d),
    "op10": lambda s, d: secrets.find_secrets(d),
}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(7) for c in CLASHES})


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(spark, odd, name):
    got = OPERATORS[name](spark, odd).collect()
    assert len(got) == len(ODD) and not OPERATORS[name](spark, odd.limit(0)).collect()
    if name in ("op2", "op3", "op8", "op10"):
        assert all(r[c] == 7 for r in got for c in CLASHES)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_rows_of_stages(spark, odd, stage):
    docs, run = odd.select("doc_id", "text", "lang", "source", "n_chars"), dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, docs, SF).collect()
    assert not run(spark, docs.limit(0), SF).collect()
    texts = [t for _, t, *_ in ODD]
    if stage == "language_id":
        assert sorted(r.text for r in got) == sorted(t for t in texts if any(c.isalpha() for c in t or ""))
    if stage == "jaccard_join":
        assert len(got) == len(set((i, t) for i, t, *_ in ODD))
    if stage == "secret_scan":
        assert len(got) == len(ODD) and sum("hunter2" in (r.text or "") for r in got) == 0 and sum(r.text is None for r in got) == 2
    if stage == "mix_sources":
        assert not any(r.text is None or not r.text.strip() for r in got)
    if stage == "bpe":
        assert len(got) == len(ODD) and all(r.n_tokens == len(r.ids) for r in got)


def test_odd_rows_of_the_pipeline(spark, odd, tmp_path):
    odd.select("doc_id", "text", "lang", "source", "n_chars").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r.n_tokens == len(r.ids) > 0 for r in got)


def test_odd_vectors_and_pages(spark):
    rows = [(i, [float(i % 7), 1.0], 3) for i in range(40)] + [(40, [1.0], 3), (41, [0.0, 0.0], 3), (None, [1.0, 2.0], 3), (5, [5.0, 1.0], 3)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, d int"), "vec_id", "embedding", F.col("vec_id") % 10 == 0).collect()
    assert {r.query_id for r in got} == {0, 10, 20, 30} and all(r.score == 0 for r in got if r["rank"] <= 4)
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x" + "y " * 200_000, "c")], "page_id long, url string, html string, text string")
    assert extraction.extract_main_text(pages).head().text == "x" + " ".join(["y"] * 200_000)
