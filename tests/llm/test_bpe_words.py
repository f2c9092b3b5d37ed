"""The lexicon comes from the tokenizer's file, not from some of the texts; what a worker remembers is bounded and changes no id."""

import numpy as np

from paperloom.llm import bpe


def test_lexicon_of_the_tokenizer():
    merger = bpe.Merger(bpe.load_spec(bpe.tokenizer_path()))
    words = bpe.whole_words(merger)
    assert len(words) > 10_000 and words == sorted(set(words)) and "the" in words and not any(w in merger.special for w in words)
    lexicon = bpe.Transducer(bpe.build_lexicon(words, merger))
    assert all(lexicon.lookup(w.encode()) == merger.ids(w) for w in words[::97])


def test_no_text_is_read_for_the_lexicon(spark):
    docs = spark.createDataFrame([(1, "qwxyz qwxyz the"), (2, None)], "doc_id long, text string").withColumn("text", bpe.F.expr("assert_true(doc_id < 0) || text"))
    assert bpe.encode_texts(docs, bpe.tokenizer_path()).columns == ["doc_id", "text", "bpe"]  # a count of words would fail here


def test_words_remembered(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 10)
    merger = bpe.Merger(bpe.load_spec(bpe.tokenizer_path()))
    codec, plain = bpe.Codec(merger, bpe.build_lexicon(["the"], merger)), bpe.Codec(merger)
    for k in range(6):
        texts = [f"the zqa{chr(97 + (k * i) % 26)}x{'q' * (i % 90)} <|endoftext|> the" for i in range(7)]
        got = codec.encode_batch(texts)
        assert codec.others <= 10
        want = [merger.special[p] if p in merger.special else merger.ids(p) for t in texts for p in plain.all_pieces(t)]
        assert got[0].tolist() == [i for ids in want for i in (ids if isinstance(ids, list) else [ids])]
        assert np.array_equal(got[1], plain.encode_batch(texts)[1]) and got[2] == plain.encode_batch(texts)[2]
