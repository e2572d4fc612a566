import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rxloom.llm import langid as g
from rxloom.llm.common import QUERIES

MODEL = g.public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def vocabulary():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ordinary = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {p: i for i, p in enumerate(sorted({p.lower() for p in ordinary if p.strip(g.START) == "" or any(c.isalpha() for c in p)}))}


def segmentations(word, at, number):
    """All (pieces) of word[at:], a character that is no piece being the unknown piece."""
    if at == len(word):
        yield []
        return
    for end in range(at + 1, len(word) + 1):
        piece = number.get(word[at:end], len(number) if end == at + 1 else None)
        if piece is not None:
            for rest in segmentations(word, end, number):
                yield [piece, *rest]


@pytest.fixture(scope="module")
def random_probabilities():
    p = np.random.default_rng(1).random((g.pieces(MODEL).count, 3))
    return p / p.sum(0)


WORDS = ["▁the", "▁language", "▁straße", "▁日本", "▁😀x", "▁ꙮ", "▁a"]


def test_forward_sums_all_segmentations(random_probabilities):
    number = vocabulary()
    got = g.log_likelihoods(WORDS, g.pieces(MODEL), random_probabilities)
    for word, row in zip(WORDS, got, strict=True):
        want = sum(np.prod(random_probabilities[ids], axis=0) for ids in segmentations(word, 0, number))
        assert np.allclose(np.log(want), row)


def test_expected_counts_are_posterior_means(random_probabilities):
    number = vocabulary()
    weights = np.arange(1, 1 + 3 * len(WORDS), dtype=float).reshape(-1, 3)
    want = np.zeros_like(random_probabilities)
    for word, w in zip(WORDS, weights, strict=True):
        ways = [(ids, np.prod(random_probabilities[ids], axis=0)) for ids in segmentations(word, 0, number)]
        total = sum(p for _, p in ways)
        for ids, p in ways:
            np.add.at(want, ids, w * p / total)
    assert np.allclose(g.expected(WORDS, weights, g.pieces(MODEL), random_probabilities), want)


def test_held_out_accuracy(spark):
    rows = (QUERIES["op10_unigram_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect())
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    tried = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in tried) >= 0.99 * len(tried)


def test_odd_texts_and_no_labels(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 ²½ --", "x"), (4, "ß" * 5000, "x"), (4, "ß" * 5000, "x"), (None, "ab", "x"), (5, "a 1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    n = g.pieces(MODEL).count
    prob = np.full((n, 2), 1.0 / n)
    got = g.predict(df, "text", ["aa", "bb"], prob).collect()
    assert len(got) == len(rows) and got[0]["word"] == "x"
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert all(r["lang_pred"] == "aa" and r["score"] == 0.5 for r in got if r["doc_id"] not in (1, 2, 3))
    assert g.predict(df.limit(0), "text", ["aa", "bb"], prob).count() == 0
    languages, prob = g.train(df.withColumn("lang", F.lit(None).cast("string")), "doc_id", "text", "lang")
    assert languages == []
    assert {r["lang_pred"] for r in g.predict(df, "text", languages, prob).collect()} == {"und"}
    with pytest.raises(ValueError, match="score"):
        g.predict(df.withColumnRenamed("word", "Score"), "text", ["aa"], prob)


def test_held_out_documents_teach_nothing(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, "only here" if i in held else "other", "zz" if i in held else "aa") for i in range(60)] + [(None, "null id", "yy")]
    words = g.training_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 1000).collect()
    assert {(r["lang"], r["word"]) for r in words} == {("aa", "▁other")}
