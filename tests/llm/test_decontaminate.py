import random
import re

import pytest

from rxloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ws(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def naive(docs, items, width):
    out = []
    for key, text in docs:
        words, hit, found = ws(text), set(), set()
        for item, body in items:
            b = ws(body)
            k = min(width, len(b))
            for s in range(len(b) - k + 1 if b else 0):
                for i in range(len(words) - k + 1):
                    if words[i:i + k] == b[s:s + k]:
                        hit.update(range(i, i + k))
                        found.add(str(item))
        out.append((key, len(words), len(hit), sorted(found), len(found), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("at_once", [100_000, 20])
def test_against_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(d, "WINDOWS_AT_ONCE", at_once)
    monkeypatch.setattr(d, "SEGMENT_DOCS", 7)
    rng = random.Random(6)
    letters = ["a", "b", "c", "É", "x1", "the"]
    items = [(i, " ".join(rng.choices(letters, k=rng.randint(0, 7)))) for i in range(14)] + [(14, None), (15, "never seen"), (3, "c c c c")]
    docs = [(i, rng.choice([" ", "--", "\n", "\0"]).join(rng.choices(letters, k=rng.randint(0, 40))).title()) for i in range(40)]
    docs += [(100, None), (101, ""), (5, docs[5][1]), (None, docs[6][1]), (102, "the " * 3000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, doc long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.contamination(df, "doc_id", "text", bench, "item_id", "text", width=4)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["n_items"], r["contaminated"]) for r in got.collect()), key=str) == naive(docs, items, 4)


def test_proximity_within_the_slop(spark):
    docs = spark.createDataFrame([(1, "p q r s t"), (2, "p q x r s t"), (3, "p q x y z r s t"), (4, "t s r q p")], "doc_id long, text string")
    windows = d.benchmark_windows(spark.createDataFrame([(9, "p q r s t")], "item_id long, text string"), "item_id", "text", 5)
    asked = d.Queries(windows.collect())
    index = d.build_index(docs, "doc_id", "text", asked.vocabulary)
    counts = d.term_counts(index, len(asked.vocabulary))
    assert counts.tolist() == [4, 4, 4, 4, 4]
    asked.order_by(counts)
    names = {r["doc"]: r["key"] for r in index.where("n_words IS NOT NULL").collect()}

    def found(slop):
        best = {}
        for r in d.find_matches(index, asked, windows.schema["item"].dataType, slop).collect():
            best[names[r["doc"]]] = min(best.get(names[r["doc"]], 99), r["drift"])
        return best

    assert found(0) == {1: 0}
    assert found(1) == {1: 0, 2: 1}
    assert set(found(3)) == {1, 2, 3}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert d.contamination(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert not d.contamination(docs, "doc_id", "text", items.limit(0), "item_id", "text").first()["contaminated"]
