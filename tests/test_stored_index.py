"""A stored catalogue index against one built anew, after inserts, edits and deletes."""

import random

from rxloom.operators import index, matching
from rxloom.operators.stored_index import CatalogueIndex


def tables(tfidf, bm25):
    def rows(df, *columns):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())

    return (rows(tfidf.idf, "term", "df", "idf"), rows(tfidf.vectors, "id", "term", "w", "rest"), rows(bm25.terms, "term", "bound"),
            rows(bm25.postings, "term", "id", "gain"), sum(len(r["entries"]) for r in bm25.blocks.collect()))


def test_changes_give_what_a_full_build_gives(spark, tmp_path):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)]

    def text():
        return " ".join(rnd.choices(words, k=rnd.randint(1, 6)))

    docs = {i: text() for i in range(60)}
    docs[60] = docs[5]  # the same text twice
    store = CatalogueIndex(spark, str(tmp_path / "index"))

    def frame(rows):
        return spark.createDataFrame(sorted(rows.items()), "id long, text string")

    assert store.version() is None and store.build(frame(docs)) == 0
    steps = [{61: text(), 62: "new words only"}, {3: text(), 5: "edited w1"}, {7: None, 60: None, 62: None}, {62: "new words only", 1: docs[2]}]
    for n, changes in enumerate([{}, *steps]):
        if n:
            assert store.apply(spark.createDataFrame(list(changes.items()), "id long, text string")) == n
            docs = {k: v for k, v in (docs | changes).items() if v is not None}
        corpus = frame(docs)
        for ngram in {0: (2,), 2: (1,), 4: (1, 2)}.get(n, ()):
            assert tables(store.tfidf(ngram), store.bm25()) == tables(index.build_tfidf(corpus, ngram), index.build_bm25(corpus))
        fresh = spark.read.parquet(str(tmp_path / "index" / f"v{n}" / "seen")).count()
        assert n == 0 or fresh <= len(changes)


def test_a_second_call_builds_nothing(spark, tmp_path, monkeypatch):
    drugs = spark.createDataFrame([(i, f"drug{i} {'red' if i % 2 else 'blue'}", f"VN-{i}", "x", 1, f"drug{i} tablet {i % 5}", None) for i in range(40)],
                                  "id long, ten_thuoc string, so_dang_ky string, hoat_chat string, is_verified int, search_text string, chi_dinh string")
    names = spark.createDataFrame([("tablet 3 drug7",), ("drug9 tablet",), ("nothing at all",), ("drug5 red",), ("tablet drug11",)], "name string")
    want = sorted(map(tuple, matching.match_catalogue(names, "name", drugs).collect()), key=repr)
    store = CatalogueIndex(spark, str(tmp_path / "index"), ("words", "spaces"))
    store.build(matching.catalogue_corpus(drugs))
    assert sorted(map(tuple, matching.match_catalogue(names, "name", drugs, stored=store).collect()), key=repr) == want

    def refuse(*_):
        raise AssertionError("built again")

    monkeypatch.setattr(CatalogueIndex, "_write", refuse)
    monkeypatch.setattr(matching, "build_tfidf", refuse)
    monkeypatch.setattr(matching, "build_bm25", refuse)
    again = CatalogueIndex(spark, str(tmp_path / "index"), ("words", "spaces"))
    assert sorted(map(tuple, matching.match_catalogue(names, "name", drugs, stored=again).collect()), key=repr) == want
