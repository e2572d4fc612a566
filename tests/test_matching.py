"""Pruned joins against brute force, golden reconciliation cases, consultation precedence."""

import math
import random
import re

from pyspark.sql import functions as F

from rxloom.functions.similarity import _lcs_wide, lcs_lengths
from rxloom.operators import consult, index, knowledge, lookup, matching, reconcile
from rxloom.operators.candidates import best_pairs, candidate_pairs, fuzzy_pairs, substring_first
from rxloom.operators import candidates as cand


def random_names(seed, n, alphabet="abcdeo ", low=1, high=24):
    rnd = random.Random(seed)
    names = {" ".join("".join(rnd.choice(alphabet) for _ in range(rnd.randint(low, high))).split()) for _ in range(n)}
    return sorted(x for x in names if x)


def ratio(a, b):
    return 200.0 * _lcs_wide(a, b) / (len(a) + len(b))


def test_lcs_vectorised_equals_wide():
    a, b = random_names(1, 200, "abc é", 1, 90), random_names(2, 200, "abc é", 1, 300)
    n = min(len(a), len(b))
    assert list(lcs_lengths(a[:n], b[:n])) == [_lcs_wide(x, y) for x, y in zip(a, b)]


def test_fuzzy_pairs_are_exhaustive(spark):
    base = random_names(3, 60)
    rnd = random.Random(4)
    near = sorted({x[: rnd.randint(0, len(x))] + rnd.choice("abz") + x[rnd.randint(0, len(x)):] for x in base})
    left = spark.createDataFrame([(x,) for x in base], "l string")
    right = spark.createDataFrame([(x,) for x in near], "r string")
    for threshold in (85.0, 70.0, 50.0):
        got = {(r.l, r.r): r.score for r in fuzzy_pairs(left, right, "l", "r", threshold).collect()}
        want = {(x, y): ratio(x, y) for x in base for y in near if ratio(x, y) >= threshold}
        assert got == want


def test_fuzzy_pairs_within_blocks(spark):
    names = random_names(5, 40, high=12)
    left = spark.createDataFrame([(i % 3, x) for i, x in enumerate(names)], "k int, l string")
    right = spark.createDataFrame([(i % 2, x) for i, x in enumerate(names)], "k int, r string")
    got = {(r.k, r.l, r.r) for r in fuzzy_pairs(left, right, "l", "r", 70.0, ["k"]).collect()}
    want = {(i % 3, x, y) for i, x in enumerate(names) for j, y in enumerate(names) if i % 3 == j % 2 and ratio(x, y) >= 70}
    assert got == want


def test_substring_first(spark):
    names = random_names(6, 80, "abc ", 2, 12)
    needles = sorted({n[i:j] for n in names[:30] for i in range(3) for j in range(i + 1, len(n) + 1)} | {"zzz", "abzzabc"})
    got = dict(substring_first(spark.createDataFrame([(x,) for x in needles], "needle string"),
                               spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, id long")).collect())
    want = {x: min(i for i, n in enumerate(names) if x in n) for x in needles if any(x in n for n in names)}
    assert got == want


def test_cosine_equals_brute_force(spark):
    docs = random_names(7, 80, "ab cd ", 3, 14)
    queries = random_names(8, 40, "ab cd ", 3, 14)
    corpus = spark.createDataFrame([(i, x) for i, x in enumerate(docs + docs[:10])], "id long, text string")
    qdf = spark.createDataFrame([(x, x) for x in queries], "query string, text string")
    n = len(docs) + 10
    df = {}
    for x in docs + docs[:10]:
        for t in set(x.split()):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}

    def vector(x):
        raw = {t: x.split().count(t) * idf[t] for t in set(x.split()) if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()} if norm else {}

    vecs = [vector(x) for x in docs]
    for threshold in (0.75, 0.4):
        want = {}
        for x in queries:
            v = vector(x)
            for i, dv in enumerate(vecs):
                s = sum(w * dv.get(t, 0.0) for t, w in v.items())
                if s >= threshold + 1e-7:
                    want[(x, i)] = round(s, 6)
        rows = index.cosine_pairs(qdf, index.build_tfidf(corpus), threshold).collect()
        got = {(r.query, r.id): round(r.score, 6) for r in rows if r.score >= threshold + 1e-7}
        assert got == want


def test_cosine_pairs_are_settled_where_they_meet(spark):
    texts = [f"w{i % 7} v{i % 11} u{i % 5}" for i in range(400)]
    rows = [(i % 390, x) for i, x in enumerate(texts)] + [(None, "w1 v1 only"), (3, "w3 w3 v9 other")]
    built = index.build_tfidf(spark.createDataFrame(rows, "id long, text string"))
    queries = spark.createDataFrame([(f"q{i}", f"v{i % 11} w{i % 7} x") for i in range(60)] + [(None, "w1 v1")], "query string, text string")
    q, d = {}, {}
    words = queries.select("query", F.explode(F.split("text", " ")).alias("term")).groupBy("query", "term").agg(F.count("*").alias("tf"))
    for r in index.unit_vectors(words, built.idf, "query").where("query IS NOT NULL").collect():
        q.setdefault(r.query, {})[r.term] = r.w
    for r in built.vectors.where("id IS NOT NULL").collect():
        d.setdefault(r.id, []).append((r.term, r.w))
    scores = {(a, b): sum(x.get(t, 0.0) * w for t, w in y) for a, x in q.items() for b, y in d.items()}
    pairs = index.cosine_pairs(queries, built, 0.6)
    got = [(r.query, r.id, round(r.score, 6)) for r in pairs.collect()]
    assert sorted(got) == sorted((a, b, round(s, 6)) for (a, b), s in scores.items() if s >= 0.6) and got
    assert pairs.select(F.spark_partition_id()).distinct().count() > 1
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((query#\d+L?, id#|id#\d+L?, (query|term)#)", plan)


def test_bm25_equals_brute_force(spark):
    docs = random_names(9, 60, "ab cd ", 3, 16)
    queries = random_names(10, 30, "ab cd ", 3, 16)
    toks = [x.split() for x in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: (0.25 * mean if v < 0 else v) for w, v in raw.items()}

    def score(q, t):
        return sum(idf.get(w, 0.0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in q.split())

    want = {(q, i): round(score(q, t), 6) for q in queries for i, t in enumerate(toks) if score(q, t) > 2.0}
    corpus = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    qdf = spark.createDataFrame([(x, x) for x in queries], "query string, text string")
    got = {(r.query, r.id): round(r.score, 6) for r in index.bm25_pairs(qdf, index.build_bm25(corpus), 2.0).collect()}
    assert got == want and want


def catalogue_names(n, seed=21, share=3):
    """Names of brand, substance, strength and form as catalogues have them, growing with n."""
    rnd = random.Random(seed)
    syllables = ["pa", "ra", "ce", "ta", "mol", "ami", "oxi", "cil", "lin", "zo", "fen", "du", "vas", "tin", "pro", "lol", "mex", "an"]
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 5))) for _ in range(max(20, n // share))]
    forms = ["tablet", "capsule", "syrup", "cream", "injection"]
    return sorted({f"{rnd.choice(words)} {rnd.choice(words)} {rnd.choice([5, 10, 20, 50, 100, 250, 500])}mg {rnd.choice(forms)}" for _ in range(n)})


def test_best_pairs_equal_the_best_of_all_pairs(spark):
    base = random_names(31, 70)
    rnd = random.Random(5)
    near = sorted({x[: rnd.randint(0, len(x))] + rnd.choice("abz") + x[rnd.randint(0, len(x)):] for x in base} | set(random_names(32, 60)))
    left = spark.createDataFrame([(i % 2, x) for i, x in enumerate(base)], "k int, l string")
    right = spark.createDataFrame([(i % 2, x) for i, x in enumerate(near)], "k int, r string")
    for threshold, keys in ((85.0, []), (70.0, []), (50.0, []), (60.0, ["k"])):
        want = {}
        for i, x in enumerate(base):
            scores = {y: ratio(x, y) for j, y in enumerate(near) if (not keys or i % 2 == j % 2) and ratio(x, y) >= threshold}
            want |= {(x, y): s for y, s in scores.items() if s == max(scores.values())}
        got = best_pairs(left.select(*keys, "l"), right.select(*keys, "r"), "l", "r", threshold, keys).collect()
        assert {(r.l, r.r): r.score for r in got} == want and len(got) == len(want)


def test_best_pairs_score_fewer_than_all_candidates(spark, monkeypatch):
    names = catalogue_names(3000)
    rnd = random.Random(6)
    queries = sorted({x[:rnd.randint(6, len(x))] if i % 3 else x.replace("a", "e", 2) for i, x in enumerate(catalogue_names(1500, 22)[:700] + names[:300])})
    left, right = (spark.createDataFrame([(x,) for x in v], f"{c} string") for v, c in ((queries, "l"), (names, "r")))
    counter = spark.sparkContext.accumulator(0)
    real = cand.sorted_ratio

    @F.udf("string")
    def seen(x):
        counter.add(1)
        return x

    monkeypatch.setattr(cand, "sorted_ratio", lambda a, b: F.when(seen(a).isNotNull(), real(a, b)))
    got = {r.l for r in best_pairs(left, right, "l", "r", 70.0).collect()}
    monkeypatch.undo()
    pairs = candidate_pairs(left, right, "l", "r", 70.0).count()
    total = len(queries) * len(names)
    print(f"candidates {pairs / total:.4%}, scored {counter.value / total:.4%}, found {len(got)}")
    assert 0 < counter.value < pairs


def test_bm25_best_equals_the_best_of_all_pairs_and_scores_a_tenth(spark):
    docs = [x.replace("mg", " mg") for x in catalogue_names(4000, share=40)]
    queries = [" ".join(x.split()[k % 2:]) for k, x in enumerate(docs[::20])] + ["mg", "mg mg tablet", "nothing"]
    corpus = spark.createDataFrame(list(enumerate(docs + docs[:50])), "id long, text string")
    qdf = spark.createDataFrame([(x, x) for x in sorted(set(queries))], "query string, text string")
    found = index.build_bm25(corpus)
    for threshold in (5.0, 0.1):
        pairs = index.bm25_pairs(qdf, found, threshold)
        want = {r.query: (r.id, r.score) for r in index.best_per_query(pairs).collect()}
        got = {r.query: (r.id, r.score) for r in index.bm25_best(qdf, found, threshold).collect()}
        assert got == want and want
        terms = index.bm25_terms(qdf.where("size(split(text, ' ')) > 3"), found)  # of single common words all documents tie
        seen = index.bm25_candidates(terms, found, threshold).count()
        reached = terms.where(F.col("reach") > threshold).join(found.postings, "term").select("query", "id").distinct().count()
        print(f"threshold {threshold}: {seen} of {reached} pairs that reach it scored")
        assert seen * 10 < reached


DRUGS = "id long, ten_thuoc string, so_dang_ky string, hoat_chat string, is_verified int, search_text string, chi_dinh string"
ITEM = "request_id string, {} string, pos int, service string, amount double"


def report(spark, claims, meds, drugs=()):
    c = spark.createDataFrame([("r", *x) for x in claims], ITEM.format("claim_id"))
    m = spark.createDataFrame([("r", *x) for x in meds], ITEM.format("medicine_id"))
    return reconcile.reconcile(c, m, spark.createDataFrame(list(drugs), DRUGS))


def test_reconcile_exact_with_catalogue(spark):
    drugs = [(1, "Paracetamol 500mg", "V1", "p", 1, "paracetamol 500mg", "")]
    out = report(spark, [("c1", 0, "Paracetamol 500mg", 15000.0)], [("m1", 0, "Paracetamol 500mg", 15000.0)], drugs)
    p = out.pairs.first()
    assert (p.match_status, p.medicine_id, p.confidence_score, p.decision) == ("matched", "m1", 1.0, "auto_approved")
    assert out.anomalies.count() == 0 and out.summary.first().risk_level == "low"


def test_reconcile_weak_without_catalogue(spark):
    out = report(spark, [("c1", 0, "Paracetamol 500", 10000.0)], [("m1", 0, "Paracetamol 500mg", 10000.0)])
    p = out.pairs.first()
    assert (p.match_status, p.medicine_id, p.confidence_score, p.decision) == ("weak_match", "m1", 0.62, "manual_review")
    assert out.summary.first().need_manual_review == 1


def test_reconcile_by_standard_name(spark):
    drugs = [(1, "BrandName X", "V1", "s", 1, "brandname x", ""), (2, "GenericName X", "V1", "s", 1, "genericname x", "")]
    p = report(spark, [("c1", 0, "BrandName X", 100.0)], [("m1", 0, "GenericName X", 100.0)], drugs).pairs.first()
    assert p.medicine_id == "m1" and p.drug_knowledge_match


def test_reconcile_anomalies(spark):
    out = report(spark, [("c1", 0, "Expensive Cancer Drug", 5e6)], [("m1", 0, "Vitamin C", 2e4)])
    assert sorted((r.kind, r.id, r.risk_flag) for r in out.anomalies.collect()) == [
        ("claim_without_purchase", "c1", "high"), ("purchase_without_claim", "m1", "low")]
    assert out.summary.first().risk_level == "high" and out.results.count() == 0


def test_reconcile_order_free(spark):
    out = report(spark, [("c1", 0, "Drug Alpha", 10.0), ("c2", 1, "Drug Beta", 20.0)],
                 [("m2", 0, "Drug Beta", 20.0), ("m1", 1, "Drug Alpha", 10.0)])
    got = {r.claim_id: (r.medicine_id, r.match_status, r.confidence_score) for r in out.pairs.collect()}
    assert got == {"c1": ("m1", "weak_match", 0.65), "c2": ("m2", "weak_match", 0.65)}
    assert out.summary.first().need_manual_review == 2


KB = "drug_name_norm string, disease_icd string, treatment_type string, tdv_feedback string, frequency long, last_updated timestamp"


def test_consult_precedence(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    kb = spark.createDataFrame([
        ("alpha one", "r51", "secondary drug", "main drug", 1, at), ("bravo two", "r51", "secondary drug", None, 1, at),
        ("charlie six", "r51", "main drug", "valid", 1, at), ("delta nine", "r51", "supplement", "", 1, at),
        ("echo zulu", "r51", None, None, 1, at), ("echo zulu", "j00", "supplement", None, 9, at)], KB)
    names = ["Alpha One", "bravo two", "charlie six", "delta nine", "echo zulu", "qqqq wwww", "bravo twoo"]
    items = spark.createDataFrame([("q", str(i), n) for i, n in enumerate(names)], "request_id string, item_id string, name string")
    diagnoses = spark.createDataFrame([("q", 0, " R51 "), ("q", 1, "j00")], "request_id string, pos int, code string")
    got = {r.item_id: (r.role, r.validity, r.source) for r in consult.consult(items, diagnoses, kb).collect()}
    assert got == {
        "0": ("main drug", "valid", "INTERNAL_KB_TDV"), "1": ("secondary drug", "valid", "INTERNAL_KB_AI"),
        "2": ("main drug", "valid", "INTERNAL_KB_AI"), "3": ("supplement", "", "INTERNAL_KB_AI"),
        "4": ("main drug", "valid", "INTERNAL_KB_DEFAULT"), "5": ("", "unknown", "INTERNAL_KB_EMPTY"),
        "6": ("secondary drug", "valid", "INTERNAL_KB_AI")}


def test_like_patterns_equal_brute_force(spark):
    rng = random.Random(9)
    names = random_names(10, 300, "abcdé %_", 1, 9)
    patterns = {"%", "_", "____", "%%", "zzz", "a%", "_b", "\\%", "a\\_b", "é"}
    for n in rng.sample(names, 60):
        patterns.add("".join(rng.choice(["%", "_", c, c, c]) for c in n.replace("_", "a").replace("%", "b")))
    q = spark.createDataFrame([(p,) for p in sorted(patterns)], "needle string")
    table = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "name string, id int")
    got = cand.like_first(q, table)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    want = q.crossJoin(table).where("name LIKE concat('%', needle, '%')").groupBy("needle").agg(F.min("id").alias("id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 20


def test_partial_like_mode(spark):
    names = spark.createDataFrame([("vitamin b1", 1), ("vitamin c", 2)], "name string, id long")
    q = spark.createDataFrame([("x", "vit%c"), ("y", "")], "query string, raw string")
    assert matching.partial_hits(q, names, "raw").count() == 0
    assert [tuple(r) for r in matching.partial_hits(q, names, "raw", like=True).collect()] == [("x", 2)]


def test_identify_flags_duplicates(spark):
    drugs = spark.createDataFrame([(1, "red ring", "V1", "r", 1, "red ring", "u")], DRUGS)
    names = spark.createDataFrame([("red ring", 0), ("Red Ring", 1), ("nothing like", 2), ("red ring", 3)], "name string, pos int")
    got = {r.input_name: (r.sdk, r.is_duplicate, r.duplicate_of, r.status) for r in lookup.identify(names, drugs).collect()}
    assert got == {"red ring": ("V1", False, None, None), "Red Ring": ("V1", True, "red ring", None),
                   "nothing like": (None, False, None, "Not Found")}


def test_keep_nonempty_option(spark):
    log = spark.createDataFrame([("1", "a", "R51 - x", "", "valid", "invalid", "s", ""), ("2", "a", "R51 - x", "", "", "", "", "")],
                                "pos string, drug_name string, primary_disease string, secondary_disease string, "
                                "classification string, feedback string, symptom string, reason string")
    rows = knowledge.prepare_log(log, F.lit("b"))
    plain = knowledge.fold_log(rows, F.current_timestamp()).first()
    kept = knowledge.fold_log(rows, F.current_timestamp(), keep_nonempty=True).first()
    assert (plain.tdv_feedback, kept.tdv_feedback, plain.symptom) == ("[]", '["drug", "invalid"]', "s")


def test_reconcile_gives_the_same_for_requests_of_any_size(spark, monkeypatch):
    rnd = random.Random(12)
    names = ["alpha one", "alpha onf", "bravo two", "two bravo", "charlie", "chxrlie", "", "zzz"]
    rows = [(rnd.choice([1, 2, 3, 4, None]), rnd.randint(0, 9), rnd.choice(names), float(rnd.randint(0, 9))) for _ in range(90)]
    claims = {(r, k): (r, f"c{k % 8}", k, n, a) for r, k, n, a in rows[:45]}  # of c0 and c1 there may be two
    meds = {(r, k): (r, f"m{k % 8}", k, n, a) for r, k, n, a in rows[45:]}
    c = spark.createDataFrame([*claims.values(), *list(claims.values())[:3]], "request_id long, claim_id string, pos int, service string, amount double")
    m = spark.createDataFrame([*meds.values(), *list(meds.values())[:3]], "request_id long, medicine_id string, pos int, service string, amount double")
    m = m.unionByName(spark.createDataFrame([(7, None, None, "bravo twoo", 1.0), (7, "m1", 1, "bravo tw", 1.0)], m.schema))
    c = c.unionByName(spark.createDataFrame([(7, "c1", 1, "bravo twooo", 1.0)], c.schema))  # its nearest purchase has no place
    drugs = spark.createDataFrame([(1, "alpha one", "V1", "s", 1, "alpha one", ""), (2, "bravo two", "V2", "s", 1, "bravo two", "")], DRUGS)

    def tables():
        out = reconcile.reconcile(c, m, drugs)
        flags = reconcile.fraud_flags(c, m, out.unsettled, settled=out.settled)
        return [sorted(map(str, df.collect())) for df in (out.pairs, out.anomalies, out.summary, flags)]

    monkeypatch.setattr(reconcile, "ROW_ITEMS", 0)
    spread = tables()
    monkeypatch.setattr(reconcile, "ROW_ITEMS", 1000)
    assert tables() == spread and all(spread)


def test_reconcile_exchanges_items_of_small_requests_once(spark):
    items = spark.range(50).selectExpr("id % 5 AS request_id", "concat('x', id) AS claim_id", "id AS pos", "'a b' AS service", "1.0D AS amount")
    info = spark.createDataFrame([("a b", "a b", None, None, None, None, None, "NO_MATCH")],
                                 "query string, norm string, db_name string, db_norm string, db_sdk string, db_ingredient string, db_confidence double, db_method string")
    rows = reconcile.settle_requests(items, items.withColumnRenamed("claim_id", "medicine_id"), info)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(request_id") == 1 and rows.where("kind = 'pair' AND med IS NOT NULL").count() == 50


def test_pairs_of_small_and_large_blocks_agree(spark, monkeypatch):
    names = random_names(15, 60, high=12)
    left = spark.createDataFrame([(i % 3, x) for i, x in enumerate(names)], "k int, l string")
    right = spark.createDataFrame([(min(i % 4, 2), x) for i, x in enumerate(names)], "k int, r string")
    got = []
    for most in (0, 300, 100_000):
        monkeypatch.setattr(cand, "BLOCK_PAIRS", most)
        got.append(sorted(map(tuple, fuzzy_pairs(left, right, "l", "r", 60.0, ["k"]).collect())))
    assert got[0] == got[1] == got[2] and got[0]
    monkeypatch.undo()
    assert "gram" not in candidate_pairs(left, right, "l", "r", 60.0, ["k"])._jdf.queryExecution().executedPlan().toString()


def test_fulltext_joins_documents_without_exchanging_pairs(spark):
    docs = spark.createDataFrame([(1, "red ring"), (2, "red ringer ring"), (3, "blue ring"), (None, "red ring")], "id long, t string")
    queries = spark.createDataFrame([("ri re", "ri re"), ("ring", "ring"), ("no", "no")], "query string, text string")
    fields = index.build_fields(docs, {"a": F.col("t")})
    hits = index.search_all_terms(queries, fields)
    assert sorted((r.query, r.id, r.score) for r in hits.collect()) == [
        ("ri re", 1, 2.0), ("ri re", 2, 3.0), ("ring", 1, 1.0), ("ring", 2, 2.0), ("ring", 3, 1.0)]
    assert sorted((r.query, r.id) for r in index.search_all_terms(queries, fields, False).collect()) == [("ring", 1), ("ring", 2), ("ring", 3)]
    assert "Exchange hashpartitioning(query" not in hits.where("id = 1")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_nested_links_equal_the_links_brought_together(spark):
    kb = spark.createDataFrame([(f"drug {i}", f"a{i % 2}", "d", "main" if i % 3 else None, i) for i in range(14)],
                               "drug_name_norm string, disease_icd string, disease_name_norm string, treatment_type string, frequency long")
    requests = spark.createDataFrame([(1, ["x", "y"], ["a0"]), (1, ["z"], ["a1", "none"]), (2, ["x"], ["none"]), (3, [], ["a0"]), (4, None, ["a0"])],
                                     "request_id long, sdks array<string>, icds array<string>")
    flat = lookup.verified_links(requests, kb)
    cols = [c for c in flat.columns if c != "request_id"]
    want = flat.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("links"))
    got = lookup.verified_links(requests, kb, nested=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 1
