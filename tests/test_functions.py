"""Golden values of the scalar functions."""

import unicodedata

from pyspark.sql import functions as F

from rxloom.functions import extract, fields, refine, text
from rxloom.functions.register import register_functions
from rxloom.functions.similarity import lcs_expr, token_sort_ratio


def values(spark, inputs, build, schema="a string"):
    df = spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)], "i int, " + schema)
    cols = [F.col(c) for c in df.columns[1:]]
    return [r[0] for r in df.orderBy("i").select(build(*cols)).collect()]


def test_normalize(spark):
    got = values(spark, ["Thuốc Đặc trị (A/B) 05ml", "05mlx", "1.05g", None, "  ", "ﬁx ㎎ 007", "ét Ⅷ ½"], text.normalize_text)
    assert got == ["thuoc dac tri a b 5ml", "05mlx", "1.5g", "", "", "fix mg 7", "et viii 1 2"]
    assert values(spark, ["05mlx"], lambda c: text.normalize_for_matching(c, "claims")) == ["5mlx"]


def test_normalize_equals_python_rendering(spark):
    samples = ["Đường Huyết 0012mg", "naïve Œuvre ß", "ＡＢＣ １２３", "ế ộ ữ ằ", "x²y³ ①", "ℓ ™ №5", "ạb"]

    def python_key(s):
        s = "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)).replace("đ", "d")
        s = "".join(c if c.isascii() and (c.islower() or c.isdigit() or c in " -+%.") else " " for c in s)
        return " ".join(s.split())

    strip_zero = [x.replace("0012", "12") for x in map(python_key, samples)]
    assert values(spark, samples, text.normalize_text) == strip_zero


def test_compound_names(spark):
    got = values(spark, ["Candesartan + hydrochlorothiazid 16mg + 12.5mg", "Berodual 200 liều", "Paracetamol", None,
                         "B12a o'neil vit-c (x) 5 mg"], text.normalize_drug_name)
    assert got == ["Candesartan 16mg + Hydrochlorothiazid 12.5mg", "Berodual Iều 200l", None, None, "B12A O'Neil Vit-C 5mg"]


def test_search_names(spark):
    got = values(spark, ["Ludox - 200mg", "Berodual 200 liều (xịt) - 10ml", "Symbicort 120 liều", "Vitamin C 1000mg/10ml",
                         "Thuốc ho Bảo Thanh (Chai 125ml)", "200mg"], text.strip_search_name)
    assert got == ["Ludox", "Berodual", "Symbicort", "Vitamin C", "Thuốc ho Bảo Thanh", "200mg"]
    assert values(spark, ["abc-d"], lambda c: text.normalize_for_search(c, "abc")) == ["abc"]
    assert values(spark, ["hộp Panadol 500 viên a"], text.extract_keywords) == [["panadol", "500"]]
    assert values(spark, ["Panadol 0500mg"], text.query_variants) == [["Panadol 0500mg", "panadol 500mg", "panadol"]]


def test_icd(spark):
    assert [tuple(r) for r in values(spark, ["R51 - Đau đầu", "B97.4-Vi rút", "", "just text"], fields.parse_icd)] == [
        ("r51", "Đau đầu"), ("b97.4", "Vi rút"), ("", ""), ("", "just text")]
    got = values(spark, ["{}", '{"u": {"ma": "J06", "ten": "Viêm"}}', '{""u"": {""ma"": ""J07"", ""ten"": ""X""}}', "J00 - Y", "{bad"],
                 fields.parse_secondary_disease)
    assert [tuple(r) for r in got] == [("", ""), ("j06", "Viêm"), ("j07", "X"), ("j00", "Y"), ("", "{bad")]


def test_classification(spark):
    got = values(spark, ["supplement", "invalid", "valid", "secondary drug", "{drug,valid,\"main drug\"}", "", None, "valid, supplement"],
                 lambda c: fields.tags_json(fields.classification_tags(c)))
    assert got == ['["nodrug", "supplement"]', '["drug", "invalid"]', '["drug", "valid", "main drug"]',
                   '["drug", "valid", "secondary drug"]', '["drug", "valid", "main drug"]', "[]", "[]",
                   '["drug", "nodrug", "valid", "supplement", "main drug"]']
    label = lambda a, b: fields.classify_labels(a, b)["value"]
    pairs = [("", "invalid"), ("", "drug,invalid"), ("{drug,invalid}", ""), ("x", "secondary drug"), ("a", "")]
    assert values(spark, pairs, label, "a string, b string") == ["invalid", "valid", "invalid", "secondary drug", "unknown"]
    fixed = lambda a, b: fields.classify_labels(a, b, True)["value"]
    assert values(spark, [("", "drug,invalid")], fixed, "a string, b string") == ["invalid"]


def test_roles(spark):
    raw = ['["drug", "valid", "main drug"]', '["nodrug", "supplement"]', '["drug", "invalid"]', "drug, drug, valid, secondary drug",
           '"{main drug}"', '["{main drug}"]', "{secondary drug}", None]
    want = ["main drug", "supplement", "", "secondary drug", "main drug", "main drug", "secondary drug", ""]
    assert values(spark, raw, fields.extract_role) == want
    got = values(spark, ["supplement", "main drug", "invalid x", "", "odd", "medical supplies"], fields.correct_mapping)
    assert [(r["category"], r["validity"]) for r in got] == [
        ("nodrug", ""), ("drug", "valid"), ("drug", "invalid"), ("drug", "invalid"), ("drug", "valid"), ("drug", "valid")]


def test_page_functions(spark):
    body = "Công dụng: giúp hạ sốt nhanh\n\n và giảm đau Liều dùng: 2 viên"
    assert values(spark, [body, "none"], extract.page_usage) == ["giúp hạ sốt nhanh và giảm đau", "Not Found"]
    assert values(spark, [body, "none"], lambda c: extract.page_usage(c, 400)) == ["giúp hạ sốt nhanh và giảm đau...", "Not Found"]
    long = "Chỉ định: " + "a" * 5000 + " Liều dùng: 1"
    assert [len(x) for x in values(spark, [long], extract.page_usage)] == [5000]
    assert values(spark, ["x" * 100_001], fields.stored_body) == ["x" * 100_001]
    assert values(spark, ["x" * 100_001], lambda c: fields.stored_body(c, 100_000)) == ["x" * 100_000]
    assert values(spark, ["SĐK: VN-12345-10 ok", "Số đăng ký: AB/99", "x"], extract.page_sdk) == ["VN-12345-10", "AB/99", "Not Found"]
    assert values(spark, ["<p>a&nbsp;&eacute; <b>b</b></p>"], lambda c: refine.clean_html(c, True)) == ["a é b"]
    section = "Thuốc trị sốt, đau đầu. La thuoc nhóm A. viêm họng"
    assert values(spark, [section], refine.summarize_indication) == ["dau dau, sot"]


def test_similarity_and_scores(spark):
    pairs = [("Paracetamol 500", "500mg Paracetamol"), ("", ""), ("a", ""), ("red ring", "ring red")]
    got = values(spark, pairs, token_sort_ratio, "a string, b string")
    assert [round(x, 4) for x in got] == [93.75, 100.0, 0.0, 100.0]
    assert values(spark, [("500 Paracetamol", "500mg Paracetamol"), ("", "x")], lcs_expr, "a string, b string") == [15, 0]
    conf = lambda a, b: fields.match_confidence(a, b, F.lit(0.0))
    assert values(spark, [(0.9375, 1.0)], conf, "a double, b double") == [0.61875]


def test_external_payloads(spark):
    bodies = ['{"matches": [{"claim_id": "c1"}]}', 'x ```json\n{"matches": [{"claim_id": "c2"}]}\n``` y', "```\n{\"matches\": []}\n```", "none", None]
    got = values(spark, bodies, fields.response_matches)
    assert [[m["claim_id"] for m in r] for r in got] == [["c1"], ["c2"], [], [], []]


def test_registered_functions(spark):
    names = register_functions(spark)
    assert "normalize_text" in names and "token_sort_ratio" in names
    r = spark.sql(
        "SELECT normalize_text('Đặc (A) 05ml') a, normalize_claim_name('05mlx') b, normalize_drug_name('x 16mg + yy 2 mg') c, "
        "parse_icd('R51 - Đau').code d, extract_role('[\"drug\", \"main drug\"]') e, valid_role('valid') f, token_sort_ratio('a b', 'b a') g, "
        "clean_url('u?srsltid=1') h, match_status(0.7D) i, extract_keywords('hop zinc') j, infer_category('Losartan') k").first()
    assert (r.a, r.b, r.d, r.e, r.f, r.g, r.h, r.i, r.j) == (
        "dac a 5ml", "5mlx", "r51", "main drug", None, 100.0, "u", "partially_matched", ["zinc"])
    assert r.c == "Yy 16mg" and r.k == "Tim mạch - Huyết áp"


def test_derived_sql_functions_equal_their_column_forms(spark):
    from rxloom.functions.register import _derived

    awkward = [None, "", " ", "Para 500mg (x)", "R51 - Đau; J00 - Y", "[\'main drug\', \"secondary drug\"]", "{}", "{\"a\": {\"R51\": \"Đau\"}}",
               "Hộp 3 vỉ x 10 viên <b>a</b> &amp; it\'s", "Chỉ định: đau đầu, sốt cao.\nLiều dùng: 1 viên", "valid", "MAIN DRUG, supplement", "a\\b 'c'", "http://x.vn/thuoc/a-b"]
    rows = spark.createDataFrame([(x, x, awkward[(i * 5 + 3) % len(awkward)], awkward[(i * 3 + 1) % len(awkward)]) for i, x in enumerate(awkward)],
                                 "s string, a string, b string, c string")
    rows.createOrReplaceTempView("awkward_rows")
    assert set(_derived()) <= set(register_functions(spark))
    for name, (params, column) in _derived().items():
        want = [r[0] for r in rows.select(column).collect()]
        got = [r[0] for r in spark.sql(f"SELECT {name}({', '.join(params)}) FROM awkward_rows").collect()]
        assert got == want, name
