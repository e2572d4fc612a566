import re

from rxloom.llm import quality as q


def naive(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n\t ", "a", "a a a a", "x\nx\n\nx \nx", "é日😀 ## <b>", "a b c d a b c e a b", "\x1c\x85 y", "w " * 2000, "one two three " * 40]


def test_measures():
    for t in TEXTS:
        assert q.measure((t or "").encode()) == naive(t), t


def test_hosts_shrink_and_reject(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, f"h{i % 10}", 1) for i in range(200)] + [(1000 + i, "bad", "junk", 1) for i in range(50)]
    rows += [(2000, good, "junk", 1), (2001, good, None, 1), (2002, "bad", "fresh", 1), (2003, good, "fresh", 1), (3, good, "h3", 1), (None, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host_ok long")
    out = q.judge_documents(df, "doc_id", "text", "source").collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    assert by[0]["kept"] and by[2001]["kept"] and by[2003]["kept"]
    assert not by[2000]["kept"] and not by[2000]["base_failed"]  # a good text of a host that fails
    assert by[2002]["base_failed"] and by[2002]["host_ok"]  # one failure does not condemn a host
    assert by[None]["base_failed"] and by[None]["n_words"] == 0
    assert q.judge_documents(df.limit(0), "doc_id", "text", "source").count() == 0
