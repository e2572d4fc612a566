import numpy as np

from rxloom.llm import url_filter as u


def naive(url, rules):
    host, path = u.split_url(url)
    fits = [(len(h) + len(p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def test_split():
    assert u.split_url("http://A.B.com:80/x/?q#f") == ("a.b.com:80", "/x/")
    assert u.split_url("http://a.com?x/") == ("a.com", "")
    assert u.split_url("x") == u.split_url(None) == ("", "")
    assert u.split_url("://É.com/É") == ("É.com", "/É")


def test_against_every_rule(spark):
    rules = [*u.RULES, ("block", "a.b.example.com", "/en/x"), ("allow", "b.example.com", "/en/xyz"), ("block", "b.example.com", "/en/xyz")]
    hosts = ["com", "example.com", "www.example.com", "a.b.example.com", "notexample.com", "x.net", "net", "EXAMPLE.COM", "", "example.com."]
    paths = ["", "/", "/en/", "/en/xyz", "/en", "/es/1", "/fr/", "?/en/", "#/en/"]
    rows = [(i, f"{s}{h}{p}", "extra") for i, (s, h, p) in enumerate((s, h, p) for s in ("http://", "") for h in hosts for p in paths)]
    rows += [(900, None, "e"), (1, rows[1][1], "repeated"), (None, rows[2][1], "no key")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = sorted(map(tuple, u.filter_urls(df, "page_id", "url", rules).collect()), key=str)
    assert got == sorted(((i, *naive(url, rules)) for i, url, _ in rows), key=str)
    assert u.filter_urls(df.limit(0), "page_id", "url", rules).count() == 0
    assert {r["verdict"] for r in u.filter_urls(df, "page_id", "url", []).collect()} == {"allow"}


def test_colliding_digests_do_not_match():
    index = u.DigestIndex(np.frombuffer(u.DigestIndex.build([("block", "a.com", "/"), ("block", "b.com", "/")]), np.uint8))
    index.digests = np.array([u.xxhash.xxh64_intdigest("c.com\n/")] * 2, np.uint64)
    assert index.judge(["http://c.com/"], "allow") == [("c.com", "/", None, "allow")]
