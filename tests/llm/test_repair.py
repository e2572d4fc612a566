import hashlib
import random
import re

import pytest

from rxloom.llm import repair as r

WORDS = r"[^\x20\x09-\x0D]"


def naive(rows):
    """Counts, cost, audit and digest of ordered (turn, role, text) rows, by extending every audit row by row."""
    rows = [(t, " " if a is None else a, " " if x is None else x) for t, a, x in rows]
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    faults, seen = [], []
    for _, a, x in rows:
        full = re.findall(WORDS, x)
        faults.append("blank" if not full else "duplicate" if (a, x) in seen else "truncated" if full[-1] not in ".!?" else "")
        seen.append((a, x))
    firsts = [a[:1] for _, a, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
    best = {"": (0, "", ())}  # role initials, shortened to what still matters
    fits = re.compile(r"(s?(ua)*u?)?\Z")

    def put(into, initials, value):
        if fits.match(initials):
            key = ("s" if initials[:1] == "s" else "") if len(initials) < 2 and initials[:1] == "s" else ("u" if initials[-1:] == "u" else "a" if initials else "")
            if key not in into or value[:2] < into[key][:2]:
                into[key] = value

    def grown(values):
        for _ in range(3):
            for key, (cost, audit, out) in list(values.items()):
                for role in ("user", "assistant"):
                    put(values, {"": "", "s": "s", "u": "u", "a": "ua"}[key] + role[0], (cost + 2, audit + "I", (*out, (role, ""))))
        return values

    best = grown(best)
    for (_, a, x), fault in zip(rows, faults, strict=True):
        now = {}
        for key, (cost, audit, out) in best.items():
            head = {"": "", "s": "s", "u": "u", "a": "ua"}[key]
            put(now, head, (cost + 3, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if a[:1] in ("s", "u", "a"):
                    put(now, head + a[:1], (cost + more, audit + "K", (*out, (a, x))))
                for role in ("user", "assistant"):
                    put(now, head + role[0], (cost + 2 + more, audit + "R", (*out, (role, x))))
        best = grown(now)
    cost, audit, out = min(best[k] for k in ("", "a") if k in best)
    text = "\n".join(f"{a}:{x}" for a, x in out)
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def exhaustive(symbols):
    """The least (cost, audit) over all edit sequences of rows given as (initial, truncated, must go), with up to three insertions in a place."""
    found = []

    def step(i, initials, cost, audit, run):
        if cost > 3 * len(symbols) or not re.match(r"(s?(ua)*u?)?\Z", initials):
            return
        if i == len(symbols) and re.match(r"(s?(ua)+)?\Z", initials):
            found.append((cost, audit))
        if run < 3:
            for role in "ua":
                step(i, initials + role, cost + 2, audit + "I", run + 1)
        if i < len(symbols):
            first, cut, gone = symbols[i]
            step(i + 1, initials, cost + 3, audit + "D", 0)
            if not gone:
                step(i + 1, initials + (first or "?"), cost + cut, audit + "K", 0)
                for role in "ua":
                    step(i + 1, initials + role, cost + 2 + cut, audit + "R", 0)

    step(0, "", 0, "", 0)
    return min(found)


def test_agenda_against_all_edit_sequences():
    shapes = [""] + [a + b + c for a in "sSuUaAxXd" for b in " sSuUaAxXd" for c in " uAxd"]
    for shape in {s.replace(" ", "") for s in shapes} | {"auau", "ssua", "uuaa", "xdua"}:
        rows = [(x.lower() if x not in "xXd" else "", int(x.isupper()), x == "d") for x in shape]
        assert r.repair_shape(shape) == exhaustive(rows), shape


def conversation(rng, n):
    rows, turn = [], rng.choice([None, 0, 5])
    for _ in range(n):
        text = rng.choice(["", " \t", "yes.", "no", "why?", f"t{rng.random()}.", f"t{rng.random()}", None, "x! \n", "é日."])
        rows.append((turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]), text))
        turn = (turn or 0) + rng.choice([1, 1, 1, 2, 3])
    return rows


def results(spark, rows):
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string, k string, x long")
    out = r.digests(r.repair(df, "conv", "turn", "role", "text")).collect()
    found = {x["conv"]: tuple(x)[1:] for x in out}
    assert len(found) == len(out)
    return found


@pytest.mark.parametrize("limits", [(256, 64), (4, 3), (1, 2)])
def test_repair_against_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(r, "SEGMENT_ROWS", limits[0])  # small: conversations are cut, and combined over several levels
    monkeypatch.setattr(r, "FAN", limits[1])
    rng = random.Random(11)
    convs = {k: conversation(rng, n) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 30, 60, 150, 7, 5])}
    convs[None] = conversation(rng, 9)
    convs[100] = [(3, "user", "same.")] * 5 + [(4, "assistant", "same.")]
    convs[101] = [(None, "assistant", "only.")]
    convs[102] = [(t, ("user", "assistant")[t % 2], f"fine {t}.") for t in range(40)]
    convs[103] = [(t, "user", " ") for t in range(9)]
    rows = [(k, *x, "extra", 1) for k, found in convs.items() for x in found]
    rng.shuffle(rows)
    got = results(spark, rows)
    assert set(got) == set(convs)
    for k, found in convs.items():
        assert got[k] == naive(found), k


def test_bytes_cut_a_conversation_and_empty_tables_give_nothing(spark, monkeypatch):
    monkeypatch.setattr(r, "SEGMENT_BYTES", 50)
    rows = [(1, t, ("user", "assistant")[t % 2], "word " * 30 + ".", "", 0) for t in range(5)]
    assert results(spark, rows) == {1: naive([x[1:4] for x in rows])}
    df = spark.createDataFrame([], "conv long, turn long, role string, text string")
    assert r.digests(r.repair(df, "conv", "turn", "role", "text")).count() == 0


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two? Three!") for c in range(60) for t in (None, 0, 1, 2)] + [(None, None, None, None)]
    got = {}
    for x in r.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((x["conv_id"], x["turn"]), []).append((x["role"], x["text"]))
    kinds = set()
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        kinds.add(min(h, 5))
        role, text = role or " ", text or " "
        want = {0: [], 1: [(role, "")], 2: [(role, re.sub("[.!?]", "", text))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(h, [(role, text)])
        assert got.get((c, t), []) == want
    assert kinds == {0, 1, 2, 3, 4, 5}
