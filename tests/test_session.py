import os
import random
from types import SimpleNamespace

import pytest

from rxloom import session
from rxloom.operators.candidates import candidate_pairs
from rxloom.session import materialise, stored_tables


def test_stored_tables_are_removed_at_the_end_of_their_scope(spark):
    kept = materialise(spark.range(3), "kept")
    with stored_tables(spark):
        inner = materialise(spark.range(5), "inner")
        path = inner.inputFiles()[0].removeprefix("file://")
        assert inner.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_a_folder_has_to_be_named(monkeypatch):
    monkeypatch.setattr(session, "_LOCAL", [])
    without = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="local[2]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.work_dir(without)
    session.use_local_folder(without)
    assert os.path.isdir(session.work_dir(without))
    cluster = SimpleNamespace(conf=without.conf, sparkContext=SimpleNamespace(master="spark://a:1"))
    monkeypatch.setattr(session, "_LOCAL", [])
    session.use_local_folder(cluster)
    with pytest.raises(RuntimeError):
        session.work_dir(cluster)


def test_few_of_all_pairs_reach_the_scorer(spark):
    rng = random.Random(1)
    parts = "pa ra ce ta mol xi cil lin bu pro fen me zol zin vi min cef rox im az thro my cin lo ti din ket co na".split()

    def names():
        return sorted({" ".join("".join(rng.choices(parts, k=4))[:9] for _ in range(2)) for _ in range(400)})

    left, right = names(), names()
    a, b = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((left, "l"), (right, "r")))
    for threshold, most in ((85.0, 0.02), (70.0, 0.2)):
        assert candidate_pairs(a, b, "l", "r", threshold).count() <= most * len(left) * len(right)
