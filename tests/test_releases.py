"""The log of releases against a list of states kept in Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import releases as R

SCHEMA = "k long, m string, v string, n double"


def log_at(spark, path):
    return R.ReleaseLog(spark, str(path), ["k", "m"], ["v", "n"])


def frame(spark, state):
    return spark.createDataFrame([(*k, *v) for k, v in state.items()], SCHEMA)


def read(log, number=None):
    return {(r.k, r.m): (r.v, r.n) for r in log.state(number).collect()}


def test_random_history(spark, tmp_path):
    r, log, states, kinds = random.Random(1), log_at(spark, tmp_path), {}, {}
    now: dict = {}
    for _ in range(9):
        step = r.choice(["publish", "publish", "rollback", "base"]) if states else "publish"
        if step == "publish":
            now = {k: v for k, v in now.items() if r.random() < 0.8}
            for _ in range(5):
                now[(r.randrange(8), r.choice("ab"))] = (r.choice(["x", None]), r.choice([1.5, None]))
            n = log.publish(frame(spark, now))
        elif step == "rollback":
            to = r.choice(list(states))
            now = dict(states[to])
            n = log.rollback(to)
        else:
            n = log.base()
        states[n], kinds[n] = dict(now), step
    assert list(states) == list(range(1, 10))
    for n, want in states.items():
        assert read(log, n) == want, (n, kinds)
    assert read(log) == now
    before: dict = {}
    want = []
    for n, s in states.items():
        if kinds[n] != "base":
            want.append((n, kinds[n], len(s.keys() - before.keys()), sum(s[k] != before[k] for k in s.keys() & before.keys()), len(before.keys() - s.keys())))
        before = s
    assert sorted((x.number, x.kind, x.created, x.updated, x.removed) for x in log.history().collect()) == want


def test_changes_without_a_header_are_not_there(spark, tmp_path):
    log = log_at(spark, tmp_path)
    log.publish(frame(spark, {(1, "a"): ("x", 1.0)}))
    spark.createDataFrame([(9, "z", None, None)], "k long, m string, before struct<v:string,n:double>, after struct<v:string,n:double>").write.parquet(str(tmp_path / "changes" / "2-dead"))
    assert log.last() == 1 and read(log) == {(1, "a"): ("x", 1.0)}
    assert log.publish(frame(spark, {(1, "a"): ("x", 1.0)})) == 2  # nothing differs, and that is a release as well
    assert read(log, 2) == read(log, 1)


def test_second_publisher_of_a_number_is_refused(spark, tmp_path, monkeypatch):
    log = log_at(spark, tmp_path)
    log.publish(frame(spark, {(1, "a"): ("x", 1.0)}))
    other = log_at(spark, tmp_path)
    monkeypatch.setattr(other, "last", lambda: 0)  # it looked before the first one was there
    with pytest.raises(R.ReleaseConflict):
        other.publish(frame(spark, {(2, "a"): ("y", 1.0)}))
    assert read(log) == {(1, "a"): ("x", 1.0)}


def test_what_is_refused(spark, tmp_path):
    log = log_at(spark, tmp_path)
    with pytest.raises(ValueError, match="nothing"):
        log.state()
    with pytest.raises(ValueError, match="no release"):
        log.rollback(1)
    with pytest.raises(ValueError, match="twice"):
        log.publish(frame(spark, {(1, "a"): ("x", 1.0)}).unionByName(frame(spark, {(1, "a"): ("y", 1.0)})))
    log.publish(frame(spark, {(1, "a"): ("x", 1.0)}))
    with pytest.raises(ValueError, match="no release"):
        log.state(7)
    log.publish(frame(spark, {}))
    assert read(log, 2) == {} and read(log, 1) != {}
    assert log.rollback(1) == 3 and read(log) == read(log, 1)


def test_triples_are_keys_without_values(spark, tmp_path):
    log = R.ReleaseLog(spark, str(tmp_path), ["s", "p", "o"], [])
    t = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c")], "s string, p string, o string")
    log.publish(t)
    log.publish(t.filter(F.col("s") == "a"))
    log.rollback(1)
    assert [sorted(tuple(r) for r in log.state(n).collect()) for n in (1, 2, 3)] == [[("a", "p", "b"), ("b", "p", "c")], [("a", "p", "b")], [("a", "p", "b"), ("b", "p", "c")]]
