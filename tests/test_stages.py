"""Stages that are kept, paused and made again; embeddings that are made once."""

import pytest
from pyspark.sql import functions as F

from quernstone.operators import embedding as E
from quernstone.operators import stages as S


def counted(log, name, make, **more):
    def run(d):
        log.append(name)
        return make(d)

    return S.Stage(name, run, **more)


def test_broken_run_redoes_only_what_is_missing(spark, tmp_path):
    log, source = [], spark.range(20).withColumn("v", F.col("id") * 2)

    def broken(_):
        raise RuntimeError("lost")

    one, two = counted(log, "one", lambda d: d.filter("id > 3")), counted(log, "two", lambda d: d.withColumn("w", F.col("v") + 1))
    three = counted(log, "three", lambda d: d.groupBy().agg(F.sum("w").alias("w")))
    st = S.Stages(spark, str(tmp_path))
    with pytest.raises(RuntimeError):
        st.run(source, [one, two, S.Stage("three", broken)])
    assert log == ["one", "two"]
    run = S.Stages(spark, str(tmp_path)).run(source, [one, two, three])
    assert run.complete and run.steps == [("one", "kept"), ("two", "kept"), ("three", "done")] and log == ["one", "two", "three"]
    assert run.output.first().w == sum(2 * i + 1 for i in range(4, 20))
    # another order of the same rows is the same source; another row is not
    assert [h for _, h in st.run(source.orderBy(F.desc("id")), [one, two, three]).steps] == ["kept"] * 3
    assert [h for _, h in st.run(source.union(source.limit(1)), [one, two, three]).steps] == ["done"] * 3
    # a new version of the second stage runs it and the third
    new = counted(log, "two", lambda d: d.withColumn("w", F.col("v")), version=2)
    assert [h for _, h in st.run(source, [one, new, three]).steps] == ["kept", "done", "done"]
    assert [h for _, h in st.run(source, [S.Stage("one", one.make, params={"x": 1}), two, three]).steps] == ["done"] * 3


def test_pause_resume_and_clear(spark, tmp_path):
    source, st = spark.range(5), S.Stages(spark, str(tmp_path))
    stages = [S.Stage("one", lambda d: (st.pause(), d)[1]), S.Stage("two", lambda d: d.filter("id > 1"))]
    run = st.run(source, stages)
    assert not run.complete and run.steps == [("one", "done"), ("two", "paused")] and run.output.count() == 5
    assert st.run(source, stages).steps == [("one", "kept"), ("two", "paused")]
    st.resume()
    run = st.run(source, stages)
    assert run.steps == [("one", "kept"), ("two", "done")] and run.output.count() == 3
    assert sorted(r.stage for r in st.manifest().collect()) == ["one", "two"]
    st.clear()
    assert st.manifest().count() == 0 and not st.paused()


def test_output_without_a_header_is_none(spark, tmp_path, monkeypatch):
    source, st = spark.range(5), S.Stages(spark, str(tmp_path))
    monkeypatch.setattr(st, "_put", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        st.run(source, [S.Stage("one", lambda d: d)])
    assert S.Stages(spark, str(tmp_path)).run(source, [S.Stage("one", lambda d: d)]).steps == [("one", "done")]


def test_each_text_is_embedded_once(spark, tmp_path):
    model, path = E.LetterCounts(), str(tmp_path)
    rows = spark.createDataFrame([(i, ["aa", "bee", "", None, "aa"][i % 5]) for i in range(50)], "id int, `t x` string").withColumn("text", F.lit("clash")).withColumn("_v", F.lit(0))
    got = {r.id: r.vec for r in E.embedded(rows, "t x", model, path).collect()}
    assert len(got) == 50 and got[0] == [2.0, 0, 0, 0, 0, 2] and got[1] == [0, 2.0, 0, 0, 0, 3] and got[2] is None and got[3] is None
    assert E.embed_new(rows, "t x", model, path) == 0 and E.cached(spark, path, model).count() == 2
    more = spark.createDataFrame([("aa",), ("new",)], "text string")
    assert E.embed_new(more, "text", model, path) == 1 and E.cached(spark, path, model).count() == 3

    class Off(E.LetterCounts):
        def is_available(self):
            return False

    late = spark.createDataFrame([("aa",), ("later",)], "text string")
    assert {r.text: r.vec is None for r in E.embedded(late, "text", Off(), path).collect()} == {"aa": False, "later": True}
    assert E.embedded(late.limit(0), "text", model, path).count() == 0
