"""The stream of changes gives what the batch gives, over several micro-batches."""

import random

import pytest

from quernstone.streaming import changes, recompute

ROWS = [(1, 0, 1, "a"), (2, 1, 5, "b"), (1, 2, 1, "again"), (1, 3, 3, "c"), (2, 4, 4, "old"), (3, 5, 0, ""), (1, 6, 2, "late"), (4, 7, None, "none"), (3, 8, 9, "x")]


def fed(spark, path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, changes.CHANGE).coalesce(1).write.parquet(f"{path}/in/{i}")
    return spark.readStream.schema(changes.CHANGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


@pytest.mark.parametrize("compact", [1, 2, 16])
def test_snapshots_equal_the_batch(spark, tmp_path, monkeypatch, compact):
    monkeypatch.setattr(recompute, "COMPACT", compact)
    feed = fed(spark, tmp_path, [ROWS[:3], ROWS[3:5], ROWS[5:7], ROWS[7:]])
    seen, home = [], str(tmp_path / "home")

    def broken(c, b):
        raise RuntimeError("no")

    query = recompute.snapshots(changes.deduplicated_stream(feed), home, then=[broken, lambda c, b: seen.append((b, c.count()))])
    query.awaitTermination()
    want = changes.upserted(spark.createDataFrame([], recompute.SHADOW), changes.accepted(spark.createDataFrame(ROWS, changes.CHANGE)))
    got = recompute.latest_snapshot(spark, home)
    assert sorted(map(tuple, got.select("entity_id", "version", "label").collect())) == sorted(map(tuple, want.select("entity_id", "version", "label").collect()))
    assert sum(n for _, n in seen) == 4 and len(seen) == 4
    log = recompute.run_log(spark, home).orderBy("batch").collect()
    assert [r.n_changes for r in log] == [n for _, n in sorted(seen)] and {r.status for r in log} == {"failed subscriber"}


def test_many_entities_of_a_bucket_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "BUCKETS", 2)
    r = random.Random(5)
    rows = [(r.randrange(-20, 20), i, r.choice([None, -1, 0, *range(1, 9)]), r.choice(["a", None])) for i in range(300)]
    feed = fed(spark, tmp_path, [[(1, -1, None, "x")], rows[:120], rows[120:130], rows[130:]])
    stream = changes.deduplicated_stream(feed)
    assert "_bucket" in stream._jdf.queryExecution().logical().toString()
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    want = changes.accepted(spark.createDataFrame(rows, changes.CHANGE))
    assert sorted(map(tuple, spark.read.schema(changes.CHANGE).parquet(f"{tmp_path}/out").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_changes_without_version_or_entity(spark):
    rows = [(1, 0, None, "a"), (1, 1, 2, "b"), (None, 2, 5, "c"), (2, 3, None, "d"), (2, 4, -1, "e")]
    d = spark.createDataFrame(rows, changes.CHANGE)
    assert list(map(tuple, changes.accepted(d).collect())) == [(1, 1, 2, "b")]


def test_actions_of_superseded_conclusions_are_void(spark):
    c = spark.createDataFrame([("1", None), ("2", "2+")], "id string, superseded_by string")
    a = spark.createDataFrame([("1", "planned"), ("2", "planned"), ("2", "done")], "conclusion_id string, status string")
    assert sorted(map(tuple, recompute.voided(a, c).collect())) == [("1", "planned"), ("2", "done"), ("2", "voided")]


def test_recompute_leaves_others_alone(spark):
    c = spark.createDataFrame([(1, True), (2, True), (3, False)], "id long, effective boolean")
    touched = spark.createDataFrame([(1, "d", "x"), (2, "d", "y"), (3, "d", "x")], "id long, dimension string, ident string")
    out = recompute.recomputed(c, touched, spark.createDataFrame([("d", "x"), ("d", "x")], "dimension string, ident string"))
    assert sorted(map(tuple, out.select("id", "effective", "superseded_by").collect()), key=str) == [("1", False, "1+"), ("1+", True, None), ("2", True, None), ("3", False, None)]
    assert recompute.recomputed(c.limit(0), touched, touched.select("dimension", "ident")).count() == 0
