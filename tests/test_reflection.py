"""Keys and references found in data, on small tables with every trap."""

import json

from pyspark.sql import functions as F

from quernstone.sources import reflection as R


def test_candidates_of_small_tables(spark):
    a = spark.range(200).select(F.col("id").alias("a_id"), F.col("id").cast("string").alias("a_code"), F.when(F.col("id") > 0, F.col("id")).alias("a_gap"), (F.col("id") % 7).alias("a_few"), F.col("id").cast("double").alias("a_ratio"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("a_text"))
    b = spark.range(500).select((F.col("id") / 5).cast("long").alias("b_id"), (F.col("id") % 5).alias("b_line"), (F.col("id") % 200).alias("a_id"), (F.col("id") % 201).alias("x_id"), F.when(F.col("id") % 2 == 0, F.lit(3)).cast("string").alias("a_code"), F.lit(None).cast("long").alias("a_gap"))
    tables = {"a": a, "b": b, "none": a.limit(0), "odd": spark.createDataFrame([([1],)], "v array<int>")}
    rows = R.reflect(spark, tables).collect()
    classes = {r.name: json.loads(r.properties) for r in rows if r.candidate_kind == "class"}
    assert classes["a"]["keys"] == [["a_id"], ["a_code"]] and classes["a"]["primary_key"] == ["a_id"]  # a text of 199 is no identifier, a gap no key
    assert ["b_id", "b_line"] == classes["b"]["primary_key"] and all(len(k) == 2 for k in classes["b"]["keys"]) and classes["none"]["keys"] == [] and classes["odd"]["keys"] == []
    assert {c["name"]: c["nullable"] for c in classes["a"]["columns"]} == {"a_id": False, "a_code": False, "a_gap": True, "a_few": False, "a_ratio": True, "a_text": False}
    links = {(r.name, tuple(json.loads(r.properties)["constrained_columns"])) for r in rows if r.candidate_kind == "link"}
    # x_id has a value too many, b_id lies within a_id as well: `id` is the stem of all three
    assert links == {("b_a", ("a_id",)), ("b_a", ("b_id",)), ("b_a", ("a_code",))}
    assert {r.name for r in R.reflect(spark, tables, ["b", "missing"]).collect()} == {"b"}


def test_hidden_duplicates_are_found_by_the_exact_count(spark):
    d = spark.range(50_000).select(F.when(F.col("id") == 49_999, 7).otherwise(F.col("id")).alias("k"))
    (p,) = R.profile("d", d)
    assert p.values >= R.SKETCHED * p.rows and R.keys(d, [p]) == []
