"""Embeddings by a pluggable model, each distinct text once: a cache table that is anti-joined and appended to.

A model says whether it is available and makes vectors of a list of texts, and is sent to the tasks that need it. Texts
that occur often (a third of all rows may hold one) are made distinct before the model sees them and fan out by a join.
What a run embeds is appended to the cache with one file for each task, so that a run which dies leaves whole files or
none; of texts that two runs embedded at once any vector counts, as a model gives equal texts equal vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.shared import folder
from quernstone.sources.tables import table

CACHED = "text string, vec array<double>"
#: Texts that a model is given at once.
TOGETHER = 256


class Embedder(Protocol):
    """A model: `name` keeps the caches of different models apart."""

    name: str

    def is_available(self) -> bool: ...

    def embed_many(self, texts: list[str]) -> list[list[float]]: ...


class LetterCounts:
    """A stand-in without a model: how often each vowel occurs, and the length."""

    name = "letters"

    def is_available(self) -> bool:
        return True

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(v)) for v in "aeiou"] + [float(len(t))] for t in texts]


def cached(spark: SparkSession, path: str, embedder: Embedder) -> DataFrame:
    """(text, vec) that the cache below a path holds of a model."""
    try:
        return spark.read.schema(CACHED).parquet(f"{path.rstrip('/')}/{embedder.name}/*")
    except AnalysisException:
        return spark.createDataFrame([], CACHED)


def embed_new(rows: DataFrame, text: str, embedder: Embedder, path: str) -> int:
    """Embeds the texts of a column that the cache lacks; returns how many there were. Nulls and empty texts have no vector."""
    if not embedder.is_available():
        return 0
    spark = rows.sparkSession

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i in range(0, len(texts), TOGETHER):
                part = texts[i : i + TOGETHER]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(embedder.embed_many(part), pa.list_(pa.float64()))], names=["text", "vec"])

    asked = rows.select(F.col(f"`{text}`").alias("text")).filter("text <> ''").distinct()
    new = asked.join(cached(spark, path, embedder).select("text"), "text", "left_anti")
    place = f"{path.rstrip('/')}/{embedder.name}/{uuid.uuid4().hex}"
    new.mapInArrow(make, CACHED).write.option("compression", "zstd").parquet(place)
    return spark.read.parquet(place).count()


def embedded(rows: DataFrame, text: str, embedder: Embedder, path: str, into: str = "vec") -> DataFrame:
    """rows with the vector of a text column; NULL for nulls, empty texts, and all where the model is not available and the cache has none."""
    embed_new(rows, text, embedder, path)
    known = cached(rows.sparkSession, path, embedder).groupBy("text").agg(F.first("vec").alias(into))
    known = known.withColumnRenamed("text", "_text")
    return rows.join(known, F.col(f"`{text}`") == F.col("_text"), "left").drop("_text")


def embedded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with the vectors of a stand-in model: the cache is filled with the names of small parts first, and asked for all twice."""
    path = f"{folder(spark)}/vectors-{uuid.uuid4().hex}"
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_type") != "PROMO", F.col("p_name")).alias("name"), "p_size")
    model = LetterCounts()
    first = embed_new(p.filter("p_size < 10"), "name", model, path)
    second = embed_new(p, "name", model, path)
    rows = embedded(p, "name", model, path)
    return rows.select("p_partkey", F.array_join(F.transform("vec", lambda x: x.cast("int").cast("string")), " ").alias("vec"), F.lit(first).alias("first"), F.lit(second).alias("second"))


O_NAMES = """
WITH n AS (SELECT p_partkey, p_size, CASE WHEN p_type <> 'PROMO' THEN p_name END AS name FROM part),
c AS (SELECT count(DISTINCT name) FILTER (WHERE p_size < 10) AS a, count(DISTINCT name) AS b FROM n),
v AS (SELECT p_partkey, array_to_string(list_concat(list_transform(['a', 'e', 'i', 'o', 'u'], lambda x: (length(name) - length(replace(name, x, '')))::INT), [length(name)::INT]), ' ') AS vec, name FROM n)
SELECT p_partkey, CASE WHEN name IS NOT NULL THEN vec END AS vec, CAST(a AS INTEGER) AS first, CAST(b - a AS INTEGER) AS second FROM v, c
"""

QUERIES = {"embedded_names": embedded_names}
ORACLES = {"embedded_names": O_NAMES}
