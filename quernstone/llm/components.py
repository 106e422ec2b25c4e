"""Connected components of a link table, by alternating large-star and small-star joins; nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import sent_if_few, written


def _large(e: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest one (or to the node itself). e: (u, v), u > v."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # a table of its own: it is broadcast if it is small, and else Spark can split a centre that a third of all nodes hang on
    least = sent_if_few(written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable from each linked node. links: (a, b) of ids; nulls and loops go."""
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        e = written(_small(_large(e).distinct()), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
