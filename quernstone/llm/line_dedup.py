"""Line dedup (operator 9), by DataFrame functions alone: levelled sorted runs of line hashes.

A run is a bucketed, sorted table of line hashes with the document that first holds each. Documents come in batches
of rising doc_id. A batch's own hashes are aggregated first (a line that a third of all documents hold is one row per
task before the shuffle), merge-anti-joined with every run, and what is new becomes a run of level 0. A level with
FAN_IN runs is compacted into one run of the next level. A line is dropped unless its document is the one that
brought its hash into a run.

Defined cases: a null or empty text is one empty line, which stays; lines whose key has fewer than ten code points
stay; rows that share a doc_id are one document; a row without doc_id keeps its lines and makes no others go; an
empty table gives an empty result; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import SENT_IDS, documents, spread, written

#: Upper and lower case letters, and the white space stripped from a line's ends.
UPPER, LOWER, SPACE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\f\r"
#: A key counts from so many code points; batches of one call; runs of a level that are compacted into one.
MIN_KEY, BATCHES, FAN_IN = 10, 4, 2
#: Words that the pipeline asks of what is left of a document, as the first of the quality rules does.
LEAST_WORDS = 50


def line_key(line: Column) -> Column:
    """The line stripped, with A-Z in lower case; lower() does for ASCII lines, and only for them."""
    line = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


class LineRuns:
    """Hashes of the lines seen so far, as levels of sorted runs; tables of the session's warehouse."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or spread(spark)
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a run's buckets are read as they were sorted
        self.levels: list[list[str]] = []
        self.mark, self.made = f"line_run_{uuid.uuid4().hex}", 0

    def _run(self, rows: DataFrame) -> str:
        name = f"{self.mark}_{self.made}"
        self.made += 1
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("compression", "zstd").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes in (doc_id, h1, h2, …) of a batch whose ids lie above those of all earlier ones; returns the rows to drop."""
        first = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
        new = reduce(lambda a, run: a.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti"), self.runs(), first)
        name = self._run(new)
        drop = lines.join(self.spark.table(name), ["h1", "h2", "doc_id"], "left_anti")
        self._settle(0, name)
        return drop

    def _settle(self, level: int, name: str) -> None:
        """Puts a run on its level, and compacts a full level upwards. Old runs stay until close(): a plan may read them yet."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= FAN_IN:
            full, self.levels[level] = self.levels[level], []
            both = reduce(DataFrame.unionByName, (self.spark.table(x) for x in full))
            self._settle(level + 1, self._run(both.repartition(self.buckets, "h1", "h2")))

    def close(self) -> None:
        for i in range(self.made):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.mark}_{i}")


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, of, at, h1, h2) of lines that count: the text's hash, the line's place, and 128 bits of its key, for at 64 chance meetings show in a large corpus."""
    whole = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("of"), F.split("text", "\n").alias("lines"))
    lines = whole.select("doc_id", "of", F.posexplode("lines").alias("at", "line"))
    keys = lines.select("doc_id", "of", "at", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= MIN_KEY)
    return keys.select("doc_id", "of", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, of, gone): for documents that lose lines, the places of those lines."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    cuts = sorted(set(plain.filter("doc_id is not null").approxQuantile("doc_id", [i / BATCHES for i in range(1, BATCHES)], 0.01)))
    batch = reduce(lambda a, c: a + (F.col("doc_id") > int(c)).cast("int"), cuts, F.lit(0))
    lines = written(line_hashes(plain).withColumn("batch", batch), "lines", by="batch")
    runs = LineRuns(spark)
    try:
        parts = []
        for b in range(len(cuts) + 1):
            drop = runs.add(lines.filter(F.col("batch") == b).drop("batch"))
            parts.append(written(drop.groupBy("doc_id", "of").agg(F.collect_set("at").alias("gone")), "gone"))
    finally:
        runs.close()
    return reduce(DataFrame.unionByName, parts)


def _sent_if_small(gone: DataFrame) -> DataFrame:
    """The places that go, broadcast if ids, hashes and places take no more than SENT_IDS ids; else a join shuffles texts too."""
    documents, places = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    return F.broadcast(gone) if 2 * documents + places / 2 <= SENT_IDS else gone


def kept_lines(docs: DataFrame) -> DataFrame:
    """docs with `_lines` (all lines) and `_kept` (those that stay); the one place where texts may be shuffled."""
    gone = _sent_if_small(dropped_lines(docs).select(F.col("doc_id").alias("_id"), F.col("of").alias("_of"), "gone"))
    same = (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64("text") == F.col("_of"))
    joined = docs.join(gone, same, "left").withColumn("_lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    # one scan of the places and one of the lines: the places that go are told apart by a hash set
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    cut = F.when(F.col("gone").isNotNull(), stays)
    return joined.withColumn("_stays", cut).withColumn("_kept", F.when(F.col("_stays").isNull(), F.col("_lines")).otherwise(F.transform("_stays", lambda i: F.get("_lines", i)))).drop("gone", "_id", "_of", "_stays")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = kept_lines(documents(spark, sf_dir).select("doc_id", "text"))
    n, m = F.size("_lines").cast("long"), F.size("_kept").cast("long")
    return kept.select("doc_id", n.alias("n_lines"), (n - m).alias("n_dropped"), F.sha2(F.array_join("_kept", "\n"), 256).alias("kept_sha256"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the repeated lines cut from their texts, and n_chars set anew; a null text stays null.

    Documents that lost lines and have fewer than LEAST_WORDS words left go.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    text = F.when(F.col("text").isNotNull(), F.array_join("_kept", "\n"))
    kept = kept_lines(inner).withColumn("_text", text)
    whole = (F.size("_kept") == F.size("_lines")) | (F.regexp_count("_text", F.lit(r"[^\x20\x09-\x0D]+")) >= LEAST_WORDS)
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return kept.filter(whole).select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


ORACLE_OP9 = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k),
d AS (SELECT l.doc_id, l.i, l.line, coalesce(o.owner < l.doc_id, false) AS gone FROM l LEFT JOIN o ON l.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
