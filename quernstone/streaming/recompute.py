"""From a change feed to fresh conclusions: snapshots of the shadow table, and a recomputation of just what a change touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.operators.lifecycle import TERMINAL
from quernstone.operators.relational import affected
from quernstone.sources.shared import forget
from quernstone.sources.tables import table
from quernstone.streaming.changes import CHANGE, upserted

SHADOW = "entity_id long, version int, label string"
#: Micro-batches between two snapshots of the shadow table.
COMPACT = 16


def recomputed(conclusions: DataFrame, touched: DataFrame, targets: DataFrame, evaluate: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """conclusions (id, effective, …) after a change: the effective ones that share an id with the targets get a successor.

    touched: (id, dimension, ident) of conclusions; targets: (dimension, ident) of the change. evaluate() makes the
    successors' rows. The old row keeps its place, no longer effective and with `superseded_by`; others are untouched.
    """
    hit = affected(touched.withColumnRenamed("id", "conclusion").withColumnRenamed("ident", "id"), "conclusion", targets.withColumnRenamed("ident", "id"))
    hit = hit.select(F.col("conclusion").alias("id"), F.lit(True).alias("_hit"))
    j = conclusions.join(hit, "id", "left").withColumn("_hit", F.coalesce(F.col("_hit") & F.col("effective"), F.lit(False)))
    after = F.concat(F.col("id").cast("string"), F.lit("+"))
    old = j.withColumns({"superseded_by": F.when(F.col("_hit"), after), "effective": F.col("effective") & ~F.col("_hit"), "id": F.col("id").cast("string")}).drop("_hit")
    new = evaluate(j.filter("_hit").drop("_hit")).withColumns({"id": after, "superseded_by": F.lit(None).cast("string"), "effective": F.lit(True)})
    return old.unionByName(new)


def voided(actions: DataFrame, conclusions: DataFrame) -> DataFrame:
    """actions (conclusion_id, status, …): those not yet ended of superseded conclusions are void."""
    gone = conclusions.filter("superseded_by IS NOT NULL").select(F.col("id").alias("conclusion_id"), F.lit(True).alias("_gone"))
    j = actions.join(gone, "conclusion_id", "left")
    ended = F.col("status").isin(*TERMINAL)
    return j.withColumn("status", F.when(F.col("_gone") & ~ended, "voided").otherwise(F.col("status"))).drop("_gone")


def snapshots(feed: DataFrame, home: str, then: Sequence[Callable[[DataFrame, int], None]] = (), **trigger) -> StreamingQuery:
    """Follows accepted changes: each micro-batch writes its own changes, and every COMPACT batches the shadow table anew.

    A batch that is run again overwrites what it wrote, so nothing counts twice. Subscribers are called after the write,
    with the changes as written; an error of one is told in the run log and stops neither the others nor the stream. What
    a shadow table holds already is deleted one compaction later.
    """

    def step(changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        changes.write.mode("overwrite").parquet(f"{home}/changes/batch={batch}")
        ours = spark.read.schema(CHANGE).parquet(f"{home}/changes/batch={batch}")
        if batch % COMPACT == 0:
            before = _latest(spark, home, batch) if batch else spark.createDataFrame([], SHADOW)
            upserted(before, ours).write.mode("overwrite").parquet(f"{home}/shadow/batch={batch}")
            for old in range(batch - 2 * COMPACT, batch - COMPACT):
                if old >= 0:
                    forget(spark, f"{home}/changes/batch={old}")
            if batch >= 2 * COMPACT:
                forget(spark, f"{home}/shadow/batch={batch - 2 * COMPACT}")
        errors = []
        for subscriber in then:
            try:
                subscriber(ours, batch)
            except Exception as e:  # isolated: the run log tells of it
                errors.append(f"{type(e).__name__}: {e}"[:500])
        log = ours.agg(F.count(F.lit(1)).alias("n_changes"), F.max("version").alias("cursor_to"))
        log.select(F.lit("failed subscriber" if errors else "success").alias("status"), "n_changes", "cursor_to", F.lit("; ".join(errors)).alias("errors")).write.mode("overwrite").parquet(f"{home}/runs/batch={batch}")

    return feed.writeStream.foreachBatch(step).option("checkpointLocation", f"{home}/state").trigger(**(trigger or {"availableNow": True})).start()


def _latest(spark: SparkSession, home: str, below: int = 1 << 31) -> DataFrame:
    """The shadow table before a batch: its last snapshot, named by number, and the changes since."""
    snapshot = spark.read.option("basePath", f"{home}/shadow").schema(f"{SHADOW}, batch int").parquet(f"{home}/shadow").filter(F.col("batch") < below)
    at = snapshot.agg(F.max("batch")).first()[0]
    since = spark.read.option("basePath", f"{home}/changes").schema(f"{CHANGE}, batch int").parquet(f"{home}/changes").filter((F.col("batch") > at) & (F.col("batch") < below)).drop("batch")
    return upserted(snapshot.filter(F.col("batch") == at).drop("batch"), since)


def latest_snapshot(spark: SparkSession, home: str) -> DataFrame:
    return _latest(spark, home)


def run_log(spark: SparkSession, home: str) -> DataFrame:
    """A row for each micro-batch: status, changes, cursor, and errors of subscribers."""
    return spark.read.option("basePath", f"{home}/runs").parquet(f"{home}/runs")


def scoped_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as conclusions over customers and priorities; a change touches some customers and one priority."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority", (F.col("o_orderstatus") != "P").alias("effective"))
    touched = o.select("id", F.inline(F.array(F.struct(F.lit("customer").alias("dimension"), F.col("o_custkey").cast("string").alias("ident")), F.struct(F.lit("priority").alias("dimension"), F.substring("o_orderpriority", 1, 1).alias("ident")))))
    targets = table(spark, sf_dir, "events").filter("value > 90").select(F.lit("customer").alias("dimension"), F.col("user_id").cast("string").alias("ident")).unionByName(spark.createDataFrame([("priority", "1")], "dimension string, ident string"))
    out = recomputed(o.select("id", "effective"), touched, targets)
    return out.select("id", "effective", "superseded_by")


O_RECOMPUTE = """
WITH h AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS e, (o_custkey IN (SELECT user_id FROM events WHERE value > 90) OR o_orderpriority LIKE '1%') AS x FROM orders)
SELECT id::VARCHAR AS id, e AND NOT x AS effective, CASE WHEN e AND x THEN concat(id, '+') END AS superseded_by FROM h
UNION ALL SELECT concat(id, '+'), true, NULL FROM h WHERE e AND x
"""

QUERIES = {"scoped_recompute": scoped_recompute}
ORACLES = {"scoped_recompute": O_RECOMPUTE}
