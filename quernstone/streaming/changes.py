"""Versioned change feeds: repeated and old versions are dropped, entities upserted, conclusions superseded.

The batch forms are aggregations and windows; `deduplicated_stream` is the same rule with state for each entity, and a test
asserts that both give the same rows.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.sources.shared import folder, kept
from quernstone.sources.tables import table

CHANGE = "entity_id long, seq long, version int, label string"
#: Micro-batches of the query that shows the stream.
BATCHES = 3
#: Groups of entities whose state is kept together. A stream's checkpoint depends on it.
BUCKETS = 1024


def accepted(changes: DataFrame) -> DataFrame:
    """Changes whose version is above 0 and all earlier ones of their entity, in order of arrival; no version counts as 0, no entity is passed over."""
    w = Window.partitionBy("entity_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("version").over(w), F.lit(0))
    return changes.filter("entity_id IS NOT NULL").withColumn("_before", before).filter(F.col("version") > F.greatest("_before", F.lit(0))).drop("_before")


def since(changes: DataFrame, cursor: int) -> DataFrame:
    """Changes above the connector's watermark."""
    return changes.filter(F.col("version") > cursor)


def upserted(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The last accepted change of each entity over its row in base; an empty label keeps the old one."""
    last = changes.groupBy("entity_id").agg(F.max(F.struct("version", "seq", "label")).alias("x")).select("entity_id", F.col("x.version").alias("v"), F.col("x.label").alias("l"))
    j = base.join(last, "entity_id", "full_outer")
    return j.select("entity_id", F.coalesce("v", "version").alias("version"), F.coalesce(F.nullif("l", F.lit("")), "label").alias("label"))


def superseded(conclusions: DataFrame) -> DataFrame:
    """Each conclusion with the one that replaces it: the next of its subject."""
    w = Window.partitionBy("subject").orderBy("id")
    return conclusions.withColumn("superseded_by", F.lead("id").over(w)).withColumn("effective", F.col("superseded_by").isNull())


def deduplicated_stream(changes: DataFrame) -> DataFrame:
    """accepted() over a stream (append mode): the state of an entity is its greatest version so far.

    Entities are kept by the bucket of their ids, as sorted lists, so a micro-batch costs Python a call for each bucket and
    not for each entity. Entities that were never accepted have no state.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, most = (np.array(x, np.int64) for x in state.get) if state.exists else (np.empty(0, np.int64),) * 2
        rows = pd.concat(list(frames)).dropna(subset=["version"]).sort_values(["entity_id", "seq"])
        entity, version = rows["entity_id"].to_numpy(np.int64), rows["version"].to_numpy(np.int64)
        floor = np.zeros(len(rows), np.int64)
        if len(ids):
            at = np.minimum(np.searchsorted(ids, entity), len(ids) - 1)
            floor = np.where(ids[at] == entity, most[at], 0)
        before = pd.Series(version).groupby(entity).cummax().groupby(entity).shift(fill_value=0).to_numpy(np.int64)
        kept_ = rows[version > np.maximum(before, floor)]
        new = kept_.groupby("entity_id")["version"].last()  # accepted versions only rise
        old = ~np.isin(ids, new.index)
        ids, most = np.concatenate([ids[old], new.index.to_numpy(np.int64)]), np.concatenate([most[old], new.to_numpy(np.int64)])
        by = np.argsort(ids)
        state.update((ids[by].tolist(), most[by].tolist()))
        yield kept_[["entity_id", "seq", "version", "label"]].astype({"version": np.int32})

    bucketed = changes.filter("entity_id IS NOT NULL").withColumn("_bucket", F.pmod(F.xxhash64("entity_id"), F.lit(BUCKETS)))
    return bucketed.groupBy("_bucket").applyInPandasWithState(step, CHANGE, "ids array<long>, most array<long>", "append", GroupStateTimeout.NoTimeout)


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change feed: the user is the entity, the number in props its version, the id the order of arrival."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("int").alias("version"), F.col("event_type").alias("label"))


_C = "c AS (SELECT user_id AS entity_id, event_id AS seq, CAST(json_extract_string(props, '$.k') AS INTEGER) AS version, event_type AS label FROM events), a AS (SELECT * FROM c QUALIFY version > coalesce(max(version) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))"


def mat_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(event_changes(spark, sf_dir))


O_DEDUP = f"WITH {_C} SELECT entity_id, seq, version, label FROM a"


def watermark(pulled: DataFrame) -> int:
    """The cursor after a pull: the greatest version of all entities."""
    return pulled.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]


def mat_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a first pull of some costly errors, the second pull takes of the whole feed only what is above their watermark."""
    c = event_changes(spark, sf_dir)
    early = table(spark, sf_dir, "events").filter("event_type = 'error' AND value > 150 AND get_json_object(props, '$.k') < '6'").select(F.col("event_id").alias("seq"))
    cursor = watermark(c.join(early, "seq", "left_semi"))
    return since(c, cursor).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("cursor_to")).withColumn("cursor_from", F.lit(cursor))


O_WATERMARK = f"""WITH {_C}, w AS (SELECT coalesce(max(CAST(json_extract_string(props, '$.k') AS INTEGER)), 0) AS cursor_from FROM events WHERE event_type = 'error' AND value > 150 AND json_extract_string(props, '$.k') < '6')
SELECT label, count(*) AS n, max(version) AS cursor_to, cursor_from FROM c, w WHERE version > cursor_from GROUP BY label, cursor_from"""


def mat_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.lit(0).alias("version"), F.col("s_name").alias("label"))
    return upserted(base, accepted(event_changes(spark, sf_dir)))


O_UPSERT = f"""WITH {_C}, l AS (SELECT entity_id, max(version) AS v, arg_max(label, version) AS l FROM a GROUP BY 1)
SELECT coalesce(l.entity_id, s.s_suppkey) AS entity_id, coalesce(v, 0) AS version, coalesce(nullif(l, ''), s_name) AS label FROM l FULL JOIN supplier s ON l.entity_id = s.s_suppkey"""


def marked(rows: DataFrame) -> DataFrame:
    """rows (id, seq, supersedes) with the one that superseded them: a row that came later and names them; what isn't there yet when it is named stays unmarked."""
    by = rows.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("_old"), F.col("id").alias("_new"), F.col("seq").alias("_at"))
    j = rows.join(by, (F.col("id") == F.col("_old")) & (F.col("seq") < F.col("_at")), "left")
    return j.groupBy("id", "seq", "supersedes").agg(F.max(F.struct("_at", "_new"))["_new"].alias("superseded_by")).withColumn("effective", F.col("superseded_by").isNull())


def mat_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("id"))
    return superseded(o)


O_SUPERSEDE = "SELECT o_custkey AS subject, o_orderkey AS id, lead(o_orderkey) OVER w AS superseded_by, lead(o_orderkey) OVER w IS NULL AS effective FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"


def mat_supersedes_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that name another by their props: some name one that came before, some one that comes later, some one that never does."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(F.col("event_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", k * 40 + F.col("user_id")).alias("supersedes"))
    return marked(rows).select("id", "superseded_by", "effective")


O_FIELD = """
WITH r AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 40 + user_id END AS s FROM events)
SELECT a.id, max(b.id) AS superseded_by, max(b.id) IS NULL AS effective FROM r a LEFT JOIN r b ON b.s = a.id AND b.id > a.id GROUP BY a.id
"""


def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed through the stateful stream, in several micro-batches by order of arrival, as a table."""
    at = f"{folder(spark)}/quernstone-feed-{uuid.uuid4().hex}"
    changes = event_changes(spark, sf_dir)
    cuts = [-1, *changes.approxQuantile("seq", [i / BATCHES for i in range(1, BATCHES)], 0.01), 1 << 62]
    for lo, hi in itertools.pairwise(cuts):  # however many files a part has, they are one micro-batch: the stream goes on where it ended
        changes.filter((F.col("seq") > int(lo)) & (F.col("seq") <= int(hi))).write.mode("append").parquet(f"{at}/in")
        feed = spark.readStream.schema(CHANGE).parquet(f"{at}/in")
        query = deduplicated_stream(feed).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    return kept(spark.read.schema(CHANGE).parquet(f"{at}/out"), "stream")


_ALL = ((mat_dedup, O_DEDUP), (mat_watermark, O_WATERMARK), (mat_upsert, O_UPSERT), (mat_supersede, O_SUPERSEDE), (mat_supersedes_field, O_FIELD), (stream_equals_batch, O_DEDUP))
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: o for f, o in _ALL}
