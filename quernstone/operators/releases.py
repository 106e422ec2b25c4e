"""Releases of a keyed table as an append-only log: any release's state is a fold of the log, a rollback appends inverses.

A release is a folder of changes (key columns, `before` and `after` as structs of the other columns, NULL for a row that
isn't there) and a header that is written last. Changes without a header don't exist: a publisher that dies half way leaves
nothing behind that anyone reads. Two publishers of the same number write to folders of their own, and the header of the
second is refused. The latest change of a key up to a number is one `max_by` aggregate, so that the state of a release takes
one pass over the folders it needs and combines before the shuffle; `base` releases hold a whole state and cut that pass.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.shared import folder, forget, kept
from quernstone.sources.tables import table

#: number, what it is (publish, rollback or base), the number it goes back to, where its changes are, and how many there are.
HEADER = "number long, kind string, target long, place string, n long"


class ReleaseConflict(RuntimeError):
    """Another publisher took the number."""


class ReleaseLog:
    """The releases of a table with these key columns and values below one path."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], values: list[str]):
        self.spark, self.path, self.keys, self.values = spark, path.rstrip("/"), keys, values

    def headers(self) -> DataFrame:
        """A row for each release, by HEADER."""
        try:
            return self.spark.read.schema(HEADER).json(f"{self.path}/headers/*")
        except AnalysisException:  # nothing is there yet
            return self.spark.createDataFrame([], HEADER)

    def last(self) -> int:
        """The number of the newest release, 0 for none."""
        return self.headers().agg(F.max("number")).first()[0] or 0

    def _changes(self, above: int, up_to: int) -> DataFrame | None:
        """The changes of the releases from `above` (exclusive), or the newest base below `up_to`, to `up_to`; NULL number of a base counts as its own."""
        listed = sorted(self.headers().filter(F.col("number").between(above + 1, up_to)).collect(), key=lambda h: h["number"])
        parts = [self.spark.read.parquet(h["place"]).withColumn("number", F.lit(h["number"])) for h in listed if h["kind"] != "base"]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _packed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.keys, F.struct(*([F.col(c) for c in self.values] or [F.lit(True).alias("there")])).alias("row"))

    def _plain(self, packed: DataFrame) -> DataFrame:
        return packed.select(*self.keys, *[F.col(f"row.{c}").alias(c) for c in self.values])

    def _folded(self, number: int) -> DataFrame | None:
        """(keys, row): the state of a release, from the newest base at or below it."""
        bases = [h for h in self.headers().filter(f"kind = 'base' AND number <= {int(number)}").collect()]
        base = max(bases, key=lambda h: h["number"], default=None)
        changes = self._changes(base["number"] if base else 0, number)
        state = self.spark.read.parquet(base["place"]) if base else None
        if changes is None:
            return state
        now = changes.groupBy(*self.keys).agg(F.max_by("after", "number").alias("row"))
        if state is None:
            return now.filter("row IS NOT NULL")
        old = state.join(now.select(*self.keys), self.keys, "left_anti")
        return old.unionByName(now.filter("row IS NOT NULL"))

    def state(self, number: int | None = None) -> DataFrame:
        """The table as of a release, the newest if none is named."""
        number = self.last() if number is None else number
        if number and not self.headers().filter(F.col("number") == number).count():
            raise ValueError(f"there is no release {number}")
        folded = self._folded(number)
        if folded is None:
            raise ValueError("nothing is released yet")
        return self._plain(folded)

    def _append(self, changes: DataFrame, kind: str, target: int | None) -> int:
        number = self.last() + 1
        place = f"{self.path}/changes/{number}-{uuid.uuid4().hex}"
        changes.write.option("compression", "zstd").parquet(place)
        n = self.spark.read.parquet(place).count()
        header = self.spark.createDataFrame([(number, kind, target, place, n)], HEADER).coalesce(1)
        try:
            header.write.mode("errorifexists").json(f"{self.path}/headers/{number}")
        except AnalysisException as e:
            forget(self.spark, place)
            raise ReleaseConflict(f"release {number} is taken") from e
        return number

    def publish(self, rows: DataFrame) -> int:
        """Appends what differs between the newest state and these rows; returns the number. Repeated keys are refused."""
        new = kept(self._packed(rows.select(*self.keys, *self.values)), "release")
        if not new.groupBy(*self.keys).count().filter("count > 1").isEmpty():
            raise ValueError("a key occurs twice")
        old = self._folded(self.last())
        if old is None:
            return self._append(new.select(*self.keys, F.lit(None).cast(new.schema["row"].dataType).alias("before"), F.col("row").alias("after")), "publish", None)
        j = old.withColumnRenamed("row", "before").join(new.withColumnRenamed("row", "after"), self.keys, "full")
        return self._append(j.filter(~F.col("before").eqNullSafe(F.col("after"))), "publish", None)

    def rollback(self, number: int) -> int:
        """Appends the inverse of all that happened after a release; the state is then that release's, and history stays.

        Only keys that changed since are touched: each goes from its last `after` to its first `before`.
        """
        last = self.last()
        if not 0 < number <= last or not self.headers().filter(F.col("number") == number).count():
            raise ValueError(f"there is no release {number}")
        since = self._changes(number, last)
        if since is None:
            since = self._changes(0, last).limit(0)
        inverse = since.groupBy(*self.keys).agg(F.max_by("after", "number").alias("before"), F.min_by("before", "number").alias("after"))
        return self._append(inverse.filter(~F.col("before").eqNullSafe(F.col("after"))), "rollback", number)

    def base(self) -> int:
        """Appends a release that holds the whole newest state, so that later ones fold from there."""
        return self._append(self._folded(self.last()), "base", None)

    def _told(self, changes: DataFrame) -> DataFrame:
        kind: Column = F.when(F.col("before").isNull(), "created").when(F.col("after").isNull(), "removed").otherwise("updated")
        return changes.withColumn("change", kind).groupBy("number").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("created", "updated", "removed")])

    def history(self, by: list[str] | None = None) -> DataFrame:
        """(number, kind, target, created, updated, removed) of every release that changes something.

        by: fewer key columns, by which a row before meets one after. Where several rows share them, each meets each, as in a join;
        only for these rows the states are read.
        """
        log = self._changes(0, self.last())
        heads = self.headers().filter("kind <> 'base'").select("number", "kind", "target")
        parts = [log]
        if by:
            several = kept(log.select(*self.keys).distinct().groupBy(*by).count().filter("count > 1").select(*by), "several")
            if not several.isEmpty():
                parts = [log.join(several, by, "left_anti").select("number", "before", "after")]
                for n in sorted(h["number"] for h in heads.collect()):
                    new, old = self._folded(n), self._folded(n - 1)
                    a, b = (d.join(several, by, "left_semi").select(*by, F.col("row").alias(name)) for d, name in ((new.limit(0) if old is None else old, "before"), (new, "after")))
                    j = a.join(b, by, "full").filter(~F.col("before").eqNullSafe(F.col("after")))
                    parts.append(j.select(F.lit(n).cast("int").alias("number"), "before", "after"))
        counts = reduce(DataFrame.unionByName, map(self._told, parts)).groupBy("number").agg(*[F.sum(c).alias(c) for c in ("created", "updated", "removed")])
        return heads.join(counts, "number", "left").na.fill(0, ["created", "updated", "removed"])


# queries: customers as classes; the second release changes what the market says, the third what nations say, then all goes back.
# A supplier's id may be a customer's as well, so the key has what it is of; history pairs by the id alone, as the SQL does.


def _released(spark: SparkSession, sf_dir: str) -> ReleaseLog:
    c = table(spark, sf_dir, "customer")
    one = c.select(F.col("c_custkey").alias("id"), F.lit("c").alias("of"), F.col("c_name").alias("label"), F.col("c_nationkey").alias("parent"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("note"))
    two = one.filter("note IS NULL OR note <> 'BUILDING'").withColumn("label", F.when(F.col("note") == "MACHINERY", F.concat("label", F.lit(" (machines)"))).otherwise(F.col("label")))
    s = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("id"), F.lit("s").alias("of"), F.col("s_name").alias("label"), F.col("s_nationkey").alias("parent"), F.lit(None).cast("string").alias("note"))
    three = one.withColumn("note", F.lit("x")).filter("parent >= 5").unionByName(s)
    log = ReleaseLog(spark, f"{folder(spark)}/releases-{uuid.uuid4().hex}", ["id", "of"], ["label", "parent", "note"])
    log.publish(one)
    log.publish(two)
    log.base()
    log.publish(three)
    log.rollback(2)
    log.rollback(1)
    return log


def release_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after each release: two are published, a third is, and two rollbacks lead to the second and to the first."""
    log = _released(spark, sf_dir)
    parts = [log.state(n).drop("of").withColumn("number", F.lit(n)) for n in (1, 2, 4, 5, 6)]
    return reduce(DataFrame.unionByName, parts)


def release_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each release created, updated and removed."""
    return _released(spark, sf_dir).history(["id"])


_STATES = """
a AS (SELECT c_custkey AS id, c_name AS label, c_nationkey AS parent, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS note FROM customer),
b AS (SELECT id, CASE WHEN note = 'MACHINERY' THEN concat(label, ' (machines)') ELSE label END AS label, parent, note FROM a WHERE note IS NULL OR note <> 'BUILDING'),
c AS (SELECT id, label, parent, 'x' AS note FROM a WHERE parent >= 5 UNION ALL SELECT -s_suppkey, s_name, s_nationkey, NULL FROM supplier)"""
O_STATES = f"""WITH {_STATES}
SELECT *, 1 AS number FROM a UNION ALL SELECT *, 2 FROM b UNION ALL SELECT *, 4 FROM c UNION ALL SELECT *, 5 FROM b UNION ALL SELECT *, 6 FROM a"""


def _moved(n: int, kind: str, target: str, x: str, y: str) -> str:
    same = "x.label IS NOT DISTINCT FROM y.label AND x.parent IS NOT DISTINCT FROM y.parent AND x.note IS NOT DISTINCT FROM y.note"
    return f"SELECT {n} AS number, '{kind}' AS kind, {target} AS target, count(*) FILTER (WHERE x.id IS NULL) AS created, count(*) FILTER (WHERE x.id IS NOT NULL AND y.id IS NOT NULL AND NOT ({same})) AS updated, count(*) FILTER (WHERE y.id IS NULL) AS removed FROM {x} x FULL JOIN {y} y ON x.id = y.id"


O_HISTORY = f"WITH {_STATES}, z AS (SELECT * FROM a WHERE false) " + " UNION ALL ".join((_moved(1, "publish", "NULL", "z", "a"), _moved(2, "publish", "NULL", "a", "b"), _moved(4, "publish", "NULL", "b", "c"), _moved(5, "rollback", "2", "c", "b"), _moved(6, "rollback", "1", "b", "a")))

QUERIES = {"release_rollback": release_states, "release_history": release_history}
ORACLES = {"release_rollback": O_STATES, "release_history": O_HISTORY}
