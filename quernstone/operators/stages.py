"""Stages whose outputs outlive a broken run: a manifest by fingerprint, pauses between stages, restarts that skip what is complete.

A stage is a name, a version, its parameters and a function from DataFrame to DataFrame. The fingerprint of its output is
that of its input (for the source: how many rows, and the sum of their hashes) with name, version and parameters, so a
changed source, stage or parameter makes this stage and all later ones run again, and nothing else. A header is written
after the output is complete; an output without one is no output. Two runs at once write to folders of their own, and
whichever header is read says the same.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators.tables import group_key
from quernstone.sources.shared import folder, forget
from quernstone.sources.tables import table

HEADER = "fingerprint string, stage string, place string, n long, cleared boolean"


@dataclass
class Stage:
    name: str
    make: Callable[[DataFrame], DataFrame]
    version: int = 1
    params: dict = field(default_factory=dict)


@dataclass
class Run:
    """What a run did: (stage, `done` or `kept` or `paused`) in order, and the last complete output (None if a pause came before any)."""

    steps: list[tuple[str, str]]
    output: DataFrame | None

    @property
    def complete(self) -> bool:
        return all(how != "paused" for _, how in self.steps)


def digest(rows: DataFrame) -> str:
    """A fingerprint of a table's rows, whatever their order: how many there are, and the sums of two hashes. Columns count by name and place."""
    cols = [F.col(f"`{c}`") for c in rows.columns]
    sums = [F.sum(F.xxhash64(F.lit(i), *cols).cast("decimal(38,0)")) for i in (1, 2)]
    n, a, b = rows.agg(F.count(F.lit(1)), *sums).first()
    return hashlib.sha256(json.dumps([rows.schema.simpleString(), n, str(a), str(b)]).encode()).hexdigest()


class Stages:
    """Runs of stages whose outputs and control lie below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, what: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).json(f"{self.path}/{what}/*")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        """(fingerprint, stage, place, n) of every complete output."""
        return self._read("manifest", HEADER).filter("NOT cleared").drop("cleared")

    def _put(self, what: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{self.path}/{what}/{uuid.uuid4().hex}")

    def pause(self) -> None:
        """Asks runs to stop before their next stage."""
        self._put("control", [("pause",)], "asked string")

    def resume(self) -> None:
        forget(self.spark, f"{self.path}/control")

    def paused(self) -> bool:
        return not self._read("control", "asked string").isEmpty()

    def clear(self) -> None:
        """Forgets all outputs, and a pause."""
        for what in ("manifest", "control", "out"):
            forget(self.spark, f"{self.path}/{what}")

    def _kept(self, fingerprint: str) -> DataFrame | None:
        row = self.manifest().filter(F.col("fingerprint") == fingerprint).first()
        return self.spark.read.parquet(row["place"]) if row else None

    def run(self, source: DataFrame, stages: list[Stage]) -> Run:
        """The stages in order, each on what the one before left; those whose output is complete are not made again."""
        at, rows, steps, output = digest(source), source, [], None
        for s in stages:
            at = hashlib.sha256(json.dumps([at, s.name, s.version, s.params], sort_keys=True, default=str).encode()).hexdigest()
            found = self._kept(at)
            if found is not None:
                rows = output = found
                steps.append((s.name, "kept"))
                continue
            if self.paused():
                steps.append((s.name, "paused"))
                break
            place = f"{self.path}/out/{at[:16]}-{uuid.uuid4().hex}"
            s.make(rows).write.option("compression", "zstd").parquet(place)
            rows = output = self.spark.read.parquet(place)
            self._put("manifest", [(at, s.name, place, output.count(), False)], HEADER)
            steps.append((s.name, "done"))
        return Run(steps, output)


# queries


class Broken(RuntimeError):
    """What stops the first run of the demonstration."""


def _parts(broken: bool) -> list[Stage]:
    """Parts parsed to words, gated by their type, keyed and aligned."""

    def fail(_: DataFrame) -> DataFrame:
        raise Broken

    parse = Stage("parse", lambda d: d.select("p_partkey", "p_type", "p_size", F.split("p_name", " ").alias("words")))
    gate = Stage("gate", lambda d: d.filter("p_type <> 'PROMO'"), params={"without": "PROMO"})
    key = Stage("key", fail if broken else lambda d: d.select("p_partkey", group_key([F.get("words", F.lit(0)), F.col("p_type")], F.col("p_partkey").cast("string"), F.col("p_size") > 25).alias("key"), T.short_span(F.get("words", F.lit(0))).alias("short")))
    return [parse, gate, key]


def staged_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that breaks in its third stage, and a second one that makes that stage alone; `kept` says how many stages it didn't repeat."""
    stages = Stages(spark, f"{folder(spark)}/stages-{uuid.uuid4().hex}")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    try:
        stages.run(p, _parts(broken=True))
    except Broken:
        pass
    done = stages.run(p, _parts(broken=False))
    return done.output.withColumn("kept", F.lit(sum(how == "kept" for _, how in done.steps)))


O_RERUN = """
SELECT p_partkey, CASE WHEN p_size > 25 THEN concat(split_part(p_name, ' ', 1), '|', p_type) ELSE p_partkey::VARCHAR END AS key, length(split_part(p_name, ' ', 1)) <= 4 AS short, 2 AS kept FROM part WHERE p_type <> 'PROMO'
"""

QUERIES = {"staged_rerun": staged_rerun}
ORACLES = {"staged_rerun": O_RERUN}
