"""What the operators of this subpackage share: settings, tables of ids and word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.shared import dropped
from quernstone.sources.shared import kept as written

#: Ids, of eight bytes each, that are broadcast at most.
SENT_IDS = 1_000_000
#: Bounds of one Arrow batch: a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, so that memory doesn't depend on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns, whatever their names, can't get in the way; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def sent_if_few(table: DataFrame) -> DataFrame:
    """A written table of ids, broadcast if it has few rows; else a join shuffles both sides."""
    return F.broadcast(table) if table.count() <= SENT_IDS else table


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with one of these doc_ids."""
    return docs.join(sent_if_few(written(ids.select("doc_id").distinct(), "ids")), "doc_id", "left_semi")


def spread(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class WordHash:
    """64-bit hashes of the words of a text, all at once: sums of a random number for each byte times a power of R.

    Words are the runs of bytes other than ASCII white space. Long texts go in blocks, cut at white space.
    """

    R, BLOCK = 0x9E3779B97F4A7C15, 1 << 20

    def __init__(self):
        self.of_byte = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        up, down = np.full(n, self.R, np.uint64), np.full(n, pow(self.R, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def __call__(self, data: bytes) -> np.ndarray:
        if len(data) <= self.BLOCK:
            return self._block(data)
        parts, at = [], 0
        while at < len(data):
            end = at + self.BLOCK
            while end < len(data) and not self.space[data[end]]:
                end += 1
            parts.append(self._block(data[at:end]))
            at = end
        return np.concatenate(parts)

    def _block(self, data: bytes) -> np.ndarray:
        b = np.frombuffer(data, dtype=np.uint8)
        if len(b) >= len(self.up):
            self._powers(2 * len(b))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], self.space[b], [True]])))
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.of_byte[b] * self.up[: len(b)], dtype=np.uint64)])
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = mixed(codes[:n])
    for i in range(1, k):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + codes[i : i + n])
    return h


def long_gram(codes: np.ndarray, k: int) -> np.ndarray:
    """grams() for large k, by doubling: the work grows with log k."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h, have = mixed(codes), 1
    while have < k:
        step = min(have, k - have)
        m = len(h) - step
        h = mixed(h[:m] * np.uint64(0xD6E8FEB86659FD93) + mixed(h[step : step + m] ^ np.uint64(have * 1000 + step)))
        have += step
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def columns_of(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Python lists of the named columns, batch by batch."""
    for b in batches:
        yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)
