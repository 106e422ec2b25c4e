"""Document fingerprints (operator 13): MinHash signatures, their bands joined in Spark, and Jaccard verified.

A text's shingles are runs of five words (A-Z lowered; fewer words: all of them as one). Each of LANES universal hash
permutations x -> a x + b (mod 2^64, a odd) keeps its smallest value over the shingles, of which 16 mixed bits go into
the fingerprint, as four hex digits a lane. The likeness of two fingerprints is the share of lanes that agree, which
estimates the Jaccard similarity of the shingle sets with a standard error of at most 0.05.

`edits` replaces the end of every text by the beginning of the next one. Ids alone are dealt to ranges; then texts go to
the range of their id, from large to small, so that the next document is the one before: no task orders the corpus, and
a task holds two documents, however many rows share an id. The document that follows a range is sent to it as well.

`classes` joins bands: equal shingle sets are one member; in each bucket of a band its smallest member leads, pairs with
the leader are verified on whole sets, what is similar joins the leader's class and leaves the bucket, and the rest goes
to another round with leaders of its own, FASTER times as many each time, until no bucket is left. A bucket of m similar
sets so costs m pairs, and one of m unlike sets takes as many rounds as m has digits. Two sets
at a similarity of 0.75 share a bucket with a probability of 0.998 (25 bands of five lanes).

Defined cases: a null text is an empty one; without words the fingerprint is empty, which is like an empty one (1) and
unlike any other (0); equal texts have equal fingerprints; rows that share a doc_id have the same next document, the one
of the next larger id, and of its rows that with the least 64-bit hash; after the largest id comes the smallest, which
may be the same document; a row without doc_id is no document's next and has none: its end is cut off, and near_next is
null; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import WordHash, bounded_batches, columns_of, documents, grams, id_and_text, mixed, signed, spread, written
from quernstone.llm.components import components
from quernstone.sources.shared import bucketed, dropped

#: Words of a shingle; permutations; bands of a signature and lanes of a band; the similarity that links, in a hundred; the part of a text that an edit replaces.
SHINGLE, LANES, BANDS, ROWS, SIMILAR, EDITED = 5, 128, 25, 5, 75, 4
#: How many times more sets of a bucket lead in each round than in the one before, and how many at most: fewer rounds, each of which reads all sets.
FASTER, MOST = 4, 512
#: Shingles that are permuted at once.
BLOCK = 2048
_RANDOM = np.random.Generator(np.random.PCG64(13))
A = _RANDOM.integers(0, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _RANDOM.integers(0, 1 << 64, LANES, dtype=np.uint64)
_words: list[WordHash] = []


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of a text's shingles, in order."""
    if not _words:
        _words.append(WordHash())
    codes = _words[0](text.encode("utf-8", "surrogatepass").lower())
    return grams(codes, min(SHINGLE, len(codes))) if len(codes) else codes


def signature(codes: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation over the shingles, as 16 bits; empty without shingles."""
    if not len(codes):
        return np.empty(0, np.uint16)
    least = np.full(LANES, ~np.uint64(0))
    for i in range(0, len(codes), BLOCK):
        np.minimum(least, (A[:, None] * codes[i : i + BLOCK] + B[:, None]).min(axis=1), out=least)
    return (mixed(least) >> np.uint64(48)).astype(np.uint16)


def told(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of equal lanes of two fingerprints."""
    if len(a) != len(b) or not a:
        return float(a == b)
    x, y = (np.frombuffer(s.encode(), np.uint32) for s in (a, b))
    return float((x == y).mean())


def _ranges(docs: DataFrame) -> tuple[list[int], DataFrame]:
    """Ranges of doc_id with about as many ids each: the smallest id of every range but its order, and (doc_id, of, part) of the first document beyond each.

    One row for each partition of the shuffle, whatever the size of the corpus.
    """
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("of"))
    dealt = written(ids.repartitionByRange(spread(docs.sparkSession), "doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    firsts = sorted((r["x"]["doc_id"], r["x"]["of"]) for r in dealt.groupBy("part").agg(F.min(F.struct("doc_id", "of")).alias("x")).collect())
    beyond = [(*firsts[(i + 1) % len(firsts)], i) for i in range(len(firsts))]
    return [i for i, _ in firsts], docs.sparkSession.createDataFrame(beyond, "doc_id long, of long, part int")


def in_order(docs: DataFrame) -> DataFrame:
    """(part, beyond, doc_id, of, text): texts dealt by ranges of doc_id, from large to small within a range, and before each range the document that follows it.

    docs: (doc_id, text), without null ids. This is the one place where texts are shuffled.
    """
    starts, beyond = _ranges(docs)

    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(starts, np.int64), ids.to_numpy(), side="right") - 1, dtype="int32")

    hashed = docs.withColumn("of", F.xxhash64("text"))
    own = hashed.select(F.pandas_udf(_as_series(part), "int")("doc_id").alias("part"), F.lit(False).alias("beyond"), "doc_id", "of", "text")
    follows = hashed.join(F.broadcast(beyond), ["doc_id", "of"]).select("part", F.lit(True).alias("beyond"), "doc_id", "of", "text")
    n = spread(docs.sparkSession)
    return own.unionByName(follows).repartitionById(n, F.col("part")).sortWithinPartitions("part", F.desc("beyond"), F.desc("doc_id"), F.desc("of"))


def _as_series(f):
    def g(ids: pd.Series) -> pd.Series:
        return f(ids)

    return g


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in EDITS.split(", ")])


def _edit(doc_id: int | None, text: str, own: str, after: str, of_next: str | None) -> tuple:
    """A row of the result: the text's last part replaced by the first of the next one."""
    n = len(text) // EDITED
    other = text[: len(text) - n] + after[:n]
    print_ = told(signature(shingles(other)))
    return doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), own, print_, likeness(own, print_), None if of_next is None else likeness(own, of_next)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents from large ids to small; of the id before, the last row (its least hash) is what follows."""
    part = here = None
    after, last = ("", None), ("", None)
    for parts, beyonds, ids, texts in columns_of(batches, "part", "beyond", "doc_id", "text"):
        out = []
        for p, beyond, i, text in zip(parts, beyonds, ids, texts, strict=True):
            own = told(signature(shingles(text)))
            if beyond or p != part:
                part, here, after = p, None, ("", None)
            elif i != here:
                after = last
            if not beyond:
                here = i
                out.append(_edit(i, text, own, *after))
            last = (text, own)
        if out:
            yield _batch(out)


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in columns_of(batches, "doc_id", "text"):
        if ids:
            yield _batch([_edit(i, t, told(signature(shingles(t))), "", None) for i, t in zip(ids, texts, strict=True)])


def edits(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text, of its edited text, and their likeness to each other and to the next document."""
    bounded_batches(docs.sparkSession)
    plain = id_and_text(docs)
    known = plain.filter("doc_id is not null")
    alone = plain.filter("doc_id is null").mapInArrow(_alone, EDITS)
    if known.isEmpty():
        return alone
    return in_order(known).mapInArrow(_edits, EDITS).unionByName(alone)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(documents(spark, sf_dir))


SETS = "doc_id long, h1 long, h2 long, bands array<long>, tokens array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's set, its bands, and 128 bits of the set."""
    for ids, texts in columns_of(batches, "doc_id", "text"):
        out = []
        for i, text in zip(ids, texts, strict=True):
            codes = np.unique(shingles(text))
            if not len(codes) or i is None:
                continue
            lanes = signature(codes)[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
            bands = np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                bands = mixed(bands * np.uint64(0xD6E8FEB86659FD93) + lanes[:, r] + np.uint64(1))
            h = [int(mixed(codes ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (1, 2)]
            out.append((i, *h, signed(bands).tolist(), signed(codes)))
        cols = list(zip(*out, strict=True)) or [()] * 5
        types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in SETS.split(", ")])


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two sets, as sorted arrays, are similar enough."""
    both = (len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True))
    return pd.Series([100 * n >= SIMILAR * (len(x) + len(y) - n) for n, x, y in zip(both, a, b, strict=True)], dtype="bool")


def band_links(sets: DataFrame, with_tokens: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(a, b): verified links between sets, found by the leaders of buckets. sets: (id, bands, tokens), a written table.

    with_tokens: from pairs and the name of an id to pairs with `{name}_tokens`, if sets come without tokens.
    """
    buckets, many = written(sets.select("id", F.posexplode("bands").alias("band", "key")), "buckets"), 1
    links = None
    while True:
        # the smallest are chosen before the shuffle, so a bucket of any size is one short row
        least = F.row_number().over(Window.partitionBy("band", "key").orderBy("id"))
        leaders = buckets.withColumn("at", least).filter(F.col("at") <= many).groupBy("band", "key").agg(F.array_agg("id").alias("leaders"), F.max("id").alias("last"))
        met = buckets.join(written(leaders, "leaders"), ["band", "key"])
        follows = F.explode(F.filter("leaders", lambda x: x < F.col("id"))).alias("leader")
        followers = written(met.select("id", "band", "key", (F.col("id") > F.col("last")).alias("stays"), follows), "followers")
        if followers.isEmpty():
            return links if links is not None else sets.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
        pairs = followers.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
        if links is not None:  # another bucket has told it
            pairs = pairs.join(links, ["a", "b"], "left_anti")
        of = with_tokens or (lambda d, name: d.join(sets.select(F.col("id").alias(name), F.col("tokens").alias(f"{name}_tokens")), name))
        checked = of(of(pairs, "a"), "b").filter(F.pandas_udf(_similar, "boolean")("a_tokens", "b_tokens")).select("a", "b")
        found = written(checked, "links")
        links = found if links is None else links.unionByName(found)
        told = links.select(F.col("a").alias("leader"), F.col("b").alias("id"), F.lit(True).alias("linked"))
        rest = followers.join(told, ["leader", "id"], "left").groupBy("id", "band", "key").agg(F.bool_or("stays").alias("stays"), F.bool_or("linked").alias("linked"))
        old, buckets = buckets, written(rest.filter("stays AND linked IS NULL").select("id", "band", "key"), "buckets")
        for table in (old, followers):  # what a round has read goes before the next one writes its own
            dropped(table)
        many = min(FASTER * many, MOST)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id of each document's class of near duplicates; a document without words is its own class."""
    bounded_batches(docs.sparkSession)
    plain = id_and_text(docs)
    # tokens are shuffled once, into buckets by document; pairs go to them
    sets = bucketed(plain.mapInArrow(_sets, SETS), "sets", "doc_id")
    members = written(sets.groupBy("h1", "h2", "doc_id").agg(F.lit(1)).select("h1", "h2", "doc_id"), "members")
    # tables on both sides of a join, so that Spark can split a set that a third of all documents have
    leads = written(members.groupBy("h1", "h2").agg(F.min("doc_id").alias("lead")), "leads")
    first = sets.select("doc_id", "h1", "h2", "bands").join(leads, ["h1", "h2"]).filter("doc_id = lead").dropDuplicates(["h1", "h2"]).sortWithinPartitions("h1", "h2")  # who leads is told by ids
    own = written(first.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "lead", "bands"), "distinct")

    def with_tokens(pairs: DataFrame, name: str) -> DataFrame:
        """By document alone, as the buckets are; of rows that share a doc_id, the one with the set's 128 bits."""
        who = own.select(F.col("id").alias(name), F.col("lead").alias("_doc"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
        held = sets.select(F.col("doc_id").alias("_doc"), "h1", "h2", F.col("tokens").alias(f"{name}_tokens"))
        same = F.col("h1").bitwiseXOR(F.col("_h1")).bitwiseOR(F.col("h2").bitwiseXOR(F.col("_h2"))) == 0
        return pairs.join(who, name).join(held, "_doc").filter(same).drop("_doc", "_h1", "_h2", "h1", "h2")

    reached = components(band_links(own, with_tokens)).withColumnRenamed("node", "id")
    groups = own.select("id", "h1", "h2", "lead").join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = groups.groupBy("component").agg(F.min("lead").alias("class_id"))
    of_set = written(groups.join(smallest, "component").select("h1", "h2", "class_id"), "classes")
    by_id = members.join(of_set, ["h1", "h2"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return plain.select("doc_id").distinct().join(by_id, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class that the bands find."""
    return classes(documents(spark, sf_dir))
