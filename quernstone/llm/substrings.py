"""Substring dedup (operator 6): repeated-phrase automata.

A window is WINDOW consecutive words. A word goes if a window that covers it also starts in a document with a smaller
doc_id.

1. Every window names the least hash among its runs of PHRASE words. Equal windows name the same, so only windows that
   name a phrase met in two documents can recur; that is a few in a hundred. Phrases met in two documents are counted.
   Up to TOLD of them are told to all tasks as a bit table, sized by their number: a wrong yes costs time, and no yes is
   missed. Beyond that they are joined with the phrases of each document instead.
2. Passages are confirmed: the hashes of windows that may recur are aggregated to the first document with each (before
   the shuffle as well, so a passage that a third of all documents share is one row per task). The first document's
   runs of such windows are its recurring passages, cut in one pass over it into pieces of bounded length.
3. Documents are dealt into shards. Each shard compiles an Aho-Corasick automaton (pyahocorasick) of the passages that
   its documents may hold, a word being one character, in blocks of half a window; it streams its documents through
   and extends every occurrence word by word. A passage that all documents share is sent to every shard: no shard gets
   more than its documents.

Documents without a window that may recur take no part in 2 and 3.

Defined cases: a null or empty text, or one of fewer than WINDOW words, loses nothing; rows that share a doc_id are one
document: none makes another lose, and each is judged by its own text; a row without doc_id loses nothing and makes no others lose; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import WordHash, bounded_batches, columns_of, documents, grams, id_and_text, long_gram, mixed, signed, spread, with_ids, written

#: Words of a window, of the phrases that stand for it, of an automaton's pattern, and of a passage's pieces at most.
WINDOW, PHRASE, BLOCK, PIECE = 50, 10, 25, 1000
#: Phrases that a bit table tells of at most; its parts, of 2^PART_BITS bits each; bits of the table for each phrase, two of them set.
TOLD, PART_BITS, BITS_EACH = 20_000_000, 20, 24
#: Words of the documents of a shard, about.
SHARD_WORDS = 400_000

SCANNED = "doc_id long, n_words long, sha string, text string, starts array<int>, hashes array<long>"


def named_phrases(codes: np.ndarray) -> np.ndarray:
    """For each window, the least phrase hash in it (by blocks of prefix and suffix minima)."""
    h = grams(codes, PHRASE)
    k = WINDOW - PHRASE + 1
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    top = np.iinfo(np.uint64).max
    square = np.concatenate([h, np.full(-len(h) % k, top, np.uint64)]).reshape(-1, k)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[k - 1 : k - 1 + n])


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashed = WordHash()
    for ids, texts in columns_of(batches, "doc_id", "text"):
        found = [np.unique(named_phrases(hashed(t.encode("utf-8", "surrogatepass")))) for t in texts]
        h = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(np.repeat(np.array(ids, dtype=np.int64), [len(x) for x in found]))], names=["h", "doc_id"])


def _places(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part and the two bits of a phrase."""
    h = mixed(h)
    low = np.uint64((1 << PART_BITS) - 1)
    return ((h >> np.uint64(44)) % np.uint64(parts)).astype(np.int64), (h & low).astype(np.int64), ((h >> np.uint64(PART_BITS)) & low).astype(np.int64)


class Table:
    """Phrases that may recur, as the bits of some parts; at most TOLD * BITS_EACH bits."""

    def __init__(self, parts: int, rows: list):
        self.bits = np.zeros((parts, 1 << PART_BITS >> 3), dtype=np.uint8)
        for r in rows:
            self.bits[r["part"]] |= np.frombuffer(r["bits"], dtype=np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        part, x, y = _places(h, len(self.bits))
        return (self.bits[part, x >> 3] << (x & 7).astype(np.uint8) & self.bits[part, y >> 3] << (y & 7).astype(np.uint8) & np.uint8(128)) > 0


def recurring(plain: DataFrame) -> tuple[DataFrame, int]:
    """The phrases that two documents or more name, written, and their number."""
    several = plain.mapInArrow(_phrases, "h long, doc_id long").groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h")
    several = written(several, "phrases")
    return several, several.count()


def told(several: DataFrame, n: int) -> Table:
    """The bit table of so many phrases; a part is one row, made by one task."""
    parts = max(1, -(-n * BITS_EACH >> PART_BITS))

    def part_of(h: pd.Series) -> pd.Series:
        return pd.Series(_places(h.to_numpy(np.int64).view(np.uint64), parts)[0])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            part, x, y = _places(b.column(0).to_numpy().view(np.uint64), parts)
            by = np.argsort(part, kind="stable")
            part, x, y = part[by], x[by], y[by]
            for p, i, j in zip(*(u.tolist() for u in _runs(part)), strict=True):
                mine = made.setdefault(p, np.zeros(1 << PART_BITS >> 3, dtype=np.uint8))
                for z in (x[i:j], y[i:j]):
                    np.bitwise_or.at(mine, z >> 3, (128 >> (z & 7)).astype(np.uint8))
        for p, mine in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([mine.tobytes()], pa.binary())], names=["part", "bits"])

    dealt = several.withColumn("part", F.pandas_udf(_typed(part_of), "long")("h")).repartition(min(parts, spread(several.sparkSession)), "part").select("h")
    return Table(parts, dealt.mapInArrow(bits, "part long, bits binary").collect())


def _typed(f):
    def g(h: pd.Series) -> pd.Series:
        return f(h)

    return g


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, begin and end of each run of equal values."""
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, dtype=np.int64)
    return x[begin], begin, np.append(begin[1:], len(x))


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def scanned(plain: DataFrame) -> DataFrame:
    """A row per document; the text and its windows that may recur only where there are any."""
    spark = plain.sparkSession
    several, n = recurring(plain.filter("doc_id is not null"))
    if n <= TOLD:
        table = spark.sparkContext.broadcast(told(several, n))
        with_phrases = plain.withColumn("phrases", F.lit(None).cast("array<long>"))
    else:
        table = None
        hits = plain.filter("doc_id is not null").mapInArrow(_phrases, "h long, doc_id long").distinct().join(several, "h", "left_semi")
        hits = hits.groupBy("doc_id").agg(F.collect_list("h").alias("phrases"))  # no more than a document's own
        with_phrases = plain.join(written(hits, "hits"), "doc_id", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for ids, texts, phrases in columns_of(batches, "doc_id", "text", "phrases"):
            out = []
            for i, t, known in zip(ids, texts, phrases, strict=True):
                data = t.encode("utf-8", "surrogatepass")
                codes = hashed(data)
                live = np.empty(0, dtype=np.int64)
                if i is not None and (table or known):
                    named = named_phrases(codes)
                    live = np.flatnonzero(table.value.holds(named) if table else np.isin(named, np.array(known, dtype=np.int64).view(np.uint64)))
                more = (t, live.astype(np.int32), signed(long_gram(codes, WINDOW)[live])) if len(live) else (None, None, None)
                out.append((i, len(codes), digest(data.split()), *more))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCANNED.split(", ")])

    return written(with_phrases.mapInArrow(rows, SCANNED), "scanned")


def _passages(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The words of an owner's runs of recurring windows: a run is cut into pieces where its windows begin in another stretch of so many words."""
    for ids, starts, texts in columns_of(batches, "owner", "at", "text"):
        for o, at, t in zip(ids, starts, texts, strict=True):
            words = t.encode("utf-8", "surrogatepass").split()
            at = np.sort(np.array(at))
            cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(at // size) > 0)) + 1
            out = [(o, int(run[0]) // size, b" ".join(words[run[0] : run[-1] + WINDOW])) for run in np.split(at, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["owner", "piece", "words"])


def characters(codes: np.ndarray) -> str:
    """A character for each word; two words may share one, so what is found is compared word by word."""
    c = (codes % np.uint64(0x10F7FF)).astype(np.uint32) + np.uint32(1)
    return np.where(c >= 0xD800, c + np.uint32(0x800), c).astype("<u4").tobytes().decode("utf-32-le")


class Shard:
    """An automaton of passages. A pattern is a block of half a window at every such distance: each window holds one whole."""

    def __init__(self, passages: list[tuple[tuple[int, int], bytes]]):
        self.hashed = WordHash()
        self.passages: list[np.ndarray] = []
        patterns: dict[str, dict[tuple[int, int], list[tuple[int, int]]]] = {}
        for key, words in passages:
            codes = self.hashed(words)
            text = characters(codes)
            for b in range(0, len(codes) - BLOCK + 1, BLOCK):
                patterns.setdefault(text[b : b + BLOCK], {}).setdefault(key, []).append((len(self.passages), b))
            self.passages.append(codes)
        self.automaton = ahocorasick.Automaton()
        for text, where in patterns.items():
            self.automaton.add_word(text, where)
        self.any = bool(patterns)
        if self.any:
            self.automaton.make_automaton()

    def covered(self, codes: np.ndarray, keys: set[tuple[int, int]]) -> np.ndarray:
        """The words in runs of a window or more that also stand in passages of the given owners' pieces."""
        gone = np.zeros(len(codes), dtype=bool)
        done: dict[tuple[int, int], int] = {}
        for end, where in self.automaton.iter(characters(codes)) if self.any else ():
            q = end - BLOCK + 1
            for key in keys & where.keys():
                for k, b in where[key]:
                    if done.get((k, q - b), -1) >= q:
                        continue
                    p = self.passages[k]
                    back = min(b, q)
                    fore = min(len(p) - b, len(codes) - q)
                    left = np.flatnonzero(p[b - back : b] != codes[q - back : q])
                    right = np.flatnonzero(p[b : b + fore] != codes[q : q + fore])
                    first = q - back + (int(left[-1]) + 1 if len(left) else 0)
                    after = q + (int(right[0]) if len(right) else fore)
                    done[k, q - b] = after - 1
                    if after - first >= WINDOW:
                        gone[first:after] = True
        return gone


def _streamed(_, docs: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
    """A shard's documents through its automaton. sent: passages, and without words, the pieces that a document may hold."""
    is_key = sent["words"].isna()
    keys: dict[int, set[tuple[int, int]]] = {}
    for i, o, p in sent.loc[is_key, ["doc_id", "owner", "piece"]].itertuples(index=False, name=None):
        keys.setdefault(int(i), set()).add((o, p))
    shard = Shard([((o, p), w) for o, p, w in sent.loc[~is_key, ["owner", "piece", "words"]].itertuples(index=False, name=None)])
    out = []
    for i, sha, text in zip(docs["doc_id"], docs["sha"], docs["text"], strict=True):
        data = text.encode("utf-8", "surrogatepass")
        gone = shard.covered(shard.hashed(data), keys.get(int(i), set()))
        out.append((i, sha, int(gone.sum()), digest([w for w, g in zip(data.split(), gone.tolist(), strict=True) if not g])))
    return pd.DataFrame(out, columns=["doc_id", "sha", "n_removed", "kept"])


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    all_ = scanned(id_and_text(docs))
    live = all_.filter("text is not null")
    windows = live.select("doc_id", F.xxhash64("sha").alias("of"), F.inline(F.arrays_zip("starts", "hashes"))).withColumnsRenamed({"starts": "at", "hashes": "h"})
    found = windows.groupBy("h").agg(F.min(F.struct("doc_id", "of", "at")).alias("first"), F.max("doc_id").alias("last")).filter("first.doc_id < last")
    confirmed = written(found.select("h", F.col("first.doc_id").alias("owner"), F.col("first.of").alias("of"), F.col("first.at").alias("at"), (F.col("first.at") / PIECE).cast("int").alias("piece")), "confirmed")

    routes = windows.select("doc_id", "h").join(confirmed.select("h", "owner", "piece"), "h").filter("owner < doc_id").select("doc_id", "owner", "piece").distinct()
    n = int(live.agg(F.sum("n_words")).first()[0] or 0)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // SHARD_WORDS)))).cast("int").alias("shard")
    routes = written(routes.select(shard, "doc_id", "owner", "piece"), "routes")

    texts = live.select("doc_id", "sha", "text")
    # one row per owner, and no more places than its words; of rows that share its id each gives its own passages
    own = confirmed.groupBy("owner", "of").agg(F.collect_set("at").alias("at"))
    owners = with_ids(texts, confirmed.select(F.col("owner").alias("doc_id"))).withColumnRenamed("doc_id", "owner").withColumn("of", F.xxhash64("sha"))
    passages = own.join(owners.dropDuplicates(["owner", "of"]), ["owner", "of"]).mapInArrow(partial(_passages, size=PIECE), "owner long, piece int, words binary")
    dealt = routes.select("shard", "owner", "piece").distinct().join(passages, ["owner", "piece"]).withColumn("doc_id", F.lit(None).cast("long"))
    sent = written(dealt.unionByName(routes.withColumn("words", F.lit(None).cast("binary"))), "sent")
    todo = with_ids(texts, routes).select(shard, "doc_id", "sha", "text")
    result = todo.groupBy("shard").cogroup(sent.groupBy("shard")).applyInPandas(_streamed, "doc_id long, sha string, n_removed long, kept string")
    cut = written(result, "cut").dropDuplicates(["doc_id", "sha"])
    return all_.select("doc_id", "n_words", "sha").join(cut, ["doc_id", "sha"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir))


ORACLE_OP6 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
o AS (SELECT h, min(doc_id) AS owner FROM g GROUP BY h),
d AS (SELECT g.doc_id, g.i FROM g JOIN o ON g.h = o.h AND o.owner < g.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS j FROM d),
l AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
k AS (SELECT l.doc_id, count(c.j) AS n_removed, string_agg(l.word, ' ' ORDER BY l.j) FILTER (WHERE c.j IS NULL) AS kept FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.j = c.j GROUP BY l.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
