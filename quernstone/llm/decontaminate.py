"""Benchmark decontamination (operator 3): spaced-seed hashing.

A mask says which of a few consecutive words a seed looks at; a substituted word at an ignored place changes nothing.
The seeds of all benchmark items are compared with those of every position of every document; around each hit the item
is laid over the document without gaps and verified.

An overlap counts if MIN_SHARE per cent of the item's words agree anywhere in it (MIN_WORDS of them at least, or all if
the item is shorter), or if in its best run ENOUGH words agree, or as many as that share; in the score of a run a
substitution costs as much as PENALTY agreements. The masks are complete for this: however the words that agree are
spread over an item, if it counts some mask stands on agreeing words alone (tests/llm proves it over all patterns).

The benchmark goes to the executors in blocks of at most BLOCK_WORDS words, one scan of the documents for each block.

Defined cases: a null or empty text, or item, matches nothing; an item shorter than every mask must occur word for
word; repeated items and rows give repeated results; a row without doc_id is searched like any other and carries a
null id; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import WordHash, bounded_batches, columns_of, documents, id_and_text

#: The masks; 1 is a word that is looked at.
MASKS = ("1111", "10111", "11011", "110101", "111001", "1000111", "1101001")
MIN_SHARE, MIN_WORDS, ENOUGH, PENALTY = 60, 8, 13, 2
BLOCK_WORDS = 1_000_000
#: Diagonals, and words of theirs, that are compared at a time; seed hits that are held at once; hits for each diagonal from which an item's words
#: are counted instead; text positions that are counted at once, and whose seeds are made at once.
DIAGONALS, COMPARED, AT_ONCE, CROWDED, WINDOW, SPAN = 1 << 14, 1 << 20, 1 << 20, 2, 1 << 18, 1 << 18

#: Letters to lower case, and everything else in ASCII but digits to white space.
FOLD = bytes(c if chr(c).islower() or chr(c).isdigit() or c > 127 else c + 32 if chr(c).isupper() else 32 for c in range(256))

HITS = "doc_id long, item_id long, n_matched long, n_item_words long, first_word long, last_word long"


def folded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(FOLD)


#: A random odd factor for each word that a seed looks at; word hashes are mixed already, so a seed is the sum of products.
FACTORS = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 63, max(m.count("1") for m in MASKS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOW = np.uint64((1 << 20) - 1)


def products(codes: np.ndarray) -> list[np.ndarray]:
    """The words of a text times each factor, once for all masks."""
    return [codes * f for f in FACTORS]


def seeds(parts: list[np.ndarray], mask: str) -> np.ndarray:
    """The hash of each position's seed under a mask. parts: products of the words."""
    n = len(parts[0]) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    looked = [i for i, bit in enumerate(mask) if bit == "1"]
    h = parts[0][:n] + np.uint64(int(mask, 2))
    for part, i in zip(parts[1:], looked[1:], strict=False):
        h += part[i : i + n]
    return h


def needed(n: int) -> int:
    """How many words of an item of n must agree for the whole of it to count."""
    return min(n, max(MIN_WORDS, -(-MIN_SHARE * n // 100)))


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1 ... for n places each, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Block:
    """Items of the benchmark with the seeds of all their positions."""

    def __init__(self, ids: list[int], texts: list[str]):
        hashed = WordHash()
        kept = [(i, c) for i, t in zip(ids, texts, strict=True) if len(c := hashed(folded(t)))]
        self.ids, self.items = [i for i, _ in kept], [c for _, c in kept]
        short = sorted({len(c) for c in self.items if len(c) < min(map(len, MASKS))})
        self.masks = [*MASKS, *("1" * n for n in short)]
        found = []
        for k, c in enumerate(self.items):
            for m in self.masks:
                if m in MASKS or len(m) == len(c):
                    h = seeds(products(c), m)
                    found.append((h, np.full(len(h), k), np.arange(len(h))))
        h, item, at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int))
        by = np.argsort(h, kind="stable")
        self.hashes, self.item, self.at = h[by], item[by], at[by]
        self.sizes = np.array([len(c) for c in self.items], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate(self.items) if self.items else np.empty(0, np.uint64)
        self.needs = np.array([needed(n) for n in self.sizes.tolist()], dtype=np.int64)
        self.low = np.zeros(int(LOW) + 1, dtype=bool)
        self.low[h & LOW] = True

    def diagonals(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, starts, agreeing words): where an item's first word would stand, for the hits where enough words agree to count in any way.

        Equal seeds of a repetitive text and a repetitive item are as many as their product. Where a text has more of
        them than AT_ONCE, they are counted by item first (each seed of the benchmark once): items with more hits than
        diagonals have the words of all their diagonals counted instead, and the rest go in groups of a bounded number.
        """
        hits = [self._hits(codes, i) for i in range(0, len(codes), SPAN)]
        if not hits:
            return
        maybe, lo, n = (np.concatenate(x) for x in zip(*hits, strict=True))
        if not len(maybe):
            return
        if int(n.sum()) <= AT_ONCE:
            yield from self._grouped(codes, maybe, lo, n, None)
            return
        load = np.zeros(len(self.items), dtype=np.int64)
        seed, first, times = np.unique(lo, return_index=True, return_counts=True)
        load += np.bincount(self.item[ranges(seed, n[first])], weights=np.repeat(times, n[first]), minlength=len(load)).astype(np.int64)
        crowded = load > CROWDED * (len(codes) + self.sizes)
        for k in np.flatnonzero(crowded):
            yield from self._counted(codes, int(k))
        load[crowded] = 0
        group = np.where(load > 0, np.cumsum(load) // AT_ONCE, -1)
        for g in np.unique(group[group >= 0]):
            yield from self._grouped(codes, maybe, lo, n, group == g)

    def _hits(self, codes: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions from `begin` on, SPAN of them, whose seed under a mask is one of the benchmark's; where its entries begin, and how many there are."""
        parts = products(codes[begin : begin + SPAN + max(map(len, self.masks)) - 1])
        of_mask = [seeds(parts, m)[:SPAN] for m in self.masks]
        h = np.concatenate(of_mask)
        begins = np.cumsum([0, *map(len, of_mask)])
        maybe = np.flatnonzero(self.low[h & LOW])
        lo, hi = (np.searchsorted(self.hashes, h[maybe], side) for side in ("left", "right"))
        some = hi > lo
        maybe, lo, n = maybe[some], lo[some], (hi - lo)[some]
        return maybe - begins[np.searchsorted(begins, maybe, "right") - 1] + begin, lo, n

    def _grouped(self, codes: np.ndarray, maybe: np.ndarray, lo: np.ndarray, n: np.ndarray, chosen: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The diagonals of hits, of chosen items alone if told so."""
        item, at = self.item, self.at
        if chosen is not None:
            mine = chosen[item]
            item, at, before = item[mine], at[mine], np.concatenate([[0], np.cumsum(mine)])
            lo, n = before[lo], before[lo + n] - before[lo]
        x = ranges(lo, n)
        # an item starts no further before the text than it is long
        back = int(self.sizes.max(initial=0))
        wide = len(codes) + back + 1
        keys = np.unique(item[x] * wide + np.repeat(maybe, n) - at[x] + back)
        found, i = [], 0
        while i < len(keys):
            # as many diagonals as their items have words in all, so that long items don't widen the comparison
            size = np.cumsum(self.sizes[keys[i : i + DIAGONALS] // wide])
            j = i + max(1, int(np.searchsorted(size, COMPARED)))
            k, start = keys[i:j] // wide, keys[i:j] % wide - back
            first = np.maximum(0, -start)
            n = np.minimum(self.sizes[k], len(codes) - start) - first
            same = self.words[ranges(self.begins[k] + first, n)] == codes[ranges(start + first, n)]
            agree = np.add.reduceat(same, np.cumsum(n) - n, dtype=np.int64)
            good = agree >= np.minimum(self.needs[k], ENOUGH)
            found.append((k[good], start[good], agree[good]))
            i = j
        k, start, agree = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(k):
            return
        cut = np.flatnonzero(np.diff(k)) + 1
        for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(k)]]), strict=True):
            yield int(k[a]), start[a:b], agree[a:b]

    def _counted(self, codes: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The diagonals of one item by counting, for each of its words, where text and item agree: pair by pair, or by one convolution where a word is frequent in both."""
        item = self.items[k]
        m, least = len(item), min(int(self.needs[k]), ENOUGH)
        words, place = np.unique(item, return_inverse=True)
        step = max(WINDOW, 4 * m)
        starts, agrees = [], []
        for begin in range(1 - m, len(codes), step):
            low = max(0, begin)
            text = codes[low : begin + step + m - 1]
            # agreement by start, from `begin` on
            agree, size = np.zeros(step, dtype=np.int64), 1 << int(step + 2 * m).bit_length()
            at = np.minimum(np.searchsorted(words, text), len(words) - 1)
            known = words[at] == text
            where = np.flatnonzero(known)
            by = where[np.argsort(at[where], kind="stable")]
            ends = np.searchsorted(at[by], np.arange(len(words) + 1))
            for w in range(len(words)):
                p, q = by[ends[w] : ends[w + 1]] + low, np.flatnonzero(place == w)
                if not len(p):
                    continue
                if len(q) > 32 and len(p) * len(q) > 16 * step:
                    x, y = np.zeros(size), np.zeros(size)
                    x[p - begin], y[q] = 1, 1
                    both = np.rint(np.fft.irfft(np.fft.rfft(x) * np.conj(np.fft.rfft(y)), size)).astype(np.int64)
                    agree += both[:step]
                    continue
                for i in range(0, len(p), max(1, AT_ONCE // len(q))):
                    s = (p[i : i + max(1, AT_ONCE // len(q)), None] - q - begin).ravel()
                    agree += np.bincount(s[(s >= 0) & (s < step)], minlength=step)
            good = np.flatnonzero(agree >= least)
            starts.append(good + begin)
            agrees.append(agree[good])
        start, agree = np.concatenate(starts), np.concatenate(agrees)
        if len(start):
            yield k, start, agree

    def _best(self, codes: np.ndarray, k: int, starts: np.ndarray, agrees: np.ndarray) -> tuple[int, int, int] | None:
        """(agreeing words, first and last word in the text) of the item's best overlap that counts: by agreeing words, then the first."""
        item, m = self.items[k], len(self.items[k])
        need = needed(m)
        by = np.lexsort((starts, -agrees))
        starts, agrees = starts[by], agrees[by]
        if agrees[0] >= need:  # no overlap of the rest can be better
            s = int(starts[0])
            a, b = max(0, -s), min(m, len(codes) - s)
            at = np.flatnonzero(item[a:b] == codes[s + a : s + b])
            return int(agrees[0]), s + a + int(at[0]), s + a + int(at[-1])
        best, rows = None, max(1, COMPARED // m)
        for i in range(0, len(starts), rows):
            if best and agrees[i] < best[0]:
                break
            s = starts[i : i + rows, None]
            at = s + np.arange(m)
            inside = (at >= 0) & (at < len(codes))
            same = inside & (codes[np.where(inside, at, 0)] == item)
            # the best run of each: agreements count 1, others -PENALTY; it begins after the last place where the sum is least
            score = np.concatenate([np.zeros((len(s), 1), np.int64), np.cumsum(np.where(same, 1, -PENALTY), axis=1)], axis=1)
            low = np.minimum.accumulate(score, axis=1)
            end = np.argmax(score - low, axis=1)
            is_low = (score == low) & (np.arange(m + 1) <= end[:, None])
            begin = m - np.argmax(is_low[:, ::-1], axis=1)
            total = np.concatenate([np.zeros((len(s), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
            row = np.arange(len(s))
            n = total[row, end] - total[row, begin]
            for j in np.flatnonzero(n >= min(need, ENOUGH)):
                start = int(s[j, 0])
                if best is None or (int(n[j]), -start) > (best[0], -best[3]):
                    best = (int(n[j]), start + int(begin[j]), start + int(end[j]) - 1, start)
        return best[:3] if best else None

    def verified(self, codes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item id, agreeing words, words of the item, first and last word in the text) of the overlaps that count; the best for each item."""
        found = sorted((k, x) for k, starts, agrees in self.diagonals(codes) if (x := self._best(codes, k, starts, agrees)))
        return [(self.ids[k], n, len(self.items[k]), first, last) for k, (n, first, last) in found]


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in pieces of bounded size, one at a time on the driver."""
    ids, texts, n = [], [], 0
    for row in benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        n += len(row["text"]) // 2 + 1
        if n >= BLOCK_WORDS:
            yield Block(ids, texts)
            ids, texts, n = [], [], 0
    yield Block(ids, texts)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item with an overlap that counts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out = None
    for block in blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hashed = WordHash()
            for ids, texts in columns_of(batches, "doc_id", "text"):
                found = [(i, *x) for i, t in zip(ids, texts, strict=True) for x in sent.value.verified(hashed(folded(t)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 6, names=[x.split()[0] for x in HITS.split(", ")])

        part = id_and_text(docs).mapInArrow(rows, HITS)
        out = part if out is None else out.unionByName(part)
    return out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that overlap with a benchmark item; the verdict is computed beside the row, block by block."""
    bounded_batches(spark)
    for block in blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        sent = spark.sparkContext.broadcast(block)

        def clean(texts: pd.Series, sent=sent) -> pd.Series:
            hashed = WordHash()
            return pd.Series([not sent.value.verified(hashed(folded(t))) for t in texts], dtype="bool")

        docs = docs.filter(F.pandas_udf(_one_column(clean), "boolean")(F.coalesce(F.col("text"), F.lit(""))))
    return docs


def _one_column(f):
    def g(texts: pd.Series) -> pd.Series:
        return f(texts)

    return g
