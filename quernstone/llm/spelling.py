"""Spelling variant grouping (operator 11): a symmetric-delete join over the vocabulary.

Runs of letters are counted where they stand: a task keeps one counter of bounded size, so that a frequent word is one
row per flush before the shuffle. Every word that occurs often enough emits its own hash and the hashes of its distinct
single deletions, each with the run of equal code points that the deletion touches. Words that share a key are joined;
the runs of two words of one length must meet, and a shorter word must be the key itself. On the strings, a pair stays
if deleting the shared place gives equal texts, which shows a distance of exactly one and is true for one key of a pair
only. Forms are an aggregate over pairs; roots are found by joins that double the distance covered.

Bounds: a key is shared by at most (its length + 1) * 62 + 1 words, one for each letter at each place, and a word of L
code points emits at most L + 1 rows of a few bytes: the words themselves are fetched for candidate pairs alone. A form
occurs several times as often as its word, so chains of forms have no loops and grow with the logarithm of the count.

Defined cases: a null or empty text has no words; a row without doc_id counts with an empty id; rows that share a
doc_id all count; an empty table gives an empty result; ties of n go to the smallest word in code-point order; texts
of any length and runs of any length count whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import bounded_batches, columns_of, documents, id_and_text, mixed, sent_if_few, signed, written

#: Letters of a run, the edit rule's divisor, least code points and occurrences of a word, and how much more frequent a form is.
LETTERS = r"A-Za-zÀ-ÿ"
EDIT, LEAST_CHARS, LEAST_N, TIMES = 199, 6, 5, 5
#: Distinct words that a task counts before it hands them on.
HELD = 100_000
RUN = re.compile(f"[{LETTERS}]{{{LEAST_CHARS},}}")
R = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(R, -1, 1 << 64))


def lowered(text: str) -> str:
    """The text with A-Z in lower case, and nothing else changed."""
    return text.encode().lower().decode()


def edited(doc: str, run: str) -> str:
    """The run without one of its code points, where the edit rule asks for it."""
    h = crc32(f"{doc}:{run}".encode())
    if h % EDIT:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])
        count.clear()
        return b

    for ids, texts in columns_of(batches, "doc_id", "text"):
        for i, text in zip(ids, texts, strict=True):
            doc = "" if i is None else str(i)
            for run, n in Counter(RUN.findall(lowered(text))).items():
                word = edited(doc, run)
                if len(word) >= LEAST_CHARS:
                    count[word] += n
            if len(count) >= HELD:
                yield out()
    if count:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(id, word, n): every word that occurs often enough, with a number of its own; a written table."""
    bounded_batches(docs.sparkSession)
    counts = id_and_text(docs).mapInArrow(_counted, "word string, n long")
    often = counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_N)
    return written(often.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


def deletions(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last): the word's own hash with a run of -1, then a hash for each distinct single deletion and the run it touches."""
    c = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(c)
    up = np.full(n, R, np.uint64)
    up[:1] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(c + np.uint64(1)) * np.multiply.accumulate(up), dtype=np.uint64)])
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if n else np.empty(0, np.int64)
    last = np.concatenate([first[1:] - 1, [n - 1]]) if n else first
    without = sums[first] + (sums[n] - sums[first + 1]) * _BACK
    keys = mixed(np.concatenate([[sums[n]], without]) + np.concatenate([[n], np.full(len(first), n - 1)]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return keys, np.concatenate([[-1], first]), np.concatenate([[-1], last])


KEYS = "key long, id long, chars int, first int, last int"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in KEYS.split(", ")]
    for ids, words in columns_of(batches, "id", "word"):
        parts = [deletions(w) for w in words]
        of = [len(k) for k, _, _ in parts]
        if not parts:
            continue
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        of_word = [np.repeat(np.array(ids, np.int64), of), np.repeat(np.array([len(w) for w in words], np.int32), of)]
        yield pa.RecordBatch.from_arrays([pa.array(signed(cols[0])), *map(pa.array, of_word), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32))], names=names)


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): the numbers of words at a distance of exactly one, each pair once. words: (id, word, n), a written table."""
    bounded_batches(words.sparkSession)
    keys = written(words.select("id", "word").mapInArrow(_keys, KEYS), "deletions")
    x, y = keys.alias("x"), keys.alias("y")
    replaced = (F.col("x.chars") == F.col("y.chars")) & (F.col("x.id") < F.col("y.id")) & (F.greatest("x.first", "y.first") <= F.least("x.last", "y.last"))
    inserted = (F.col("x.chars") == F.col("y.chars") + 1) & (F.col("y.first") < 0)
    pairs = x.filter("first >= 0").join(y, (F.col("x.key") == F.col("y.key")) & (replaced | inserted))
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.greatest("x.first", "y.first").alias("at"), (F.col("y.first") < 0).alias("shorter"))
    texts = words.select("id", "word")
    pairs = pairs.join(texts.select(F.col("id").alias("a"), F.col("word").alias("aw")), "a").join(texts.select(F.col("id").alias("b"), F.col("word").alias("bw")), "b")
    without = lambda w: F.concat(F.expr(f"substring({w}, 1, at)"), F.expr(f"substring({w}, at + 2)"))
    return pairs.filter(without("aw") == F.when(F.col("shorter"), F.col("bw")).otherwise(without("bw"))).filter("aw <> bw").select("a", "b")


def forms(words: DataFrame) -> DataFrame:
    """words with n_near, and the id and n of the form of each that has one."""
    pairs = written(near_words(words), "near")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("id").alias("b"), F.col("word").alias("w"), F.col("n").alias("m"))
    best = ends.join(other, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "w", "b")).alias("best"))
    with_best = words.join(best.withColumnRenamed("a", "id"), "id", "left")
    has = -F.col("best.less") >= TIMES * F.col("n")
    return with_best.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best.b")).alias("form_id"), F.when(has, F.col("best.w")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"),
    )


def roots(steps: DataFrame) -> DataFrame:
    """(id, root_id): the last word reached from each word that has a form. steps: (id, form_id); each round doubles the distance."""
    reach = written(steps.select("id", F.col("form_id").alias("root_id")), "reach")
    while True:
        further = reach.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        reach = written(reach.join(sent_if_few(further), "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")), "reach")
        moved = not reach.filter("moved").isEmpty()
        reach = reach.drop("moved")
        if not moved:
            return reach


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word."""
    words = vocabulary(docs)
    table = written(forms(words), "forms")
    last = roots(table.filter("form_id is not null")).join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id")
    rows = table.join(last.select("id", "root"), "id", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


ORACLE_OP11 = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
        FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT doc, run, n, hex(encode(doc || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(1, length(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::UBIGINT)),
    lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1]::UBIGINT[], lambda v, k: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))), 4294967295::UBIGINT) AS h
  FROM bytes),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.k = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.k = b.word),
ranked AS (
  SELECT x, y, w.n AS m, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY w.n DESC, y) AS r
  FROM pairs JOIN words w ON w.word = y),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * w.n THEN y END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN ranked r ON r.x = w.word AND r.r = 1),
walk AS (
  SELECT word, word AS reached, 0 AS d FROM formed
  UNION ALL SELECT walk.word, f.form, d + 1 FROM walk JOIN formed f ON f.word = walk.reached WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(reached, d) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""
