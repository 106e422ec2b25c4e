"""Language ID (operator 7): a byte convolutional network, trained and applied with numpy.

Bytes (A-Z in lower case) are embedded; filters of several widths run over a window of fixed length; the greatest answer
of each filter goes to a softmax over languages. A text is cut into windows from its first byte to its last, the last
one padded; its languages' probabilities are the means over its windows, weighted by how many bytes of each are text.

The network is trained on the driver with one window from each of at most SAMPLE labelled documents, as many of each
language as there are, up to an equal share, chosen by the hash of their ids; every language that has a label is
learned, and of more than SAMPLE languages one window each. Predictions take nothing but the text. For speed the embedding and each pair of a filter's columns are
multiplied out once into tables by byte and by pair of bytes; the sums are those of the convolution.

Defined cases: a null text, or one without a letter, is `und` with a score of 0; every other text gets a learned
language, however short; if there is no labelled document at all, everything is `und`; a null doc_id counts as held out
in no fold; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import bounded_batches, columns_of, documents

#: Documents to learn from at most: a bound of what the driver reads (one window of each).
SAMPLE = 6_000
#: Bytes of a window, size of a byte's embedding, filters of each width.
WINDOW, EMBEDDING, FILTERS, WIDTHS = 128, 8, 8, (2, 3, 4)
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.01, 7
#: Windows whose features are computed together.
TOGETHER = 512

_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Net:
    """languages, and the parameters: embedding, filters and biases by width, dense layer."""

    languages: list[str]
    params: dict[str, np.ndarray]

    def __getstate__(self):
        return self.languages, self.params

    def __setstate__(self, state):
        self.languages, self.params = state

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, what each pair of bytes (or single byte) adds at each place."""
        if not hasattr(self, "_tables"):
            e = self.params["e"]
            out = []
            for w in WIDTHS:
                f = self.params[f"f{w}"].reshape(w, EMBEDDING, FILTERS)
                single = [e @ f[i] for i in range(w)]
                out.append([(single[i][:, None] + single[i + 1][None]).reshape(65536, FILTERS).astype(np.float32) if i + 1 < w else single[i].astype(np.float32) for i in range(0, w, 2)])
            self._tables = out
        return self._tables

    def features(self, x: np.ndarray) -> np.ndarray:
        pair = x[:, :-1].astype(np.intp) * 256 + x[:, 1:]
        parts = []
        for w, tables in zip(WIDTHS, self.tables(), strict=True):
            n = WINDOW - w + 1
            at = [(pair if t.shape[0] == 65536 else x)[:, 2 * i : 2 * i + n] for i, t in enumerate(tables)]
            total = np.take(tables[0], at[0], axis=0)
            for t, i in zip(tables[1:], at[1:], strict=True):
                total += np.take(t, i, axis=0)
            parts.append(np.maximum(total.max(axis=1) + self.params[f"b{w}"], 0))
        return np.concatenate(parts, axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.features(x) @ self.params["w"] + self.params["c"])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def windows(data: bytes) -> np.ndarray:
    """The bytes of a text in rows of WINDOW, the last one padded with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


def start(n_languages: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"e": rng.normal(0, 0.5, (256, EMBEDDING))}
    for w in WIDTHS:
        p[f"f{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    return p | {"w": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), n_languages)), "c": np.zeros(n_languages)}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the cross entropy of one batch; only the winning place of each filter passes any on."""
    n, pooled, kept = len(x), [], []
    embedded = p["e"][x]
    for w in WIDTHS:
        columns = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, w * EMBEDDING)
        answer = columns @ p[f"f{w}"] + p[f"b{w}"]
        at = answer.argmax(axis=1)
        top = np.take_along_axis(answer, at[:, None], axis=1)[:, 0]
        pooled.append(np.maximum(top, 0))
        kept.append((columns, at, top > 0))
    h = np.concatenate(pooled, axis=1)
    d = softmax(h @ p["w"] + p["c"])
    d[np.arange(n), y] -= 1
    d /= n
    g = {"w": h.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(p["e"])}
    back = d @ p["w"].T
    for k, (w, (columns, at, on)) in enumerate(zip(WIDTHS, kept, strict=True)):
        b = back[:, k * FILTERS : (k + 1) * FILTERS] * on
        won = columns[np.arange(n)[:, None], at]
        g[f"f{w}"] = np.einsum("nf,nfc->cf", b, won)
        g[f"b{w}"] = b.sum(axis=0)
        to = np.einsum("nf,cf->nfc", b, p[f"f{w}"]).reshape(n, FILTERS, w, EMBEDDING)
        byte = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]
        np.add.at(g["e"], byte, to)
    return g


def train(texts: list[str], labels: list[str]) -> Net:
    """A network from one window of each text, by Adam."""
    rng = np.random.default_rng(SEED)
    languages = sorted(set(labels))
    if not languages:
        return Net([], {})
    x = np.concatenate([windows(t.encode("utf-8", "surrogatepass").lower()[:WINDOW]) for t in texts])
    y = np.array([languages.index(v) for v in labels])
    p = start(len(languages), rng)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(max(EPOCHS, -(-EPOCHS * 500 // len(x)))):
        by = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            g, step = gradients(p, x[by[i : i + BATCH]], y[by[i : i + BATCH]]), step + 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Net(languages, {k: a.astype(np.float32) for k, a in p.items()})


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame) -> Net:
    """A network from a bounded sample of the labelled documents outside the held-out fold."""
    h = F.xxhash64(F.col("doc_id"))
    rows = docs.select("doc_id", "lang", F.col("text").alias("text")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    start_at = F.lit(1) + F.pmod(h, F.greatest(F.char_length("text") - WINDOW, F.lit(1))).cast("int")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = max(1, SAMPLE // max(1, len(counts)))
    # about twice each language's share passes this filter, whatever the corpus; the window makes the bound exact
    least = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int((1 << 30) * min(1.0, 2 * share / n)))]) if counts else F.lit(None).cast("map<string,int>")
    rows = rows.filter(F.pmod(h, F.lit(1 << 30)) < F.element_at(least, F.col("lang")))
    some = rows.select(h.alias("by"), "lang", F.substring(F.col("text"), start_at, F.lit(WINDOW)).alias("text"))
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("by", "text"))).filter(F.col("at") <= share).orderBy("by", "text").toArrow()
    return train(some["text"].to_pylist(), some["lang"].to_pylist())


def predicted(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(net)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for ids, held, texts in columns_of(batches, "doc_id", "held_out", "text"):
            answers = [predict(net, t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array([a[0] for a in answers], pa.string()), pa.array([a[1] for a in answers], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return plain.mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double")


def predict(net: Net, text: str | None) -> tuple[str, float]:
    if not text or not net.languages or not _LETTER.search(text):
        return "und", 0.0
    x = windows(text.encode("utf-8", "surrogatepass").lower())
    total, weight = np.zeros(len(net.languages)), 0
    for i in range(0, len(x), TOGETHER):
        part = x[i : i + TOGETHER]
        n = ((part >= 97) & (part <= 122) | (part > 127)).sum(axis=1)
        total += n @ net.probabilities(part)
        weight += int(n.sum())
    mean = total / max(weight, 1)
    k = int(mean.argmax())
    return net.languages[k], float(min(1.0, max(0.0, mean[k])))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predicted(docs, learned(docs))
