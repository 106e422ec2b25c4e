"""Spans of text, half-open by characters, as arrays within the row: selection, rows of cells, inline boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.tables import dealt, table

SPAN = "struct<start:int,end:int,label:string,score:double>"


def greedy(spans: Column) -> Column:
    """Of spans (start, end, label, score) the best that don't overlap: by score, then start, then end; in order of start.

    Spans compete only within a run of spans that hang together by overlaps, so a long line's work is not the square of its spans.
    """
    by = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (-s["score"]).alias("o"), s["label"].alias("label"), s["score"].alias("score"))))
    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    start = F.from_json(F.lit('{"run": [], "done": []}'), f"struct<reach:int,run:array<{SPAN}>,done:array<{SPAN}>>")

    def plain(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label"), x["score"].alias("score"))

    def take(a: Column, x: Column) -> Column:
        hit = F.exists(a, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        return F.when(hit, a).otherwise(F.array_append(a, plain(x)))

    def best(run: Column) -> Column:
        ordered = F.array_sort(F.transform(run, lambda s: F.struct((-s["score"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["score"].alias("score"))))
        return F.when(F.size(run) < 2, run).otherwise(F.aggregate(ordered, none, take))

    def add(a: Column, x: Column) -> Column:
        apart = F.struct(x["end"].alias("reach"), F.array(plain(x)).alias("run"), F.concat(a["done"], best(a["run"])).alias("done"))
        more = F.struct(F.greatest(a["reach"], x["end"]).alias("reach"), F.array_append(a["run"], plain(x)).alias("run"), a["done"].alias("done"))
        return F.when(x["start"] < a["reach"], more).otherwise(apart)

    return F.array_sort(F.aggregate(by, start, add, lambda a: F.concat(a["done"], best(a["run"]))))


def row_segment(headers: list[str], cells: list[Column]) -> tuple[Column, Column]:
    """A row as text `header：cell | …`, and the (start, end) of each cell in it; empty cells are left out."""
    start = F.struct(F.lit("").alias("text"), F.from_json(F.lit("[]"), "array<struct<col:int,start:int,end:int>>").alias("cells"))
    pairs = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(h).alias("h"), F.coalesce(c.cast("string"), F.lit("")).alias("c")) for i, (h, c) in enumerate(zip(headers, cells, strict=True))])

    def add(a: Column, x: Column) -> Column:
        lead = F.concat(a["text"], F.when(a["text"] == "", "").otherwise(" | "), x["h"], F.lit("："))
        at = F.char_length(lead)
        cell = F.struct(x["col"].alias("col"), at.alias("start"), (at + F.char_length(x["c"])).alias("end"))
        return F.struct(F.concat(lead, x["c"]).alias("text"), F.array_append(a["cells"], cell).alias("cells"))

    out = F.aggregate(F.filter(pairs, lambda x: x["c"] != ""), start, add)
    return out["text"], out["cells"]


def cell_of(span_start: Column, span_end: Column, cells: Column) -> Column:
    """The first cell that holds a span whole."""
    return F.get(F.filter(cells, lambda c: (c["start"] <= span_start) & (span_end <= c["end"])), F.lit(0))["col"]


def elementary(runs: Column, spans: Column) -> Column:
    """The text between all neighbouring ends of runs and spans (start, end), with the first run and span that covers each."""
    return F.get(F.transform(F.array(F.struct(runs.alias("runs"), spans.alias("spans"))), lambda x: _elementary(x["runs"], x["spans"])), F.lit(0))  # both are made once


def _elementary(runs: Column, spans: Column) -> Column:
    ends = F.array_sort(F.array_distinct(F.flatten(F.array(runs["start"], runs["end"], spans["start"], spans["end"]))))
    pairs = F.zip_with(F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0))), F.slice(ends, F.lit(2), F.greatest(F.size(ends) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("start"), b.alias("end")))

    def covering(of: Column, p: Column) -> Column:
        return F.array_position(F.transform(of, lambda x: (x["start"] <= p["start"]) & (p["end"] <= x["end"])), F.lit(True))

    marked = F.transform(pairs, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), covering(runs, p).alias("run"), covering(spans, p).alias("span")))
    return F.filter(marked, lambda m: m["run"] > 0)


def matches(text: Column, pattern: str, label: str, score: Column | float) -> Column:
    """Spans of a pattern's matches: pieces between them and their lengths, summed up along the text in one pass."""
    pieces = F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, x: F.struct(F.char_length(p).alias("gap"), F.char_length(x).alias("n")))
    start = F.from_json(F.lit('{"at": 0, "done": []}'), f"struct<at:int,done:array<{SPAN}>>")

    def add(a: Column, p: Column) -> Column:
        begin, end = a["at"] + p["gap"], a["at"] + p["gap"] + p["n"]
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(label).alias("label"), (F.lit(score) if isinstance(score, float) else score).cast("double").alias("score"))
        return F.when(p["n"].isNull(), a).otherwise(F.struct(end.alias("at"), F.array_append(a["done"], span).alias("done")))

    return F.aggregate(pieces, start, add, lambda a: a["done"])


def span_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over each line of the documents: capitalised words, words with their neighbours, and numbers compete."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "t"))
    spans = F.concat(matches(F.col("t"), r"[A-Z][a-z]+", "name", 0.6), matches(F.col("t"), r"[a-z]+ [A-Z][a-z]+", "pair", 0.8), matches(F.col("t"), r"[0-9]+", "number", 0.9))
    kept = lines.select("doc_id", "line", greedy(spans).alias("s"))
    return kept.select("doc_id", "line", F.size("s").alias("n"), F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["label"], x["start"], x["end"])), ",").alias("spans"))


def row_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as row segments, and the cell that holds the first run of digits."""
    c = table(spark, sf_dir, "customer")
    text, cells = row_segment(["name", "segment", "balance"], [F.col("c_name"), F.col("c_mktsegment"), F.col("c_acctbal").cast("decimal(12,2)")])
    rows = c.select("c_custkey", text.alias("text"), cells.alias("cells")).withColumn("at", F.regexp_instr("text", F.lit("[0-9]+")) - 1)
    return rows.select("c_custkey", "text", F.col("cells")[0]["start"].alias("first_start"), F.element_at("cells", -1)["end"].alias("last_end"), cell_of(F.col("at"), F.col("at") + 1, F.col("cells")).alias("cell"))


O_SEGMENTS = """
SELECT c_custkey, concat('name：', c_name, ' | segment：', c_mktsegment, ' | balance：', c_acctbal::DECIMAL(12,2)) AS text, 5 AS first_start,
  CAST(length(concat('name：', c_name, ' | segment：', c_mktsegment, ' | balance：', c_acctbal::DECIMAL(12,2))) AS INTEGER) AS last_end,
  CASE WHEN regexp_matches(c_name, '[0-9]') THEN 0 WHEN regexp_matches(c_mktsegment, '[0-9]') THEN 1 ELSE 2 END AS cell FROM customer
"""

def inline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names and segments as two runs of a text, split where spans of words and digits begin and end."""
    c = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select("c_custkey", F.concat("c_name", "c_mktsegment").alias("t"), F.char_length("c_name").alias("n"))
    runs = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end")), F.struct(F.col("n").alias("start"), F.char_length("t").alias("end")))
    parts = c.select("c_custkey", elementary(runs, matches(F.col("t"), "[0-9]+", "number", 1.0)).alias("p"))
    return parts.select("c_custkey", F.size("p").alias("n_parts"), F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["start"], x["end"], x["run"], x["span"])), ",").alias("parts"))


O_INLINE = """
SELECT c_custkey, CAST(3 AS INTEGER) AS n_parts, concat('0:', b, ':1:0,', b, ':', n, ':1:1,', n, ':', n + length(c_mktsegment), ':2:0') AS parts
FROM (SELECT *, length(c_name) AS n, length(regexp_extract(c_name, '^[^0-9]*')) AS b FROM customer)
"""

QUERIES = {"span_greedy": span_greedy, "row_segments": row_segments, "inline_split": inline_split}
ORACLES = {"row_segments": O_SEGMENTS, "inline_split": O_INLINE}
