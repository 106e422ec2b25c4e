"""License scans (operator 10), by DataFrame functions alone: ordered signature rules.

A text is folded to its lower-case words, one space between them. A keyword decides which rules of license_rules.py run
on it at all; the regexes of those give intervals. Of detections, one that lies within another goes; of equal intervals
the rule first in order stays. Everything is computed within the row, in time that grows with the text's length: nothing
is shuffled. Regexes are literals, so each is compiled once a task.

The base detections (four plain phrases) stay whatever the rules say.

Defined cases: a null or empty text has no words, no labels and a score of 0; repeated rows give repeated rows; a null
doc_id stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import documents, id_and_text
from quernstone.llm.license_rules import GATES, parsed
from quernstone.llm.line_dedup import LOWER, UPPER

#: The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

def folded(text: Column) -> Column:
    """The words of a text in lower case (A-Z only), each between single spaces; a lone space if there are none."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _places(order: int, sure: float, label: str, regex: str) -> str:
    """SQL for the intervals of a rule, in words: its matches are marked, and the marks are found again among the words, in one scan."""
    marked = f"split(regexp_replace(words, r' ({regex})(?= )', ' \\u0001$1\\u0002'), ' ')"
    at = [f"filter(transform({marked}, (t, i) -> if({test}, i, -1)), i -> i >= 0)" for test in ("startswith(t, '\\u0001')", "endswith(t, '\\u0002')")]
    found = f"named_struct('from', a, 'to', -b, 'o', {order}, 'label', '{label}', 'sure', {sure}D)"
    return f"CASE WHEN words RLIKE r' ({regex})(?= )' THEN zip_with({at[0]}, {at[1]}, (a, b) -> {found}) END"


def _detections() -> Column:
    """Every interval that a rule finds in `words`: an array of (from, -to, order, label, confidence), in that order."""
    groups = [f"CASE WHEN contains(words, '{key}') THEN flatten(array_compact(array({', '.join(_places(*r) for r in rules)}))) END" for key, rules in parsed()]
    return F.expr(f"array_sort(flatten(array_compact(array({', '.join(groups)}))))")


def _outermost(found: Column) -> Column:
    """(labels, score) of the detections that lie in no other. They come by start, the longest first, the strongest rule first."""
    start = F.struct(F.lit(-1).alias("most"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def take(a: Column, x: Column) -> Column:
        within = -x["to"] <= a["most"]
        return F.struct(
            F.greatest(a["most"], -x["to"]).alias("most"),
            F.when(within, a["labels"]).otherwise(F.array_union(a["labels"], F.array(x["label"]))).alias("labels"),
            F.when(within, a["score"]).otherwise(F.greatest(a["score"], x["sure"])).alias("score"),
        )

    return F.aggregate(found, start, take)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    words = F.col("words")
    rows = id_and_text(docs).select("doc_id", folded(F.col("text")).alias("words"))
    rows = rows.withColumn("gate", reduce(Column.__or__, [F.contains(words, F.lit(g)) for g in GATES]))
    counts = [F.regexp_count(words, F.lit(f" {p}(?= )")) for p, _ in PHRASES]
    first = F.least(*[F.when(n > 0, _spaces(F.regexp_extract(words, f"(?s)^(.*?) {p} ", 1))) for n, (p, _) in zip(counts, PHRASES, strict=True)])
    last = F.greatest(*[F.when(n > 0, _spaces(F.regexp_extract(words, f"(?s)^(.*) {p} ", 1))) for n, (p, _) in zip(counts, PHRASES, strict=True)])
    base = F.array_compact(F.array(*[F.when(n > 0, F.lit(b)) for n, (_, b) in zip(counts, PHRASES, strict=True)]))
    none = F.array().cast("array<string>")
    rows = rows.select(
        "doc_id",
        F.when(words == "  ", 0).otherwise(_spaces(words) - 1).cast("long").alias("n_words"),
        F.when(F.col("gate"), sum(counts)).otherwise(0).cast("long").alias("n_base"),
        F.when(F.col("gate"), first).alias("first_word"),
        F.when(F.col("gate"), last).alias("last_word"),
        F.when(F.col("gate"), base).otherwise(none).alias("base"),
        F.when(F.col("gate"), _outermost(_detections())).alias("more"),
    )
    both = F.array_union("base", F.coalesce("more.labels", none))
    score = F.greatest(F.coalesce("more.score", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array("base"), ",").alias("base_labels"), F.array_join(F.sort_array(both), ",").alias("labels"), score.alias("score"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir))
