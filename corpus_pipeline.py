"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame: the documents with
all their columns, and from the last stage the token digests of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.bpe import encode_kept
from quernstone.llm.common import documents, written
from quernstone.llm.decontaminate import drop_contaminated
from quernstone.llm.jaccard import keep_one_of_each
from quernstone.llm.line_dedup import drop_repeated_lines
from quernstone.llm.quality import keep_good

STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode_kept),
]

#: SQL can't express byte-level BPE; tests/llm holds the pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
