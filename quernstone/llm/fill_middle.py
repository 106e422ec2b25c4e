"""Fill-in-middle transformation (operator 12): texts cut at two places that their id chooses, and put together anew.

The tokenizers library's Split pre-tokenizer isolates the matches of a unit's pattern and gives their offsets in code
points; no tokenizer is trained. The number of offsets is n, and the offsets at two ranks are the ends of prefix and
middle. Where a unit is one code point, the matches are told at two levels: first blocks of BLOCK units, isolated by the
same pre-tokenizer, then the units of the block that holds a rank (and of the last one, for n). That bounds memory, as
offsets of a whole text take a few hundred bytes a unit. Another pattern's units are isolated over the whole text at once.

Defined cases: a null text is an empty one; a text that is empty or holds a mark stays plain; a row without doc_id is
dealt by an empty id; equal ids are dealt alike, so repeated rows give repeated rows; equal ranks give an empty middle;
an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from quernstone.llm.common import bounded_batches, columns_of, documents, id_and_text

#: The marks before prefix, suffix and middle; texts left plain and forms that start with the suffix, in a hundred.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: A unit of one code point, and how many of them a block has.
CODE_POINT, BLOCK = r"[\s\S]", 64
CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@functools.cache
def _isolated(pattern: str) -> Split:
    return Split(Regex(pattern), behavior="isolated")


def offsets(text: str, unit: str) -> list[tuple[int, int]]:
    """The (start, end) of every unit, and of what lies between them, in code points."""
    return [at for _, at in _isolated(unit).pre_tokenize_str(text)]


def places(text: str, unit: str = CODE_POINT) -> tuple[int, Callable[[int], int]]:
    """The number n of units, and the place where the first k units end."""
    if unit != CODE_POINT:
        at = offsets(text, unit)
        return len(at), lambda k: at[k - 1][1] if k else 0
    blocks = offsets(text, f"{CODE_POINT}{{1,{BLOCK}}}")
    if not blocks:
        return 0, lambda k: 0

    def end(k: int) -> int:
        b, i = divmod(k, BLOCK)
        if not i:
            return blocks[b - 1][1] if b else 0
        first, last = blocks[b]
        return first + offsets(text[first:last], CODE_POINT)[i - 1][1]

    first, last = blocks[-1]
    return (len(blocks) - 1) * BLOCK + len(offsets(text[first:last], CODE_POINT)), end


def cut(doc_id: int | None, text: str, unit: str = CODE_POINT) -> tuple:
    """(n, form, code points of the prefix, of the middle, output) of one text."""
    n, end = places(text, unit)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not n or h3 % 100 >= PLAIN_FROM or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = (end(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT) -> DataFrame:
    """A row per document with its output: units, form, sizes of prefix and middle. unit: a pattern as the tokenizers library reads it."""
    bounded_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in CUT.split(", ")])
        for ids, texts in columns_of(batches, "doc_id", "text"):
            out = [(i, *cut(i, t, unit)) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    return id_and_text(docs).mapInArrow(rows, CUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; its parts hold no mark, so the marks tell them apart."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    psm, spm = F.split(body, f"{SUFFIX}|{MIDDLE}"), F.split(body, f"{PREFIX}|{MIDDLE}")
    part = lambda parts, *order: F.concat(*[F.get(parts, F.lit(i)) for i in order])
    return F.when(form == "psm", part(psm, 0, 2, 1)).when(form == "spm", part(spm, 1, 2, 0)).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(documents(spark, sf_dir))
    whole = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


ORACLE_OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, text, length(text)::BIGINT AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
             ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, low) AS prefix, substr(text, low + 1, high - low) AS middle, substr(text, high + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
