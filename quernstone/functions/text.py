"""Text scalar functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Sentence ends of both scripts, obligation words, and the longest key of a key-value line.
ENDS = "。！？；.!?;"
OBLIGATIONS = "shall|must|should|is required to|应|必须|须"
KEY_LENGTH = 40


def sentences(text: Column) -> Column:
    """Pieces of a text, each up to and with a sentence end or line break; trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, f"([{ENDS}])", "$1\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def coalesced(pieces: Column, least: int = 8) -> Column:
    """Pieces joined until each has `least` characters; a short tail goes to the piece before it. A fold within the row."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def take(a: Column, x: Column) -> Column:
        now = F.concat(a["open"], x)
        full = F.char_length(now) >= least
        return F.struct(F.when(full, F.array_append(a["done"], now)).otherwise(a["done"]).alias("done"), F.when(full, "").otherwise(now).alias("open"))

    def finish(a: Column) -> Column:
        n = F.size(a["done"])
        last = F.concat(F.element_at(a["done"], -1), a["open"])
        return F.when(a["open"] == "", a["done"]).when(n == 0, F.array(a["open"])).otherwise(F.array_append(F.slice(a["done"], F.lit(1), n - 1), last))

    return F.aggregate(pieces, start, take, finish)


def is_narrative(text: Column) -> Column:
    """At least 120 characters and four sentences, fewer than half of the lines key-value, and few enumerations."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n = F.greatest(F.size(lines), F.lit(1))
    pairs = F.size(F.filter(lines, lambda x: x.rlike(rf"^[^:：]{{1,{KEY_LENGTH}}}[:：]\s*\S")))
    listed = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(?:[-*•]|[0-9]+[.)、])")))
    return (F.char_length(text) >= 120) & (F.size(sentences(text)) >= 4) & (pairs * 2 < n) & (listed * 5 < n * 4)


def key_value(line: Column) -> tuple[Column, Column]:
    """Key and value of a line `key: value`, with a colon of either width; NULLs if it is none."""
    pattern = rf"^\s*([^:：]{{1,{KEY_LENGTH}}}?)\s*[:：]\s*(.+?)\s*$"
    hit = line.rlike(pattern)
    return F.when(hit, F.regexp_extract(line, pattern, 1)), F.when(hit, F.regexp_extract(line, pattern, 2))


def unit_stripped(label: Column) -> Column:
    """A label without a trailing unit in parentheses."""
    return F.trim(F.regexp_replace(label, r"\s*[(（][^()（）]*[)）]\s*$", ""))


def first_percentage(text: Column) -> Column:
    return F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*[%％]", 1).try_cast("double")


def normalised(text: Column, vocabulary: list[str]) -> Column:
    """The first term of a vocabulary that the text, in upper case and without spaces, contains; NULL for none."""
    flat = F.upper(F.regexp_replace(F.trim(text), r"\s+", ""))
    return F.coalesce(*[F.when(F.contains(flat, F.lit(t.upper().replace(" ", ""))), F.lit(t)) for t in vocabulary])


def conditional_action(text: Column) -> Column:
    """(condition, action, obligation) of `if|when … , (then) … shall …`; NULL if there is none."""
    pattern = rf"(?i)\b(?:if|when)\s+([^,.\n]+),\s*(?:then\s+)?([^.\n]*?\b({OBLIGATIONS})\b[^.\n]*)"
    part = lambda i: F.trim(F.regexp_extract(text, pattern, i))
    return F.when(text.rlike(pattern), F.struct(part(1).alias("condition"), part(2).alias("action"), F.lower(part(3)).alias("obligation")))


def label_tokens(label: Column) -> Column:
    """ASCII words and runs of CJK characters, of two or more, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(label), F.lit(r"[a-z0-9]{2,}|[一-鿿]{2,}"), F.lit(0)))


def keyword_score(text: Column, curated: list[str], tokens: list[str]) -> Column:
    """Two for each curated keyword and one for each further token that a text contains."""
    low = F.lower(text)
    two = [F.when(F.contains(low, F.lit(k)), 2).otherwise(0) for k in curated]
    one = [F.when(F.contains(low, F.lit(k)), 1).otherwise(0) for k in tokens if k not in curated]
    return reduce(Column.__add__, two + one, F.lit(0))


def local_name(iri: Column) -> Column:
    """What stands after the last `#`, or else after the last `/`."""
    return F.when(F.contains(iri, F.lit("#")), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))


def context(text: Column, start: Column, end: Column, around: int) -> Column:
    """A half-open span of characters with so many on either side, as far as there are any."""
    first = F.greatest(start - around, F.lit(0))
    return F.substring(text, first + 1, F.least(end + around, F.char_length(text)) - first)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys, no spaces, non-ASCII as it is; a key of a NULL value is left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


#: Drug codes, impurity names, what is no entity (measures, numbers, spans of time, comparisons, ranges), and
#: the tokens of a text: each CJK character, ASCII runs with their connectors, any other character but white space.
DRUG_CODE = r"[A-Z]{2,4}-[0-9]{3,5}"
IMPURITY = (r"(?i)(Imp[-‐]?\w+)", r"杂质[为:：]?\s*([^\s，。;；]+)")
NO_ENTITY = r"^[0-9]+(\.[0-9]+)?\s*[a-zA-Zμ°℃%‰]+$|^[0-9]+(\.[0-9]+)?$|^[0-9]+\s*(分钟|小时|天)$|^[±<>≤≥]\s*[0-9]|^[0-9]+(\.[0-9]+)?\s*[-–~]\s*[0-9]"
TOKEN = r"[一-鿿㐀-䶿]|[A-Za-z0-9]+(?:[._\-/%][A-Za-z0-9]+)*|[^\s]"
#: A span of so many CJK characters, or characters if it has none, is short.
SHORT_CJK, SHORT = 3, 4
#: Characters of a document that a prompt holds, and paragraphs that a haystack holds.
PROMPT, HAYSTACK = 12_000, 12


def matched(text: Column, pattern: str, group: int = 0) -> Column:
    """What a pattern finds first; NULL, not an empty string, if nothing."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def drug_code(title: Column, paragraphs: Column, pattern: str = DRUG_CODE) -> Column:
    """The first code of the title, else of the first paragraphs, else the title itself."""
    found = F.filter(F.transform(F.slice(paragraphs, 1, HAYSTACK), lambda p: matched(p, pattern)), lambda x: x.isNotNull())
    return F.coalesce(matched(title, pattern), F.get(found, F.lit(0)), title)


def impurity(text: Column) -> Column:
    return F.coalesce(*[matched(text, p, 1) for p in IMPURITY])


def subclass_of(text: Column, table: list[tuple[str, str]]) -> Column:
    """The class of the first keyword of a list that a text contains."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(c)) for k, c in table])


def first_alternative(text: Column) -> Column:
    return F.trim(F.substring_index(text, "/", 1))


def no_entity(span: Column) -> Column:
    """One character or less, or a pattern of NO_ENTITY."""
    t = F.trim(span)
    return (F.char_length(t) <= 1) | t.rlike(NO_ENTITY)


def short_span(span: Column) -> Column:
    cjk = F.char_length(span) - F.char_length(F.regexp_replace(span, "[一-鿿]", ""))
    return F.when(cjk > 0, cjk <= SHORT_CJK).otherwise(F.char_length(span) <= SHORT)


_TOKEN = re.compile(TOKEN)


#: Code points of texts whose tokens are Python objects at once.
AT_ONCE = 1 << 20
TOKENS = "array<struct<token: string, start: int, end: int>>"


def _offsets(texts: pa.Array) -> pa.Array:
    """A list of (token, start, end) for each text; what lies between tokens is white space, so each begins where it is found next.

    Tokens become Arrow columns after every AT_ONCE code points, so that a batch of many texts holds few of them as objects.
    """
    parts, tokens, starts, ends, at_text, null, size = [], [], [], [], [0], [], 0

    def arrow() -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["token", "start", "end"])

    for text in texts:
        text = text.as_py()
        found, at = _TOKEN.findall(text) if text else [], 0
        for token in found:
            at = text.index(token, at)
            starts.append(at)
            at += len(token)
            ends.append(at)
        tokens += found
        at_text.append(at_text[-1] + len(found))
        null.append(text is None)
        size += len(text or "")
        if size >= AT_ONCE:
            parts.append(arrow())
            tokens, starts, ends, size = [], [], [], 0
    rows = pa.concat_arrays([*parts, arrow()])
    return pa.ListArray.from_arrays(pa.array(at_text, pa.int32()), rows, mask=pa.array(null, pa.bool_()))


def tokens_with_offsets(text: Column) -> Column:
    """Tokens with their half-open places; offsets need a running sum over all that lies between, so Arrow batches do it."""
    return F.arrow_udf(_offsets, TOKENS)(text)


def _cut(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts have AT_ONCE code points together, or are one text."""
    start, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()):
        if i > start and size + n > AT_ONCE:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def tokenised(docs: DataFrame, text: str) -> DataFrame:
    """docs with `tokens`: tokens_with_offsets of a column, in batches of few code points, so that what worker and JVM hold at once doesn't grow with the rows of a batch."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _cut(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, _offsets(part.column(text))], names=[*part.schema.names, "tokens"])

    return docs.mapInArrow(told, StructType([*docs.schema.fields, *StructType.fromDDL(f"tokens {TOKENS}").fields]))


def heading_level(style: Column, points: Column | None = None) -> Column:
    """1 to 6 by a paragraph's style name, in English or Chinese, else by its font size; 0 for none."""
    s = F.trim(style)
    low, number = F.lower(s), F.regexp_extract(s, "([0-9]+)", 1).try_cast("int")
    named = F.when((low == "title") | (s == "标题"), 1).when((low == "subtitle") | (s == "副标题"), 2)
    named = named.when((F.contains(low, F.lit("heading")) | F.startswith(s, F.lit("标题"))) & number.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(6), number)))
    by_size = F.lit(None).cast("int") if points is None else F.when(points >= 20, 1).when(points >= 16, 2).when(points >= 14, 3)
    return F.coalesce(named, by_size, F.lit(0))


def next_version(version: Column) -> Column:
    """v2 after v1; any other form gets `.1`."""
    n = matched(version, "^v([0-9]+)$", 1).try_cast("bigint")
    return F.when(n.isNotNull(), F.concat(F.lit("v"), n + 1)).otherwise(F.concat(version, F.lit(".1")))


def column_like(mapping: dict[str, str], latin: str, other: str) -> str | None:
    """The first property of a column mapping whose column or property name holds a Latin word, whatever its case, or whose column holds another."""
    return next((p for c, p in mapping.items() if latin in c.lower() or latin in p.lower() or other in c), None)


def haystack(title: Column, headings: Column, paragraphs: Column) -> Column:
    """Title, headings and the first paragraphs: what a document is classified by."""
    return F.concat_ws("\n", title, headings, F.slice(paragraphs, 1, HAYSTACK))


def prompt_text(headings: Column, paragraphs: Column, rows: Column) -> Column:
    """Headings, paragraphs and the first ten rows of tables, cut at PROMPT characters with a mark."""
    whole = F.concat_ws("\n", headings, paragraphs, F.slice(rows, 1, 10))
    return F.when(F.char_length(whole) > PROMPT, F.concat(F.substring(whole, 1, PROMPT), F.lit("\n[…]"))).otherwise(whole)


def cell_like(row: dict[str, Column], needles: list[str]) -> Column:
    """The first filled column whose name holds one of some words; empty for none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for k, c in row.items() if any(n in k for n in needles)], F.lit(""))


def table_found(headers: Column, needles: list[str]) -> Column:
    """Whether all needles stand in a table's joined headers."""
    joined = F.array_join(headers, "|")
    return reduce(Column.__and__, [F.contains(joined, F.lit(n)) for n in needles])


def anchor(evidence: Column, blocks: Column) -> Column:
    """Where evidence stands among blocks (text, heading): the first that contains it, else the first of six characters or more that it contains.

    `§ ` and the heading, or the block's own text if it has none; NULL if nothing fits.
    """
    span = F.trim(evidence)
    fore = F.filter(blocks, lambda b: F.contains(b["text"], span))
    back = F.filter(blocks, lambda b: (F.char_length(b["text"]) >= 6) & F.contains(span, b["text"]))
    b = F.coalesce(F.get(fore, F.lit(0)), F.get(back, F.lit(0)))
    return F.when(span != "", F.when(b["heading"].isNotNull(), F.concat(F.lit("§ "), b["heading"])).otherwise(b["text"]))
