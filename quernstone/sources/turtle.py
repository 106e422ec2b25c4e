"""Turtle files as triples, and triples as Turtle files.

Files are read whole by Spark's own reader, so they may lie in any store that Spark knows; a task parses the files it is
given one after the other and holds one of them. A file that is no Turtle gives no triples but one row that names the
line and what was wrong there; the others are read all the same. A folder that isn't there has no triples.

Names of blank nodes hold within their file, so they get a mark of it. Writers deal a graph to many files; blank nodes
leave as IRIs below SKOLEM, which readers turn back into blank nodes of the same name.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.graph import place_triples
from quernstone.sources.shared import folder, kept
from quernstone.sources.tables import table

#: The vocabulary that the syntax stands for, escapes of strings, and the tokens.
RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^\x00-\x20<>"{}|^`]*>)|(?P<text>\"{3}(?:\"{0,2}(?:[^"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3}|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')"""
    r"""|(?P<blank>_:\w(?:[\w.-]*[\w-])?)|(?P<number>[+-]?(?:\d+\.\d*|\.?\d+)[eE][+-]?\d+|[+-]?\d*\.\d+|[+-]?\d+)"""
    r"""|(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:%-]|\\[\W_])(?:(?:[\w:%.-]|\\[\W_])*(?:[\w:%-]|\\[\W_]))?)?)"""
    r"""|(?P<tag>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<word>[A-Za-z]+)|(?P<mark>\^\^|[.;,\[\]()])""",
    re.DOTALL,
)
#: Blank nodes in files that a writer made.
SKOLEM = "urn:blank:"
ROW = "file string, s string, p string, o string, o_kind string, o_datatype string, o_lang string, fault string"
_NAMES = [x.split()[0] for x in ROW.split(", ")]


class TurtleError(ValueError):
    """What is wrong, and in which line."""


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "uU":
            return chr(int(x[1:], 16))
        if x not in ESCAPES:
            raise TurtleError(f"no escape: \\{x}")
        return ESCAPES[x]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.DOTALL) if "\\" in text else text


class _File:
    """The statements of one file: triples (s, p, o) whose o is (text, kind, datatype, language)."""

    def __init__(self, text: str, scope: str, base: str = ""):
        self.text, self.scope, self.base, self.prefixes, self.made, self.out = text, scope, base, {}, 0, []
        self.tokens = self._tokens()
        self.kind, self.now = next(self.tokens)

    def _tokens(self) -> Iterator[tuple[str, str]]:
        self.at = 0
        while self.at < len(self.text):
            m = TOKEN.match(self.text, self.at)
            if not m:
                raise TurtleError(f"{self.text[self.at : self.at + 12]!r} is no token")
            self.at = m.end()
            if m.lastgroup != "space":
                yield m.lastgroup, m[0]
        while True:
            yield "end", ""

    def line(self) -> int:
        return self.text.count("\n", 0, self.at) + 1

    def step(self) -> str:
        was, (self.kind, self.now) = self.now, next(self.tokens)
        return was

    def need(self, mark: str) -> None:
        if self.now != mark or self.kind == "text":
            raise TurtleError(f"{mark!r} expected, found {self.now or 'the end'!r}")
        self.step()

    def parse(self) -> list[tuple]:
        while self.kind != "end":
            word = self.now.lower()
            if self.kind in ("tag", "word") and word in ("@prefix", "@base", "prefix", "base"):
                self.directive(word)
                continue
            if self.now == "[" and self.kind == "mark":
                s, bare = self.blank_list(), True
            else:
                s, bare = self.subject(), False
            if not (bare and self.now == "."):
                self.predicates(s)
            self.need(".")
        return self.out

    def directive(self, word: str) -> None:
        self.step()
        if word.endswith("prefix"):
            if self.kind != "name" or not self.now.endswith(":") or self.now.count(":") > 1:
                raise TurtleError(f"a prefix expected, found {self.now!r}")
            name = self.step()[:-1]
            self.prefixes[name] = self.iri()
        else:
            self.base = self.iri()
        if word.startswith("@"):
            self.need(".")

    def iri(self) -> str:
        if self.kind == "iri":
            x = _unescaped(self.step()[1:-1])
            return urljoin(self.base, x) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", x) else x
        if self.kind == "name":
            prefix, _, local = self.now.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"no prefix {prefix!r}")
            self.step()
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise TurtleError(f"an IRI expected, found {self.now or 'the end'!r}")

    def resource(self) -> str:
        x = self.iri()
        return "_:" + x[len(SKOLEM) :] if x.startswith(SKOLEM) else x

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.scope}.{self.made}"

    def subject(self) -> str:
        if self.kind == "blank":
            return f"_:{self.scope}_{self.step()[2:]}"
        if self.now == "(" and self.kind == "mark":
            return self.collection()
        return self.resource()

    def blank_list(self) -> str:
        self.need("[")
        s = self.fresh()
        if self.now != "]":
            self.predicates(s)
        self.need("]")
        return s

    def collection(self) -> str:
        self.need("(")
        items = []
        while not (self.now == ")" and self.kind == "mark"):
            items.append(self.object())
        self.need(")")
        nodes = [self.fresh() for _ in items] + [RDF + "nil"]
        for here, after, item in zip(nodes, nodes[1:], items, strict=False):
            self.out.append((here, RDF + "first", item))
            self.out.append((here, RDF + "rest", _node(after)))
        return nodes[0]

    def predicates(self, s: str) -> None:
        while True:
            p = RDF + "type" if self.kind == "word" and self.now == "a" and self.step() else self.iri()
            self.out.append((s, p, self.object()))
            while self.now == "," and self.kind == "mark":
                self.step()
                self.out.append((s, p, self.object()))
            while self.now == ";" and self.kind == "mark":
                self.step()
                more = self.now not in (";", ".", "]") or self.kind == "text"
                if more:
                    break
            else:
                return

    def object(self) -> tuple:
        if self.kind == "mark" and self.now == "[":
            return _node(self.blank_list())
        if self.kind in ("iri", "name", "blank") or self.now == "(" and self.kind == "mark":
            return _node(self.subject())
        if self.kind == "number":
            x = self.step()
            return x, "literal", XSD + ("double" if "e" in x.lower() else "decimal" if "." in x else "integer"), None
        if self.kind == "word" and self.now in ("true", "false"):
            return self.step(), "literal", XSD + "boolean", None
        if self.kind != "text":
            raise TurtleError(f"an object expected, found {self.now or 'the end'!r}")
        x = self.step()
        x = _unescaped(x[3:-3] if len(x) >= 6 and x[:3] in ('"""', "'''") else x[1:-1])
        if self.kind == "tag":
            return x, "literal", None, self.step()[1:]
        if self.now == "^^" and self.kind == "mark":
            self.step()
            return x, "literal", self.iri(), None
        return x, "literal", None, None


def _node(x: str) -> tuple:
    return x, "bnode" if x.startswith("_:") else "iri", None, None


def parsed(text: str, file: str, base: str = "") -> list[tuple]:
    """Rows of ROW of one file: its triples, or a single row with what is wrong."""
    f = None
    try:
        f = _File(text.removeprefix("﻿"), hashlib.md5(file.encode()).hexdigest()[:8], base)
        return [(file, s, p, *o, None) for s, p, o in f.parse()]
    except (TurtleError, RecursionError) as e:
        what = str(e) if isinstance(e, TurtleError) else "nested too deep"
        return [(file, None, None, None, None, None, None, f"line {f.line() if f else 1}: {what}")]


#: Rows of one Arrow batch, and the names of files that write_turtle makes.
ROWS, WRITTEN = 10_000, "part-*"


def turtle(spark: SparkSession, path: str, base: str = "", files: str = "*.ttl") -> tuple[DataFrame, DataFrame]:
    """The triples (s, p, o, o_kind, o_datatype, o_lang), each once, of all files of this name below a path; and (file, fault) of files passed over."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, text in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True):
                out = parsed(text, file, base)
                for i in range(0, len(out), ROWS):
                    cols = zip(*out[i : i + ROWS], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=_NAMES)

    try:
        files = spark.read.option("pathGlobFilter", files).option("recursiveFileLookup", True).text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], ROW)
    else:
        found = kept(files.select(F.col("_metadata.file_path").alias("file"), "value").mapInArrow(rows, ROW), "turtle")
    triples = found.filter("fault IS NULL").select("s", "p", "o", "o_kind", "o_datatype", "o_lang").distinct()
    return triples, found.filter("fault IS NOT NULL").select("file", "fault")


def _term(x: str, prefixes: list[tuple[str, str]]) -> str:
    if x.startswith("_:"):
        x = SKOLEM + x[2:]
    for name, iri in prefixes:
        if x.startswith(iri) and re.fullmatch(r"\w*", x[len(iri) :], re.ASCII):
            return f"{name}:{x[len(iri) :]}"
    return "<" + re.sub(r'[\x00-\x20<>"{}|^`\\]', lambda m: f"\\u{ord(m[0]):04X}", x) + ">"


def _object(o: str, kind: str, datatype: str | None, lang: str | None, prefixes: list[tuple[str, str]]) -> str:
    if kind != "literal":
        return _term(o, prefixes)
    text = o.translate({34: '\\"', 92: "\\\\", 10: "\\n", 13: "\\r", 9: "\\t"})
    return f'"{text}"' + (f"^^{_term(datatype, prefixes)}" if datatype else f"@{lang}" if lang else "")


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """Triples (s, p, o, o_kind[, o_datatype, o_lang]) as files below a path; a subject's triples stand together, prefixes (name to IRI) before them."""
    named = sorted((prefixes or {}).items(), key=lambda x: -len(x[1]))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last = [f"@prefix {n}: <{i}> ." for n, i in named], None
        for b in batches:
            for s, p, *o in zip(*[b.column(n).to_pylist() for n in ("s", "p", "o", "o_kind", "o_datatype", "o_lang")], strict=True):
                tail = f"{_term(p, named)} {_object(*o, named)}"
                if s == last:
                    out[-1] += " ;"
                    out.append(f"  {tail}")
                else:
                    if last is not None:
                        out[-1] += " ."
                    out.append(f"{_term(s, named)} {tail}")
                last = s
            if len(out) > 1:  # the last line may go on
                yield pa.RecordBatch.from_arrays([pa.array(out[:-1], pa.string())], names=["value"])
                out = out[-1:]
        if last is not None:
            out[-1] += " ."
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    more = [F.lit(None).cast("string").alias(c) for c in ("o_datatype", "o_lang") if c not in triples.columns]
    dealt = triples.select("*", *more).repartition("s").sortWithinPartitions("s", "p", "o")
    dealt.mapInArrow(lines, "value string").write.text(path)


# queries


def turtle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, suppliers and blank notes written to Turtle files and read again, beside customers as typed literals."""
    t = place_triples(spark, sf_dir, 2)
    kind = F.when(F.startswith("o", F.lit("_:")), "bnode").when(F.col("p").isin("label", "text"), "literal").otherwise("iri")
    none = F.lit(None).cast("string")
    t = t.select("s", "p", "o", kind.alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang"))
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("http://x/customer/"), "c_custkey").alias("s"), F.lit("http://x/note").alias("p"), F.concat(F.lit('"'), "c_name", F.lit('"\\ and\n'), "c_mktsegment").alias("o"), F.lit("literal").alias("o_kind"),
        F.when(F.col("c_acctbal") > 0, XSD + "string").alias("o_datatype"), F.when(~(F.col("c_acctbal") > 0), "en").alias("o_lang"),
    )
    path = f"{folder(spark)}/turtle-{uuid.uuid4().hex}"
    write_turtle(t.unionByName(c), path, {"c": "http://x/customer/", "xsd": XSD})
    triples, _ = turtle(spark, path, files=WRITTEN)
    return triples


O_ROUND_TRIP = """
SELECT concat('n:', n_nationkey) AS s, 'label' AS p, CASE WHEN n_nationkey % 5 = 0 THEN concat(n_name, ' II') ELSE n_name END AS o, 'literal' AS o_kind, NULL AS o_datatype, NULL AS o_lang FROM nation
UNION ALL SELECT concat('n:', n_nationkey), 'in', concat('r:', n_regionkey), 'iri', NULL, NULL FROM nation UNION ALL SELECT concat('n:', n_nationkey), 'note', concat('_:b', n_nationkey), 'bnode', NULL, NULL FROM nation
UNION ALL SELECT concat('_:b', n_nationkey), 'text', 'v2', 'literal', NULL, NULL FROM nation
UNION ALL SELECT concat('s:', s_suppkey), 'at', concat('n:', CASE WHEN s_suppkey % 7 = 0 THEN (s_nationkey + 1) % 25 ELSE s_nationkey END), 'iri', NULL, NULL FROM supplier
UNION ALL SELECT concat('http://x/customer/', c_custkey), 'http://x/note', concat('"', c_name, '"', chr(92), ' and', chr(10), c_mktsegment), 'literal', CASE WHEN c_acctbal > 0 THEN 'http://www.w3.org/2001/XMLSchema#string' END, CASE WHEN NOT c_acctbal > 0 THEN 'en' END FROM customer
"""

QUERIES = {"turtle_round_trip": turtle_round_trip}
ORACLES = {"turtle_round_trip": O_ROUND_TRIP}
