"""Structure of tables found in their data: keys, and the columns of other tables that refer to them.

Files declare no keys, so candidates are proposed for review: a pass over each table gives counts, sketches of distinct
values and ranges; they rule out nearly all columns, and exact plans confirm the rest: a key has no group of two rows, a
reference no value that an anti join leaves. What comes to the driver is a row for each column.

A key is a column, or a pair where no single column is one, without NULLs, of whole numbers, dates or strings of at most
LONGEST code points. A reference is a column of the same type whose values all are in the key of another table, and whose
name is the key's but for what stands before the first underscore: inclusion alone says little of small numbers.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.sources.tables import table

#: Code points of the longest value of a key; the share of rows that a sketch must count to be asked again exactly, three standard errors below.
LONGEST, SKETCHED, ERROR = 128, 0.94, 0.02
KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass
class Profile:
    """What one pass says of a column; values are the sketch's count of distinct ones, least and most as Spark orders them."""

    table: str
    name: str
    type: str
    rows: int
    filled: int
    values: int
    least: object
    most: object
    longest: int

    @property
    def stem(self) -> str:
        return self.name.partition("_")[2] if "_" in self.name and len(self.name.partition("_")[0]) <= 2 else self.name


def profile(name: str, rows: DataFrame) -> list[Profile]:
    """Every column of a table that may be part of a key or a reference, by one aggregate."""
    cols = [f for f in rows.schema.fields if isinstance(f.dataType, KEY_TYPES)]
    if not cols:
        return []
    c = lambda f: F.col(f"`{f.name}`")
    of = lambda f: F.struct(F.count(c(f)).alias("filled"), F.approx_count_distinct(c(f), ERROR).alias("values"), F.min(c(f)).alias("least"), F.max(c(f)).alias("most"), (F.max(F.char_length(c(f))) if isinstance(f.dataType, T.StringType) else F.lit(0)).alias("longest"))
    r = rows.agg(F.count(F.lit(1)).alias("rows"), *[of(f).alias(f"c{i}") for i, f in enumerate(cols)]).first()
    return [Profile(name, f.name, f.dataType.simpleString(), r["rows"], r[f"c{i}"]["filled"], r[f"c{i}"]["values"], r[f"c{i}"]["least"], r[f"c{i}"]["most"], r[f"c{i}"]["longest"] or 0) for i, f in enumerate(cols)]


def _unique(rows: DataFrame, names: tuple[str, ...]) -> bool:
    return rows.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()


def keys(rows: DataFrame, columns: list[Profile]) -> list[tuple[str, ...]]:
    """The keys of a table: single columns, else pairs."""
    able = [c for c in columns if c.rows and c.filled == c.rows and c.longest <= LONGEST]
    single = [(c.name,) for c in able if c.values >= SKETCHED * c.rows and _unique(rows, (c.name,))]
    if single:
        return single
    return [(a.name, b.name) for a, b in itertools.combinations(able, 2) if a.values * b.values >= SKETCHED**2 * a.rows and _unique(rows, (a.name, b.name))]


def references(tables: dict[str, DataFrame], columns: dict[str, list[Profile]], found: dict[str, list[tuple[str, ...]]]) -> list[tuple[str, str, str, str]]:
    """(table, column, other, key): columns whose values all are in a single-column key of another table, by name and by data."""
    targets = [next(c for c in columns[t] if c.name == k[0]) for t, ks in found.items() for k in ks if len(k) == 1]
    out = []
    for c in itertools.chain.from_iterable(columns.values()):
        for k in targets:
            if c.table == k.table or c.type != k.type or c.stem != k.stem or not c.filled:
                continue
            if c.least < k.least or c.most > k.most or c.values * (1 - 3 * ERROR) > k.values * (1 + 3 * ERROR):
                continue
            mine = tables[c.table].select(F.col(f"`{c.name}`").alias("v")).filter("v IS NOT NULL").distinct()
            # sorted, as files say little of a key's size: millions of numbers in a row take next to none, but not in a broadcast
            if mine.join(tables[k.table].select(F.col(f"`{k.name}`").alias("v")).hint("merge"), "v", "left_anti").isEmpty():
                out.append((c.table, c.name, k.table, k.name))
    return out


CANDIDATE = "candidate_kind string, name string, properties string"


def reflect(spark: SparkSession, tables: dict[str, DataFrame], include: list[str] | None = None) -> DataFrame:
    """Candidates for review: a `class` for each table (columns with type and whether NULLs were seen, keys) and a `link` for each reference, properties as JSON."""
    chosen = {n: d for n, d in tables.items() if include is None or n in include}
    columns = {n: profile(n, d) for n, d in chosen.items()}
    found = {n: keys(d, columns[n]) for n, d in chosen.items()}
    rows = []
    for n, d in chosen.items():
        seen = {c.name: c.filled < c.rows for c in columns[n]}
        cols = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": seen.get(f.name, True)} for f in d.schema.fields]
        rows.append(("class", n, json.dumps({"table": n, "columns": cols, "primary_key": list(found[n][0]) if found[n] else [], "keys": [list(k) for k in found[n]]})))
    for a, x, b, y in references(chosen, columns, found):
        rows.append(("link", f"{a}_{b}", json.dumps({"from_table": a, "to_table": b, "constrained_columns": [x], "referred_columns": [y]})))
    return spark.createDataFrame(rows, CANDIDATE)


# queries

#: Tables of the driver, and their columns that may be part of a key, strings that are never long among them.
SHAPES = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_mktsegment", "supplier": "s_suppkey s_name s_nationkey",
    "part": "p_partkey p_name p_brand p_type p_size", "orders": "o_orderkey o_custkey o_orderstatus o_orderdate o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type props", "documents": "doc_id lang source n_chars", "pages": "page_id url", "labels": "doc_id quality toxic", "conversations": "conv_id turn role",
}


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t).select(*cols.split()) for t, cols in SHAPES.items()}


def schema_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of every table."""
    found = reflect(spark, _tables(spark, sf_dir)).filter("candidate_kind = 'class'")
    each = F.explode(F.from_json(F.get_json_object("properties", "$.keys"), "array<array<string>>"))
    return found.select(F.col("name").alias("in_table"), each.alias("k")).select("in_table", F.array_join("k", ",").alias("key"))


def schema_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references among all tables, and how many of the key's values each uses."""
    tables = _tables(spark, sf_dir)
    found = reflect(spark, tables).filter("candidate_kind = 'link'")
    rows = found.select(*[F.get_json_object("properties", f"$.{p}").alias(c) for c, p in (("from_table", "from_table"), ("from_column", "constrained_columns[0]"), ("to_table", "to_table"), ("to_column", "referred_columns[0]"))])
    linked = sorted({(r["from_table"], r["from_column"]) for r in rows.collect()})  # a row for each reference
    if not linked:
        return rows.withColumn("n_values", F.lit(0).cast("long"))
    parts = [tables[t].select(F.lit(t).alias("from_table"), F.lit(c).alias("from_column"), F.col(c).cast("string").alias("v")) for t, c in linked]
    n = reduce(DataFrame.unionByName, parts).groupBy("from_table", "from_column", "v").agg(F.lit(1)).groupBy("from_table", "from_column").agg(F.count("v").alias("n_values"))
    return rows.join(n, ["from_table", "from_column"])


def _o_keys() -> str:
    one = {t: [(c,) for c in cols.split()] for t, cols in SHAPES.items()}
    two = {t: list(itertools.combinations(cols.split(), 2)) for t, cols in SHAPES.items()}
    test = lambda t, k: f"SELECT '{t}' AS in_table, '{','.join(k)}' AS key, {len(k)} AS width FROM (SELECT count(*) AS n, count(DISTINCT ({', '.join(k)})) AS d, {' + '.join(f'count({c})' for c in k)} AS f FROM {t}) WHERE n = d AND f = {len(k)} * n AND n > 0"
    rows = " UNION ALL ".join(test(t, k) for t in SHAPES for k in one[t] + two[t])
    return f"WITH k AS ({rows}) SELECT in_table, key FROM k WHERE width = (SELECT min(width) FROM k b WHERE b.in_table = k.in_table)"


def _o_links() -> str:
    stem = lambda c: c.partition("_")[2] if len(c.partition("_")[0]) <= 2 and "_" in c else c
    keyed = {("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("events", "event_id"), ("documents", "doc_id"), ("labels", "doc_id"), ("pages", "page_id"), ("pages", "url"), ("region", "r_name"), ("nation", "n_name"), ("customer", "c_name"), ("supplier", "s_name")}
    pairs = [(t, c, u, k) for t, cols in SHAPES.items() for c in cols.split() for u, k in sorted(keyed) if t != u and stem(c) == stem(k)]
    return " UNION ALL ".join(f"SELECT '{t}' AS from_table, '{c}' AS from_column, '{u}' AS to_table, '{k}' AS to_column, (SELECT count(DISTINCT {c}) FROM {t}) AS n_values WHERE NOT EXISTS (SELECT 1 FROM {t} x WHERE x.{c} IS NOT NULL AND x.{c} NOT IN (SELECT {k} FROM {u})) AND (SELECT count(*) = count(DISTINCT {k}) FROM {u})" for t, c, u, k in pairs)


QUERIES = {"schema_keys": schema_keys, "schema_links": schema_links}
ORACLES = {"schema_keys": _o_keys(), "schema_links": _o_links()}
