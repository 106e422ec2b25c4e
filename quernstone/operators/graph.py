"""Graphs as edge and triple tables: closure, depth, bounded search, difference, merge and patterns of triples.

Loops run on the driver over whole-table joins; each round's result is a table in the shared folder, and the loop ends by
a count. No node or triple is gathered.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.shared import kept
from quernstone.sources.tables import table

TRIPLE = "s string, p string, o string"


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) over (child, parent), the least depth for each pair, however deep; safe on cycles."""
    step = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).filter("node <> ancestor").distinct()
    found, before = kept(step.withColumn("depth", F.lit(1)), "closure"), 0
    # paths of two known pieces: what is known doubles its reach each round, and a round without a new pair is the last
    while (n := found.count()) > before:
        before = n
        above = found.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"), F.col("depth").alias("more"))
        longer = found.join(above, "ancestor").filter("node <> above").select("node", F.col("above").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        found = kept(found.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "closure")
    return found


def hops(start: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(node, hop) of nodes within `limit` hops (or any number) of start (node) along (src, dst); each node at its first discovery."""
    seen = front = kept(start.select("node").distinct().withColumn("hop", F.lit(0)), "hops")
    for hop in itertools.count(1) if limit is None else range(1, limit + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = kept(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)), "hops")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, s, p, o): triples added and removed, those with blank nodes left out."""
    old, new = (t.select("s", "p", "o").filter("NOT startswith(s, '_:') AND NOT startswith(o, '_:')") for t in (old, new))
    return new.subtract(old).withColumn("change", F.lit("added")).unionByName(old.subtract(new).withColumn("change", F.lit("removed")))


def blank_closure(triples: DataFrame, roots: DataFrame) -> DataFrame:
    """The triples reachable from roots (s) through blank objects."""
    blank = triples.filter("startswith(o, '_:')").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    reach = hops(roots.select(F.col("s").alias("node")), blank).filter("startswith(node, '_:')").select(F.col("node").alias("s"))
    return triples.join(reach, "s", "left_semi")


def merged(base: DataFrame, managed: DataFrame, owned: list[str]) -> DataFrame:
    """base without the owned predicates of managed subjects and the blank subgraphs that hung on them, plus managed."""
    subjects = managed.select("s").distinct()
    gone = base.filter(F.col("p").isin(owned)).join(subjects, "s", "left_semi")
    below = blank_closure(base, gone.filter("startswith(o, '_:')").select(F.col("o").alias("s")))
    stay = base.join(gone, ["s", "p", "o"], "left_anti").join(below, ["s", "p", "o"], "left_anti")
    return stay.unionByName(managed).distinct()


def matched(triples: DataFrame, patterns: list[tuple[str, str, str]], select: list[str]) -> DataFrame:
    """A basic graph pattern: terms that start with `?` are variables; patterns join on the variables they share."""
    parts = []
    for terms in patterns:
        t = triples
        for c, x in zip("spo", terms, strict=True):
            if not x.startswith("?"):
                t = t.filter(F.col(c) == x)
        first = {}
        for c, x in zip("spo", terms, strict=True):
            if x.startswith("?"):
                if x in first:
                    t = t.filter(F.col(c) == F.col(first[x]))
                first.setdefault(x, c)
        parts.append(t.select(*[F.col(c).alias(x[1:]) for x, c in first.items()]))

    found = parts.pop(0)
    while parts:  # whichever pattern comes next that shares a variable with what is joined already
        at = next((i for i, t in enumerate(parts) if set(t.columns) & set(found.columns)), None)
        if at is None:
            raise ValueError("patterns that share no variable, by whatever way, make a cross product")
        t = parts.pop(at)
        found = found.join(t, [c for c in found.columns if c in t.columns])
    return found.select(*[F.col(v[1:]).alias(f"col_{i}") for i, v in enumerate(select)])


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers below nations, nations below regions, regions below the world."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    return reduce(DataFrame.unionByName, (r, n, c, s))


O_PLACES = """e AS (SELECT concat('n', n_nationkey) AS child, concat('r', n_regionkey) AS parent FROM nation UNION SELECT concat('r', r_regionkey), 'world' FROM region
  UNION SELECT concat('c', c_custkey), concat('n', c_nationkey) FROM customer UNION SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier),
a AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION SELECT a.node, e.parent, a.depth + 1 FROM a JOIN e ON a.ancestor = e.child)"""


def class_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes lie below each, in all and directly."""
    a = ancestors(place_edges(spark, sf_dir))
    return a.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n_below"), F.count_if(F.col("depth") == 1).alias("n_direct"))


O_CLOSURE = f"WITH RECURSIVE {O_PLACES} SELECT ancestor, count(*) AS n_below, count(*) FILTER (WHERE depth = 1) AS n_direct FROM a GROUP BY ancestor"


def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's ancestors from near to far; the chain is as short as the tree is high."""
    a = ancestors(place_edges(spark, sf_dir))
    return a.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list(F.struct("depth", "ancestor")))["ancestor"], ">").alias("chain"))


O_CHAIN = f"WITH RECURSIVE {O_PLACES} SELECT node, string_agg(ancestor, '>' ORDER BY depth) AS chain FROM a GROUP BY node"


def hierarchy_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ancestors(place_edges(spark, sf_dir))
    return a.groupBy("node").agg(F.max("depth").alias("depth")).groupBy(F.substring("node", 1, 1).alias("kind"), "depth").agg(F.count(F.lit(1)).alias("n"))


O_DEPTH = f"WITH RECURSIVE {O_PLACES} SELECT substr(node, 1, 1) AS kind, depth, count(*) AS n FROM (SELECT node, max(depth) AS depth FROM a GROUP BY node) GROUP BY 1, 2"


def relation_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one customer along orders, parts and suppliers: who is how many hops away."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    line = table(spark, sf_dir, "lineitem")
    p = line.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    s = line.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    edges = o.unionByName(p).unionByName(s)  # fronts are small: each hop is a scan of two columns and a broadcast join
    return hops(spark.createDataFrame([("c7",)], "node string"), edges, 4)


O_BFS = """
WITH h1 AS (SELECT DISTINCT concat('o', o_orderkey) AS node, o_orderkey FROM orders WHERE o_custkey = 7),
h2 AS (SELECT DISTINCT concat('p', l_partkey) AS node, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM h1)),
h3 AS (SELECT DISTINCT concat('s', l_suppkey) AS node FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM h2))
SELECT 'c7' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3
"""


def place_triples(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Nations and suppliers as triples; version 2 renames some nations, moves some suppliers and adds blank notes."""
    n = table(spark, sf_dir, "nation")
    name = F.when((F.col("n_nationkey") % 5 == 0) & (F.lit(version) == 2), F.concat("n_name", F.lit(" II"))).otherwise(F.col("n_name"))
    iri = F.concat(F.lit("n:"), "n_nationkey")
    s = table(spark, sf_dir, "supplier")
    to = F.when((F.col("s_suppkey") % 7 == 0) & (F.lit(version) == 2), (F.col("s_nationkey") + 1) % 25).otherwise(F.col("s_nationkey"))
    note = F.concat(F.lit("_:b"), "n_nationkey")
    return reduce(
        DataFrame.unionByName,
        (
            n.select(iri.alias("s"), F.lit("label").alias("p"), name.alias("o")),
            n.select(iri.alias("s"), F.lit("in").alias("p"), F.concat(F.lit("r:"), "n_regionkey").alias("o")),
            n.select(iri.alias("s"), F.lit("note").alias("p"), note.alias("o")),
            n.select(note.alias("s"), F.lit("text").alias("p"), F.concat(F.lit("v"), F.lit(version)).alias("o")),
            s.select(F.concat(F.lit("s:"), "s_suppkey").alias("s"), F.lit("at").alias("p"), F.concat(F.lit("n:"), to).alias("o")),
        ),
    )


def _o_triples(v: int) -> str:
    name = "CASE WHEN n_nationkey % 5 = 0 THEN concat(n_name, ' II') ELSE n_name END" if v == 2 else "n_name"
    to = "CASE WHEN s_suppkey % 7 = 0 THEN (s_nationkey + 1) % 25 ELSE s_nationkey END" if v == 2 else "s_nationkey"
    return f"""t{v} AS (SELECT concat('n:', n_nationkey) AS s, 'label' AS p, {name} AS o FROM nation UNION SELECT concat('n:', n_nationkey), 'in', concat('r:', n_regionkey) FROM nation
  UNION SELECT concat('n:', n_nationkey), 'note', concat('_:b', n_nationkey) FROM nation UNION SELECT concat('_:b', n_nationkey), 'text', 'v{v}' FROM nation
  UNION SELECT concat('s:', s_suppkey), 'at', concat('n:', {to}) FROM supplier)"""


def triple_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difference(place_triples(spark, sf_dir, 1), place_triples(spark, sf_dir, 2))


_PLAIN = "NOT starts_with(s, '_:') AND NOT starts_with(o, '_:')"
O_DIFF = f"""WITH {_o_triples(1)}, {_o_triples(2)}
SELECT s, p, o, 'added' AS change FROM (SELECT * FROM t2 EXCEPT SELECT * FROM t1) WHERE {_PLAIN} UNION ALL SELECT s, p, o, 'removed' FROM (SELECT * FROM t1 EXCEPT SELECT * FROM t2) WHERE {_PLAIN}"""


def triple_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    managed = place_triples(spark, sf_dir, 2).filter("p = 'label' AND s < 'n:2'")
    return merged(place_triples(spark, sf_dir, 1), managed, ["label", "note"])


O_MERGE = f"""WITH {_o_triples(1)}, {_o_triples(2)}, m AS (SELECT * FROM t2 WHERE p = 'label' AND s < 'n:2'),
g AS (SELECT * FROM t1 WHERE p IN ('label', 'note') AND s IN (SELECT s FROM m)), b AS (SELECT * FROM t1 WHERE s IN (SELECT o FROM g WHERE starts_with(o, '_:')))
SELECT s, p, o FROM (SELECT * FROM t1 EXCEPT SELECT * FROM g EXCEPT SELECT * FROM b) UNION SELECT * FROM m"""


def bgp_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = place_triples(spark, sf_dir, 1)
    return matched(t, [("?s", "at", "?n"), ("?n", "in", "r:1"), ("?n", "label", "?l")], ["?s", "?l"])


O_BGP = f"WITH {_o_triples(1)} SELECT a.s AS col_0, c.o AS col_1 FROM t1 a JOIN t1 b ON a.o = b.s AND b.p = 'in' AND b.o = 'r:1' JOIN t1 c ON c.s = a.o AND c.p = 'label' WHERE a.p = 'at'"

_ALL = ((class_closure, O_CLOSURE), (ancestor_chain, O_CHAIN), (hierarchy_depth, O_DEPTH), (relation_bfs, O_BFS), (triple_diff, O_DIFF), (triple_merge, O_MERGE), (bgp_select, O_BGP))
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: o for f, o in _ALL}
