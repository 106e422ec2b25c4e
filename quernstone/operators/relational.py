"""Reads over entity tables: search, filters, latest rows, set-overlap joins, reference checks, grouping and canonical rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.sources.tables import table


def matching(df: DataFrame, equal: dict[str, object], text: str | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the given values (None asks for nothing) that hold a text in one of some columns, whatever the case; % and _ are wild."""
    for k, v in equal.items():
        if v is not None:
            df = df.filter(F.col(k) == F.lit(v))
    return df.filter(reduce(Column.__or__, [F.col(c).ilike(f"%{text}%") for c in within])) if text else df


def page(df: DataFrame, by: str, offset: int, size: int) -> DataFrame:
    return df.orderBy(by).offset(offset).limit(size)


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The greatest row of each key by the given columns: partial maxima before the shuffle, no sort."""
    rest = [c for c in df.columns if c not in (key, *order)]
    return df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("x")).select(key, "x.*")


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The least row of each key by the given columns."""
    rest = [c for c in df.columns if c not in (*key, *order)]
    return df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("x")).select(*key, "x.*")


def affected(conclusions: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """Conclusions (key, dimension, id) that share an id of some dimension with the targets (dimension, id)."""
    return conclusions.join(targets.distinct(), ["dimension", "id"], "left_semi").select(key).distinct()


def contained_first(values: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """Each row with the pattern (pattern, target, priority) of the highest priority that its text contains, or none.

    patterns is a configuration table of some dozens of rows: it becomes an array literal of the plan, not a join.
    """
    rows = [tuple(r) for r in patterns.select("priority", "pattern", "target").orderBy(F.desc("priority"), "pattern").collect()]
    hits = [F.when(F.contains(F.col(text), F.lit(p)), F.lit(t)) for _, p, t in rows]
    return values.withColumn("target", F.coalesce(*hits) if hits else F.lit(None).cast("string"))


def shadow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in all, by type and by user, in one pass."""
    table(spark, sf_dir, "events").select("event_type", "user_id").createOrReplaceTempView("_shadow")
    return spark.sql("SELECT event_type, user_id, count(*) AS n FROM _shadow GROUP BY GROUPING SETS ((), (event_type), (user_id))")


O_STATS = "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((), (event_type), (user_id))"


def entity_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching(table(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": None}, "1", ("c_name", "c_mktsegment"))
    return page(found.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", 10, 25)


O_SEARCH = "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_name ILIKE '%1%' OR c_mktsegment ILIKE '%1%') ORDER BY c_custkey LIMIT 25 OFFSET 10"


def json_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "props", "value").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.filter((F.col("k") % 3 == 0) & F.startswith("event_type", F.lit("c"))).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("most"))


O_JSON = "SELECT event_type, k, count(*) AS n, round(max(value), 6) AS most FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE k % 3 = 0 AND starts_with(event_type, 'c') GROUP BY 1, 2"


def latest_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    last = latest(o, "o_custkey", ["o_orderdate", "o_orderkey"])
    c = table(spark, sf_dir, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", "o_orderkey", "o_orderstatus")


O_LATEST = """
SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN
  (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey
"""


def subgraph_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    sides = e.select("event_id", F.inline(F.array(F.struct(F.lit("user").alias("dimension"), F.col("user_id").cast("string").alias("id")), F.struct(F.lit("k").alias("dimension"), F.col("k").alias("id")))))
    targets = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.lit("user").alias("dimension"), F.col("s_suppkey").cast("string").alias("id"))
    targets = targets.unionByName(spark.createDataFrame([("k", "5")], "dimension string, id string"))
    hit = affected(sides, "event_id", targets)
    return e.join(hit, "event_id", "left_semi").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


O_SEMI = """
SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events
WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) OR json_extract_string(props, '$.k') = '5' GROUP BY event_type
"""


def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live customers and suppliers of nations that are switched off, and nations of such regions: a union of semi joins."""
    off = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("ref"))
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(k).cast("long").alias("id"), F.col(r).cast("int").alias("ref")).join(off, "ref", "left_semi") for t, k, r in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey"))]
    regions = table(spark, sf_dir, "region").filter("r_regionkey = 2").select(F.col("r_regionkey").alias("ref"))
    parts.append(table(spark, sf_dir, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("ref")).join(regions, "ref", "left_semi"))
    return reduce(DataFrame.unionByName, parts)


O_DANGLING = """
SELECT ref, 'customer' AS kind, c_custkey AS id FROM (SELECT *, c_nationkey AS ref FROM customer) WHERE ref IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
UNION ALL SELECT s_nationkey, 'supplier', s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
UNION ALL SELECT n_regionkey, 'nation', n_nationkey::BIGINT FROM nation WHERE n_regionkey = 2
"""


def mapping_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each nation's mappings (its suppliers): none, drifting (a negative balance), orphaned, whole or partial."""
    s = table(spark, sf_dir, "supplier")
    seen = s.groupBy("s_nationkey").agg(F.bool_or(F.col("s_acctbal") < -500).alias("drift"), F.bool_or(F.col("s_name").isNull()).alias("orphan"), F.bool_or(F.col("s_acctbal") > 5000).alias("a"), F.bool_or((F.col("s_acctbal") >= 0) & (F.col("s_acctbal") <= 5000)).alias("b"))
    n = table(spark, sf_dir, "nation").join(seen, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    state = F.when(F.col("s_nationkey").isNull(), "unmapped").when(F.col("drift"), "drift").when(F.col("orphan"), "orphan").when(F.col("a") & F.col("b"), "ok").otherwise("unmapped")
    return n.select("n_nationkey", state.alias("health"))


O_HEALTH = """
SELECT n_nationkey, CASE WHEN count(s_suppkey) = 0 THEN 'unmapped' WHEN bool_or(s_acctbal < -500) THEN 'drift' WHEN bool_or(s_name IS NULL AND s_suppkey IS NOT NULL) THEN 'orphan'
  WHEN bool_or(s_acctbal > 5000) AND bool_or(s_acctbal BETWEEN 0 AND 5000) THEN 'ok' ELSE 'unmapped' END AS health
FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey
"""


def validate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release checks as (check, id) rows: lines without a part of size, orders without lines, parts never ordered."""
    line, part, orders = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    big = part.filter("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"))
    a = line.select("l_partkey").distinct().join(big, "l_partkey", "left_anti").select(F.lit("missing part").alias("check"), F.col("l_partkey").alias("id"))
    b = orders.select(F.col("o_orderkey").alias("l_orderkey")).join(line.select("l_orderkey"), "l_orderkey", "left_anti").select(F.lit("empty order").alias("check"), F.col("l_orderkey").alias("id"))
    c = part.select(F.col("p_partkey").alias("l_partkey")).join(line.select("l_partkey"), "l_partkey", "left_anti").select(F.lit("unused part").alias("check"), F.col("l_partkey").alias("id"))
    return a.unionByName(b).unionByName(c)


O_VALIDATE = """
SELECT 'missing part' AS "check", l_partkey AS id FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)
UNION ALL SELECT 'empty order', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'unused part', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
"""


def template_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame([("/en/", "english", 5), ("example.org", "org", 9), ("blog.", "blog", 7), ("https", "secure", 1)], "pattern string, target string, priority int")
    return contained_first(table(spark, sf_dir, "pages").select("page_id", "url"), "url", patterns).select("page_id", F.coalesce("target", F.lit("default")).alias("template"))


O_TEMPLATE = "SELECT page_id, CASE WHEN contains(url, 'example.org') THEN 'org' WHEN contains(url, 'blog.') THEN 'blog' WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, 'https') THEN 'secure' ELSE 'default' END AS template FROM pages"


def edges_to_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user the types in order of first sight, and the last value of each type: two aggregations, no long lists."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    by = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"), F.max(F.struct("event_id", "value")).alias("last"))
    one = by.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("seen"), F.map_from_entries(F.collect_list(F.struct("event_type", F.col("last.value").alias("v")))).alias("values"))
    return one.select("user_id", F.array_join("seen.event_type", ",").alias("types"), F.round(F.element_at("values", F.lit("click")), 6).alias("last_click"))


O_EDGES = """
SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types, round(max(last) FILTER (WHERE event_type = 'click'), 6) AS last_click
FROM (SELECT user_id, event_type, min(event_id) AS first, arg_max(value, event_id) AS last FROM events GROUP BY 1, 2) GROUP BY 1
"""


def canonical_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical row of each group: the greatest score (null counts 0), the first among equals."""
    line = table(spark, sf_dir, "lineitem").select(F.concat_ws("|", "l_partkey", F.col("l_suppkey") % 10).alias("key"), "l_orderkey", "l_linenumber", F.coalesce("l_extendedprice", F.lit(0.0)).alias("score"))
    return first_of(line.withColumn("down", -F.col("score")), ["key"], ["down", "l_orderkey", "l_linenumber"]).select("key", "l_orderkey", "l_linenumber", F.round("score", 4).alias("score"))


O_CANONICAL = """
SELECT key, l_orderkey, l_linenumber, round(s, 4) AS score FROM (SELECT concat(l_partkey, '|', l_suppkey % 10) AS key, l_orderkey, l_linenumber, coalesce(l_extendedprice, 0) AS s FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC, l_orderkey, l_linenumber) = 1
"""


def equipment_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers numbered within their nation."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name", F.row_number().over(w).alias("seq"))


O_SEQ = "SELECT s_nationkey, s_suppkey, s_name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS seq FROM supplier"


def subject_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct segments of each nation's customers, joined in order of first sight."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("p"))
    return c.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("p", "c_mktsegment")))["c_mktsegment"], "; ").alias("subject"))


O_SUBJECT = "SELECT c_nationkey, string_agg(c_mktsegment, '; ' ORDER BY p) AS subject FROM (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS p FROM customer GROUP BY 1, 2) GROUP BY 1"


def entity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns of one role within a conversation count once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("before").isNull() | (F.col("before") != F.col("role"))).alias("n_runs"))


O_RUNS = "SELECT role, count(*) AS n_turns, count(*) FILTER (WHERE before IS NULL OR before <> role) AS n_runs FROM (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY role"


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compatibility matrix: the first level of each pair of nation and priority class."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").pivot("p", ["1", "2", "3", "4", "5"]).agg(F.min(F.struct("o_orderkey", "o_orderstatus"))["o_orderstatus"])
    return j.select("c_nationkey", *[F.col(p).alias(f"p{p}") for p in "12345"])


O_PIVOT = "SELECT c_nationkey, " + ", ".join(f"arg_min(o_orderstatus, o_orderkey) FILTER (WHERE o_orderpriority LIKE '{p}%') AS p{p}" for p in "12345") + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"

_ALL = (
    (shadow_stats, O_STATS), (entity_search_page, O_SEARCH), (json_path_filter, O_JSON), (latest_signature, O_LATEST), (subgraph_semi, O_SEMI), (dangling_refs, O_DANGLING), (mapping_health, O_HEALTH),
    (validate_union, O_VALIDATE), (template_resolve, O_TEMPLATE), (edges_to_facts, O_EDGES), (canonical_group, O_CANONICAL), (equipment_seq, O_SEQ), (subject_text, O_SUBJECT), (entity_runs, O_RUNS), (status_pivot, O_PIVOT),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: o for f, o in _ALL}
