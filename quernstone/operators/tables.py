"""Maintenance of the small tables that queries read: guarded writes as snapshot rewrites, releases, candidates, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators.relational import first_of
from quernstone.sources.tables import table


def inserted_if_new(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """base with the rows whose key it lacks; of several new rows of a key the least."""
    rest = [c for c in rows.columns if c != key]
    new = first_of(rows.join(base.select(key), key, "left_anti"), [key], rest)
    return base.unionByName(new)


def swapped(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Compare and swap: updates (key, expected, others) take effect where the row's version is the expected one, and raise it.

    A NULL in an update keeps the old value. `swapped` says whether a row was written.
    """
    others = [c for c in updates.columns if c not in (key, "expected")]
    u = updates.select(key, "expected", *[F.col(c).alias(f"_{c}") for c in others])
    j = base.join(u, key, "left").withColumn("swapped", F.coalesce(F.col("expected") == F.col("version"), F.lit(False)))
    new = {c: F.when(F.col("swapped"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in others}
    return j.withColumns({**new, "version": F.col("version") + F.col("swapped").cast("int")}).select(*base.columns, "swapped")


def disabled(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Soft delete: the rows of keys are switched off and drafts again."""
    j = base.join(keys.select(key, F.lit(True).alias("_off")), key, "left")
    return j.withColumns({"enabled": F.col("enabled") & F.col("_off").isNull(), "status": F.when(F.col("_off"), "draft").otherwise(F.col("status"))}).drop("_off")


def release_log(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): create, update or disable of every draft row against the published ones."""
    o = old.select(key, F.struct(*[c for c in old.columns if c != key]).alias("_o"))
    n = new.filter("status = 'draft'").select(key, "enabled", F.struct(*[c for c in old.columns if c != key]).alias("_n"))
    j = n.join(o, key, "left")
    change = F.when(~F.col("enabled"), "disable").when(F.col("_o").isNull(), "create").otherwise("update")
    return j.select(key, change.alias("change"))


def filled_blanks(structured: Column, extracted: Column) -> Column:
    """Map overlay that only fills gaps: a structured value wins unless it is null or white space."""
    solid = F.map_filter(structured, lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    return F.map_concat(F.map_filter(extracted, lambda k, v: ~F.coalesce(F.map_contains_key(solid, k), F.lit(False))), solid)


def group_key(parts: list[Column], id_value: Column, drug_like: Column) -> Column:
    """Non-empty parts joined with `|` for drug-like classes, else the id; NULL if there is nothing."""
    joined = F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), "|")
    return F.nullif(F.when(drug_like, joined).otherwise(id_value), F.lit(""))


def module_of(iris: Column, modules: dict[str, str]) -> Column:
    """The module of the first IRI that contains a module's prefix, IRIs before prefixes; else `integration`."""
    hits = F.transform(iris, lambda i: F.coalesce(*[F.when(F.contains(i, F.lit(p)), F.lit(m)) for p, m in modules.items()]))
    return F.coalesce(F.get(F.array_compact(hits), F.lit(0)), F.lit("integration"))


def seed_if_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_name")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" new")).alias("s_name"))
    return inserted_if_new(base, rows.unionByName(rows), "s_suppkey")


O_SEED = "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name ELSE concat(s_name, ' new') END AS s_name FROM supplier"


def compare_and_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").alias("version"))
    up = base.filter("p_type <> 'PROMO'").select("p_partkey", F.when(F.col("p_brand") < "Brand#3", F.col("version")).otherwise(F.col("version") - 1).alias("expected"), F.lit("B").alias("p_brand"), F.lit(None).cast("string").alias("p_type"))
    return swapped(base, up, "p_partkey")


O_SWAP = "SELECT p_partkey, CASE WHEN hit THEN 'B' ELSE p_brand END AS p_brand, p_type, p_size + hit::INT AS version, hit AS swapped FROM (SELECT *, p_type <> 'PROMO' AND p_brand < 'Brand#3' AS hit FROM part)"


def release_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as classes: rich ones are drafts, the richest are new, furniture is switched off, and one nation's are switched off now."""
    n = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", (F.col("c_mktsegment") != "FURNITURE").alias("enabled"), F.when(F.col("c_acctbal") > 3000, "draft").otherwise("published").alias("status"))
    log = release_log(n.filter("c_acctbal < 8000"), disabled(n, n.filter("c_nationkey = 7"), "c_custkey"), "c_custkey")
    return log.groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


O_RELEASE = """
SELECT CASE WHEN c_mktsegment = 'FURNITURE' OR c_nationkey = 7 THEN 'disable' WHEN c_acctbal >= 8000 THEN 'create' ELSE 'update' END AS change, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys
FROM customer WHERE c_acctbal > 3000 OR c_nationkey = 7 GROUP BY 1
"""


def candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group keys of part candidates, their modules, and how many share each."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", F.concat(F.lit("http://x/"), "p_type", F.lit("#"), "p_brand").alias("iri"))
    key = group_key([F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type"))], F.col("p_partkey").cast("string"), F.col("p_size") % 2 == 0)
    m = module_of(F.array("iri"), {"Brand#1": "one", "Brand#2": "two"})
    c = p.select(key.alias("group_key"), m.alias("module"), T.local_name(F.col("iri")).alias("name"))
    return c.groupBy("group_key", "module", "name").agg(F.count(F.lit(1)).alias("n"))


O_KEYS = """
SELECT CASE WHEN p_size % 2 = 0 THEN concat_ws('|', p_brand, CASE WHEN p_size > 25 THEN p_type END) ELSE p_partkey::VARCHAR END AS group_key,
  CASE WHEN contains(iri, 'Brand#1') THEN 'one' WHEN contains(iri, 'Brand#2') THEN 'two' ELSE 'integration' END AS module, regexp_extract(iri, '([^#]*)$', 1) AS name, count(*) AS n
FROM (SELECT *, concat('http://x/', p_type, '#', p_brand) AS iri FROM part) GROUP BY ALL
"""


def blank_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("status"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(" ")).otherwise(F.col("o_orderstatus")), F.lit("price"), F.lit(None).cast("string")).alias("a"), F.create_map(F.lit("status"), F.lit("text"), F.lit("price"), F.col("o_orderpriority"), F.lit("more"), F.lit("m")).alias("b"))
    m = o.select("o_orderkey", filled_blanks(F.col("a"), F.col("b")).alias("m"))
    return m.select("o_orderkey", F.element_at("m", F.lit("status")).alias("status"), F.element_at("m", F.lit("price")).alias("price"), F.element_at("m", F.lit("more")).alias("more"))


O_BLANKS = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'text' ELSE o_orderstatus END AS status, o_orderpriority AS price, 'm' AS more FROM orders"


def release_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the day's releases: orders of a day in order of their keys."""
    w = Window.partitionBy("day").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return o.select("o_orderkey", F.concat_ws("-", F.date_format("day", "yyyyMMdd"), F.lpad(F.row_number().over(w).cast("string"), 3, "0")).alias("release"))


O_NUMBERS = "SELECT o_orderkey, concat(strftime(o_orderdate, '%Y%m%d'), '-', lpad(CAST(row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderkey) AS VARCHAR), 3, '0')) AS release FROM orders"

_ALL = ((seed_if_new, O_SEED), (compare_and_swap, O_SWAP), (release_changes, O_RELEASE), (candidate_keys, O_KEYS), (blank_filling, O_BLANKS), (release_numbers, O_NUMBERS))
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: o for f, o in _ALL}
