"""Queries that show the rule algebra and the numeric operators on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import numeric, ternary
from quernstone.plans import rules
from quernstone.plans.rules import compiled, value
from quernstone.sources.tables import table

NO_MAP = "map<string,array<string>>"


def _facts(df: DataFrame, keep: list[str], classes=None, relations=None, data=None, scalars=None) -> DataFrame:
    """A frame of facts from whichever parts are given."""
    lists, values = F.from_json(F.lit("{}"), "map<string,array<string>>"), F.from_json(F.lit("{}"), f"map<string,{rules.VALUE}>")
    return df.select(
        *keep,
        (F.array().cast("array<string>") if classes is None else classes).alias("classes"),
        (lists if relations is None else relations).alias("relations"),
        (values if data is None else data).alias("data_values"),
        lists.alias("alignments"),
        (values if scalars is None else scalars).alias("scalars"),
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")


def rule_kleene_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    d = _labelled(spark, sf_dir).select("source", a.alias("a"), b.alias("b"))
    d = d.select("source", ternary.all_of([F.col("a"), F.col("b")]).alias("x"), ternary.any_of([F.col("a"), F.col("b")]).alias("y"))
    return d.groupBy("source").agg(ternary.agg_all(F.col("x")).alias("all_both"), ternary.agg_any(F.col("y")).alias("any_either"), F.count_if(F.col("x").isNull()).alias("n_unknown"), F.count_if("y").alias("n_either"))


O_KLEENE = """
SELECT source, CASE WHEN coalesce(bool_or(NOT x), false) THEN false WHEN count(x) = count(*) THEN true END AS all_both,
  CASE WHEN coalesce(bool_or(y), false) THEN true WHEN count(y) = count(*) THEN false END AS any_either,
  count(*) FILTER (WHERE x IS NULL) AS n_unknown, count(*) FILTER (WHERE y) AS n_either
FROM (SELECT source, quality = 1 AND toxic = 1 AS x, quality = 1 OR toxic = 1 AS y FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY source
"""


def rule_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.create_map(F.lit("quality"), value(d=F.col("quality")), F.lit("toxic"), value(b=F.col("toxic") == 1))
    facts = _facts(_labelled(spark, sf_dir), ["lang"], data=data, scalars=F.create_map(F.lit("n_chars"), value(d=F.col("n_chars")), F.lit("lang"), value(s=F.col("lang"))))
    patterns = {
        "good": {"op": "datatype_facet", "property": "quality", "cmp": "ge", "value": 1},
        "clean": {"op": "boolean_has_value", "property": "toxic", "value": False},
        "long": {"op": "literal_cmp", "key": "n_chars", "cmp": "gt", "value": 1000},
        "english": {"op": "literal_eq", "key": "lang", "value": "en"},
    }
    for p in patterns.values():
        rules.validate(p)
    both = {"op": "and", "operands": list(patterns.values())[:3]}
    cols = {k: compiled(p) for k, p in (patterns | {"both": both}).items()}
    d = facts.select("lang", *[c.alias(k) for k, c in cols.items()])
    return d.groupBy("lang").agg(*[f for k in cols for f in (F.count_if(k).alias(f"{k}_true"), F.count_if(F.col(k).isNull()).alias(f"{k}_unknown"))])


O_FACET = "SELECT lang, " + ", ".join(f"count(*) FILTER (WHERE {e}) AS {k}_true, count(*) FILTER (WHERE ({e}) IS NULL) AS {k}_unknown" for k, e in {"good": "quality >= 1", "clean": "toxic <> 1", "long": "n_chars > 1000", "english": "lang = 'en'", "both": "quality >= 1 AND toxic <> 1 AND n_chars > 1000"}.items()) + " FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"


def rule_existential(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    held = orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("status"), F.collect_set("o_orderpriority").alias("priority"))
    d = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(held, F.col("c_custkey") == F.col("o_custkey"), "left")
    relations = F.map_filter(F.create_map(F.lit("status"), F.col("status"), F.lit("priority"), F.col("priority")), lambda k, v: v.isNotNull())
    facts = _facts(d, ["c_custkey"], classes=F.array("c_mktsegment"), relations=relations)
    return facts.select(
        "c_custkey",
        compiled({"op": "some_values_from", "property": "status", "filler_class": "P"}).alias("has_p"),
        compiled({"op": "class_membership", "property": "priority", "classes": ["URGENT", "HIGH"]}).alias("is_urgent"),
        compiled({"op": "class_present", "class": "AUTO"}).alias("is_auto"),
        compiled({"op": "external_alignment", "property": "status", "alignment": "P"}).alias("aligned"),
    )


O_EXISTENTIAL = """
SELECT c_custkey, CASE WHEN bool_or(contains(o_orderstatus, 'P')) THEN true END AS has_p,
  CASE WHEN bool_or(contains(o_orderpriority, 'URGENT') OR contains(o_orderpriority, 'HIGH')) THEN true END AS is_urgent,
  contains(any_value(c_mktsegment), 'AUTO') AS is_auto, CAST(NULL AS BOOLEAN) AS aligned
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
"""


def rule_classify_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    facts = _facts(part, ["p_partkey"], classes=F.array("p_type"), scalars=F.create_map(F.lit("size"), value(d=F.col("p_size")), F.lit("brand"), value(s=F.col("p_brand"))))
    big = {"op": "literal_cmp", "key": "size", "cmp": "ge", "value": 25}
    chain = {"op": "and", "operands": [{"op": "class_present", "class": "Big"}, {"op": "literal_cmp", "key": "brand", "cmp": "ne", "value": "Brand#11"}]}
    out = rules.classify(facts, [("A", big, "Big"), ("B", chain, "BigOther")])
    return out.select("p_partkey", F.array_join("classes", ",").alias("classes"), F.array_join("criteria_fired", ",").alias("fired"))


O_CHAIN = """
SELECT p_partkey, concat(p_type, CASE WHEN b THEN ',Big' ELSE '' END, CASE WHEN c THEN ',BigOther' ELSE '' END) AS classes,
  concat_ws(',', CASE WHEN b THEN 'A' END, CASE WHEN c THEN 'B' END) AS fired
FROM (SELECT *, p_size >= 25 AS b, (p_size >= 25 OR contains(p_type, 'Big')) AND p_brand <> 'Brand#11' AS c FROM part)
"""


def risk_lattice_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest priority among each customer's orders, by (rank, earlier place): no list is gathered."""
    ranks = {"5-LOW": 1, "4-NOT SPECIFIED": 2, "3-MEDIUM": 3, "2-HIGH": 4, "1-URGENT": 5}
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in ranks.items() for v in kv]), F.col("o_orderpriority")), F.lit(0))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    best = o.groupBy("o_custkey").agg(F.max(F.struct(rank.alias("r"), (-F.col("o_orderkey")).alias("p"), F.col("o_orderpriority").alias("level"))).alias("x"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(best, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.coalesce("x.level", F.lit("5-LOW")).alias("risk_level"))


O_LATTICE = """
SELECT c_custkey, coalesce(arg_max(o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4 WHEN '1-URGENT' THEN 5 ELSE 0 END * 1000000000000 - o_orderkey), '5-LOW') AS risk_level
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
"""


def dedication_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both policies over each supplier's lines; a line that is neither returned nor accepted says nothing."""
    says = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("day"), says.alias("x"))
    yes, no = F.coalesce(F.bool_or("x"), F.lit(False)), F.coalesce(F.bool_or(~F.col("x")), F.lit(False))
    return lines.groupBy("l_suppkey", F.year("day").alias("year")).agg(yes.alias("restrictive"), (yes & ~no).alias("permissive"))


O_DEDICATION = """
SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, coalesce(bool_or(x), false) AS restrictive, coalesce(bool_or(x), false) AND NOT coalesce(bool_or(NOT x), false) AS permissive
FROM (SELECT l_suppkey, l_shipdate, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS x FROM lineitem) GROUP BY 1, 2
"""


def num_pde(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    species = F.element_at(F.array(*map(F.lit, ("rat", "dog", "mouse", "fish"))), (F.col("p_size") % 4 + 1).cast("int"))
    factor = numeric.pde(F.col("p_retailprice"), [numeric.species_factor(species), F.lit(10.0), numeric.duration_factor(F.col("p_size") * 5), (F.col("p_size") % 7).cast("double")])
    return p.select("p_partkey", F.round(factor, 6).alias("pde"))


O_PDE = """
SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN round(p_retailprice * 50.0 / (s * 10.0 * d * (p_size % 7)), 6) END AS pde
FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 WHEN 2 THEN 12.0 ELSE 10.0 END AS s,
  CASE WHEN p_size * 5 <= 28 THEN 10.0::DOUBLE WHEN p_size * 5 <= 90 THEN 5.0 WHEN p_size * 5 <= 180 THEN 2.0 ELSE 1.0 END AS d FROM part)
"""


def num_maco(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    route = F.when(F.col("l_quantity") > 25, "oral").otherwise("other")
    best = numeric.maco(numeric.maco_methods(F.lit(1000.0), F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice"), route))
    return line.select("l_orderkey", "l_linenumber", F.round(best["value"], 6).alias("maco"), best["method"].alias("method"))


O_MACO = """
WITH m AS (SELECT *, CASE WHEN l_discount > 0 THEN l_discount * 1000.0::DOUBLE / l_quantity END AS a,
  CASE WHEN l_tax > 0 THEN l_tax * 1000.0::DOUBLE / (1000.0::DOUBLE * l_quantity) END AS b, 10000.0::DOUBLE AS c,
  CASE WHEN l_extendedprice > 0 THEN l_extendedprice * 50.0::DOUBLE / 2000.0::DOUBLE * 1000.0::DOUBLE / (CASE WHEN l_quantity > 25 THEN 55.0::DOUBLE ELSE 550.0::DOUBLE END * l_quantity) END AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, round(least(a, b, c, d), 6) AS maco,
  CASE WHEN a = least(a, b, c, d) THEN 'pde' WHEN b = least(a, b, c, d) THEN 'dose' WHEN c = least(a, b, c, d) THEN 'general' ELSE 'noel' END AS method FROM m
"""


def num_oeb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands from an exposure limit, floors of severe endpoints (unknown where unlabelled), and acute categories."""
    d = _labelled(spark, sf_dir)
    point = numeric.band(F.col("n_chars") / 10)
    ends = [F.col("quality") == 0, F.col("toxic") == 1, F.col("toxic") == 1]
    floor = numeric.floor_band(*ends)
    return d.select("doc_id", point.alias("point"), floor.alias("floor"), numeric.recommended_band(point, floor, *ends).alias("band"), numeric.acute_category(F.col("n_chars").cast("double")).alias("acute"))


O_OEB = """
SELECT doc_id, point, floor, CASE WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN greatest(point, floor) ELSE least(5, greatest(point, floor) + 1) END AS band,
  CASE WHEN n_chars <= 5 THEN 1 WHEN n_chars <= 50 THEN 2 WHEN n_chars <= 300 THEN 3 WHEN n_chars <= 2000 THEN 4 WHEN n_chars <= 5000 THEN 5 ELSE 6 END AS acute
FROM (SELECT doc_id, n_chars, quality, toxic,
  CASE WHEN n_chars / 10 >= 1000 THEN 1 WHEN n_chars / 10 >= 100 THEN 2 WHEN n_chars / 10 >= 10 THEN 3 WHEN n_chars / 10 >= 1 THEN 4 ELSE 5 END AS point,
  greatest(CASE WHEN quality = 0 THEN 5 END, CASE WHEN toxic = 1 THEN 4 END) AS floor FROM documents LEFT JOIN labels USING (doc_id))
"""

QUERIES = {f.__name__: f for f in (rule_kleene_truth, rule_facet, rule_existential, rule_classify_chain, risk_lattice_max, dedication_policy, num_pde, num_maco, num_oeb)}
ORACLES = dict(zip(QUERIES, (O_KLEENE, O_FACET, O_EXISTENTIAL, O_CHAIN, O_LATTICE, O_DEDICATION, O_PDE, O_MACO, O_OEB), strict=True))
