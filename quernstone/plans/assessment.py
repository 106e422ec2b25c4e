"""The assessment: facts are bound, classified, put to the rule groups for each pathway, conflicts resolved, limits computed.

One lazy plan without a shuffle of its own. Facts that rules read are plain nullable columns, so rules are generated code;
what the cross product with pathways would make rows of are conditions within the row.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import numeric
from quernstone.functions.ternary import any_of
from quernstone.plans import rules
from quernstone.plans.rules import Flat, Rule
from quernstone.plans.shared_line import PATHWAYS
from quernstone.sources.tables import table

LATTICE = {"LowRisk": 1, "MediumRisk": 2, "HighRisk": 3}

#: The rules of the demonstration over order lines: criteria, then the groups.
CRITERIA = [
    ("C1", {"op": "datatype_facet", "property": "potency", "cmp": "ge", "value": 7}, "HighPotency"),
    ("C2", {"op": "and", "operands": [{"op": "class_present", "class": "HighPotency"}, {"op": "literal_cmp", "key": "cleanability", "cmp": "ge", "value": 30}]}, "Hazard"),
]
RULES = [
    Rule("D1", "dedication", 1, {"op": "and", "operands": [{"op": "class_present", "class": "Hazard"}, {"op": "boolean_has_value", "property": "clean", "value": False}]}, {"dedicated": True}),
    Rule("D2", "dedication", 2, {"op": "and", "operands": [{"op": "class_present", "class": "HighPotency"}, {"op": "some_values_from", "property": "flag", "filler_class": "R"}]}, {"dedicated": True}),
    Rule("D3", "dedication", 3, {"op": "class_membership", "property": "flag", "classes": ["A", "N"]}, {"dedicated": False}),
    Rule("K1", "contamination", 1, {"op": "and", "operands": [{"op": "literal_eq", "key": "pathway", "value": "airborne"}, {"op": "literal_cmp", "key": "cleanability", "cmp": "le", "value": 10}]}, {"level": "HighRisk"}),
    Rule("K2", "contamination", 2, {"op": "and", "operands": [{"op": "literal_eq", "key": "pathway", "value": "mechanical"}, {"op": "class_present", "class": "Hazard"}]}, {"level": "MediumRisk"}),
    Rule("K3", "contamination", 3, {"op": "or", "operands": [{"op": "literal_cmp", "key": "cleanability", "cmp": "gt", "value": 40}, {"op": "boolean_has_value", "property": "clean", "value": True}]}, {"level": "LowRisk"}),
]


def assessed(facts: DataFrame, flat: Flat, criteria: list, rule_set: list[Rule], pathways: tuple[str, ...] = PATHWAYS, restrictive: bool = True) -> DataFrame:
    """facts with `dedicated`, `risk_level`, `n_fired`, the keys of all rules that fired, and the facts that each of them read.

    flat names the columns that are facts. A rule that doesn't read the pathway is one expression for all of them.
    """
    out, fired = facts, []
    for i, (key, pattern, adds) in enumerate(criteria):
        out = out.withColumn(f"_c{i}", rules.holds(flat.compiled(pattern)))
        flat = replace(flat, added=[*flat.added, (adds, F.col(f"_c{i}"))])
        fired.append((key, F.col(f"_c{i}"), pattern, None))
    own = lambda g: sorted((r for r in rule_set if r.group == g), key=lambda r: (r.priority, r.key))
    new = {}
    for r in own("dedication"):
        new[f"_d{r.key}"] = rules.holds(flat.compiled(r.pattern))
        fired.append((r.key, F.col(f"_d{r.key}"), r.pattern, None))
    for r in own("contamination"):
        ways = pathways if "pathway" in rules.referenced(r.pattern) else pathways[:1]
        for p in ways:
            new[f"_k{r.key}{p}"] = rules.holds(flat.with_scalar("pathway", s=F.lit(p)).compiled(r.pattern))
        fired += [(r.key, F.col(f"_k{r.key}{p if len(ways) > 1 else ways[0]}"), r.pattern, p) for p in pathways]
    out = out.withColumns(new)
    said = {v: [F.col(f"_d{r.key}") for r in own("dedication") if r.consequent["dedicated"] is v] for v in (True, False)}
    dedicated = any_of(said[True]) if restrictive else any_of(said[True]) & ~any_of(said[False])
    level = F.lit(min(LATTICE, key=LATTICE.get))
    for name in sorted({r.consequent["level"] for r in own("contamination")}, key=lambda x: LATTICE.get(x, 0)):
        level = F.when(any_of([F.col(c) for c in new for r in own("contamination") if r.consequent["level"] == name and c.startswith(f"_k{r.key}")]), name).otherwise(level)
    read = lambda pattern, p: (flat.with_scalar("pathway", s=F.lit(p)) if p else flat).facts(pattern)
    return out.withColumns(
        {
            "dedicated": dedicated,
            "risk_level": level,
            "n_fired": reduce(Column.__add__, [on.cast("int") for _, on, _, _ in fired]),
            "rules_fired": F.array_compact(F.array(*[F.when(on, F.lit(key)) for key, on, _, _ in fired])),
            "provenance": F.array_compact(F.array(*[F.when(on, F.struct(F.lit(key).alias("rule"), F.lit(p).alias("pathway"), read(x, p).alias("facts"))) for key, on, x, p in fired])),
        }
    ).drop(*new, *[f"_c{i}" for i in range(len(criteria))])


def order_line_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Flat]:
    """A row of facts for each order line: the part is the product, the supplier the equipment. No discount is an unknown potency."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    d = joined.select("l_orderkey", "l_linenumber", "p_brand", "p_type", "p_size", "l_quantity", "p_retailprice", "l_returnflag", "l_linestatus", F.when(F.col("l_discount") > 0, F.round(F.col("l_discount") * 100, 6)).alias("potency"), (F.col("s_acctbal") > 0).alias("clean"))
    flat = Flat(
        [F.col("p_type")],
        {("relations", "flag"): [F.col("l_returnflag"), F.col("l_linestatus")]},
        {("data", "potency"): {"d": F.col("potency")}, ("data", "clean"): {"b": F.col("clean")}, ("scalars", "cleanability"): {"d": F.col("p_size")}},
    )
    return d, flat


def recommended(dedicated: Column, risk_level: Column, limit: Column, scenarios: Column) -> Column:
    """What follows from a result, in order: dedicated equipment, an air system of its own, cleaning validation, a specific method."""
    return F.array_compact(
        F.array(
            F.when(rules.holds(dedicated), F.lit("dedicate the equipment")),
            F.when(F.exists(scenarios, lambda s: s.contains("HormonalCytotoxicHighPotencyScenario")), F.lit("separate air handling")),
            F.when(risk_level == "HighRisk", F.lit("strengthen cleaning validation")),
            F.when(limit < 0.01, F.format_string("limit of %.6f mg: use a specific method", limit)),
        )
    )


def rule_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule fired on each set of facts that it read."""
    facts, flat = order_line_facts(spark, sf_dir)
    # lines with equal facts fire the same rules: they are counted first, and put to the rules once
    equal = facts.groupBy("p_type", "p_size", "l_returnflag", "l_linestatus", "potency", "clean").agg(F.count(F.lit(1)).alias("lines"))
    rows = assessed(equal, flat, CRITERIA, RULES).select(F.explode("provenance").alias("p"), "lines")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("p.facts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("p.rule", "p.pathway", text.alias("facts"), "lines").groupBy("rule", "pathway", "facts").agg(F.sum("lines").alias("n"))


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations of every order line, counted."""
    facts, flat = order_line_facts(spark, sf_dir)
    scenario = F.when(F.col("dedicated"), F.array(F.lit("http://x/HormonalCytotoxicHighPotencyScenario"))).otherwise(F.array().cast("array<string>"))
    limit = F.col("p_retailprice") / (F.col("l_quantity") * F.lit(5000.0))
    rows = assessed(facts, flat, CRITERIA, RULES).select(F.explode(recommended(F.col("dedicated"), F.col("risk_level"), limit, scenario)).alias("recommendation"))
    return rows.groupBy(F.substring_index("recommendation", " of ", 1).alias("recommendation")).agg(F.count(F.lit(1)).alias("n"))


def assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, flat = order_line_facts(spark, sf_dir)
    out = assessed(facts, flat, CRITERIA, RULES)
    methods = numeric.maco_methods(F.lit(1000.0), F.col("l_quantity"), F.col("p_retailprice") / 1000, F.lit(0.0), F.lit(0.0), F.lit("oral"))
    limit = numeric.maco(methods)["value"]
    groups = out.select("p_brand", "risk_level", "dedicated", F.col("n_fired").alias("n"), limit.alias("limit")).groupBy("p_brand", "risk_level", "dedicated")
    return groups.agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n").alias("n_rules"), F.round(F.min("limit"), 4).alias("least_maco"))


ORACLE_ASSESSMENT = """
WITH f AS (SELECT p_brand, p_type, p_size, l_quantity, p_retailprice, l_returnflag, l_linestatus,
    CASE WHEN l_discount > 0 THEN round(l_discount * 100, 6) END AS potency, s_acctbal > 0 AS clean
  FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey),
c AS (SELECT *, coalesce(potency >= 7, false) OR contains(p_type, 'HighPotency') AS hp FROM f),
h AS (SELECT *, hp AND p_size >= 30 AS hz, coalesce(potency >= 7, false) AS c1 FROM c),
r AS (SELECT *, coalesce(hz AND clean = false, false) AS d1,
    hp AND (contains(l_returnflag, 'R') OR contains(l_linestatus, 'R')) AS d2,
    contains(l_returnflag, 'A') OR contains(l_returnflag, 'N') OR contains(l_linestatus, 'A') OR contains(l_linestatus, 'N') AS d3,
    p_size <= 10 AS k1, hz AS k2, coalesce(p_size > 40 OR clean, false) AS k3 FROM h)
SELECT p_brand, CASE WHEN k1 THEN 'HighRisk' WHEN k2 THEN 'MediumRisk' ELSE 'LowRisk' END AS risk_level, d1 OR d2 AS dedicated,
  count(*) AS n_lines, CAST(sum(c1::INT + hz::INT + d1::INT + d2::INT + d3::INT + k1::INT + k2::INT + 4 * k3::INT) AS BIGINT) AS n_rules,
  round(min(least(CASE WHEN p_retailprice > 0 THEN p_retailprice / 1000 * 1000 / l_quantity ELSE 10000.0 END, 10000.0)), 4) AS least_maco
FROM r GROUP BY 1, 2, 3
"""

ORACLE_PROVENANCE = """
WITH f AS (SELECT p_type, p_size, l_returnflag AS rf, l_linestatus AS ls, CASE WHEN l_discount > 0 THEN round(l_discount * 100, 6) END AS potency, s_acctbal > 0 AS clean
  FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey),
c AS (SELECT *, coalesce(potency >= 7, false) AS c1, coalesce(potency >= 7, false) OR contains(p_type, 'HighPotency') AS hp FROM f),
h AS (SELECT *, hp AND p_size >= 30 AS hz, concat('cleanability=', p_size::DOUBLE::VARCHAR) AS cl, concat('flag=', rf, ',', ls) AS fl, 'clean=' || clean::VARCHAR AS cn FROM c),
w(pathway) AS (VALUES ('residue'), ('airborne'), ('mechanical'), ('confusion')),
x AS (SELECT 'C1' AS rule, NULL AS pathway, concat('potency=', potency::VARCHAR) AS facts FROM h WHERE c1 UNION ALL SELECT 'C2', NULL, replace(cl, '.0', '') FROM h WHERE hz
  UNION ALL SELECT 'D1', NULL, cn FROM h WHERE hz AND clean = false UNION ALL SELECT 'D2', NULL, fl FROM h WHERE hp AND (rf = 'R' OR ls = 'R') UNION ALL SELECT 'D3', NULL, fl FROM h WHERE rf IN ('A', 'N') OR ls IN ('A', 'N')
  UNION ALL SELECT 'K1', 'airborne', replace(concat(cl, ';pathway=airborne'), '.0', '') FROM h WHERE p_size <= 10 UNION ALL SELECT 'K2', 'mechanical', 'pathway=mechanical' FROM h WHERE hz
  UNION ALL SELECT 'K3', pathway, concat_ws(';', cn, replace(cl, '.0', '')) FROM h, w WHERE coalesce(p_size > 40 OR clean, false))
SELECT rule, pathway, facts, count(*) AS n FROM x GROUP BY ALL
"""

ORACLE_RECOMMENDATIONS = """
WITH f AS (SELECT p_size, p_type, l_quantity, p_retailprice, l_returnflag AS rf, l_linestatus AS ls, coalesce(CASE WHEN l_discount > 0 THEN round(l_discount * 100, 6) END >= 7, false) AS hp, s_acctbal > 0 AS clean
  FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey),
r AS (SELECT *, (hp AND p_size >= 30 AND coalesce(NOT clean, false)) OR (hp AND (rf = 'R' OR ls = 'R')) AS ded FROM f)
SELECT 'dedicate the equipment' AS recommendation, count(*) AS n FROM r WHERE ded HAVING count(*) > 0 UNION ALL SELECT 'separate air handling', count(*) FROM r WHERE ded HAVING count(*) > 0
UNION ALL SELECT 'strengthen cleaning validation', count(*) FROM r WHERE p_size <= 10 HAVING count(*) > 0 UNION ALL SELECT 'limit', count(*) FROM r WHERE p_retailprice / (l_quantity * 5000) < 0.01 HAVING count(*) > 0
"""

QUERIES = {"assessment": assessment, "rule_provenance": rule_provenance, "recommendations": recommendations}
ORACLES = {"assessment": ORACLE_ASSESSMENT, "rule_provenance": ORACLE_PROVENANCE, "recommendations": ORACLE_RECOMMENDATIONS}
