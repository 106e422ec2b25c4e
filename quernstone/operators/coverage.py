"""Coverage of a report template by a document's edges: values, equipment columns, assessed dimensions, dismissals and fills.

A template is a list of slots known when the plan is built, so each slot is one aggregate over a document's edges: all slots
of all documents come out of a single grouping, whatever their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.ternary import holds
from quernstone.plans.rules import compiled, value
from quernstone.sources.tables import table

#: Kinds of groups and of sources, and the statuses of a slot.
GROUP_KINDS = ("fields", "equipment_table", "assessment_table", "manual")
SOURCE_KINDS = ("extraction", "rule", "manual", "constant", "llm_extraction")
FILLED, MISSING, BLANK, MANUAL, INFERRED, DISMISSED = "filled", "missing_required", "blank_optional", "manual", "inferred", "dismissed"


@dataclass(frozen=True)
class Slot:
    """A slot of a template; an extraction names a class, and one selector: text, data_property, label or relation."""

    section: str
    group: str
    kind: str
    slot: str
    source: str
    required: bool = False
    contains: str = ""
    selector: str = ""
    name: str = ""
    constant: str = ""


def checked(template: list[Slot]) -> list[Slot]:
    """The template, or a ValueError that names its first fault."""
    seen = set()
    for s in template:
        if s.kind not in GROUP_KINDS or s.source not in SOURCE_KINDS:
            raise ValueError(f"{s.slot}: unknown kind {s.kind!r} or source {s.source!r}")
        if s.slot in seen:
            raise ValueError(f"{s.slot}: stands twice")
        seen.add(s.slot)
        if s.source == "extraction" and s.selector not in ("text", "data_property", "label", "relation"):
            raise ValueError(f"{s.slot}: exactly one selector is asked for")
        if s.kind == "equipment_table" and s.selector not in ("text", "label"):
            raise ValueError(f"{s.slot}: a column of a repeated table is the text or a label")
        if s.selector in ("data_property", "label", "relation") and not s.name:
            raise ValueError(f"{s.slot}: the selector has no name")
    return template


def _short(iri: Column) -> Column:
    return F.regexp_extract(iri, "([^#/]*)$", 1)


def _found(s: Slot) -> Column:
    """What an edge gives a slot, or NULL."""
    inside = F.contains("object_class_iri", F.lit(s.contains))
    if s.selector == "relation":
        return F.when(inside & (_short(F.col("predicate_iri")) == s.name), "present")
    if s.selector == "text":
        return F.when(inside, F.nullif("object_text", F.lit("")))
    hit = (lambda d: _short(d["iri"]) == s.name) if s.selector == "data_property" else (lambda d: d["label"] == s.name)
    values = F.filter("object_data_properties", lambda d: hit(d) & F.coalesce(d["value"] != "", F.lit(False)))
    return F.when(inside, F.get(values, F.lit(0))["value"])


def _gap(s: Slot) -> Column:
    return F.lit(MISSING if s.required else BLANK)


def _record(s: Slot, slot_id: str, status: Column, held: Column, source: str) -> Column:
    return F.struct(F.lit(s.section).alias("section"), F.lit(s.group).alias("grp"), F.lit(slot_id).alias("slot_id"), status.alias("status"), held.cast("string").alias("value"), F.lit(source).alias("source"))


def coverage(documents: DataFrame, edges: DataFrame, template: list[Slot], rules: list[tuple[str, dict]], key: str = "doc_id") -> DataFrame:
    """(key, section, grp, slot_id, status, value, source) of every document.

    documents: the key, with the columns of facts that the rules read; edges: (key, pos, predicate_iri, object_class_iri,
    object_text, object_data_properties). The first edge in order that gives a value fills a slot; the text column of an
    equipment table counts its rows; each rule is a row of an assessment table: TRUE is inferred, FALSE filled, UNKNOWN a
    gap. Without rules the table is one missing row.
    """
    drawn = [s for s in checked(template) if s.source == "extraction"]
    found = [_found(s) for s in drawn]
    counted = [s.kind == "equipment_table" and s.selector == "text" for s in drawn]
    aggs = [F.count(v).alias(f"v{i}") if n else F.min(F.when(v.isNotNull(), F.struct("pos", v.alias("value"))))["value"].alias(f"v{i}") for i, (v, n) in enumerate(zip(found, counted, strict=True))]
    d = documents.join(edges.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *aggs), key, "left")
    at = {s.slot: (F.col(f"v{i}"), n) for i, (s, n) in enumerate(zip(drawn, counted, strict=True))}
    out, done = [], set()
    for s in template:
        if s.kind == "assessment_table":
            if not rules and s.group not in done:
                out.append(_record(s, f"{s.group}.__no_rules__", F.lit(MISSING), F.lit(None), "rule"))
            done.add(s.group)
            for name, pattern in rules:
                x = compiled(pattern)
                out.append(_record(s, f"{s.slot}[{name}]", F.when(x, INFERRED).when(~x, FILLED).otherwise(_gap(s)), F.lit(None), "rule"))
        elif s.source == "extraction":
            v, n = at[s.slot]
            held = F.when(v > 0, v).cast("string") if n else v
            shown = held if s.kind != "equipment_table" or n else F.lit(None)
            out.append(_record(s, s.slot, F.when(held.isNotNull(), FILLED).otherwise(_gap(s)), shown, "extraction"))
        elif s.source == "constant":
            out.append(_record(s, s.slot, F.lit(FILLED), F.lit(s.constant), "constant"))
        else:
            out.append(_record(s, s.slot, F.lit(MANUAL), F.lit(None), "manual"))
    return d.select(key, F.posexplode(F.array(*out)).alias("place", "_s")).select(key, "place", "_s.*")


def base_id(slot_id: Column) -> Column:
    return F.substring_index(slot_id, "[", 1)


def dismissed(records: DataFrame, dismissals: DataFrame, key: str = "doc_id") -> DataFrame:
    """Missing slots that a dismissal (key, slot_id) names, whole or by what stands before `[`, are dismissed.

    A document's dismissals meet its records as one row, so that records stay where their key has put them.
    """
    d = dismissals.groupBy(key).agg(F.collect_set("slot_id").alias("_slots"))
    named = F.array_contains("_slots", F.col("slot_id")) | F.array_contains("_slots", base_id(F.col("slot_id")))
    return records.join(d, key, "left").withColumn("status", F.when((F.col("status") == MISSING) & holds(named), DISMISSED).otherwise(F.col("status"))).select(records.columns)


def filled_in(records: DataFrame, fills: DataFrame, key: str = "doc_id") -> DataFrame:
    """Missing slots with what was found for them elsewhere (key, slot_id, value): by whole id, else by what stands before `[`; the least value of several."""
    # by document and slot in one aggregation: sorted, so that the first of a slot is its least
    found = F.array_sort(F.collect_set(F.when(F.col("slot_id").isNotNull() & F.col("value").isNotNull(), F.struct("slot_id", "value"))))
    f = fills.groupBy(key).agg(found.alias("_found"))
    of = lambda slot: F.get(F.filter("_found", lambda x: x["slot_id"] == slot), F.lit(0))["value"]
    j = records.join(f, key, "left")
    return j.withColumn("fill", F.when(F.col("status") == MISSING, F.coalesce(of(F.col("slot_id")), of(base_id(F.col("slot_id")))))).select(*records.columns, "fill")


def tree(template: list[Slot]) -> list[tuple[str, str, int]]:
    """(section, group, slots) in the order in which they are first seen."""
    out: dict[tuple[str, str], int] = {}
    for s in template:
        out[s.section, s.group] = out.get((s.section, s.group), 0) + 1
    return [(a, b, n) for (a, b), n in out.items()]


def expanded(template: DataFrame, domains: DataFrame, bound: DataFrame) -> DataFrame:
    """Slots that a template (section, class) could also have: properties (prop, class) of its classes not yet bound (prop), each at the first section."""
    new = template.join(domains, "class").join(bound.select("prop").distinct(), "prop", "left_anti")
    return new.groupBy("prop").agg(F.min(F.struct("section", "class")).alias("x")).select("prop", "x.section", "x.class")


#: The demonstration: orders are documents, their lines edges to reactors (open lines) and impurities.
TEMPLATE = [
    Slot("1", "head", "fields", "head.title", "constant", constant="Report"),
    Slot("1", "head", "fields", "head.code", "extraction", True, "Impurity", "text"),
    Slot("1", "head", "fields", "head.amount", "extraction", True, "Reactor", "data_property", "quantity"),
    Slot("1", "head", "fields", "head.tax", "extraction", False, "Impurity", "label", "Tax"),
    Slot("1", "head", "fields", "head.returned", "extraction", False, "Impurity", "relation", "returns"),
    Slot("2", "devices", "equipment_table", "devices.id", "extraction", True, "Reactor", "text"),
    Slot("2", "devices", "equipment_table", "devices.tax", "extraction", False, "Reactor", "label", "Tax"),
    Slot("3", "risk", "assessment_table", "risk.level", "rule", True),
    Slot("4", "notes", "manual", "notes.remark", "manual"),
    Slot("4", "notes", "fields", "notes.more", "llm_extraction"),
]
RISKS = [("R1", {"op": "literal_cmp", "key": "price", "cmp": "gt", "value": 150000}), ("R2", {"op": "class_present", "class": "URGENT"})]


def order_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_returnflag", "l_linestatus")
    dp = lambda iri, label, v: F.struct(F.lit(iri).alias("iri"), F.lit(label).alias("label"), v.alias("value"))
    edges = line.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("int")).alias("pos"),
        F.when(F.col("l_returnflag") == "R", "http://x/rel#returns").otherwise("http://x/rel#has").alias("predicate_iri"),
        F.when(F.col("l_linestatus") == "O", "http://x/Reactor").otherwise("http://x/ImpurityClass").alias("object_class_iri"),
        F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("P"), "l_partkey")).otherwise("").alias("object_text"),
        F.array(dp("http://x/p#quantity", "Quantity", F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("int").cast("string"))), dp("http://x/p#tax", "Tax", F.when(F.col("l_tax") > 0.05, F.lit("high")).otherwise(""))).alias("object_data_properties"),
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    docs = o.select(
        F.col("o_orderkey").alias("doc_id"), "o_orderpriority",
        F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>")).otherwise(F.array("o_orderpriority")).alias("classes"), none.alias("relations"), none.alias("alignments"),
        F.create_map(F.lit("x"), value(d=F.lit(1.0))).alias("data_values"),
        F.create_map(F.lit("price"), value(d=F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))).alias("scalars"),
    )
    return docs, edges


def coverage_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of every order."""
    docs, edges = order_edges(spark, sf_dir)
    return coverage(docs.drop("o_orderpriority"), edges, TEMPLATE, RISKS).drop("place")


O_COVERAGE = """
WITH e AS (SELECT l_orderkey AS d, l_linenumber * 10000000 + l_partkey * 100 + l_quantity::INT AS pos, l_linestatus = 'O' AS r, nullif(CASE WHEN l_partkey % 3 > 0 THEN concat('P', l_partkey) ELSE '' END, '') AS t,
    CASE WHEN l_quantity > 25 THEN l_quantity::INT::VARCHAR END AS q, CASE WHEN l_tax > 0.05 THEN 'high' END AS tax, l_returnflag = 'R' AS ret FROM lineitem),
a AS (SELECT d, arg_min(t, pos) FILTER (NOT r AND t IS NOT NULL) AS code, arg_min(q, pos) FILTER (r AND q IS NOT NULL) AS amount, min(tax) FILTER (NOT r) AS tax,
    CASE WHEN bool_or(NOT r AND ret) THEN 'present' END AS returned, count(t) FILTER (r) AS n, min(tax) FILTER (r) AS dtax FROM e GROUP BY d),
j AS (SELECT o_orderkey AS doc_id, a.*, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 150000 END AS r1, CASE WHEN o_orderstatus <> 'P' THEN contains(o_orderpriority, 'URGENT') END AS r2
  FROM orders LEFT JOIN a ON d = o_orderkey)
SELECT doc_id, '1' AS section, 'head' AS grp, 'head.title' AS slot_id, 'filled' AS status, 'Report' AS value, 'constant' AS source FROM j
UNION ALL SELECT doc_id, '1', 'head', 'head.code', CASE WHEN code IS NULL THEN 'missing_required' ELSE 'filled' END, code, 'extraction' FROM j
UNION ALL SELECT doc_id, '1', 'head', 'head.amount', CASE WHEN amount IS NULL THEN 'missing_required' ELSE 'filled' END, amount, 'extraction' FROM j
UNION ALL SELECT doc_id, '1', 'head', 'head.tax', CASE WHEN tax IS NULL THEN 'blank_optional' ELSE 'filled' END, tax, 'extraction' FROM j
UNION ALL SELECT doc_id, '1', 'head', 'head.returned', CASE WHEN returned IS NULL THEN 'blank_optional' ELSE 'filled' END, returned, 'extraction' FROM j
UNION ALL SELECT doc_id, '2', 'devices', 'devices.id', CASE WHEN n > 0 THEN 'filled' ELSE 'missing_required' END, CASE WHEN n > 0 THEN n::VARCHAR END, 'extraction' FROM j
UNION ALL SELECT doc_id, '2', 'devices', 'devices.tax', CASE WHEN dtax IS NULL THEN 'blank_optional' ELSE 'filled' END, NULL, 'extraction' FROM j
UNION ALL SELECT doc_id, '3', 'risk', 'risk.level[R1]', CASE WHEN r1 THEN 'inferred' WHEN NOT r1 THEN 'filled' ELSE 'missing_required' END, NULL, 'rule' FROM j
UNION ALL SELECT doc_id, '3', 'risk', 'risk.level[R2]', CASE WHEN r2 THEN 'inferred' WHEN NOT r2 THEN 'filled' ELSE 'missing_required' END, NULL, 'rule' FROM j
UNION ALL SELECT doc_id, '4', 'notes', 'notes.remark', 'manual', NULL, 'manual' FROM j
UNION ALL SELECT doc_id, '4', 'notes', 'notes.more', 'manual', NULL, 'manual' FROM j
"""


def coverage_dismissals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots by status after dismissals (low orders dismiss risks, urgent ones their code) and fills by the customer's segment."""
    docs, edges = order_edges(spark, sf_dir)
    records = coverage(docs.drop("o_orderpriority"), edges, TEMPLATE, RISKS)
    low = docs.filter("o_orderpriority = '5-LOW'").select("doc_id", F.lit("risk.level").alias("slot_id"))
    urgent = docs.filter("o_orderpriority = '1-URGENT'").select("doc_id", F.lit("head.code").alias("slot_id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey")
    fills = o.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("value")), "o_custkey").select("doc_id", F.explode(F.array(F.lit("risk.level[R1]"), F.lit("head.amount"))).alias("slot_id"), "value")
    out = filled_in(dismissed(records, low.unionByName(urgent)), fills)
    return out.groupBy("section", "slot_id", "status", "fill").agg(F.count(F.lit(1)).alias("n"))


O_DISMISSALS = f"""
WITH c AS ({O_COVERAGE}), x AS (SELECT c.*, c_mktsegment AS seg, CASE WHEN status = 'missing_required' AND ((o_orderpriority = '5-LOW' AND slot_id LIKE 'risk.level[%') OR (o_orderpriority = '1-URGENT' AND slot_id = 'head.code')) THEN 'dismissed' ELSE status END AS st
  FROM c JOIN orders ON doc_id = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey)
SELECT section, slot_id, st AS status, CASE WHEN st = 'missing_required' AND slot_id IN ('risk.level[R1]', 'head.amount') THEN seg END AS fill, count(*) AS n FROM x GROUP BY ALL
"""


def coverage_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template's tree with each group's records: slots, and how many of all documents' are filled, in the template's order."""
    docs, edges = order_edges(spark, sf_dir)
    records = coverage(docs.drop("o_orderpriority"), edges, TEMPLATE, RISKS)
    groups = records.groupBy("section", "grp").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(FILLED, INFERRED)).alias("n_filled"), F.array_join(F.array_sort(F.collect_set("slot_id")), ",").alias("slots"))
    sizes = spark.createDataFrame(tree(TEMPLATE), "section string, grp string, n_slots int")
    return groups.join(F.broadcast(sizes), ["section", "grp"]).drop("place")


O_TREE = f"""
SELECT section, grp, count(*) AS n, count(*) FILTER (status IN ('filled', 'inferred')) AS n_filled, string_agg(DISTINCT slot_id, ',' ORDER BY slot_id) AS slots,
  CAST(CASE grp WHEN 'head' THEN 5 WHEN 'devices' THEN 2 WHEN 'risk' THEN 1 ELSE 2 END AS INTEGER) AS n_slots FROM ({O_COVERAGE}) GROUP BY 1, 2
"""


def template_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sections, their customers' segments as classes, part names as properties of classes; names of parts of the largest size are bound already."""
    n = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("section"), F.col("c_mktsegment").alias("class")).distinct()
    p = table(spark, sf_dir, "part").select("p_name", "p_size", F.element_at(F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]), F.col("p_size") % 5 + 1).alias("class"))
    return expanded(n, p.select(F.col("p_name").alias("prop"), "class").distinct(), p.filter("p_size = 50").select(F.col("p_name").alias("prop")))


O_EXPANSION = """
WITH n AS (SELECT DISTINCT c_nationkey::VARCHAR AS section, c_mktsegment AS class FROM customer),
p AS (SELECT DISTINCT p_name AS prop, (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[p_size % 5 + 1] AS class FROM part)
SELECT prop, section, class FROM n JOIN p USING (class) WHERE prop NOT IN (SELECT p_name FROM part WHERE p_size = 50) QUALIFY row_number() OVER (PARTITION BY prop ORDER BY section, class) = 1
"""

_ALL = ((coverage_by_group, O_COVERAGE), (coverage_dismissals, O_DISMISSALS), (coverage_tree, O_TREE), (template_expansion, O_EXPANSION))
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: o for f, o in _ALL}
