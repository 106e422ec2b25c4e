"""Scans and sinks: tabular sources with a column mapping, document lines, N-Triples, change connectors, JSON reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.shared import kept
from quernstone.sources.tables import table

#: A change of an entity, whatever connector it came from.
CHANGE = "connector string, entity_id string, entity_type string, version long, label string, fields map<string,string>"
#: An N-Triples line: subject, predicate, object with its datatype or language.
TRIPLE_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z-]+))?)\s*\.\s*$'


def mapped(rows: DataFrame, mapping: dict[str, str], free_text: tuple[str, ...] = ()) -> DataFrame:
    """A sheet's columns under their property names; unmapped ones go, free-text ones into a map, rows without a value too."""
    cols = [F.col(h).cast("string").alias(p) for h, p in mapping.items() if h in rows.columns and h not in free_text]
    text = F.map_filter(F.create_map(*[x for h in free_text for x in (F.lit(mapping.get(h, h)), F.col(h).cast("string"))]), lambda k, v: F.trim(v) != "") if free_text else F.from_json(F.lit("{}"), "map<string,string>")
    out = rows.select(*cols, text.alias("free_text"))
    filled = [F.coalesce(F.trim(c) != "", F.lit(False)) for c in out.columns if c != "free_text"]
    return out.filter(reduce(Column.__or__, [*filled, F.size("free_text") > 0]))


def table_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, cells) of the lines that are table rows, ` | ` between cells; other lines are paragraphs with one cell."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line")).filter(F.trim("line") != "")
    return lines.select(key, "pos", F.transform(F.split("line", r"\|"), lambda x: F.trim(x)).alias("cells"), F.contains("line", F.lit("|")).alias("is_row"))


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, o_kind, o_datatype, o_lang) of a folder of N-Triples; lines that aren't triples are left out."""
    at = lambda i: F.nullif(F.regexp_extract("value", TRIPLE_LINE, i), F.lit(""))
    lines = spark.read.text(path).filter(F.col("value").rlike(TRIPLE_LINE))
    s = F.regexp_replace(at(1), "^<|>$", "")
    kind = F.when(at(3).isNotNull(), "iri").when(at(4).isNotNull(), "bnode").otherwise("literal")
    plain = lambda c: F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return lines.select(s.alias("s"), at(2).alias("p"), F.coalesce(at(3), at(4), plain(F.regexp_extract("value", TRIPLE_LINE, 5))).alias("o"), kind.alias("o_kind"), at(6).alias("o_datatype"), at(7).alias("o_lang")).distinct()


def write_ntriples(triples: DataFrame, path: str) -> None:
    """(s, p, o, o_kind, …) as N-Triples."""
    node = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    quoted = F.concat(F.lit('"'), F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    tail = F.when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(quoted, tail)).otherwise(node(F.col("o")))
    triples.select(F.concat_ws(" ", node(F.col("s")), F.concat(F.lit("<"), "p", F.lit(">")), o, F.lit(".")).alias("value")).write.text(path)


def inline_changes(rows: DataFrame, connector: str) -> DataFrame:
    return rows.select(F.lit(connector).alias("connector"), "entity_id", "entity_type", "version", "label", "fields")


def uploaded_changes(envelopes: DataFrame, connector: str, kinds: dict[str, str]) -> DataFrame:
    """Upload envelopes (doc_id, doc_type, version, title, metadata) in the shape of a change; unknown types keep their name."""
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv]), F.col("doc_type")), F.col("doc_type"))
    return envelopes.select(F.lit(connector).alias("connector"), F.col("doc_id").alias("entity_id"), kind.alias("entity_type"), "version", F.col("title").alias("label"), F.col("metadata").alias("fields"))


def subgraph(changes: DataFrame) -> DataFrame:
    """The ids that a change touches by dimension: sorted, each once, empty dimensions left out."""
    dims = {"equipment": ("equipment", "area", "room"), "product": ("product", "prod_code")}
    ids = [F.struct(F.lit(d).alias("d"), F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.element_at("fields", F.lit(k)) for k in ks])))).alias("ids")) for d, ks in dims.items()]
    return changes.withColumn("affected", F.map_from_entries(F.filter(F.array(*ids), lambda x: F.size(x["ids"]) > 0)))


def json_report(rows: DataFrame, key: str) -> DataFrame:
    """Each row as one JSON document."""
    return rows.select(key, F.to_json(F.struct(*sorted(rows.columns))).alias("report"))


def tabular_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a sheet, its columns under property names."""
    sheet = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Id"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("Name"), F.lit("x").alias("Unmapped"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("Note"))
    path = kept(sheet, "sheet")
    out = mapped(path, {"Name": "label", "Note": "remark"}, ("Note",))
    return out.groupBy("free_text.remark").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("n_labels"))


O_TABULAR = """
SELECT CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS remark, count(*) AS n, count(CASE WHEN c_custkey % 5 > 0 THEN c_name END) AS n_labels
FROM customer WHERE c_custkey % 5 > 0 OR c_custkey % 3 = 0 GROUP BY 1
"""


def document_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return t.groupBy("doc_id").agg(F.count_if("is_row").alias("n_rows"), F.count_if(~F.col("is_row")).alias("n_paragraphs"), F.max(F.size("cells")).alias("widest"))


O_TABLES = """
SELECT doc_id, count(*) FILTER (WHERE contains(line, '|')) AS n_rows, count(*) FILTER (WHERE NOT contains(line, '|')) AS n_paragraphs, CAST(max(len(string_split(line, '|'))) AS INTEGER) AS widest
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, ' ') <> '' GROUP BY doc_id
"""


def connector_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two connectors in one feed, with the ids that each change touches."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    none = F.from_json(F.lit("{}"), "map<string,string>")
    inline = e.filter("event_id % 2 = 0").select(F.col("user_id").cast("string").alias("entity_id"), F.lit("Equipment").alias("entity_type"), F.col("event_id").alias("version"), F.col("event_type").alias("label"), F.create_map(F.lit("equipment"), k, F.lit("room"), F.col("event_type")).alias("fields"))
    upload = e.filter("event_id % 2 = 1").select(F.concat(F.lit("d"), "user_id").alias("doc_id"), F.col("event_type").alias("doc_type"), F.col("event_id").alias("version"), F.lit("t").alias("title"), F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("product"), k)).otherwise(none).alias("metadata"))
    c = subgraph(inline_changes(inline, "aps").unionByName(uploaded_changes(upload, "repo", {"click": "Clicked"})))
    c = c.select("connector", "entity_type", F.coalesce(F.array_join(F.element_at("affected", F.lit("equipment")), ","), F.lit("")).alias("equipment"), F.coalesce(F.array_join(F.element_at("affected", F.lit("product")), ","), F.lit("")).alias("product"), "version")
    return c.groupBy("connector", "entity_type", "equipment", "product").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("cursor_to"))


O_CONNECTOR = """
WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
SELECT 'aps' AS connector, 'Equipment' AS entity_type, array_to_string(list_sort(list_distinct([k, event_type])), ',') AS equipment, '' AS product, count(*) AS n, max(event_id) AS cursor_to FROM e WHERE event_id % 2 = 0 GROUP BY ALL
UNION ALL SELECT 'repo', CASE event_type WHEN 'click' THEN 'Clicked' ELSE event_type END, '', CASE WHEN event_id % 3 = 0 THEN k ELSE '' END, count(*), max(event_id) FROM e WHERE event_id % 2 = 1 GROUP BY ALL
"""


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return json_report(n, "n_nationkey")


O_REPORT = """SELECT n_nationkey, concat('{"n_name":"', n_name, '","n_nationkey":', n_nationkey, ',"n_regionkey":', n_regionkey, '}') AS report FROM nation"""

_ALL = ((tabular_scan, O_TABULAR), (document_tables, O_TABLES), (connector_changes, O_CONNECTOR), (report_json, O_REPORT))
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: o for f, o in _ALL}
