"""Extraction from documents without models: relation finders by class, candidates from row to individual, typing in two passes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators.tables import filled_blanks, group_key
from quernstone.sources.tables import dealt, table

#: Scores asked of a span's own text and of its context, and the namespace of documents.
DIRECT, IN_CONTEXT, FACTS = 0.85, 0.50, "http://x/facts#"
#: Endpoint finders by the class of their range: each makes (doc_id, pos, object_text) of (doc_id, text).
FINDERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def finder(range_class: str) -> Callable:
    """Registers a finder for properties with this range."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        FINDERS[range_class] = f
        return f

    return register


def by_pattern(docs: DataFrame, pattern: str, group: int = 0) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    return docs.select("doc_id", F.posexplode(found).alias("pos", "object_text"))


@finder("License")
def licenses(docs: DataFrame) -> DataFrame:
    return by_pattern(docs, r"(?i)licensed under (?:the )?([A-Za-z0-9 .-]*[A-Za-z0-9])", 1)


@finder("Address")
def addresses(docs: DataFrame) -> DataFrame:
    return by_pattern(docs, r"[a-z0-9.]+@[a-z0-9]+\.example\.com")


@finder("Host")
def hosts(docs: DataFrame) -> DataFrame:
    return by_pattern(docs, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")


def relations(docs: DataFrame, properties: list[tuple[str, str]]) -> DataFrame:
    """Edges (doc_id, predicate, object_class, pos, object_text) of properties (predicate, range): the range's finder is asked, each object told once, at its first place.

    Properties whose range has no finder give nothing.
    """
    parts = [FINDERS[r](docs).groupBy("doc_id", "object_text").agg(F.min("pos").alias("pos")).select("doc_id", F.lit(p).alias("predicate"), F.lit(r).alias("object_class"), "pos", "object_text") for p, r in properties if r in FINDERS]
    return reduce(DataFrame.unionByName, parts)


def prefix_matched(steps: DataFrame, rows: DataFrame) -> DataFrame:
    """(step, code): rows (cell, code) whose cell, without white space, starts with a step's name, each code once a step.

    Cells are cut to the lengths that step names have, a number bounded by the longest name, and joined by equality: no nested loop.
    """
    flat = lambda c: F.regexp_replace(c, r"\s+", "")
    s = steps.select("step", flat(F.col("step")).alias("key")).distinct()
    lengths = sorted(r["n"] for r in s.select(F.char_length("key").alias("n")).distinct().collect())  # no more than the longest name is long
    cut = rows.withColumn("cell", flat(F.col("cell"))).select("code", F.explode(F.array(*[F.when(F.char_length("cell") >= n, F.substring("cell", 1, n)) for n in lengths])).alias("key")).filter("key IS NOT NULL")
    return s.join(cut.distinct(), "key").select("step", "code").distinct()


def two_pass(raw: Column, context: Column, span: Column) -> Column:
    """The class of a span by (class, score) of its own text, if that is sure; else, unless the span is short, by its context's."""
    return F.when(raw["score"] >= DIRECT, raw["cls"]).when(~T.short_span(span) & (context["score"] >= IN_CONTEXT), context["cls"])


def committed(candidates: DataFrame, phases: DataFrame) -> DataFrame:
    """Candidates (id, target, aligned, source, props) as individuals: the aligned IRI or a new one, and provenance for what came of documents.

    phases: (source, phase); a phase that a candidate has already stays.
    """
    j = candidates.join(phases.groupBy("source").agg(F.min("phase").alias("_phase")), "source", "left")
    own = F.startswith(F.coalesce("source", F.lit("")), F.lit(FACTS))
    known = F.map_contains_key("props", F.lit("hasDevelopmentPhase"))
    more = F.when(own & F.col("_phase").isNotNull() & ~known, F.map_concat("props", F.create_map(F.lit("hasDevelopmentPhase"), F.col("_phase")))).otherwise(F.col("props"))
    linked = F.when(own, F.map_concat(F.map_filter(more, lambda k, v: k != "extractedFrom"), F.create_map(F.lit("extractedFrom"), F.col("source")))).otherwise(more)
    return j.select("id", F.coalesce("aligned", F.concat("target", F.lit("_"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 8))).alias("iri"), linked.alias("props"), F.lit("committed").alias("review_status"))


def reviewed(candidates: DataFrame, merges: DataFrame, splits: DataFrame) -> DataFrame:
    """Candidates (id, target, status, merged_into) after merges (id, into) and splits (id, parts: array of texts).

    A merged row names its target; a split row stays, and each part is a new pending row. Merges into a candidate that isn't there are ignored.
    """
    there = merges.join(candidates.select(F.col("id").alias("into")), "into", "left_semi").groupBy("id").agg(F.min("into").alias("_into"))
    cut = splits.groupBy("id").agg(F.min("parts").alias("_parts"))
    j = candidates.join(there, "id", "left").join(cut, "id", "left")
    old = j.select("id", "target", F.when(F.col("_into").isNotNull(), "merged").when(F.col("_parts").isNotNull(), "split").otherwise(F.col("status")).alias("status"), F.coalesce("_into", "merged_into").alias("merged_into"))
    new = j.filter("_parts IS NOT NULL").select("id", "target", F.posexplode("_parts").alias("i", "part"))
    new = new.select(F.concat("id", F.lit("/"), "i").alias("id"), "target", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("merged_into"))
    return old.unionByName(new)


def grouped(candidates: DataFrame, key: str) -> DataFrame:
    """(key, n, canonical, members): a row for each group with its canonical member; rows without a key stay rows of their own."""
    best = F.max(F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), (-F.col("pos")).alias("p"), F.col("id")))["id"]
    g = candidates.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), best.alias("canonical"))
    alone = candidates.filter(F.col(key).isNull()).select(F.lit(None).cast("string").alias(key), F.lit(1).cast("long").alias("n"), F.col("id").alias("canonical"))
    return g.unionByName(alone)


def staged(rows: DataFrame, mentions: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows (id, name, kind, size, score, a and b: maps of structured and free values) through the stages: blanks filled, gate by kinds that are mentioned (kind), aligned by exact id (id, iri), keyed, canonical rows marked."""
    d = rows.withColumn("props", filled_blanks(F.col("a"), F.col("b"))).filter("size(props) > 0")
    d = d.join(mentions.select("kind").distinct(), "kind", "left_semi").join(existing, "id", "left")
    d = d.withColumn("key", group_key([F.col("name"), F.col("kind")], F.col("id").cast("string"), F.col("size") > 25))
    best = d.groupBy("key").agg(F.max(F.struct(F.coalesce("score", F.lit(0.0)), -F.col("id"))).alias("x")).select("key", (-F.col("x.col2")).alias("_best"))
    return d.join(best, "key").select("id", "key", "iri", F.size("props").alias("n_props"), (F.col("id") == F.col("_best")).alias("canonical"))


def folded_labels(hits: DataFrame, key: str) -> DataFrame:
    """(key, label, value): what was found under each label, as JSON: the text itself if there is one, else all in order."""
    g = hits.groupBy(key, "label").agg(F.array_sort(F.collect_list(F.struct("pos", "value")))["value"].alias("v"))
    return g.select(key, "label", F.when(F.size("v") == 1, F.to_json(F.struct(F.col("v")[0].alias("v")))).otherwise(F.to_json(F.struct("v"))).alias("value"))


# queries


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses, mail addresses and hosts that documents name; the last property's range has no finder."""
    return relations(_docs(spark, sf_dir), [("hasLicense", "License"), ("writtenBy", "Address"), ("runsOn", "Host"), ("hasTaste", "Taste")])


_FOUND = "SELECT doc_id, {p} AS predicate, {c} AS object_class, CAST(min(i) - 1 AS INTEGER) AS pos, x AS object_text FROM (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{r}', {g}) AS xs FROM documents)) GROUP BY doc_id, x"
O_RELATIONS = " UNION ALL ".join(
    _FOUND.format(p=p, c=c, r=r, g=g)
    for p, c, r, g in (("'hasLicense'", "'License'", "(?i)licensed under (?:the )?([A-Za-z0-9 .-]*[A-Za-z0-9])", 1), ("'writtenBy'", "'Address'", r"[a-z0-9.]+@[a-z0-9]+\.example\.com", 0), ("'runsOn'", "'Host'", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0))
)


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: how many, where the first begins and the last ends, and all of them hashed."""
    t = T.tokenised(dealt(_docs(spark, sf_dir), "doc_id"), "text").select("doc_id", F.col("tokens").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.get("t", F.lit(0))["start"].alias("first_start"), F.element_at("t", -1)["end"].alias("last_end"), F.sha2(F.array_join("t.token", "\n"), 256).alias("tokens_sha256"))


O_TOKENS = r"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(length(text) - length(ltrim(text, E' \t\n\r\x0b\x0c')) AS INTEGER) AS first_start, CAST(length(rtrim(text, E' \t\n\r\x0b\x0c')) AS INTEGER) AS last_end, sha256(array_to_string(t, chr(10))) AS tokens_sha256
FROM (SELECT doc_id, text, regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]|[A-Za-z0-9]+(?:[._/%-][A-Za-z0-9]+)*|[^\s\x0b]') AS t FROM documents)
"""


def span_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans made of lines of orders: measures, ranges, comparisons, words of one character, short and long names, in two scripts."""
    q, p = F.col("l_quantity").cast("int").cast("string"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    forms = [F.concat(q, F.lit("L")), q, F.concat(q, F.lit(" 分钟")), F.concat(F.lit("≤ "), q), F.concat(q, F.lit("-"), q), F.substring("p_name", 1, 1), F.substring("p_name", 1, 4), F.col("p_name"), F.lit("反应釜"), F.lit("旋转蒸发器")]
    d = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(p, "l_partkey").select(F.element_at(F.array(*forms), F.col("p_size") % len(forms) + 1).alias("span"))
    return d.groupBy("span").agg(F.count(F.lit(1)).alias("n")).select("span", "n", T.no_entity(F.col("span")).alias("no_entity"), T.short_span(F.col("span")).alias("short"))


O_SPANS = """
WITH f AS (SELECT p_size % 10 AS k, p_name, l_quantity::INT::VARCHAR AS q FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT k, CASE k WHEN 0 THEN concat(q, 'L') WHEN 1 THEN q WHEN 2 THEN concat(q, ' 分钟') WHEN 3 THEN concat('≤ ', q) WHEN 4 THEN concat(q, '-', q) WHEN 5 THEN substr(p_name, 1, 1) WHEN 6 THEN substr(p_name, 1, 4) WHEN 7 THEN p_name WHEN 8 THEN '反应釜' ELSE '旋转蒸发器' END AS span FROM f)
SELECT span, count(*) AS n, min(k) <= 5 AS no_entity, CASE WHEN min(k) = 8 THEN true WHEN min(k) = 9 THEN false WHEN min(k) = 2 THEN true ELSE length(span) <= 4 END AS short FROM s GROUP BY span
"""


def text_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, impurities, subclasses, first alternatives, versions and headings out of lines made of parts."""
    p = table(spark, sf_dir, "part")
    title = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("Report AB-"), F.col("p_partkey") + 100, F.lit(" on "), "p_name")).otherwise(F.concat(F.lit("Report on "), "p_name"))
    lines = F.array(F.lit("first line"), F.when(F.col("p_type") == "SMALL", F.concat(F.lit("code HRS-"), F.col("p_partkey") + 100)).otherwise(F.lit("none")))
    found = F.when(F.col("p_size") > 30, F.concat(F.lit("has imp-"), "p_size", F.lit(" in it"))).when(F.col("p_size") > 20, F.concat(F.lit("杂质: X"), "p_size", F.lit("，其他"))).otherwise(F.lit("pure"))
    style = F.when(F.col("p_size") > 40, F.concat(F.lit("Heading "), F.col("p_size") % 10)).when(F.col("p_size") > 30, F.concat(F.lit("标题 "), F.col("p_size") % 10)).when(F.col("p_size") == 7, F.lit("Title"))
    version = F.when(F.col("p_size") > 25, F.concat(F.lit("v"), "p_size")).otherwise(F.concat(F.lit("1."), "p_size"))
    return p.select(
        "p_partkey",
        T.drug_code(title, lines, r"[A-Z]{2,4}-[0-9]{3,}").alias("code"),  # these codes are keys, of as many digits as the table is large
        T.impurity(found).alias("impurity"),
        T.subclass_of(F.col("p_name"), [("ring", "Ring"), ("green", "Green"), ("widget", "Widget")]).alias("subclass"),
        T.first_alternative(F.concat("p_type", F.lit(" / "), "p_name")).alias("first"),
        T.next_version(version).alias("version"),
        T.heading_level(style, F.col("p_size")).alias("level"),
    )


O_CODES = """
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN concat('AB-', p_partkey + 100) WHEN 'SMALL' THEN concat('HRS-', p_partkey + 100) ELSE concat('Report on ', p_name) END AS code,
  CASE WHEN p_size > 30 THEN concat('imp-', p_size) WHEN p_size > 20 THEN concat('X', p_size) END AS impurity,
  CASE WHEN contains(p_name, 'ring') THEN 'Ring' WHEN contains(p_name, 'green') THEN 'Green' WHEN contains(p_name, 'widget') THEN 'Widget' END AS subclass, p_type AS first,
  CASE WHEN p_size > 25 THEN concat('v', p_size + 1) ELSE concat('1.', p_size, '.1') END AS version,
  CAST(CASE WHEN p_size > 30 THEN greatest(1, least(6, p_size % 10)) WHEN p_size = 7 THEN 1 WHEN p_size >= 20 THEN 1 WHEN p_size >= 16 THEN 2 WHEN p_size >= 14 THEN 3 ELSE 0 END AS INTEGER) AS level FROM part
"""


def step_equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of part names are steps; brands are the equipment of the parts whose name starts with one."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("cell"), F.col("p_brand").alias("code"))
    steps = p.select(F.substring_index("cell", " ", 1).alias("step")).unionByName(p.select(F.col("cell").alias("step")).filter("length(cell) < 10")).distinct()
    return prefix_matched(steps, p)


O_STEPS = """
WITH s AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS step FROM part UNION SELECT p_name FROM part WHERE length(p_name) < 10)
SELECT DISTINCT step, p_brand AS code FROM s JOIN part ON starts_with(replace(p_name, ' ', ''), replace(step, ' ', ''))
"""


def evidence_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last forty characters of each document looked for among its lines, a short line being the heading of those after it."""
    d = _docs(spark, sf_dir).withColumn("lines", F.split("text", "\n"))
    head = lambda x: (F.char_length(x) > 0) & (F.char_length(x) < 30)
    blocks = F.transform("lines", lambda x: F.struct(x.alias("text"), F.when(head(x), x).alias("heading")))
    return d.select("doc_id", F.sha2(F.coalesce(T.anchor(F.substring("text", -40, 40), blocks), F.lit("none")), 256).alias("anchor_sha256"))


O_ANCHOR = """
WITH d AS (SELECT doc_id, trim(CASE WHEN length(text) <= 40 THEN text ELSE right(text, 40) END, ' ') AS e, string_split(text, chr(10)) AS ls FROM documents),
b AS (SELECT doc_id, e, list_filter(ls, lambda x: contains(x, e))[1] AS fore, list_filter(ls, lambda x: length(x) >= 6 AND contains(e, x))[1] AS back FROM d), c AS (SELECT doc_id, e, coalesce(fore, back) AS t FROM b)
SELECT doc_id, sha256(coalesce(CASE WHEN e <> '' THEN CASE WHEN length(t) BETWEEN 1 AND 29 THEN concat('§ ', t) ELSE t END END, 'none')) AS anchor_sha256 FROM c
"""


def document_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prompt holds of each document, and what it is classified by: the caps are the feature."""
    d = _docs(spark, sf_dir).withColumn("lines", F.split("text", "\n"))
    heads = F.filter("lines", lambda x: (F.char_length(x) > 0) & (F.char_length(x) < 30))
    rest = F.filter("lines", lambda x: F.char_length(x) >= 30)
    rows = F.filter("lines", lambda x: F.contains(x, F.lit("|")))
    return d.select("doc_id", F.sha2(T.prompt_text(heads, rest, rows), 256).alias("prompt_sha256"), F.char_length(T.haystack(F.get("lines", F.lit(0)), heads, rest)).alias("n_haystack"))


O_PROMPTS = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
h AS (SELECT doc_id, ls[1] AS t, list_filter(ls, lambda x: length(x) BETWEEN 1 AND 29) AS a, list_filter(ls, lambda x: length(x) >= 30) AS b, list_filter(ls, lambda x: contains(x, '|'))[1:10] AS r FROM d),
p AS (SELECT doc_id, array_to_string(list_concat(a, b, r), chr(10)) AS w, length(array_to_string(list_concat([t], a, b[1:12]), chr(10))) AS n FROM h)
SELECT doc_id, sha256(CASE WHEN length(w) > 12000 THEN concat(substr(w, 1, 12000), chr(10), '[…]') ELSE w END) AS prompt_sha256, CAST(n AS INTEGER) AS n_haystack FROM p
"""


def two_pass_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders typed by discount as their own score and by tax as their context's; part names are the spans."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    d = table(spark, sf_dir, "lineitem").select("l_partkey", "l_discount", "l_tax").join(p, "l_partkey")
    span = F.when(F.col("p_brand") == "Brand#11", F.substring("p_name", 1, 3)).otherwise(F.col("p_name"))
    raw = F.struct(F.col("p_brand").alias("cls"), (F.col("l_discount") * 10).alias("score"))
    context = F.struct(F.col("p_type").alias("cls"), (F.col("l_tax") * 10).alias("score"))
    return d.select(two_pass(raw, context, span).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


O_TYPING = "SELECT CASE WHEN l_discount * 10 >= 0.85 THEN p_brand WHEN p_brand <> 'Brand#11' AND length(p_name) > 4 AND l_tax * 10 >= 0.5 THEN p_type END AS cls, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"


def candidate_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates: those of rich customers are aligned, urgent ones come of documents, whose phase is the nation's region."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey"), "o_custkey")
    src = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit(FACTS), "c_nationkey")).otherwise("file")
    props = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("hasDevelopmentPhase"), F.lit("own"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    c = o.select(F.col("o_orderkey").alias("id"), F.lit("http://x/Order").alias("target"), F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("c"), "o_custkey")).alias("aligned"), src.alias("source"), props.alias("props"))
    phases = table(spark, sf_dir, "nation").select(F.concat(F.lit(FACTS), "n_nationkey").alias("source"), F.concat(F.lit("phase"), "n_regionkey").alias("phase"))
    out = committed(c, phases)
    return out.select("id", "iri", F.element_at("props", F.lit("hasDevelopmentPhase")).alias("phase"), F.element_at("props", F.lit("extractedFrom")).alias("origin"))


O_COMMIT = """
SELECT o_orderkey AS id, CASE WHEN c_acctbal > 5000 THEN concat('c', o_custkey) ELSE concat('http://x/Order_', substr(sha256(o_orderkey::VARCHAR), 1, 8)) END AS iri,
  CASE WHEN o_orderstatus = 'F' THEN 'own' WHEN o_orderpriority = '1-URGENT' THEN concat('phase', n_regionkey) END AS phase, CASE WHEN o_orderpriority = '1-URGENT' THEN concat('http://x/facts#', c_nationkey) END AS origin
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
"""


def candidate_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidates: those in debt merge into the first of their nation, the richest split in two."""
    s = table(spark, sf_dir, "supplier")
    c = s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").alias("target"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("merged_into"))
    first = s.filter("s_acctbal >= 0").groupBy("s_nationkey").agg(F.min("s_suppkey").cast("string").alias("into"))
    merges = s.filter("s_acctbal < 0").join(first, "s_nationkey").select(F.col("s_suppkey").cast("string").alias("id"), "into")
    splits = s.filter("s_acctbal > 9000").select(F.col("s_suppkey").cast("string").alias("id"), F.array("s_name", F.lit("rest")).alias("parts"))
    return reviewed(c, merges, splits)


O_REVIEW = """
WITH f AS (SELECT s_nationkey AS k, min(s_suppkey)::VARCHAR AS i FROM supplier WHERE s_acctbal >= 0 GROUP BY 1)
SELECT s_suppkey::VARCHAR AS id, s_nationkey AS target, CASE WHEN s_acctbal < 0 AND i IS NOT NULL THEN 'merged' WHEN s_acctbal > 9000 THEN 'split' ELSE 'pending' END AS status, CASE WHEN s_acctbal < 0 THEN i END AS merged_into FROM supplier LEFT JOIN f ON k = s_nationkey
UNION ALL SELECT concat(s_suppkey, '/', j), s_nationkey, 'pending', NULL FROM supplier, (VALUES (0), (1)) v(j) WHERE s_acctbal > 9000
"""


def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers grouped by nation and segment, those in debt without a key."""
    c = table(spark, sf_dir, "customer")
    key = F.when(F.col("c_acctbal") >= 0, F.concat_ws("|", "c_nationkey", "c_mktsegment"))
    return grouped(c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("pos"), key.alias("key"), F.round("c_acctbal", -3).alias("score")), "key")


O_GROUPS = """
SELECT key, count(*) AS n, arg_max(c_custkey, (s, -c_custkey)) AS canonical FROM (SELECT *, concat(c_nationkey, '|', c_mktsegment) AS key, round(c_acctbal, -3) AS s FROM customer WHERE c_acctbal >= 0) GROUP BY key
UNION ALL SELECT NULL, 1, c_custkey FROM customer WHERE c_acctbal < 0
"""


def staged_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts through all stages: types that a bulky order line names are relevant, small parts exist already."""
    p = table(spark, sf_dir, "part")
    a = F.create_map(F.lit("brand"), F.when(F.col("p_size") > 20, F.col("p_brand")))
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.round("p_retailprice", -1).alias("score"), a.alias("a"), F.when(F.col("p_size") > 10, F.create_map(F.lit("brand"), F.lit("text"), F.lit("colour"), F.substring_index("p_name", " ", 1))).otherwise(F.from_json(F.lit("{}"), "map<string,string>")).alias("b"))
    mentions = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).join(p.select("p_partkey", F.col("p_type").alias("kind")), "p_partkey").filter("kind <> 'PROMO'")
    return staged(rows, mentions, p.filter("p_size < 15").select(F.col("p_partkey").alias("id"), F.concat(F.lit("iri"), "p_partkey").alias("iri")))


O_STAGED = """
WITH m AS (SELECT DISTINCT p_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49 AND p_type <> 'PROMO'),
d AS (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN concat(p_name, '|', p_type) ELSE p_partkey::VARCHAR END AS key, CASE WHEN p_size < 15 THEN concat('iri', p_partkey) END AS iri, 2 AS n_props, round(p_retailprice, -1) AS s FROM part WHERE p_size > 10 AND p_type IN (SELECT p_type FROM m))
SELECT id, key, iri, CAST(n_props AS INTEGER) AS n_props, row_number() OVER (PARTITION BY key ORDER BY s DESC, id) = 1 AS canonical FROM d
"""


def label_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of each user's events by type: one is told as such, several as a list."""
    e = table(spark, sf_dir, "events").filter("value > 150").select("user_id", F.col("event_type").alias("label"), F.col("event_id").alias("pos"), F.get_json_object("props", "$.k").alias("value"))
    return folded_labels(e, "user_id")


O_FOLDING = """
WITH e AS (SELECT user_id, event_type AS label, list('"' || json_extract_string(props, '$.k') || '"' ORDER BY event_id) AS v FROM events WHERE value > 150 GROUP BY 1, 2)
SELECT user_id, label, CASE WHEN len(v) = 1 THEN concat('{"v":', v[1], '}') ELSE concat('{"v":[', array_to_string(v, ','), ']}') END AS value FROM e
"""


def header_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' customers as tables with names and segments for headers: the first that holds both words, and the first filled cell like a name."""
    c = table(spark, sf_dir, "customer")
    hit = T.table_found(F.array("c_name", "c_mktsegment"), ["1", "BUILD"])
    cell = T.cell_like({"c_name": F.when(F.col("c_acctbal") > 0, F.col("c_name")), "c_mktsegment": F.col("c_mktsegment")}, ["name", "seg"])
    return c.filter(hit).groupBy("c_nationkey").agg(F.min(F.struct("c_custkey", cell.alias("cell"))).alias("x")).select("c_nationkey", "x.c_custkey", "x.cell")


O_HEADERS = "SELECT c_nationkey, min(c_custkey) AS c_custkey, arg_min(CASE WHEN c_acctbal > 0 THEN c_name ELSE c_mktsegment END, c_custkey) AS cell FROM customer WHERE contains(c_name, '1') AND contains(c_mktsegment, 'BUILD') GROUP BY 1"

_ALL = (
    (relation_edges, O_RELATIONS), (token_offsets, O_TOKENS), (span_gate, O_SPANS), (text_codes, O_CODES), (step_equipment, O_STEPS), (evidence_anchor, O_ANCHOR), (document_prompts, O_PROMPTS), (two_pass_typing, O_TYPING),
    (candidate_commit, O_COMMIT), (candidate_review, O_REVIEW), (candidate_groups, O_GROUPS), (staged_extraction, O_STAGED), (label_folding, O_FOLDING), (header_lookup, O_HEADERS),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: o for f, o in _ALL}
