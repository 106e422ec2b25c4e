"""Reads over an ontology kept as tables: classes, properties with domain and range, labels, individuals, and their seeds.

The demonstration's ontology is made of the driver's tables: regions and nations are classes of one module, the market
segments of each nation classes of another, below their nation; nations trade with nations, segments sell into regions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.operators.graph import ancestors
from quernstone.sources.shared import kept
from quernstone.sources.tables import table

#: Hops of a relation schema, seed labels at most, and what each kind of restriction must have.
HOPS, SEEDS = 4, 40
RESTRICTIONS = {
    ("some", "only"): ("property_iri", "filler_iri"),
    ("exactly", "min", "max"): ("property_iri", "cardinality"),
    ("disjoint", "equivalent"): ("filler_iri",),
}


def labelled(labels: DataFrame) -> DataFrame:
    """(iri, label_zh, label_en) from (iri, lang, value, pos): the first of each language; an untagged label stands for English if there is none."""
    first = lambda lang: F.min(F.when(F.col("lang") == lang if lang else F.col("lang").isNull(), F.struct("pos", "value")))["value"]
    return labels.groupBy("iri").agg(first("zh").alias("label_zh"), F.coalesce(first("en"), first("")).alias("label_en"))


def roots(classes: DataFrame) -> DataFrame:
    """Classes (iri, module, parent) with no parent in their own module."""
    known = classes.select(F.col("module"), F.col("iri").alias("parent")).distinct()
    return classes.join(known, ["module", "parent"], "left_anti").select("iri", "module").distinct()


def class_index(classes: DataFrame) -> DataFrame:
    """(iri, module, depth): every class with its distance from the topmost class above it."""
    edges = classes.filter("parent IS NOT NULL").join(classes.select(F.col("iri").alias("parent")).distinct(), "parent", "left_semi").select(F.col("iri").alias("child"), "parent")
    depth = ancestors(edges).groupBy("node").agg(F.max("depth").alias("depth"))
    return classes.select("iri", "module").distinct().join(depth.withColumnRenamed("node", "iri"), "iri", "left").select("iri", "module", F.coalesce("depth", F.lit(0)).alias("depth"))


def relation_schema(root: str, classes: DataFrame, props: DataFrame, max_hops: int = HOPS) -> DataFrame:
    """(hop, prop, domain, range) reached from a class by (prop, domain, range), each range class once, subclasses of a range going on.

    Of several ways to a range in one hop the first by (domain, prop) counts; of ranges of one hop that lie below each
    other, the upper one.
    """
    spark = classes.sparkSession
    below = kept(ancestors(classes.filter("parent IS NOT NULL").select(F.col("iri").alias("child"), "parent")).select("node", "ancestor"), "below")
    front = spark.createDataFrame([(root,)], "domain string")
    seen = spark.createDataFrame([], "range string")
    out = []
    for hop in range(1, max_hops + 1):
        met = props.join(front, "domain").join(seen, "range", "left_anti").groupBy("range").agg(F.min(F.struct("domain", "prop")).alias("x")).select("range", "x.domain", "x.prop")
        met = kept(met, "met")
        under = met.select(F.col("range").alias("ancestor")).join(below, "ancestor").select(F.col("node").alias("range")).distinct()
        new = kept(met.join(under, "range", "left_anti").select(F.lit(hop).alias("hop"), "prop", "domain", "range"), "schema")
        if new.isEmpty():
            break
        out.append(new)
        subs = new.select(F.col("range").alias("ancestor")).join(below, "ancestor").select(F.col("node").alias("range"))
        front = kept(new.select("range").unionByName(subs).distinct(), "front")
        seen, front = seen.unionByName(front), front.withColumnRenamed("range", "domain")
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "hop int, prop string, domain string, range string")


def relevant_classes(schema: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes that a schema names, as domain, range or subclass of a range."""
    below = ancestors(classes.filter("parent IS NOT NULL").select(F.col("iri").alias("child"), "parent"))
    subs = schema.select(F.col("range").alias("ancestor")).join(below, "ancestor").select(F.col("node").alias("iri"))
    return schema.select(F.explode(F.array("domain", "range")).alias("iri")).unionByName(subs).distinct()


def nearest_upper(classes: DataFrame, upper: DataFrame) -> DataFrame:
    """(iri, upper, distance): the nearest ancestor that is an upper class (upper), the first by name at one distance."""
    a = ancestors(classes.filter("parent IS NOT NULL").select(F.col("iri").alias("child"), "parent"))
    hit = a.join(upper.select(F.col("upper").alias("ancestor")), "ancestor", "left_semi")
    return hit.groupBy(F.col("node").alias("iri")).agg(F.min(F.struct("depth", "ancestor")).alias("x")).select("iri", F.col("x.ancestor").alias("upper"), F.col("x.depth").alias("distance"))


def inherited_properties(classes: DataFrame, domains: DataFrame) -> DataFrame:
    """(iri, prop, inherited, origin): properties (prop, class) of a class, its own and those of its ancestors, each from the nearest."""
    above = ancestors(classes.filter("parent IS NOT NULL").select(F.col("iri").alias("child"), "parent")).select(F.col("node").alias("iri"), F.col("ancestor").alias("class"), "depth")
    own = classes.select("iri", F.col("iri").alias("class"), F.lit(0).alias("depth")).distinct()
    all_ = own.unionByName(above).join(domains, "class")
    return all_.groupBy("iri", "prop").agg(F.min(F.struct("depth", "class")).alias("x")).select("iri", "prop", (F.col("x.depth") > 0).alias("inherited"), F.col("x.class").alias("origin"))


def ego_graph(individuals: DataFrame) -> DataFrame:
    """(source, prop, target): edges by object properties (iri, prop, values) with a single value; a list makes no edge."""
    return individuals.filter("size(values) = 1").select(F.col("iri").alias("source"), "prop", F.col("values")[0].alias("target"))


def neighbours(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the labels of their targets, where there are any."""
    return edges.join(labels.select(F.col("iri").alias("target"), "label"), "target", "left")


def unwrapped(values: Column) -> Column:
    """Values of a property as JSON: the value itself if it is the only one."""
    return F.when(F.size(values) == 1, F.to_json(F.struct(values[0].alias("v")))).otherwise(F.to_json(F.struct(values.alias("v"))))


def seed_labels(classes: DataFrame, props: DataFrame, cap: int = SEEDS) -> DataFrame:
    """Classes to start from: those that are domains, then roots; by name, each once, so many at most (a bounded report)."""
    d = props.select(F.col("domain").alias("iri"), F.lit(0).alias("rank"))
    r = roots(classes).select("iri", F.lit(1).alias("rank"))
    return d.unionByName(r).groupBy("iri").agg(F.min("rank").alias("rank")).orderBy("rank", "iri").limit(cap)


def resolved(names: DataFrame, known: DataFrame, namespace: str) -> DataFrame:
    """names (name) with their IRIs (name, iri; the first counts), or the namespace and the name."""
    first = known.groupBy("name").agg(F.min(F.struct("pos", "iri")).alias("x")).select("name", F.col("x.iri").alias("_iri"))
    return names.join(first, "name", "left").select("name", F.coalesce("_iri", F.concat(F.lit(namespace), "name")).alias("iri"))


def restriction_fault(kind: Column) -> Column:
    """What a restriction of a kind lacks: the first empty column that it must have; NULL if it is whole."""
    cases = [F.when(kind.isin(*kinds), F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needs])) for kinds, needs in RESTRICTIONS.items()]
    return F.coalesce(*cases)


def seeded_classes(triples: DataFrame, managed: str) -> DataFrame:
    """(iri, parent): the T-Box's classes from triples (s, p, o, pos): typed as class, in the managed namespace; of superclasses the first named managed one."""
    cls = triples.filter((F.col("p") == "type") & (F.col("o") == "Class") & F.startswith("s", F.lit(managed))).select(F.col("s").alias("iri")).distinct()
    sup = triples.filter((F.col("p") == "subClassOf") & F.startswith("o", F.lit(managed))).groupBy(F.col("s").alias("iri")).agg(F.min(F.struct("pos", "o")).alias("x")).select("iri", F.col("x.o").alias("parent"))
    return cls.join(sup, "iri", "left")


def inverses(props: DataFrame) -> DataFrame:
    """props (prop, inverse) with the inverse told from the other side as well: a second pass over the same table."""
    other = props.filter("inverse IS NOT NULL").groupBy(F.col("inverse").alias("prop")).agg(F.min("prop").alias("_other"))
    return props.join(other, "prop", "left").select("prop", F.coalesce("inverse", "_other").alias("inverse"))


def world(modules: list[DataFrame | None]) -> DataFrame:
    """Triples of modules in order of dependency, the first module that holds one named; a module that can't be read (None) is left out."""
    parts = [m.select("s", "p", "o", F.lit(i).alias("module")) for i, m in enumerate(modules) if m is not None]
    return reduce(DataFrame.unionByName, parts).groupBy("s", "p", "o").agg(F.min("module").alias("module"))


def world_changed(triples: DataFrame, upserts: DataFrame, deleted: DataFrame) -> DataFrame:
    """Triples after deletions (s), as subject or object, and upserts: what an upserted subject had by the same predicates goes."""
    gone = deleted.select("s").distinct()
    stay = triples.join(gone, "s", "left_anti").join(gone.withColumnRenamed("s", "o"), "o", "left_anti").join(upserts.select("s", "p").distinct(), ["s", "p"], "left_anti")
    return stay.select("s", "p", "o").unionByName(upserts.select("s", "p", "o")).distinct()


# the demonstration's ontology


def classes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("iri"), F.lit("geo").alias("module"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("iri"), F.lit("geo").alias("module"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    c = c.select(F.concat(F.lit("n"), "c_nationkey", F.lit("/"), "c_mktsegment").alias("iri"), F.lit("market").alias("module"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return kept(r.unionByName(n).unionByName(c), "classes")


def props_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    trades = n.select(F.concat(F.lit("trades"), "n_nationkey").alias("prop"), F.concat(F.lit("n"), "n_nationkey").alias("domain"), F.concat(F.lit("n"), (F.col("n_nationkey") * 7 + 3) % 25).alias("range"))
    sells = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct().select(F.concat(F.lit("sells"), "c_nationkey", "c_mktsegment").alias("prop"), F.concat(F.lit("n"), "c_nationkey", F.lit("/"), "c_mktsegment").alias("domain"), F.concat(F.lit("r"), F.col("c_nationkey") % 5).alias("range"))
    return trades.unionByName(sells)


_ONTOLOGY = """k AS (SELECT concat('r', r_regionkey) AS iri, 'geo' AS module, NULL AS parent FROM region UNION ALL SELECT concat('n', n_nationkey), 'geo', concat('r', n_regionkey) FROM nation
  UNION ALL SELECT DISTINCT concat('n', c_nationkey, '/', c_mktsegment), 'market', concat('n', c_nationkey) FROM customer),
pr AS (SELECT concat('trades', n_nationkey) AS prop, concat('n', n_nationkey) AS domain, concat('n', (n_nationkey * 7 + 3) % 25) AS range FROM nation
  UNION ALL SELECT DISTINCT concat('sells', c_nationkey, c_mktsegment), concat('n', c_nationkey, '/', c_mktsegment), concat('r', c_nationkey % 5) FROM customer),
up AS (SELECT iri AS node, parent AS ancestor, 1 AS depth FROM k WHERE parent IS NOT NULL UNION SELECT up.node, k.parent, up.depth + 1 FROM up JOIN k ON k.iri = up.ancestor WHERE k.parent IS NOT NULL)"""
_W = f"WITH RECURSIVE {_ONTOLOGY}"


def _hop_sql(n: int) -> str:
    parts, seen, front = [], "SELECT NULL::VARCHAR AS iri WHERE false", "SELECT 'n0' AS iri"
    for i in range(1, n + 1):
        parts.append(f"m{i} AS (SELECT range, min((domain, prop)) AS x FROM pr WHERE domain IN ({front}) AND range NOT IN ({seen}) GROUP BY range)")
        parts.append(f"s{i} AS (SELECT {i} AS hop, x[2] AS prop, x[1] AS domain, range FROM m{i} WHERE range NOT IN (SELECT node FROM up JOIN m{i} ON m{i}.range = ancestor))")
        parts.append(f"f{i} AS (SELECT range AS iri FROM s{i} UNION SELECT node FROM up JOIN s{i} ON s{i}.range = ancestor)")
        front, seen = f"SELECT iri FROM f{i}", " UNION ALL ".join(f"SELECT iri FROM f{j}" for j in range(1, i + 1))
    return ", ".join(parts)


_SCHEMA = f"{_hop_sql(HOPS)}, sc AS ({' UNION ALL '.join(f'SELECT * FROM s{i}' for i in range(1, HOPS + 1))})"


def ontology_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roots(classes_of(spark, sf_dir))


O_ROOTS = f"{_W} SELECT DISTINCT iri, module FROM k WHERE NOT EXISTS (SELECT 1 FROM k p WHERE p.module = k.module AND p.iri = k.parent)"


def ontology_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_index(classes_of(spark, sf_dir))


O_INDEX = f"{_W} SELECT iri, module, CAST(coalesce((SELECT max(depth) FROM up WHERE node = iri), 0) AS INTEGER) AS depth FROM k"


def ontology_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and individuals of each module: customers are individuals of their segment, suppliers of their nation."""
    c = classes_of(spark, sf_dir).groupBy("module").agg(F.count_distinct("iri").alias("n_classes"))
    i = table(spark, sf_dir, "customer").select(F.lit("market").alias("module")).unionByName(table(spark, sf_dir, "supplier").select(F.lit("geo").alias("module")))
    return c.join(i.groupBy("module").agg(F.count(F.lit(1)).alias("n_individuals")), "module", "left")


O_MODULES = f"{_W} SELECT module, count(DISTINCT iri) AS n_classes, CASE module WHEN 'market' THEN (SELECT count(*) FROM customer) ELSE (SELECT count(*) FROM supplier) END AS n_individuals FROM k GROUP BY module"


def ontology_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What relates to the first nation within four hops."""
    return relation_schema("n0", classes_of(spark, sf_dir), props_of(spark, sf_dir))


O_SCHEMA = f"{_W}, {_SCHEMA} SELECT CAST(hop AS INTEGER) AS hop, prop, domain, range FROM sc"


def ontology_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classes_of(spark, sf_dir)
    return relevant_classes(relation_schema("n0", c, props_of(spark, sf_dir)), c)


O_RELEVANT = f"{_W}, {_SCHEMA} SELECT domain AS iri FROM sc UNION SELECT range FROM sc UNION SELECT node FROM up JOIN sc ON range = ancestor"


def ontology_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest upper class: regions, and nations with suppliers in debt."""
    debt = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("n"), "s_nationkey").alias("upper"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("upper"))
    return nearest_upper(classes_of(spark, sf_dir), debt.unionByName(r).distinct())


O_UPPER = f"{_W} SELECT node AS iri, ancestor AS upper, CAST(depth AS INTEGER) AS distance FROM up WHERE ancestor LIKE 'r%' OR ancestor IN (SELECT concat('n', s_nationkey) FROM supplier WHERE s_acctbal < 0) QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth, ancestor) = 1"


def ontology_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of every class with those it inherits: regions have an area, nations a code, and nations and segments what they trade in."""
    p = props_of(spark, sf_dir).select("prop", F.col("domain").alias("class"))
    area = table(spark, sf_dir, "region").select(F.lit("area").alias("prop"), F.concat(F.lit("r"), "r_regionkey").alias("class"))
    code = table(spark, sf_dir, "nation").select(F.explode(F.array(F.lit("code"), F.lit("area"))).alias("prop"), F.concat(F.lit("n"), "n_nationkey").alias("class"), "n_regionkey").filter("prop = 'code' OR n_regionkey = 1").drop("n_regionkey")
    return inherited_properties(classes_of(spark, sf_dir), p.unionByName(area).unionByName(code))


O_PROPERTIES = f"""{_W}, dm AS (SELECT prop, domain AS class FROM pr UNION ALL SELECT 'area', concat('r', r_regionkey) FROM region UNION ALL SELECT 'code', concat('n', n_nationkey) FROM nation UNION ALL SELECT 'area', concat('n', n_nationkey) FROM nation WHERE n_regionkey = 1),
al AS (SELECT iri, iri AS class, 0 AS depth FROM k UNION SELECT node, ancestor, depth FROM up)
SELECT iri, prop, depth > 0 AS inherited, class AS origin FROM al JOIN dm USING (class) QUALIFY row_number() OVER (PARTITION BY iri, prop ORDER BY depth, class) = 1"""


def ontology_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as individuals: one supplier is an edge to it, with its name; several are a list and none."""
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("iri")).agg(F.collect_set(F.concat(F.lit("s"), "l_suppkey")).alias("values")).withColumn("prop", F.lit("from"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("iri"), F.col("s_name").alias("label"))
    return neighbours(ego_graph(i), s)


O_EGO = "WITH e AS (SELECT l_orderkey::VARCHAR AS source, min(l_suppkey) AS k FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1) SELECT source, 'from' AS prop, concat('s', k) AS target, s_name AS label FROM e LEFT JOIN supplier ON s_suppkey = k AND s_acctbal > 0"


def ontology_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the sorted parts of their lines, unwrapped where there is one."""
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("v"))
    return i.select("l_orderkey", unwrapped(F.col("v")).alias("info"))


O_INDIVIDUALS = """SELECT l_orderkey, CASE WHEN len(v) = 1 THEN concat('{"v":', v[1], '}') ELSE concat('{"v":[', array_to_string(v, ','), ']}') END AS info FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS v FROM lineitem GROUP BY 1)"""


def ontology_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of customers by segment: one segment's are Chinese, one's English, one's have no language, the rest both."""
    lang = F.when(F.col("c_mktsegment") == "BUILDING", "zh").when(F.col("c_mktsegment") == "FURNITURE", "en").when(F.col("c_mktsegment") == "HOUSEHOLD", None).otherwise("both")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("iri"), lang.alias("l"), F.col("c_name").alias("value"), F.col("c_custkey").alias("pos"))
    rows = c.select("iri", F.explode(F.when(F.col("l") == "both", F.array(F.lit("zh"), F.lit("en"))).otherwise(F.array("l"))).alias("lang"), "value", "pos")
    return labelled(rows)


O_LABELS = """WITH c AS (SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 'zh' WHEN 'FURNITURE' THEN 'en' WHEN 'HOUSEHOLD' THEN NULL ELSE 'both' END AS l FROM customer)
SELECT concat('n', c_nationkey) AS iri, arg_min(c_name, c_custkey) FILTER (l IN ('zh', 'both')) AS label_zh, coalesce(arg_min(c_name, c_custkey) FILTER (l IN ('en', 'both')), arg_min(c_name, c_custkey) FILTER (l IS NULL)) AS label_en FROM c GROUP BY 1"""


def ontology_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_labels(classes_of(spark, sf_dir), props_of(spark, sf_dir))


O_SEEDS = f"{_W} SELECT iri, CAST(min(rank) AS INTEGER) AS rank FROM (SELECT domain AS iri, 0 AS rank FROM pr UNION ALL SELECT iri, 1 FROM k WHERE NOT EXISTS (SELECT 1 FROM k p WHERE p.module = k.module AND p.iri = k.parent)) GROUP BY 1 ORDER BY 2, 1 LIMIT {SEEDS}"


def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names to the first brand that has them among the small parts, or a name in the namespace."""
    p = table(spark, sf_dir, "part")
    known = p.filter("p_size <= 10").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("iri"))
    return resolved(p.select(F.col("p_name").alias("name")).distinct(), known, "http://x/")


O_NAMES = "SELECT p_name AS name, coalesce(arg_min(p_brand, p_partkey) FILTER (p_size <= 10), concat('http://x/', p_name)) AS iri FROM part GROUP BY 1"


def restriction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as restrictions of the kind of their type; brands are properties, sizes cardinalities, long names fillers."""
    kinds = {"ECONOMY": "some", "STANDARD": "only", "PROMO": "exactly", "LARGE": "min", "MEDIUM": "max", "SMALL": "disjoint"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("p_type"))
    p = table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), F.when(F.length("p_brand") > 7, F.col("p_brand")).alias("property_iri"), F.when(F.length("p_name") > 10, F.col("p_name")).alias("filler_iri"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("cardinality"))
    return p.select("kind", restriction_fault(F.col("kind")).alias("fault")).groupBy("kind", "fault").agg(F.count(F.lit(1)).alias("n"))


O_RESTRICTIONS = """WITH p AS (SELECT CASE p_type WHEN 'ECONOMY' THEN 'some' WHEN 'STANDARD' THEN 'only' WHEN 'PROMO' THEN 'exactly' WHEN 'LARGE' THEN 'min' WHEN 'MEDIUM' THEN 'max' WHEN 'SMALL' THEN 'disjoint' END AS kind, length(p_brand) > 7 AS pr, length(p_name) > 10 AS fi, p_size > 10 AS ca FROM part)
SELECT kind, CASE WHEN kind <> 'disjoint' AND NOT pr THEN 'property_iri' WHEN kind IN ('some', 'only', 'disjoint') AND NOT fi THEN 'filler_iri' WHEN kind IN ('exactly', 'min', 'max') AND NOT ca THEN 'cardinality' END AS fault, count(*) AS n FROM p GROUP BY ALL"""


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and customers as classes: a customer is below each supplier's nation that shares its balance's sign, and below its own."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("m:n"), "n_nationkey").alias("s"), F.lit("type").alias("p"), F.lit("Class").alias("o"), F.lit(0).alias("pos"))
    c = table(spark, sf_dir, "customer")
    t = c.select(F.concat(F.when(F.col("c_acctbal") > 0, "m:c").otherwise("x:c"), "c_custkey").alias("s"), F.explode(F.array(F.struct(F.lit("type").alias("p"), F.lit("Class").alias("o"), F.lit(0).alias("pos")), F.struct(F.lit("subClassOf").alias("p"), F.concat(F.when(F.col("c_mktsegment") == "BUILDING", "x:n").otherwise("m:n"), "c_nationkey").alias("o"), F.lit(1).alias("pos")), F.struct(F.lit("subClassOf").alias("p"), F.concat(F.lit("m:n"), (F.col("c_nationkey") + 1) % 25).alias("o"), F.lit(2).alias("pos")))).alias("x")).select("s", "x.*")
    return n.unionByName(t)


def tbox_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_classes(_triples(spark, sf_dir), "m:")


O_TBOX = "SELECT concat('m:n', n_nationkey) AS iri, NULL AS parent FROM nation UNION ALL SELECT concat('m:c', c_custkey), concat('m:n', CASE WHEN c_mktsegment = 'BUILDING' THEN (c_nationkey + 1) % 25 ELSE c_nationkey END) FROM customer WHERE c_acctbal > 0"


def inverse_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as properties: those of the first regions name an inverse, the others learn of it."""
    n = table(spark, sf_dir, "nation")
    return inverses(n.select(F.concat(F.lit("p"), "n_nationkey").alias("prop"), F.when(F.col("n_regionkey") < 2, F.concat(F.lit("p"), (F.col("n_nationkey") + 2) % 25)).alias("inverse")))


O_INVERSE = """WITH p AS (SELECT concat('p', n_nationkey) AS prop, CASE WHEN n_regionkey < 2 THEN concat('p', (n_nationkey + 2) % 25) END AS inverse FROM nation)
SELECT prop, coalesce(inverse, (SELECT min(q.prop) FROM p q WHERE q.inverse = p.prop)) AS inverse FROM p"""


def world_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper module, a module that is missing, and a module that repeats some of the first; how many triples each brings."""
    t = _triples(spark, sf_dir)
    return world([t.filter("p = 'type'"), None, t]).groupBy("module", "p").agg(F.count(F.lit(1)).alias("n"))


O_WORLD = """SELECT CAST(0 AS INTEGER) AS module, 'type' AS p, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS n UNION ALL SELECT 2, 'subClassOf', 2 * count(*) FROM customer"""


def world_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the classes of one nation's name are deleted and building customers get a new superclass: triples by predicate."""
    t = _triples(spark, sf_dir)
    up = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 0").select(F.concat(F.lit("m:c"), "c_custkey").alias("s"), F.lit("subClassOf").alias("p"), F.lit("m:new").alias("o"))
    gone = table(spark, sf_dir, "nation").filter("n_regionkey = 2").select(F.concat(F.lit("m:n"), "n_nationkey").alias("s"))
    return world_changed(t, up, gone).groupBy("p", F.substring("o", 1, 3).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


O_UPDATE = """WITH g AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2), c AS (SELECT *, c_mktsegment = 'BUILDING' AS b, c_acctbal > 0 AS m FROM customer)
SELECT p, kind, count(*) AS n FROM (SELECT 'type' AS p, 'Cla' AS kind FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'type', 'Cla' FROM customer
  UNION ALL SELECT 'subClassOf', 'x:n' FROM c WHERE b AND NOT m UNION ALL SELECT 'subClassOf', 'm:n' FROM c WHERE NOT b AND c_nationkey NOT IN (SELECT k FROM g)
  UNION ALL SELECT 'subClassOf', 'm:n' FROM c WHERE NOT (b AND m) AND (c_nationkey + 1) % 25 NOT IN (SELECT k FROM g)
  UNION ALL SELECT 'subClassOf', 'm:n' FROM c WHERE b AND m) GROUP BY ALL"""

_ALL = (
    (ontology_roots, O_ROOTS), (ontology_index, O_INDEX), (ontology_modules, O_MODULES), (ontology_schema, O_SCHEMA), (ontology_relevant, O_RELEVANT), (ontology_upper, O_UPPER), (ontology_properties, O_PROPERTIES),
    (ontology_ego, O_EGO), (ontology_individuals, O_INDIVIDUALS), (ontology_labels, O_LABELS), (ontology_seeds, O_SEEDS), (name_resolution, O_NAMES), (restriction_check, O_RESTRICTIONS), (tbox_seed, O_TBOX),
    (inverse_properties, O_INVERSE), (world_load, O_WORLD), (world_update, O_UPDATE),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: o for f, o in _ALL}
