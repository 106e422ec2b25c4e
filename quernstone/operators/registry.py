"""Rules of the small tables: what may be created, changed, published or deleted, each as a test beside the rows and a snapshot after it.

Every operator returns the whole table after a batch of requests, or the requests with the first fault of each; nothing is
updated in place. Of several requests for one key the first by `pos` counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions.ternary import holds
from quernstone.sources.tables import table

#: Data types of data properties, and groups of decision rules.
DATATYPES = ("string", "integer", "decimal", "boolean", "date", "dateTime", "anyURI")
RULE_GROUPS = ("equipment_dedication", "scenario_identification", "contamination_risk", "risk_assessment")


def firsts(requests: DataFrame, key: str) -> DataFrame:
    """The first request of each key, with `again` for the others."""
    return requests.withColumn("again", F.row_number().over(Window.partitionBy(key).orderBy("pos")) > 1)


def _known(requests: DataFrame, column: str, table_: DataFrame, key: str, flag: str, name: str) -> DataFrame:
    """requests with `name`: the flag of the row that a column refers to; NULL if there is none."""
    t = table_.select(F.col(key).alias(column), F.col(flag).alias(name)).dropDuplicates([column])
    return requests.join(t, column, "left")


def class_faults(requests: DataFrame, classes: DataFrame, managed: str) -> DataFrame:
    """(iri, fault) of requests for classes (iri, parent, pos) against classes (iri, enabled): namespace, unique IRI, a parent that exists and is another."""
    r = firsts(requests, "iri")
    r = _known(_known(r, "parent", classes, "iri", "enabled", "_p"), "iri", classes, "iri", "enabled", "_i")
    fault = (
        F.when(~F.startswith("iri", F.lit(managed)), "namespace")
        .when(F.col("_i").isNotNull() | F.col("again"), "exists")
        .when(F.col("parent") == F.col("iri"), "own parent")
        .when(F.col("parent").isNotNull() & F.col("_p").isNull(), "no parent")
    )
    return r.select("iri", "pos", fault.alias("fault"))


def link_faults(requests: DataFrame, classes: DataFrame) -> DataFrame:
    """(iri, fault) of requests for link types (iri, domain, range, low, high, inverse, pos): domain and range exist and are enabled, low ≤ high, the inverse is known."""
    r = _known(_known(firsts(requests, "iri"), "domain", classes, "iri", "enabled", "_d"), "range", classes, "iri", "enabled", "_r")
    known = requests.select(F.col("iri").alias("inverse"), F.lit(True).alias("_inv")).distinct()
    r = r.join(known, "inverse", "left")
    fault = (
        F.when(F.col("again"), "exists")
        .when(F.col("_d").isNull() | F.col("_r").isNull(), "no class")
        .when(~F.col("_d") | ~F.col("_r"), "disabled class")
        .when(F.col("low") > F.col("high"), "cardinality")
        .when(F.col("inverse").isNotNull() & F.col("_inv").isNull(), "no inverse")
    )
    return r.select("iri", "pos", fault.alias("fault"))


def property_faults(requests: DataFrame) -> DataFrame:
    """(iri, fault) of requests for data properties (iri, datatype, pos)."""
    return firsts(requests, "iri").select("iri", "pos", F.when(F.col("again"), "exists").when(~F.col("datatype").isin(*DATATYPES), "datatype").alias("fault"))


def rule_faults(requests: DataFrame, groups: tuple[str, ...] = RULE_GROUPS) -> DataFrame:
    """(key, fault) of requests for decision rules (key, rule_group, pos)."""
    return firsts(requests, "key").select("key", "pos", F.when(F.col("again"), "exists").when(~F.col("rule_group").isin(*groups), "group").alias("fault"))


def edited(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows after partial changes (first by pos): non-null fields win, and what was changed is a draft again."""
    first = changes.groupBy(key).agg(F.min(F.struct("pos", *columns)).alias("_c"))
    j = rows.join(first, key, "left")
    new = {c: F.coalesce(F.col(f"_c.{c}"), F.col(c)) for c in columns}
    return j.withColumns(new | {"status": F.when(F.col("_c").isNotNull(), "draft").otherwise(F.col("status"))}).drop("_c")


def published(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with `fault`: drafts among the keys are published, for a published one it is `published already`."""
    j = rows.join(keys.select(key, F.lit(True).alias("_ask")).distinct(), key, "left")
    ask = holds(F.col("_ask"))
    return j.withColumns({"fault": F.when(ask & (F.col("status") == "published"), "published already"), "status": F.when(ask, "published").otherwise(F.col("status"))}).drop("_ask")


def deleted(rows: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """rows (key, version, …) less those whose deletion names their version: compare, then delete."""
    return rows.join(requests.select(key, "version").distinct(), [key, "version"], "left_anti")


def started(jobs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Jobs after a start: only pending ones run; `refused` tells of the others that were asked."""
    j = jobs.join(keys.select(key, F.lit(True).alias("_ask")).distinct(), key, "left")
    ask = holds(F.col("_ask"))
    return j.withColumns({"refused": ask & (F.col("status") != "pending"), "status": F.when(ask & (F.col("status") == "pending"), "running").otherwise(F.col("status"))}).drop("_ask")


def revised(templates: DataFrame, edits: DataFrame) -> DataFrame:
    """Templates (name, version, pos, is_default, body) after edits (name, body): a new version row for each, which takes the default over from the last."""
    last = templates.groupBy("name").agg(F.max(F.struct("pos", "version", "is_default")).alias("x"))
    one = edits.groupBy("name").agg(F.min("body").alias("body"))
    new = one.join(last, "name").select("name", T.next_version(F.col("x.version")).alias("version"), (F.col("x.pos") + 1).alias("pos"), F.col("x.is_default").alias("is_default"), "body")
    old = templates.join(one.select("name", F.lit(True).alias("_new")), "name", "left").withColumn("is_default", F.col("is_default") & F.col("_new").isNull()).drop("_new")
    return old.unionByName(new)


def default_set(templates: DataFrame, name: str, version: str) -> DataFrame:
    """The named version is the default, and no other."""
    return templates.withColumn("is_default", (F.col("name") == name) & (F.col("version") == version))


def inserted(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows whose keys it doesn't hold, each once."""
    return base.unionByName(rows.dropDuplicates(keys).join(base, keys, "left_anti"))


def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key: a combined maximum, no sort."""
    rest = [c for c in rows.columns if c not in (key, at)]
    return rows.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("x")).select(key, "x.*")


# queries


def _nation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("m:n"), "n_nationkey").alias("iri"), (F.col("n_regionkey") != 3).alias("enabled"))


def class_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for classes below their nation: those in debt outside the namespace, some names twice, some for a nation that isn't there."""
    c = table(spark, sf_dir, "customer")
    iri = F.concat(F.when(F.col("c_acctbal") < 0, "x:").otherwise("m:"), F.substring("c_name", -2, 2), "c_mktsegment")
    parent = F.when(F.col("c_mktsegment") == "BUILDING", iri).otherwise(F.concat(F.lit("m:n"), F.col("c_nationkey") + F.when(F.col("c_mktsegment") == "MACHINERY", 20).otherwise(0)))
    out = class_faults(c.select(iri.alias("iri"), parent.alias("parent"), F.col("c_custkey").alias("pos")), _nation_classes(spark, sf_dir), "m:")
    return out.groupBy("fault").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


O_CLASSES = """
WITH r AS (SELECT c_custkey AS pos, c_acctbal < 0 AS x, concat(CASE WHEN c_acctbal < 0 THEN 'x:' ELSE 'm:' END, right(c_name, 2), c_mktsegment) AS iri, c_mktsegment AS seg, c_nationkey + CASE WHEN c_mktsegment = 'MACHINERY' THEN 20 ELSE 0 END AS p FROM customer),
f AS (SELECT pos, CASE WHEN x THEN 'namespace' WHEN row_number() OVER (PARTITION BY iri ORDER BY pos) > 1 THEN 'exists' WHEN seg = 'BUILDING' THEN 'own parent' WHEN p NOT IN (SELECT n_nationkey FROM nation) THEN 'no parent' END AS fault FROM r)
SELECT fault, count(*) AS n, min(pos) AS first FROM f GROUP BY fault
"""


def link_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers ask for links between nations: some disabled, some not there, some with bounds the wrong way round."""
    s = table(spark, sf_dir, "supplier")
    r = s.select(F.concat(F.lit("l"), "s_suppkey").alias("iri"), F.concat(F.lit("m:n"), "s_nationkey").alias("domain"), F.concat(F.lit("m:n"), F.col("s_nationkey") + 4).alias("range"), F.round(F.col("s_acctbal") / 1000).cast("int").alias("low"), F.lit(8).alias("high"), F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("l"), F.col("s_suppkey") + 3)).alias("inverse"), F.col("s_suppkey").alias("pos"))
    return link_faults(r, _nation_classes(spark, sf_dir)).select("iri", "fault")


O_LINKS = """
SELECT concat('l', s_suppkey) AS iri, CASE WHEN r.n_nationkey IS NULL THEN 'no class' WHEN d.n_regionkey = 3 OR r.n_regionkey = 3 THEN 'disabled class' WHEN CAST(round(s_acctbal / 1000) AS INTEGER) > 8 THEN 'cardinality'
  WHEN s_acctbal > 5000 AND s_suppkey + 3 NOT IN (SELECT s_suppkey FROM supplier) THEN 'no inverse' END AS fault
FROM supplier JOIN nation d ON d.n_nationkey = s_nationkey LEFT JOIN nation r ON r.n_nationkey = s_nationkey + 4
"""


def property_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ask for data properties and rules by name; types stand for data types and groups."""
    kind = {"ECONOMY": "string", "STANDARD": "integer", "PROMO": "date", "LARGE": "decimal"}
    group = {"ECONOMY": "equipment_dedication", "STANDARD": "scenario_identification", "SMALL": "risk_assessment"}
    of = lambda m: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("p_type")), F.lit("other"))
    p = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_name", "p_brand").alias("iri"), of(kind).alias("datatype"), of(group).alias("rule_group"), F.col("p_partkey").alias("pos"))
    a = property_faults(p).select("fault", F.lit("property").alias("what"))
    b = rule_faults(p.withColumnRenamed("iri", "key")).select("fault", F.lit("rule").alias("what"))
    return a.unionByName(b).groupBy("what", "fault").agg(F.count(F.lit(1)).alias("n"))


O_REQUESTS = """
WITH r AS (SELECT p_type, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) > 1 AS again FROM part)
SELECT 'property' AS what, CASE WHEN again THEN 'exists' WHEN p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO', 'LARGE') THEN 'datatype' END AS fault, count(*) AS n FROM r GROUP BY ALL
UNION ALL SELECT 'rule', CASE WHEN again THEN 'exists' WHEN p_type NOT IN ('ECONOMY', 'STANDARD', 'SMALL') THEN 'group' END, count(*) FROM r GROUP BY ALL
"""


def rule_editing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as rules: those of one region are edited, then those with money published, then some deleted by their version."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    rows = s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("label"), F.when(F.col("s_acctbal") > 4000, "published").otherwise("draft").alias("status"), F.col("s_nationkey").alias("version"))
    changes = s.filter("n_regionkey = 1").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_acctbal") > 2000, F.concat(F.lit("new "), "s_name")).alias("label"), F.lit(1).alias("pos"))
    out = published(edited(rows, changes, "key", ["label"]), s.filter("s_acctbal > 3000").select(F.col("s_suppkey").alias("key")), "key")
    return deleted(out, s.filter("s_acctbal < 1000").select(F.col("s_suppkey").alias("key"), F.lit(7).alias("version")), "key")


O_EDITING = """
WITH s AS (SELECT *, n_regionkey = 1 AS e FROM supplier JOIN nation ON n_nationkey = s_nationkey), t AS (SELECT *, CASE WHEN e THEN 'draft' WHEN s_acctbal > 4000 THEN 'published' ELSE 'draft' END AS st FROM s)
SELECT s_suppkey AS key, CASE WHEN e AND s_acctbal > 2000 THEN concat('new ', s_name) ELSE s_name END AS label, CASE WHEN s_acctbal > 3000 THEN 'published' ELSE st END AS status, s_nationkey AS version,
  CASE WHEN s_acctbal > 3000 AND st = 'published' THEN 'published already' END AS fault FROM t WHERE NOT (s_acctbal < 1000 AND s_nationkey = 7)
"""


def job_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: those of building customers are started."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"))
    keys = o.join(table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return started(o, keys, "o_orderkey").groupBy("status", "refused").agg(F.count(F.lit(1)).alias("n"))


O_JOBS = """
WITH j AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'done' END AS s, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS ask FROM orders)
SELECT CASE WHEN ask AND s = 'pending' THEN 'running' ELSE s END AS status, ask AND s <> 'pending' AS refused, count(*) AS n FROM j GROUP BY ALL
"""


def template_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as templates, some with a second version; those with suppliers in debt are edited."""
    n = table(spark, sf_dir, "nation")
    t = n.select(F.col("n_name").alias("name"), F.lit("v1").alias("version"), F.lit(1).alias("pos"), (F.col("n_nationkey") == 3).alias("is_default"), F.lit("a").alias("body"), "n_nationkey", "n_regionkey")
    second = t.filter("n_regionkey = 2").withColumns({"version": F.lit("draft"), "pos": F.lit(2), "is_default": F.lit(False)})
    base = t.unionByName(second).drop("n_nationkey", "n_regionkey")
    edits = table(spark, sf_dir, "supplier").filter("s_acctbal < 2000").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("body")).join(n, "n_nationkey").select(F.col("n_name").alias("name"), "body")
    return revised(base, edits)


O_VERSIONS = """
WITH b AS (SELECT n_name AS name, 'v1' AS version, 1 AS pos, n_nationkey = 3 AS is_default, 'a' AS body FROM nation UNION ALL SELECT n_name, 'draft', 2, false, 'a' FROM nation WHERE n_regionkey = 2),
e AS (SELECT n_name AS name, min(s_name) AS body FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal < 2000 GROUP BY 1), l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY name ORDER BY pos DESC) = 1)
SELECT name, version, pos, is_default AND name NOT IN (SELECT name FROM e) AS is_default, body FROM b
UNION ALL SELECT name, CASE WHEN l.version = 'v1' THEN 'v2' ELSE 'draft.1' END, l.pos + 1, l.is_default, e.body FROM e JOIN l USING (name)
"""


def slot_dismissals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dismissals of (order, part) by lines: those of returned lines are there already, all lines are asked for."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    base = line.filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey", F.lit("old").alias("kind")).distinct()
    out = inserted(base, line.select("l_orderkey", "l_partkey", F.lit("new").alias("kind")), ["l_orderkey", "l_partkey"])
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


O_SLOTS = """
WITH a AS (SELECT l_orderkey, l_partkey, bool_or(l_returnflag = 'R') AS old FROM lineitem GROUP BY 1, 2) SELECT CASE WHEN old THEN 'old' ELSE 'new' END AS kind, count(*) AS n FROM a GROUP BY 1
"""


def latest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each customer, as the newest report of its job."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return newest(o, "o_custkey", "o_orderdate").select("o_custkey", "o_orderkey", "o_orderstatus")


O_REPORTS = "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"

_ALL = (
    (class_requests, O_CLASSES), (link_requests, O_LINKS), (property_requests, O_REQUESTS), (rule_editing, O_EDITING), (job_start, O_JOBS), (template_versions, O_VERSIONS), (slot_dismissals, O_SLOTS),
    (latest_reports, O_REPORTS),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: o for f, o in _ALL}
