"""Listings of logs, actions and connectors, validation and states of releases, and what the rule layer reads of its tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import numeric
from quernstone.functions.ternary import holds
from quernstone.operators.lifecycle import TERMINAL, _states
from quernstone.plans.rules import dedication, highest, validate
from quernstone.sources.tables import table

#: Rows of a governance listing; the default interval of a connector in seconds, and what its timeout adds.
NEWEST, INTERVAL, GRACE = 500, 2, 3
#: Mappings that a class must have, unless others are named: its IRI in the own ontology and in the upper one.
MAPPINGS = ("own_iri", "bfo")
#: Legal steps of a release.
RELEASE_STEPS = {"submit": ("draft", "in_review"), "publish": ("in_review", "published"), "return": ("in_review", "draft")}


def audit_rows(log: DataFrame, **equal: object) -> DataFrame:
    """Rows of the chain (seq is set) with the given values; None asks for nothing."""
    out = log.filter("seq IS NOT NULL")
    return reduce(lambda d, kv: d if kv[1] is None else d.filter(F.col(kv[0]) == F.lit(kv[1])), equal.items(), out)


def newest_rows(log: DataFrame, at: list[str], n: int = NEWEST) -> DataFrame:
    """The last n rows, newest first: a top-k, no full sort."""
    return log.orderBy(*[F.desc(c) for c in at]).limit(n)


def open_actions(conclusions: DataFrame, actions: DataFrame) -> DataFrame:
    """Conclusions with their actions that are not ended."""
    return conclusions.join(actions.filter(~F.col("status").isin(*TERMINAL)).withColumnRenamed("conclusion_id", "id"), "id")


def polled(connectors: DataFrame) -> DataFrame:
    """Active connectors that are polled, with the kind that reads them (unknown ones as the default) and their timeout."""
    kind = F.when(F.lower("system_type") == "doc_repo", "doc_repo").otherwise("aps")
    due = connectors.filter((F.col("status") == "active") & (F.col("mode") == "poll"))
    return due.withColumns({"kind": kind, "timeout": F.coalesce(F.nullif("interval", F.lit(0)), F.lit(INTERVAL)) + GRACE})


def poll_runs(cursors: DataFrame, pulls: DataFrame, failures: DataFrame) -> DataFrame:
    """A run for each connector (connector, cursor): changes above its cursor and the new one; a failed pull (connector, status) keeps the cursor and stops no other."""
    new = pulls.join(cursors, "connector").filter("version > cursor").groupBy("connector").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("top"))
    j = cursors.join(new, "connector", "left").join(failures.select("connector", F.col("status").alias("_failed")), "connector", "left")
    ok = F.col("_failed").isNull()
    return j.select("connector", F.coalesce("_failed", F.lit("success")).alias("status"), F.col("cursor").alias("cursor_from"), F.when(ok, F.coalesce("top", "cursor")).alias("cursor_to"), F.when(ok, F.coalesce("n", F.lit(0))).otherwise(0).alias("n_changes"), F.when(ok, F.coalesce("top", "cursor")).otherwise(F.col("cursor")).alias("cursor"))


def scheduled(changes: DataFrame) -> DataFrame:
    """Changes of products as batches: id, name, and the equipment that they name."""
    ids = F.filter(F.split(F.coalesce(F.element_at("fields", F.lit("equipment_ids")), F.lit("")), ","), lambda x: x != "")
    return changes.filter("entity_type = 'product'").select(F.col("entity_id").alias("batch_id"), F.col("label").alias("product_name"), ids.alias("equipment_ids"))


def equipment_status(changes: DataFrame, ids: DataFrame) -> DataFrame:
    """The status of the given equipment (equipment_id) by its changes; idle if a change names none."""
    asked = changes.filter("entity_type = 'equipment'").join(ids.select(F.col("equipment_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    return asked.select(F.col("entity_id").alias("equipment_id"), F.coalesce(F.element_at("fields", F.lit("status")), F.lit("idle")).alias("status"))


def release_faults(classes: DataFrame, mappings: DataFrame, links: DataFrame, needed: tuple[str, ...] = MAPPINGS) -> DataFrame:
    """(code, entity, severity) of what stands against a release.

    classes (iri, parent, enabled), mappings (iri, mapping_type), links (iri, domain, range, low, high, enabled): enabled
    classes without a mapping that is asked for, alone in the tree, or below a disabled one; links to or from one, or
    with a lower bound above the upper.
    """
    on, off = classes.filter("enabled"), classes.filter("NOT enabled").select(F.col("iri").alias("_off"))
    row = lambda d, code, severity: d.select(F.lit(code).alias("code"), F.col("iri").alias("entity"), F.lit(severity).alias("severity"))
    have = mappings.filter(F.col("mapping_type").isin(*needed)).groupBy("iri").agg(F.count_distinct("mapping_type").alias("_n"))
    unmapped = on.join(have.filter(F.col("_n") == len(needed)), "iri", "left_anti")
    alone = on.filter("parent IS NULL").join(classes.select(F.col("parent").alias("iri")), "iri", "left_anti")
    below = on.join(off, F.col("parent") == F.col("_off"), "left_semi")
    live = links.filter("enabled")
    tied = live.join(off, F.col("domain") == F.col("_off"), "left_semi").unionByName(live.join(off, F.col("range") == F.col("_off"), "left_semi")).dropDuplicates(["iri"])
    parts = [row(unmapped, "missing_mapping", "blocking"), row(alone, "orphan_class", "warning"), row(below, "disabled_referenced", "blocking"), row(tied, "disabled_referenced", "blocking"), row(live.filter("low > high"), "cardinality_conflict", "blocking")]
    return reduce(DataFrame.unionByName, parts)


def released(releases: DataFrame, blocked: Column) -> DataFrame:
    """releases (status, step) after their steps: each from one state only, and neither submitted nor published while something blocks."""
    start = reduce(lambda c, kv: c.when(F.col("step") == kv[0], kv[1][0]), RELEASE_STEPS.items(), F.when(F.lit(False), ""))
    to = reduce(lambda c, kv: c.when(F.col("step") == kv[0], kv[1][1]), RELEASE_STEPS.items(), F.when(F.lit(False), ""))
    fault = F.when(start.isNull() | (F.col("status") != start), "state").when((F.col("step") != "return") & holds(blocked), "blocked")
    return releases.withColumns({"fault": fault, "status": F.when(fault.isNull(), to).otherwise(F.col("status"))})


def active(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Enabled rules, drafts and published alike, whose target class is there."""
    return rules.filter("enabled").join(classes.select(F.col("iri").alias("target")).distinct(), "target", "left_semi")


def injected(scalars: Column, relations: Column, post: Column) -> tuple[Column, Column]:
    """(scalars, relations) with post-conditions laid over: the right side wins among scalars; values like IRIs join the relation of their key, once."""
    over = F.map_concat(F.map_filter(scalars, lambda k, v: ~F.map_contains_key(post, k)), post)
    iris = F.map_filter(post, lambda k, v: F.contains(v, F.lit("/")) | F.contains(v, F.lit("#")))
    return over, F.map_zip_with(relations, iris, lambda k, a, b: F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.when(b.isNotNull(), F.array(b)).otherwise(F.array().cast("array<string>")))))


def references(pattern: dict) -> tuple[set[str], set[str], set[str]]:
    """Properties, classes and alignments that a pattern names, for the gate of a release."""
    props, classes, aligned = set(), set(), set()
    op = pattern["op"]
    if op in ("some_values_from", "class_membership", "datatype_facet", "boolean_has_value", "external_alignment"):
        props.add(pattern["property"])
    if op == "some_values_from":
        classes.add(pattern["filler_class"])
    if op == "class_membership":
        classes.update(pattern["classes"])
    if op == "class_present":
        classes.add(pattern["class"])
    if op == "external_alignment":
        aligned.add(pattern["alignment"])
    for p in pattern.get("operands", []):
        for mine, more in zip((props, classes, aligned), references(p), strict=True):
            mine |= more
    return props, classes, aligned


def reference_table(spark: SparkSession, patterns: list[tuple[str, dict]]) -> DataFrame:
    """(rule, kind, name) of all that patterns name."""
    rows = []
    for key, p in patterns:
        validate(p)
        rows += [(key, kind, n) for kind, names in zip(("property", "class", "alignment"), references(p), strict=True) for n in sorted(names)]
    return spark.createDataFrame(rows, "rule string, kind string, name string")


def phase_note(phase: Column, notes: dict[str, str], generic: str) -> Column:
    """A note for a phase by its local name, or a generic one: beside the facts, never one of them."""
    name = F.substring_index(F.substring_index(phase, "/", -1), "#", -1)
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in notes.items()], F.lit(generic))


def derivation(noael: Column, species: Column, point: Column, floor: Column, band: Column, endpoints: dict[str, Column]) -> Column:
    """How a band came about, as JSON: inputs, factors, bands, and which endpoints are not known."""
    gaps = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(k)) for k, c in endpoints.items()]))
    return F.to_json(
        F.struct(
            F.struct(noael.alias("noael"), species.alias("species")).alias("inputs"),
            F.struct(numeric.species_factor(species).alias("species")).alias("factors"),
            F.struct(point.alias("point"), floor.alias("floor"), band.alias("recommended")).alias("bands"),
            F.struct((F.size(gaps) > 0).alias("is_provisional"), gaps.alias("data_gaps")).alias("provisional"),
        ),
        {"ignoreNullFields": "false"},
    )


# queries


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.when(F.col("event_type") != "view", F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("actor"), F.col("event_type").alias("action"), seq.alias("seq"))


def audit_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(_events(spark, sf_dir), action="purchase", actor=None).select("seq", "actor", "action")


O_LISTING = "SELECT event_id AS seq, user_id AS actor, event_type AS action FROM events WHERE event_type = 'purchase'"


def governance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of all logs."""
    return newest_rows(_events(spark, sf_dir), ["ts", "event_id"]).select("event_id", "actor")


O_NEWEST = f"SELECT event_id, user_id AS actor FROM events ORDER BY ts DESC, event_id DESC LIMIT {NEWEST}"


def action_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions that are not ended, by conclusion; of conclusions that wait for a signature apart."""
    c = _states(spark, sf_dir).select(F.col("o_orderkey").alias("id"), "state")
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("conclusion_id"), F.when(F.col("l_returnflag") == "R", "voided").when(F.col("l_linestatus") == "F", "done").otherwise("pending").alias("status"))
    return open_actions(c, a).groupBy("id", (holds(F.col("state") == "pending_signature")).alias("unsigned")).agg(F.count(F.lit(1)).alias("n"))


O_ACTIONS = "SELECT o_orderkey AS id, coalesce(NOT o_totalprice < 5000 AND o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT', false) AS unsigned, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' AND l_linestatus <> 'F' GROUP BY 1, 2"


def connector_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as connectors, by kind and timeout."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "DOC_REPO").when(F.col("c_mktsegment") == "MACHINERY", None).otherwise("other").alias("system_type"), F.when(F.col("c_acctbal") > 0, "active").otherwise("off").alias("status"), F.when(F.col("c_nationkey") < 20, "poll").otherwise("push").alias("mode"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("interval"))
    return polled(c).groupBy("kind", "timeout").agg(F.count(F.lit(1)).alias("n"))


O_POLLS = "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'doc_repo' ELSE 'aps' END AS kind, CASE WHEN c_nationkey > 3 THEN c_nationkey ELSE 2 END + 3 AS timeout, count(*) AS n FROM customer WHERE c_acctbal > 0 AND c_nationkey < 20 GROUP BY 1, 2"


def connector_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as connectors with a cursor each; the pulls of some fail or time out."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("connector"), F.get_json_object("props", "$.k").cast("int").alias("version"), "event_type", "value")
    cursors = e.groupBy("connector").agg(F.min("version").alias("cursor"))
    failures = e.filter("event_type = 'error' AND value > 180").groupBy("connector").agg(F.when(F.max("value") > 200, "timeout").otherwise("error").alias("status"))
    return poll_runs(cursors, e.select("connector", "version"), failures)


O_RUNS = """
WITH e AS (SELECT user_id AS connector, CAST(json_extract_string(props, '$.k') AS INTEGER) AS version, event_type, value FROM events), c AS (SELECT connector, min(version) AS cur FROM e GROUP BY 1),
f AS (SELECT connector, CASE WHEN max(value) > 200 THEN 'timeout' ELSE 'error' END AS s FROM e WHERE event_type = 'error' AND value > 180 GROUP BY 1),
n AS (SELECT e.connector, count(*) AS n, max(version) AS top FROM e JOIN c USING (connector) WHERE version > cur GROUP BY 1)
SELECT connector, coalesce(s, 'success') AS status, cur AS cursor_from, CASE WHEN s IS NULL THEN coalesce(top, cur) END AS cursor_to, CASE WHEN s IS NULL THEN coalesce(n, 0) ELSE 0 END AS n_changes, CASE WHEN s IS NULL THEN coalesce(top, cur) ELSE cur END AS cursor
FROM c LEFT JOIN n USING (connector) LEFT JOIN f USING (connector)
"""


def schedule_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches and equipment of a feed: purchases are products that name their user's equipment, errors and clicks are equipment."""
    kind = F.when(F.col("event_type") == "purchase", "product").when(F.col("event_type").isin("error", "click"), "equipment").otherwise("other")
    fields = F.map_filter(F.create_map(F.lit("equipment_ids"), F.when(F.col("value") > 20, F.concat_ws(",", "user_id", F.col("user_id") + 1)), F.lit("status"), F.when(F.col("event_type") == "error", "down")), lambda k, v: v.isNotNull())
    c = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("entity_id"), kind.alias("entity_type"), F.col("event_type").alias("label"), fields.alias("fields"), "value")
    a = scheduled(c).select(F.col("batch_id").alias("id"), F.col("product_name").alias("what"), F.size("equipment_ids").alias("n"))
    b = equipment_status(c, c.filter("value > 100").select(F.col("entity_id").alias("equipment_id"))).select(F.col("equipment_id").alias("id"), F.col("status").alias("what"), F.lit(0).alias("n"))
    return a.unionByName(b)


O_SCHEDULE = "SELECT event_id::VARCHAR AS id, 'purchase' AS what, CAST(CASE WHEN value > 20 THEN 2 ELSE 0 END AS INTEGER) AS n FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id::VARCHAR, CASE event_type WHEN 'error' THEN 'down' ELSE 'idle' END, 0 FROM events WHERE event_type IN ('error', 'click') AND value > 100"


def release_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and suppliers as classes (a supplier below its nation or alone), parts and lines as links between them."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("iri"), F.lit(None).cast("string").alias("parent"), (F.col("n_regionkey") != 2).alias("enabled"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("iri"), F.when(F.col("s_acctbal") > 2000, F.concat(F.lit("n"), "s_nationkey")).alias("parent"), (F.col("s_acctbal") < 9000).alias("enabled"))
    m = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("iri"), F.explode(F.array(F.lit("own_iri"), F.when(F.col("s_acctbal") > 1000, "bfo").otherwise("source_field"))).alias("mapping_type"))
    m = m.unionByName(n.select("iri", F.explode(F.array(F.lit("bfo"), F.lit("own_iri"))).alias("mapping_type")))
    line = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("iri"), F.concat(F.lit("s"), "l_suppkey").alias("domain"), F.concat(F.lit("n"), F.col("l_partkey") % 25).alias("range"), F.col("l_linenumber").alias("low"), F.lit(6).alias("high"), (F.col("l_returnflag") != "R").alias("enabled")).dropDuplicates(["iri"])
    return release_faults(n.unionByName(s), m, line).groupBy("code", "severity", F.substring("entity", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


O_VALIDATION = """
WITH k AS (SELECT concat('n', n_nationkey) AS iri, NULL AS parent, n_regionkey <> 2 AS on_, true AS mapped FROM nation UNION ALL SELECT concat('s', s_suppkey), CASE WHEN s_acctbal > 2000 THEN concat('n', s_nationkey) END, s_acctbal < 9000, s_acctbal > 1000 FROM supplier),
l AS (SELECT DISTINCT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS iri, concat('s', l_suppkey) AS d, concat('n', l_partkey % 25) AS r, l_linenumber > 6 AS bad FROM lineitem WHERE l_returnflag <> 'R'),
x AS (SELECT 'missing_mapping' AS code, 'blocking' AS severity, iri FROM k WHERE on_ AND NOT mapped UNION ALL SELECT 'orphan_class', 'warning', iri FROM k WHERE on_ AND parent IS NULL AND iri NOT IN (SELECT parent FROM k WHERE parent IS NOT NULL)
  UNION ALL SELECT 'disabled_referenced', 'blocking', iri FROM k WHERE on_ AND parent IN (SELECT iri FROM k WHERE NOT on_) UNION ALL SELECT 'disabled_referenced', 'blocking', iri FROM l WHERE d IN (SELECT iri FROM k WHERE NOT on_) OR r IN (SELECT iri FROM k WHERE NOT on_)
  UNION ALL SELECT 'cardinality_conflict', 'blocking', iri FROM l WHERE bad)
SELECT code, severity, substr(iri, 1, 1) AS kind, count(*) AS n FROM x GROUP BY ALL
"""


def release_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as releases, asked for a step; those with returned lines are blocked."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "F", "in_review").otherwise("published").alias("status"), F.when(F.col("o_orderpriority") < "2", "submit").when(F.col("o_orderpriority") < "4", "publish").when(F.col("o_orderpriority") < "5", "return").otherwise("other").alias("step"))
    bad = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("bad")).distinct()
    return released(o.join(bad, "o_orderkey", "left"), F.col("bad")).groupBy("status", "step", "fault").agg(F.count(F.lit(1)).alias("n"))


O_STATES = """
WITH o AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'F' THEN 'in_review' ELSE 'published' END AS s, CASE WHEN o_orderpriority < '2' THEN 'submit' WHEN o_orderpriority < '4' THEN 'publish' WHEN o_orderpriority < '5' THEN 'return' ELSE 'other' END AS step, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS bad FROM orders),
f AS (SELECT *, CASE WHEN NOT ((step = 'submit' AND s = 'draft') OR (step IN ('publish', 'return') AND s = 'in_review')) THEN 'state' WHEN step <> 'return' AND bad THEN 'blocked' END AS fault FROM o)
SELECT CASE WHEN fault IS NOT NULL THEN s WHEN step = 'submit' THEN 'in_review' WHEN step = 'publish' THEN 'published' ELSE 'draft' END AS status, step, fault, count(*) AS n FROM f GROUP BY ALL
"""


def active_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules of a brand, suppliers' nations as the classes that are there."""
    r = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("n"), "p_size").alias("target"), (F.col("p_type") != "SMALL").alias("enabled"), F.col("p_brand").alias("key"))
    c = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("iri"))
    return active(r, c).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


O_ACTIVE = "SELECT p_brand AS key, count(*) AS n FROM part WHERE p_type <> 'SMALL' AND p_size IN (SELECT s_nationkey FROM supplier) GROUP BY 1"


def policy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of each order's lines, resolved by the policies of a table: restrictive for one customer segment, permissive for the rest; the lattice is the table's too."""
    policies = spark.createDataFrame([("BUILDING", "restrictive_wins", "max_severity"), ("FURNITURE", "permissive_wins", "max_severity")], "c_mktsegment string, direction string, strategy string")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").join(F.broadcast(policies), "c_mktsegment", "left")
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("x"))).alias("v"), F.array_sort(F.collect_list(F.when(F.col("l_tax") > 0.06, "HighRisk").when(F.col("l_tax") > 0.03, "MediumRisk").otherwise("LowRisk"))).alias("levels"))
    d = o.join(line, "l_orderkey")
    x = F.when(F.coalesce("direction", F.lit("restrictive_wins")) == "restrictive_wins", dedication(F.col("v.x"))).otherwise(dedication(F.col("v.x"), False))
    return d.select("c_mktsegment", x.alias("dedicated"), highest(F.col("levels"), {"LowRisk": 1, "MediumRisk": 2, "HighRisk": 3}).alias("level")).groupBy("c_mktsegment", "dedicated", "level").agg(F.count(F.lit(1)).alias("n"))


O_POLICY = """
WITH l AS (SELECT l_orderkey AS k, bool_or(l_returnflag = 'R') AS t, bool_or(l_returnflag = 'A') AS f, max(l_tax) AS tax FROM lineitem GROUP BY 1)
SELECT c_mktsegment, CASE c_mktsegment WHEN 'FURNITURE' THEN t AND NOT f ELSE t END AS dedicated, CASE WHEN tax > 0.06 THEN 'HighRisk' WHEN tax > 0.03 THEN 'MediumRisk' ELSE 'LowRisk' END AS level, count(*) AS n
FROM l JOIN orders ON o_orderkey = k JOIN customer ON c_custkey = o_custkey GROUP BY ALL
"""


def post_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of parts with post-conditions: a new size for some, and a class that joins the brands of others."""
    p = table(spark, sf_dir, "part")
    none = F.from_json(F.lit("{}"), "map<string,string>")
    post = F.when(F.col("p_size") > 40, F.create_map(F.lit("size"), F.lit("low"), F.lit("brand"), F.concat(F.lit("http://x/"), "p_brand"))).when(F.col("p_size") > 20, F.create_map(F.lit("kind"), F.lit("x#y"))).otherwise(none)
    scalars, relations = injected(F.create_map(F.lit("size"), F.col("p_size").cast("string")), F.create_map(F.lit("brand"), F.array("p_brand")), post)
    d = p.select("p_partkey", scalars.alias("s"), relations.alias("r"))
    return d.select("p_partkey", F.element_at("s", F.lit("size")).alias("size"), F.size("s").alias("n"), F.array_join(F.element_at("r", F.lit("brand")), ",").alias("brands"), F.array_join(F.element_at("r", F.lit("kind")), ",").alias("kinds"))


O_POST = """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'low' ELSE p_size::VARCHAR END AS size, CAST(CASE WHEN p_size > 20 THEN 2 ELSE 1 END AS INTEGER) AS n,
  CASE WHEN p_size > 40 THEN concat(p_brand, ',http://x/', p_brand) ELSE p_brand END AS brands, CASE WHEN p_size > 20 AND p_size <= 40 THEN 'x#y' END AS kinds FROM part
"""


def references_in(patterns: DataFrame) -> DataFrame:
    """(rule, kind, name) of all that stored patterns (rule, pattern: JSON) name, each once."""
    found = lambda text, regex: F.regexp_extract_all(text, F.lit(regex), F.lit(1))
    listed = F.flatten(F.transform(found(F.col("pattern"), r'"classes"\s*:\s*\[([^\]]*)\]'), lambda x: found(x, '"([^"]*)"')))
    named = lambda key: found(F.col("pattern"), rf'"{key}"\s*:\s*"([^"]*)"')
    kinds = {"property": named("property"), "class": F.concat(named("(?:class|filler_class)"), listed), "alignment": named("alignment")}
    told = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name"))
    each = F.flatten(F.array(*[F.transform(names, told(kind)) for kind, names in kinds.items()]))
    return patterns.select("rule", F.inline(F.array_distinct(each)))


def pattern_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules made of parts, as the JSON that a table of rules holds, and what they name that no supplied part is or is called."""
    p = table(spark, sf_dir, "part")
    pattern = (
        F.when(F.col("p_size") <= 10, F.to_json(F.struct(F.lit("class_present").alias("op"), F.col("p_type").alias("class"))))
        .when(F.col("p_size") <= 25, F.to_json(F.struct(F.lit("and").alias("op"), F.array(
            F.struct(F.lit("some_values_from").alias("op"), F.col("p_brand").alias("property"), F.col("p_type").alias("filler_class"), F.lit(None).cast("string").alias("alignment")),
            F.struct(F.lit("external_alignment").alias("op"), F.lit("made of").alias("property"), F.lit(None).cast("string").alias("filler_class"), F.col("p_name").alias("alignment")),
        ).alias("operands"))))
        .otherwise(F.to_json(F.struct(F.lit("class_membership").alias("op"), F.col("p_brand").alias("property"), F.array("p_type", F.substring_index("p_name", " ", 1)).alias("classes"))))
    )
    known = p.filter("p_size = 50").select(F.explode(F.array("p_brand", "p_type")).alias("name")).distinct()
    return references_in(p.select(F.col("p_partkey").alias("rule"), pattern.alias("pattern"))).join(known, "name", "left_anti")


O_REFERENCES = """
WITH r AS (SELECT p_partkey AS rule, 'class' AS kind, p_type AS name FROM part UNION SELECT p_partkey, 'property', p_brand FROM part WHERE p_size > 10
  UNION SELECT p_partkey, 'property', 'made of' FROM part WHERE p_size BETWEEN 11 AND 25 UNION SELECT p_partkey, 'alignment', p_name FROM part WHERE p_size BETWEEN 11 AND 25 UNION SELECT p_partkey, 'class', split_part(p_name, ' ', 1) FROM part WHERE p_size > 25)
SELECT * FROM r WHERE name NOT IN (SELECT p_brand FROM part WHERE p_size = 50) AND name NOT IN (SELECT p_type FROM part WHERE p_size = 50)
"""


def derivation_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each document's band came about: its length is the dose, its labels are the endpoints, unknown where there is none."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    ends = {"genotoxic": F.col("quality") == 0, "carcinogenic": F.col("toxic") == 1, "reproductive": F.col("toxic") == 1}
    point, floor = numeric.band(F.col("n_chars") / 10), numeric.floor_band(*ends.values())
    return d.select("doc_id", derivation(F.col("n_chars"), F.when(F.col("lang") == "en", "rat"), point, floor, numeric.recommended_band(point, floor, *ends.values()), ends).alias("provenance"))


O_DERIVATION = """
WITH d AS (SELECT doc_id, n_chars, lang = 'en' AS rat, quality, toxic, CASE WHEN n_chars / 10 >= 1000 THEN 1 WHEN n_chars / 10 >= 100 THEN 2 WHEN n_chars / 10 >= 10 THEN 3 WHEN n_chars / 10 >= 1 THEN 4 ELSE 5 END AS p, greatest(CASE WHEN quality = 0 THEN 5 END, CASE WHEN toxic = 1 THEN 4 END) AS f FROM documents LEFT JOIN labels USING (doc_id)),
e AS (SELECT *, CASE WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN greatest(p, f) ELSE least(5, greatest(p, f) + 1) END AS r, array_to_string(list_filter([CASE WHEN quality IS NULL THEN '"genotoxic"' END, CASE WHEN toxic IS NULL THEN '"carcinogenic"' END, CASE WHEN toxic IS NULL THEN '"reproductive"' END], lambda x: x IS NOT NULL), ',') AS g FROM d)
SELECT doc_id, concat('{"inputs":{"noael":', n_chars, ',"species":', CASE WHEN rat THEN '"rat"' ELSE 'null' END, '},"factors":{"species":', CASE WHEN rat THEN '5.0' ELSE '10.0' END, '},"bands":{"point":', p, ',"floor":', coalesce(f::VARCHAR, 'null'), ',"recommended":', r, '},"provisional":{"is_provisional":', CASE WHEN g = '' THEN 'false' ELSE 'true' END, ',"data_gaps":[', g, ']}}') AS provenance FROM e
"""


def phase_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of regions' phases on their nations."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("http://x/a#Phase_"), "n_regionkey").alias("phase"))
    return n.select("n_nationkey", phase_note(F.col("phase"), {"Phase_0": "early", "Phase_3": "late"}, "no emphasis").alias("note"))


O_NOTES = "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'early' WHEN 3 THEN 'late' ELSE 'no emphasis' END AS note FROM nation"

_ALL = (
    (audit_listing, O_LISTING), (governance_audit, O_NEWEST), (action_listing, O_ACTIONS), (connector_polls, O_POLLS), (connector_runs, O_RUNS), (schedule_fetch, O_SCHEDULE), (release_validation, O_VALIDATION),
    (release_states, O_STATES), (active_artifacts, O_ACTIVE), (policy_choice, O_POLICY), (post_conditions, O_POST), (pattern_references, O_REFERENCES), (derivation_provenance, O_DERIVATION), (phase_notes, O_NOTES),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: o for f, o in _ALL}
