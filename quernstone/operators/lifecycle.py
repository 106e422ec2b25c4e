"""Templates' coverage, the four states of a conclusion, and the actions that follow from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.ternary import holds
from quernstone.sources.tables import table

#: Legal transitions of a conclusion (from no state at first), and terminal states of an action.
LEGAL = ((None, "effective"), (None, "pending_signature"), ("pending_signature", "effective"), ("pending_signature", "rejected"), ("effective", "superseded"))
TERMINAL = ("voided", "done", "failed")


def backfilled(superseded: Column, signed: Column, needs_signature: Column) -> Column:
    """The state of an old row by precedence; NULL for one that has not entered its life yet."""
    return F.when(superseded, "superseded").when(signed, "effective").when(holds(needs_signature), "pending_signature")


def transition(state: Column, to: Column) -> Column:
    """(state after, accepted): an illegal step changes nothing."""
    legal = reduce(Column.__or__, [state.eqNullSafe(F.lit(a)) & (to == b) for a, b in LEGAL])
    ok = F.coalesce(legal, F.lit(False))
    return F.struct(F.when(ok, to).otherwise(state).alias("state"), ok.alias("accepted"))


def planned(dedicated: Column, risk: Column, effective: Column) -> Column:
    """The actions of a result, suppressed until the conclusion is effective."""
    kinds = F.array_compact(F.array(F.when(holds(dedicated), "isolate"), F.when(risk == "HighRisk", "hold"), F.when(risk == "LowRisk", "release")))
    return F.transform(kinds, lambda k: F.struct(k.alias("action"), F.when(holds(effective), "planned").otherwise("suppressed").alias("status")))


def covered(source: Column, value: Column, required: Column) -> Column:
    """A slot's status: constants and values fill it; other sources than extraction are manual; a required gap is missing."""
    blank = F.coalesce(F.trim(value.cast("string")) == "", F.lit(True))
    return F.when(source == "constant", "filled").when(source != "extraction", "manual").when(~blank, "filled").when(holds(required), "missing").otherwise("blank")


def assessed_slot(x: Column) -> Column:
    """TRUE is inferred, FALSE filled, UNKNOWN missing."""
    return F.when(x, "inferred").when(~x, "filled").otherwise("missing")


def slots(spark: SparkSession) -> DataFrame:
    rows = [("a", "quality", "extraction", True), ("a", "toxic", "extraction", False), ("b", "title", "constant", True), ("b", "remark", "manual", False), ("b", "length", "extraction", True)]
    return spark.createDataFrame(rows, "section string, slot string, source string, required boolean")


def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of every document: the slots are an array of the plan, so nothing is shuffled for the cross product."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").withColumnRenamed("source", "origin").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    values = F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string"), F.lit("length"), F.when(F.col("n_chars") > 100, F.col("n_chars").cast("string")))
    rows = [F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()]) for r in slots(spark).collect()]
    s = d.select("doc_id", "origin", values.alias("v"), F.inline(F.array(*rows)))
    return s.select("doc_id", "origin", "section", "slot", covered(F.col("source"), F.element_at("v", F.col("slot")), F.col("required")).alias("status"))


_SLOTS = "(VALUES ('a', 'quality', 'extraction', true), ('a', 'toxic', 'extraction', false), ('b', 'title', 'constant', true), ('b', 'remark', 'manual', false), ('b', 'length', 'extraction', true)) s(section, slot, src, required)"
O_STATUS = f"""
SELECT doc_id, source AS origin, section, slot, CASE WHEN src = 'constant' THEN 'filled' WHEN src <> 'extraction' THEN 'manual'
  WHEN (slot = 'quality' AND quality IS NOT NULL) OR (slot = 'toxic' AND toxic IS NOT NULL) OR (slot = 'length' AND n_chars > 100) THEN 'filled' WHEN required THEN 'missing' ELSE 'blank' END AS status
FROM documents LEFT JOIN labels USING (doc_id), {_SLOTS}
"""


def coverage_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts of each source's documents, less dismissed gaps (those of documents called toxic), and the slots that are missing anywhere."""
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("_gone")).distinct()
    s = coverage_status(spark, sf_dir).join(gone, "doc_id", "left")
    status = F.when((F.col("status") == "missing") & holds(F.col("_gone")), "dismissed").otherwise(F.col("status"))
    g = s.withColumn("status", status).groupBy("origin", "status").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("slot")), ",").alias("slots"))
    return g


O_MANIFEST = f"SELECT origin, CASE WHEN status = 'missing' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'dismissed' ELSE status END AS status, count(*) AS n, string_agg(DISTINCT slot, ',' ORDER BY slot) AS slots FROM ({O_STATUS}) GROUP BY 1, 2"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return o.withColumn("state", backfilled(F.col("o_totalprice") < 5000, F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"))


_STATE = "CASE WHEN o_totalprice < 5000 THEN 'superseded' WHEN o_orderstatus = 'F' THEN 'effective' WHEN o_orderpriority = '1-URGENT' THEN 'pending_signature' END"


def lifecycle_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


O_BACKFILL = f"SELECT {_STATE} AS state, count(*) AS n FROM orders GROUP BY 1"


def lifecycle_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = F.when(F.col("o_orderkey") % 2 == 0, "effective").otherwise("superseded")
    x = transition(F.col("state"), to)
    return _states(spark, sf_dir).select("o_orderkey", x["state"].alias("state"), x["accepted"].alias("accepted"))


O_GUARD = f"""
SELECT o_orderkey, CASE WHEN ok THEN t ELSE s END AS state, ok AS accepted FROM (SELECT *, coalesce((coalesce(s, 'none') IN ('none', 'pending_signature') AND t = 'effective') OR (s = 'effective' AND t = 'superseded'), false) AS ok
FROM (SELECT o_orderkey, {_STATE} AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'effective' ELSE 'superseded' END AS t FROM orders))
"""


def action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = F.when(F.col("o_totalprice") > 200000, "HighRisk").when(F.col("o_totalprice") < 50000, "LowRisk").otherwise("MediumRisk")
    d = _states(spark, sf_dir).select("o_orderkey", F.inline(planned(F.col("o_orderpriority") == "2-HIGH", risk, F.col("state") == "effective")))
    return d.groupBy("action", "status").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_id"))


O_PLAN = f"""
WITH s AS (SELECT *, CASE WHEN {_STATE} = 'effective' THEN 'planned' ELSE 'suppressed' END AS status FROM orders)
SELECT action, status, count(*) AS n, min(o_orderkey) AS first_id FROM (SELECT o_orderkey, 'isolate' AS action, status FROM s WHERE o_orderpriority = '2-HIGH'
  UNION ALL SELECT o_orderkey, 'hold', status FROM s WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'release', status FROM s WHERE o_totalprice < 50000) GROUP BY 1, 2
"""


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a report by a nullable condition: its level, low, or pending; a post-condition brings it down to low."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    x = (F.col("quality") == 0) & (F.col("n_chars") > 500)
    level = F.when(x, "high").when(~x, "low").otherwise("pending")
    post = F.when(F.col("n_chars") % 2 == 0, "low").otherwise(level)
    return d.select("doc_id", level.alias("level"), post.alias("post_level"), assessed_slot(x).alias("status"))


O_REPORT = """
SELECT doc_id, l AS level, CASE WHEN n_chars % 2 = 0 THEN 'low' ELSE l END AS post_level, CASE l WHEN 'high' THEN 'inferred' WHEN 'low' THEN 'filled' ELSE 'missing' END AS status
FROM (SELECT doc_id, n_chars, CASE WHEN quality = 0 AND n_chars > 500 THEN 'high' WHEN NOT (quality = 0 AND n_chars > 500) THEN 'low' ELSE 'pending' END AS l FROM documents LEFT JOIN labels USING (doc_id))
"""



def signed(conclusions: DataFrame, decisions: DataFrame) -> DataFrame:
    """conclusions (id, state, …) after decisions (id, approve; the first for each id): a legal signature makes them effective, a refusal rejected; others stay."""
    d = decisions.groupBy("id").agg(F.min("approve").alias("_approve"))
    j = conclusions.join(d, "id", "left")
    x = transition(F.col("state"), F.when(F.col("_approve"), "effective").otherwise("rejected"))
    ok = F.col("_approve").isNotNull() & (F.col("state") == "pending_signature") & x["accepted"]
    return j.withColumns({"state": F.when(ok, x["state"]).otherwise(F.col("state")), "decided": F.coalesce(ok, F.lit(False))}).drop("_approve")


def released(actions: DataFrame, conclusions: DataFrame) -> DataFrame:
    """actions (conclusion_id, status, …) after signed(): suppressed ones of what is effective now are pending; of what is rejected, those not yet ended are void."""
    c = conclusions.filter("decided").select(F.col("id").alias("conclusion_id"), F.col("state").alias("_state"))
    j = actions.join(c, "conclusion_id", "left")
    status = F.when((F.col("_state") == "effective") & (F.col("status") == "suppressed"), "pending").when((F.col("_state") == "rejected") & ~F.col("status").isin(*TERMINAL), "voided")
    return j.withColumn("status", F.coalesce(status, "status")).drop("_state")


def moved(status: Column, to: Column) -> Column:
    """(status after, fault): terminal actions don't move, suppressed ones only by a signature."""
    fault = F.when(status.isin(*TERMINAL), "terminal").when(status == "suppressed", "suppressed")
    return F.struct(F.when(fault.isNull(), to).otherwise(status).alias("status"), fault.alias("fault"))


def sign_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders signed or refused by their customer's balance, and their actions after it."""
    c = _states(spark, sf_dir).select(F.col("o_orderkey").alias("id"), "state")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority", "o_orderstatus")
    decisions = o.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 3000).alias("approve")), "o_custkey").select("id", "approve")
    after = signed(c, decisions)
    actions = o.select(F.col("id").alias("conclusion_id"), F.explode(F.array(F.lit("suppressed"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done"))).alias("status"))
    done = released(actions, after).join(after.select(F.col("id").alias("conclusion_id"), "state", "decided"), "conclusion_id")
    return done.groupBy("state", "decided", "status").agg(F.count(F.lit(1)).alias("n"))


O_SIGN = f"""
WITH s AS (SELECT o_orderkey, o_orderstatus, {_STATE} AS st, c_acctbal > 3000 AS ok FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
d AS (SELECT *, st = 'pending_signature' AND ok IS NOT NULL AS dec FROM s), e AS (SELECT *, coalesce(dec, false) AS decided, CASE WHEN dec THEN CASE WHEN ok THEN 'effective' ELSE 'rejected' END ELSE st END AS state FROM d),
a AS (SELECT e.*, x FROM e, (VALUES (0), (1)) v(x)), b AS (SELECT *, CASE WHEN x = 0 THEN 'suppressed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'done' END AS before FROM a)
SELECT state, decided, CASE WHEN decided AND state = 'effective' AND before = 'suppressed' THEN 'pending' WHEN decided AND state = 'rejected' AND before <> 'done' THEN 'voided' ELSE before END AS status, count(*) AS n FROM b GROUP BY ALL
"""


def action_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as actions in all states, asked to move on."""
    status = F.when(F.col("l_returnflag") == "R", "voided").when(F.col("l_linestatus") == "F", "suppressed").when(F.col("l_quantity") > 40, "done").otherwise("pending")
    x = moved(F.col("s"), F.lit("running"))
    d = table(spark, sf_dir, "lineitem").select(status.alias("s")).select(F.col("s").alias("before"), x["status"].alias("after"), x["fault"].alias("fault"))
    return d.groupBy("before", "after", "fault").agg(F.count(F.lit(1)).alias("n"))


O_MOVED = """
SELECT s AS before, CASE WHEN s = 'pending' THEN 'running' ELSE s END AS after, CASE WHEN s IN ('voided', 'done') THEN 'terminal' WHEN s = 'suppressed' THEN 'suppressed' END AS fault, count(*) AS n
FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'voided' WHEN l_linestatus = 'F' THEN 'suppressed' WHEN l_quantity > 40 THEN 'done' ELSE 'pending' END AS s FROM lineitem) GROUP BY ALL
"""

_ALL = ((coverage_status, O_STATUS), (coverage_manifest, O_MANIFEST), (lifecycle_backfill, O_BACKFILL), (lifecycle_guard, O_GUARD), (action_plan, O_PLAN), (report_rows, O_REPORT), (sign_reject, O_SIGN), (action_guard, O_MOVED))
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: o for f, o in _ALL}
