"""Queries over documents, conversations and pages that show the text operators, each with its SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.sources.shared import kept
from quernstone.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.char_length)), F.lit(0)).alias("longest"))


_PIECES = r"list_filter(list_transform(string_split(regexp_replace(text, '([。！？；.!?;])', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
O_SENTENCES = f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS INTEGER) AS longest FROM (SELECT doc_id, {_PIECES} AS s FROM documents)"


def sentence_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences joined to fragments of eight characters or more; no SQL for an ordered fold, so a test holds it against Python."""
    d = _docs(spark, sf_dir).select("doc_id", T.coalesced(T.sentences(F.col("text"))).alias("s"))
    return d.select("doc_id", F.size("s").alias("n_fragments"), F.sha2(F.array_join("s", "\n"), 256).alias("fragments_sha256"))


def narrative_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.is_narrative(F.col("text")).alias("narrative"))


O_NARRATIVE = rf"""
SELECT doc_id, length(text) >= 120 AND len({_PIECES}) >= 4 AND len(list_filter(l, lambda x: regexp_matches(x, '^[^:：]{{1,40}}[:：]\s*\S'))) * 2 < greatest(len(l), 1)
  AND len(list_filter(l, lambda x: regexp_matches(x, '^\s*(?:[-*•]|[0-9]+[.)、])'))) * 5 < greatest(len(l), 1) * 4 AS narrative
FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents)
"""


def kv_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    extra = _docs(spark, sf_dir).select(F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.explode(F.split("text", "\n")).alias("line"))
    e = table(spark, sf_dir, "events")
    told = F.when(F.col("value") > 100, F.concat(F.lit(" "), "event_type", F.lit(" ： "), F.round("value", 1))).otherwise(F.concat("event_type", F.lit(":"), "props"))
    logged = e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), told.alias("line"))
    both = lines.select("conv_id", F.col("turn").cast("long").alias("turn"), "line").unionByName(extra).unionByName(logged)
    key, value = T.key_value(F.col("line"))
    return both.select("conv_id", "turn", key.alias("key"), value.alias("value")).filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first_value"))


O_KV = r"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations UNION ALL SELECT unnest(string_split(text, chr(10))) FROM documents
  UNION ALL SELECT CASE WHEN value > 100 THEN concat(' ', event_type, ' ： ', round(value, 1)) ELSE concat(event_type, ':', props) END FROM events),
k AS (SELECT regexp_extract(line, '^\s*([^:：]{1,40}?)\s*[:：]\s*(.+?)\s*$', 1) AS key, regexp_extract(line, '^\s*([^:：]{1,40}?)\s*[:：]\s*(.+?)\s*$', 2) AS value FROM l WHERE regexp_matches(line, '^\s*([^:：]{1,40}?)\s*[:：]\s*(.+?)\s*$'))
SELECT key, count(*) AS n, min(value) AS first_value FROM k GROUP BY key
"""


def vocab_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", T.normalised(F.concat_ws(" ", F.lower("c_mktsegment"), F.lit("phase i i")), ["AUTO MOBILE", "HOUSE HOLD", "PHASE II"]).alias("term"))
    return c.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


O_VOCAB = "SELECT CASE WHEN contains(c_mktsegment, 'AUTOMOBILE') THEN 'AUTO MOBILE' WHEN contains(c_mktsegment, 'HOUSEHOLD') THEN 'HOUSE HOLD' ELSE 'PHASE II' END AS term, count(*) AS n FROM customer GROUP BY 1"


def doc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document with the greatest keyword score, three at least; the first among equals."""
    classes = {"english": (["the ", " of "], ["and", "with"]), "french": ([" de ", " est "], ["eau", "que"]), "german": ([" der ", "ung"], ["sch", "ein"]), "spanish": (["ción", " los "], ["ado", "que"])}
    scores = [F.struct(T.keyword_score(F.col("text"), a, b).alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("name")) for i, (k, (a, b)) in enumerate(classes.items())]
    best = F.array_max(F.array(*scores))
    return _docs(spark, sf_dir).select("doc_id", F.when(best["score"] >= 3, best["name"]).alias("doc_class"), best["score"].alias("score"))


def _o_score(a: list[str], b: list[str]) -> str:
    return " + ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {w} ELSE 0 END" for ks, w in ((a, 2), (b, 1)) for k in ks)


O_CLASSIFY = f"""
WITH s AS (SELECT doc_id, {_o_score(["the ", " of "], ["and", "with"])} AS a, {_o_score([" de ", " est "], ["eau", "que"])} AS b, {_o_score([" der ", "ung"], ["sch", "ein"])} AS c, {_o_score(["ción", " los "], ["ado", "que"])} AS d FROM documents)
SELECT doc_id, CASE WHEN greatest(a, b, c, d) < 3 THEN NULL WHEN a = greatest(a, b, c, d) THEN 'english' WHEN b = greatest(a, b, c, d) THEN 'french' WHEN c = greatest(a, b, c, d) THEN 'german' ELSE 'spanish' END AS doc_class,
  greatest(a, b, c, d) AS score FROM s
"""


def section_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under their headings (short lines without a final stop): a running count of headings within the document."""
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = (F.char_length("line") < 30) & (F.char_length("line") > 0)
    w = Window.partitionBy("doc_id").orderBy("pos")
    d = d.withColumn("section", F.sum(head.cast("int")).over(w))
    return d.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars"))


O_SECTIONS = """
SELECT doc_id, section, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars
FROM (SELECT *, CAST(sum(CASE WHEN length(line) BETWEEN 1 AND 29 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS section
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) GROUP BY 1, 2
"""


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around the first `the` of each document."""
    at = F.instr("text", "the") - 1
    return _docs(spark, sf_dir).select("doc_id", F.when(at >= 0, T.context(F.col("text"), at, at + 3, 15)).alias("around"))


O_CONTEXT = "SELECT doc_id, CASE WHEN p > 0 THEN substr(text, greatest(p - 15, 1), least(p + 17, length(text)) - greatest(p - 15, 1) + 1) END AS around FROM (SELECT *, instr(text, 'the') AS p FROM documents)"


def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents × classes by fan-out: rows that mention a token of the class's label stay; a class without tokens keeps all."""
    labels = {"open": "", "water": "eau vi", "sound": "ing ble", "union": "und ver"}
    classes = F.array(*[F.struct(F.lit(k).alias("class"), F.lit(v).alias("label")) for k, v in labels.items()])
    d = _docs(spark, sf_dir).select("doc_id", "lang", F.lower("text").alias("t"), F.inline(classes)).withColumn("tokens", T.label_tokens(F.col("label")))
    stays = (F.size("tokens") == 0) | F.exists("tokens", lambda x: F.contains(F.col("t"), x))
    return d.filter(stays).groupBy("class", "lang").agg(F.count(F.lit(1)).alias("n"))


O_GATE = """
SELECT class, lang, count(*) AS n FROM documents, (VALUES ('open', NULL, NULL), ('water', 'eau', 'vi'), ('sound', 'ing', 'ble'), ('union', 'und', 'ver')) c(class, a, b)
WHERE a IS NULL OR contains(lower(text), a) OR contains(lower(text), b) GROUP BY 1, 2
"""


def pct_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Purity (w/w) of "), "p_name", F.lit(": "), F.col("p_size"), F.lit(".5 % by assay")).alias("line"))
    key, value = T.key_value(F.col("line"))
    return p.select("p_partkey", T.first_percentage(value).alias("pct"), F.char_length(T.unit_stripped(F.concat(key, F.lit(" (mg)")))).alias("key_length"))


O_PCT = "SELECT p_partkey, p_size + 0.5::DOUBLE AS pct, CAST(length(concat('Purity (w/w) of ', p_name)) AS INTEGER) AS key_length FROM part WHERE length(concat('Purity (w/w) of ', p_name)) <= 40 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE length(concat('Purity (w/w) of ', p_name)) > 40"


def action_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("When the "), "event_type", F.lit(" exceeds "), F.round("value").cast("int"), F.lit(", then line "), F.col("user_id"), F.lit(" shall be cleaned. End."))).otherwise(F.lit("Nothing to do.")).alias("t"))
    a = T.conditional_action(F.col("t"))
    return e.select("event_id", a["condition"].alias("condition"), a["action"].alias("action"), a["obligation"].alias("obligation"))


O_ACTION = """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('the ', event_type, ' exceeds ', CAST(round(value) AS INTEGER)) END AS condition,
  CASE WHEN event_id % 3 = 0 THEN concat('line ', user_id, ' shall be cleaned') END AS action, CASE WHEN event_id % 3 = 0 THEN 'shall' END AS obligation FROM events
"""


GENESIS = "0" * 64
CHAIN = "user_id long, event_id long, seq long, prev_hash string, entry_hash string"


def chained(log: DataFrame) -> DataFrame:
    """user_id, event_id, seq, prev_hash and entry_hash of every record, from user_id, event_id, seq and record (its canonical text).

    entry_hash = sha256(prev_hash || record), prev_hash the entry_hash before it in its user's log. A log lies in one partition
    in order of seq; the running hash goes from batch to batch, so no log is held in memory. A log is sequential by its nature.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, last, started = None, GENESIS, False
        for b in batches:
            users, records = b.column("user_id").to_pylist(), b.column("record").to_pylist()
            prev, entry = [], []
            for user, record in zip(users, records, strict=True):
                if not started or user != owner:
                    owner, last, started = user, GENESIS, True
                prev.append(last)
                last = hashlib.sha256((last + record).encode()).hexdigest()
                entry.append(last)
            yield pa.RecordBatch.from_arrays([b.column("user_id"), b.column("event_id"), b.column("seq"), pa.array(prev, pa.string()), pa.array(entry, pa.string())], names=[x.split()[0] for x in CHAIN.split(", ")])

    plain = log.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.col("seq").cast("long").alias("seq"), "record")
    return plain.repartition("user_id").sortWithinPartitions("user_id", "seq", "event_id").mapInArrow(rows, CHAIN)


def chain_faults(stored: DataFrame) -> DataFrame:
    """Faults of a stored log (user_id, event_id, seq, record, prev_hash, entry_hash), each row by itself and its neighbour.

    `seq`: not the one due at its place, so something is missing before it or stands twice; `prev`: prev_hash isn't the
    entry_hash before it; `entry`: entry_hash isn't that of its own record.
    """
    w = Window.partitionBy("user_id").orderBy("seq", "event_id")
    rows = stored.withColumn("_due", F.row_number().over(w)).withColumn("_before", F.lag("entry_hash", 1, GENESIS).over(w))
    tests = {"seq": F.col("seq").eqNullSafe(F.col("_due")), "prev": F.col("prev_hash").eqNullSafe(F.col("_before")), "entry": F.col("entry_hash").eqNullSafe(F.sha2(F.concat("prev_hash", "record"), 256))}
    faults = F.filter(F.array(*[F.when(~ok, F.lit(k)) for k, ok in tests.items()]), lambda x: x.isNotNull())
    return rows.withColumn("faults", faults).filter(F.size("faults") > 0).select("user_id", "event_id", "seq", "faults")


def _audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").withColumn("seq", seq.cast("long"))
    record = T.canonical_json({"type": F.col("event_type"), "id": F.col("event_id"), "props": F.col("props"), "seq": F.col("seq")})
    return e.select("user_id", "event_id", "seq", record.alias("record"))


def audit_hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's running chain in each user's log: an entry_hash depends on every record before it."""
    return chained(_audit_log(spark, sf_dir))


def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry hashes of each user's log."""
    return audit_hash_chain(spark, sf_dir).select("user_id", "event_id", "seq", "entry_hash")


def audit_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification finds in a log whose costliest views were cut out, costliest errors rewritten and costliest sign-ups given another predecessor."""
    log, e = _audit_log(spark, sf_dir), table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    stored = kept(chained(log), "log").join(log.select("event_id", "record"), "event_id").join(e, "event_id")
    is_ = lambda t: (F.col("event_type") == t) & (F.col("value") > 150)
    stored = stored.filter(~is_("view")).withColumns({"record": F.when(is_("error"), "changed").otherwise(F.col("record")), "prev_hash": F.when(is_("signup"), GENESIS).otherwise(F.col("prev_hash"))})
    return chain_faults(stored).select("user_id", "event_id", "seq", F.array_join("faults", ",").alias("faults"))


O_HASH_CHAIN = f"""
WITH RECURSIVE r AS (SELECT user_id, event_id, seq, concat('{{"id":', event_id, ',"props":', to_json(props), ',"seq":', seq, ',"type":"', event_type, '"}}') AS record
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events)),
c AS (SELECT user_id, event_id, seq, '{GENESIS}' AS prev_hash, sha256(concat('{GENESIS}', record)) AS entry_hash FROM r WHERE seq = 1
  UNION ALL SELECT r.user_id, r.event_id, r.seq, c.entry_hash, sha256(concat(c.entry_hash, r.record)) FROM c JOIN r ON r.user_id = c.user_id AND r.seq = c.seq + 1)
SELECT * FROM c
"""

O_AUDIT = f"SELECT user_id, event_id, seq, entry_hash FROM ({O_HASH_CHAIN})"
O_FAULTS = f"""
WITH x AS (SELECT c.*, event_type = 'error' AND value > 150 AS ch, event_type = 'signup' AND value > 150 AS sg, event_type = 'view' AND value > 150 AS gone FROM ({O_HASH_CHAIN}) c JOIN events USING (event_id)),
y AS (SELECT user_id, event_id, seq, ch, sg, CASE WHEN sg THEN '{GENESIS}' ELSE prev_hash END AS p, prev_hash AS was, coalesce(lag(entry_hash) OVER w, '{GENESIS}') AS before, row_number() OVER w AS due FROM x WHERE NOT gone WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
z AS (SELECT user_id, event_id, seq, concat_ws(',', CASE WHEN seq <> due THEN 'seq' END, CASE WHEN p <> before THEN 'prev' END, CASE WHEN ch OR p <> was THEN 'entry' END) AS faults FROM y)
SELECT * FROM z WHERE faults <> ''
"""

_ALL = (
    (sentence_split, O_SENTENCES), (sentence_coalesce, None), (narrative_flag, O_NARRATIVE), (kv_extract, O_KV), (vocab_normalise, O_VOCAB), (doc_classify, O_CLASSIFY), (section_islands, O_SECTIONS),
    (context_window, O_CONTEXT), (relevance_gate, O_GATE), (pct_extract, O_PCT), (action_parse, O_ACTION), (audit_chain, O_AUDIT), (audit_hash_chain, O_HASH_CHAIN), (audit_faults, O_FAULTS),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: o for f, o in _ALL if o}
