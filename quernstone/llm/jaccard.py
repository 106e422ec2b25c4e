"""N-gram Jaccard join (operator 2): a grouped prefix join over sets of word shingles, exact.

1. Shingles that repeat within one input task are counted, and the most frequent of them become the last of a global
   order (by hash before that). Any order gives the same links; a good one keeps common shingles out of prefixes.
2. A set's prefix holds its first `n - ceil(0.75 n) + 1` shingles: sets that link share one of them. Documents with
   the same prefix and size collapse into one group, and a group's prefix is posted once per task.
3. Shingles in the prefixes of two groups or more are the only ones that stay. Group pairs pass a size and a position
   filter before they are expanded to members, and members are verified on their whole sets.
4. Copies never become all pairs. Two rounds verify the members of a shingle's bucket with one of them only (a star),
   and links found contract to components. Shingles whose members all hang together are done with; the last round
   takes every pair of groups whose members lie in different components, so that no link between components is
   missed. Equal sets are one member throughout.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; fewer than five
words make one shingle; repeated rows and rows that share a doc_id are one node; a row without doc_id keeps a null
component_id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import WordHash, bounded_batches, columns_of, documents, dropped, grams, id_and_text, mixed, sent_if_few, signed, spread, with_ids, written
from quernstone.llm.components import components

#: Words of a shingle; two documents link at a similarity of NUM / DEN or more.
WORDS, NUM, DEN = 5, 3, 4
#: Shingles that the global order knows as frequent: a bound of what is broadcast (24 bytes each), never of what is joined.
FREQUENT = 500_000
LOW = (1 << 23) - 1
#: Pairs of one document that are verified together.
SLICE = 64
#: Shingles of one task that are counted together.
COUNTED = 2_000_000
#: Documents from which a shingle's postings are joined with its hub, instead of meeting in one task.
OFTEN = 1_000


def shingles(text: str, hashed: WordHash) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    codes = hashed(text.encode("utf-8", "surrogatepass").lower())
    if len(codes) < WORDS:
        return mixed(grams(codes, len(codes)) + np.uint64(len(codes))) if len(codes) else codes
    return distinct(grams(codes, WORDS))


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles in two or more texts of this task, with how many."""
    hashed, held, size = WordHash(), [], 0

    def repeated() -> pa.RecordBatch:
        all_ = np.sort(np.concatenate(held)) if held else np.empty(0, dtype=np.uint64)
        new = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]])) if len(all_) else np.empty(0, dtype=np.int64)
        n = np.diff(np.append(new, len(all_)))
        return pa.RecordBatch.from_arrays([pa.array(signed(all_[new][n > 1])), pa.array(n[n > 1].astype(np.int64))], names=["h", "n"])

    for (texts,) in columns_of(batches, "text"):
        for t in texts:
            s = shingles(t, hashed)
            held.append(s)
            size += len(s)
            if size >= COUNTED:
                yield repeated()
                held, size = [], 0
    yield repeated()


class Order:
    """The global order of shingles: infrequent ones by hash, then the frequent ones by count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        by = np.argsort(hashes)
        self.hashes, self.counts = hashes[by], counts[by]
        #: By the lowest bits: whether a frequent shingle has them. Most shingles are told apart by this alone.
        self.low = np.zeros(LOW + 1, dtype=bool)
        self.low[hashes & np.uint64(LOW)] = True

    def prefix(self, s: np.ndarray) -> np.ndarray:
        p = prefix_size(len(s))
        maybe = np.flatnonzero(self.low[s & np.uint64(LOW)])
        if not len(maybe):
            return s[:p]
        at = np.minimum(np.searchsorted(self.hashes, s[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == s[maybe]
        frequent = maybe[hit]
        rare = np.delete(s, frequent)
        if len(rare) >= p:
            return rare[:p]
        by = np.argsort(self.counts[at[hit]], kind="stable")
        return np.concatenate([rare, s[frequent[by]][: p - len(rare)]])


def _described(batches: Iterator[pa.RecordBatch], order, postings: bool) -> Iterator[pa.RecordBatch]:
    """Documents with the fingerprints of their sets and of their groups; or the prefixes of groups, once per task."""
    hashed, posted = WordHash(), set()
    for ids, texts in columns_of(batches, "doc_id", "text"):
        rows: list[tuple] = []
        tokens: list[np.ndarray] = []
        for i, t in zip(ids, texts, strict=True):
            s = shingles(t, hashed)
            if not len(s):
                if not postings:
                    rows.append((i, 0, None, None, None))
                continue
            p = order.value.prefix(s)
            group = int.from_bytes(hashlib.blake2b(p.tobytes() + len(s).to_bytes(8), digest_size=8).digest(), signed=True)
            if not postings:
                f = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                rows.append((i, len(s), group, int.from_bytes(f[:8], signed=True), int.from_bytes(f[8:], signed=True)))
            elif group not in posted:
                if len(posted) >= 500_000:
                    posted.clear()
                posted.add(group)
                tokens.append(p)
                rows.append((group, len(s), len(p)))
        if postings:
            k = [r[2] for r in rows]
            group = np.repeat(np.array([r[0] for r in rows], dtype=np.int64), k)
            at = np.concatenate([np.arange(x) for x in k]) if k else np.empty(0)
            token = signed(np.concatenate(tokens)) if k else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(group), pa.array(at.astype(np.int32))], names=["token", "grp", "at"])
        else:
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "n_shingles", "grp", "f1", "f2"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashed = WordHash()
    for ids, texts in columns_of(batches, "doc_id", "text"):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([shingles(t, hashed).tobytes() for t in texts], pa.binary())], names=["doc_id", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose whole sets are similar enough."""
    for a, b, x, y in columns_of(batches, "a", "b", "x", "y"):
        stay = []
        for i, (p, q) in enumerate(zip(x, y, strict=True)):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            if DEN * both >= NUM * (len(p) + len(q) - both):
                stay.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in stay], pa.int64()) for c in (a, b)], names=["a", "b"])


def _cap(n: str, at: str, shared: int = 1) -> Column:
    """The greatest size of a set that may link with one of n by the shingle at this place of its prefix.

    Sets of n and m with an overlap of a share at least k of the first n - a + k shingles of the one and m - a + k of
    the other, for every k, and a is at least 3 (n + m) / 7 where they link.
    """
    return F.floor((NUM + DEN) * (F.col(n) - F.col(at) + shared - 1) / NUM) - F.col(n)


def _reaches(n: str, i: str, m: str, j: str, shared: int = 1) -> Column:
    return (F.col(m) <= _cap(n, i, shared)) & (F.col(n) <= _cap(m, j, shared))


def _two(n: str, m: str) -> Column:
    """Whether the posted prefixes of sets of n and m are long enough to ask for two shared shingles."""
    overlap = F.ceil(NUM * (F.col(n) + F.col(m)) / (NUM + DEN))
    return overlap + 1 - F.ceil(NUM * F.greatest(n, m) / DEN) >= 2


def _verified(pairs: DataFrame, plain: DataFrame) -> DataFrame:
    """The pairs that link. The sets of their documents go into a table bucketed by doc_id, so that joins move only pairs."""
    spark, name, n = plain.sparkSession, f"shingle_sets_{uuid.uuid4().hex}", spread(plain.sparkSession)
    pairs = written(pairs, "pairs")
    degree = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "degrees")
    hot = written(degree.filter(F.col("n") > SLICE).select("doc_id", F.ceil(F.col("n") / SLICE).cast("int").alias("slices")), "hot")
    found = with_ids(plain, degree).mapInArrow(_sets, "doc_id long, shingles binary")
    found.repartition(n, "doc_id").write.bucketBy(n, "doc_id").sortBy("doc_id").format("parquet").option("compression", "zstd").saveAsTable(name)
    try:
        both = _with_set(_with_set(pairs, spark.table(name), hot, "a", "x"), spark.table(name), hot, "b", "y")
        return written(both.mapInArrow(_linked, "a long, b long"), "links")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _with_set(pairs: DataFrame, sets: DataFrame, hot: DataFrame, end: str, name: str) -> DataFrame:
    """pairs with the set of the document at one end. A document of many pairs has them dealt to slices, with a copy of its set for each."""
    of = sets.select(F.col("doc_id").alias(end), F.col("shingles").alias(name))
    if hot.isEmpty():
        return pairs.join(of, end)
    slices = sent_if_few(hot).withColumnRenamed("doc_id", end)
    marked = pairs.join(slices, end, "left")
    cool = marked.filter("slices is null").drop("slices").join(of, end)
    dealt = marked.filter("slices is not null").withColumn("slice", F.pmod(F.xxhash64("a", "b"), "slices").cast("int")).drop("slices")
    copies = of.join(slices, end).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    return cool.unionByName(dealt.join(copies, [end, "slice"]).drop("slice"))


def _least_count(counts: DataFrame) -> int:
    """The least count that at most FREQUENT shingles reach."""
    total, least = 0, 1 << 62
    for n, k in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        total += k
        if total > FREQUENT:
            break
        least = n
    return least


def described(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row per document with its set's fingerprint; and the links (a, b), enough of them to keep all components whole."""
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = id_and_text(docs)
    counts = plain.select("text").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = written(counts, "counts")
    least = _least_count(counts)
    top = counts.filter(F.col("n") >= least).toArrow()
    order = spark.sparkContext.broadcast(Order(top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()))
    del top
    rows = written(plain.mapInArrow(partial(_described, order=order, postings=False), "doc_id long, n_shingles long, grp long, f1 long, f2 long"), "sets")
    members = written(rows.filter("doc_id is not null and f1 is not null").groupBy("grp", "n_shingles", "f1", "f2").agg(F.min("doc_id").alias("node")), "members")

    posts = plain.filter("doc_id is not null").mapInArrow(partial(_described, order=order, postings=True), "token long, grp long, at int")
    shared = _shared(posts, counts.filter(F.col("n") >= max(OFTEN, least)).select(F.col("h").alias("token")))
    size = members.groupBy("grp").agg(F.max("n_shingles").cast("int").alias("n"), F.count(F.lit(1)).alias("k"))
    groups = written(shared.groupBy("grp").agg(F.count(F.lit(1)).alias("posts")).join(size, "grp", "right").filter("posts is not null or k > 1").select("grp", "n", "k", (F.coalesce("posts", F.lit(0)) / F.col("n")).alias("w")), "groups")
    nodes = written(members.select("grp", "node").join(groups, "grp"), "nodes")
    links = _verified(_hubs(shared, nodes), plain)
    comp = written(components(links), "components")
    live = _open(shared.select("token", "grp", "at").unionByName(_own(groups)), nodes, comp)
    links = links.unionByName(_verified(_stars(live), plain))
    comp = written(components(links), "components")
    live = _open(live.select("token", "grp", "at").distinct(), nodes, comp)
    return rows, links.unionByName(_verified(_crossing(live), plain))


def _shared(posts: DataFrame, often: DataFrame | None = None) -> DataFrame:
    """The postings of shingles that two groups or more have, each with one of these as its hub.

    Most postings are of shingles that no other group has: they are shuffled once, by shingle. A shingle may also be in the
    prefixes of a third of all groups: those in `often` (FREQUENT at most) are aggregated, and joined back, so that Spark can split them.
    """
    marks = posts.sparkSession.createDataFrame([], "token long") if often is None else often
    marked = posts.join(F.broadcast(marks.withColumn("often", F.lit(True))), "token", "left")
    posts = written(marked.select("token", "grp", "at", F.coalesce("often", F.lit(False)).alias("often")), "posts")
    many = posts.filter("often").drop("often")
    hub = many.groupBy("token").agg(F.min("grp").alias("hub"), F.min_by("at", "grp").alias("hub_at"), F.max("grp").alias("hi")).filter("hub < hi")
    wide = written(many.join(hub.drop("hi"), "token"), "wide")
    few = _met(posts.filter("not often").drop("often"))
    shared = written(few.distinct().unionByName(wide.distinct()), "shared")  # a group's prefix is posted once for each task that met it
    for done in (posts, wide):
        dropped(done)
    return shared


def _met(posts: DataFrame) -> DataFrame:
    """The postings of shingles that two groups or more have, with their hubs, by one shuffle."""
    of = Window.partitionBy("token")
    met = posts.select("token", "grp", "at", F.min("grp").over(of).alias("hub"), F.max("grp").over(of).alias("hi")).filter("hub < hi").drop("hi")
    return met.withColumn("hub_at", F.min(F.when(F.col("grp") == F.col("hub"), F.col("at"))).over(of))


def _own(groups: DataFrame) -> DataFrame:
    """A posting of its own for each group of several members: they share its whole prefix."""
    return groups.filter("k > 1").select(F.xxhash64("grp").alias("token"), "grp", F.lit(0).alias("at"))


def _pair(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _hubs(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first stars: members with a member of each hub that they share enough shingles with, or of their own group."""
    one = written(nodes.groupBy("grp").agg(F.min("node").alias("hub_node"), F.max("n").alias("n")), "hubs")
    few = sent_if_few(one)
    met = shared.filter("grp <> hub").join(few.select("grp", "n"), "grp").join(few.select(F.col("grp").alias("hub"), F.col("n").alias("hub_n"), "hub_node"), "hub").filter(_reaches("n", "at", "hub_n", "hub_at", 2))
    enough = met.groupBy("grp", "hub_node", "n", "hub_n").agg(F.count(F.lit(1)).alias("k")).filter((F.col("k") >= 2) | ~_two("n", "hub_n"))
    pairs = enough.select("grp", "hub_node").join(nodes, "grp")
    own = nodes.filter("k > 1").join(one.select("grp", "hub_node"), "grp").filter("node <> hub_node")
    return pairs.select(*_pair("node", "hub_node")).unionByName(own.select(*_pair("node", "hub_node"))).distinct()


def _open(posted: DataFrame, nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """The postings, by member with its component, of shingles whose members don't all hang together yet."""
    known = written(nodes.join(comp, "node", "left").select("grp", "node", "n", "w", F.coalesce("component", "node").alias("c")), "placed")
    wide = written(posted.join(sent_if_few(known), "grp"), "wide")
    mixed = wide.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("token")
    return written(wide.join(mixed, "token", "left_semi"), "open")


def _stars(live: DataFrame) -> DataFrame:
    """The second stars: for each shingle and range of sizes, the member with the largest part of shared shingles."""
    full = live.withColumn("range", F.floor(F.log(F.col("n") + F.lit(0.5)) / F.log(F.lit(DEN / NUM))))
    best = F.max(F.struct("w", F.col("node").alias("hub"), F.col("c").alias("hub_c"), F.col("n").alias("hub_n"), F.col("at").alias("hub_at")))
    hub = full.groupBy("token", "range").agg(best.alias("x")).select("token", "range", "x.hub", "x.hub_c", "x.hub_n", "x.hub_at")
    near = full.join(hub, ["token", "range"]).filter((F.col("hub_c") != F.col("c")) & _reaches("n", "at", "hub_n", "hub_at", 2))
    met = near.groupBy("hub", "node", "grp", "n", "hub_n").agg(F.count(F.lit(1)).alias("k"), F.bool_or(F.col("token") == F.xxhash64("grp")).alias("own"))
    return met.filter((F.col("k") >= 2) | F.col("own") | ~_two("n", "hub_n")).select(*_pair("hub", "node")).distinct()


def _band(n: str | Column) -> Column:
    """Sizes in steps of a tenth."""
    return F.floor(F.log(n + F.lit(0.5)) / F.log(F.lit(1.1))).cast("int")


def _crossing(live: DataFrame) -> DataFrame:
    """Every pair of members that share a prefix shingle, may be similar and lie in different components.

    Shingles are joined with the pairs of components that meet there, so the pairs within a component are never made;
    pairs of groups pass the filters before they are expanded to members. Members meet by shingle and band of sizes: one
    looks for another in the bands that its place in the prefix lets it reach, and only where one of them reaches it as
    well. Documents that share a common part and are too long to link by it (a head of a site's pages) so never meet.
    The bands of a shingle are one row, so what sees nobody is left out where it is read; that holds for both ends of a
    pair, as similar sets see each other.
    """
    two, least = _cap("n", "at", 2), F.ceil(NUM * F.col("n") / DEN)
    seen = live.select("token", "c", "grp", "n", _cap("n", "at").alias("one"), two.alias("two"), _band(F.col("n")).alias("band"))
    there = seen.groupBy("token", "band").agg(F.min("n").alias("lo"), F.max("two").alias("hi"), F.min("c").alias("c_lo"), F.max("c").alias("c_hi"))
    bands = there.groupBy("token").agg(F.collect_list(F.struct(*there.columns[1:])).alias("bands"))
    meets = lambda b: b["band"].between(_band(least), _band(F.col("two"))) & (b["lo"] <= F.col("two")) & (b["hi"] >= F.col("n")) & ((b["c_lo"] != F.col("c")) | (b["c_hi"] != F.col("c")))
    near = seen.filter(F.col("two") >= least).join(bands, "token").withColumn("see", F.transform(F.filter("bands", meets), lambda b: b["band"])).drop("bands")
    groups = written(near.filter(F.size("see") > 0).distinct(), "near")
    x = groups.select("token", F.explode("see").alias("band"), F.col("c").alias("c_x"), "n", "two").groupBy("token", "band", "c_x").agg(F.min("n").alias("least_x"), F.max("two").alias("cap_x"))
    y = groups.groupBy("token", "band", F.col("c").alias("c_y")).agg(F.min("n").alias("least_y"), F.max("two").alias("cap_y"))
    apart = x.join(y, ["token", "band"]).filter((F.col("c_x") < F.col("c_y")) & (F.col("least_x") <= F.col("cap_y")) & (F.col("least_y") <= F.col("cap_x")))
    p, q = (groups.select("token", *[F.col(k).alias(f"{k}_{s}") for k in ("c", "grp", "n", "one", "two")], *(["band"] if s == "y" else [])) for s in "xy")
    met = apart.select("token", "band", "c_x", "c_y", "least_y", "cap_y").join(p, ["token", "c_x"]).filter("n_x <= cap_y AND least_y <= two_x")
    met = met.join(q, ["token", "band", "c_y"]).filter("n_x <= two_y AND n_y <= two_x")
    first = F.count_if((F.col("n_x") <= F.col("one_y")) & (F.col("n_y") <= F.col("one_x")))
    met = met.groupBy("grp_x", "grp_y", "c_x", "c_y", "n_x", "n_y").agg(F.count(F.lit(1)).alias("k"), first.alias("first"))
    able = met.filter(F.when(_two("n_x", "n_y"), F.col("k") >= 2).otherwise(F.col("first") >= 1) | (F.col("grp_x") == F.col("grp_y"))).select("grp_x", "grp_y", "c_x", "c_y")
    member = live.select("grp", "c", "node").distinct()
    u, v = (member.select(F.col("grp").alias(f"grp_{s}"), F.col("c").alias(f"c_{s}"), F.col("node").alias(k)) for s, k in (("x", "p"), ("y", "q")))
    return able.join(u, ["grp_x", "c_x"]).join(v, ["grp_y", "c_y"]).select(*_pair("p", "q")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, links = described(docs)
    one = rows.filter("doc_id is not null and f1 is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"))
    comp = components(links)
    root = one.join(comp, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("root"))
    return rows.join(root, ["f1", "f2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that link, directly or not, to one with a smaller doc_id; rows without doc_id stay."""
    gone = sent_if_few(written(classes(docs).filter("component_id < doc_id").select("doc_id").distinct(), "gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


ORACLE_OP2 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, m.root AS component_id
FROM documents d LEFT JOIN c USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) m USING (doc_id)
"""
