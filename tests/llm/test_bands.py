"""Buckets of many unlike sets."""

from __future__ import annotations

import glob
import random

from quernstone.llm import fingerprints as P
from quernstone.llm import jaccard, line_dedup


def test_unlike_sets_of_a_bucket_take_few_rounds_and_lose_no_link(spark, monkeypatch):
    rounds, write = [], P.written
    monkeypatch.setattr(P, "written", lambda df, name: (rounds.append(name), write(df, name))[1])
    # sets of three classes of two in one bucket, and thirty that are like nothing
    sets = [(i, [7], [100 * i + k for k in range(8)]) for i in range(30)] + [(30 + i, [7], [100 * (i % 3) + k for k in range(9)]) for i in range(6)]
    links = P.band_links(write(spark.createDataFrame(sets, "id long, bands array<long>, tokens array<long>"), "sets"))
    near = {frozenset((x.a, x.b)) for x in links.collect()}
    assert near >= {frozenset((i % 3, 30 + i)) for i in range(6)} and all(a % 30 % 3 == b % 30 % 3 for a, b in near)
    assert rounds.count("followers") <= 5


def test_only_members_that_see_another_are_taken_on(spark, monkeypatch):
    made, write = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name, *a: made.setdefault(name, write(df, name, *a)))
    alone = [(1, 100 + i, 0, 100 + i, 40 * 2**i, 1.0, 100 + i) for i in range(10)]  # of one shingle, but too unlike in size
    live = spark.createDataFrame([*alone, (1, 7, 0, 7, 43, 1.0, 7)], "token long, grp long, at int, node long, n int, w double, c long")
    pairs = {(r.a, r.b) for r in jaccard._crossing(live).collect()}
    assert {r.grp for r in made["near"].collect()} == {7, 100} and pairs <= {(7, 100)}


def test_postings_go_when_they_are_read(spark):
    posts = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 1, 1)], "token long, grp long, at int")
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/*/*/part-*"))
    assert jaccard._shared(posts).count() == 2
    assert {f.split("/")[-2] for f in set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/*/*/part-*")) - before} == {"shared"}


def test_postings_of_rare_shingles_are_shuffled_once(spark):
    rng = random.Random(7)
    posts = [(t, rng.randrange(6), rng.randrange(3)) for t in range(40) for _ in range(rng.choice([1, 1, 2, 5]))]
    posts = list({(t, g): (t, g, a) for t, g, a in posts}.values())
    of = {t: sorted((g, a) for u, g, a in posts if u == t) for t, _, _ in posts}
    want = {(t, g, a, *of[t][0]) for t, g, a in posts if len(of[t]) > 1}
    table = spark.createDataFrame(posts + posts[::3], "token long, grp long, at int")  # some are posted by two tasks
    for often in ([], [1, 2, 3], range(40)):
        shared = jaccard._shared(table, spark.createDataFrame([(t,) for t in often], "token long"))
        rows = [tuple(r) for r in shared.select("token", "grp", "at", "hub", "hub_at").collect()]
        assert len(rows) == len(want) and set(rows) == want
    plan = jaccard._met(table).distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_texts_are_not_shuffled_where_few_documents_change(spark, monkeypatch):
    text = "\n".join(f"line number {i} of this text has quite a few words" for i in range(20))
    docs = spark.createDataFrame([(1, text), (2, text + "\nand one more"), (3, "other words " * 40), (None, text)], "doc_id long, text string")
    joined = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(jaccard, "classes", lambda d: d.selectExpr("doc_id", "least(doc_id, 2) AS component_id").filter("doc_id is not null"))
    one = jaccard.keep_one_of_each(spark, docs, "")
    lines = line_dedup.kept_lines(docs)
    assert "rightHint=(strategy=broadcast)" in joined(one) and "rightHint=(strategy=broadcast)" in joined(lines)
    assert {r.doc_id for r in one.collect()} == {1, 2, None}
    sent = sorted(lines.select("doc_id", "_kept").collect(), key=str)
    monkeypatch.setattr(line_dedup, "SENT_IDS", 0)
    both = line_dedup.kept_lines(docs)
    assert "strategy=broadcast" not in joined(both)
    assert sorted(both.select("doc_id", "_kept").collect(), key=str) == sent
    assert {r.doc_id: len(r._kept) for r in sent} == {1: 20, 2: 1, 3: 1, None: 20}


def test_sets_in_buckets_are_not_shuffled_when_pairs_are_verified(spark, monkeypatch):
    plans, write = [], P.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString() if name == "links" else "")
        return write(df, name)

    monkeypatch.setattr(P, "written", seen)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = [(i, " ".join(f"w{i // 2}x{k}" for k in range(80)) + (" end" if i % 2 else "")) for i in range(12)]
        got = {r.doc_id: r.class_id for r in P.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {i: i - i % 2 for i in range(12)}
    told = [p for p in plans if p]
    assert told and all("SelectedBucketsCount" in p for p in told)
