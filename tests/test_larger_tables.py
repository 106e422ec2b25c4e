"""Queries on tables larger, or with other keys, than the driver's smallest ones, against their SQL."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from quernstone import catalog
from quernstone.functions import text as T
from quernstone.operators import spans as S
from quernstone.operators import triple_query

AT = "/root/testdata/sf0.001"


def changed(tmp_path, **tables):
    """A folder of the driver's tables, some of them by a SELECT over all."""
    con = duckdb.connect()
    names = [f[: -len(".parquet")] for f in os.listdir(AT)]
    for t in names:
        con.execute(f"CREATE VIEW old_{t} AS SELECT * FROM '{AT}/{t}.parquet'")
    for t in names:
        con.execute(f"COPY ({tables.get(t, f'SELECT * FROM old_{t}')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    return str(tmp_path), con


def same_as_sql(spark, name, at, con):
    got = catalog.QUERIES[name](spark, at)
    want = con.execute(catalog.ORACLES[name])
    cols = [d[0] for d in want.description]
    return Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(want.fetchall())


def test_codes_of_keys_of_six_digits_are_whole(spark, tmp_path):
    at, con = changed(tmp_path, part="SELECT * REPLACE (p_partkey + 99850 AS p_partkey) FROM old_part")
    assert same_as_sql(spark, "text_codes", at, con)


def test_links_read_only_columns_that_refer(spark):
    found = catalog.QUERIES["schema_links"](spark, AT)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") <= found.count()


def test_releases_of_customers_whose_keys_are_those_of_suppliers_below_zero(spark, tmp_path):
    at, con = changed(tmp_path, customer="SELECT * REPLACE (c_custkey - 100 AS c_custkey) FROM old_customer")
    for name in ("release_rollback", "release_history"):
        assert same_as_sql(spark, name, at, con), name


def planned(spark, name):
    return catalog.QUERIES[name](spark, AT)._jdf.queryExecution().toString()


def test_a_small_file_of_dear_rows_is_dealt_to_several_tasks(spark):
    for name in ("span_greedy", "inline_split", "token_offsets"):
        assert catalog.QUERIES[name](spark, AT).rdd.getNumPartitions() > 1, name


def test_what_several_steps_read_is_made_once(spark):
    assert "part.parquet" not in planned(spark, "axioms_read")
    assert "lineitem.parquet" not in planned(spark, "grid_segments")


def test_a_product_is_put_to_the_rules_once_and_not_for_each_piece_of_equipment(spark):
    plan = planned(spark, "part_conclusions").split("== Optimized Logical Plan ==")[1]
    assert "map_concat" not in plan and not re.search(r"hashpartitioning\(l_partkey#\d+L?, l_suppkey#", plan)


def test_lines_are_counted_by_their_facts_before_rules_read_them(spark):
    plan = planned(spark, "rule_provenance").split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert -1 < plan.find("Generate explode") < plan.find("Aggregate [p_type")  # what comes first stands lower


def test_records_are_not_shuffled_by_slot_for_dismissals_and_fills(spark):
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, (slot_id|_base)#", planned(spark, "coverage_dismissals"))


def test_an_optional_that_is_only_asked_whether_it_is_bound_multiplies_nothing(spark):
    rows = [("n", "in", "r"), *[(f"s{i}", "at", "n") for i in range(20)], *[(f"s{i}", "balance", "5") for i in range(20)], *[("n", "debtor", f"c{i}") for i in range(30)]]
    t = spark.createDataFrame(rows, "s string, p string, o string")
    text = "SELECT DISTINCT ?r { ?s <at> ?n ; <balance> ?b . ?n <in> ?r OPTIONAL { ?n <debtor> ?c } FILTER (BOUND(?c) || ?b < 0) }"
    assert triple_query._solved(t, triple_query.parsed(text).where, told={"r"})[0].count() == 20
    assert [tuple(r) for r in triple_query.select(t, text).collect()] == [("r",)]


def test_tokens_are_the_same_however_few_are_objects_at_once(monkeypatch):
    texts = pa.array(["a b-c  d", None, "", "反应 x", "last one"])
    whole = T._offsets(texts)
    monkeypatch.setattr(T, "AT_ONCE", 3)
    assert T._offsets(texts).equals(whole) and len(whole) == 5 and whole[1].as_py() is None


def test_a_batch_of_many_texts_is_tokenised_in_parts(spark, monkeypatch):
    monkeypatch.setattr(T, "AT_ONCE", 10)
    texts = ["a b-c", "", None, "x" * 25, "反应 x", "last one"]
    batch = pa.record_batch({"i": list(range(6)), "text": pa.array(texts, pa.string())})
    parts = list(T._cut(batch, "text"))
    assert [p.num_rows for p in parts] == [3, 1, 1, 1] and pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    assert not list(T._cut(batch.slice(0, 0), "text"))
    assert "MapInArrow" in planned(spark, "token_offsets")


def test_greedy_spans_against_brute_force(spark):
    r = random.Random(3)
    cases = []
    for i in range(60):
        spans = {(s, s + r.randrange(1, 6), r.choice("ab"), r.choice([0.5, 0.7, 0.9])) for s in (r.randrange(40) for _ in range(r.randrange(14)))}
        cases.append((i, list(spans)))
    got = spark.createDataFrame(cases, "i int, s array<struct<start:int,end:int,label:string,score:double>>").select("i", S.greedy(F.col("s")).alias("s"))
    for row in got.collect():
        kept: list = []
        for x in sorted(cases[row.i][1], key=lambda x: (-x[3], *x)):
            if not any(y[0] < x[1] and x[0] < y[1] for y in kept):
                kept.append(x)
        assert [tuple(x) for x in row.s] == sorted(kept)
