"""Operators that SQL can't express, against plain Python; and edge cases of the others."""

import difflib

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import alignment, graph, lifecycle, relational, similarity, spans
from quernstone.streaming import changes


def test_coalesced_sentences(spark):
    def brute(pieces):
        done, now = [], ""
        for p in pieces:
            now += p
            if len(now) >= 8:
                done, now = [*done, now], ""
        if now and done:
            done[-1] += now
        elif now:
            done = [now]
        return done

    rows = [["ab.", "cdefghij.", "k."], ["a."], [], ["12345678.", "b", "c"], ["x" * 9, "y" * 9]]
    d = spark.createDataFrame([(r,) for r in rows], "s array<string>")
    assert [r[0] for r in d.select(T.coalesced(F.col("s"))).collect()] == [brute(r) for r in rows]


def test_greedy_spans(spark):
    rows = [[(0, 5, "a", 0.5), (3, 8, "b", 0.9), (8, 9, "c", 0.1), (0, 3, "d", 0.5)], [], [(1, 2, "x", 0.5), (1, 2, "y", 0.5)]]
    d = spark.createDataFrame([(r,) for r in rows], f"s array<{spans.SPAN}>")
    got = [[(x.start, x.end, x.label) for x in r[0]] for r in d.select(spans.greedy(F.col("s"))).collect()]
    assert got == [[(0, 3, "d"), (3, 8, "b"), (8, 9, "c")], [], [(1, 2, "x")]]


def test_elementary_segments(spark):
    d = spark.createDataFrame([([(0, 10), (10, 20)], [(5, 12)])], "r array<struct<start:int,end:int>>, s array<struct<start:int,end:int>>")
    got = [tuple(x) for x in d.select(spans.elementary(F.col("r"), F.col("s"))).first()[0]]
    assert got == [(0, 5, 1, 0), (5, 10, 1, 1), (10, 12, 2, 1), (12, 20, 2, 0)]


def test_lexical_alignment(spark):
    c = spark.createDataFrame([("i1", "aspirin", 1), ("x", "aspirine", 1), ("y", "zzz", 1), ("z", "ibuprofen", 2)], "id string, name string, b int")
    e = spark.createDataFrame([("i1", "aspirin", 1, 0), ("i2", "aspirin B", 1, 1), ("i3", "ibuprofene", 2, 2)], "iri string, label string, b int, pos int")
    got = {r.id: (r.iri, round(r.score, 6)) for r in alignment.aligned(c, e, "b", 0.6).collect()}
    assert got == {"i1": ("i1", 1.0), "x": ("i1", round(difflib.SequenceMatcher(None, "aspirine", "aspirin").ratio(), 6)), "z": ("i3", round(difflib.SequenceMatcher(None, "ibuprofen", "ibuprofene").ratio(), 6))}


def test_closure_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    got = {(r.node, r.ancestor): r.depth for r in graph.ancestors(e).collect()}
    assert got[("d", "a")] == 1 and got[("d", "c")] == 3 and got[("a", "c")] == 2 and ("a", "a") not in got


def test_pattern_without_a_shared_variable_is_refused(spark):
    t = spark.createDataFrame([("a", "p", "b")], graph.TRIPLE)
    with pytest.raises(ValueError, match="cross product"):
        graph.matched(t, [("?x", "p", "?y"), ("?u", "p", "?v")], ["?x"])


@pytest.mark.parametrize(("arrivals", "versions"), [([1, 2], [1, 2]), ([2, 1], [2]), ([2, 2, 1], [2]), ([3, 1, 4, 4, 5], [3, 4, 5])])
def test_change_feed(spark, arrivals, versions):
    d = spark.createDataFrame([(1, i, v, "x") for i, v in enumerate(arrivals)], changes.CHANGE)
    assert [r.version for r in changes.accepted(d).orderBy("seq").collect()] == versions


def test_transitions(spark):
    d = spark.createDataFrame([(None, "effective"), (None, "superseded"), ("effective", "superseded"), ("rejected", "effective")], "a string, b string")
    assert [tuple(r[0]) for r in d.select(lifecycle.transition(F.col("a"), F.col("b"))).collect()] == [("effective", True), (None, False), ("superseded", True), ("rejected", False)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], changes.CHANGE)
    assert changes.accepted(none).count() == 0
    assert graph.ancestors(spark.createDataFrame([], "child string, parent string")).count() == 0
    assert relational.latest(none, "entity_id", ["version", "seq"]).count() == 0


def test_ntriples_round_trip(spark, tmp_path):
    from quernstone.sources import scans

    rows = [("http://a", "p", 'b "q" \\ x', "literal", "http://dt", None), ("_:b1", "p", "http://c", "iri", None, None), ("http://a", "q", "_:b1", "bnode", None, None), ("http://a", "l", "été", "literal", None, "fr")]
    d = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    scans.write_ntriples(d, str(tmp_path / "nt"))
    assert sorted(map(str, scans.ntriples(spark, str(tmp_path / "nt")).collect())) == sorted(map(str, d.collect()))


def test_cell_of_a_span_outside_all_cells(spark):
    d = spark.createDataFrame([([(0, 2, 5)], 9, 10), ([(0, 2, 5)], 2, 5)], "c array<struct<col:int,start:int,end:int>>, a int, b int")
    assert [r[0] for r in d.select(spans.cell_of(F.col("a"), F.col("b"), F.col("c"))).collect()] == [None, 0]


def test_audit_chain_runs_and_faults_are_found(spark):
    import hashlib

    from pyspark.sql import functions as F

    from quernstone.plans import text_queries as q

    log = spark.createDataFrame([(u, 10 * u + i, i, f"record {u} {i}") for u in (1, 2) for i in range(1, 7)], "user_id long, event_id long, seq long, record string")
    chain = q.chained(log).collect()
    last = {}
    for r in sorted(chain, key=lambda r: (r.user_id, r.seq)):
        before = last.get(r.user_id, q.GENESIS)
        last[r.user_id] = hashlib.sha256(f"{before}record {r.user_id} {r.seq}".encode()).hexdigest()
        assert (r.prev_hash, r.entry_hash) == (before, last[r.user_id])
    changed = q.chained(log.withColumn("record", F.when(F.col("event_id") == 12, "x").otherwise(F.col("record")))).collect()
    assert {r.event_id for r in set(changed) - set(chain)} == {12, 13, 14, 15, 16}
    stored = log.join(spark.createDataFrame(chain, q.CHAIN).drop("seq", "user_id"), "event_id")
    faults = lambda d: {(r.event_id, *r.faults) for r in q.chain_faults(d).collect()}
    assert faults(stored) == set()
    assert faults(stored.withColumn("record", F.when(F.col("event_id") == 12, "x").otherwise(F.col("record")))) == {(12, "entry")}
    assert faults(stored.filter("event_id <> 23")) == {(24, "seq", "prev"), (25, "seq"), (26, "seq")}
    assert faults(stored.withColumn("prev_hash", F.when(F.col("event_id") == 14, F.lit(None)).otherwise(F.col("prev_hash")))) == {(14, "prev", "entry")}


def test_classes_in_blocks_are_all_compared(spark, monkeypatch):
    from quernstone.operators import similarity

    rows = spark.createDataFrame([(i, [float(i % 5 + 1), float(i % 3), 1.0]) for i in range(20)], "id long, v array<double>")
    classes = spark.createDataFrame([(i, [float(i % 4 + 1), float(i % 7), 0.5]) for i in range(30)], "idx long, c array<double>")
    want = sorted(map(tuple, similarity.top_classes(rows, "v", classes, "c", "id", 4, "idx").select("id", "idx", "rank").collect()))
    n = similarity.scored(rows, "v", classes, "c").count()
    monkeypatch.setattr(similarity, "SMALL", 7)
    assert sorted(map(tuple, similarity.top_classes(rows, "v", classes, "c", "id", 4, "idx").select("id", "idx", "rank").collect())) == want
    assert similarity.scored(rows, "v", classes, "c").count() == n == 600


def test_closure_of_a_long_chain(spark):
    from quernstone.operators import graph

    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(66)] + [("66", "0")], "child string, parent string")
    assert graph.ancestors(chain.filter("child <> '66'")).filter("node = '0'").count() == 66


def test_patterns_join_in_whatever_order(spark):
    from quernstone.operators import graph

    t = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c"), ("c", "r", "d")], graph.TRIPLE)
    asked = [("?x", "p", "?y"), ("?z", "r", "?w"), ("?y", "q", "?z")]
    assert list(map(tuple, graph.matched(t, asked, ["?x", "?w"]).collect())) == [("a", "d")]


def test_flat_rules_agree_with_maps(spark):
    from quernstone.plans import rules
    from quernstone.plans.rules import Flat, value

    d = spark.createDataFrame([("NearClass", "x1", 3.0, True, "7"), (None, None, None, None, None), ("Other", "", 9.0, False, "abc")], "c string, r string, n double, b boolean, s string")
    maps = d.select("*", F.filter(F.array("c"), lambda x: x.isNotNull()).alias("classes"), F.map_filter(F.create_map(F.lit("r"), F.array("r")), lambda k, v: v[0].isNotNull()).alias("relations"), F.create_map(F.lit("n"), value(d=F.col("n")), F.lit("b"), value(b=F.col("b"))).alias("data_values"), F.from_json(F.lit("{}"), "map<string,array<string>>").alias("alignments"), F.create_map(F.lit("s"), value(s=F.col("s"))).alias("scalars"))
    flat = Flat([F.col("c")], {("relations", "r"): [F.col("r")]}, {("data", "n"): {"d": F.col("n")}, ("data", "b"): {"b": F.col("b")}, ("scalars", "s"): {"s": F.col("s")}})
    one = [
        {"op": "class_present", "class": "Class"}, {"op": "some_values_from", "property": "r", "filler_class": "x"}, {"op": "class_membership", "property": "r", "classes": ["y", "1"]}, {"op": "external_alignment", "property": "r", "alignment": "x"},
        {"op": "datatype_facet", "property": "n", "cmp": "ge", "value": 4}, {"op": "datatype_facet", "property": "none", "cmp": "ge", "value": 4}, {"op": "boolean_has_value", "property": "b", "value": True}, {"op": "boolean_has_value", "property": "n", "value": True},
        {"op": "literal_eq", "key": "s", "value": "abc"}, {"op": "literal_cmp", "key": "s", "cmp": "gt", "value": 5}, {"op": "literal_cmp", "key": "s", "cmp": "ne", "value": "abc"}, {"op": "literal_eq", "key": "none", "value": 1},
    ]
    patterns = one + [{"op": "and", "operands": one[:3]}, {"op": "or", "operands": one[4:]}]
    for r in maps.select(*[F.struct(rules.compiled(p).alias("a"), flat.compiled(p).alias("b")).alias(f"p{i}") for i, p in enumerate(patterns)]).collect():
        for i, p in enumerate(patterns):
            assert r[i].a == r[i].b, p


def test_templates_are_checked():
    from quernstone.operators.coverage import Slot, checked

    for bad in ([Slot("1", "g", "fields", "a", "extraction", selector="")], [Slot("1", "g", "fields", "a", "manual")] * 2, [Slot("1", "g", "equipment_table", "a", "extraction", selector="relation", name="x")], [Slot("1", "g", "odd", "a", "manual")]):
        with pytest.raises(ValueError):
            checked(bad)


def test_coverage_without_rules_or_edges(spark):
    from quernstone.operators import coverage

    docs, edges = coverage.order_edges(spark, "/root/testdata/sf0.001")
    out = coverage.coverage(docs.limit(1).drop("o_orderpriority"), edges.limit(0), coverage.TEMPLATE, []).collect()
    assert {r.slot_id: r.status for r in out} == {"head.title": "filled", "head.code": "missing_required", "head.amount": "missing_required", "head.tax": "blank_optional", "head.returned": "blank_optional", "devices.id": "missing_required", "devices.tax": "blank_optional", "risk.__no_rules__": "missing_required", "notes.remark": "manual", "notes.more": "manual"}


def test_offsets_and_text_of_awkward_inputs(spark):
    from quernstone.functions import text as T

    d = spark.createDataFrame([("反应釜 AB-1.2/x %",), ("",), (None,), (" \t",)], "t string")
    rows = d.select(T.tokens_with_offsets(F.col("t")).alias("x")).collect()
    assert [tuple(x) for x in rows[0].x] == [("反", 0, 1), ("应", 1, 2), ("釜", 2, 3), ("AB-1.2/x", 4, 12), ("%", 13, 14)] and rows[1].x == [] and rows[2].x is None and rows[3].x == []
    assert T.column_like({"Code": "x", "编号": "y"}, "id", "编号") == "y" and T.column_like({}, "id", "编号") is None


def test_tampered_logs_are_found(spark):
    from quernstone.plans import text_queries as Q

    log = spark.createDataFrame([(1, i, i, f"r{i}") for i in range(1, 6)], "user_id long, event_id long, seq long, record string")
    stored = Q.chained(log).join(log.select("event_id", "record"), "event_id")
    assert Q.chain_faults(stored).count() == 0
    faults = lambda d: {(r.seq, tuple(r.faults)) for r in Q.chain_faults(d).collect()}
    assert faults(stored.withColumn("record", F.when(F.col("seq") == 2, "new").otherwise(F.col("record")))) == {(2, ("entry",))}
    assert faults(stored.withColumn("prev_hash", F.when(F.col("seq") == 3, "0").otherwise(F.col("prev_hash")))) == {(3, ("prev", "entry"))}
    assert faults(stored.filter("seq <> 3")) == {(4, ("seq", "prev")), (5, ("seq",))}
