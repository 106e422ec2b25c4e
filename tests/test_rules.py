"""The truth tables of the rule algebra, and its validation."""

import json

import pytest
from pyspark.sql import functions as F

from quernstone.functions import numeric, ternary
from quernstone.plans import rules


def facts(spark, **parts):
    row = {"classes": [], "relations": {}, "data_values": {}, "alignments": {}, "scalars": {}} | parts
    return spark.createDataFrame([(json.dumps(row),)], "j string").select(F.from_json("j", rules.FACTS.replace(":", ":")).alias("f")).select("f.*")


def value(x):
    return {"b": x} if isinstance(x, bool) else {"d": x} if isinstance(x, int | float) else {"s": x}


def truth(spark, pattern, **parts):
    rules.validate(pattern)
    return facts(spark, **parts).select(rules.compiled(pattern).alias("x")).first()[0]


CASES = [
    ({"op": "some_values_from", "property": "p", "filler_class": "Tox"}, {"relations": {"p": ["x#Toxic"]}}, True),
    ({"op": "some_values_from", "property": "p", "filler_class": "Tox"}, {"relations": {"p": ["x#Mild"]}}, None),
    ({"op": "some_values_from", "property": "p", "filler_class": "Tox"}, {}, None),
    ({"op": "class_membership", "property": "p", "classes": ["A", "B"]}, {"relations": {"p": ["B"]}}, True),
    ({"op": "class_membership", "property": "p", "classes": ["A", "B"]}, {"relations": {"p": ["C"]}}, None),
    ({"op": "external_alignment", "property": "p", "alignment": "Z"}, {"alignments": {"p": ["Z1"]}}, True),
    ({"op": "external_alignment", "property": "p", "alignment": "Z"}, {"alignments": {}}, None),
    ({"op": "class_present", "class": "A"}, {"classes": ["xA"]}, True),
    ({"op": "class_present", "class": "A"}, {"classes": ["B"]}, False),
    ({"op": "class_present", "class": "A"}, {"classes": []}, None),
    ({"op": "datatype_facet", "property": "p", "cmp": "ge", "value": 3}, {"data_values": {"p": value(3)}}, True),
    ({"op": "datatype_facet", "property": "p", "cmp": "ge", "value": 3}, {"data_values": {"p": value("2.5")}}, False),
    ({"op": "datatype_facet", "property": "p", "cmp": "ge", "value": 3}, {"data_values": {"p": value("many")}}, None),
    ({"op": "datatype_facet", "property": "p", "cmp": "ge", "value": 3}, {}, None),
    ({"op": "boolean_has_value", "property": "p", "value": True}, {"data_values": {"p": value("false")}}, True),
    ({"op": "boolean_has_value", "property": "p", "value": False}, {"data_values": {"p": value(0)}}, True),
    ({"op": "boolean_has_value", "property": "p", "value": False}, {}, None),
    ({"op": "literal_eq", "key": "k", "value": "a"}, {"scalars": {"k": value("a")}}, True),
    ({"op": "literal_eq", "key": "k", "value": 1}, {"scalars": {"k": value(True)}}, True),
    ({"op": "literal_eq", "key": "k", "value": "a"}, {"scalars": {"k": value(1)}}, False),
    ({"op": "literal_eq", "key": "k", "value": "a"}, {}, None),
    ({"op": "literal_cmp", "key": "k", "cmp": "lt", "value": 5}, {"scalars": {"k": value(4)}}, True),
    ({"op": "literal_cmp", "key": "k", "cmp": "lt", "value": 5}, {"scalars": {"k": value("x")}}, None),
    ({"op": "literal_cmp", "key": "k", "cmp": "ne", "value": "x"}, {"scalars": {"k": value("y")}}, True),
    ({"op": "literal_cmp", "key": "k", "cmp": "eq", "value": "x"}, {"scalars": {"k": value("x")}}, True),
]


@pytest.mark.parametrize("case", CASES)
def test_operator(spark, case):
    pattern, parts, want = case
    assert truth(spark, pattern, **parts) is want


def test_kleene_tables(spark):
    d = spark.createDataFrame([(a, b) for a in (True, False, None) for b in (True, False, None)], "a boolean, b boolean")
    got = {(r.a, r.b): (r.x, r.y) for r in d.select("a", "b", ternary.all_of([F.col("a"), F.col("b")]).alias("x"), ternary.any_of([F.col("a"), F.col("b")]).alias("y")).collect()}
    for (a, b), (x, y) in got.items():
        assert x is (False if False in (a, b) else None if None in (a, b) else True)
        assert y is (True if True in (a, b) else None if None in (a, b) else False)


def test_aggregates_agree_with_lists(spark):
    d = spark.createDataFrame([(g, x) for g, xs in enumerate([[True, True], [True, None], [True, False, None], [False], [None]]) for x in xs], "g int, x boolean")
    got = {r.g: (r.a, r.o) for r in d.groupBy("g").agg(ternary.agg_all(F.col("x")).alias("a"), ternary.agg_any(F.col("x")).alias("o")).collect()}
    assert got == {0: (True, True), 1: (None, True), 2: (False, True), 3: (False, False), 4: (None, None)}


@pytest.mark.parametrize("bad", [[], {"op": "not"}, {"op": "and", "operands": []}, {"op": "literal_cmp", "key": "k", "cmp": "~", "value": 1}, {"op": "or", "operands": [{"op": "class_present"}]}, {"op": "class_membership", "property": "p", "classes": "A"}])
def test_validation_refuses(bad):
    with pytest.raises(ValueError, match=r"^\$"):
        rules.validate(bad)


def test_conflicts_and_lattice(spark):
    d = spark.createDataFrame([([True, False],), ([None, False],), ([],), ([True, None],)], "x array<boolean>")
    assert [tuple(r) for r in d.select(rules.dedication(F.col("x")), rules.dedication(F.col("x"), False)).collect()] == [(True, False), (False, False), (False, False), (True, True)]
    levels = spark.createDataFrame([(["Low", "High", "Odd"],), ([],), (["Odd"],)], "x array<string>")
    assert [r[0] for r in levels.select(rules.highest(F.col("x"), {"Low": 1, "High": 3})).collect()] == ["High", "Low", "Odd"]


def test_derivation_of_bands(spark):
    rows = [(2.0, "rat", 28, None, None, None), (2.0, "rat", 28, True, False, False), (2.0, "rat", 28, False, False, False), (None, "rat", 28, None, None, None)]
    d = spark.createDataFrame(rows, "noael double, species string, days int, g boolean, c boolean, r boolean")
    dose = numeric.pde(F.col("noael"), [numeric.species_factor(F.col("species")), F.lit(10.0), numeric.duration_factor(F.col("days")), F.lit(1.0)]) * 1000
    point = numeric.band(dose / 10)
    ends = [F.col("g"), F.col("c"), F.col("r")]
    floor = numeric.floor_band(*ends)
    got = [tuple(r) for r in d.select(dose, point, floor, numeric.recommended_band(point, floor, *ends)).collect()]
    assert got == [(200.0, 3, None, 4), (200.0, 3, 5, 5), (200.0, 3, None, 3), (None, None, None, None)]


def test_shared_line_matrix_and_edges(spark):
    from quernstone.plans import shared_line as S

    individuals, requests = S.matrix(spark)
    got = {r.case_id: r for r in S.assessed(individuals, requests).collect()}
    assert len(got) == len(S.CASES)
    for case, ids, dedicated, risk, scenarios, *_ in S.EXPECTED:
        r = got[case]
        assert (",".join(r.rule_ids), r.requires_dedication, r.risk_level, ",".join(r.scenarios)) == (ids, dedicated, risk, scenarios)
    # an ingredient that is missing, and two pieces of equipment that disagree
    odd = spark.createDataFrame([("d", ["http://x/DrugProduct"], {"hasActiveIngredient": ("gone", None, None, None), "dosageForm": (None, "powder", None, None)}), ("e1", [], {"isInCleanArea": (None, "true", None, None)}), ("e2", [], {})], S.INDIVIDUAL)
    asked = spark.createDataFrame([("a", "d", ["e1", "e2"]), ("b", "d", ["e1"]), ("c", "d", None), ("x", "unknown", [])], S.REQUEST)
    assert {r.case_id: (r.risk_level, r.rule_ids) for r in S.assessed(odd, asked).collect()} == {"a": ("HighRisk", ["R-CP2"]), "b": ("LowRisk", []), "c": ("LowRisk", [])}
    # the permissive policy: an explicit False vetoes
    assert S.assessed(individuals, requests, restrictive=False).filter("case_id = 'cytotoxic_noninactivatable_dedicate'").first().requires_dedication is True
    # an aligned ingredient makes a hormonal product
    horm = spark.createDataFrame([("d", ["http://x/DrugProduct"], {"hasActiveIngredient": ("i", None, None, None)}), ("i", [S.HORMONE], {})], S.INDIVIDUAL)
    r = S.assessed(horm, spark.createDataFrame([("h", "d", [])], S.REQUEST)).first()
    assert r.rule_ids == ["HormonalDrug-suff", "R-ED6", "R-SCe"]
