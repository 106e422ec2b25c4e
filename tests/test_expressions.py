"""Class expressions: every pattern to triples and back, and what can't be said."""

import itertools
import json
import random

from pyspark.sql import functions as F

from quernstone.plans import expressions as X

NS = "http://n/"


def criteria(spark, patterns):
    return spark.createDataFrame([(i, f"{NS}T{i}", p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(patterns)], "id long, target string, pattern string").withColumn("x", F.lit("clash"))


def test_round_trip_is_the_identity(spark):
    r = random.Random(1)
    name = lambda: r.choice(["A", "B", "C_d", NS + "E", "http://far/F"])
    patterns = []
    for _ in range(12):
        patterns += [
            {"op": "some_values_from", "property": name(), "filler_class": r.choice(["A", NS + "B"])}, {"op": "class_membership", "property": "p", "classes": [name() for _ in range(r.randrange(1, 7))]},
            {"op": "datatype_facet", "property": "q", "cmp": r.choice(list(X.FACETS)), "value": r.randrange(-5, 99)}, {"op": "boolean_has_value", "property": name(), "value": r.random() < 0.5}, {"op": "external_alignment", "property": "p", "alignment": "http://far/Z"},
        ]
    full = lambda n: n if n is None or ":" in n else NS + n
    text = lambda v: None if v is None else str(v).lower()
    want = sorted(((f"{NS}T{i}", p["op"], full(p["property"]), full(p.get("filler_class")), [full(c) for c in p["classes"]] if "classes" in p else None, p.get("cmp"), text(p.get("value")), p.get("alignment")) for i, p in enumerate(patterns)), key=str)
    c = criteria(spark, patterns)
    triples = X.class_expressions(c, NS)
    noise = spark.createDataFrame([(f"{NS}T0", X.OWL + "equivalentClass", "http://far/Same", "iri", None), ("_:z", X.RDF + "first", "q", "iri", None)], "s string, p string, o string, o_kind string, o_datatype string")
    got = X.patterns_of(triples.unionByName(noise).orderBy(F.rand(3)), NS).collect()
    assert sorted((tuple(x) for x in got), key=str) == want and X.unsaid(c, NS).count() == 0
    assert len({tuple(t) for t in triples.collect()}) == triples.count()


def test_what_cannot_be_said(spark):
    patterns = [None, "{broken", {}, {"op": "and", "operands": []}, {"op": "literal_eq", "key": "x"}, {"op": "datatype_facet", "property": "p", "cmp": "eq", "value": 3}, {"op": "datatype_facet", "property": "p", "cmp": "gt", "value": "x"}, {"op": "some_values_from", "property": "p"}, {"op": "some_values_from", "filler_class": "A"}, {"op": "class_membership", "property": "p", "classes": []}, {"op": "boolean_has_value", "property": "p", "value": "maybe"}, {"op": "external_alignment", "property": "p"}]
    c = criteria(spark, patterns)
    assert [(r.id, r.fault) for r in X.unsaid(c, NS).orderBy("id").collect()] == list(zip(itertools.count(), ["no pattern"] * 3 + ["outside the vocabulary"] * 2 + ["no facet"] + ["incomplete"] * 6, strict=False))
    assert X.class_expressions(c, NS).count() == 0 and X.patterns_of(X.class_expressions(c, NS), NS).count() == 0
