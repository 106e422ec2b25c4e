"""The query language over triples: errors by place, and random queries against a plain search."""

from __future__ import annotations

import itertools
import random

import pytest

from quernstone.operators import triple_query as Q

TRIPLES = [
    ("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "a"), ("d", "knows", "d"), ("e", "knows", "a"), ("a", "age", "30"), ("b", "age", "4"), ("c", "age", "x"), ("d", "age", "30.0"),
    ("a", "name", 'An "a"'), ("b", "name", "Bo"), ("e", "name", "Bo"), ("a", Q.TYPE, "T"), ("e", Q.TYPE, "T"), ("http://p/x", "http://p/q", "a"),
]


@pytest.fixture(scope="module")
def triples(spark):
    return spark.createDataFrame(TRIPLES, "s string, p string, o string").cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT ?x { ?x a <T> }", [("a",), ("e",)]),
        ('SELECT ?x { ?x <name> "An \\"a\\"" }', [("a",)]),
        ("PREFIX p: <http://p/> SELECT * { p:x p:q ?y . ?y <knows> ?z }", [("a", "b")]),
        ("SELECT ?x ?y { ?x <knows>+ ?y FILTER (?x = <a>) }", [("a", "a"), ("a", "b"), ("a", "c")]),
        ("SELECT ?x { ?x <knows>+ ?x }", [("a",), ("b",), ("c",), ("d",)]),
        ("SELECT ?x { ?x <age> 30 }", [("a",)]),
        ("SELECT ?x { ?x <age> ?n FILTER (?n = 30) }", [("a",), ("d",)]),
        ("SELECT ?x { ?x <age> ?n FILTER (!(?n < 10)) }", [("a",), ("c",), ("d",)]),
        ("SELECT ?x ?n { ?x <knows> ?y OPTIONAL { ?x <name> ?n } }", [("a", 'An "a"'), ("b", "Bo"), ("c", None), ("d", None), ("e", "Bo")]),
        ("SELECT ?x { ?x <knows> ?y OPTIONAL { ?x <name> ?n } FILTER (!BOUND(?n)) }", [("c",), ("d",)]),
        ("SELECT ?x { ?x <knows> ?y OPTIONAL { ?x <name> ?n } FILTER (?n = \"Bo\") }", [("b",), ("e",)]),
        ("SELECT ?x ?y { { ?x <name> ?m } UNION { ?x a ?y } . ?x <knows> <a> }", [("e", "T"), ("e", None)]),
        ("SELECT ?x ?n { ?x <knows> ?y OPTIONAL { ?x <age> ?n FILTER (?n > 10 && ?y != <d>) } }", [("a", "30"), ("b", None), ("c", "x"), ("d", None), ("e", None)]),
        ("SELECT ?x { ?x a <T> . <a> <knows> <b> }", [("a",), ("e",)]),
        ("SELECT ?x { ?x a <T> . <b> <knows> <a> }", []),
        ("SELECT ?x { <a> <knows> <b> . ?x a <T> OPTIONAL { <z> <z> <z> } }", [("a",), ("e",)]),
        ("SELECT DISTINCT ?n { ?x <name> ?n } ORDER BY DESC(?n) LIMIT 1", [("Bo",)]),
        ("SELECT ?n { ?x <age> ?n } ORDER BY ?n LIMIT 3", [("30",), ("30.0",), ("4",)]),
        ("select ?x where { ?x <knows> ?y , <b> ; a <T> . FILTER (STRSTARTS(?y, \"b\") || REGEX(?x, \"^e\")) }", [("a",)]),
        ("SELECT ?z { ?x <knows> ?y OPTIONAL { ?x <name> ?z } ?y <name> ?z }", [("An \"a\"",)]),
    ],
)
def test_query_texts(triples, text, want):
    assert rows(Q.select(triples, text)) == sorted(want, key=str)
    assert Q.select(triples.limit(0), text).collect() == []


def test_order_is_by_number_then_text(triples):
    assert [r.col_0 for r in Q.select(triples, "SELECT ?n { ?x <age> ?n } ORDER BY ?n").collect()] == ["4", "30", "30.0", "x"]
    assert [r.col_0 for r in Q.select(triples, "SELECT ?n { ?x <age> ?n } ORDER BY DESC(?n) OFFSET 1").collect()] == ["30.0", "30", "4"]


@pytest.mark.parametrize(
    "text, place",
    [
        ("SELECT ?x { ?x <p> }", "at 19"), ("SELECT { ?x <p> ?y }", "at 7"), ("SELECT ?x { ?x <p> ?y", "at 21"), ("SELECT ?x { ?x ?p+ ?y }", "constant"), ("SELECT ?x { ?x <p> ?y } LIMIT x", "at 30"), ("SELECT ?z { ?x <p> ?y }", "in no pattern"),
        ("SELECT ?x { ?x <p> ?y FILTER ?x }", "comparison"), ("SELECT ?x { ?x <p> ?y . ?a <q> ?b }", "share no variable"), ("SELECT ?x { ?x <p> ~ }", "at 19"), ("SELECT ?x { }", "in no pattern"), ("SELECT ?x { OPTIONAL { ?x <p> ?y } }", "before it"), ("ASK { ?x <p> ?y }", "SELECT"),
        ("SELECT ?x { ?x <p> ?y } x", "the end"), ("PREFIX p <x> SELECT ?x { ?x <p> ?y }", "prefix"), ("SELECT * { <a> <b> <c> }", "without variables"),
    ],
)
def test_errors_name_the_place(triples, text, place):
    with pytest.raises(Q.QueryError, match=place):
        Q.select(triples, text)


def brute(triples, parts):
    """Solutions of triple patterns and of optional ones, by trying all triples in order of the parts."""
    sols = [{}]
    for optional, pattern in parts:
        out = []
        for sol in sols:
            hits = []
            for t in triples:
                new = dict(sol)
                for x, v in zip(pattern, t, strict=True):
                    if x.startswith("?"):
                        if new.setdefault(x, v) != v:
                            break
                    elif x != v:
                        break
                else:
                    hits.append(new)
            out += hits or ([sol] if optional else [])
        sols = out
    return sols


def test_random_patterns_against_a_search(spark):
    r = random.Random(3)
    nodes, names = [f"n{i}" for i in range(6)], ["p", "q", "r"]
    data = sorted({(r.choice(nodes), r.choice(names), r.choice(nodes)) for _ in range(40)})
    df = spark.createDataFrame(data, "s string, p string, o string").cache()
    for _ in range(12):
        parts, known = [], ["?a"]
        for i in range(r.randrange(1, 4)):
            new = f"?{'bcd'[i]}"
            ends = [r.choice(known), r.choice([new, new, r.choice(known), r.choice(nodes)])]
            r.shuffle(ends)
            optional = i > 0 and r.random() < 0.4
            if optional:
                ends = [known[0] if e not in (new,) else e for e in ends]
            parts.append((optional, (ends[0], r.choice(names), ends[1])))
            if not optional:
                known += [e for e in ends if e.startswith("?") and e not in known]
        term = lambda x: x if x.startswith("?") else f"<{x}>"
        body = " ".join(("OPTIONAL { %s } " if o else "%s . ") % " ".join(map(term, t)) for o, t in parts)
        names_ = sorted({x for _, t in parts for x in t if x.startswith("?")})
        if "?a" not in {x for x in parts[0][1]} or not names_:
            continue
        text = f"SELECT {' '.join(names_)} {{ {body} }}"
        want = sorted((tuple(s.get(v) for v in names_) for s in brute(data, parts)), key=str)
        assert rows(Q.select(df, text)) == want, text


def test_closure_against_a_walk(spark):
    r = random.Random(4)
    data = sorted({(f"n{r.randrange(9)}", "p", f"n{r.randrange(9)}") for _ in range(12)})
    reach = {(s, o) for s, _, o in data}
    for _ in range(9):
        reach |= {(a, d) for (a, b), (c, d) in itertools.product(reach, reach) if b == c}
    assert rows(Q.select(spark.createDataFrame(data, "s string, p string, o string"), "SELECT ?x ?y { ?x <p>+ ?y }")) == sorted(reach)
