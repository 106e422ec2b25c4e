"""Turtle: the syntax by hand, faults by line, and round trips."""

from __future__ import annotations

import random

import pytest

from quernstone.sources import scans
from quernstone.sources import turtle as T

SCHEMA = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"
R, X = T.RDF, T.XSD


def triples(text: str) -> list[tuple]:
    rows = T.parsed(text, "f")
    assert all(r[7] is None for r in rows), rows
    return [r[1:7] for r in rows]


def test_terms_and_literals():
    got = triples('''
        @prefix ex: <http://e/> . PREFIX : <#> @base <http://b/d/> .   # a comment
        ex:a a ex:T ; <p> "x\\n\\u00e9"@en-GB , 'y' , """long "quoted"
line""" , 1 , -2.5 , 1e3 , true ;; :q "5"^^ex:dt .
        <rel> ex:a\\,b ex:x.y . <http://abs> <../up> _:n1 .
    ''')
    assert got == [
        ("http://e/a", R + "type", "http://e/T", "iri", None, None), ("http://e/a", "http://b/d/p", "x\né", "literal", None, "en-GB"), ("http://e/a", "http://b/d/p", "y", "literal", None, None),
        ("http://e/a", "http://b/d/p", 'long "quoted"\nline', "literal", None, None), ("http://e/a", "http://b/d/p", "1", "literal", X + "integer", None), ("http://e/a", "http://b/d/p", "-2.5", "literal", X + "decimal", None),
        ("http://e/a", "http://b/d/p", "1e3", "literal", X + "double", None), ("http://e/a", "http://b/d/p", "true", "literal", X + "boolean", None), ("http://e/a", "#q", "5", "literal", "http://e/dt", None),
        ("http://b/d/rel", "http://e/a,b", "http://e/x.y", "iri", None, None), ("http://abs", "http://b/up", got[-1][2], "bnode", None, None),
    ]
    assert got[-1][2].endswith("_n1")


def test_blank_nodes_and_lists():
    got = [r[:3] for r in triples('<a> <p> [ <q> "v" ; <r> [] ] , ( 1 <b> ) . [ <x> <y> ] . [] <z> () . _:n <p> _:n .')]
    a, b, c, d, e, f, n = "_:8fa14cdd.1", "_:8fa14cdd.2", "_:8fa14cdd.3", "_:8fa14cdd.4", "_:8fa14cdd.5", "_:8fa14cdd.6", "_:8fa14cdd_n"
    assert sorted(got) == sorted([(a, "q", "v"), (a, "r", b), ("<a>"[1:-1], "p", a), (c, R + "first", "1"), (c, R + "rest", d), (d, R + "first", "b"), (d, R + "rest", R + "nil"), ("a", "p", c), (e, "x", "y"), (f, "z", R + "nil"), (n, "p", n)])


@pytest.mark.parametrize("text, fault", [("<a> <b> <c>", "line 1: '.' expected"), ("\n\n<a> <b> .", "line 3: an object"), ("x:a <b> <c> .", "line 1: no prefix 'x'"), ('<a> <b> "x\n" .', "line 1"), ("<a> <b> <c> ] .", "line 1: '.' expected"), ('<a> <b> "\\q" .', "line 1: no escape"), ("@prefix <x> .", "a prefix expected"), ('"a" <b> <c> .', "an IRI expected"), ("<a> <p> " + "[ <p> " * 3000 + "] " * 3000 + ".", "nested too deep"), ("<a> <b> \x00 .", "no token")])
def test_faults_name_the_line(text, fault):
    rows = T.parsed(text, "f")
    assert len(rows) == 1 and fault in rows[0][7] and rows[0][1] is None


def test_folder_with_a_corrupt_file(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.ttl").write_text("﻿<a> <p> _:n . <a> <p> <b> .")
    (tmp_path / "sub" / "b.ttl").write_text("<a> <p> <b> . _:n <p> 'x' .")
    (tmp_path / "c.ttl").write_text("<a> <p> <b> .\n<broken")
    (tmp_path / "d.txt").write_text("<no> <no> <no> .")
    (tmp_path / "e.ttl").write_text("")
    got, faults = T.turtle(spark, str(tmp_path))
    rows = got.collect()
    assert sorted(r.o for r in rows if not r.s.startswith("_:") and r.o_kind == "iri") == ["b"] and len(rows) == 3
    assert len({x for r in rows for x in (r.s, r.o) if x.startswith("_:")}) == 2  # a blank node for each file
    assert [(r.file.rsplit("/", 1)[1], r.fault) for r in faults.collect()] == [("c.ttl", "line 2: '<broken' is no token")]
    none, faults = T.turtle(spark, str(tmp_path / "missing"))
    assert none.count() == 0 and faults.count() == 0 and none.columns == got.columns


def test_round_trip_with_ntriples(spark, tmp_path):
    r = random.Random(2)
    strings = ['a "b"', "line\nbreak\r\t", "back\\slash", "", "é😀", "'", "<x>", "tab\u0001"]
    names = ["http://e/a", "http://e/a b", "http://e/b#c", "urn:x", "_:n1", "_:n2"]
    rows = set()
    for _ in range(300):
        o = r.choice([(r.choice(names), None), (r.choice(strings), "literal")])
        kind = o[1] or ("bnode" if o[0].startswith("_:") else "iri")
        tail = r.choice([(None, None), (X + "date", None), (None, "en")]) if kind == "literal" else (None, None)
        rows.add((r.choice(names), r.choice(names[:4]), o[0], kind, *tail))
    df = spark.createDataFrame(sorted(rows, key=str), SCHEMA).repartition(5)
    T.write_turtle(df, str(tmp_path / "t"), {"e": "http://e/", "xsd": X})
    got, faults = T.turtle(spark, str(tmp_path / "t"), files=T.WRITTEN)
    assert faults.count() == 0 and {tuple(x) for x in got.collect()} == rows
    plain = df.filter("NOT s LIKE '% %' AND NOT p LIKE '% %' AND NOT o RLIKE '[\\\\n\\\\r]'")
    scans.write_ntriples(plain, str(tmp_path / "n"))
    T.write_turtle(plain, str(tmp_path / "m"))
    assert {tuple(x) for x in scans.ntriples(spark, str(tmp_path / "n")).collect()} == {tuple(x) for x in T.turtle(spark, str(tmp_path / "m"), files=T.WRITTEN)[0].collect()}
