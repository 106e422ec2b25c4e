"""Defined criteria as class expressions in triples, and back.

A criterion (id, target, pattern as JSON) becomes a restriction that its target class is equivalent to: blank nodes are named
by the criterion's id, so the same table gives the same triples. What the vocabulary can't say (combinations, = and !=, what
is no defined pattern) is listed, not guessed. The way back reads restrictions out of any triples by joins; lists are
followed by the closure of their rests, so their order and length don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.graph import ancestors
from quernstone.sources.shared import kept
from quernstone.sources.tables import dealt, table

#: The vocabulary of class expressions, and the facet of each comparison.
RDF, RDFS, OWL, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"
FACETS = {"gt": XSD + "minExclusive", "ge": XSD + "minInclusive", "lt": XSD + "maxExclusive", "le": XSD + "maxInclusive"}
SAID = ("some_values_from", "class_membership", "datatype_facet", "boolean_has_value", "external_alignment")
PATTERN = "struct<op:string,property:string,filler_class:string,classes:array<string>,cmp:string,value:string,alignment:string>"
TRIPLE = "struct<s:string,p:string,o:string,o_kind:string,o_datatype:string>"


def _triple(s: Column, p: str | Column, o: Column | str, kind: str = "iri", datatype: str | None = None) -> Column:
    whole = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(s.alias("s"), whole(p).alias("p"), whole(o).alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"))


def read_patterns(criteria: DataFrame, namespace: str) -> DataFrame:
    """criteria (id, target, pattern) with `x`, the pattern's fields, and `fault`: why it can't be said, NULL if it can. Names without a namespace are taken in the given one."""
    x = F.from_json("pattern", PATTERN)
    named = lambda c: F.when(c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), c).otherwise(F.concat(F.lit(namespace), c))
    d = criteria.withColumn("x", x)
    d = d.withColumn("x", F.struct(F.col("x.op").alias("op"), named(F.col("x.property")).alias("property"), named(F.col("x.filler_class")).alias("filler"), F.transform("x.classes", named).alias("classes"), F.col("x.cmp").alias("cmp"), F.col("x.value").alias("value"), F.col("x.alignment").alias("alignment")))
    op = F.col("x.op")
    lacks = (
        (op == "some_values_from") & F.col("x.filler").isNull() | (op == "class_membership") & F.coalesce(F.size("x.classes") <= 0, F.lit(True))
        | (op == "datatype_facet") & F.col("x.value").try_cast("bigint").isNull() | (op == "boolean_has_value") & ~F.coalesce(F.col("x.value").isin("true", "false"), F.lit(False)) | (op == "external_alignment") & F.col("x.alignment").isNull()
    )
    fault = F.when(op.isNull(), "no pattern").when(~op.isin(*SAID), "outside the vocabulary").when(F.col("x.property").isNull() | lacks, "incomplete")
    return d.withColumn("fault", fault.when((op == "datatype_facet") & ~F.coalesce(F.col("x.cmp").isin(*FACETS), F.lit(False)), "no facet"))


def class_expressions(criteria: DataFrame, namespace: str) -> DataFrame:
    """The triples (s, p, o, o_kind, o_datatype) of all criteria that can be said."""
    d = read_patterns(criteria, namespace).filter("fault IS NULL")
    root = F.concat(F.lit("_:c"), F.col("id").cast("string"))
    node = lambda tail: F.concat(root, F.lit(tail))
    op, x = F.col("x.op"), lambda name: F.col(f"x.{name}")
    on = [_triple(F.col("target"), OWL + "equivalentClass", root, "bnode"), _triple(root, RDF + "type", OWL + "Restriction"), _triple(root, OWL + "onProperty", x("property"))]
    some = lambda o, kind="iri": _triple(root, OWL + "someValuesFrom", o, kind)
    place = lambda i: F.concat(root, F.lit("l"), i.cast("string"))

    def cell(item: Column, i: Column) -> Column:
        last = i == F.size("x.classes") - 1
        rest = F.struct(place(i).alias("s"), F.lit(RDF + "rest").alias("p"), F.when(last, RDF + "nil").otherwise(place(i + 1)).alias("o"), F.when(last, "iri").otherwise("bnode").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))
        return F.array(_triple(place(i), RDF + "first", item), rest)

    members = F.concat(F.array(some(node("u"), "bnode"), _triple(node("u"), RDF + "type", OWL + "Class"), _triple(node("u"), OWL + "unionOf", node("l0"), "bnode")), F.flatten(F.transform("x.classes", cell)))
    facet = reduce(lambda c, kv: c.when(x("cmp") == kv[0], kv[1]), FACETS.items(), F.when(F.lit(False), ""))
    limited = F.array(
        some(node("d"), "bnode"), _triple(node("d"), RDF + "type", RDFS + "Datatype"), _triple(node("d"), OWL + "onDatatype", XSD + "integer"), _triple(node("f"), facet, x("value"), "literal", XSD + "integer"),
        _triple(node("d"), OWL + "withRestrictions", node("r"), "bnode"), _triple(node("r"), RDF + "first", node("f"), "bnode"), _triple(node("r"), RDF + "rest", RDF + "nil"),
    )
    own = (
        F.when(op == "some_values_from", F.array(some(x("filler")))).when(op == "class_membership", members).when(op == "datatype_facet", limited)
        .when(op == "boolean_has_value", F.array(_triple(root, OWL + "hasValue", x("value"), "literal", XSD + "boolean"))).otherwise(F.array(some(x("alignment"))))
    )
    return d.select(F.inline(F.concat(F.array(*on), own).cast(f"array<{TRIPLE}>")))


def unsaid(criteria: DataFrame, namespace: str) -> DataFrame:
    """(id, op, fault) of the criteria that class expressions can't say."""
    return read_patterns(criteria, namespace).filter("fault IS NOT NULL").select("id", F.col("x.op").alias("op"), "fault")


def patterns_of(triples: DataFrame, namespace: str) -> DataFrame:
    """(target, op, property, filler, classes, cmp, value, alignment) of every restriction that a class is equivalent to; a filler outside the namespace is an alignment."""
    triples = kept(triples.select("s", "p", "o"), "triples", by="p")  # made once, and each of the reads below takes its own predicates
    of = lambda p, name, *more: triples.filter(F.col("p") == p).select(F.col("s").alias("root" if name != "at" else "s"), F.col("o").alias(name), *more)
    roots = triples.filter(F.col("p") == OWL + "equivalentClass").select(F.col("s").alias("target"), F.col("o").alias("root"))
    base = roots.join(of(OWL + "onProperty", "property"), "root")
    first = triples.filter(F.col("p") == RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("item"))
    heads = triples.filter(F.col("p").isin(OWL + "unionOf", OWL + "withRestrictions")).select(F.col("s").alias("holder"), F.col("p").alias("list"), F.col("o").alias("head"))
    rests = triples.filter(F.col("p") == RDF + "rest").select(F.col("s").alias("child"), F.col("o").alias("parent"))
    reach = ancestors(rests).select(F.col("node").alias("head"), F.col("ancestor").alias("cell"), "depth").unionByName(heads.select("head", F.col("head").alias("cell"), F.lit(0).alias("depth")).distinct())
    items = heads.join(reach, "head").join(first, "cell").groupBy("holder", "list").agg(F.sort_array(F.collect_list(F.struct("depth", "item")))["item"].alias("items"))
    unions = items.filter(F.col("list") == OWL + "unionOf").select(F.col("holder").alias("some"), F.col("items").alias("classes"))
    cmp = reduce(lambda c, kv: c.when(F.col("p") == kv[1], kv[0]), FACETS.items(), F.when(F.lit(False), ""))
    facets = triples.filter(F.col("p").isin(*FACETS.values())).select(F.col("s").alias("facet"), cmp.alias("cmp"), F.col("o").alias("bound"))
    limits = items.filter(F.col("list") == OWL + "withRestrictions").select(F.col("holder").alias("some"), F.explode("items").alias("facet")).join(facets, "facet").drop("facet")
    d = base.join(of(OWL + "someValuesFrom", "some"), "root", "left").join(of(OWL + "hasValue", "has"), "root", "left").join(unions, "some", "left").join(limits, "some", "left")
    mine = F.startswith("some", F.lit(namespace))
    op = F.when(F.col("has").isNotNull(), "boolean_has_value").when(F.col("classes").isNotNull(), "class_membership").when(F.col("cmp").isNotNull(), "datatype_facet").when(mine, "some_values_from").otherwise("external_alignment")
    return d.select("target", op.alias("op"), "property", F.when(op == "some_values_from", F.col("some")).alias("filler"), "classes", "cmp", F.coalesce("has", "bound").alias("value"), F.when(op == "external_alignment", F.col("some")).alias("alignment"))


# queries: parts as criteria, whose brand is the property and whose type the class


NS = "http://x/onto/"


def _criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey"), F.col("p_size")
    word = F.substring_index("p_name", " ", 1)
    fields = lambda op, **more: F.to_json(F.struct(F.lit(op).alias("op"), F.translate("p_brand", "#", "_").alias("property"), *[v.alias(k) for k, v in more.items()]))
    pattern = (
        F.when(size <= 8, fields("some_values_from", filler_class=F.col("p_type"))).when(size <= 16, fields("class_membership", classes=F.array("p_type", word, F.col("p_type"))))
        .when(size <= 28, fields("datatype_facet", cmp=F.when(size <= 20, "gt").when(size <= 23, "le").when(size <= 26, "eq").otherwise("lt"), value=size)).when(size <= 36, fields("boolean_has_value", value=size > 30))
        .when(size <= 44, fields("external_alignment", alignment=F.concat(F.lit("http://y/"), "p_type"))).when(size <= 47, fields("and"))
    )
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit(NS + "T"), "p_partkey").alias("target"), pattern.alias("pattern"))


def class_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class expressions of all parts, as triples."""
    return class_expressions(_criteria(spark, sf_dir), NS)


def axioms_unsaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts whose pattern no class expression says."""
    return unsaid(_criteria(spark, sf_dir), NS)


def axioms_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns read back from the triples of all parts."""
    d = patterns_of(class_expressions(_criteria(spark, sf_dir), NS), NS)
    return d.select("target", "op", "property", "filler", F.array_join("classes", ",").alias("classes"), "cmp", "value", "alignment")


_C = f"c AS (SELECT p_partkey AS id, concat('{NS}T', p_partkey) AS target, concat('_:c', p_partkey) AS r, p_size AS z, concat('{NS}', replace(p_brand, '#', '_')) AS prop, concat('{NS}', p_type) AS cls, concat('{NS}', split_part(p_name, ' ', 1)) AS word, concat('http://y/', p_type) AS far, CASE WHEN p_size <= 20 THEN 'gt' WHEN p_size <= 23 THEN 'le' WHEN p_size <= 26 THEN 'eq' ELSE 'lt' END AS cmp FROM part)"
_OK = "z <= 44 AND NOT (z BETWEEN 24 AND 26)"


def _o_axioms() -> str:
    row = lambda s, p, o, where, kind="iri", datatype=None: f"SELECT {s} AS s, {p} AS p, {o} AS o, '{kind}' AS o_kind, {f"'{datatype}'" if datatype else 'NULL'} AS o_datatype FROM c WHERE {where}"
    q = lambda x: f"'{x}'"
    at = lambda tail: f"concat(r, '{tail}')"
    union, facet = "z BETWEEN 9 AND 16", "z BETWEEN 17 AND 28 AND cmp <> 'eq'"
    rows = [
        row("target", q(OWL + "equivalentClass"), "r", _OK, "bnode"), row("r", q(RDF + "type"), q(OWL + "Restriction"), _OK), row("r", q(OWL + "onProperty"), "prop", _OK),
        row("r", q(OWL + "someValuesFrom"), "cls", "z <= 8"), row("r", q(OWL + "someValuesFrom"), "far", "z BETWEEN 37 AND 44"), row("r", q(OWL + "hasValue"), "CASE WHEN z > 30 THEN 'true' ELSE 'false' END", "z BETWEEN 29 AND 36", "literal", XSD + "boolean"),
        row("r", q(OWL + "someValuesFrom"), at("u"), union, "bnode"), row(at("u"), q(RDF + "type"), q(OWL + "Class"), union), row(at("u"), q(OWL + "unionOf"), at("l0"), union, "bnode"),
        *[row(at(f"l{i}"), q(RDF + "first"), x, union) for i, x in enumerate(("cls", "word", "cls"))], *[row(at(f"l{i}"), q(RDF + "rest"), at(f"l{i + 1}"), union, "bnode") for i in (0, 1)], row(at("l2"), q(RDF + "rest"), q(RDF + "nil"), union),
        row("r", q(OWL + "someValuesFrom"), at("d"), facet, "bnode"), row(at("d"), q(RDF + "type"), q(RDFS + "Datatype"), facet), row(at("d"), q(OWL + "onDatatype"), q(XSD + "integer"), facet), row(at("d"), q(OWL + "withRestrictions"), at("r"), facet, "bnode"),
        row(at("f"), "CASE cmp " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FACETS.items()) + " END", "z::VARCHAR", facet, "literal", XSD + "integer"), row(at("r"), q(RDF + "first"), at("f"), facet, "bnode"), row(at("r"), q(RDF + "rest"), q(RDF + "nil"), facet),
    ]
    return f"WITH {_C} " + " UNION ALL ".join(rows)


O_UNSAID = f"WITH {_C} SELECT id, CASE WHEN z <= 28 THEN 'datatype_facet' WHEN z <= 47 THEN 'and' END AS op, CASE WHEN z <= 28 THEN 'no facet' WHEN z <= 47 THEN 'outside the vocabulary' ELSE 'no pattern' END AS fault FROM c WHERE NOT ({_OK})"
O_READ = f"""WITH {_C} SELECT target, CASE WHEN z <= 8 THEN 'some_values_from' WHEN z <= 16 THEN 'class_membership' WHEN z <= 28 THEN 'datatype_facet' WHEN z <= 36 THEN 'boolean_has_value' ELSE 'external_alignment' END AS op, prop AS property,
CASE WHEN z <= 8 THEN cls END AS filler, CASE WHEN z BETWEEN 9 AND 16 THEN concat(cls, ',', word, ',', cls) END AS classes, CASE WHEN z BETWEEN 17 AND 28 THEN cmp END AS cmp, CASE WHEN z BETWEEN 17 AND 28 THEN z::VARCHAR WHEN z BETWEEN 29 AND 36 THEN CASE WHEN z > 30 THEN 'true' ELSE 'false' END END AS value, CASE WHEN z > 36 THEN far END AS alignment FROM c WHERE {_OK}"""

QUERIES = {"class_axioms": class_axioms, "axioms_unsaid": axioms_unsaid, "axioms_read": axioms_read}
ORACLES = {"class_axioms": _o_axioms(), "axioms_unsaid": O_UNSAID, "axioms_read": O_READ}
