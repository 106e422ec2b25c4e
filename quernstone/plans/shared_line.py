"""The shared-line assessment of products on equipment, over individuals with open property maps.

individual: iri, class_iris, properties (map of key to {iri, s, d, b}; keys are matched by containment, the first hit wins)
request: case_id, drug_iri, equipment_iris

A request's own facts are read and put to the rules once; then requests fan out to their equipment, the four pathways are
conditions within the row, and one aggregation by request counts what they hit. Missing ingredients and equipment are tolerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import numeric
from quernstone.plans import rules
from quernstone.plans.rules import Rule, value
from quernstone.sources.tables import table

PROPERTY = "struct<iri:string,s:string,d:double,b:boolean>"
INDIVIDUAL = f"iri string, class_iris array<string>, properties map<string,{PROPERTY}>"
REQUEST = "case_id string, drug_iri string, equipment_iris array<string>"
PATHWAYS = ("residue", "airborne", "mechanical", "confusion")
LATTICE = {"HighRisk": 3, "MediumRisk": 2, "LowRisk": 1}
BATCH, DOSE = 1000.0, 1000.0


def _present(name: str) -> dict:
    return {"op": "class_present", "class": name}


def _member(prop: str, *names: str) -> dict:
    return {"op": "class_membership", "property": prop, "classes": list(names)}


def _is(key: str, to: object) -> dict:
    return {"op": "literal_eq", "key": key, "value": to}


def _than(key: str, cmp: str, to: float) -> dict:
    return {"op": "literal_cmp", "key": key, "cmp": cmp, "value": to}


def _and(*operands: dict) -> dict:
    return {"op": "and", "operands": list(operands)}


def _or(*operands: dict) -> dict:
    return {"op": "or", "operands": list(operands)}


#: External classes that make an ingredient hormonal, a penicillin or antineoplastic.
CHEBI = "http://purl.obolibrary.org/obo/CHEBI_"
HORMONE, PENICILLIN, ANTINEOPLASTIC = CHEBI + "24621", CHEBI + "17334", CHEBI + "35610"

#: The default criteria (key, pattern, class).
CRITERIA = [
    ("R-DC1", {"op": "some_values_from", "property": "hasToxicityProfile", "filler_class": "GenotoxicityProfile"}, "CytotoxicDrug"),
    ("R-DC2", _member("hasOEBClassification", "OEB4", "OEB5"), "HighActivityDrug"),
    ("R-DC3", {"op": "datatype_facet", "property": "sensitizationLevel", "cmp": "gt", "value": 3}, "HighSensitizingDrug"),
    ("R-DC4", {"op": "boolean_has_value", "property": "hasBetaLactamRing", "value": True}, "BetaLactamDrug"),
    ("HormonalDrug-suff", {"op": "external_alignment", "property": "hasActiveIngredient", "alignment": HORMONE}, "HormonalDrug"),
    ("PenicillinDrug-suff", {"op": "external_alignment", "property": "hasActiveIngredient", "alignment": PENICILLIN}, "PenicillinDrug"),
    ("AntineoplasticDrug-suff", {"op": "external_alignment", "property": "hasActiveIngredient", "alignment": ANTINEOPLASTIC}, "AntineoplasticDrug"),
]

#: The default rules by group, all of one priority, so that they fire in order of their keys.
DEDICATION = [
    ("R-ED1", _present("PenicillinDrug"), True),
    ("R-ED2", _and(_present("CytotoxicDrug"), _member("hasInactivationProfile", "NonInactivatable")), True),
    ("R-ED3", _and(_present("BiologicalProduct"), _is("hasPrionRisk", True)), True),
    ("R-ED4", _and(_present("CytotoxicDrug"), _member("hasInactivationProfile", "HeatInactivatable", "ChemicalInactivatable")), False),
    ("R-ED5", _and(_present("HighActivityDrug"), _member("hasOEBClassification", "OEB5")), True),
    ("R-ED6", _present("HormonalDrug"), None),
]
SHARED = _is("isShared", True)
SCENARIOS = [
    ("R-SCa", _and(_present("ClinicalTrialDrug"), _member("coProduct", "CommercialDrug")), "ClinicalWithCommercialScenario"),
    ("R-SCb", _and(_present("TraditionalChineseMedicine"), SHARED), "TCMSharedLineScenario"),
    ("R-SCc", _and(_present("BiologicalProduct"), SHARED), "BiologicSharedLineScenario"),
    ("R-SCd", _and(_present("SterileDrugProduct"), SHARED), "TerminalVsNonTerminalSterilizationScenario"),
    ("R-SCe", _and(_or(_present("HormonalDrug"), _present("CytotoxicDrug"), _present("HighActivityDrug")), SHARED), "HormonalCytotoxicHighPotencyScenario"),
    ("R-SCf", _and(_present("CellTherapyProduct"), SHARED), "CellTherapySharedLineScenario"),
    ("R-SCg", _and(_or(_present("NarcoticDrug"), _present("PsychotropicDrug"), _present("PrecursorChemical")), SHARED), "NarcoticPsychotropicPrecursorScenario"),
    ("R-SCh", _present("PenicillinDrug"), "PenicillinBetaLactamScenario"),
]
CONTAMINATION = [
    ("R-CP1", _and(_is("pathway", "residue"), _than("pde", "lt", 0.01), _than("cleanability", "lt", 3)), "HighRisk"),
    ("R-CP2", _and(_is("pathway", "airborne"), _is("dosageForm", "powder"), _is("areaType", "general")), "HighRisk"),
    ("R-CP3", _and(_is("pathway", "residue"), _is("dosageForm", "solution"), _than("cleanability", "gt", 4)), "LowRisk"),
    ("R-CP4", _and(_is("pathway", "confusion"), _is("formRelation", "same")), "MediumRisk"),
]
RULES = [
    *(Rule(k, "dedication", 100, p, {"dedicated": c}) for k, p, c in DEDICATION),
    *(Rule(k, "scenario", 100, p, {"scenario": c}) for k, p, c in SCENARIOS),
    *(Rule(k, "contamination", 100, p, {"level": c}) for k, p, c in CONTAMINATION),
]


def _entries(properties: str, *names: str) -> Column:
    """The entries whose key contains one of the names."""
    return F.filter(F.map_entries(properties), lambda e: F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(e["key"], n)))


def _first(properties: str, *names: str) -> Column:
    return F.get(_entries(properties, *names), F.lit(0))["value"]


def _text(v: Column) -> Column:
    return F.coalesce(v["s"], v["d"].cast("string"), F.initcap(v["b"].cast("string")))


def _number(v: Column) -> Column:
    return F.coalesce(v["d"], v["s"].try_cast("double"), v["b"].cast("double"))


def _objects(properties: str, *names: str) -> Column:
    """IRIs of the entries, as a list: empty where there is an individual without any."""
    return F.array_compact(F.transform(_entries(properties, *names), lambda e: e["value"]["iri"]))


def _typed(v: Column) -> Column:
    return F.when(v.isNotNull(), F.struct(v["s"].alias("s"), v["d"].alias("d"), v["b"].alias("b")))


def _held(*pairs: tuple[str, Column]) -> Column:
    """A map of the pairs whose value is there: a missing fact is a missing key."""
    rows = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, v in pairs]))
    return F.map_from_entries(rows)


def products(individuals: DataFrame, requests: DataFrame) -> DataFrame:
    """A row for each request whose product exists: what rules and limits read of the product and its ingredient."""
    drug = individuals.select(F.col("iri").alias("drug_iri"), F.col("class_iris").alias("classes"), F.col("properties").alias("dp"))
    api = individuals.select(F.col("iri").alias("api_iri"), F.col("class_iris").alias("api_classes"), F.col("properties").alias("ap"))
    d = requests.select("case_id", "drug_iri").join(drug, "drug_iri").withColumn("_i", _first("dp", "hasActiveIngredient"))
    d = d.withColumn("api_iri", F.coalesce(F.col("_i.iri"), F.when(F.startswith("_i.s", F.lit("http")), F.col("_i.s")))).join(api, "api_iri", "left")
    return d.select(
        "case_id",
        "classes",
        F.when(F.col("ap").isNotNull(), _objects("ap", "Toxicity")).alias("toxicity"),
        F.when(F.col("ap").isNotNull(), _objects("ap", "OEB")).alias("oeb"),
        F.coalesce(_objects("ap", "Inactivation", "inactivation"), F.array().cast("array<string>")).alias("inactivation"),
        _typed(F.element_at("dp", F.lit("sensitization_level"))).alias("sensitization"),
        _typed(_first("ap", "has_beta_lactam_ring")).alias("ring"),
        F.when(F.size("api_classes") > 0, F.col("api_classes")).alias("aligned"),
        F.coalesce(_typed(F.element_at("dp", F.lit("hasPrionRisk"))), value(b=F.lit(False))).alias("prion"),
        _text(_first("dp", "dosageForm")).alias("form"),
        _number(_first("ap", "pde_mg_per_day")).alias("pde"),
        _number(_first("dp", "maximumDailyDose_mg")).alias("tdd"),
        _number(_first("dp", "minimumTherapeuticDose_mg")).alias("dose"),
        _number(_first("ap", "ld50_mg_per_kg")).alias("ld50"),
        F.coalesce(_text(_first("dp", "routeOfAdministration")), F.lit("oral")).alias("route"),
    )


def equipped(individuals: DataFrame, requests: DataFrame) -> DataFrame:
    """case_id, area and score of each piece of equipment that is asked for and exists. Its properties are read before they meet requests."""
    area = F.when(F.lower(_text(_first("properties", "isInCleanArea"))) == "true", "clean").otherwise("general")
    score = F.get(F.array_compact(F.transform(_entries("properties", "cleanability"), lambda x: F.floor(_number(x["value"])))), F.lit(0))
    equipment = individuals.select(F.col("iri").alias("eq_iri"), area.alias("area"), score.alias("score"))
    return requests.select("case_id", F.explode("equipment_iris").alias("eq_iri")).join(equipment, "eq_iri").select("case_id", "area", "score")


def _named(pathway: str | None = None) -> dict:
    """The facts of products() by their names; for a pathway, with it and the facts of equipment."""
    lists, typed = "array<string>", rules.VALUE
    scalars = {"isShared": value(b=F.lit(True)), "hasPrionRisk": F.col("prion"), "dosageForm": value(s=F.col("form")), "pde": value(d=F.col("pde"))}
    if pathway:
        scalars |= {"pathway": value(s=F.lit(pathway)), "areaType": value(s=F.col("area")), "cleanability": value(d=F.col("score"))}
    return {
        "classes": F.col("classes"),
        "relations": rules.Named(lists, hasToxicityProfile=F.col("toxicity"), hasOEBClassification=F.col("oeb"), hasInactivationProfile=F.col("inactivation"), coProduct=F.array().cast(lists)),
        "data_values": rules.Named(typed, sensitizationLevel=F.col("sensitization"), hasBetaLactamRing=F.col("ring")),
        "alignments": rules.Named(lists, hasActiveIngredient=F.col("aligned")),
        "scalars": rules.Named(typed, **scalars),
    }


def assessed(individuals: DataFrame, requests: DataFrame, criteria: list = CRITERIA, rule_set: list[Rule] = RULES, restrictive: bool = True) -> DataFrame:
    """case_id, rule_ids, requires_dedication, risk_level, scenarios, classes_added, maco and its method; arrays are sorted.

    What only the product decides is decided once for each request; equipment is counted by contamination rule and pathway.
    """
    d = rules.classify(products(individuals, requests), criteria, _named())
    d = d.withColumns({"_d": rules.fired(rule_set, "dedication", _named()), "_s": rules.fired(rule_set, "scenario", _named())})
    tdd = F.coalesce(F.nullif(F.col("tdd"), F.lit(0.0)), F.lit(DOSE))
    best = F.when(F.col("pde") > 0, numeric.maco(numeric.maco_methods(F.lit(BATCH), tdd, F.col("pde"), F.col("dose"), F.col("ld50"), F.col("route"))))
    added = F.array_compact(F.array(*[F.when(F.array_contains("criteria_fired", k), F.lit(c)) for k, _, c in criteria]))
    mine = {"added": added, "fired": F.concat("criteria_fired", "_d.rule", "_s.rule"), "dedicated": rules.dedication(F.col("_d.dedicated"), restrictive), "scenarios": F.col("_s.scenario"), "best": best}
    d = d.withColumns(mine).drop("criteria_fired", "_d", "_s", "tdd", "dose", "ld50", "route")
    own = sorted((r for r in rule_set if r.group == "contamination"), key=lambda r: (r.priority, r.key))
    ways = [(p, r) for p in PATHWAYS for r in own]
    hit = [F.count_if(F.col("area").isNotNull() & rules.holds(rules.compiled(r.pattern, facts=_named(p)))).cast("int").alias(f"n{i}") for i, (p, r) in enumerate(ways)]
    one = d.join(equipped(individuals, requests), "case_id", "left").groupBy("case_id").agg(*[F.any_value(k).alias(k) for k in mine], *hit)
    levels = F.array_compact(F.array(*[F.when(F.col(f"n{i}") > 0, F.lit(r.consequent["level"])) for i, (_, r) in enumerate(ways)]).cast("array<string>"))
    return one.select(
        "case_id",
        F.array_sort(F.concat("fired", *[F.array_repeat(F.lit(r.key), F.col(f"n{i}")) for i, (_, r) in enumerate(ways)])).alias("rule_ids"),
        F.col("dedicated").alias("requires_dedication"),
        rules.highest(levels, LATTICE).alias("risk_level"),
        F.array_sort("scenarios").alias("scenarios"),
        F.array_sort("added").alias("classes_added"),
        F.col("best.value").alias("maco"),
        F.col("best.method").alias("maco_method"),
    )


#: Words of hazards that ask for a signature, in scenarios and in the names of classes that criteria add.
HAZARD_CLASSES = "penicillin|cephalosporin|hormonal|sensitiz|highactivity|highpotency"
HAZARDS = "penicillin|青霉|cephalosporin|头孢|sensitiz|致敏|hazard|hormonal"


def needs_signature(result: DataFrame) -> DataFrame:
    """A quality signature is asked for at high risk, dedication, or a scenario or class of a hazard."""
    hazard = F.exists("scenarios", lambda s: F.lower(s).rlike(HAZARDS)) | F.exists("classes_added", lambda c: F.lower(c).rlike(HAZARD_CLASSES))
    return result.withColumn("requires_signature", (F.col("risk_level") == "HighRisk") | F.col("requires_dedication") | hazard)


def _p(iri: str | None = None, s: str | None = None, d: float | None = None, b: bool | None = None) -> tuple:
    return (iri, s, d, b)


#: The cases of the golden matrix: classes and properties of drug and ingredient, and of the equipment.
CASES = {
    "dc1_genotoxic_cytotoxic": ([], {}, {"hasToxicityProfile": _p("GenotoxicityProfile")}, None),
    "dc2_oeb4_highactivity": ([], {}, {"hasOEBClassification": _p("OEB4")}, None),
    "dc3_sensitization_high": ([], {"sensitization_level": _p(d=4.0)}, None, None),
    "dc3_sensitization_below": ([], {"sensitization_level": _p(d=2.0)}, None, None),
    "dc3_sensitization_absent": ([], {}, None, None),
    "dc4_betalactam": ([], {}, {"has_beta_lactam_ring": _p(b=True)}, None),
    "dc4_betalactam_false": ([], {}, {"has_beta_lactam_ring": _p(b=False)}, None),
    "penicillin_dedication": (["PenicillinDrug"], {}, None, None),
    "cytotoxic_noninactivatable_dedicate": ([], {}, {"hasToxicityProfile": _p("GenotoxicityProfile"), "hasInactivationDisposition": _p("NonInactivatable")}, None),
    "cytotoxic_inactivatable_shared": ([], {}, {"hasToxicityProfile": _p("GenotoxicityProfile"), "hasInactivationDisposition": _p("HeatInactivatable")}, None),
    "highactivity_oeb5_dedicate": ([], {}, {"hasOEBClassification": _p("OEB5")}, None),
    "biologic_prion_dedicate": (["BiologicalProduct"], {"hasPrionRisk": _p(b=True)}, None, None),
    "hormonal_hvac": (["HormonalDrug"], {}, None, None),
    "contamination_highrisk": ([], {"dosageForm": _p(s="powder")}, {"pde_mg_per_day": _p(d=0.005)}, {"cleanabilityScore": _p(d=2.0), "isInCleanArea": _p(b=False)}),
    "contamination_lowrisk": ([], {"dosageForm": _p(s="solution")}, {"pde_mg_per_day": _p(d=5.0)}, {"cleanabilityScore": _p(d=5.0), "isInCleanArea": _p(b=True)}),
}


def matrix(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The golden cases as individuals and requests."""
    ns = "http://example.org/drug/"
    people, asked = [], []
    for case, (classes, drug, api, equipment) in CASES.items():
        props = dict(drug)
        if api is not None:
            props["hasActiveIngredient"] = _p(f"api:{case}")
            people.append((f"api:{case}", [ns + "ActivePharmaceuticalIngredient"], {k: (_p(ns + v[0]) if v[0] else v) for k, v in api.items()}))
        people.append((f"drug:{case}", [ns + "DrugProduct", *(ns + c for c in classes)], props))
        if equipment is not None:
            people.append((f"eq:{case}", [ns + "Equipment"], equipment))
        asked.append((case, f"drug:{case}", [f"eq:{case}", "eq:unknown"] if equipment is not None else []))
    return spark.createDataFrame(people, INDIVIDUAL), spark.createDataFrame(asked, REQUEST)


def golden_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden matrix; tests hold it against the known conclusions."""
    r = needs_signature(assessed(*matrix(spark)))
    return r.select("case_id", F.array_join("rule_ids", ",").alias("rule_ids"), "requires_dedication", "risk_level", F.array_join("scenarios", ",").alias("scenarios"), F.round("maco", 6).alias("maco"), "maco_method", "requires_signature")


#: The known conclusions, as SQL: a table of values.
EXPECTED = (
    ("dc1_genotoxic_cytotoxic", "R-DC1,R-SCe", False, "LowRisk", "HormonalCytotoxicHighPotencyScenario", None, None, True),
    ("dc2_oeb4_highactivity", "R-DC2,R-SCe", False, "LowRisk", "HormonalCytotoxicHighPotencyScenario", None, None, True),
    ("dc3_sensitization_high", "R-DC3", False, "LowRisk", "", None, None, True),
    ("dc3_sensitization_below", "", False, "LowRisk", "", None, None, False),
    ("dc3_sensitization_absent", "", False, "LowRisk", "", None, None, False),
    ("dc4_betalactam", "R-DC4", False, "LowRisk", "", None, None, False),
    ("dc4_betalactam_false", "", False, "LowRisk", "", None, None, False),
    ("penicillin_dedication", "R-ED1,R-SCh", True, "LowRisk", "PenicillinBetaLactamScenario", None, None, True),
    ("cytotoxic_noninactivatable_dedicate", "R-DC1,R-ED2,R-SCe", True, "LowRisk", "HormonalCytotoxicHighPotencyScenario", None, None, True),
    ("cytotoxic_inactivatable_shared", "R-DC1,R-ED4,R-SCe", False, "LowRisk", "HormonalCytotoxicHighPotencyScenario", None, None, True),
    ("highactivity_oeb5_dedicate", "R-DC2,R-ED5,R-SCe", True, "LowRisk", "HormonalCytotoxicHighPotencyScenario", None, None, True),
    ("biologic_prion_dedicate", "R-ED3,R-SCc", True, "LowRisk", "BiologicSharedLineScenario", None, None, True),
    ("hormonal_hvac", "R-ED6,R-SCe", False, "LowRisk", "HormonalCytotoxicHighPotencyScenario", None, None, True),
    ("contamination_highrisk", "R-CP1,R-CP2", False, "HighRisk", "", 0.005, "pde", True),
    ("contamination_lowrisk", "R-CP3", False, "LowRisk", "", 5.0, "pde", False),
)


def _sql(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}::DOUBLE" if isinstance(x, float) else f"'{x}'"


def part_individuals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as products with an ingredient each (but for STANDARD ones), suppliers as equipment, and a request for each part on the suppliers of its lines.

    Types are classes and profiles; sizes are levels, limits and forms; a missing property is a missing key.
    """
    ns = "http://example.org/drug/"
    p, s, line = (table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    kind, size = F.col("p_type"), F.col("p_size")
    classes = F.array_compact(F.array(F.lit(ns + "DrugProduct"), *[F.when(kind == k, F.lit(ns + c)) for k, c in (("PROMO", "PenicillinDrug"), ("ECONOMY", "BiologicalProduct"), ("SMALL", "HormonalDrug"))]))
    one = lambda iri=None, s=None, d=None, b=None: F.struct(*[(F.lit(None) if x is None else x).cast(t).alias(n) for n, t, x in (("iri", "string", iri), ("s", "string", s), ("d", "double", d), ("b", "boolean", b))])
    ingredient = F.concat(F.lit("a"), "p_partkey")
    drug = _held(
        ("sensitization_level", F.when(size <= 45, one(d=size / 10))), ("hasPrionRisk", F.when(kind == "ECONOMY", one(b=size > 25))), ("dosageForm", one(s=F.when(size > 20, "powder").otherwise("solution"))),
        ("hasActiveIngredient", F.when(size > 3, one(iri=ingredient)).otherwise(one(s=F.lit("by name")))), ("maximumDailyDose_mg", F.when(size > 10, one(d=F.col("p_retailprice")))),
    )
    high = F.when(size > 25, "NonInactivatable").otherwise("HeatInactivatable")
    api = _held(
        ("hasToxicityProfile", F.when(kind == "LARGE", one(iri=F.lit(ns + "GenotoxicityProfile")))), ("hasOEBClassification", F.when(kind == "MEDIUM", one(iri=F.when(size > 25, ns + "OEB5").otherwise(ns + "OEB4")))),
        ("hasInactivationDisposition", F.when(kind == "LARGE", one(iri=F.concat(F.lit(ns), high)))), ("has_beta_lactam_ring", F.when(kind == "PROMO", one(b=size > 30))), ("pde_mg_per_day", one(d=size / 1000)),
    )
    people = p.select(F.concat(F.lit("d"), "p_partkey").alias("iri"), classes.alias("class_iris"), drug.alias("properties"))
    people = people.unionByName(p.filter(kind != "STANDARD").select(ingredient.alias("iri"), F.array(F.lit(ns + "ActivePharmaceuticalIngredient")).alias("class_iris"), api.alias("properties")))
    clean = _held(("cleanabilityScore", one(d=F.col("s_acctbal") / 1000)), ("isInCleanArea", one(b=F.col("s_nationkey") > 12)))
    people = people.unionByName(s.select(F.concat(F.lit("e"), "s_suppkey").alias("iri"), F.array(F.lit(ns + "Equipment")).alias("class_iris"), clean.alias("properties")))
    lines = line.select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").repartition("p_partkey")  # dealt once, for the distinct suppliers and for their lists
    used = lines.distinct().groupBy("p_partkey").agg(F.collect_list(F.concat(F.lit("e"), "l_suppkey")).alias("e"))
    asked = p.select("p_partkey").join(used, "p_partkey", "left").select(F.col("p_partkey").cast("string").alias("case_id"), F.concat(F.lit("d"), "p_partkey").alias("drug_iri"), F.concat(F.coalesce("e", F.array().cast("array<string>")), F.array(F.lit("eq:unknown"))).alias("equipment_iris"))
    return people, asked


def part_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default criteria and rules over all parts."""
    r = needs_signature(assessed(*part_individuals(spark, sf_dir)))
    return r.select("case_id", F.array_join("rule_ids", ",").alias("rule_ids"), "requires_dedication", "risk_level", F.array_join("scenarios", ",").alias("scenarios"), F.array_join("classes_added", ",").alias("classes_added"), F.round("maco", 6).alias("maco"), "maco_method", "requires_signature")


O_PARTS = """
WITH q AS (SELECT l_partkey, count(*) FILTER (WHERE floor(s_acctbal / 1000) < 3) AS low, count(*) FILTER (WHERE s_nationkey <= 12) AS general, count(*) FILTER (WHERE floor(s_acctbal / 1000) > 4) AS good
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
c AS (SELECT p_partkey, p_retailprice, p_size AS z, p_size > 3 AND p_type <> 'STANDARD' AS api, coalesce(low, 0) AS low, coalesce(general, 0) AS general, coalesce(good, 0) AS good, p_type = 'PROMO' AS promo, p_type = 'ECONOMY' AS eco, p_type = 'SMALL' AS small,
  p_type = 'LARGE' AND p_size > 3 AS cyt, p_type = 'MEDIUM' AND p_size > 3 AS act, p_size > 30 AND p_size <= 45 AS sens FROM part LEFT JOIN q ON l_partkey = p_partkey),
f AS (SELECT *, list_filter(list_concat(CASE WHEN api AND z < 10 THEN list_transform(range(low), lambda x: 'R-CP1') ELSE [] END, CASE WHEN z > 20 THEN list_transform(range(general), lambda x: 'R-CP2') ELSE [] END, CASE WHEN z <= 20 THEN list_transform(range(good), lambda x: 'R-CP3') ELSE [] END,
    [CASE WHEN cyt THEN 'R-DC1' END, CASE WHEN act THEN 'R-DC2' END, CASE WHEN sens THEN 'R-DC3' END, CASE WHEN promo AND z > 30 THEN 'R-DC4' END, CASE WHEN promo THEN 'R-ED1' END, CASE WHEN cyt AND z > 25 THEN 'R-ED2' END, CASE WHEN eco AND z > 25 THEN 'R-ED3' END,
     CASE WHEN cyt AND z <= 25 THEN 'R-ED4' END, CASE WHEN act AND z > 25 THEN 'R-ED5' END, CASE WHEN small THEN 'R-ED6' END, CASE WHEN eco THEN 'R-SCc' END, CASE WHEN small OR cyt OR act THEN 'R-SCe' END, CASE WHEN promo THEN 'R-SCh' END]), lambda x: x IS NOT NULL) AS fired FROM c),
r AS (SELECT *, promo OR (cyt AND z > 25) OR (eco AND z > 25) OR (act AND z > 25) AS ded, (api AND z < 10 AND low > 0) OR (z > 20 AND general > 0) AS high FROM f)
SELECT p_partkey::VARCHAR AS case_id, array_to_string(fired, ',') AS rule_ids, ded AS requires_dedication, CASE WHEN high THEN 'HighRisk' ELSE 'LowRisk' END AS risk_level,
  concat(CASE WHEN eco THEN 'BiologicSharedLineScenario' ELSE '' END, CASE WHEN small OR cyt OR act THEN 'HormonalCytotoxicHighPotencyScenario' ELSE '' END, CASE WHEN promo THEN 'PenicillinBetaLactamScenario' ELSE '' END) AS scenarios,
  array_to_string(list_filter([CASE WHEN promo AND z > 30 THEN 'BetaLactamDrug' END, CASE WHEN cyt THEN 'CytotoxicDrug' END, CASE WHEN act THEN 'HighActivityDrug' END, CASE WHEN sens THEN 'HighSensitizingDrug' END], lambda x: x IS NOT NULL), ',') AS classes_added,
  CASE WHEN api THEN round(z / 1000 * 1000 / CASE WHEN z > 10 THEN p_retailprice ELSE 1000 END, 6) END AS maco, CASE WHEN api THEN 'pde' END AS maco_method, ded OR high OR small OR cyt OR act OR promo OR sens AS requires_signature FROM r
"""

QUERIES = {"golden_assessment": golden_assessment, "part_conclusions": part_conclusions}
ORACLES = {"part_conclusions": O_PARTS, "golden_assessment": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in EXPECTED) + ") t(case_id, rule_ids, requires_dedication, risk_level, scenarios, maco, maco_method, requires_signature)"}
