"""The rule algebra: patterns are JSON trees of ten closed operators, compiled into nullable boolean columns.

Facts are one wide row: `classes`, and maps `relations`, `alignments` (to arrays of strings), `data_values` and `scalars`
(to typed values). A key that is absent is UNKNOWN. Compilation happens when the plan is built; at run time a rule is an
expression within whole-stage code.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.ternary import all_of, any_of, holds, some

#: Operators with their required fields, and comparators.
FIELDS = {
    "and": ("operands",),
    "or": ("operands",),
    "some_values_from": ("property", "filler_class"),
    "class_membership": ("property", "classes"),
    "datatype_facet": ("property", "cmp", "value"),
    "boolean_has_value": ("property", "value"),
    "external_alignment": ("property", "alignment"),
    "class_present": ("class",),
    "literal_eq": ("key", "value"),
    "literal_cmp": ("key", "cmp", "value"),
}
COMPARATORS = {"gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le, "eq": operator.eq, "ne": operator.ne}

#: The type of a value of `data_values` and `scalars`: one of the three is set.
VALUE = "struct<s:string,d:double,b:boolean>"
FACTS = f"classes array<string>, relations map<string,array<string>>, data_values map<string,{VALUE}>, alignments map<string,array<string>>, scalars map<string,{VALUE}>"


def value(s: Column | None = None, d: Column | None = None, b: Column | None = None) -> Column:
    """A typed value; NULL if what it holds is NULL."""
    held = next(c for c in (s, d, b) if c is not None)
    parts = (F.lit(None).cast(t).alias(k) if c is None else c.cast(t).alias(k) for k, c, t in (("s", s, "string"), ("d", d, "double"), ("b", b, "boolean")))
    return F.when(held.isNotNull(), F.struct(*parts))


def validate(pattern: object, path: str = "$") -> None:
    """Raises a ValueError that names the place of the first fault of a pattern."""
    if not isinstance(pattern, dict):
        raise ValueError(f"{path}: a node is an object")
    op = pattern.get("op")
    if op not in FIELDS:
        raise ValueError(f"{path}: unknown operator {op!r}")
    for f in FIELDS[op]:
        if pattern.get(f) is None:
            raise ValueError(f"{path}.{f}: missing")
    if "cmp" in FIELDS[op] and pattern["cmp"] not in COMPARATORS:
        raise ValueError(f"{path}.cmp: unknown comparator {pattern['cmp']!r}")
    if op == "class_membership" and not isinstance(pattern["classes"], list):
        raise ValueError(f"{path}.classes: not a list")
    if op in ("and", "or"):
        if not isinstance(pattern["operands"], list) or not pattern["operands"]:
            raise ValueError(f"{path}.operands: not a list with members")
        for i, x in enumerate(pattern["operands"]):
            validate(x, f"{path}.operands[{i}]")


def referenced(pattern: dict) -> list[str]:
    """The property and key names that a pattern reads, in order, each once."""
    own = [x for k in ("property", "key") if (x := pattern.get(k))]
    return list(dict.fromkeys(own + [x for p in pattern.get("operands", []) for x in referenced(p)]))


def _number(v: Column) -> Column:
    return F.coalesce(v["d"], v["s"].try_cast("double"), v["b"].cast("double"))


def _truth(v: Column) -> Column:
    return F.coalesce(v["b"], v["d"] != 0, v["s"] != "")


def _equal(v: Column, to: object) -> Column:
    if isinstance(to, bool) or isinstance(to, int | float):
        same = F.coalesce(v["d"], v["b"].cast("double")) == F.lit(float(to))
    else:
        same = v["s"] == F.lit(str(to))
    return F.when(v.isNotNull(), F.coalesce(same, F.lit(False)))


class Named(dict):
    """Facts of one kind by name, each a column of its own instead of a map's entry; a name that isn't there is UNKNOWN."""

    def __init__(self, kind: str, **columns: Column):
        super().__init__(columns)
        self.kind = kind

    def __missing__(self, name: str) -> Column:
        return F.lit(None).cast(self.kind)


def compiled(pattern: dict, prefix: str = "", facts: dict | None = None) -> Column:
    """The pattern over the fact columns (below a struct column, if a prefix ending in a dot is given), or over facts given by their names."""
    op = pattern["op"]
    classes, relations, data, alignments, scalars = (facts[c] if facts else F.col(prefix + c) for c in ("classes", "relations", "data_values", "alignments", "scalars"))
    if op in ("and", "or"):
        return (all_of if op == "and" else any_of)([compiled(p, prefix, facts) for p in pattern["operands"]])
    if op == "some_values_from":
        return some(relations[pattern["property"]], lambda v: v.contains(pattern["filler_class"]))
    if op == "class_membership":
        return some(relations[pattern["property"]], lambda v: any_of([v.contains(c) for c in pattern["classes"]]))
    if op == "external_alignment":
        return some(alignments[pattern["property"]], lambda v: v.contains(pattern["alignment"]))
    if op == "class_present":
        return F.when(F.size(classes) > 0, F.exists(classes, lambda v: v.contains(pattern["class"])))
    if op == "datatype_facet":
        return COMPARATORS[pattern["cmp"]](_number(data[pattern["property"]]), F.lit(float(pattern["value"])))
    if op == "boolean_has_value":
        return _truth(data[pattern["property"]]) == F.lit(bool(pattern["value"]))
    if op == "literal_eq":
        return _equal(scalars[pattern["key"]], pattern["value"])
    v, to, cmp = scalars[pattern["key"]], pattern["value"], pattern["cmp"]
    number = F.lit(float(to)) if not isinstance(to, str) else F.lit(to).try_cast("double")
    by_number = COMPARATORS[cmp](_number(v), number)
    if cmp not in ("eq", "ne"):
        return by_number
    raw = _equal(v, to)
    return F.coalesce(by_number, raw if cmp == "eq" else ~raw)


@dataclass
class Flat:
    """Facts as plain columns, for rules known when the plan is built: what they read is generated code, without maps or arrays.

    classes: columns of class names; lists: (`relations` or `alignments`, name) to the columns of its values; values:
    (`data` or `scalars`, name) to typed columns by `s`, `d` or `b`; added: classes that criteria gave, with the condition.
    """

    classes: list[Column]
    lists: dict[tuple[str, str], list[Column]] = field(default_factory=dict)
    values: dict[tuple[str, str], dict[str, Column]] = field(default_factory=dict)
    added: list[tuple[str, Column]] = field(default_factory=list)

    def with_scalar(self, name: str, **typed: Column) -> Flat:
        return replace(self, values=self.values | {("scalars", name): typed})

    def _among(self, kind: str, name: str, wanted: list[str]) -> Column:
        hits = [holds(v.contains(w)) for v in self.lists.get((kind, name), []) for w in wanted]
        return F.when(any_of(hits), True)

    def _number(self, typed: dict[str, Column]) -> Column:
        ways = {"d": lambda c: c.cast("double"), "s": lambda c: c.try_cast("double"), "b": lambda c: c.cast("double")}
        return F.coalesce(*[ways[k](typed[k]) for k in ("d", "s", "b") if k in typed], F.lit(None).cast("double"))

    def _equal(self, typed: dict[str, Column], to: object) -> Column:
        there = reduce(Column.__or__, [c.isNotNull() for c in typed.values()], F.lit(False))
        if isinstance(to, bool | int | float):
            same = [typed[k].cast("double") == F.lit(float(to)) for k in ("d", "b") if k in typed]
        else:
            same = [typed["s"] == F.lit(str(to))] if "s" in typed else []
        return F.when(there, any_of([holds(x) for x in same]))

    def compiled(self, pattern: dict) -> Column:
        """What compiled() gives over the maps."""
        op, unknown = pattern["op"], F.lit(None).cast("boolean")
        if op in ("and", "or"):
            return (all_of if op == "and" else any_of)([self.compiled(p) for p in pattern["operands"]])
        if op == "some_values_from":
            return self._among("relations", pattern["property"], [pattern["filler_class"]])
        if op == "class_membership":
            return self._among("relations", pattern["property"], pattern["classes"])
        if op == "external_alignment":
            return self._among("alignments", pattern["property"], [pattern["alignment"]])
        if op == "class_present":
            hits = [holds(c.contains(pattern["class"])) for c in self.classes] + [on for name, on in self.added if pattern["class"] in name]
            there = [c.isNotNull() for c in self.classes] + [on for _, on in self.added]
            return F.when(any_of(there), any_of(hits))
        typed = self.values.get(("data" if op in ("datatype_facet", "boolean_has_value") else "scalars", pattern.get("property") or pattern.get("key")), {})
        if not typed:
            return unknown
        if op == "boolean_has_value":
            ways = {"b": lambda c: c, "d": lambda c: c != 0, "s": lambda c: c != ""}
            return F.coalesce(*[ways[k](typed[k]) for k in ("b", "d", "s") if k in typed]) == F.lit(bool(pattern["value"]))
        if op == "literal_eq":
            return self._equal(typed, pattern["value"])
        to, cmp = pattern["value"], pattern["cmp"]
        if op == "datatype_facet":
            return COMPARATORS[cmp](self._number(typed), F.lit(float(to)))
        by_number = COMPARATORS[cmp](self._number(typed), F.lit(to).try_cast("double") if isinstance(to, str) else F.lit(float(to)))
        if cmp not in ("eq", "ne"):
            return by_number
        raw = self._equal(typed, to)
        return F.coalesce(by_number, raw if cmp == "eq" else ~raw)

    def facts(self, pattern: dict) -> Column:
        """A map of what a pattern reads that is there, by name: lists joined by commas, values as text."""
        names = referenced(pattern)
        text = lambda typed: F.coalesce(*[c.cast("string") for c in typed.values()])
        rows = []
        for n in names:
            lists = [F.concat_ws(",", *c) for (_, k), c in self.lists.items() if k == n]
            typed = [text(c) for (_, k), c in self.values.items() if k == n]
            rows.append(F.struct(F.lit(n).alias("key"), F.coalesce(*lists, *typed, F.lit(None).cast("string")).alias("value")))
        return F.map_from_entries(F.filter(F.array(*rows), lambda x: F.coalesce(x["value"] != "", F.lit(False))))


@dataclass(frozen=True)
class Rule:
    """A rule of a group: fires where its pattern is TRUE, and then says its consequent."""

    key: str
    group: str
    priority: int
    pattern: dict
    consequent: dict


def classify(facts: DataFrame, criteria: list[tuple[str, dict, str]], named: dict | None = None) -> DataFrame:
    """facts with the classes of criteria (key, pattern, class) that hold appended, in order, and `criteria_fired`.

    Each criterion sees the classes of those before it; one pass, not a fixpoint. named: the facts, if they are columns.
    """
    out = facts.withColumn("criteria_fired", F.array().cast("array<string>"))
    for key, pattern, adds in criteria:
        fired = holds(compiled(pattern, facts=named))
        out = out.withColumn("_fired", fired).withColumns(
            {
                "classes": F.when(F.col("_fired"), F.array_append("classes", F.lit(adds))).otherwise(F.col("classes")),
                "criteria_fired": F.when(F.col("_fired"), F.array_append("criteria_fired", F.lit(key))).otherwise(F.col("criteria_fired")),
            }
        )
    return out.drop("_fired")


def fired(rules: list[Rule], group: str, named: dict | None = None) -> Column:
    """An array of (rule, consequent fields) of the group's rules that fire, by priority and key."""
    own = sorted((r for r in rules if r.group == group), key=lambda r: (r.priority, r.key))
    names = sorted({k for r in own for k in r.consequent})
    rows = [F.when(holds(compiled(r.pattern, facts=named)), F.struct(F.lit(r.key).alias("rule"), *[F.lit(r.consequent.get(n)).alias(n) for n in names])) for r in own]
    return F.array_compact(F.array(*rows))


def dedication(required: Column, restrictive: bool = True) -> Column:
    """Of an array of nullable booleans: any TRUE; or, permissive, any TRUE and no explicit FALSE."""
    any_true = F.exists(required, lambda x: holds(x))
    return any_true if restrictive else any_true & ~F.exists(required, lambda x: holds(~x))


def highest(levels: Column, lattice: dict[str, int]) -> Column:
    """Of an array of levels, the one highest in the lattice (0 if unknown to it), the first among equals; the lowest of the lattice for none."""
    rank = F.create_map(*[F.lit(v) for kv in lattice.items() for v in kv])
    ranked = F.transform(levels, lambda x, i: F.struct(F.coalesce(F.element_at(rank, x), F.lit(0)).alias("rank"), (-i).alias("place"), x.alias("level")))
    return F.coalesce(F.array_max(ranked)["level"], F.lit(min(lattice, key=lattice.get)))
