"""Queries over triples by text: SELECT with FILTER, OPTIONAL, UNION, paths by `+`, DISTINCT, ORDER BY, LIMIT, OFFSET.

A query text becomes a small tree (group, union, optional, filter, triple), and the tree becomes joins, left joins, unions
and the library's closure over the triples table; Catalyst plans them. Solutions are columns by variable, and the result's
columns are `col_0`, `col_1` … in the order of the SELECT, as a reader without names expects.

Terms: `?name`, `<iri>`, `prefix:local` (as it stands where no PREFIX names it), `"text"`, numbers, `a` for rdf:type.
Literals and IRIs are compared as the text of the column. Filters compare terms by = != < <= > >= (numbers where both
sides are), join by && || !, and know CONTAINS, STRSTARTS, REGEX, BOUND. A comparison with an unbound variable is an
error, which is NULL here and drops the row, as the language asks.

Defined cases: an empty table or a pattern without a match gives no rows; SELECT * takes the variables in order of
appearance; a variable that a branch of a UNION or an OPTIONAL doesn't bind is NULL and agrees with anything it meets
later; patterns that share no variable that is always bound would make a cross product, and are refused like an error
of form.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.graph import O_PLACES, _o_triples, ancestors, place_edges, place_triples
from quernstone.sources.tables import table

#: The predicate that `a` stands for, and the words of the language.
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<text>"(?:[^"\\]|\\.)*")|(?P<var>\?\w+)|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w-]*:[\w.-]*\w|[A-Za-z_][\w-]*:|_:\w+)|(?P<word>[A-Za-z]\w*)|(?P<mark>&&|\|\||!=|<=|>=|[{}().;,+*=<>!])""")


class QueryError(ValueError):
    """A text that is no query, with the place of what is wrong."""


@dataclass
class Triple:
    s: str
    p: str
    o: str
    plus: bool = False


@dataclass
class Group:
    """Parts in order: Triple, Group (nested), ("union", groups), ("optional", group); filters hold for the whole group."""

    parts: list = field(default_factory=list)
    filters: list = field(default_factory=list)


@dataclass
class Select:
    columns: list[str]
    where: Group
    distinct: bool = False
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class _Reader:
    """One pass over the tokens of a text."""

    def __init__(self, text: str):
        self.tokens, self.at, self.prefixes, self.seen = [], 0, {}, []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryError(f"{text[at : at + 10]!r} at {at} is no part of a query")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", len(text)))

    def peek(self) -> str:
        kind, text, _ = self.tokens[self.at]
        return text.upper() if kind == "word" else text

    def take(self) -> tuple[str, str]:
        kind, text, _ = self.tokens[self.at]
        self.at += kind != "end"
        return kind, text

    def wrong(self, wanted: str) -> QueryError:
        _, text, at = self.tokens[self.at]
        return QueryError(f"{wanted} expected at {at}, found {text or 'the end'!r}")

    def has(self, word: str) -> bool:
        if self.peek() != word or self.tokens[self.at][0] == "text":
            return False
        self.at += 1
        return True

    def need(self, word: str) -> None:
        if not self.has(word):
            raise self.wrong(repr(word))

    def variable(self) -> str:
        if self.tokens[self.at][0] != "var":
            raise self.wrong("a variable")
        return self.take()[1]

    def number(self) -> int:
        if not self.tokens[self.at][1].isdigit():
            raise self.wrong("a whole number")
        return int(self.take()[1])

    def term(self, verb: bool = False) -> str:
        """A variable with its mark, or the text of a constant after a `=`."""
        kind, text, _ = self.tokens[self.at]
        if kind not in ("iri", "text", "var", "number", "name") and not (verb and text == "a"):
            raise self.wrong("a term")
        self.at += 1
        if kind == "var":
            if text not in self.seen:
                self.seen.append(text)
            return text
        if kind == "name":
            prefix, _, local = text.partition(":")
            return "=" + (self.prefixes[prefix] + local if prefix in self.prefixes else text)
        return "=" + {"iri": text[1:-1], "text": re.sub(r"\\(.)", r"\1", text[1:-1]), "number": text, "word": TYPE}[kind]

    def select(self) -> Select:
        while self.has("PREFIX"):
            kind, name = self.take()
            kind, iri = self.take() if kind == "name" and name.endswith(":") else ("", "")
            if kind != "iri":
                self.at -= 1
                raise self.wrong("a prefix and its <iri>")
            self.prefixes[name[:-1]] = iri[1:-1]
        self.need("SELECT")
        distinct, names = self.has("DISTINCT"), []
        while self.tokens[self.at][0] == "var":
            names.append(self.variable())
        all_ = not names
        if all_:
            self.need("*")
        self.has("WHERE")
        q = Select(names, self.group(), distinct)
        if all_:
            q.columns = list(self.seen)
        if self.has("ORDER"):
            self.need("BY")
            while self.peek() in ("ASC", "DESC") or self.tokens[self.at][0] == "var":
                down = self.peek() == "DESC"
                if self.has("ASC") or self.has("DESC"):
                    self.need("(")
                    q.order.append((self.variable(), down))
                    self.need(")")
                else:
                    q.order.append((self.variable(), False))
            if not q.order:
                raise self.wrong("a variable")
        while self.peek() in ("LIMIT", "OFFSET"):
            if self.has("LIMIT"):
                q.limit = self.number()
            else:
                self.need("OFFSET")
                q.offset = self.number()
        if self.tokens[self.at][0] != "end":
            raise self.wrong("the end")
        return q

    def group(self) -> Group:
        self.need("{")
        g = Group()
        while not self.has("}"):
            if self.has("FILTER"):
                g.filters.append(self.condition())
            elif self.has("OPTIONAL"):
                g.parts.append(("optional", self.group()))
            elif self.peek() == "{":
                branches = [self.group()]
                while self.has("UNION"):
                    branches.append(self.group())
                g.parts.append(("union", branches))
            else:
                self.triples(g)
            self.has(".")
        return g

    def triples(self, g: Group) -> None:
        """A subject with its predicates and their objects; the next one begins after a `.`."""
        s = self.term()
        while True:
            p = self.term(verb=True)
            plus = self.has("+")
            if plus and p.startswith("?"):
                raise self.wrong("a constant before '+'")
            g.parts.append(Triple(s, p, self.term(), plus))
            while self.has(","):
                g.parts.append(Triple(s, p, self.term(), plus))
            if not self.has(";"):
                return
            if self.peek() in (".", "}"):
                return

    def condition(self) -> tuple:
        left = self.conjunction()
        while self.has("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.test()
        while self.has("&&"):
            left = ("and", left, self.test())
        return left

    def test(self) -> tuple:
        if self.has("!"):
            return ("not", self.test())
        if self.has("("):
            inner = self.condition()
            self.need(")")
            return inner
        word = self.peek()
        if word in ("BOUND", "CONTAINS", "STRSTARTS", "REGEX") and self.tokens[self.at][0] == "word":
            self.at += 1
            self.need("(")
            args = [self.variable() if word == "BOUND" else self.term()]
            if word != "BOUND":
                self.need(",")
                args.append(self.term())
            self.need(")")
            return (word, *args)
        left = self.term()
        if self.peek() not in ("=", "!=", "<", "<=", ">", ">="):
            raise self.wrong("a comparison")
        return ("compare", self.take()[1], left, self.term())


def parsed(text: str) -> Select:
    """The tree of a query text, or a QueryError that names the place."""
    return _Reader(text).select()


def _term(x: str, columns: list[str]) -> Column:
    if not x.startswith("?"):
        return F.lit(x[1:])
    return F.col(x[1:]) if x[1:] in columns else F.lit(None).cast("string")


def _filter(c: tuple, columns: list[str]) -> Column:
    """A condition as a column; NULL is an error."""
    if c[0] in ("and", "or"):
        a, b = (_filter(x, columns) for x in c[1:])
        return a & b if c[0] == "and" else a | b
    if c[0] == "not":
        return ~_filter(c[1], columns)
    if c[0] == "BOUND":
        return _term(c[1], columns).isNotNull()
    if c[0] == "compare":
        a, b = (_term(x, columns) for x in c[2:])
        m, n = a.try_cast("double"), b.try_cast("double")
        by = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}[c[1]]
        return F.when(m.isNotNull() & n.isNotNull(), by(m, n)).otherwise(by(a, b))
    a, b = (_term(x, columns) for x in c[1:])
    return {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "REGEX": F.rlike}[c[0]](a, b)


def _triple(triples: DataFrame, t: Triple) -> DataFrame:
    """The solutions of one pattern; `p+` goes over the closure of one predicate."""
    if t.plus:
        own = triples.filter(F.col("p") == t.p[1:]).select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct()
        far = ancestors(own).select(F.col("node").alias("s"), F.col("ancestor").alias("o"))
        terms, rows = (("s", t.s), ("o", t.o)), far.unionByName(_cycles(own, far))
    else:
        terms, rows = (("s", t.s), ("p", t.p), ("o", t.o)), triples
    first: dict[str, str] = {}
    for c, x in terms:
        if not x.startswith("?"):
            rows = rows.filter(F.col(c) == x[1:])
        elif x in first:
            rows = rows.filter(F.col(c) == F.col(first[x]))
        else:
            first[x] = c
    return rows.select(*[F.col(c).alias(x[1:]) for x, c in first.items()]) if first else rows.select(F.lit(True).alias(HOLDS)).limit(1)


#: The column of a pattern without variables: one row if it holds.
HOLDS = "_holds"


def _cycles(edges: DataFrame, far: DataFrame) -> DataFrame:
    """(s, o) of nodes that reach themselves, which a closure over different nodes leaves out."""
    back = far.join(edges.select(F.col("child").alias("o"), F.col("parent").alias("s")), ["s", "o"], "left_semi").select("s", F.col("s").alias("o"))
    own = edges.filter("child = parent").select(F.col("child").alias("s"), F.col("parent").alias("o"))
    return back.unionByName(own).distinct()


def _joined(a: DataFrame, b: DataFrame, loose: set[str], how: str = "inner", also: list[tuple] = ()) -> DataFrame:
    """Solutions that agree on what both bind. A variable among `loose` may be NULL on a side, and then takes the other's value; `also`: conditions of the join."""
    for x, y in ((a, b), (b, a)):
        if HOLDS in y.columns:  # one row at most, so a semi join on a constant
            return x if how == "left" else x.withColumn("_g", F.lit(True)).join(y.select(F.col(HOLDS).alias("_g")), "_g", "left_semi").drop("_g")
    shared = [c for c in a.columns if c in b.columns]
    firm = [c for c in shared if c not in loose]
    if not firm:
        raise QueryError(f"patterns over {sorted(a.columns)} and {sorted(b.columns)} share no variable that is always bound")
    right = b.select(*[F.col(c).alias(f"_r_{c}" if c in shared else c) for c in b.columns])
    meets = lambda c: F.col(c) == F.col(f"_r_{c}") if c in firm else F.col(c).isNull() | F.col(f"_r_{c}").isNull() | (F.col(c) == F.col(f"_r_{c}"))
    names = a.columns + [c for c in b.columns if c not in shared]
    j = a.join(right, reduce(Column.__and__, [meets(c) for c in shared] + [_filter(c, names) for c in also]), how)
    return j.select(*[(F.coalesce(c, f"_r_{c}") if c in shared and c in loose else F.col(c)).alias(c) for c in names])


def _next(todo: list, found: DataFrame | None) -> int:
    """The first part that shares a variable with what is found; nothing passes an OPTIONAL."""
    for i, x in enumerate(todo):
        if isinstance(x, tuple) and x[0] == "optional":
            break
        if found is None or not _variables(x) or _variables(x) & set(found.columns):
            return i
    return 0


def _solved(triples: DataFrame, g: Group, outer: list[str] | None = None, told: set[str] | None = None) -> tuple[DataFrame, set[str], list]:
    """Solutions of a group, the variables that may be unbound in them, and the filters of an OPTIONAL that ask for variables of the group around it.

    told: the variables whose values a DISTINCT result shows. Of an OPTIONAL's other variables that nothing else asks for, it only
    counts that they are bound: its solutions are then told apart by the rest alone, and don't multiply those they are joined with.
    """
    found, maybe, todo = None, set(), list(g.parts)
    while todo:
        part = todo.pop(_next(todo, found))
        if isinstance(part, Triple):
            rows, may = _triple(triples, part), set()
        elif part[0] == "union":
            solved = [_solved(triples, b) for b in part[1]]
            names = list(dict.fromkeys(c for rows, _, _ in solved for c in rows.columns))
            may = {c for c in names if any(c not in rows.columns or c in m for rows, m, _ in solved)}
            wide = [rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in names]) for rows, _, _ in solved]
            rows = reduce(DataFrame.unionByName, wide)
        else:
            if found is None:
                raise QueryError("an OPTIONAL needs a pattern before it")
            sure = set(found.columns) - maybe
            rows, may, left = _solved(triples, part[1], found.columns)
            if told is not None:
                asked = told | set(found.columns) | set().union(*map(_variables, todo)) | set().union(*map(_values, [*g.filters, *left]))
                mute = [c for c in rows.columns if c not in asked]
                if mute:
                    rows = rows.select(*[F.when(F.col(c).isNotNull(), "").alias(c) if c in mute else F.col(c) for c in rows.columns]).distinct()
            found = _joined(found, rows, maybe | may, "left", left)
            maybe = set(found.columns) - sure
            continue
        sure = set(rows.columns) - may
        if found is not None:
            sure |= set(found.columns) - maybe
            rows = _joined(found, rows, maybe | may)
        found, maybe = rows, set(rows.columns) - sure
    if found is None:
        raise QueryError("a group without a pattern")
    inner = [c for c in g.filters if outer and _asks(c) - set(found.columns) and _asks(c) & set(outer)]
    for c in g.filters:
        if c not in inner:
            found = found.filter(_filter(c, found.columns))
    return found, maybe, inner


def _variables(x) -> set[str]:
    if isinstance(x, Triple):
        return {t[1:] for t in (x.s, x.p, x.o) if t.startswith("?")}
    if isinstance(x, Group):
        return set().union(*[_variables(p) for p in x.parts]) if x.parts else set()
    return set().union(*[_variables(g) for g in (x[1] if x[0] == "union" else [x[1]])])


def _asks(c: tuple) -> set[str]:
    return set().union(*[_asks(x) if isinstance(x, tuple) else {x[1:]} if isinstance(x, str) and x.startswith("?") else set() for x in c[1:]], set())


def _values(c: tuple) -> set[str]:
    """The variables whose values a filter asks for, not only whether they are bound."""
    return set() if c[0] == "BOUND" else set().union(*[_values(x) if isinstance(x, tuple) else {x[1:]} if isinstance(x, str) and x.startswith("?") else set() for x in c[1:]], set())


def select(triples: DataFrame, text: str) -> DataFrame:
    """The result of a query over triples (s, p, o), a set as the functions of `graph` make it; its columns are `col_0` and on."""
    q = parsed(text)
    for v in q.columns + [v for v, _ in q.order]:
        if v[1:] not in _variables(q.where):
            raise QueryError(f"{v} is in no pattern")
    if not q.columns:
        raise QueryError("a query without variables")
    if q.distinct and not {v for v, _ in q.order} <= set(q.columns):
        raise QueryError("DISTINCT with an order by a variable that isn't selected")
    rows, _, _ = _solved(triples, q.where, told={v[1:] for v in q.columns} if q.distinct else None)
    cols = [v[1:] for v in q.columns]
    if q.distinct:
        rows = rows.select(*dict.fromkeys(cols)).distinct()
    if q.order:
        keys = []
        for v, down in q.order:  # unbound first, then numbers, then text
            c, number = F.col(v[1:]), F.col(v[1:]).try_cast("double")
            keys += [c.isNotNull().desc(), number.desc_nulls_first(), c.desc()] if down else [c.isNotNull().asc(), number.asc_nulls_last(), c.asc()]
        rows = rows.orderBy(*keys)
    if q.offset:
        rows = rows.offset(q.offset)
    if q.limit is not None:
        rows = rows.limit(q.limit)
    return rows.select(*[F.col(c).alias(f"col_{i}") for i, c in enumerate(cols)])


# queries


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, suppliers and notes; who lies below whom; suppliers' balances, and nations that a customer in debt lives in."""
    below = place_edges(spark, sf_dir).select(F.col("child").alias("s"), F.lit("below").alias("p"), F.col("parent").alias("o"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("s"), F.lit("balance").alias("p"), F.round("s_acctbal").cast("long").cast("string").alias("o"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("n:"), "c_nationkey").alias("s"), F.lit("debtor").alias("p"), F.concat(F.lit("c"), "c_custkey").alias("o"))
    return reduce(DataFrame.unionByName, (place_triples(spark, sf_dir, 2), below, s, c))


_O = f"""WITH RECURSIVE {O_PLACES}, {_o_triples(2)},
t AS (SELECT * FROM t2 UNION SELECT child, 'below', parent FROM e UNION SELECT concat('s:', s_suppkey), 'balance', round(s_acctbal)::BIGINT::VARCHAR FROM supplier
  UNION SELECT concat('n:', c_nationkey), 'debtor', concat('c', c_custkey) FROM customer WHERE c_acctbal < 0)"""
#: Query texts by name, each with its SQL.
TEXTS = {
    "triples_filter": (
        """SELECT ?s ?l WHERE { ?n <label> ?l ; <in> ?r . ?s <at> ?n
           FILTER (?r = r:1 || ?r = <r:2> && !CONTAINS(?l, "II")) FILTER REGEX(?s, "[1-5]$") }""",
        f"""{_O} SELECT a.s AS col_0, l.o AS col_1 FROM t l JOIN t i ON i.s = l.s AND i.p = 'in' JOIN t a ON a.o = l.s AND a.p = 'at' WHERE l.p = 'label' AND (i.o = 'r:1' OR (i.o = 'r:2' AND NOT contains(l.o, 'II'))) AND regexp_matches(a.s, '[1-5]$')""",
    ),
    "triples_optional": (
        """PREFIX q: <> # a nation's note, and its debtors if its label says so
           SELECT ?n ?t ?c { ?n q:in ?r . OPTIONAL { ?n <note> ?b . ?b <text> ?t } ?n <label> ?l OPTIONAL { ?n <debtor> ?c FILTER (CONTAINS(?l, "1")) } }""",
        f"""{_O} SELECT i.s AS col_0, x.o AS col_1, c.o AS col_2 FROM t i JOIN t l ON l.s = i.s AND l.p = 'label' LEFT JOIN (SELECT n.s, m.o FROM t n JOIN t m ON m.s = n.o AND m.p = 'text' WHERE n.p = 'note') x ON x.s = i.s
LEFT JOIN t c ON c.s = i.s AND c.p = 'debtor' AND contains(l.o, '1') WHERE i.p = 'in'""",
    ),
    "triples_union": (
        """SELECT ?x ?v { { ?x <at> ?n } UNION { ?n <debtor> ?x . ?n <note> ?v } ?n <in> r:3 }""",
        f"""{_O} SELECT x AS col_0, v AS col_1 FROM (SELECT s AS x, o AS n, NULL AS v FROM t WHERE p = 'at' UNION ALL SELECT a.o, a.s, b.o FROM t a JOIN t b ON a.s = b.s AND b.p = 'note' WHERE a.p = 'debtor') JOIN t i ON i.s = n AND i.p = 'in' AND i.o = 'r:3'""",
    ),
    "triples_path": (
        """SELECT ?x ?y { ?x <below>+ ?y . ?y <below> <world> FILTER STRSTARTS(?x, "s") }""",
        f"""{_O} SELECT node AS col_0, ancestor AS col_1 FROM a JOIN t ON t.s = ancestor AND t.p = 'below' AND t.o = 'world' WHERE starts_with(node, 's')""",
    ),
    "triples_top": (
        """SELECT ?s ?b { ?s <balance> ?b ; <at> ?n . ?n <in> ?r FILTER (?b >= 0 && ?b != 77) } ORDER BY DESC(?b) ?s LIMIT 12 OFFSET 3""",
        f"""{_O} SELECT b.s AS col_0, b.o AS col_1 FROM t b JOIN t a ON a.s = b.s AND a.p = 'at' JOIN t i ON i.s = a.o AND i.p = 'in' WHERE b.p = 'balance' AND b.o::BIGINT >= 0 AND b.o::BIGINT <> 77 ORDER BY b.o::BIGINT DESC, b.s LIMIT 12 OFFSET 3""",
    ),
    "triples_negation": (
        """SELECT DISTINCT ?r { ?s <at> ?n ; <balance> ?b . ?n <in> ?r OPTIONAL { ?n <debtor> ?c } FILTER (!BOUND(?c) || ?b < 0) }""",
        f"""{_O} SELECT DISTINCT i.o AS col_0 FROM t a JOIN t b ON b.s = a.s AND b.p = 'balance' JOIN t i ON i.s = a.o AND i.p = 'in' LEFT JOIN t c ON c.s = a.o AND c.p = 'debtor' WHERE a.p = 'at' AND (c.o IS NULL OR b.o::BIGINT < 0)""",
    ),
}


def _query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select(places(spark, sf_dir), text)

    return run


QUERIES = {name: _query(text) for name, (text, _) in TEXTS.items()}
ORACLES = {name: sql for name, (_, sql) in TEXTS.items()}
