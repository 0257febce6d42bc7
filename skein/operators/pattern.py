"""A small graph-pattern language, compiled to joins over a board.

    pattern = clause { "." clause } [ "|" filter { "," filter } ]
    clause  = ?var pair { ";" pair }        pair = ( "a" | name ) term
    term    = ?var | name | number | "string" | true | false
    filter  = ?var op term                  op = = != < <= > >=

A pair reads the subject's kind (`a`), else its attribute of that name, else an outgoing
relation. A free variable takes the first target in order of the relation's targets; a bound
one, or a name, needs only some matching target. That choice is fixed from clause order when
the pattern is compiled, so Catalyst may order the joins as it likes.

Boards are nodes (id, kind, attrs map<string, struct<t,b,n,s>>) and edges (source, relation,
target). Each variable is a column struct<node, value>, one of them null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE = "struct<t:string,b:boolean,n:double,s:string>"
BOUND = f"struct<node:string,value:{VALUE}>"


class PatternError(ValueError):
    """The pattern could not be read; says where."""


@dataclass(frozen=True)
class Term:
    kind: str  # var, name, number, string, bool
    value: object


@dataclass(frozen=True)
class Clause:
    subject: str
    pairs: tuple[tuple[str, Term], ...]


@dataclass(frozen=True)
class Filter:
    var: str
    op: str
    term: Term


@dataclass(frozen=True)
class Pattern:
    clauses: tuple[Clause, ...]
    filters: tuple[Filter, ...]

    def variables(self) -> list[str]:
        """In order of first mention in the clauses."""
        out = []
        for c in self.clauses:
            out += [c.subject] + [t.value for _, t in c.pairs if t.kind == "var"]
        return list(dict.fromkeys(out))

    def unbound_filters(self) -> list[str]:
        """Filter variables that no clause binds; a seed may still bind them."""
        known = self.variables()
        return [f.var for f in self.filters if f.var not in known]


_LEX = re.compile(r"""\s+|(?P<var>\?[A-Za-z_]\w*)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?(?![\w:]))|(?P<op><=|>=|!=|=|<|>)|(?P<mark>[.;|,])|(?P<name>[A-Za-z_][\w:\-/]*)""")


def lex(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise PatternError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    return out


def parse(text: str) -> Pattern:
    tokens = lex(text)
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else ("end", "", len(text))

    def take(kind: str, what: str = "") -> str:
        nonlocal at
        k, v, p = peek()
        if k != kind or what and v != what:
            raise PatternError(f"expected {what or kind} at {p}, found {v or 'the end'}")
        at += 1
        return v

    def term() -> Term:
        nonlocal at
        k, v, p = peek()
        if k not in ("var", "name", "number", "string"):
            raise PatternError(f"expected a term at {p}, found {v or 'the end'}")
        at += 1
        if k == "string":
            return Term(k, re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), v[1:-1]))
        if k == "number":
            return Term(k, float(v))
        if k == "name" and v in ("true", "false"):
            return Term("bool", v == "true")
        return Term(k, v[1:] if k == "var" else v)

    def clause() -> Clause:
        subject = take("var")[1:]
        pairs = []
        while True:
            pairs.append((take("name"), term()))
            if peek()[1] != ";":
                return Clause(subject, tuple(pairs))
            take("mark", ";")

    clauses, filters = [clause()], []
    while peek()[1] == ".":
        take("mark", ".")
        clauses.append(clause())
    if peek()[1] == "|":
        take("mark", "|")
        while True:
            var = take("var")[1:]
            filters.append(Filter(var, take("op"), term()))
            if peek()[1] != ",":
                break
            take("mark", ",")
    if peek()[0] != "end":
        raise PatternError(f"unexpected {peek()[1]!r} at {peek()[2]}")
    return Pattern(tuple(clauses), tuple(filters))


def value(kind: str, content) -> Column:
    """A literal attribute value."""
    parts = {"bool": ("bool", "boolean", "b"), "number": ("num", "double", "n"), "string": ("str", "string", "s")}[kind]
    fields = [F.lit(parts[0]).alias("t")] + [F.lit(content if f == parts[2] else None).cast(t).alias(f) for f, t in (("b", "boolean"), ("n", "double"), ("s", "string"))]
    return F.struct(*fields)


def number(column: Column) -> Column:
    return F.struct(F.lit("num").alias("t"), F.lit(None).cast("boolean").alias("b"), column.cast("double").alias("n"), F.lit(None).cast("string").alias("s"))


def string(column: Column) -> Column:
    return F.struct(F.lit("str").alias("t"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("double").alias("n"), column.cast("string").alias("s"))


def as_node(column: Column) -> Column:
    return F.when(column.isNotNull(), F.struct(column.cast("string").alias("node"), F.lit(None).cast(VALUE).alias("value")))


def as_value(column: Column) -> Column:
    return F.when(column.isNotNull(), F.struct(F.lit(None).cast("string").alias("node"), column.alias("value")))


def same(bound: Column, term: Term) -> Column:
    """Does a bound thing equal a constant? A bare name equals a node's id or a string value."""
    if term.kind == "name":
        return (bound["node"].eqNullSafe(F.lit(term.value))) | ((bound["value"]["t"] == "str") & bound["value"]["s"].eqNullSafe(F.lit(term.value)))
    return bound["value"].eqNullSafe(value(term.kind, term.value))


def evaluate(pattern: Pattern, nodes: DataFrame, edges: DataFrame, seed: DataFrame | None = None, bound: tuple[str, ...] = ()) -> DataFrame:
    """Distinct bindings, a column v_<name> a variable. A seed holds such columns for `bound` and any others."""
    rows, known = seed, list(bound)
    carried = [c for c in seed.columns if not c.startswith("v_")] if seed is not None else []
    for n, clause in enumerate(pattern.clauses):
        cols = [F.col("id").alias(f"_i{n}"), F.col("kind").alias(f"_k{n}"), F.col("attrs").alias(f"_a{n}")]
        here = nodes.select(*cols)
        subject = f"v_{clause.subject}"
        if rows is None:
            rows = here.withColumn(subject, as_node(F.col(f"_i{n}")))
        elif clause.subject in known:
            rows = rows.join(here, F.col(subject)["node"] == F.col(f"_i{n}"))
        else:
            rows = _candidates(rows, clause, nodes, edges, known, f"_i{n}").join(here, f"_i{n}").withColumn(subject, as_node(F.col(f"_i{n}")))
        if clause.subject not in known:
            known.append(clause.subject)
        for m, (name, term) in enumerate(clause.pairs):
            rows = _pair(rows, edges, known, f"_i{n}", f"_k{n}", f"_a{n}", name, term, f"{n}_{m}")
            if term.kind == "var" and term.value not in known:
                known.append(term.value)
        rows = rows.drop(f"_i{n}", f"_k{n}", f"_a{n}")
    for f in pattern.filters:
        if f.var in known:
            rows = rows.where(_filter(F.col(f"v_{f.var}"), f, known))
        else:
            rows = rows.where("false")
    return rows.select(*carried, *(f"v_{v}" for v in known)).distinct()


def _candidates(rows: DataFrame, clause, nodes: DataFrame, edges: DataFrame, known: list[str], i: str) -> DataFrame:
    """rows with each node that a clause of a new subject can mean: those tied to a bound variable, by an edge
    to its node or an attribute of its value. Only where no pair is bound are all nodes meant."""
    tied = [(name, term) for name, term in clause.pairs if name != "a" and term.kind == "var" and term.value in known]
    if not tied:
        return rows.join(nodes.select(F.col("id").alias(i)), F.lit(True))
    name, term = tied[0]
    bound = F.col(f"v_{term.value}")
    to = edges.where(F.col("relation") == name).select(F.col("source").alias(i), F.col("target").alias("_to")).distinct()
    held = nodes.where(F.map_contains_key("attrs", F.lit(name))).select(F.col("id").alias(i), as_value(F.col("attrs")[name])["value"].alias("_to"))
    return rows.join(to, bound["node"] == F.col("_to")).drop("_to").unionByName(rows.where(bound["value"].isNotNull()).join(held, bound["value"].eqNullSafe(F.col("_to"))).drop("_to"))


def _pair(rows: DataFrame, edges: DataFrame, known: list[str], i: str, k: str, a: str, name: str, term: Term, tag: str) -> DataFrame:
    free = term.kind == "var" and term.value not in known
    if name == "a":
        kind = as_value(string(F.col(k)))
        if free:
            return rows.withColumn(f"v_{term.value}", kind)
        hit = kind.eqNullSafe(F.col(f"v_{term.value}")) if term.kind == "var" else F.col(k) == F.lit(term.value)
        return rows.where(hit)
    has = F.map_contains_key(F.col(a), F.lit(name))
    attr = as_value(F.col(a)[name])
    mine = edges.where(F.col("relation") == name)
    if free:
        first = mine.groupBy("source").agg(F.min("target").alias(f"_t{tag}"))
        out = rows.join(first, F.col(i) == F.col("source"), "left").drop("source")
        out = out.withColumn(f"v_{term.value}", F.when(has, attr).otherwise(as_node(F.col(f"_t{tag}")))).drop(f"_t{tag}")
        return out.where(F.col(f"v_{term.value}").isNotNull())
    if term.kind == "var":
        to = mine.select(F.col("source").alias(f"_s{tag}"), F.col("target").alias(f"_t{tag}"), F.lit(True).alias(f"_h{tag}")).distinct()
        out = rows.join(to, (F.col(i) == F.col(f"_s{tag}")) & (F.col(f"v_{term.value}")["node"] == F.col(f"_t{tag}")), "left")
        ok = F.when(has, attr.eqNullSafe(F.col(f"v_{term.value}"))).otherwise(F.coalesce(f"_h{tag}", F.lit(False)))
        return out.where(ok).drop(f"_s{tag}", f"_t{tag}", f"_h{tag}")
    if term.kind != "name":
        return rows.where(has & same(attr, term))
    to = mine.where(F.col("target") == term.value).select(F.col("source").alias(f"_s{tag}"), F.lit(True).alias(f"_h{tag}")).distinct()
    out = rows.join(to, F.col(i) == F.col(f"_s{tag}"), "left")
    ok = F.when(has, same(attr, term)).otherwise(F.coalesce(f"_h{tag}", F.lit(False)))
    return out.where(ok).drop(f"_s{tag}", f"_h{tag}")


def _filter(left: Column, f: Filter, known: list[str]) -> Column:
    """Typed equality; order only between numbers, anything else is false."""
    if f.term.kind == "var":
        right = F.col(f"v_{f.term.value}") if f.term.value in known else F.lit(None).cast(BOUND)
        equal, number_ = left.eqNullSafe(right), right["value"]["n"]
    else:
        equal = same(left, f.term)
        number_ = F.lit(f.term.value if f.term.kind == "number" else None).cast("double")
    if f.op in ("=", "!="):
        return equal if f.op == "=" else ~equal
    n = left["value"]["n"]
    test = {"<": n < number_, "<=": n <= number_, ">": n > number_, ">=": n >= number_}[f.op]
    return F.coalesce(test, F.lit(False))


def filter_warnings(pattern: Pattern, rows: DataFrame) -> DataFrame:
    """(filter, rows) of order filters that met something that is no number; rows are bindings before the filters."""
    out = None
    for f in pattern.filters:
        if f.op in ("=", "!=") or f.var not in pattern.variables():
            continue
        odd = rows.where(F.coalesce(F.col(f"v_{f.var}")["value"]["t"], F.lit("")) != "num").agg(F.lit(f"?{f.var} {f.op} {f.term.value}").alias("filter"), F.count(F.lit(1)).alias("rows"))
        out = odd if out is None else out.unionByName(odd)
    return out
