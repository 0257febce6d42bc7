"""Markdown sections and mentions, and the graph's export: triples, Turtle, shapes and chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import module_stem, slug, turtle_literal
from skein.operators.graph import numbered, reach, tasks_for, unpacked
from skein.scratch import settle

_FENCE, _HEAD = re.compile(r"^ {0,3}(`{3,}|~{3,})"), re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_TICKS = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)")
_LINK = re.compile(r"\[[^\]]*\]\(([^)\s]+)")
_IDENT = re.compile(r"^(?:([A-Za-z_]\w*(?:(?:::|\.)[A-Za-z_]\w*)*)(?:::|\.))?([A-Za-z_]\w*)(?:\(\))?$")


def sections_of(text: str) -> list[dict]:
    """Sections in order with heading, depth and mentions (symbol, qualifier); fenced lines are no headings."""
    out, fence = [{"heading": None, "depth": 0, "mentions": [], "links": []}], None
    for line in (text or "").split("\n"):
        m = _FENCE.match(line)
        if m and (fence is None or line.strip().startswith(fence) and not line.strip().strip(fence[0])):
            fence = m[1] if fence is None else None
            continue
        if fence:
            continue
        h = _HEAD.match(line)
        if h:
            out.append({"heading": h[2], "depth": len(h[1]), "mentions": [], "links": []})
            line = h[2]
        for t in _TICKS.finditer(line):
            i = _IDENT.match(t[2].strip())
            if i:
                out[-1]["mentions"].append({"symbol": i[2], "qualifier": re.split(r"::|\.", i[1])[-1] if i[1] else None})
        out[-1]["links"] += _LINK.findall(line)
    return [s for s in out if s["heading"] is not None or s["mentions"] or s["links"]]


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, heading, depth, slug, mentions, links); slugs that repeat in a document get -1, -2, ..."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for pdf in batches:
            rows = [(k, n, s["heading"], s["depth"], s["mentions"], s["links"]) for k, t in zip(pdf[key], pdf[text]) for n, s in enumerate(sections_of(t))]
            yield pd.DataFrame(rows, columns=[key, "pos", "heading", "depth", "mentions", "links"])

    out = docs.select(key, text).mapInPandas(run, f"{key} {kind}, pos int, heading string, depth int, mentions array<struct<symbol:string,qualifier:string>>, links array<string>")
    return unique_slugs(out.withColumn("slug", slug(F.coalesce("heading", F.lit("")))), key, "slug", "pos")


def unique_slugs(rows: DataFrame, key: str, column: str, pos: str) -> DataFrame:
    w = Window.partitionBy(key, column).orderBy(pos)
    n = F.row_number().over(w) - 1
    return rows.withColumn("_n", n).withColumn(column, F.when(F.col("_n") > 0, F.concat_ws("-", F.col(column), F.col("_n").cast("string"))).otherwise(F.col(column))).drop("_n")


PART = 1000  # ids of one key that travel as one row


def pairs(left: DataFrame, right: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(a, b) of each row of `left` with each of `right` that has the same `by`. Both sides travel in arrays of about PART ids.

    Only chunks are joined, never by broadcast: their files look small, but as hash tables they would not fit the driver."""

    def packed(rows: DataFrame, value: str, chunk: str) -> DataFrame:
        rows = rows.select(value, *by)
        many = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / PART).alias("_parts")).where("_parts > 1")
        none = F.array_repeat(F.lit(None).cast(rows.schema[value].dataType), F.count_if(F.col(value).isNull()).cast("int"))
        placed = rows.join(many, by, "left").withColumn(chunk, F.pmod(F.xxhash64(value), F.coalesce("_parts", F.lit(1))))
        return placed.groupBy(*by, chunk).agg(F.concat(F.collect_list(value), none).alias(f"{value}_nodes"))

    count = lambda rows, name: rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    n = tasks_for(count(left, "_a").join(count(right, "_b"), by).agg(F.sum(F.col("_a") * F.col("_b"))))
    from_, to = packed(left, a, "_from"), packed(right, b, "_to")
    met = from_.select(*by, "_from").join(to.select(*by, "_to").hint("merge"), by).join(from_.hint("merge"), [*by, "_from"])
    met = met.repartition(n, *by, "_to").join(to.hint("merge"), [*by, "_to"])
    return unpacked(met.select(f"{a}_nodes", f"{b}_nodes"), a, b, n)


def mention_links(mentions: DataFrame, symbols: DataFrame) -> DataFrame:
    """(mention, node): symbols of a mention's bare name; a qualifier that is some candidate's module, case aside, narrows to those."""
    stem = F.lower(module_stem(F.col("file")))
    s = settle(symbols.select("node", F.col("name").alias("symbol"), stem.alias("stem")).distinct().withColumn("_again", F.count(F.lit(1)).over(Window.partitionBy("node")) > 1))
    m = mentions.select("mention", "symbol", F.lower("qualifier").alias("stem")).distinct().withColumn("_more", F.count(F.lit(1)).over(Window.partitionBy("mention")) > 1)
    known = s.select("symbol", "stem", F.lit(True).alias("_q")).distinct()
    narrow = F.coalesce(F.max("_q").over(Window.partitionBy("mention")), F.lit(False))  # any of a mention's names narrows them all
    m = settle(m.join(known, ["symbol", "stem"], "left").withColumn("_any", narrow))

    def links(some: DataFrame, to: DataFrame) -> DataFrame:
        return pairs(some.where("NOT _any"), to, "mention", "node", ["symbol"]).unionByName(pairs(some.where("_any AND _q"), to, "mention", "node", ["symbol", "stem"]))

    # a mention and a node that each stand once meet once
    lone, again = links(m.where("NOT _more"), s.where("NOT _again")), s.where("_again")
    if m.where("_more").isEmpty() and again.isEmpty():
        return lone
    return lone.unionByName(links(m.where("_more"), s).unionByName(links(m.where("NOT _more"), again)).distinct())


def import_edges(refs: DataFrame, modules: DataFrame) -> DataFrame:
    """(rel, target): distinct imports (rel, language, name) resolved to modules (rel, language) by stem, itself left out."""
    to = modules.select(F.col("rel").alias("target"), "language", module_stem(F.col("rel")).alias("name"))
    return refs.join(to, ["language", "name"]).where("rel <> target").select("rel", "target").distinct()


def first_of(rows: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """One row a key, the first in order, with all kinds that the key has."""
    w = Window.partitionBy(key).orderBy(*order)
    kinds = rows.groupBy(key).agg(F.array_sort(F.collect_set(kind)).alias("kinds"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").join(kinds, key)


def triples(*parts: DataFrame) -> DataFrame:
    """Distinct (s, p, o, o_kind)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("s", "p", "o", "o_kind").distinct()


def statements(rows: DataFrame, s: Column, p: str, o: Column, o_kind: str) -> DataFrame:
    return rows.select(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(o_kind).alias("o_kind"))


def code_triples(symbols: DataFrame, edges: DataFrame, base: str = "urn:code:") -> DataFrame:
    """Modules, symbols, where they are defined, and distinct calls."""
    iri = F.concat(F.lit(base), "file", F.lit("#"), "name")
    ids = symbols.withColumn("iri", iri)
    of = ids.select("node", "iri")
    calls = edges.join(of.withColumnsRenamed({"node": "src", "iri": "a"}), "src").join(of.withColumnsRenamed({"node": "dst", "iri": "b"}), "dst").select("a", "b").distinct()
    module = F.concat(F.lit(base), "file")
    return triples(
        statements(symbols.select("file").distinct(), module, "rdf:type", F.lit("code:Module"), "iri"),
        statements(ids, F.col("iri"), "rdf:type", F.lit("code:Symbol"), "iri"),
        statements(ids, F.col("iri"), "code:name", F.col("name"), "literal"),
        statements(ids, F.col("iri"), "code:kind", F.col("kind"), "literal"),
        statements(ids, F.col("iri"), "code:definedIn", module, "iri"),
        statements(calls, F.col("a"), "code:calls", F.col("b"), "iri"),
    )


def turtle(rows: DataFrame) -> DataFrame:
    """(value): one statement a line, for the text sink; order by it for one document."""
    o = F.when(F.col("o_kind") == "literal", turtle_literal(F.col("o"))).when(F.col("o").rlike(r"^[a-z]+:[A-Za-z]\w*$"), F.col("o")).otherwise(F.concat(F.lit("<"), "o", F.lit(">")))
    return rows.select(F.concat(F.lit("<"), "s", F.lit("> "), "p", F.lit(" "), o, F.lit(" .")).alias("value"))


_TURTLE = re.compile(r"""\s+|\#[^\n]*|(?P<text>\"{3}.*?\"{3}|"(?:[^"\\\n]|\\.)*")(?:\^\^[^\s;,.\])]+|@[\w-]+)?|(?P<iri><[^>\s]*>)|(?P<mark>[\[\]();,]|\.(?=\s|$))|(?P<word>@prefix|[^\s\[\]();,"<>]*[^\s\[\]();,"<>.]:?)""", re.S)


def turtle_nodes(text: str) -> tuple[dict[str, str], dict[str, list[tuple]]]:
    """The prefixes, and (predicate, object) pairs of each subject of a Turtle text; a blank node is a list of pairs, a collection a tuple, a string ('text', s)."""
    tokens, at = [], 0
    while at < len(text):
        m = _TURTLE.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"not Turtle at {text[at : at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append((None, None))
    prefixes, nodes, pos = {}, {}, 0

    def take(want: str | None = None):
        nonlocal pos
        kind, word = tokens[pos]
        if want and word != want or kind is None:
            raise ValueError(f"expected {want or 'more'}, found {word!r}")
        pos += 1
        return kind, word

    def thing():
        kind, word = take()
        if word == "[" and kind == "mark":
            found = pairs("]")
            take("]")
            return found
        if word == "(" and kind == "mark":
            found = []
            while tokens[pos][1] != ")":
                found.append(thing())
            take(")")
            return tuple(found)
        if kind == "text":
            inner = word[3:-3] if word.startswith('"""') else word[1:-1]
            return "text", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), inner)
        return word

    def pairs(end: str) -> list[tuple]:
        found = []
        while tokens[pos][1] != end:
            predicate = take()[1]
            found.append((predicate, thing()))
            while tokens[pos] == ("mark", ","):
                take()
                found.append((predicate, thing()))
            while tokens[pos] == ("mark", ";"):
                take()
        return found

    while tokens[pos][0]:
        if tokens[pos][1] == "@prefix":
            take()
            prefixes[take()[1].removesuffix(":")] = take()[1][1:-1]
        else:
            subject = take()[1]
            nodes.setdefault(subject, []).extend(pairs("."))
        take(".")
    return prefixes, nodes


# The terms of the shapes vocabulary that are tested here, and those that test nothing.
TESTED = ("sh:path", "sh:minCount", "sh:maxCount", "sh:in", "sh:nodeKind", "sh:datatype", "sh:class", "sh:pattern")
SAID_ONLY = ("a", "rdfs:comment", "rdfs:label", "sh:name", "sh:description", "sh:message", "sh:severity")


def read_shapes(text: str) -> list[dict]:
    """Shapes of a Turtle text, one for each property of a node shape and target; a term that is not tested is an error, not a pass."""
    out = []
    for subject, said in turtle_nodes(text)[1].items():
        if ("a", "sh:NodeShape") not in said:
            continue
        targets = [{"target": o} for p, o in said if p == "sh:targetClass"] + [{"subjects_of": o} for p, o in said if p == "sh:targetSubjectsOf"]
        if odd := {p for p, _ in said} - {"sh:targetClass", "sh:targetSubjectsOf", "sh:property", *SAID_ONLY}:
            raise ValueError(f"{subject}: {min(odd)} is not tested")
        for prop in (o for p, o in said if p == "sh:property"):
            have = dict(prop)
            if odd := have.keys() - {*TESTED, *SAID_ONLY}:
                raise ValueError(f"{subject}: {min(odd)} is not tested")
            literal = lambda v: v[1] if isinstance(v, tuple) else v
            shape = {"path": have["sh:path"], "min": have.get("sh:minCount"), "max": have.get("sh:maxCount"), "values": [literal(v) for v in have["sh:in"]] if "sh:in" in have else None, "node_kind": have["sh:nodeKind"].split(":")[1].lower() if "sh:nodeKind" in have else None}
            shape |= {"datatype": have.get("sh:datatype"), "to_class": have.get("sh:class"), "pattern": literal(have.get("sh:pattern"))}
            out += [t | {k: int(v) if k in ("min", "max") else v for k, v in shape.items() if v is not None} for t in targets]
    return out


_SHAPE = "shape int, target string, subjects_of string, path string, min int, max int, values array<string>, node_kind string, datatype string, to_class string, pattern string"
LEXICAL = {"xsd:integer": r"^[+-]?[0-9]+$", "xsd:boolean": "^(true|false|0|1)$", "xsd:decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"}


def shape_violations(rows: DataFrame, shapes: list[dict]) -> DataFrame:
    """(focus, path, constraint, value) of triples (s, p, o, o_kind): a shape is {target (a class) or subjects_of (a predicate), path, min, max, values, node_kind, datatype, to_class, pattern}.

    All shapes are tested in one pass: the few shapes meet subjects and values by class and predicate, then both meet by subject and
    shape, however many shapes there are. A datatype is told by a literal's form; xsd:string takes any literal."""
    names = [c.split()[0] for c in _SHAPE.split(", ")]
    table = F.broadcast(rows.sparkSession.createDataFrame([tuple([i, *(sh.get(n) for n in names[1:])]) for i, sh in enumerate(shapes)], _SHAPE))  # as many rows as the caller has shapes
    typed = rows.where("p = 'rdf:type'").select("s", F.col("o").alias("class")).distinct()
    focus = typed.join(table, F.col("class") == F.col("target")).select("s", "shape").unionByName(rows.join(table, F.col("p") == F.col("subjects_of")).select("s", "shape")).distinct()
    values = rows.join(table.select("shape", "path"), F.col("p") == F.col("path")).select("s", "shape", "o", "o_kind")
    met = focus.join(values, ["s", "shape"], "left")
    counted = met.groupBy("s", "shape").agg(F.count("o").alias("n")).join(table, "shape")
    one = lambda name, bad, value: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("constraint"), value.cast("string").alias("value")))
    counts = F.array(one("minCount", F.col("n") < F.col("min"), F.col("n")), one("maxCount", F.col("n") > F.col("max"), F.col("n")))
    right = typed.select(F.col("s").alias("o"), F.col("class").alias("to_class"), F.lit(True).alias("fits"))
    asked = met.where(F.col("o").isNotNull()).join(table, "shape").join(right, ["o", "to_class"], "left")
    literal, o = F.col("o_kind") == "literal", F.col("o")
    formed = F.lit(True)
    for name, pattern in LEXICAL.items():
        formed = F.when(F.col("datatype") == name, o.rlike(pattern)).otherwise(formed)
    each = F.array(
        one("in", ~F.array_contains("values", o), o), one("nodeKind", F.col("o_kind") != F.col("node_kind"), o), one("datatype", F.col("datatype").isNotNull() & ~(literal & formed), o),
        one("class", F.col("to_class").isNotNull() & (F.col("o_kind") == "iri") & F.col("fits").isNull(), o), one("pattern", F.col("pattern").isNotNull() & ~F.regexp_like(o, F.coalesce("pattern", F.lit(""))), o),
    )
    found = lambda frame, tests: frame.select(F.col("s").alias("focus"), "path", F.explode(F.array_compact(tests)).alias("v")).select("focus", "path", "v.*")
    return found(counted, counts).unionByName(found(asked, each))


def conforms(violations: DataFrame) -> DataFrame:
    return violations.agg((F.count(F.lit(1)) == 0).alias("conforms"), F.count(F.lit(1)).alias("violations"))


def class_predicates(shapes: list[dict]) -> list[str]:
    """The predicates whose objects must be typed in the payload that holds them."""
    return sorted({sh["path"] for sh in shapes if sh.get("to_class")})


def running(rows: DataFrame, value: str, name: str, block: int = 10_000) -> DataFrame:
    """rows (pos, ...) plus the sum of value up to and with each, in order of pos: within blocks of places, after the sums of the blocks before."""
    at = rows.withColumn("_b", F.floor(F.col("pos") / block))
    blocks = at.groupBy("_b").agg(F.sum(value).alias("_s"))  # a row for each `block` places
    before = blocks.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_before"))
    w = Window.partitionBy("_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("_own", F.sum(value).over(w)).join(before, "_b").withColumn(name, F.col("_before") + F.col("_own")).drop("_b", "_own", "_before")


def greedy_starts(sized: DataFrame, most: int) -> DataFrame:
    """(pos): where the chunks begin if rows (pos from 0, bytes) are packed in order, each chunk as full as `most` allows.

    Running sums say where a chunk that begins at a place must end: the first place whose sum passes that of the places before
    plus `most`. Sums are looked up in cells of `most` bytes, each sorted by itself. The starts are those that the first place reaches by these steps,
    found by doubling them: a round for each power of two of chunks."""
    upto = settle(running(sized, "bytes", "upto").select("pos", (F.col("upto") - F.col("bytes")).alias("before"), "upto"))
    n = upto.count()
    cell = lambda v: F.floor(v / most).cast("long")
    held = upto.withColumn("cell", F.explode(F.sequence(cell(F.col("before")), cell(F.col("upto"))))).select("cell", F.col("upto").alias("v"), F.lit(0).alias("asks"), "pos")
    asked = upto.select(cell(F.col("before") + most).alias("cell"), (F.col("before") + most).alias("v"), F.lit(1).alias("asks"), "pos")
    after = F.min(F.when(F.col("asks") == 0, F.col("pos"))).over(Window.partitionBy("cell").orderBy("v", "asks").rowsBetween(1, Window.unboundedFollowing))
    step = held.unionByName(asked).withColumn("to", after).where("asks = 1")
    steps = [settle(step.select("pos", F.greatest(F.coalesce("to", F.lit(n)), F.col("pos") + 1).alias("to")))]
    while n and (steps[-1].where("pos = 0").first()["to"]) < n:
        a, b = steps[-1], steps[-1].select(F.col("pos").alias("to"), F.col("to").alias("further"))
        steps.append(settle(a.join(b, "to", "left").select("pos", F.coalesce("further", F.lit(n)).alias("to"))))
    found = upto.where("pos = 0").select("pos")
    for s in reversed(steps):
        found = settle(found.unionByName(found.join(s, "pos").where(F.col("to") < n).select(F.col("to").alias("pos"))).distinct())
    return found


def chunks(rows: DataFrame, most: int = 1_500_000, needs: list[str] | str = ()) -> DataFrame:
    """(chunk, s, p, o, o_kind, carried): subjects whole, in order, packed greedily into chunks of at most `most` bytes; each chunk
    also carries the type statements of every object that a statement of a `needs` predicate points to and that it does not hold.

    A subject counts with its own statements and with the types that it needs, so that a chunk keeps to its size whatever it
    carries; a subject over `most` is a chunk of its own."""
    needs = [needs] if isinstance(needs, str) else list(needs)
    size = F.octet_length("s") + F.octet_length("p") + F.octet_length("o") + 12
    types = rows.where("p = 'rdf:type'").select(F.col("s").alias("o2"), F.col("o").alias("class")).distinct()
    cost = types.groupBy("o2").agg(F.sum(F.octet_length("o2") + F.octet_length(F.lit("rdf:type")) + F.octet_length("class") + 12).alias("cost"))
    links = rows.where(F.col("p").isin(*needs)).select("s", F.col("o").alias("o2")).distinct()
    carry = links.join(cost, "o2").groupBy("s").agg(F.sum("cost").alias("more"))
    subjects = rows.groupBy("s").agg(F.sum(size).alias("own")).join(carry, "s", "left").select("s", (F.col("own") + F.coalesce("more", F.lit(0))).alias("bytes"))
    placed = settle(numbered(subjects, ["s"], "pos"))
    starts = greedy_starts(placed.select("pos", "bytes"), most).withColumn("begins", F.lit(1))
    marked = running(placed.select("s", "pos").join(starts, "pos", "left").fillna(0, ["begins"]), "begins", "nth")
    home = settle(marked.select("s", (F.col("nth") - 1).cast("long").alias("chunk")))
    own = rows.join(home, "s").withColumn("carried", F.lit(False))
    wanted = links.join(home, "s").select("chunk", "o2").distinct().join(home.withColumnsRenamed({"s": "o2", "chunk": "home"}), "o2").where("chunk <> home")
    extra = wanted.join(types, "o2").select("chunk", F.col("o2").alias("s"), F.lit("rdf:type").alias("p"), F.col("class").alias("o"), F.lit("iri").alias("o_kind"), F.lit(True).alias("carried"))
    return own.select("chunk", "s", "p", "o", "o_kind", "carried").unionByName(extra.distinct())


def subclasses(rows: DataFrame, root: str, hops: int = 20) -> DataFrame:
    """Classes below root along rdfs:subClassOf, root itself at 0."""
    edges = rows.where("p = 'rdfs:subClassOf'").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    seed = rows.sparkSession.createDataFrame([(root,)], "node string")
    return seed.withColumn("distance", F.lit(0)).unionByName(reach(edges, seed, "callers", hops))
