"""From files to a graph: the working tree, a commit with or without checks, and the base that overlays stand on.

Sources are tables: files (rel, source, language), and for commits blobs (commit, rel, source)
with refs (ref, commit). Parsing is once a distinct content, edges are joins by name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import content_hash, language, vendored
from skein.operators import extract, graph
from skein.scratch import stable


class BaselineError(ValueError):
    """A base that cannot be built, which is not the same as an empty one."""


class NoRepository(BaselineError):
    """There is no commit at all."""


class UnresolvedRef(BaselineError):
    """The name stands for no commit."""


@dataclass
class Graph:
    """symbols (node, name, file, language, kind, scope, start_line, end_line), edges (src, dst) with parallel
    ones, and skipped (rel): files of a known language that could not be parsed."""

    symbols: DataFrame
    edges: DataFrame
    skipped: DataFrame


@dataclass
class Base:
    """A graph at a resolved commit, with files (rel, hash, symbols in order of definition)."""

    graph: Graph
    commit: str
    files: DataFrame


def node(rel, line, scope, name):
    """An id that stays the same while a symbol keeps its place."""
    return F.concat(rel, F.lit("#"), F.array_join(F.concat(scope, F.array(name)), "::"), F.lit("@"), line.cast("string"))


def build(files: DataFrame) -> Graph:
    """The graph of files (rel, source, language); files that do not parse are skipped and listed."""
    return assembled(stable(extract.structures(files)))


def assembled(found: DataFrame) -> Graph:
    """The graph of what extract.structures found in files: symbols as they are, calls resolved by name over all of them."""
    own = found.select("rel", "language", F.explode("symbols").alias("s"))
    symbols = own.select(node(F.col("rel"), F.col("s.start_line"), F.col("s.scope"), F.col("s.name")).alias("node"), "s.name", F.col("rel").alias("file"), "language", "s.kind", "s.scope", "s.start_line", "s.end_line").dropDuplicates(["node"])
    calls = found.select("rel", "language", F.explode("calls").alias("c")).select("language", "c.caller", "c.callee")
    return Graph(symbols, graph.call_edges(calls, symbols), found.where("NOT parsed").select("rel"))


def resolve(refs: DataFrame, name: str) -> str | None:
    """The full commit of a ref's name, or of a commit's prefix of at least seven digits that only one has."""
    exact = refs.where(F.col("ref") == name).select("commit").distinct().limit(2).collect()
    if not exact and len(name) >= 7:
        exact = refs.where(F.col("commit").startswith(name)).select("commit").distinct().limit(2).collect()
    return exact[0][0] if len(exact) == 1 else None


def files_at(blobs: DataFrame, commit: str | None) -> DataFrame:
    """(rel, source, language) of one commit in a known language, vendored ones left out; none for no commit."""
    at = blobs.where(F.col("commit") == commit) if commit else blobs.where("false")
    return at.withColumn("language", language(F.col("rel"))).where(F.col("language").isNotNull() & ~vendored(F.col("rel"))).select("rel", "source", "language")


def build_at(blobs: DataFrame, refs: DataFrame, name: str) -> Graph:
    """The graph at a ref; empty where the ref is unknown. Prefer build_checked where somebody reads the result."""
    return build(files_at(blobs, resolve(refs, name)))


def build_checked(blobs: DataFrame, refs: DataFrame, name: str) -> Graph:
    """The same; NoRepository or UnresolvedRef instead of an empty graph."""
    return base(blobs, refs, name).graph


def base(blobs: DataFrame, refs: DataFrame, name: str) -> Base:
    """The base at a ref: its graph, the commit that the ref stands for, and each file's hash and symbols."""
    if refs.isEmpty():
        raise NoRepository("no commits")
    commit = resolve(refs, name)
    if commit is None:
        raise UnresolvedRef(name)
    files = files_at(blobs, commit)
    made = build(files)
    names = made.symbols.groupBy(F.col("file").alias("rel")).agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "node", "name"))), lambda s: s["name"]).alias("symbols"))
    facts = files.select("rel", content_hash(F.col("source")).alias("hash")).join(names, "rel", "left")
    return Base(made, commit, facts.select("rel", "hash", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols")))


def refresh(made: Graph, changed: DataFrame) -> DataFrame:
    """(node) of the symbols of changed files (rel): what a rebuild without tenants makes anew."""
    return made.symbols.join(changed.select(F.col("rel").alias("file")).distinct(), "file", "left_semi").select("node")


def edit_cycle(symbols: DataFrame, edges: DataFrame, edited: DataFrame, hops: int = 5, fan_limit: int | None = 100) -> DataFrame:
    """One row a file of edited (file): its symbols, those with callers elsewhere, the callers' files, and how many nodes the change reaches.

    symbols and edges are the tenant's composed view after the edit. Each file is walked apart."""
    files = edited.select("file").distinct()
    own = stable(symbols.join(files, "file").select("file", "node", "name"))
    into = edges.select("src", "dst").distinct().join(own.select(F.col("node").alias("dst"), "file", "name"), "dst")
    outside = into.join(symbols.select(F.col("node").alias("src"), F.col("file").alias("_from")), "src").where("_from <> file")
    advised = outside.groupBy("file").agg(F.array_sort(F.collect_set("name")).alias("advised"), F.array_sort(F.collect_set("_from")).alias("files"))
    seeds = own.select(F.concat_ws("\x1f", "file", "name").alias("key"), "node", "file")
    found = graph.bounded_reach(edges, seeds.select("key", "node"), hops, fan_limit).join(seeds.select("key", "file").distinct(), "key").select("file", "node").distinct()
    frontier = found.join(own.select("file", "node"), ["file", "node"], "left_anti").groupBy("file").agg(F.count(F.lit(1)).alias("frontier"))
    out = files.join(own.groupBy("file").agg(F.count(F.lit(1)).alias("symbols")), "file", "left").join(advised, "file", "left").join(frontier, "file", "left").fillna(0, ["symbols", "frontier"])
    none = F.array().cast("array<string>")
    return out.select("file", "symbols", F.coalesce("advised", none).alias("advised"), F.coalesce("files", none).alias("files"), "frontier")
