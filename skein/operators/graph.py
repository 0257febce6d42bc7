"""Name-resolved edges, hop-bounded reachability and what is computed from them.

Facts are tables: symbols(node, name, file, language, ...), calls(language, caller, callee, ...)
and edges(src, dst). Every traversal is one loop over frontiers: a hop joins the last frontier
with the edges and keeps what has not been seen, so each node is expanded once. A hop's new
nodes are written to the shared folder, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import intervals
from skein.scratch import discard, is_scan, settle


def next_edges(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(src, dst) of each value and the next one of its group, distinct and without loops."""
    after = F.lead(value).over(Window.partitionBy(group).orderBy(*order))
    return rows.select(F.col(value).alias("src"), after.alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()


def call_edges(calls: DataFrame, symbols: DataFrame, as_set: bool = False) -> DataFrame:
    """Calls resolved by name and language to (src, dst): many to many, parallel edges kept unless as_set."""
    caller = symbols.select(F.col("node").alias("src"), "language", F.col("name").alias("caller"))
    callee = symbols.select(F.col("node").alias("dst"), "language", F.col("name").alias("callee"))
    out = calls.join(caller, ["language", "caller"]).join(callee, ["language", "callee"]).where("src <> dst").select("src", "dst")
    return out.distinct() if as_set else out


def callers_by_callee(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (callee, caller node); the callee itself may be undefined."""
    caller = symbols.select(F.col("node").alias("caller_node"), "language", F.col("name").alias("caller"))
    return calls.select("language", "caller", "callee").distinct().join(caller, ["language", "caller"]).select("language", "callee", "caller_node").distinct()


CHUNK = 1000  # nodes of one name that travel as one row
PAIRS = 16_000_000  # pairs that a task makes, about


def tasks_for(pairs: DataFrame) -> int:
    """Tasks for as many pairs as the one number in `pairs`: counted, since few bytes of arrays make many pairs."""
    context = pairs.sparkSession.sparkContext
    return min(max(context.defaultParallelism, -(-int(pairs.first()[0] or 0) // PAIRS)), 20_000)


def unpacked(rows: DataFrame, src: str, dst: str, n: int) -> DataFrame:
    """Each node of the array in `{src}_nodes` with each of `{dst}_nodes`, as src and dst; rows lie in n partitions.

    Two explodes in one generated loop hold all pairs of a row before the first goes on. coalesce() moves nothing here, it keeps them apart."""
    rest = [c for c in rows.columns if c not in (f"{src}_nodes", f"{dst}_nodes")]
    return rows.select(*rest, f"{dst}_nodes", F.explode(f"{src}_nodes").alias(src)).coalesce(n).select(*rest, src, F.explode(f"{dst}_nodes").alias(dst))


def counted_calls(calls: DataFrame) -> DataFrame:
    """(language, caller, callee, n): each call by name once; calls may come counted, with n of their own."""
    return calls.groupBy("language", "caller", "callee").agg((F.sum("n") if "n" in calls.columns else F.count(F.lit(1))).alias("n"))


def call_counts(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, n): the edges of call_edges(), each once with the number of parallel ones.

    Calls are counted by name first. Nodes of a name travel in arrays of about CHUNK, and only the last step makes pairs of
    nodes, which are not shuffled: a node that stands once has one name, so two such nodes meet in one call alone. Pairs with
    a node that stands more often are added up apart."""
    k = settle(counted_calls(calls))
    rows = symbols.where("node IS NOT NULL AND language IS NOT NULL AND name IS NOT NULL").select("node", "language", "name")
    s = settle(rows.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("node")) > 1))
    once, often = s.where("NOT often"), s.where("often")
    size = once.groupBy("language", "name").agg(F.count(F.lit(1)).alias("nodes")).withColumn("chunks", F.ceil(F.col("nodes") / CHUNK))
    packed = once.join(size.drop("nodes"), ["language", "name"]).groupBy("language", "name", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk")).agg(F.collect_list("node").alias("nodes"))
    out = k
    for end, to in (("caller", "src"), ("callee", "dst")):
        out = out.join(size.withColumnsRenamed({"name": end, "chunks": f"{to}_chunks", "nodes": f"{to}_all"}), ["language", end])
    n = tasks_for(out.agg(F.sum(F.col("src_all") * F.col("dst_all"))))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    out = out.withColumn("src_chunk", every("src_chunks")).withColumn("dst_chunk", every("dst_chunks")).drop("src_chunks", "dst_chunks", "src_all", "dst_all")
    for end, to in (("caller", "src"), ("callee", "dst")):
        if to == "dst":
            out = out.repartition(n, "language", end, f"{to}_chunk")
        out = out.join(packed.withColumnsRenamed({"name": end, "chunk": f"{to}_chunk", "nodes": f"{to}_nodes"}).hint("merge"), ["language", end, f"{to}_chunk"]).drop(end, f"{to}_chunk")
    out = unpacked(out.drop("language"), "src", "dst", n).where("src <> dst").select("src", "dst", "n")
    if often.isEmpty():
        return out
    end = lambda frame, name, to: frame.select(F.col("node").alias(to), "language", F.col("name").alias(name))
    met = [k.join(end(a, "caller", "src"), ["language", "caller"]).join(end(b, "callee", "dst"), ["language", "callee"]) for a, b in ((often, s), (once, often))]
    return out.unionByName(met[0].unionByName(met[1]).where("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("n")))


def caller_counts(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(callee, callers, first_caller): how many rows callers_by_callee() has for a callee, and the least node in them.

    Nodes of one name in their language are counted by name; those of several are listed, since callees may share them."""
    k = settle(calls.select("language", "caller", "callee").distinct())
    rows = symbols.select("node", "language", F.col("name").alias("caller")).distinct()
    s = settle(rows.withColumn("several", F.count(F.lit(1)).over(Window.partitionBy("language", "node")) > 1))
    sums = [F.sum("callers").alias("callers"), F.min("first_caller").alias("first_caller")]
    each = [F.count(F.lit(1)).alias("callers"), F.min("node").alias("first_caller")]
    plain = k.join(s.where("NOT several").groupBy("language", "caller").agg(*each), ["language", "caller"]).groupBy("callee").agg(*sums)
    listed = k.join(s.where("several"), ["language", "caller"]).select("language", "callee", "node").distinct().groupBy("callee").agg(*each)
    return plain.unionByName(listed).groupBy("callee").agg(*sums)


def graph_totals(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """graph_stats() of call_edges(), by counts: pairs of nodes of the names that call, less those of a node with itself."""
    k = settle(counted_calls(calls))
    s = symbols.where("node IS NOT NULL").groupBy("node", "language", "name").agg(F.count(F.lit(1)).alias("m"))
    by_name = s.groupBy("language", "name").agg(F.sum("m").alias("m"))
    side = lambda frame, end: frame.withColumnsRenamed({"name": end, "m": f"m_{end}"})
    product = F.coalesce(F.sum(F.col("n") * F.col("m_caller") * F.col("m_callee")), F.lit(0))
    pairs = k.join(side(by_name, "caller"), ["language", "caller"]).join(side(by_name, "callee"), ["language", "callee"]).agg(product.alias("pairs"))
    selves = side(s, "caller").join(side(s, "callee"), ["node", "language"]).groupBy("language", "caller", "callee").agg(F.sum(F.col("m_caller") * F.col("m_callee")).alias("m_caller"), F.lit(1).alias("m_callee"))
    loops = k.join(selves, ["language", "caller", "callee"]).agg(product.alias("loops"))
    nodes = symbols.agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.crossJoin(pairs).crossJoin(loops).select("nodes", (F.col("pairs") - F.col("loops")).alias("edges"))


def graph_stats(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, and edges with parallel ones."""
    return symbols.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))


def directed(edges: DataFrame, direction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, src, dst) to follow: `callees` forward, `callers` backward, `both` undirected. Parallel edges stay."""
    forward = edges.select(*by, "src", "dst")
    backward = edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return forward if direction == "callees" else backward if direction == "callers" else forward.unionByName(backward)


def read_often(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges fit to be read in every hop: as they are if they come straight from files, else made once without parallel ones."""
    out = edges.select(*by, "src", "dst")
    return out if is_scan(out) else settle(out.distinct())


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "callees", hops: int = 5, keys: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node, distance) of every node within `hops` of the seeds (keys, node [, hops]), seeds left out.

    With keys, each key's seeds are walked apart in the same joins; a seed column `hops` bounds
    a key's own walk. Keys named in `by` are columns of the edges too: such a walk follows its own
    edges only. The loop ends early when no walk finds anything new. Parallel edges cost nothing
    but the read, since each hop keeps a node once."""
    if hops < 1:
        return seeds.select(*keys, "node").where("false").withColumn("distance", F.lit(0))
    step = directed(read_often(edges, by) if hops > 1 else edges, direction, by).withColumnRenamed("dst", "_to").withColumnRenamed("src", "node")
    limit = [c for c in ("hops",) if c in seeds.columns]
    start = seeds.select(*keys, "node", *limit).distinct()
    if limit:
        start = start.groupBy(*keys, "node").agg(F.max("hops").alias("hops"))
    frontier = seen = settle(start.withColumn("distance", F.lit(0)))
    for hop in range(1, hops + 1):
        live = frontier.where(F.col("hops") >= hop) if limit else frontier
        found = live.select(*keys, "node", *limit).join(step, [*by, "node"]).select(*keys, F.col("_to").alias("node"), *limit)
        found = found.groupBy(*keys, "node").agg(F.max("hops").alias("hops")) if limit else found.distinct()
        frontier = settle(found.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("distance", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0").select(*keys, "node", "distance")


def ways(edges: DataFrame) -> DataFrame:
    """(way, src, dst): the edges forward as callees and backward as callers, made once for walks of both kinds."""
    forward = edges.select(F.lit("callees").alias("way"), "src", "dst")
    return settle(forward.unionByName(edges.select(F.lit("callers").alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())


def both_ways(seeds: DataFrame) -> DataFrame:
    return seeds.withColumn("way", F.explode(F.array(F.lit("callers"), F.lit("callees"))))


def impact(edges: DataFrame, symbols: DataFrame, name: str, hops: int = 5) -> DataFrame:
    """Callers of all symbols called `name`, directly or not: node, name, file, distance, via and tier."""
    found = reach(edges, symbols.where(F.col("name") == name).select("node"), "callers", hops)
    return found.join(symbols, "node").withColumn("via", F.lit("called_by")).withColumn("tier", F.lit("treesitter"))


def impact_envelope(reached: DataFrame) -> DataFrame:
    """One row: how many symbols, and their files in order."""
    return reached.agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set("file")).alias("files"))


def blast_radius(reached: DataFrame, edited_file: str, language: str) -> DataFrame:
    """One row: distinct names and files reached outside the edited file, in its language."""
    own = reached.where((F.col("file") != edited_file) & (F.col("language") == language))
    return own.agg(F.count_distinct("name").alias("symbols"), F.count_distinct("file").alias("files"))


def fan_in(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, fan): neighbours at one hop in either direction of each key's seeds (key, node)."""
    return _fan(ways(edges), seeds)


def _fan(both: DataFrame, seeds: DataFrame) -> DataFrame:
    counted = reach(both, both_ways(seeds), "callees", 1, ("key", "way"), ("way",)).groupBy("key").agg(F.count(F.lit(1)).alias("fan"))
    return seeds.select("key").distinct().join(counted, "key", "left").fillna(0, ["fan"])


def bounded_reach(edges: DataFrame, seeds: DataFrame, hops: int, fan_limit: int | None) -> DataFrame:
    """(key, way, node, distance) from each key's seeds in both directions, one hop only for keys whose fan is over the limit."""
    both, walk = ways(edges), seeds
    if fan_limit is not None:
        walk = seeds.join(_fan(both, seeds), "key").select("key", "node", F.when(F.col("fan") > fan_limit, 1).otherwise(hops).alias("hops"))
    return reach(both, both_ways(walk), "callees", hops, ("key", "way"), ("way",))


def frontier(edges: DataFrame, seeds: DataFrame, hops: int = 5, fan_limit: int | None = None) -> DataFrame:
    """(node, distance): what the changed keys' seeds (key, node) touch in either direction.

    Keys whose fan is over fan_limit go one hop only. Nodes that are a seed of any key are left
    out; a node that several keys or directions reach has its least distance."""
    whole = bounded_reach(edges, seeds, hops, fan_limit).groupBy("node").agg(F.min("distance").alias("distance"))
    return whole.join(seeds.select("node").distinct(), "node", "left_anti")


def fold_weights(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """Undirected (a, b, weight) with a < b: parallel edges of both directions add up."""
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(w.alias("weight"))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows plus their place from 0 in this order, without a task that sees them all: sorted by ranges, then offset by the counts before."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, 8)
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_id", 33)
    placed = settle(ranged)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_before")


def _swept(total: float, passes: int, gain: float):
    """A function of a part's rows (src, dst, weight, comm, heavy, degree; src = dst for the node itself) that gives its nodes' communities."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["src"] == rows["dst"]].sort_values("src")
        ids, degree = own["src"].to_numpy(), own["degree"].to_numpy()
        here = {n: i for i, n in enumerate(ids.tolist())}
        comm = own["comm"].tolist()
        heavy = dict(zip(rows["comm"].tolist(), rows["heavy"].tolist()))
        near = rows[rows["src"] != rows["dst"]].sort_values(["src", "dst"])
        cuts = np.searchsorted(near["src"].to_numpy(), ids, side="left").tolist() + [len(near)]
        dst, weight, outside = near["dst"].tolist(), near["weight"].tolist(), near["comm"].tolist()
        local = [here.get(n, -1) for n in dst]
        for _ in range(passes):
            moved = False
            for i, d in enumerate(degree.tolist()):
                into: dict = {}
                for j in range(cuts[i], cuts[i + 1]):
                    c = outside[j] if local[j] < 0 else comm[local[j]]
                    into[c] = into.get(c, 0.0) + weight[j]
                mine = comm[i]
                heavy[mine] -= d
                best, top = mine, into.get(mine, 0.0) - heavy[mine] * d / total
                for c in sorted(into):
                    score = into[c] - heavy[c] * d / total
                    if score > top + gain:
                        best, top = c, score
                heavy[best] += d
                comm[i], moved = best, moved or best != mine
            if not moved:
                break
        return pd.DataFrame({"node": ids, "to": comm})

    return run


def local_moving(nodes: DataFrame, edges: DataFrame, total: float, part_edges: int, rounds: int, passes: int, gain: float) -> DataFrame:
    """(node, comm, degree): nodes (node, degree), each at first its own community, moved to the neighbouring community of most gain.

    A round deals half of the nodes to parts of about `part_edges` edges, by a hash that is another one in each round; a part moves its
    nodes in order, sees its own moves at once and those of others in the next round. Ties go to the smallest label. It ends with two rounds that move
    nothing, or after `rounds`."""
    state = settle(nodes.select("node", F.col("node").alias("comm"), "degree"))
    links, quiet = edges.where("src <> dst"), 0
    parts = -(-edges.count() // (2 * part_edges)) or 1
    for r in range(rounds):
        turn = F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2
        heavy = state.groupBy("comm").agg(F.sum("degree").alias("heavy"))
        known = state.join(heavy, "comm")
        asked = known.where(turn)
        near = links.join(asked.select(F.col("node").alias("src")), "src", "left_semi").join(known.select(F.col("node").alias("dst"), "comm", "heavy"), "dst")
        rows = near.select("src", "dst", "weight", "comm", "heavy", F.lit(0.0).alias("degree")).unionByName(asked.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("weight"), "comm", "heavy", "degree"))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("src", F.lit(r), F.lit(1)), F.lit(parts)))
        moves = dealt.groupBy("part").applyInPandas(_swept(total, passes, gain), "node long, to long")
        later = state.join(moves, "node", "left").select("node", F.coalesce("to", "comm").alias("comm"), "degree", F.coalesce(F.col("to") != F.col("comm"), F.lit(False)).alias("moved"))
        found, spent = settle(later), state
        quiet = quiet + 1 if found.where("moved").isEmpty() else 0
        state = found.drop("moved")
        discard(spent)
        if quiet == 2:
            break
    return state


def communities(symbols: DataFrame, edges: DataFrame, part_edges: int = 100_000, rounds: int = 24, passes: int = 2, levels: int = 16, gain: float = 1e-12, place: tuple[str, ...] = ()) -> DataFrame:
    """(community, node): Louvain over the folded graph, largest community first, then by its first member's `place` (columns
    of symbols such as file and line; none: the node).

    Folding, degrees and contraction are joins and aggregates; nodes move in parts of bounded size (local_moving), so no
    task sees the graph, though it must hold a node's edges. Levels are contracted until one merges none. Nodes that share a name are one. The same rows give
    the same result, however they are dealt out."""
    folded = fold_weights(edges).select("a", "b", F.col("weight").cast("double").alias("weight"))
    ends = symbols.select("node").unionByName(folded.select(F.col("a").alias("node"))).unionByName(folded.select(F.col("b").alias("node"))).distinct()
    names = settle(numbered(ends, ["node"], "id"))
    ids = lambda column, to: names.select(F.col("node").alias(column), F.col("id").alias(to))
    told = folded.join(ids("a", "src"), "a").join(ids("b", "dst"), "b").select("src", "dst", "weight")
    level = settle(told.unionByName(told.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    total = level.agg(F.sum("weight")).first()[0] or 0.0  # the driver sees one number
    members = names.select("node", "id", F.col("id").alias("comm"))
    count = members.count()
    for _ in range(levels if total else 0):
        degree = level.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))
        moved = local_moving(degree, level, total, part_edges, rounds, passes, gain)
        up = moved.select(F.col("node").alias("comm"), F.col("comm").alias("up"))
        members = settle(members.join(up, "comm", "left").select("node", "id", F.coalesce("up", "comm").alias("comm")))
        to = moved.select("node", "comm")
        small = level.join(to.select(F.col("node").alias("src"), F.col("comm").alias("a")), "src").join(to.select(F.col("node").alias("dst"), F.col("comm").alias("b")), "dst")
        level, spent = settle(small.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"))), level
        discard(spent)
        now = members.select("comm").distinct().count()
        if now == count:
            break
        count = now
    first = symbols.groupBy("node").agg(F.min(F.struct(*place, "node")).alias("first"))
    groups = members.join(first, "node", "left").groupBy("comm").agg(F.count(F.lit(1)).alias("size"), F.min("first").alias("first"), F.min("id").alias("least"))
    ranked = numbered(groups, [F.desc("size"), F.asc_nulls_last("first"), F.asc("least")], "community")
    return members.join(ranked.select("comm", F.col("community").cast("int").alias("community")), "comm").select("community", "node")


def modularity(members: DataFrame, folded: DataFrame) -> DataFrame:
    """One row: the Newman-Girvan score of (community, node) over (a, b, weight)."""
    of = members.select("node", "community")
    ends = folded.select(F.col("a").alias("node"), "weight").unionByName(folded.select(F.col("b").alias("node"), "weight"))
    degree = ends.join(of, "node").groupBy("community").agg(F.sum("weight").alias("d"))
    inside = folded.join(of.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(of.withColumnsRenamed({"node": "b", "community": "cb"}), "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("w"))
    m = folded.agg(F.sum("weight").alias("m"))
    return degree.join(inside, "community", "left").fillna(0, ["w"]).crossJoin(F.broadcast(m)).agg(F.sum(F.col("w") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


def name_collisions(symbols: DataFrame, by: list[str], kind: str, place: str) -> DataFrame:
    """Groups with more than one distinct (kind, place): how many, and whether within or across kinds."""
    one = F.struct(F.col(kind), F.col(place))
    return (
        symbols.groupBy(*by)
        .agg(F.count_distinct(one).alias("definitions"), F.count_distinct(kind).alias("kinds"))
        .where("definitions > 1")
        .select(*by, "definitions", "kinds", (F.col("kinds") < F.col("definitions")).alias("same_kind"), (F.col("kinds") > 1).alias("cross_kind"))
    )


def symbol_at(symbols: DataFrame, points: DataFrame) -> DataFrame:
    """The innermost symbol around each point (file, line): latest start, then shortest, then first node. Points without one are left out."""
    own = [c for c in symbols.columns if c != "file"]
    best = F.struct((-F.col("start_line")).alias("s"), (F.col("end_line") - F.col("start_line")).alias("n"), F.col("node").alias("_node"), F.struct(*own).alias("row"))
    found = intervals.best_around(points, symbols, ["file"], "line", "start_line", "end_line", best, "_best")
    return found.select(*points.columns, *(F.col(f"_best.row.{c}").alias(c) for c in own))


def touched_symbols(symbols: DataFrame, spans: DataFrame) -> DataFrame:
    """Symbols that overlap an edited span (file, start, end)."""
    return intervals.overlapping(symbols, spans, ["file"], "start_line", "end_line", "start", "end")


def definitions(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name)


def file_symbols(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.where(F.col("file") == file).orderBy("start_line", "node")


def caller_files(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Distinct files of the direct callers of a name, in order."""
    return reach(edges, definitions(symbols, name).select("node"), "callers", 1).join(symbols, "node").select("file").distinct().orderBy("file")


def external_callers(edges: DataFrame, symbols: DataFrame, file: str) -> DataFrame:
    """(node, name, callers): distinct callers from other files of each symbol of a file, symbols without any left out."""
    own = symbols.where(F.col("file") == file).select(F.col("node").alias("dst"), "name")
    other = symbols.where(F.col("file") != file).select(F.col("node").alias("src"))
    calls = edges.select("src", "dst").distinct().join(own, "dst").join(other, "src")
    return calls.groupBy(F.col("dst").alias("node"), "name").agg(F.count(F.lit(1)).alias("callers"))


def page_rank(edges: DataFrame, seeds: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, score): personalised PageRank from the seeds, a fixed number of rounds."""
    step = directed(edges, "callees").distinct()
    out = step.groupBy("src").agg(F.count(F.lit(1)).alias("fan"))
    step = settle(step.join(out, "src"))
    base = settle(seeds.select("node").distinct().crossJoin(F.broadcast(seeds.select("node").distinct().agg((1 / F.count(F.lit(1))).alias("score")))))
    score = base
    for _ in range(rounds):
        moved = score.join(step, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg((F.sum(F.col("score") / F.col("fan")) * damping).alias("score"))
        score = settle(moved.unionByName(base.select("node", (F.col("score") * (1 - damping)).alias("score"))).groupBy("node").agg(F.sum("score").alias("score")))
    return score


def reconcile(structural: DataFrame, cochange: DataFrame, key: str = "file") -> DataFrame:
    """(key, bucket): corroborated by both, or found by one side alone."""
    a = structural.select(key).distinct().withColumn("_s", F.lit(True))
    b = cochange.select(key).distinct().withColumn("_c", F.lit(True))
    bucket = F.when(F.col("_s") & F.col("_c"), "corroborated").when(F.col("_s"), "structural_only").otherwise("cochange_only")
    return a.join(b, key, "full").select(key, bucket.alias("bucket"))


def change_set(before: DataFrame, after: DataFrame, key: list[str], unread: DataFrame | None = None) -> DataFrame:
    """(key, change): added, removed, or modified (named on both sides), of files that both sides could read."""
    a, b = before.select(*key).distinct().withColumn("_a", F.lit(True)), after.select(*key).distinct().withColumn("_b", F.lit(True))
    out = a.join(b, key, "full").select(*key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("modified").alias("change"))
    return out.join(unread.select(key[0]).distinct(), key[0], "left_anti") if unread is not None else out
