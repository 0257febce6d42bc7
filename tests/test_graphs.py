import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from skein.operators import audit, graph


def walk(edges, seeds, hops):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    dist, queue = {s: 0 for s in seeds}, deque(seeds)
    while queue:
        n = queue.popleft()
        if dist[n] < hops:
            for m in near.get(n, ()):
                if m not in dist:
                    dist[m] = dist[n] + 1
                    queue.append(m)
    return {n: d for n, d in dist.items() if d}


@pytest.mark.parametrize("seed", range(3))
def test_reach_against_plain_search(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(70)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    for direction, plain in (("callees", edges), ("callers", [(b, a) for a, b in edges]), ("both", edges + [(b, a) for a, b in edges])):
        out = graph.reach(frame, spark.createDataFrame([(1,), (2,)], "node long"), direction, 3)
        assert {x["node"]: x["distance"] for x in out.collect()} == walk(plain, [1, 2], 3)


def test_reach_by_key_with_own_hops(spark):
    edges = [(i, i + 1) for i in range(10)]
    seeds = spark.createDataFrame([("a", 0, 2), ("b", 0, 4), ("b", 7, 1)], "key string, node long, hops int")
    out = {(x["key"], x["node"]): x["distance"] for x in graph.reach(spark.createDataFrame(edges, "src long, dst long"), seeds, "callees", 5, ("key",)).collect()}
    assert out == {("a", 1): 1, ("a", 2): 2, ("b", 1): 1, ("b", 2): 2, ("b", 3): 3, ("b", 4): 4, ("b", 8): 1}
    assert graph.reach(spark.createDataFrame(edges, "src long, dst long"), seeds, hops=0).count() == 0


CHAIN = [(1, "leaf", "leaf.rs"), (2, "mid", "mid.rs"), (3, "top", "top.rs")] + [(10 + i, f"pad{i}", f"pad{i}.rs") for i in range(5)]


def chain(spark):
    symbols = spark.createDataFrame([(n, name, f, "rust", 1, 3) for n, name, f in CHAIN], "node long, name string, file string, language string, start_line int, end_line int")
    calls = spark.createDataFrame([("rust", "mid", "leaf"), ("rust", "top", "mid"), ("rust", "top", "mid"), ("rust", "top", "nowhere"), ("go", "mid", "leaf")], "language string, caller string, callee string")
    return symbols, calls


def test_call_chain(spark):
    symbols, calls = chain(spark)
    edges = graph.call_edges(calls, symbols)
    assert sorted(map(tuple, edges.collect())) == [(2, 1), (3, 2), (3, 2)]
    assert graph.call_edges(calls, symbols, as_set=True).count() == 2
    assert sorted((x["callee"], x["caller_node"]) for x in graph.callers_by_callee(calls, symbols).collect()) == [("leaf", 2), ("mid", 3), ("nowhere", 3)]
    out = graph.impact(edges, symbols, "leaf")
    assert {(x["name"], x["distance"], x["via"]) for x in out.collect()} == {("mid", 1, "called_by"), ("top", 2, "called_by")}
    assert graph.impact_envelope(out).first()["files"] == ["mid.rs", "top.rs"]
    assert tuple(graph.blast_radius(out.withColumnRenamed("x", "x"), "mid.rs", "rust").first()) == (1, 1)
    assert [x["file"] for x in graph.caller_files(edges, symbols, "leaf").collect()] == ["mid.rs"]
    assert tuple(graph.graph_stats(symbols, edges).first()) == (8, 3)
    empty = graph.impact(edges, symbols, "absent")
    assert empty.count() == 0 and "tier" in empty.columns


def test_frontier_bounded_by_fan(spark):
    edges = spark.createDataFrame([(i, 100) for i in range(5)] + [(100, 200), (200, 300), (50, 0)], "src long, dst long")
    seeds = spark.createDataFrame([("hub", 100)], "key string, node long")
    wide = {x["node"] for x in graph.frontier(edges, seeds, 3).collect()}
    assert wide == {0, 1, 2, 3, 4, 50, 200, 300}
    assert {x["node"] for x in graph.frontier(edges, seeds, 3, fan_limit=5).collect()} == {0, 1, 2, 3, 4, 200}
    assert {x["node"] for x in graph.frontier(edges, seeds, 3, fan_limit=6).collect()} == wide


def test_communities(spark):
    edges = [(1, 0), (2, 1), (2, 0), (4, 3), (5, 4), (5, 3), (5, 0)]
    symbols = spark.range(7).withColumnRenamed("id", "node")
    out = graph.communities(symbols, spark.createDataFrame(edges, "src long, dst long"))
    groups = {}
    for x in out.collect():
        groups.setdefault(x["community"], []).append(x["node"])
    assert {k: sorted(v) for k, v in groups.items()} == {0: [0, 1, 2], 1: [3, 4, 5], 2: [6]}
    folded = graph.fold_weights(spark.createDataFrame(edges, "src long, dst long"))
    assert graph.modularity(out, folded).first()[0] > 0.3


def sweep(nodes, edges):
    """Local moving one node after the other, level by level: the plain form of communities()."""
    near = {n: Counter() for n in nodes}
    for a, b, w in edges:
        near[a][b] += w
        near[b][a] += w
    member, total = {n: n for n in nodes}, sum(sum(x.values()) for x in near.values())
    while total:
        degree = {n: sum(x.values()) for n, x in near.items()}
        comm, heavy, moved = {n: n for n in near}, Counter(degree), True
        while moved:
            moved = False
            for n in sorted(near):
                into = Counter()
                for m, w in near[n].items():
                    if m != n:
                        into[comm[m]] += w
                heavy[comm[n]] -= degree[n]
                score = lambda c: into[c] - heavy[c] * degree[n] / total  # noqa: B023, E731
                best = min([comm[n], *into], key=lambda c: (-score(c), c))
                if score(best) > score(comm[n]) + 1e-12:
                    comm[n], moved = best, True
                heavy[comm[n]] += degree[n]
        if len(set(comm.values())) == len(near):
            break
        member, old = {n: comm[c] for n, c in member.items()}, near
        near = {c: Counter() for c in comm.values()}
        for n, x in old.items():
            for m, w in x.items():
                near[comm[n]][comm[m]] += w
    return member


def score_of(edges, member):
    degree, inside, m = Counter(), Counter(), sum(w for *_, w in edges)
    for a, b, w in edges:
        degree[member[a]] += w
        degree[member[b]] += w
        inside[member[a]] += w * (member[a] == member[b])
    return sum(inside[c] / m - (d / 2 / m) ** 2 for c, d in degree.items())


def test_communities_score_like_a_sequential_sweep(spark):
    r = random.Random(4)
    nodes = list(range(240))
    pairs = [(a, b) for _ in range(1500) for a in [r.randrange(240)] for b in [(a // 20 * 20 + r.randrange(20)) if r.random() < 0.6 else r.randrange(240)] if a != b]
    edges = [(a, b, float(n)) for (a, b), n in Counter(tuple(sorted(p)) for p in pairs).items()]
    symbols = spark.createDataFrame([(n, f"f{n % 7}", n) for n in [*nodes, 999]], "node long, file string, start_line int")
    calls = spark.createDataFrame(pairs, "src long, dst long").repartition(5)
    out = graph.communities(symbols, calls, place=("file", "start_line"))
    found = {x["node"]: x["community"] for x in out.collect()}
    assert set(found) == {*nodes, 999}
    assert score_of(edges, found) >= 0.98 * score_of(edges, sweep(nodes, edges)) > 0.2
    groups = {}
    for n, c in found.items():
        groups.setdefault(c, []).append(n)
    rank = [(-len(g), min((f"f{n % 7}", n) for n in g)) for _, g in sorted(groups.items())]
    assert rank == sorted(rank) and sorted(groups) == list(range(len(groups)))
    again = graph.communities(symbols.repartition(3), calls.repartition(2), place=("file", "start_line"))
    assert {x["node"]: x["community"] for x in again.collect()} == found
    none = graph.communities(symbols.where("node < 3"), calls.where("false"))
    assert sorted(tuple(x) for x in none.collect()) == [(0, 0), (1, 1), (2, 2)]
    assert graph.communities(symbols.where("false"), calls.where("false")).count() == 0


def test_interval_joins(spark):
    r = random.Random(8)
    rows = [(r.choice("ab"), a, a + r.choice([-1, 0, 1, 3, 17, 200]), i) for i in range(150) for a in [r.randrange(-50, 400)]]
    symbols = spark.createDataFrame(rows, "file string, start_line int, end_line int, node int")
    points = spark.createDataFrame([(f, x) for f in "abc" for x in range(-60, 620, 7)], "file string, line int")
    want = {}
    for f, x in ((f, x) for f in "abc" for x in range(-60, 620, 7)):
        held = [(-s, e - s, n) for g, s, e, n in rows if g == f and s <= x <= e]
        if held:
            want[f, x] = min(held)[2]
    got = graph.symbol_at(symbols, points)
    assert {(x["file"], x["line"]): x["node"] for x in got.collect()} == want and got.columns == ["file", "line", "start_line", "end_line", "node"]
    spans = [("a", 3, 3), ("a", 100, 140), ("b", 390, 380), ("b", -100, -45)]
    met = {n for f, s, e, n in rows if s <= e and any(f == g and s <= hi and e >= lo and lo <= hi for g, lo, hi in spans)}
    assert {x["node"] for x in graph.touched_symbols(symbols, spark.createDataFrame(spans, "file string, start int, end int")).collect()} == met
    reads = [("s", i, r.choice(["read"] * 8 + ["edit", "compact"]), r.choice("pq"), lo, lo + r.choice([0.0, 0.5, 4.0, 30.0])) for i in range(200) for lo in [r.randrange(0, 60) / 2]]
    epoch, whole, past, want = Counter(), 0, {}, {}
    for s, i, kind, path, lo, hi in reads:
        whole += kind == "compact"
        epoch[path] += kind == "edit"
        if kind == "read" and lo < hi:
            before = past.setdefault((path, whole, epoch[path]), [])
            if hit := [j for j, a, b in before if lo < b and a < hi]:
                want[i] = min(hit)
            before.append((i, lo, hi))
    events = spark.createDataFrame(reads, "session string, idx int, kind string, path string, lo double, hi double")
    assert {x["idx"]: x["prior"] for x in audit.rereads(events).collect()} == want


def test_one_file_of_many_symbols_makes_no_pairs(spark):
    n = 100_000
    symbols = spark.range(n).selectExpr("'f' AS file", "id AS node", "id AS start_line", "id + 500 AS end_line")
    points = spark.range(0, n, 5).selectExpr("'f' AS file", "id AS line")
    got = graph.symbol_at(symbols, points)
    assert got.count() == n // 5 and got.where("node <> line").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "BETWEEN" not in plan.upper() and "start_line" not in "".join(x for x in plan.split("\n") if "Join" in x)


def test_symbol_at_innermost(spark):
    symbols = spark.createDataFrame([(1, "m", "a", 1, 90), (2, "f", "a", 5, 20), (3, "g", "a", 5, 10), (4, "h", "b", 1, 9)], "node long, name string, file string, start_line int, end_line int")
    points = spark.createDataFrame([("a", 6), ("a", 15), ("a", 50), ("a", 95), ("b", 9)], "file string, line int")
    assert {(x["file"], x["line"]): x["node"] for x in graph.symbol_at(symbols, points).collect()} == {("a", 6): 3, ("a", 15): 2, ("a", 50): 1, ("b", 9): 4}
    spans = spark.createDataFrame([("a", 21, 30)], "file string, start int, end int")
    assert [x["node"] for x in graph.touched_symbols(symbols, spans).collect()] == [1]


def test_reconcile_and_changes(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "file string"), spark.createDataFrame([("y",), ("z",)], "file string")
    assert {(x[0], x[1]) for x in graph.reconcile(a, b).collect()} == {("x", "structural_only"), ("y", "corroborated"), ("z", "cochange_only")}
    before = spark.createDataFrame([("f", "a"), ("f", "b"), ("u", "c")], "file string, name string")
    after = spark.createDataFrame([("f", "b"), ("f", "d"), ("u", "e")], "file string, name string")
    unread = spark.createDataFrame([("u",)], "file string")
    assert {tuple(x) for x in graph.change_set(before, after, ["file", "name"], unread).collect()} == {("f", "a", "removed"), ("f", "b", "modified"), ("f", "d", "added")}


def test_page_rank(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src long, dst long")
    out = {x["node"]: x["score"] for x in graph.page_rank(edges, spark.createDataFrame([(1,)], "node long"), rounds=25).collect()}
    assert out[1] > out[2] > out[3] and 4 not in out


def _named_calls(spark, r):
    """Names that many nodes share, one of them in more than a chunk; nodes of several names, repeated rows and nulls."""
    names = [f"f{i}" for i in range(6)]
    symbols = [(n, r.choice("xy"), r.choice(names)) for n in range(60)] + [(n, "x", "hot") for n in range(100, 125)]
    symbols += [(n, r.choice("xy"), r.choice(names)) for n in range(8)] + [(3, "x", "hot"), (3, "x", "hot"), (None, "x", "f1"), (70, None, "f1"), (71, "x", None)]
    calls = [(r.choice("xy"), r.choice([*names, "hot"]), r.choice([*names, "hot", "nowhere"])) for _ in range(60)] + [("x", "hot", "hot")] * 3 + [("x", None, "f1"), (None, "f1", "f1")]
    return spark.createDataFrame(symbols, "node long, language string, name string").repartition(5), spark.createDataFrame(calls, "language string, caller string, callee string").repartition(3)


def test_calls_by_counts_are_the_calls_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(graph, "CHUNK", 7)
    for seed in (1, 2):
        symbols, calls = _named_calls(spark, random.Random(seed))
        edges = graph.call_edges(calls, symbols)
        want = sorted(map(tuple, edges.groupBy("src", "dst").count().collect()))
        assert want and sorted(map(tuple, graph.call_counts(calls, symbols).collect())) == want
        plain = symbols.where("node > 8").dropDuplicates(["node"])
        want = sorted(map(tuple, graph.call_edges(calls, plain).groupBy("src", "dst").count().collect()))
        got = graph.call_counts(calls, plain)
        assert want and sorted(map(tuple, got.collect())) == want
        assert "Aggregate [src" not in got._jdf.queryExecution().optimizedPlan().toString()
        rows = {}
        for x in graph.callers_by_callee(calls, symbols).collect():
            rows.setdefault(x["callee"], []).append(x["caller_node"])
        assert {x["callee"]: (x["callers"], x["first_caller"]) for x in graph.caller_counts(calls, symbols).collect()} == {c: (len(v), min((n for n in v if n is not None), default=None)) for c, v in rows.items()}
        assert tuple(graph.graph_totals(calls, symbols).first()) == tuple(graph.graph_stats(symbols, edges).first())
    assert tuple(graph.graph_totals(calls.where("false"), symbols).first()) == (symbols.count(), 0)


def test_pairs_of_calls_are_made_in_tasks_by_their_number(spark, monkeypatch):
    """Few bytes make many pairs: tasks are set by pairs, and no generated loop holds all pairs of two chunks."""
    monkeypatch.setattr(graph, "PAIRS", 10)
    symbols, calls = _named_calls(spark, random.Random(3))
    plain = symbols.where("node > 8").dropDuplicates(["node"])
    got = graph.call_counts(calls, plain)
    assert graph.tasks_for(spark.range(101).agg(F.sum("id"))) == 505
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(dst_nodes") < plan.index("Coalesce") < plan.index("explode(src_nodes")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.call_edges(calls, plain).groupBy("src", "dst").count().collect()))


def test_call_queries_make_no_pairs_of_nodes_but_those_they_return(spark, tmp_path):
    """A name that 3,000 parts share: its calls, one by one, would be 9 million rows each."""
    from skein.plans import catalog

    d, n = str(tmp_path), 3000
    spark.range(n).selectExpr("id AS p_partkey", "'part' AS p_name", "'Brand#11' AS p_brand", "'T' AS p_type", "2 AS p_size").write.parquet(f"{d}/part.parquet")
    spark.range(2 * n).selectExpr("id div 2 AS l_orderkey", "id % 3000 AS l_partkey", "id % 7 AS l_suppkey", "CAST(id % 2 AS int) AS l_linenumber", "1D AS l_quantity", "1D AS l_extendedprice", "'x' AS l_shipdate").write.parquet(f"{d}/lineitem.parquet")
    pairs = n // 2  # distinct edges between parts
    assert tuple(catalog.queries()["graph_stats"](spark, d).first()) == (n, pairs * n * (n - 1))
    assert [tuple(x) for x in catalog.queries()["callers_by_callee"](spark, d).collect()] == [("part Brand#11", n, 0)]
    out = catalog.queries()["call_edges"](spark, d)
    assert tuple(out.agg(F.count("n"), F.min("n"), F.max("n")).first()) == (n * (n - 1), pairs, pairs)
    assert out.where("src < 9").dropDuplicates(["src", "dst"]).count() == 9 * (n - 1)
