import pytest

from skein.operators import guard, overlay, pattern

NODES = f"id string, kind string, attrs map<string,{pattern.VALUE}>"
EDGES = "source string, relation string, target string"
ORDERS = f"order_id string, seq int, pos int, op string, id string, key string, value {pattern.VALUE}, kind string, source string, relation string, target string"


def val(x):
    return ("bool", x, None, None) if isinstance(x, bool) else ("num", None, float(x), None) if isinstance(x, (int, float)) else ("str", None, None, x)


def board(spark):
    """Depots that keep pallets, some of them cold, trucks that stand at one, and who supplies whom."""
    depot = lambda cold, pallets: {"cold": val(cold), "pallets": val(pallets)}
    nodes = [("north", "Depot", depot(True, 40)), ("south", "Depot", depot(False, 7)), ("quay", "Depot", depot(True, 0)), ("t7", "Truck", {"load": val(7)}), ("t9", "Truck", {})]
    edges = [("t7", "parked_at", "north"), ("t9", "parked_at", "north"), ("north", "supplies", "quay")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def ask(spark, text, *variables):
    rows = pattern.evaluate(pattern.parse(text), *board(spark)).collect()
    pick = lambda x: x["node"] or (x["value"]["s"] if x["value"]["t"] == "str" else x["value"]["n"] if x["value"]["t"] == "num" else x["value"]["b"])
    return sorted(tuple(pick(r[f"v_{v}"]) for v in variables) for r in rows)


def test_patterns(spark):
    assert ask(spark, "?d a Depot", "d") == [("north",), ("quay",), ("south",)]
    assert ask(spark, "?d cold true ; pallets ?n", "d", "n") == [("north", 40.0), ("quay", 0.0)]
    assert ask(spark, "?d pallets ?n | ?n > 5", "d", "n") == [("north", 40.0), ("south", 7.0)]
    assert ask(spark, "?t parked_at north", "t") == [("t7",), ("t9",)] and ask(spark, "?t parked_at quay", "t") == []
    assert ask(spark, '?d pallets "40"', "d") == []  # a number is no string
    assert ask(spark, "?d a Depot | ?d != south", "d") == [("north",), ("quay",)]
    assert ask(spark, "?d a ?k | ?k < 3", "d") == []


def test_patterns_of_several_clauses(spark):
    assert ask(spark, "?t parked_at ?d . ?d cold true", "t", "d") == [("t7", "north"), ("t9", "north")]
    # a new subject is found through what is bound: an edge's target, or an attribute's value
    assert ask(spark, "?d supplies ?q . ?t parked_at ?d", "q", "t") == [("quay", "t7"), ("quay", "t9")]
    assert ask(spark, "?t load ?n . ?d pallets ?n", "t", "d") == [("t7", "south")]
    assert len(ask(spark, "?t a Truck . ?d a Depot", "t", "d")) == 6


def test_first_target_when_free_any_when_bound(spark):
    nodes = spark.createDataFrame([(x, "N", {}) for x in "abc"], NODES)
    edges = spark.createDataFrame([("a", "r", "c"), ("a", "r", "b")], EDGES)
    run = lambda t, *v: sorted(tuple(x[f"v_{k}"]["node"] for k in v) for x in pattern.evaluate(pattern.parse(t), nodes, edges).collect())
    assert run("?x r ?y", "x", "y") == [("a", "b")]
    assert run("?y a N . ?x r ?y", "x", "y") == [("a", "b"), ("a", "c")]
    shadow = spark.createDataFrame([("a", "N", {"r": val("own")}), ("b", "N", {}), ("c", "N", {})], NODES)
    assert pattern.evaluate(pattern.parse("?x r c"), shadow, edges).count() == 0


@pytest.mark.parametrize("bad", ["", "?x", "?x a", "x a N", "?x a N |", "?x a N | ?y >", "?x a N . ", "?x a N ^", "?x a N ?y"])
def test_pattern_errors(bad):
    with pytest.raises(pattern.PatternError):
        pattern.parse(bad)


def test_pattern_facts(spark):
    p = pattern.parse('?b a N ; k "x\\"y" | ?z = 1, ?b < 2')
    assert p.variables() == ["b"] and p.unbound_filters() == ["z"] and p.clauses[0].pairs[1][1].value == 'x"y'
    rows = pattern.evaluate(pattern.parse("?d cold ?v"), *board(spark))
    assert pattern.filter_warnings(pattern.parse("?d cold ?v | ?v > 1"), rows).first()["rows"] == 3


def order(spark, *rows):
    full = []
    for n, r in enumerate(rows):
        r = {"order_id": f"o{n}", "seq": n, "pos": 0} | r
        full.append(tuple(r.get(k) for k in ("order_id", "seq", "pos", "op", "id", "key", "value", "kind", "source", "relation", "target")))
    return spark.createDataFrame(full, ORDERS)


POLICY = guard.Policy("stocked", "?d a Depot ; cold true", "?d pallets ?n | ?n >= 10")


def said(out):
    return sorted((x["policy"], x["outcome"], x["binding"], x["pre_existing"], x["blame"]) for x in out.collect())


def test_guard_blames_the_order(spark):
    nodes, edges = board(spark)
    o = order(spark, {"op": "upsert_node", "id": "x", "kind": "K"}, {"op": "set_attr", "id": "north", "key": "pallets", "value": val(3)})
    assert said(guard.guard([POLICY], nodes, edges, o)) == [("stocked", "evaluated", "d=north", False, ["o1"]), ("stocked", "evaluated", "d=quay", True, [])]
    assert said(guard.guard([POLICY], nodes, edges)) == [("stocked", "evaluated", "d=quay", False, [])]


def test_guard_outcomes(spark):
    nodes, edges = board(spark)
    empty = nodes.where("false")
    assert [x["outcome"] for x in guard.guard([POLICY], empty, edges).collect()] == ["refused"]
    assert [x["outcome"] for x in guard.guard([], nodes, edges).collect()] == ["refused"]
    assert [x["outcome"] for x in guard.guard([guard.Policy("p", "?b a", "?b a N")], nodes, edges).collect()] == ["unevaluated"]
    assert [x["outcome"] for x in guard.guard([guard.Policy("p", "?b a N", "?b a N", boundary="turn")], nodes, edges).collect()] == ["unevaluated"]
    assert [x["outcome"] for x in guard.guard([guard.Policy("p", "?b a Nothing", "?b a N")], nodes, edges).collect()] == ["vacuous"]
    must_not = guard.Policy("p", "?d a Depot", "?d pallets 7", "must-not-match")
    assert said(guard.guard([must_not], nodes, edges)) == [("p", "evaluated", "d=south", False, [])]
    exist = guard.Policy("p", "?d a Depot", "?d pallets 99", "must-exist")
    assert said(guard.guard([exist], nodes, edges)) == [("p", "evaluated", "d=-", False, [])]


def test_guard_blames_each_order_for_its_own_breach(spark):
    """Bindings enough for many tasks: the number that ties blame to a binding must not be made twice."""
    n = 3000
    attrs = "map('cold', named_struct('t', 'bool', 'b', true, 'n', CAST(NULL AS double), 's', CAST(NULL AS string)), 'pallets', {})"
    num = lambda x: f"named_struct('t', 'num', 'b', CAST(NULL AS boolean), 'n', {x}D, 's', CAST(NULL AS string))"
    nodes = spark.range(n).repartition(7).selectExpr("concat('d', id) AS id", "'Depot' AS kind", f"{attrs.format(num(50))} AS attrs")
    none = "CAST(NULL AS string)"
    orders = spark.range(0, n, 2).selectExpr("concat('o', id) AS order_id", "CAST(id AS int) AS seq", "0 AS pos", "'set_attr' AS op", "concat('d', id) AS id", "'pallets' AS key", f"{num(3)} AS value", *(f"{none} AS {c}" for c in ("kind", "source", "relation", "target")))
    edges = spark.createDataFrame([], EDGES)
    for threshold in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            out = guard.guard([POLICY, guard.Policy("few", "?d a Depot", "?d pallets 3", "must-not-match")], nodes, edges, orders)
            assert "monotonically_increasing_id" not in out._jdf.queryExecution().optimizedPlan().toString()
            assert said(out) == sorted((p, "evaluated", f"d=d{i}", False, [f"o{i}"]) for p in ("stocked", "few") for i in range(0, n, 2))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_orders_apply_in_sequence(spark):
    nodes, edges = board(spark)
    o = order(
        spark,
        {"op": "remove_node", "id": "north"},
        {"op": "add_edge", "source": "t7", "relation": "parked_at", "target": "north"},
        {"op": "upsert_node", "id": "t12", "kind": "Truck"},
        {"op": "set_attr", "id": "t12", "key": "driver", "value": val("Kim")},
        {"op": "add_edge", "source": "t12", "relation": "parked_at", "target": "south"},
        {"op": "remove_edge", "source": "t12", "relation": "parked_at", "target": "south"},
        {"op": "remove_edge", "source": "t12", "relation": "parked_at", "target": "south"},
        {"op": "set_attr", "id": "north", "key": "pallets", "value": val(1)},
        {"op": "paint", "id": "t12"},
    )
    after = guard.apply_orders(nodes, edges, o)
    found = {x["id"]: x["attrs"] for x in after["nodes"].collect()}
    assert set(found) == {"south", "quay", "t7", "t9", "t12"} and found["t12"]["driver"]["s"] == "Kim"
    assert after["edges"].count() == 0  # all of them ended at the depot that went
    assert sorted((x["order_id"], x["reason"]) for x in after["unapplied"].collect()) == [("o1", "edge_not_visible"), ("o6", "edge_not_visible"), ("o7", "node_not_visible"), ("o8", "unknown_op")]
    assert sorted((x["id"], x["change"]) for x in guard.diff(nodes, after).collect()) == [("north", "removed"), ("t12", "added")]


def test_what_if(spark):
    nodes, edges = board(spark)
    out = guard.what_if(nodes, edges, order(spark, {"op": "set_attr", "id": "quay", "key": "pallets", "value": val(12)}))
    assert out["envelope"].first()["committed"] is False
    assert [(x["key"], x["before"]["n"], x["after"]["n"]) for x in out["diff"].collect()] == [("pallets", 0.0, 12.0)]
    assert [(x["id"], x["distance"], x["degree"]) for x in out["impacts"].collect()][:2] == [("quay", 0, 1), ("north", 1, 3)]


def test_tombstones_mask_edges_for_good(spark):
    nodes, edges = board(spark)
    log = "seq int, op string, " + NODES
    steps = [(1, "tombstone", "t9", "Truck", {}), (2, "upsert", "t9", "Truck", {})]
    none = spark.createDataFrame([], "seq int, op string, " + EDGES)
    n, e = overlay.board_view(nodes, edges, spark.createDataFrame(steps, log), none)
    assert n.count() == 5 and {x["source"] for x in e.collect()} == {"t7", "north"}
    back = spark.createDataFrame([(3, "add_edge", "t9", "parked_at", "south")], "seq int, op string, " + EDGES)
    assert {(x["source"], x["target"]) for x in overlay.board_view(nodes, edges, spark.createDataFrame(steps, log), back)[1].collect()} == {("t7", "north"), ("t9", "south"), ("north", "quay")}
    assert overlay.board_view(nodes, edges, spark.createDataFrame(steps[:1], log), back)[1].count() == 2


def test_ingest(spark):
    nodes, _ = board(spark)
    entities = spark.createDataFrame([("a", "T"), (" ", "T"), ("b", None)], "name string, type string")
    edges = spark.createDataFrame([("a", "r", "t7"), ("a", "r", "b")], EDGES)
    count = lambda v, f: tuple(overlay.ingest_report(overlay.ingest(nodes, entities, edges, v, f)).first())
    assert count("private", "red") == (1, 2, 1, 1)
    assert count("shared", None) == (1, 2, 1, 1)
    assert count("shared", "red") == (0, 3, 0, 2)
    assert overlay.ingest(nodes, entities, edges, "private", "red")["nodes"].first()["faction"] == "red"


def test_tenants_are_isolated(spark):
    base = spark.createDataFrame([("f1", "a", "h1"), ("f2", "b", "h2")], "rel string, name string, hash string")
    writes = spark.createDataFrame([("t1", "f1", 1, "x"), ("t1", "f1", 2, "h1"), ("t2", "f2", 1, "y")], "tenant string, rel string, seq int, hash string")
    touched = overlay.touches(base, writes)
    assert [tuple(x) for x in touched.select("tenant", "rel", "hash").collect()] == [("t2", "f2", "y")]
    own = spark.createDataFrame([("t2", "f2", "new", "y")], "tenant string, rel string, name string, hash string")
    names = lambda t: sorted(x["name"] for x in overlay.tenant_view(base, touched, own, t).collect())
    assert names("t2") == ["a", "new"] and names("t1") == names("nobody") == ["a", "b"]
    gone = overlay.tenant_view(base, touched, own.where("false"), "t2")
    assert [x["name"] for x in gone.collect()] == ["a"]
    assert sorted((x["tenant"], x["name"]) for x in overlay.view(base, touched, own).collect()) == [("t2", "a"), ("t2", "new")]
    assert tuple(overlay.sharing_stats(touched.where("false")).first()) == (0, 0, 0, 0.0)
    s = spark.createDataFrame([("a", 1, 9), ("b", 2, 3), ("c", 3, 5)], "tenant string, created int, last_used int")
    assert sorted(x["tenant"] for x in overlay.evict(s, 2).where("kept").collect()) == ["a", "c"]
    assert sorted(x["tenant"] for x in overlay.evict(s, 2, "oldest").where("kept").collect()) == ["b", "c"]
