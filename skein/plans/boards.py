"""Board queries: views, ingest checks, patterns, guards and what-if over nations, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import guard, overlay, pattern
from skein.plans.tables import board, effects, read


def _changes(spark, d):
    """Every 11th customer is tombstoned and every 33rd comes back; orders of every 5th get an extra edge."""
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    nodes, _ = board(spark, d)
    cid = F.concat(F.lit("c"), "c_custkey")
    gone = c.where("c_custkey % 11 = 0").select(cid.alias("id"), F.col("c_custkey").alias("seq"), F.lit("tombstone").alias("op"))
    back = c.where("c_custkey % 33 = 0").select(cid.alias("id"), (F.col("c_custkey") + 10_000_000).alias("seq"), F.lit("upsert").alias("op"))
    kinds = nodes.select("id", F.col("kind"), F.col("attrs"))
    node_changes = gone.unionByName(back).join(kinds, "id")
    edge_changes = c.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 20_000_000).alias("seq"), F.lit("add_edge").alias("op"), cid.alias("source"), F.lit("visited").alias("relation"), F.concat(F.lit("n"), ((F.col("c_nationkey") + 1) % 30).cast("string")).alias("target"))
    return node_changes, edge_changes


def board_view(spark, d):
    """What is left: edges by relation, and visible nodes by kind."""
    n, e = overlay.board_view(*board(spark, d), *_changes(spark, d))
    return n.groupBy(F.concat(F.lit("node:"), "kind").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(e.groupBy(F.concat(F.lit("edge:"), "relation").alias("what")).agg(F.count(F.lit(1)).alias("n")))


def board_edges(spark, d):
    _, e = overlay.board_view(*board(spark, d), *_changes(spark, d))
    return e.select("source", "relation", "target")


def dangling_edges(spark, d):
    n, e = board(spark, d)
    return overlay.dangling(e, n.where("NOT (kind = 'Customer' AND id LIKE '%7')"))


def ingest_report(spark, d):
    c = read(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    n, _ = board(spark, d)
    entities = c.select(F.concat(F.lit("x"), "c_custkey").alias("name"), F.when(F.col("c_custkey") % 9 == 0, " ").otherwise(F.col("c_mktsegment")).alias("type"))
    edges = c.select(F.concat(F.lit("x"), "c_custkey").alias("source"), F.lit("is").alias("relation"), F.concat(F.lit("c"), "c_custkey").alias("target"))
    return overlay.ingest_report(overlay.ingest(n, entities, edges, "private", "red"))


def ingest_refused(spark, d):
    c = read(spark, d, "customer", "c_custkey", "c_mktsegment")
    n, e = board(spark, d)
    entities = c.select(F.concat(F.lit("x"), "c_custkey").alias("name"), F.col("c_mktsegment").alias("type"))
    return overlay.ingest_report(overlay.ingest(n, entities, e, "shared", "red"))


def isolation_report(spark, d):
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    rows = c.select((F.col("c_nationkey") % 5).alias("game"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 25 == 0, "red").alias("faction"))
    return overlay.isolation_report(rows).select("game", F.array_join("leaked", ",").alias("leaked"))


def _flat(rows, *variables):
    v = lambda x: F.coalesce(F.col(f"v_{x}.node"), F.col(f"v_{x}.value.s"), F.format_string("%.2f", F.col(f"v_{x}.value.n")))
    return rows.select(*(v(x).alias(x) for x in variables))


def pattern_select(spark, d):
    return _flat(pattern.evaluate(pattern.parse('?c a Customer ; segment "BUILDING" ; balance ?b'), *board(spark, d)), "c", "b")


def pattern_join(spark, d):
    return _flat(pattern.evaluate(pattern.parse('?o a Order ; status "F" ; placed_by ?c . ?c a Customer ; segment "BUILDING" ; in ?n'), *board(spark, d)), "o", "c", "n")


def pattern_filter(spark, d):
    return _flat(pattern.evaluate(pattern.parse('?o a Order ; price ?p ; placed_by ?c . ?c balance ?b | ?p > 100000, ?b < 0, ?c != c1'), *board(spark, d)), "o", "p", "c", "b")


def pattern_bound(spark, d):
    """The second clause tests an edge to a node that the first has bound."""
    return _flat(pattern.evaluate(pattern.parse('?n a Nation ; name "NATION_5" . ?c a Customer ; in ?n'), *board(spark, d)), "n", "c")


def _guard(spark, d, selector, predicate, match):
    out = guard.guard([guard.Policy("p", selector, predicate, match)], *board(spark, d), effects(spark, d))
    return out.select("policy", "outcome", "binding", "pre_existing", F.array_join("blame", ",").alias("blame"))


def guard_must_match(spark, d):
    """Every customer has a balance of at least -1000."""
    return _guard(spark, d, "?c a Customer", "?c balance ?b | ?b >= -1000", "must-match")


def guard_must_not(spark, d):
    """No order is billed to a customer of segment MACHINERY."""
    return _guard(spark, d, "?o a Order", '?o billed_to ?c . ?c segment "MACHINERY"', "must-not-match")


def guard_must_exist(spark, d):
    return _guard(spark, d, "?c a Customer", "?c balance ?b | ?b > 1000000", "must-exist")


def guard_vacuous(spark, d):
    return _guard(spark, d, "?c a Supplier", "?c balance ?b", "must-match")


def whatif_diff(spark, d):
    n, e = board(spark, d)
    out = guard.diff(n, guard.apply_orders(n, e, effects(spark, d)))
    show = lambda c: F.coalesce(F.col(f"{c}.s"), F.when(F.col(f"{c}.n").isNotNull(), F.format_string("%.2f", F.col(f"{c}.n"))))
    return out.select("id", "change", F.coalesce("key", F.lit("-")).alias("key"), F.coalesce(show("before"), F.lit("-")).alias("before"), F.coalesce(show("after"), F.lit("-")).alias("after"))


def whatif_unapplied(spark, d):
    n, e = board(spark, d)
    return guard.apply_orders(n, e, effects(spark, d))["unapplied"]


def whatif_impacts(spark, d):
    n, e = board(spark, d)
    return guard.impacts(guard.apply_orders(n, e, effects(spark, d)), 1)


QUERIES = {f.__name__: f for f in (board_view, board_edges, dangling_edges, ingest_report, ingest_refused, isolation_report, pattern_select, pattern_join, pattern_filter, pattern_bound, guard_must_match, guard_must_not, guard_must_exist, guard_vacuous, whatif_diff, whatif_unapplied, whatif_impacts)}

_VIEW = """
nd AS (SELECT 'n' || n_nationkey AS id, 'Nation' AS kind FROM nation UNION ALL SELECT 'c' || c_custkey, 'Customer' FROM customer WHERE c_custkey % 11 <> 0 OR c_custkey % 33 = 0 UNION ALL SELECT 'o' || o_orderkey, 'Order' FROM orders),
ed AS (SELECT 'c' || c_custkey AS source, 'in' AS relation, 'n' || c_nationkey AS target FROM customer WHERE c_custkey % 11 <> 0
       UNION SELECT 'o' || o_orderkey, 'placed_by', 'c' || o_custkey FROM orders WHERE o_custkey % 11 <> 0
       UNION SELECT 'c' || c_custkey, 'visited', 'n' || ((c_nationkey + 1) % 30) FROM customer WHERE c_custkey % 5 = 0),
ve AS (SELECT * FROM ed WHERE source IN (SELECT id FROM nd) AND target IN (SELECT id FROM nd))"""
_AFTER = """
ca AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN -5000.0 ELSE c_acctbal END AS bal, c_acctbal AS old, c_mktsegment AS seg FROM customer WHERE c_custkey % 70 <> 0)"""

ORACLES = {
    "board_view": f"WITH {_VIEW} SELECT 'node:' || kind AS what, count(*) AS n FROM nd GROUP BY 1 UNION ALL SELECT 'edge:' || relation, count(*) FROM ve GROUP BY 1",
    "board_edges": f"WITH {_VIEW} SELECT * FROM ve",
    "dangling_edges": "SELECT 'c' || c_custkey AS source, 'in' AS relation, 'n' || c_nationkey AS target, 'source' AS missing FROM customer WHERE c_custkey % 10 = 7 UNION ALL SELECT 'o' || o_orderkey, 'placed_by', 'c' || o_custkey, 'target' FROM orders WHERE o_custkey % 10 = 7",
    "ingest_report": "SELECT count(*) FILTER (WHERE c_custkey % 9 <> 0) AS nodes, count(*) FILTER (WHERE c_custkey % 9 = 0) AS rejected_nodes, count(*) FILTER (WHERE c_custkey % 9 <> 0) AS edges, count(*) FILTER (WHERE c_custkey % 9 = 0) AS rejected_edges FROM customer",
    "ingest_refused": "SELECT 0 AS nodes, (SELECT count(*) FROM customer) AS rejected_nodes, 0 AS edges, (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS rejected_edges",
    "isolation_report": "SELECT c_nationkey % 5 AS game, string_agg('c' || c_custkey, ',' ORDER BY 'c' || c_custkey) AS leaked FROM customer WHERE c_custkey % 25 = 0 GROUP BY 1",
    "pattern_select": "SELECT 'c' || c_custkey AS c, printf('%.2f', c_acctbal) AS b FROM customer WHERE c_mktsegment = 'BUILDING'",
    "pattern_join": "SELECT 'o' || o_orderkey AS o, 'c' || o_custkey AS c, 'n' || c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'",
    "pattern_filter": "SELECT 'o' || o_orderkey AS o, printf('%.2f', o_totalprice) AS p, 'c' || o_custkey AS c, printf('%.2f', c_acctbal) AS b FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 AND c_acctbal < 0 AND c_custkey <> 1",
    "pattern_bound": "SELECT 'n' || n_nationkey AS n, 'c' || c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_5'",
    "guard_must_match": f"""WITH {_AFTER} SELECT 'p' AS policy, 'evaluated' AS outcome, 'c=c' || c_custkey AS binding, old < -1000 AS pre_existing, CASE WHEN old < -1000 OR c_custkey % 50 <> 0 THEN '' ELSE 'set_attr-' || (c_custkey + 10000000) END AS blame FROM ca WHERE bal < -1000""",
    "guard_must_not": f"""WITH {_AFTER} SELECT 'p' AS policy, 'evaluated' AS outcome, 'o=o' || o_orderkey AS binding, false AS pre_existing, 'add_edge-' || (o_orderkey + 30000000) AS blame FROM orders JOIN ca ON o_custkey = c_custkey WHERE o_orderkey % 90 = 0 AND seg = 'MACHINERY'""",
    "guard_must_exist": "SELECT 'p' AS policy, 'evaluated' AS outcome, 'c=-' AS binding, true AS pre_existing, '' AS blame WHERE (SELECT max(c_acctbal) FROM customer) <= 1000000",
    "guard_vacuous": "SELECT 'p' AS policy, 'vacuous' AS outcome, NULL AS binding, NULL::BOOLEAN AS pre_existing, NULL AS blame",
    "whatif_diff": "SELECT 'c' || c_custkey AS id, 'removed' AS change, '-' AS key, '-' AS before, '-' AS after FROM customer WHERE c_custkey % 70 = 0 UNION ALL SELECT 'c' || c_custkey, 'attr', 'balance', printf('%.2f', c_acctbal), '-5000.00' FROM customer WHERE c_custkey % 50 = 0 AND c_custkey % 70 <> 0 AND c_acctbal <> -5000.0",
    "whatif_unapplied": "SELECT 'add_edge-' || (o_orderkey + 30000000) AS order_id, 'add_edge' AS op, 'o' || o_orderkey || ' billed_to c' || o_custkey AS subject, 'edge_not_visible' AS reason FROM orders WHERE o_orderkey % 90 = 0 AND o_custkey % 70 = 0",
}
_TCH = """
nd AS (SELECT 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 70 <> 0 UNION ALL SELECT 'o' || o_orderkey FROM orders),
ed0 AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b, 'in' AS r FROM customer UNION SELECT 'o' || o_orderkey, 'c' || o_custkey, 'placed_by' FROM orders UNION SELECT 'o' || o_orderkey, 'c' || o_custkey, 'billed_to' FROM orders WHERE o_orderkey % 90 = 0),
ed AS (SELECT * FROM ed0 WHERE a IN (SELECT id FROM nd) AND b IN (SELECT id FROM nd)),
tch AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 50 = 0 AND c_custkey % 70 <> 0 UNION SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 90 = 0 AND o_custkey % 70 <> 0 UNION SELECT 'c' || o_custkey FROM orders WHERE o_orderkey % 90 = 0 AND o_custkey % 70 <> 0),
sm AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed)"""
ORACLES["whatif_impacts"] = f"WITH {_TCH}, rc AS (SELECT id, 0 AS distance FROM tch UNION ALL SELECT DISTINCT sm.b, 1 FROM sm JOIN tch ON sm.a = tch.id WHERE sm.b NOT IN (SELECT id FROM tch)) SELECT rc.id, distance, count(sm.a) AS degree FROM rc LEFT JOIN sm ON sm.a = rc.id GROUP BY 1, 2"
