"""Speculative orders, policy guards with blame, and what-if differences over a board.

Orders are rows (order_id, seq, pos, op, id, key, value, kind, source, relation, target) with
op one of upsert_node, remove_node, set_attr, add_edge, remove_edge. Policies hold a selector
and a predicate in the pattern language. Every outcome is tagged: evaluated, refused,
unevaluated or vacuous; "could not evaluate" is never "no match".
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import graph, overlay, pattern
from skein.scratch import settle

OPS = ("upsert_node", "remove_node", "set_attr", "add_edge", "remove_edge")


@dataclass(frozen=True)
class Policy:
    label: str
    selector: str
    predicate: str
    match: str = "must-match"  # must-match, must-not-match, must-exist
    effect: str = "deny"
    claim: str = ""
    boundary: str = "order"
    language: str = "graph-pattern"

    def compiled(self) -> tuple[pattern.Pattern, pattern.Pattern]:
        """Selector and predicate; raises where they cannot be evaluated here."""
        if self.boundary != "order":
            raise pattern.PatternError(f"boundary {self.boundary!r} is not evaluated at an order")
        if self.language != "graph-pattern":
            raise pattern.PatternError(f"language {self.language!r} is not evaluated")
        if self.match not in ("must-match", "must-not-match", "must-exist"):
            raise pattern.PatternError(f"unknown direction {self.match!r}")
        return pattern.parse(self.selector), pattern.parse(self.predicate)


def apply_orders(nodes: DataFrame, edges: DataFrame, orders: DataFrame) -> dict[str, DataFrame]:
    """The board after the orders' effects in (seq, pos) order: nodes, edges, touched (id, order_id), unapplied.

    Later effects see earlier ones: an attribute needs its node to be there at that point, an
    edge both ends. Whether a node is there is a running fact of that node's own effects, so
    effects on nodes are folded node by node and edges are tested against the nodes' history."""
    step = F.struct("seq", "pos")
    moves = orders.withColumn("step", step)
    base = nodes.select("id", F.lit(True).alias("_base"))

    def history(rows: DataFrame) -> DataFrame:
        """Node effects with `alive`: was the node there just before."""
        last = F.last(F.col("_after"), ignorenulls=True).over(window)
        after = F.when(F.col("op") == "upsert_node", True).when(F.col("op") == "remove_node", False)
        return rows.withColumn("_after", after).withColumn("alive", F.coalesce(last, F.col("_base"), F.lit(False)))

    window = Window.partitionBy("id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    on_nodes = history(moves.where(F.col("op").isin("upsert_node", "remove_node", "set_attr")).join(base, "id", "left"))
    on_nodes = settle(on_nodes.select("order_id", "step", "op", "id", "kind", "key", "value", "alive"))
    good = on_nodes.where((F.col("op") == "upsert_node") | F.col("alive"))
    # a node's attributes: those of its last life, later ones over earlier ones
    born = good.where("op IN ('upsert_node', 'remove_node')").groupBy("id").agg(F.max_by("op", "step").alias("last"), F.max("step").alias("since"), F.max_by("kind", "step").alias("new_kind"))
    sets = good.where("op = 'set_attr'").join(born, "id", "left").where("since IS NULL OR step > since")
    sets = sets.groupBy("id", "key").agg(F.max_by("value", "step").alias("value")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("new"))
    out = nodes.join(born, "id", "full").join(sets, "id", "left")
    empty = F.create_map().cast(f"map<string,{pattern.VALUE}>")
    start = F.when(F.col("last") == "upsert_node", empty).otherwise(F.coalesce("attrs", empty))
    merged = F.map_concat(F.map_filter(start, lambda k, _: ~F.coalesce(F.map_contains_key(F.coalesce("new", empty), k), F.lit(False))), F.coalesce("new", empty))
    new_nodes = out.where("last IS NULL OR last = 'upsert_node'").select("id", F.coalesce("new_kind", "kind").alias("kind"), merged.alias("attrs"))

    lives = on_nodes.where("op IN ('upsert_node', 'remove_node') AND (op = 'upsert_node' OR alive)").select("id", "step", (F.col("op") == "upsert_node").alias("on"))
    on_edges = moves.where(F.col("op").isin("add_edge", "remove_edge")).select("order_id", "step", "op", "source", "relation", "target")

    def there(rows: DataFrame, end: str) -> DataFrame:
        past = rows.select("step", end).distinct().join(lives.withColumnsRenamed({"step": "_w", "id": end}), end).where("_w < step").groupBy("step", end).agg(F.max_by("on", "_w").alias("_on"))
        out = rows.join(past, ["step", end], "left").join(base.withColumnRenamed("id", end), end, "left")
        return out.withColumn(f"{end}_on", F.coalesce("_on", "_base", F.lit(False))).drop("_on", "_base")

    triple = ["source", "relation", "target"]
    ends = there(there(on_edges, "source"), "target")
    prior = edges.select(*triple).distinct().withColumn("_e", F.lit(True))
    window = Window.partitionBy(*triple).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    state = F.when((F.col("op") == "add_edge") & F.col("source_on") & F.col("target_on"), True).when(F.col("op") == "remove_edge", False)
    ends = ends.join(prior, triple, "left").withColumn("_after", state).withColumn("present", F.coalesce(F.last("_after", ignorenulls=True).over(window), F.col("_e"), F.lit(False)))
    ends = settle(ends.withColumn("ok", F.col("source_on") & F.col("target_on") & ((F.col("op") == "add_edge") | F.col("present"))).select("order_id", "step", "op", *triple, "ok"))
    last = ends.where("ok").groupBy(*triple).agg(F.max_by("op", "step").alias("op"))
    kept = edges.select(*triple).distinct().join(last.where("op = 'remove_edge'").select(*triple), triple, "left_anti").unionByName(last.where("op = 'add_edge'").select(*triple)).distinct()
    touched = good.select("id", "order_id").unionByName(ends.where("ok").select(F.explode(F.array("source", "target")).alias("id"), "order_id")).distinct()
    known = moves.where(F.col("op").isin(*OPS))
    unapplied = on_nodes.where("op <> 'upsert_node' AND NOT alive").select("order_id", "op", F.col("id").alias("subject"), F.lit("node_not_visible").alias("reason"))
    unapplied = unapplied.unionByName(ends.where("NOT ok").select("order_id", "op", F.concat_ws(" ", *triple).alias("subject"), F.lit("edge_not_visible").alias("reason")))
    unapplied = unapplied.unionByName(moves.join(known.select("step"), "step", "left_anti").select("order_id", "op", F.coalesce("id", F.lit("")).alias("subject"), F.lit("unknown_op").alias("reason")))
    new_nodes = settle(new_nodes)  # every policy and difference reads the board after the orders
    return {"nodes": new_nodes, "edges": settle(overlay.visible(kept, new_nodes)), "touched": settle(touched), "unapplied": unapplied}


def breaches(policy: Policy, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Bindings of the selector that breach the policy; one row without bindings for must-exist."""
    selector, predicate = policy.compiled()
    selected = pattern.evaluate(selector, nodes, edges)
    variables = tuple(selector.variables())
    keys = [f"v_{v}" for v in variables]
    good = pattern.evaluate(predicate, nodes, edges, selected, variables).select(*keys).distinct()
    if policy.match == "must-match":
        return _anti(selected, good, keys)
    if policy.match == "must-not-match":
        return good
    counts = selected.agg(F.count(F.lit(1)).alias("n")).crossJoin(good.agg(F.count(F.lit(1)).alias("m")))
    return counts.where("n > 0 AND m = 0").select(*(F.lit(None).cast(pattern.BOUND).alias(k) for k in keys))


def _on(left: DataFrame, right: DataFrame, keys: list[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return cond, right.withColumnsRenamed({k: f"_r_{k}" for k in keys})


def _anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    cond, other = _on(left, right, keys)
    return left.join(other, cond, "left_anti")


def rendered(keys: list[str]):
    """var=value pairs of a binding, in order of the variables' names."""
    parts = []
    for k in sorted(keys):
        v = F.col(k)["value"]
        text = F.coalesce(F.col(k)["node"], v["s"], v["b"].cast("string"), F.when(v["n"] == F.floor(v["n"]), v["n"].cast("decimal(38,0)").cast("string")).otherwise(v["n"].cast("string")), F.lit("-"))
        parts.append(F.concat(F.lit(f"{k[2:]}="), text))
    return F.concat_ws(" ", *parts)


def guard(policies: list[Policy], nodes: DataFrame, edges: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """(policy, outcome, effect, binding, pre_existing, blame, reason): what the board after the orders breaches.

    A board without nodes, or no policies, is refused. A breach that stood before the orders is
    marked and blames nobody; else the orders that touched a node of its binding are blamed."""
    spark = nodes.sparkSession
    schema = "policy string, outcome string, effect string, binding string, pre_existing boolean, blame array<string>, reason string"
    said = lambda *rows: spark.createDataFrame(list(rows), schema)
    if not policies:
        return said((None, "refused", None, None, None, None, "no policies"))
    if nodes.isEmpty():
        return said((None, "refused", None, None, None, None, "empty board"))
    after = apply_orders(nodes, edges, orders) if orders is not None else {"nodes": nodes, "edges": edges, "touched": None}
    out = None
    for p in policies:
        try:
            selector, _ = p.compiled()
        except pattern.PatternError as e:
            part = said((p.label, "unevaluated", p.effect, None, None, None, str(e)))
        else:
            keys = [f"v_{v}" for v in selector.variables()]
            post = breaches(p, after["nodes"], after["edges"])
            if orders is not None:
                # the numbers tie blame to its breach, so they are given once: read twice, the rows would be numbered anew
                post = settle(post.withColumn("_n", F.monotonically_increasing_id()))
                cond, before = _on(post, breaches(p, nodes, edges).withColumn("_pre", F.lit(True)), keys)
                post = post.join(before, cond, "left").select("_n", *keys, F.coalesce("_pre", F.lit(False)).alias("pre_existing"))
                ids = post.select("_n", F.explode(F.array(*(F.col(k)["node"] for k in keys))).alias("id")).where("id IS NOT NULL")
                blame = ids.join(after["touched"], "id").groupBy("_n").agg(F.array_sort(F.collect_set("order_id")).alias("_blame"))
                post = post.join(blame, "_n", "left")
                blamed = F.when(F.col("pre_existing"), F.array().cast("array<string>")).otherwise(F.coalesce("_blame", F.array().cast("array<string>")))
            else:
                post, blamed = post.withColumn("pre_existing", F.lit(False)), F.array().cast("array<string>")
            part = post.select(F.lit(p.label).alias("policy"), F.lit("evaluated").alias("outcome"), F.lit(p.effect).alias("effect"), rendered(keys).alias("binding"), "pre_existing", blamed.alias("blame"), F.lit(None).cast("string").alias("reason"))
            empty = pattern.evaluate(selector, after["nodes"], after["edges"]).agg(F.count(F.lit(1)).alias("n")).where("n = 0")
            part = part.unionByName(empty.select(F.lit(p.label).alias("policy"), F.lit("vacuous").alias("outcome"), F.lit(p.effect).alias("effect"), *(F.lit(None).cast(t).alias(c) for c, t in (("binding", "string"), ("pre_existing", "boolean"), ("blame", "array<string>"))), F.lit("nothing selected").alias("reason")))
        out = part if out is None else out.unionByName(part)
    return out


def diff(nodes: DataFrame, after: dict[str, DataFrame]) -> DataFrame:
    """(id, change, key, before, after) of touched nodes: added, removed, or an attribute that differs."""
    touched = after["touched"].select("id").distinct()
    pre, post = nodes.join(touched, "id", "left_semi"), after["nodes"].join(touched, "id", "left_semi")
    both = pre.select("id", F.col("attrs").alias("a"), F.lit(True).alias("_a")).join(post.select("id", F.col("attrs").alias("b"), F.lit(True).alias("_b")), "id", "full")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("key", "string"), ("before", pattern.VALUE), ("after", pattern.VALUE))]
    lone = both.where("_a IS NULL OR _b IS NULL").select("id", F.when(F.col("_a").isNull(), "added").otherwise("removed").alias("change"), *none)
    keys = both.where("_a AND _b").select("id", "a", "b", F.explode(F.array_union(F.map_keys("a"), F.map_keys("b"))).alias("key"))
    changed = keys.select("id", F.lit("attr").alias("change"), "key", F.col("a")[F.col("key")].alias("before"), F.col("b")[F.col("key")].alias("after"))
    return lone.unionByName(changed.where(~F.col("before").eqNullSafe(F.col("after"))))


def impacts(after: dict[str, DataFrame], hops: int = 3) -> DataFrame:
    """(id, distance, degree) around the touched nodes, undirected, themselves at 0; nearest and best connected first."""
    edges = after["edges"].select(F.col("source").alias("src"), F.col("target").alias("dst"))
    seeds = after["touched"].select(F.col("id").alias("node")).distinct().join(after["nodes"].select(F.col("id").alias("node")), "node", "left_semi")
    found = seeds.withColumn("distance", F.lit(0)).unionByName(graph.reach(edges, seeds, "both", hops))
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return found.join(ends, "node", "left").select(F.col("node").alias("id"), "distance", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy("distance", F.desc("degree"), "id")


def what_if(nodes: DataFrame, edges: DataFrame, orders: DataFrame, hops: int = 3) -> dict[str, DataFrame]:
    """Differences, ranked impacts and unapplied effects of orders that are never committed."""
    after = apply_orders(nodes, edges, orders)
    head = nodes.sparkSession.createDataFrame([(False, "engine-state")], "committed boolean, tier string")
    return {"envelope": head, "diff": diff(nodes, after), "impacts": impacts(after, hops), "unapplied": after["unapplied"]}
