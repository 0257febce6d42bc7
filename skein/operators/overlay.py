"""Copy-on-write overlays: a tenant's view is the base without what it touched, plus its own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def touches(base_files: DataFrame, writes: DataFrame) -> DataFrame:
    """(tenant, rel, hash, ...) in force: the latest write of each file, unless it says what the base says."""
    last = Window.partitionBy("tenant", "rel").orderBy(F.desc("seq"))
    latest = writes.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    return latest.join(base_files.select("rel", "hash"), ["rel", "hash"], "left_anti")


def view(base: DataFrame, touched: DataFrame, own: DataFrame, key: str = "rel") -> DataFrame:
    """(tenant, base columns): for each tenant, base rows of files that it has not touched and its own rows.

    A touched file without own rows is deleted. The base is read once for all tenants."""
    tenants = touched.select("tenant").distinct()
    masked = base.join(tenants, F.lit(True)).join(touched.select("tenant", key).distinct(), ["tenant", key], "left_anti")
    return masked.select("tenant", *base.columns).unionByName(own.select("tenant", *base.columns))


def tenant_view(base: DataFrame, touched: DataFrame, own: DataFrame, tenant, key: str = "rel") -> DataFrame:
    """One tenant's view; a tenant that touched nothing sees the base."""
    mine = touched.where(F.col("tenant") == tenant).select(key).distinct()
    return base.join(mine, key, "left_anti").unionByName(own.where(F.col("tenant") == tenant).select(*base.columns))


def view_edges(base_edges: DataFrame, base_symbols: DataFrame, base_callers: DataFrame, own_symbols: DataFrame, own_calls: DataFrame, touched: DataFrame) -> DataFrame:
    """(src, dst) of one tenant's composed graph over nodes (node, name, language, file).

    Base edges between untouched files stay. Base callers by name of anything that an overlay
    defines are tied to the overlay's node. Overlay calls are attributed inside their own file
    and resolved by name against the whole view."""
    hidden = touched.select("file").distinct()
    kept = base_symbols.join(hidden, "file", "left_anti")
    still = kept.select("node")
    base = base_edges.join(still.withColumnRenamed("node", "src"), "src", "left_semi").join(still.withColumnRenamed("node", "dst"), "dst", "left_semi")
    mine = own_symbols.select("node", "name", "language")
    remapped = base_callers.join(still.withColumnRenamed("node", "caller_node"), "caller_node", "left_semi").join(mine.withColumnRenamed("name", "callee"), ["language", "callee"]).select(F.col("caller_node").alias("src"), F.col("node").alias("dst"))
    whole = kept.select("node", "name", "language").unionByName(mine)
    caller = own_symbols.select(F.col("node").alias("src"), "file", F.col("name").alias("caller"))
    own = own_calls.join(caller, ["file", "caller"]).join(whole.withColumnsRenamed({"name": "callee", "node": "dst"}), ["language", "callee"]).select("src", "dst")
    return base.select("src", "dst").unionByName(remapped).unionByName(own).where("src <> dst").distinct()


def sharing_stats(touched: DataFrame) -> DataFrame:
    """One row: touches, distinct contents among them, parses saved, and the share saved (0 for none)."""
    return touched.agg(F.count(F.lit(1)).alias("touches"), F.count_distinct("hash").alias("live")).select(
        "touches", "live", (F.col("touches") - F.col("live")).alias("saved"), F.when(F.col("touches") > 0, F.round((F.col("touches") - F.col("live")) / F.col("touches"), 6)).otherwise(0.0).alias("ratio")
    )


def registry_status(touched: DataFrame) -> DataFrame:
    return touched.groupBy("tenant").agg(F.count_distinct("rel").alias("files"), F.count_distinct("hash").alias("contents"))


def evict(sessions: DataFrame, cap: int = 32, policy: str = "lru") -> DataFrame:
    """Sessions (tenant, created, last_used) with `kept`: beyond the cap the least recently used, or oldest, go."""
    order = F.desc("last_used" if policy == "lru" else "created")
    ranked = sessions.orderBy(order, "tenant").limit(cap).select("tenant").withColumn("kept", F.lit(True))
    return sessions.join(ranked, "tenant", "left").fillna(False, ["kept"])


def sweep(parses: DataFrame, touched: DataFrame) -> DataFrame:
    """Interned parses that some overlay still refers to."""
    return parses.join(touched.select("hash").distinct(), "hash", "left_semi")


# ---- boards: nodes (id, kind, attrs...), edges (source, relation, target) and change logs ----


def latest(changes: DataFrame, key: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc("seq"))
    return changes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def board_view(nodes: DataFrame, edges: DataFrame, node_changes: DataFrame, edge_changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The visible (nodes, edges) after a log of node changes (seq, op, node columns) and edge changes
    (seq, op, source, relation, target).

    Node ops are upsert and tombstone, edge ops add_edge and mask_edge. A tombstone masks the
    base edges at its node for good, also where the node comes back; adding such an edge
    unmasks it. Edges need both ends visible."""
    last = latest(node_changes, ["id"])
    own = last.where("op = 'upsert'").select(*nodes.columns)
    seen = nodes.join(last.select("id"), "id", "left_anti").unionByName(own)
    buried = node_changes.where("op = 'tombstone'").groupBy("id").agg(F.max("seq").alias("seq"))
    triple = ["source", "relation", "target"]
    by_end = [edges.join(buried.withColumnRenamed("id", end), end).select(*triple, "seq", F.lit("mask_edge").alias("op")) for end in ("source", "target")]
    log = by_end[0].unionByName(by_end[1]).unionByName(edge_changes.select(*triple, "seq", "op"))
    state = latest(log, triple)
    kept = edges.select(*triple).join(state.where("op = 'mask_edge'").select(*triple), triple, "left_anti").unionByName(state.where("op = 'add_edge'").select(*triple)).distinct()
    return seen, visible(kept, seen)


def visible(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with a missing end, and which: source, target or both."""
    ids = nodes.select("id", F.lit(True).alias("_h"))
    out = edges.join(ids.withColumnsRenamed({"id": "source", "_h": "_s"}), "source", "left").join(ids.withColumnsRenamed({"id": "target", "_h": "_t"}), "target", "left")
    missing = F.when(F.col("_s").isNull() & F.col("_t").isNull(), "both").when(F.col("_s").isNull(), "source").when(F.col("_t").isNull(), "target")
    return out.select("source", "relation", "target", missing.alias("missing")).where("missing IS NOT NULL")


def ingest(existing: DataFrame, entities: DataFrame, edges: DataFrame, visibility: str, faction: str | None) -> dict[str, DataFrame]:
    """Accepted and rejected rows of a write: entities (name, type), edges (source, relation, target).

    A shared write that names a faction is refused whole. Blank names or types are rejected row
    by row, and edges whose ends are not visible after the write. Private rows carry the faction."""
    refused = visibility == "shared" and faction is not None
    blank = (F.trim(F.coalesce("name", F.lit(""))) == "") | (F.trim(F.coalesce("type", F.lit(""))) == "")
    marked = entities.withColumn("reason", F.when(F.lit(refused), "faction_on_shared").when(blank, "blank").otherwise(F.lit(None).cast("string")))
    good = marked.where("reason IS NULL").select(F.col("name").alias("id"), F.col("type").alias("kind"), F.lit(faction if visibility == "private" else None).cast("string").alias("faction"))
    ids = existing.select("id").unionByName(good.select("id")).distinct()
    bad = edges.select(*("source", "relation", "target"), F.lit("faction_on_shared").alias("reason")) if refused else dangling(edges, ids).select("source", "relation", "target", F.lit("dangling").alias("reason"))
    fine = edges.where(F.lit(not refused)).select("source", "relation", "target")
    return {"nodes": good, "rejected_nodes": marked.where("reason IS NOT NULL"), "edges": visible(fine, ids), "rejected_edges": bad}


def ingest_report(parts: dict[str, DataFrame]) -> DataFrame:
    """One row of counters."""
    out = None
    for name, rows in parts.items():
        n = rows.agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.crossJoin(n)
    return out


def isolation_report(shared: DataFrame) -> DataFrame:
    """(game, leaked): faction-tagged ids that stand in a game's shared base."""
    return shared.where("faction IS NOT NULL").groupBy("game").agg(F.array_sort(F.collect_set("id")).alias("leaked"))
