"""Spools, throttles, debouncing in batch form, session audits and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import intervals

CAP = 21_600  # the longest throttle, in seconds


def backoff(expression: Column, overage: Column) -> Column:
    """Seconds of `exp(min(overage / D, C))`, floored and capped; null where malformed or D <= 0."""
    form = r"^\s*exp\(\s*min\(\s*overage\s*/\s*([0-9.]+)\s*,\s*([0-9.]+)\s*\)\s*\)\s*$"
    d, c = (F.regexp_extract(expression, form, i).try_cast("double") for i in (1, 2))
    return F.when((d > 0) & c.isNotNull(), F.least(F.floor(F.exp(F.least(overage / d, c, F.lit(700.0)))), F.lit(CAP)).cast("long"))


def throttle_rows(events: DataFrame, now: Column, seconds: Column) -> DataFrame:
    """(constraint_id, scope, until) of throttles set now: the cap is six hours."""
    return events.select("constraint_id", "scope", (now + F.least(seconds, F.lit(CAP))).cast("long").alias("until"))


def active_throttles(log: DataFrame, scope: str, now: int) -> DataFrame:
    """(constraint_id, until) in force for a scope; rows without a scope match nothing."""
    return log.where(F.col("scope") == scope).groupBy("constraint_id").agg(F.max("until").alias("until")).where(F.col("until") > now).orderBy("constraint_id")


def tail(spool: DataFrame, order: str, line: str, size: int = 256 << 10) -> DataFrame:
    """The last whole lines within `size` bytes of the end; the line that the cut tears is dropped, and so are lines of the same place.

    What is cut off is found on (order, bytes) alone: as many of the latest rows as fill `size` if all were as short as the shortest.
    The rows themselves are read again and compared with the place of the cut, so nothing depends on how they were dealt out."""
    sized = spool.where(F.col(line).isNotNull()).select(F.col(order).alias("_o"), (F.octet_length(line) + 1).alias("_n"))
    least = sized.agg(F.min("_n")).first()[0]
    if least is None:
        return spool.where("false")
    latest = sized.orderBy(F.desc("_o")).limit(size // least + 1)
    upto = F.sum("_n").over(Window.orderBy(F.desc("_o")))  # lines of one place together
    cut = latest.withColumn("_u", upto).agg(F.max(F.when(F.col("_u") > size, F.struct("_o"))).alias("_out"), F.max("_o").alias("_last"))
    beyond = F.col("_out").isNull() | (F.col(order) > F.col("_out._o")) | (F.col("_out._o").isNull() & F.col(order).isNotNull())
    return spool.join(F.broadcast(cut), beyond & (F.col(order).isNull() | (F.col(order) <= F.col("_last")))).drop("_out", "_last")


def newest(spool: DataFrame, order: str, columns: list[str]) -> DataFrame:
    return spool.agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*")


def debounce(events: DataFrame, key: str, ts: str, window_us: int) -> DataFrame:
    """(key, first, last, events, due): runs of events less than the window apart; each flushes a window after its last."""
    w = Window.partitionBy(key).orderBy(ts)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = us - F.lag(us).over(w)
    marked = events.select(key, ts, F.when(gap < window_us, 0).otherwise(1).alias("_new"))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("events")).select(key, "first", "last", "events", F.timestamp_micros(F.unix_micros(F.col("last").cast("timestamp")) + window_us).alias("due"))


def once(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rereads(events: DataFrame) -> DataFrame:
    """(session, path, idx, prior): reads (lo, hi) that overlap an earlier read of the same path since its last edit, or
    since the session's last compaction, and the first such read. events: session, idx, kind (read, edit, compact), path, lo, hi; a read
    with lo not below hi reads nothing."""
    upto = lambda *by: Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    marked = events.withColumn("_c", F.sum((F.col("kind") == "compact").cast("int")).over(upto("session"))).withColumn("_e", F.sum((F.col("kind") == "edit").cast("int")).over(upto("session", "path")))
    reads = marked.where("kind = 'read'")
    # the least of all overlapping reads is the earliest prior one, if it is before this read at all
    met = intervals.first_overlap(reads, ["session", "path", "_c", "_e"], "idx", "lo", "hi", "prior")
    return met.where("prior < idx").select("session", "path", "idx", "prior")


def foreign_writes(events: DataFrame, owners: DataFrame) -> DataFrame:
    """(session, idx, path, owner): writes after a session's first work item to paths that another crew owns, case aside."""
    seen = F.max((F.col("kind") == "item").cast("int")).over(Window.partitionBy("session").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    writes = events.withColumn("_on", seen).where("kind = 'write' AND _on = 1")
    return writes.join(owners, "path").where(F.lower("crew") != F.lower("owner")).select("session", "idx", "path", "owner")


def concurrent(registry: DataFrame, me: str, now: int, age: int = 900) -> DataFrame:
    """Live registrations (tree, who, ts) by others on the trees where `me` is registered."""
    live = registry.where(F.col("ts") > now - age)
    return live.where(F.col("who") != me).join(live.where(F.col("who") == me).select("tree").distinct(), "tree", "left_semi")


def drop_tally(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """(reason, n): the first reason that holds, else `kept`; every row counts once."""
    ladder = F.lit("kept")
    for name, test in reversed(reasons.items()):
        ladder = F.when(test, name).otherwise(ladder)
    return rows.groupBy(ladder.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def percentiles(rows: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact order statistics: the value at floor(p * (n - 1)) of each group in order.

    Two windows by group would hold a group in one task; ranks over (group, value) counts stay small
    where values repeat and otherwise spill, as any exact percentile must."""
    w = Window.partitionBy(*by).orderBy(value)
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = counted.withColumn("_hi", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    at = {k: F.floor((F.col("_n") - 1) * F.lit(p)) for k, p in points.items()}
    picks = [F.max(F.when((F.col("_hi") - F.col("_c") <= a) & (a < F.col("_hi")), F.col(value))).alias(k) for k, a in at.items()]
    return ranked.groupBy(*by).agg(*picks, F.max("_n").alias("n"))


def recorded_path(path: Column, root: str, mode: str) -> Column:
    """off: null; relative: below the root; absolute: as it is."""
    if mode == "off":
        return F.lit(None).cast("string")
    return F.when(path.startswith(root + "/"), F.substring(path, F.lit(len(root) + 2), F.length(path))).otherwise(path) if mode == "relative" else path


def attribution(rows: DataFrame, declared: str, executor: str) -> DataFrame:
    """rows plus the declared chain's parts and whether its tail is not the executor."""
    chain = F.filter(F.transform(F.split(declared, ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumn("chain", chain).withColumn("conflict", F.coalesce(F.try_element_at("chain", F.lit(-1)) != F.col(executor), F.lit(False)))
