"""What to show about work items: capped neighbourhoods with counts of what was left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPS = {"path": 12, "symbol": 10, "caller_file": 6}


def capped(rows: DataFrame, key: list[str], order: list[str], cap: int) -> DataFrame:
    """The first `cap` rows of each key in order, with `rank` and how many were withheld."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).withColumn("withheld", F.greatest(n - cap, F.lit(0)))
    return ranked.where(F.col("rank") <= cap)


def neighbourhood(touches: DataFrame, symbols: DataFrame, edges: DataFrame, caps: dict[str, int] | None = None, off: tuple[str, ...] = ()) -> DataFrame:
    """(item, section, value, rank, withheld) of touches (item, path): paths, the symbols in them, and the files that call those.

    Sections named in `off` are left out, which is how one source's part in an answer is measured."""
    caps = CAPS | (caps or {})
    paths = touches.select("item", F.col("path").alias("file")).distinct()
    own = paths.join(symbols.select("node", "name", "file"), "file")
    callers = own.select("item", F.col("node").alias("dst")).join(edges.select("src", "dst"), "dst").join(symbols.select(F.col("node").alias("src"), "file"), "src")
    outside = callers.select("item", "file").distinct().join(paths, ["item", "file"], "left_anti")
    parts = {"path": paths.select("item", F.col("file").alias("value")), "symbol": own.select("item", F.col("name").alias("value")).distinct(), "caller_file": outside.select("item", F.col("file").alias("value"))}
    out = None
    for section, rows in parts.items():
        if section in off:
            continue
        part = capped(rows, ["item"], ["value"], caps[section]).select("item", F.lit(section).alias("section"), "value", "rank", "withheld")
        out = part if out is None else out.unionByName(part)
    return out


def brief(found: DataFrame) -> DataFrame:
    """(item, text): one line a section, values in order, `(+n)` where some were withheld."""
    line = found.groupBy("item", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda v: v["value"]), ", ").alias("v"), F.max("withheld").alias("w"))
    text = F.concat(F.col("section"), F.lit(": "), F.col("v"), F.when(F.col("w") > 0, F.concat(F.lit(" (+"), F.col("w").cast("string"), F.lit(")"))).otherwise(""))
    return line.groupBy("item").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("text"))
