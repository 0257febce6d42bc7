"""Interval joins in time linear in both sides: dyadic cells instead of pairs.

A whole-number interval is the union of at most two aligned cells of each power of two; a point lies in one
cell of each. So "which intervals hold this point" is an equi-join on (keys, level, cell), and where only
the best of them or their being there is asked, each cell is aggregated to one row first: a file with
100,000 symbols costs each symbol and each point some 20 rows, and no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.scratch import settle


def cells_of(lo: Column, hi: Column) -> Column:
    """array<struct<level, cell>>: the aligned cells whose union is lo to hi, both included; none where hi is below lo."""
    odd = lambda x: F.pmod(x, F.lit(2)) == 1
    down = lambda x, k: F.call_function("shiftright", x, k)
    low, high = lo.cast("long"), hi.cast("long") + 1

    def at(k: Column) -> Column:
        first, last = -down(-low, k), down(high, k)
        cell = lambda c: F.struct(k.alias("level"), c.alias("cell"))
        return F.array_compact(F.array(F.when((first < last) & odd(first), cell(first)), F.when(odd(last) & (last - 1 >= first + odd(first).cast("long")), cell(last - 1))))

    levels = F.sequence(F.lit(0), F.floor(F.log2((high - low).cast("double"))).cast("int"))
    return F.when(high > low, F.flatten(F.transform(levels, at))).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))


def cells_around(point: Column, top: int) -> Column:
    """array<struct<level, cell>>: the cell of each level up to `top` that holds the point."""
    return F.transform(F.sequence(F.lit(0), F.lit(top)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", point.cast("long"), k).alias("cell")))


def top_level(cells: DataFrame) -> int:
    return cells.agg(F.max("level")).first()[0] or 0


def cut(rows: DataFrame, lo: str, hi: str, *columns) -> DataFrame:
    """columns, level, cell: a row for each cell of lo to hi."""
    return rows.select(*columns, F.explode(cells_of(F.col(lo), F.col(hi))).alias("_dyadic")).select(*columns, "_dyadic.level", "_dyadic.cell")


def placed(rows: DataFrame, point: str, top: int, *columns) -> DataFrame:
    """columns, level, cell: a row for each cell around the point."""
    return rows.select(*columns, F.explode(cells_around(F.col(point), top)).alias("_dyadic")).select(*columns, "_dyadic.level", "_dyadic.cell")


def best_around(points: DataFrame, rows: DataFrame, keys: list[str], point: str, lo: str, hi: str, best: Column, name: str) -> DataFrame:
    """points plus the least `best` of the rows of their keys whose lo to hi holds the point; points without one are left out."""
    held = settle(cut(rows.withColumn(name, best), lo, hi, *keys, name).groupBy(*keys, "level", "cell").agg(F.min(name).alias(name)))
    own = points.select(*keys, point).distinct()
    found = placed(own, point, top_level(held), *keys, point).join(held, [*keys, "level", "cell"]).groupBy(*keys, point).agg(F.min(name).alias(name))
    return points.join(found, [*keys, point])


def overlapping(rows: DataFrame, spans: DataFrame, keys: list[str], lo: str, hi: str, start: str, end: str) -> DataFrame:
    """The rows whose lo to hi meets any span start to end of their keys: those that hold a span's start, and those that start in a span."""
    mine = rows.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in rows.columns)))
    spans = spans.where(F.col(start) <= F.col(end))
    held = settle(cut(mine, lo, hi, *keys, "_row"))
    starts = placed(spans.select(*keys, start).distinct(), start, top_level(held), *keys).distinct()
    holds = held.join(starts, [*keys, "level", "cell"], "left_semi").select("_row")
    inside = settle(cut(spans.select(*keys, start, end).distinct(), start, end, *keys).distinct())
    begins = placed(mine.where(F.col(lo) <= F.col(hi)), lo, top_level(inside), *keys, "_row").join(inside, [*keys, "level", "cell"], "left_semi").select("_row")
    return holds.unionByName(begins).distinct().select("_row.*")


def first_overlap(rows: DataFrame, keys: list[str], order: str, lo: str, hi: str, name: str) -> DataFrame:
    """rows plus the least `order` of the rows of their keys, themselves included, that share more than an end with them (lo to hi, hi
    left out, numbers of any kind). Rows that hold nothing (lo not below hi) are left out."""
    rows = rows.where(F.col(lo) < F.col(hi))
    ends = rows.select(*keys, F.explode(F.array(F.col(lo).cast("double"), F.col(hi).cast("double"))).alias("_v")).distinct()
    ranked = settle(ends.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_v"))))  # places instead of values
    place = lambda column, to: ranked.withColumnsRenamed({"_v": column, "_n": to})
    put = rows.withColumns({"_a": F.col(lo).cast("double"), "_b": F.col(hi).cast("double")}).join(place("_a", "_lo"), [*keys, "_a"]).join(place("_b", "_hi"), [*keys, "_b"])
    put = settle(put.withColumn("_hi", F.col("_hi") - 1).drop("_a", "_b"))
    # those that hold this start, and those that start inside
    held = settle(cut(put, "_lo", "_hi", *keys, order).groupBy(*keys, "level", "cell").agg(F.min(order).alias(name)))
    top = top_level(held)
    around = placed(put, "_lo", top, *keys, "_lo").distinct().join(held, [*keys, "level", "cell"]).groupBy(*keys, "_lo").agg(F.min(name).alias("_at"))
    begun = settle(placed(put, "_lo", top, *keys, order).groupBy(*keys, "level", "cell").agg(F.min(order).alias(name)))
    inside = cut(put.select(*keys, "_lo", "_hi").distinct(), "_lo", "_hi", *keys, "_lo", "_hi").join(begun, [*keys, "level", "cell"]).groupBy(*keys, "_lo", "_hi").agg(F.min(name).alias("_in"))
    return put.join(around, [*keys, "_lo"]).join(inside, [*keys, "_lo", "_hi"]).withColumn(name, F.least("_at", "_in")).drop("_lo", "_hi", "_at", "_in")
