"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.scratch import discard, settle

HOT, SALTS = 1000, 64


def salted(left: DataFrame, keys: list[str], spread: str, right: DataFrame, size: str, total: float, how: str = "inner") -> DataFrame:
    """left joined with right (one row a key, `size` = its rows in left), keys of over 1 / HOT of `total` rows spread.

    At most a few thousand keys can be that large (sizes sum to a small multiple of total), so
    their list is broadcast; their rows of left are salted by `spread`, and their row of right repeated."""
    large = F.col(size) * HOT > F.lit(float(total))
    hot = F.broadcast(right.where(large).select(*keys, F.lit(SALTS).alias("salts")))
    left = left.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64(spread), F.coalesce("salts", F.lit(1)))).drop("salts")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(large, SALTS - 1).otherwise(0).cast("long")))).drop(size)
    return left.join(right, [*keys, "salt"], how).drop("salt")


def connected(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the smallest node of its component.

    Each round is two joins of the edges with their nodes' smallest neighbours, written to the
    shared folder; rounds grow with the logarithm of a component's size. Hubs are salted, and
    nothing is collected. Done where every node has one edge, to a node that has none upwards."""
    pairs = settle(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most):
        ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        total, open_ = ends.agg(F.sum("up"), F.sum(((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).cast("long"))).first()
        if not open_:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
        # large star: a node's larger neighbours go to its smallest one, and so does it
        large = salted(pairs.withColumnRenamed("v", "low"), ["low"], "u", least.withColumnRenamed("u", "low"), "n", total).select("u", F.col("m").alias("v"))
        large = settle(large.unionByName(least.where("m <> u").select("u", F.col("m").alias("v"))).distinct())
        # small star: a node's smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = salted(large, ["u"], "v", least, "n", total).where("v <> m").select("v", "m")
        small = small.unionByName(least.select(F.col("u").alias("v"), "m")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").distinct()
        before, pairs = pairs, settle(small)
        discard(before)
        discard(large)
    else:
        raise RuntimeError(f"components not settled after {most} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
