"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Each source's share of tokens is raised to an exponent and normalised. The exponent is
bisected in [0, 1]: up to the largest that still reaches `target_entropy` (as a share of the
entropy of uniform weights), or down to the smallest under which no source is repeated more
than `max_repeats` times. Weights times the token budget give a budget a source. Its
documents are hashed to blocks; every full pass takes all blocks in that epoch's seeded
permutation, and the last takes blocks in permuted order up to the rest of the budget.

Statistics cover all rows. Token counts are made once and settled; sources, blocks and
positions are aggregates and windows over at most `blocks` rows a source, so a source with
a third of all rows is spread over as many blocks and tasks. The driver bisects over the
distinct totals of sources, each with the number of sources that have it: numbers that sum to
all tokens, so of n tokens there are under sqrt(2 n) of them, however many sources there are.

Defined results: null and empty texts have no tokens and null sources are a source of their
own; repeated rows are kept as such; a source without tokens gets no budget; a text of any
length is only counted; empty tables give empty results. Weights under which a source would be
read more than MAX_PASSES times are refused (without max_repeats a tiny source can get there).
Columns of the input named like an output give way; any other names are allowed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.scratch import settle

MAX_PASSES = 10_000
OUT = ("n_tokens", "epoch", "block", "block_rank", "weight")


def weights(tokens, exponent: float, counts=None) -> np.ndarray:
    """Of one source of each total; counts says how many sources have it (one, if not given)."""
    tokens = np.asarray(tokens, float)
    counts = np.ones(len(tokens)) if counts is None else np.asarray(counts)
    raised = np.where(tokens > 0, (np.maximum(tokens, 1) / (tokens @ counts)) ** exponent, 0.0)
    return raised / (raised @ counts)


def entropy(w: np.ndarray, counts=None) -> float:
    counts = np.ones(len(w)) if counts is None else np.asarray(counts)
    live = w > 0
    return -float((counts[live] * w[live]) @ np.log(w[live]))


def bisect(good, rising: bool, steps: int = 60) -> float:
    """The exponent in [0, 1] where good() changes: largest good one, or smallest if rising."""
    if good(0.0 if rising else 1.0):
        return 0.0 if rising else 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        if good(mid) == rising:
            high = mid
        else:
            low = mid
    return high if rising else low


def exponent_for(tokens, budget: float, target_entropy: float | None, max_repeats: float | None, counts=None) -> float:
    live, many = np.asarray(tokens, float), np.ones(len(tokens)) if counts is None else np.asarray(counts)
    live, many = live[live > 0], many[live > 0]
    if many.sum() < 2:
        return 1.0
    found = 1.0 if max_repeats is None else 0.0  # without a target, as flat as the limit allows
    if target_entropy is not None:
        most = np.log(many.sum())
        found = bisect(lambda e: entropy(weights(live, e, many), many) >= target_entropy * most, rising=False)
    if max_repeats is not None:
        limit = max(max_repeats, budget / (live @ many))  # the natural mix repeats every source this often
        least = bisect(lambda e: bool((budget * weights(live, e, many) <= limit * live * (1 + 1e-9)).all()), rising=True)
        found = max(found, least)
    return found


def mix(
    docs: DataFrame, budget_tokens: int | None = None, target_entropy: float | None = 0.97, max_repeats: float | None = 4.0, blocks: int = 1024, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row for each time a document is read: its columns but the text, n_tokens, epoch, block, block_rank and weight."""
    text, source = F.coalesce(F.col(text_col), F.lit("")), F.col(source_col)
    own = [c for c in docs.columns if c not in OUT and c != text_col]
    where = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(text), F.lit(seed)), F.lit(blocks)).cast("int")
    # the input's columns travel in one struct, so that no name of theirs meets one of these
    counted = settle(docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), source.alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"), where.alias("block")))
    by_block = counted.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    totals = by_block.groupBy("source").agg(F.sum("tokens").alias("total"))
    sizes = totals.groupBy("total").agg(F.count(F.lit(1)).alias("n")).orderBy("total").toArrow()
    tokens, counts = np.asarray(sizes.column("total"), float), np.asarray(sizes.column("n"), float)
    total = float(tokens @ counts)
    budget = float(total if budget_tokens is None else budget_tokens)
    exponent = exponent_for(tokens, budget, target_entropy, max_repeats, counts)
    live = tokens > 0
    norm = float(counts[live] @ (tokens[live] / max(total, 1.0)) ** exponent) or 1.0
    passes = float((budget * (tokens[live] / total) ** exponent / norm / tokens[live]).max(initial=0.0))
    if passes > MAX_PASSES:
        raise ValueError(f"a source would be read {passes:.0f} times, over {MAX_PASSES}: set max_repeats or a smaller budget")
    weight = F.when(F.col("total") > 0, F.pow(F.col("total") / F.lit(total or 1.0), F.lit(exponent)) / F.lit(norm)).otherwise(0.0)
    plan = totals.withColumn("weight", weight).withColumn("full", F.when(F.col("total") > 0, F.floor(F.lit(budget) * F.col("weight") / F.col("total"))).otherwise(0))
    plan = plan.select(F.col("source").alias("of"), "weight", "full", (F.lit(budget) * F.col("weight") - F.col("full") * F.col("total")).alias("rest"))
    every = by_block.join(plan, F.col("source").eqNullSafe(F.col("of"))).select("source", "block", "tokens", "full", "rest", "weight")
    every = every.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full").cast("int"))))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("")), "epoch", "block", F.lit(seed)), "block")
    every = every.withColumn("block_rank", F.row_number().over(order)).withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))
    taken = every.where("weight > 0").where((F.col("epoch") < F.col("full")) | (F.col("before") + F.col("tokens") / 2 <= F.col("rest")))
    taken = taken.select(F.col("source").alias("of"), F.col("block").alias("in"), "epoch", "block_rank", F.round("weight", 9).alias("weight"))
    read = counted.join(taken, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in")))
    return read.select(*(F.col("row").getField(c).alias(c) for c in own), "n_tokens", "epoch", "block", "block_rank", "weight")


def report(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source"))
