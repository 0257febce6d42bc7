"""Ordered-subsequence conformance of runs of steps to golden paths, and known hazards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signature(action: Column, target: Column) -> Column:
    """kind/class of a step; a missing class is `none`, a missing kind cannot be evaluated (null)."""
    return F.when(action.isNotNull(), F.concat_ws("/", action, F.coalesce(target, F.lit("none"))))


def runs(steps: DataFrame) -> DataFrame:
    """(run_id, sigs): each run's signatures in order of step; one row a run."""
    one = F.struct("step", signature(F.col("action_kind"), F.col("target_class")).alias("sig"))
    return steps.groupBy("run_id").agg(F.array_sort(F.collect_list(one)).alias("steps")).select("run_id", F.transform("steps", lambda s: s["sig"]).alias("sigs"))


def conformance(sigs: Column, pattern: list[str]) -> Column:
    """struct<matched, last>: greedy in-order matching of the pattern; last is the 0-based step that matched last."""
    want = F.array(*map(F.lit, pattern)) if pattern else F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("matched"), F.lit(-1).alias("last"), F.lit(0).alias("at"))

    def step(s: Column, sig: Column) -> Column:
        hit = (s["matched"] < len(pattern)) & F.coalesce(sig == F.try_element_at(want, s["matched"] + 1), F.lit(False))
        return F.struct((s["matched"] + hit.cast("int")).alias("matched"), F.when(hit, s["at"]).otherwise(s["last"]).alias("last"), (s["at"] + 1).alias("at"))

    return F.aggregate(sigs, start, step, lambda s: F.struct(s["matched"].alias("matched"), F.when(s["last"] >= 0, s["last"]).alias("last")))


def hazards(steps: DataFrame, dead_ends: DataFrame) -> DataFrame:
    """(run_id, step, sig, note): steps on a known dead end (sig, note, ordinal); the first note counts."""
    notes = dead_ends.groupBy("sig").agg(F.min_by("note", "ordinal").alias("note"))
    return steps.select("run_id", "step", signature(F.col("action_kind"), F.col("target_class")).alias("sig")).join(notes, "sig").select("run_id", "step", "sig", "note")


def check(steps: DataFrame, paths: list[dict], follows: str, grammar: str, mode: str = "plan", deny_opt_in: bool = False) -> DataFrame:
    """(run_id, outcome, effect, matched, deviation, last, unevaluated, hazards, reason): each run against the path that it follows, of
    paths {path, grammar, pattern, level, dead_ends: [(sig, note)]}. No paths, an unknown one and another grammar refuse.

    Steps without a kind neither match nor deviate: they are listed in unevaluated. hazards are (step, note) of steps on a
    dead end, the first note of each. deviation is the pattern index that found no step and last the step matched before it:
    only a whole plan (mode `plan`) has them, a run in progress never deviates. A deviation from a blessed path denies where that is opted in;
    any other deviation and any hazard warn."""
    rows = runs(steps)
    path = next((p for p in paths if p["path"] == follows), None)
    held = "array<struct<step:int,note:string>>"
    if path is None or path["grammar"] != grammar:
        reason = "empty registry" if not paths else "unknown path" if path is None else "other grammar"
        nulls = [F.lit(None).cast("int").alias(c) for c in ("matched", "deviation", "last")]
        return rows.select("run_id", F.lit("refused").alias("outcome"), F.lit(None).cast("string").alias("effect"), *nulls, F.array().cast("array<int>").alias("unevaluated"), F.array().cast(held).alias("hazards"), F.lit(reason).alias("reason"))
    want, notes = path["pattern"], {}
    for sig, note in path.get("dead_ends", []):
        notes.setdefault(sig, note)
    each = F.transform("sigs", lambda s, i: F.struct(s.alias("sig"), i.cast("int").alias("step")))
    note_of = F.create_map(*(F.lit(x) for kv in notes.items() for x in kv)) if notes else F.create_map().cast("map<string,string>")
    found = rows.withColumn("m", conformance(F.col("sigs"), want))
    found = found.withColumn("unevaluated", F.transform(F.filter(each, lambda x: x.sig.isNull()), lambda x: x.step))
    found = found.withColumn("hazards", F.transform(F.filter(each, lambda x: x.sig.isin(*notes)), lambda x: F.struct(x.step.alias("step"), note_of[x.sig].alias("note"))).cast(held))
    off = (F.col("m.matched") < len(want)) if mode == "plan" else F.lit(False)
    strong = path.get("level") == "blessed" and deny_opt_in
    effect = F.when(off, "deny" if strong else "warn").when(F.size("hazards") > 0, "warn").otherwise("none")
    return found.select(
        "run_id", F.lit("evaluated").alias("outcome"), effect.alias("effect"), F.col("m.matched").alias("matched"), F.when(off, F.col("m.matched")).alias("deviation"),
        F.when(off, F.col("m.last")).alias("last"), "unevaluated", "hazards", F.lit(None).cast("string").alias("reason"),
    )
