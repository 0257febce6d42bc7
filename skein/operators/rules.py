"""Rule planes: globs and scopes, text rules, token grounding, ceilings and decisions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class RuleError(ValueError):
    """A rule that cannot be compiled, and why."""


def glob_regex(glob: str) -> str:
    """An anchored regex of a path glob: * within a segment, ** across segments, ? and [..]; p/** also covers p/*."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise RuleError(f"unclosed class in glob {glob!r}")
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def glob_errors(globs: list[str]) -> list[tuple[str, str]]:
    bad = []
    for g in globs:
        try:
            re.compile(glob_regex(g))
        except (RuleError, re.error) as e:
            bad.append((g, str(e)))
    return bad


def any_glob(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def in_scope(path: Column, allow: list[str], deny: list[str]) -> Column:
    """deny wins; an empty allow list allows all."""
    return ~any_glob(path, deny) & (any_glob(path, allow) if allow else F.lit(True))


def scope_decision(path: Column, allow: list[str], deny: list[str]) -> Column:
    return F.when(any_glob(path, deny), "denied").when(F.lit(not allow) | any_glob(path, allow), "allowed").otherwise("outside")


def ceiling(symbols: Column, files: Column, max_symbols: int | None, max_files: int | None) -> Column:
    """The rule ids that a radius breaks, joined by +; empty for none."""
    parts = []
    if max_symbols is not None:
        parts.append(F.when(symbols > max_symbols, "max-symbols"))
    if max_files is not None:
        parts.append(F.when(files > max_files, "max-files"))
    return F.concat_ws("+", *parts) if parts else F.lit("")


_UNSAFE = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]")


def compile_pattern(pattern: str) -> str:
    """The pattern, if it keeps to what linear-time engines allow: no look-around, no back references."""
    if _UNSAFE.search(pattern):
        raise RuleError("look-around and back references are not allowed")
    try:
        re.compile(pattern)
    except re.error as e:
        raise RuleError(str(e)) from e
    return pattern


def compile_errors(patterns: list[str]) -> list[tuple[str, str]]:
    bad = []
    for p in patterns:
        try:
            compile_pattern(p)
        except RuleError as e:
            bad.append((p, str(e)))
    return bad


def text_rule(text: Column, pattern: str) -> Column:
    """Distinct tokens of all matches, in the order first seen."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(compile_pattern(pattern)), F.lit(0)))


def text_findings(texts: DataFrame, rules: list[dict], path: str, text: str) -> DataFrame:
    """texts' key columns x rules that match: rule, tokens, n_tokens and blocking.

    A rule is name, pattern, tier (block or warn) and an optional exempt path regex; a block
    rule blocks only where `exposure`, if texts has it, is public."""
    public = F.coalesce(F.col("exposure"), F.lit("unknown")) == "public" if "exposure" in texts.columns else F.lit(True)
    found = []
    for r in rules:
        live = ~F.col(path).rlike(r["exempt"]) if r.get("exempt") else F.lit(True)
        found.append(F.struct(F.lit(r["name"]).alias("rule"), F.when(live, text_rule(F.col(text), r["pattern"])).otherwise(F.array().cast("array<string>")).alias("tokens"), (F.lit(r.get("tier", "warn") == "block") & public).alias("blocking")))
    out = texts.withColumn("_f", F.explode(F.array(*found))).select(*(c for c in texts.columns if c != text), "_f.rule", "_f.tokens", F.size("_f.tokens").alias("n_tokens"), "_f.blocking")
    return out.where("n_tokens > 0")


def must_exist(rows: DataFrame, by: str, text: str, pattern: str) -> DataFrame:
    """Groups of which no row matches."""
    return rows.groupBy(by).agg(F.bool_or(F.coalesce(F.col(text), F.lit("")).rlike(compile_pattern(pattern))).alias("hit"), F.count(F.lit(1)).alias("rows"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9_-]+"), F.lit(0))


def id_prefix(identifier: Column) -> Column:
    """What stands before the last hyphen; empty without one."""
    return F.regexp_extract(identifier, r"^(.*)-[^-]*$", 1)


def ground(texts: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, outcome): grounded tokens are known ids, fabricated ones only share an id's prefix and have a suffix."""
    known = ids.select(F.col("id").alias("token"), F.lit(True).alias("_id")).distinct()
    prefixes = ids.select(id_prefix(F.col("id")).alias("_p")).where("_p <> ''").distinct().withColumn("_pre", F.lit(True))
    found = texts.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))
    found = found.withColumn("_p", F.regexp_extract("token", r"^(.*)-[^-]+$", 1))
    out = found.join(known, "token", "left").join(prefixes, "_p", "left")
    return out.select(key, "token", F.when(F.col("_id"), "grounded").when(F.col("_pre"), "fabricated").otherwise("unrelated").alias("outcome"))


def grounding_rules(texts: DataFrame, found: DataFrame, key: str, direction: str) -> DataFrame:
    """(key, outcome): must-ground breaches have no grounded token, must-not-ground ones have one; fabricated ids are their own."""
    per = found.groupBy(key).agg(F.sum((F.col("outcome") == "grounded").cast("long")).alias("g"), F.sum((F.col("outcome") == "fabricated").cast("long")).alias("f"))
    out = texts.select(key).join(per, key, "left").fillna(0, ["g", "f"])
    breach = F.col("g") == 0 if direction == "must-ground" else F.col("g") > 0
    return out.select(key, F.when(F.col("f") > 0, "fabricated").when(breach, "breach").otherwise("ok").alias("outcome"))


def scope_ladder(requests: DataFrame, declared: DataFrame, parents: DataFrame, observed: DataFrame) -> DataFrame:
    """requests (item, path) with rung and inside: the item's declared paths, else its parent's, else those seen, else unknown.

    declared and observed are (item, path); parents (item, parent, ordinal), the first parent
    counts. Only a declared scope decides; the others advise."""
    first = parents.groupBy("item").agg(F.min_by("parent", "ordinal").alias("parent"))
    sets = lambda rows, name: rows.groupBy("item").agg(F.array_sort(F.collect_set("path")).alias(name))
    out = requests.join(first, "item", "left").join(sets(declared, "own"), "item", "left").join(sets(declared, "up").withColumnRenamed("item", "parent"), "parent", "left").join(sets(observed, "seen"), "item", "left")
    rung = F.when(F.col("own").isNotNull(), "declared").when(F.col("up").isNotNull(), "derived").when(F.col("seen").isNotNull(), "observed").otherwise("unknown")
    paths = F.coalesce("own", "up", "seen")
    return out.select("item", "path", rung.alias("rung"), F.coalesce(F.array_contains(paths, F.col("path")), F.lit(False)).alias("inside"), (rung == "declared").alias("decides"))


# Classes, effects, points and layers of governed rules, and the modes from weak to strong.
CLASSES = ("hard", "soft", "escalation")
BLOCKING_CLASSES = ("hard", "escalation")
QUIET_EFFECTS = ("warn", "record", "allow", "throttle")
POINTS = ("PAG", "ATM", "PAA", "tool_layer", "policy_layer")
BEFORE_EDIT = "PAG"
LAYERS = ("orchestration", "tool", "policy")
HOOK_LAYER = "orchestration"
MODES = ("off", "advise", "enforce")


def blocks(class_: Column, effect: Column, mode: Column, point: Column | None = None) -> Column:
    """Does a rule block an edit: only under enforce, by its class, or where that is not declared by its effect; an effect that
    is not known blocks, the careful direction. A rule declared for another point than before the edit does not fire here."""
    wants = F.when(F.coalesce(class_.isin(*CLASSES), F.lit(False)), class_.isin(*BLOCKING_CLASSES)).otherwise(F.coalesce(~effect.isin(*QUIET_EFFECTS), F.lit(True)))
    here = F.lit(True) if point is None else before_edit(point)
    return wants & here & F.coalesce(mode == "enforce", F.lit(False))


def before_edit(point: Column) -> Column:
    """Rules without a declared point, or with one that is not known, fire before the edit too."""
    return F.coalesce(~point.isin(*POINTS) | (point == BEFORE_EDIT), F.lit(True))


def overclaim(declared: Column, actual: Column | None = None) -> Column:
    """A rule said to be held at a stronger layer than it is; unknown layers claim nothing."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, LAYERS)), c)
    actual = F.lit(HOOK_LAYER) if actual is None else actual
    return F.coalesce((rank(declared) > 0) & (rank(actual) > 0) & (rank(declared) > rank(actual)), F.lit(False))


def outcome(mode: Column, rung: Column) -> Column:
    """The weaker of mode and what the rung allows; a mode that is not known is off."""
    rank = lambda c: F.when(c == "enforce", 2).when(c == "advise", 1).otherwise(0)
    cap = F.when(rung == "declared", 2).when(rung.isin("derived", "observed"), 1).otherwise(0)
    return F.element_at(F.array(*map(F.lit, MODES)), F.least(rank(mode), cap) + 1)


def first_decision(findings: DataFrame, key: str, plane: str, rule: str) -> DataFrame:
    """One row a key: the earliest plane's blocking finding decides, else its first advice; all rule ids joined by +."""
    w = Window.partitionBy(key).orderBy(F.desc("blocking"), plane, rule)
    ids = findings.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(rule)), "+").alias("rules"))
    return findings.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").join(ids, key)


def rule_digest(rules: DataFrame, column: str) -> DataFrame:
    """One row: sha256 over the sorted values joined by the record separator."""
    return rules.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(column)), "\x1e"), 256).alias("digest"))


def draft(text: str, name: str = "draft") -> dict:
    """A rule drafted from an example: its distinct tokens, and a pattern of their shapes to narrow by hand."""
    found = list(dict.fromkeys(re.findall(r"[A-Za-z0-9_-]+", text)))
    return {"name": name, "tokens": found, "pattern": narrowing_pattern(found), "tier": "warn"}


def narrowing_pattern(tokens_: list[str]) -> str:
    """A regex of the tokens' shapes: letter runs, digit runs and what stands between, each between word ends."""
    shapes = []
    for t in tokens_:
        shape = "".join("[A-Za-z]+" if p[0].isalpha() else "[0-9]+" if p[0].isdigit() else re.escape(p) for p in re.findall(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]", t))
        shapes.append(rf"\b{shape}\b")
    return "|".join(dict.fromkeys(shapes))
