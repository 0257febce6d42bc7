"""Ignore rules of a tree as joins: rule files compiled to rows, paths met with the rules of the folders above them.

A rule file's line is a row (folder, rank, regex, negated, folders_only). Each folder and file of the tree is met
with the rules of all folders above it, and the last rule that matches decides: those of deeper folders after those
of higher ones, `.ignore` after `.gitignore` after `.git/info/exclude`, later lines after earlier ones. A path goes if it or any folder above it is
ignored: what lies in an ignored folder cannot be taken back. Hidden names are ignored unless a rule takes them back.

Folders are judged once, however many files they hold. Blank lines and comments are no rules; a
line that cannot be compiled matches nothing.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_FILES = {".git/info/exclude": 0, ".gitignore": 1, ".ignore": 2}  # fixed values: weaker ones first
_RULE = "struct<regex:string,negated:boolean,folders_only:boolean>"


def compiled(line: str) -> tuple[str, bool, bool] | None:
    """(regex over a path below the rule's folder, negated, folders only) of one line, or None."""
    text = line.rstrip("\r\n")
    while text.endswith(" ") and not text.endswith("\\ "):
        text = text[:-1]
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    folders = text.endswith("/")
    text = text.rstrip("/") if folders else text
    anchored = "/" in text
    text = text.removeprefix("/")
    if not text:
        return None
    out, i = "", 0
    while i < len(text):
        if text.startswith("**/", i) and (i == 0 or text[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif text[i:] == "**" and i and text[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif text[i] == "*":
            while text[i : i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif text[i] == "?":
            out, i = out + "[^/]", i + 1
        elif text[i] == "[":
            end = text.find("]", i + 2 + (text[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                return None
            body = text[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + "(?!/)[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif text[i] == "\\" and i + 1 < len(text):
            out, i = out + re.escape(text[i + 1]), i + 2
        else:
            out, i = out + re.escape(text[i]), i + 1
    regex = f"^{'' if anchored else '(?:.*/)?'}{out}$"
    try:
        re.compile(regex)
    except re.error:
        return None
    return regex, negated, folders


def rules_of(files: DataFrame) -> DataFrame:
    """(folder, strength, rank, regex, negated, folders_only) of the rule files among files (rel, source)."""

    def compile_all(lines: pd.Series) -> pd.DataFrame:
        made = [compiled(x) or (None, None, None) for x in lines]
        return pd.DataFrame(made, columns=["regex", "negated", "folders_only"])

    kind = F.coalesce(*(F.when((F.col("rel") == n) | (F.col("rel").endswith(f"/{n}") if "/" not in n else F.lit(False)), F.lit(n)) for n in RULE_FILES))
    own = files.withColumn("kind", kind).where(F.col("kind").isNotNull() & F.col("source").isNotNull())
    folder = F.when(F.col("kind") == ".git/info/exclude", "").otherwise(F.regexp_replace("rel", "/?[^/]*$", ""))
    strength = F.coalesce(*(F.when(F.col("kind") == n, F.lit(s)) for n, s in RULE_FILES.items()))
    lines = own.select(folder.alias("folder"), strength.alias("strength"), F.posexplode(F.split("source", "\n")).alias("rank", "line"))
    return lines.select("folder", "strength", "rank", F.pandas_udf(compile_all, _RULE)("line").alias("r")).where("r.regex IS NOT NULL").select("folder", "strength", "rank", "r.*")


def no_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "folder string, strength int, rank int, regex string, negated boolean, folders_only boolean")


def above(path: Column) -> Column:
    """The folders above a path, the root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ignored(paths: DataFrame, rules: DataFrame, hidden: bool = True) -> DataFrame:
    """paths (rel, ...) plus ignored. hidden: names that begin with a dot are ignored unless a rule takes them back."""
    names = paths.select("rel").distinct()
    chain = names.select("rel", F.explode(F.concat(F.filter(above(F.col("rel")), lambda f: f != ""), F.array("rel"))).alias("path")).withColumn("folder_like", F.col("path") != F.col("rel"))
    things = chain.select("path", "folder_like").distinct()
    asked = things.withColumn("folder", F.explode(above(F.col("path"))))
    below = F.expr("substring(path, length(folder) + CASE WHEN folder = '' THEN 1 ELSE 2 END)")
    met = asked.join(rules, "folder").where((F.col("folder_like") | ~F.col("folders_only")) & F.regexp_like(below, F.col("regex")))
    decided = met.groupBy("path", "folder_like").agg(F.max_by(~F.col("negated"), F.struct(F.length("folder"), "strength", "rank")).alias("said"))
    dotted = F.lit(hidden) & F.substring_index("path", "/", -1).startswith(".")
    judged = things.join(decided, ["path", "folder_like"], "left").select("path", "folder_like", F.coalesce("said", dotted).alias("gone"))
    out = chain.join(judged, ["path", "folder_like"]).groupBy("rel").agg(F.bool_or("gone").alias("ignored"))
    return paths.join(out, "rel")


def kept(files: DataFrame, hidden: bool = True) -> DataFrame:
    """Files (rel, source, ...) of a tree without those that its own rule files ignore."""
    return ignored(files, rules_of(files), hidden).where(~F.col("ignored")).drop("ignored")
