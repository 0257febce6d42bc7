"""Verification of proposed buffers: what an edit brings in that the tree cannot resolve.

Only what syntax alone decides is reported, and only what the edit introduces: free calls of
names that nothing defines, free calls with another arity than the one definition in the buffer,
and `mod x;` without a file. Method calls, calls through a path, generic calls, macros and
constructors (names that begin with a capital) are left unchecked. Buffers are parsed one by one
in mapInPandas; names and files are resolved by joins.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import language

UNCHECKED = ("types", "method calls", "calls through a path", "use paths")
_OPEN, _CLOSE = "([{", ")]}"
_LITERAL = re.compile(r"""r(#*)".*?"\1|b?"(?:[^"\\]|\\.)*"|'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.)|[^\\'\n])'""", re.S)
_SKIP = re.compile(rf"//[^\n]*|/\*.*?\*/|{_LITERAL.pattern}", re.S)
_CALL = re.compile(r"(?<![\w!])([a-z_]\w*)\s*\(")
_FN = re.compile(r"\bfn\s+([A-Za-z_]\w*)")
_WORD = re.compile(r"[A-Za-z_]\w*")
_NOT_CALLED = set("if while match for return in loop move else unsafe as fn let impl where pub dyn ref mut await break use".split())


def _bare(source: str) -> str:
    """Comments as blanks, literals as digits of the same length: offsets and lines stay, arguments still count."""

    def fill(m: re.Match) -> str:
        mark = " " if m[0].startswith("/") else "0"
        return re.sub(r"[^\n]", mark, m[0])

    return _SKIP.sub(fill, source)


def _closing(text: str, at: int) -> int:
    """Where the bracket at `at` closes; the end of the text if it does not."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(text, at):
        depth += 1 if m[0] in _OPEN else -1
        if depth == 0:
            return m.start()
    return len(text)


def _without(text: str, opening: str) -> str:
    """The text with what `opening` (a pattern that ends in a bracket) starts blanked up to its closing bracket."""
    out, at = [], 0
    for m in re.finditer(opening, text):
        if m.start() < at:
            continue
        end = _closing(text, m.end() - 1) + 1
        out += [text[at : m.start()], re.sub(r"[^\n]", " ", text[m.start() : end])]
        at = end
    return "".join(out) + text[at:]


def _pieces(text: str, types: bool = False) -> list[str]:
    """What top-level commas part. Angle brackets nest in types, and after :: elsewhere; closure parameters stay whole."""
    out, depth, angle, start, i = [], 0, 0, 0, 0
    while i < len(text):
        c = text[i]
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
        elif c == "<" and (types or angle or text[max(i - 2, 0) : i] == "::"):
            angle += 1
        elif c == ">" and angle and text[i - 1] != "-":
            angle -= 1
        elif c == "|" and depth == 0 and not types and text[start:i].strip() in ("", "move"):
            end = text.find("|", i + 1)
            i = end if end >= 0 else len(text)
        elif c == "," and depth == 0 and angle == 0:
            out.append(text[start:i])
            start = i + 1
        i += 1
    return [p for p in [*out, text[start:]] if p.strip()]


def analyze(source: str) -> dict:
    """functions (name, params, takes_self, line), calls (name, form, arity, line), modules and bound names of a Rust
    buffer. A broken buffer gives what can be read of it."""
    text = _bare(source)
    text = _without(_without(text, r"#!?\s*\["), r"\w!\s*\w*\s*[(\[{]")
    line = lambda i: text.count("\n", 0, i) + 1
    functions, calls, bound, defined = [], [], set(), set()
    for m in _FN.finditer(text):
        at = re.compile(r"\s*(?:<[^({]*>)?\s*\(").match(text, m.end())
        defined.add(m.start(1))
        if not at:
            continue
        given = _pieces(text[at.end() : _closing(text, at.end() - 1)], types=True)
        own = bool(given) and re.match(r"\s*(?:&\s*(?:'\w+\s*)?)?(?:mut\s+)?self\b", given[0]) is not None
        functions.append({"name": m[1], "params": len(given), "takes_self": own, "line": line(m.start())})
        for p in given[own:]:
            bound.update(_WORD.findall(p.split(":")[0]))
    for m in re.finditer(r"\blet\b(.*?)(?:(?<![=!<>])=(?!=)|;|\belse\b)", text, re.S):
        bound.update(_WORD.findall(re.sub(r"(?<!:):(?!:).*", "", m[1], flags=re.S)))
    for m in re.finditer(r"\buse\b([^;]*);", text):
        bound.update(_WORD.findall(m[1]))
    for m in _CALL.finditer(text):
        if m[1] in _NOT_CALLED or m.start(1) in defined:
            continue
        before = text[max(m.start() - 80, 0) : m.start()].rstrip()[-2:]
        form = "path" if before == "::" else "method" if before.endswith(".") and before != ".." else "free"
        calls.append({"name": m[1], "form": form, "arity": len(_pieces(text[m.end() : _closing(text, m.end() - 1)])), "line": line(m.start())})
    modules = re.findall(r"\bmod\s+([A-Za-z_]\w*)\s*;", text)
    return {"functions": functions, "calls": calls, "modules": modules, "bound": sorted(bound - _NOT_CALLED)}


def introduced(proposed: str, baseline: str | None) -> list[tuple]:
    """(check, symbol, line, arity, params) that the tree has to settle, or that the buffer already settles as wrong."""
    now = analyze(proposed)
    old = {(c["name"], c["arity"]) for c in analyze(baseline)["calls"]} if baseline is not None else set()
    bound, out = set(now["bound"]), [("module", m, 0, None, None) for m in now["modules"]]
    own: dict[str, list[dict]] = {}
    for f in now["functions"]:
        own.setdefault(f["name"], []).append(f)
    for c in now["calls"]:
        if c["form"] != "free" or (c["name"], c["arity"]) in old or c["name"] in bound:
            continue
        defs = own.get(c["name"])
        if defs is None:
            out.append(("name", c["name"], c["line"], c["arity"], None))
        elif len(defs) == 1 and not defs[0]["takes_self"] and defs[0]["params"] != c["arity"]:
            out.append(("arity", c["name"], c["line"], c["arity"], defs[0]["params"]))
    return out


def violations(edits: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(key, rel, kind, symbol, line) of edits (key, rel, proposed, baseline or null), against the names of symbols
    (name) and files (rel). Files of other languages than Rust, and null buffers, have none."""
    key = dict(edits.dtypes)["key"]

    def run(batches):
        for pdf in batches:
            rows = [(k, rel, *found) for k, rel, new, old in zip(pdf["key"], pdf["rel"], pdf["proposed"], pdf["baseline"]) for found in introduced(new, None if pd.isna(old) else old)]
            out = pd.DataFrame(rows, columns=["key", "rel", "check", "symbol", "line", "arity", "params"])
            yield out.astype({"line": "int32", "arity": "Int32", "params": "Int32"})

    rust = edits.where((language(F.col("rel")) == "rust") & F.col("proposed").isNotNull())
    found = rust.select("key", "rel", "proposed", "baseline").mapInPandas(run, f"key {key}, rel string, check string, symbol string, line int, arity int, params int")
    known = symbols.select(F.col("name").alias("symbol"), F.lit("name").alias("check")).distinct()
    folder = F.regexp_extract("rel", r"^(.*/)?[^/]*$", 1)
    beside = files.select(F.regexp_extract("rel", r"^(.*?)([^/]+?)(?:/mod)?\.rs$", 1).alias("_folder"), F.regexp_extract("rel", r"^(.*?)([^/]+?)(?:/mod)?\.rs$", 2).alias("symbol"), F.lit("module").alias("check")).distinct()
    open_ = found.join(known, ["symbol", "check"], "left_anti").withColumn("_folder", folder).join(beside, ["_folder", "symbol", "check"], "left_anti")
    kind = F.when(F.col("check") == "name", "identifier-does-not-exist").when(F.col("check") == "arity", "wrong-arity").otherwise("unresolved-import")
    return open_.select("key", "rel", kind.alias("kind"), "symbol", "line")


def verdicts(edits: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(key, rel, ok, violations): one row an edit; violations are (line, symbol, kind) in that order."""
    bad = violations(edits, symbols, files).groupBy("key", "rel").agg(F.array_sort(F.collect_list(F.struct("line", "symbol", "kind"))).alias("violations"))
    out = edits.select("key", "rel").join(bad, ["key", "rel"], "left")
    return out.select("key", "rel", F.col("violations").isNull().alias("ok"), F.coalesce("violations", F.array().cast("array<struct<line:int,symbol:string,kind:string>>")).alias("violations"))
