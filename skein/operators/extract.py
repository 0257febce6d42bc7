"""Symbols, calls and imports from source text; buffer checks and local data flow.

Python goes through its own parser. The other languages go through small lexer recipes:
comments and strings are blanked, declarations found by pattern, and bodies by matching
braces. They cover the usual declaration forms, not the full grammars, so facts carry the
tier `lexer` (Python: `ast`). Parsing is per file and has no shared state, so it is a
mapInPandas over files; equal contents are parsed once.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STRING = {"rust": r'r?"(?:[^"\\]|\\.)*"', "go": r'"(?:[^"\\\n]|\\.)*"|`[^`]*`', "typescript": r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`', "java": r'"(?:[^"\\\n]|\\.)*"', "cpp": r'"(?:[^"\\\n]|\\.)*"'}
_STRING["tsx"] = _STRING["typescript"]
_NAME = r"([A-Za-z_$][\w$]*)"
DECLS: dict[str, list[tuple[str, str]]] = {
    "rust": [("function", rf"\bfn\s+{_NAME}"), ("struct", rf"\bstruct\s+{_NAME}"), ("union", rf"\bunion\s+{_NAME}\s*[{{<]"), ("enum", rf"\benum\s+{_NAME}"), ("trait", rf"\btrait\s+{_NAME}"), ("module", rf"\bmod\s+{_NAME}"), ("constant", rf"\bconst\s+{_NAME}\s*:"), ("static", rf"\bstatic\s+(?:mut\s+)?{_NAME}\s*:"), ("type", rf"\btype\s+{_NAME}")],
    "go": [("function", rf"\bfunc\s+{_NAME}\s*[(\[]"), ("method", rf"\bfunc\s*\([^)]*\)\s*{_NAME}\s*\("), ("struct", rf"\btype\s+{_NAME}\s+struct\b"), ("interface", rf"\btype\s+{_NAME}\s+interface\b"), ("type", rf"\btype\s+{_NAME}\s*=?\s*(?!struct|interface)[A-Za-z\[*]")],
    "typescript": [("function", rf"\bfunction\s*\*?\s*{_NAME}"), ("class", rf"\bclass\s+{_NAME}"), ("interface", rf"\binterface\s+{_NAME}"), ("enum", rf"\benum\s+{_NAME}"), ("type", rf"\btype\s+{_NAME}\s*(?:<[^=]*>)?\s*="), ("method", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*{_NAME}\s*\([^()]*\)\s*(?::\s*[^{{;=]+)?\{{")],
    "java": [("class", rf"\b(?:class|record)\s+{_NAME}"), ("interface", rf"\binterface\s+{_NAME}"), ("enum", rf"\benum\s+{_NAME}"), ("method", rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\],.?]+\s+{_NAME}\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?\{{"), ("constructor", rf"^[ \t]*(?:(?:public|private|protected)\s+)?([A-Z]\w*)\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?\{{")],
    "cpp": [("function", rf"^[ \t]*(?:[\w:<>*&~]+\s+[*&]*)+(?:[\w]+::)*{_NAME}\s*\([^()]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{{"), ("struct", rf"\bstruct\s+{_NAME}\s*[:{{]"), ("class", rf"(?<!enum )\bclass\s+{_NAME}\s*[:{{]"), ("union", rf"\bunion\s+{_NAME}\s*\{{"), ("enum", rf"\benum\s+(?:class\s+|struct\s+)?{_NAME}"), ("namespace", rf"\bnamespace\s+{_NAME}"), ("type", rf"\btypedef\b[^;]*?\b{_NAME}\s*;")],
}
DECLS["tsx"] = DECLS["typescript"]
_KEYWORDS = set("if for while switch match return fn func function catch sizeof new else loop do super this self await defer go throw typeof import assert synchronized".split())
# (the clause that names modules, what of it counts, words that are no names): identifiers of dotted paths, or the quoted path as it is
_IMPORTS = {
    "rust": (r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:use\s+|mod\s+(?=\w+\s*;))([^;]+);", r"[A-Za-z_]\w*", {"crate", "self", "super", "as"}),
    "go": (r'^\s*(?:import\s+(?:[\w.]+\s+)?|\s+(?:[\w.]+\s+)?)"([^"\n]+)"', r".+", set()),
    "typescript": (r"""^\s*import\b[^'";(]*['"]([^'"\n]+)['"]""", r".+", set()),
    "java": (r"^\s*import\s+(?:static\s+)?([\w.]+)", r"[A-Za-z_$][\w$]*", set()),
    "cpp": (r'^\s*#\s*include\s*[<"]([^>"\n]+)[>"]', r".+", set()),
}
_IMPORTS["tsx"] = _IMPORTS["typescript"]


@dataclass
class Facts:
    symbols: list[dict]
    calls: list[dict]
    imports: list[str]
    tier: str


def blanked(source: str, language: str, strings: bool = True) -> str:
    """Comments (and strings) replaced by blanks, line ends kept."""
    parts = [r"//[^\n]*", r"/\*.*?\*/"] + ([_STRING[language]] if strings else [])
    keep = "" if strings else _STRING[language] + "|"
    return re.sub(keep and f"({keep[:-1]})|" + "|".join(parts) or "|".join(parts), lambda m: m[0] if keep and m[1] else re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def body_end(text: str, at: int) -> int:
    """Where the declaration at `at` ends: its matching brace, or the first ; before any brace."""
    depth = 0
    for i in range(at, len(text)):
        c = text[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i
        elif c == ";" and depth == 0:
            return i
    return len(text) - 1


def lexed(source: str, language: str) -> Facts:
    text = blanked(source, language)
    found = []
    for kind, pattern in DECLS[language]:
        for m in re.finditer(pattern, text, re.M):
            if m[1] not in _KEYWORDS:
                found.append((m.start(1), body_end(text, m.end(1)), kind, m[1]))
    found = sorted({f[0]: f for f in reversed(found)}.values())
    line = lambda i: text.count("\n", 0, i) + 1
    symbols, spans = [], []
    for at, end, kind, name in found:
        scope = [s[3] for s in found if s[0] < at and end <= s[1] and s is not None]
        if language == "go" and kind == "method":
            r = re.search(r"func\s*\(\s*\w*\s*\*?\s*(\w+)[^)]*\)\s*$", text[:at])
            scope = [r[1]] if r else scope
        symbols.append({"name": name, "scope": scope, "kind": kind, "start_line": line(at), "end_line": line(end)})
        if kind in ("function", "method", "constructor"):
            spans.append((at, end, name))
    declared = {s[0] for s in found}
    calls = []
    for m in re.finditer(rf"{_NAME}\s*(?:::<[^>]*>)?\(", text):
        if m.start(1) in declared or m[1] in _KEYWORDS:
            continue
        inside = [s for s in spans if s[0] < m.start() <= s[1]]
        if inside:
            calls.append({"caller": max(inside)[2], "callee": m[1], "line": line(m.start())})
    pattern, word, drop = _IMPORTS[language]
    refs = set()
    for m in re.finditer(pattern, blanked(source, language, strings=False), re.M):
        refs |= {w for w in re.findall(word, m[1]) if w not in drop}
    return Facts(symbols, calls, sorted(refs), "lexer")


def python_facts(source: str) -> Facts:
    tree = ast.parse(source)
    symbols, calls, refs = [], [], set()

    def callee(node):
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None

    def walk(node, scope, owner):
        for child in ast.iter_child_nodes(node):
            here, who = scope, owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                symbols.append({"name": child.name, "scope": scope, "kind": kind, "start_line": child.lineno, "end_line": child.end_lineno})
                here, who = [*scope, child.name], child.name if kind != "class" else owner
            elif isinstance(child, ast.Call) and owner and callee(child.func):
                calls.append({"caller": owner, "callee": callee(child.func), "line": child.lineno})
            elif isinstance(child, ast.Import):
                refs.update(p for a in child.names for p in [*a.name.split("."), *([a.asname] if a.asname else [])])
            elif isinstance(child, ast.ImportFrom):
                refs.update(p for p in (child.module or "").split(".") if p)
                refs.update(n for a in child.names for n in (a.name, a.asname) if n and n != "*")
            walk(child, here, who)

    walk(tree, [], None)
    return Facts(symbols, calls, sorted(refs), "ast")


def facts(source: str | None, language: str | None) -> Facts | None:
    """None where the language is unknown or the source cannot be read."""
    if source is None or language is None:
        return None
    try:
        return python_facts(source) if language == "python" else lexed(source, language) if language in DECLS else None
    except (SyntaxError, ValueError, RecursionError):
        return None


SCHEMA = (
    "hash string, language string, tier string, parsed boolean, symbols array<struct<name:string,scope:array<string>,kind:string,start_line:int,end_line:int>>, "
    "calls array<struct<caller:string,callee:string,line:int>>, imports array<string>"
)


def structures(files: DataFrame) -> DataFrame:
    """(rel, language, hash, tier, parsed, symbols, calls, imports) of files (rel, source, language); equal contents are parsed once."""
    keyed = files.withColumn("hash", F.sha2(F.encode(F.coalesce("source", F.lit("")), "utf-8"), 256))

    def run(batches):
        for pdf in batches:
            rows = []
            for h, language, source in zip(pdf["hash"], pdf["language"], pdf["source"]):
                f = facts(source, language)
                rows.append((h, language, f.tier if f else None, f is not None, f.symbols if f else [], f.calls if f else [], f.imports if f else []))
            yield pd.DataFrame(rows, columns=["hash", "language", "tier", "parsed", "symbols", "calls", "imports"])

    once = keyed.select("hash", "language", "source").dropDuplicates(["hash", "language"]).mapInPandas(run, SCHEMA).withColumnsRenamed({"hash": "_h", "language": "_l"})
    found = keyed.select("rel", "language", "hash").join(once, (F.col("hash") == F.col("_h")) & F.col("language").eqNullSafe(F.col("_l")))
    return found.select("rel", "language", "hash", "tier", "parsed", "symbols", "calls", "imports")


def symbols(files: DataFrame) -> DataFrame:
    """(rel, language, tier, name, scope, kind, start_line, end_line)."""
    return structures(files).select("rel", "language", "tier", F.explode("symbols").alias("s")).select("rel", "language", "tier", "s.*")


def calls(files: DataFrame) -> DataFrame:
    return structures(files).select("rel", "language", F.explode("calls").alias("c")).select("rel", "language", "c.*")


def imports(files: DataFrame) -> DataFrame:
    return structures(files).select("rel", "language", F.explode("imports").alias("name"))


def summary(files: DataFrame) -> DataFrame:
    """One row: files, those without a parse, and symbols."""
    return structures(files).agg(F.count_distinct("rel").alias("files"), F.sum((~F.col("parsed")).cast("long")).alias("unparsed"), F.sum(F.size("symbols")).alias("symbols"))


def proposed(source: str, edits: list[tuple[str, str]]) -> str | None:
    """The buffer after edits (old, new): each replaces the first occurrence; None where one is missing."""
    for old, new in edits:
        if old not in source:
            return None
        source = source.replace(old, new, 1)
    return source


def edited_spans(text: str, new: list[str]) -> list[tuple[int, int]]:
    """First and last line of every occurrence of each new string."""
    out = []
    for n in filter(None, new):
        at = text.find(n)
        while at >= 0:
            first = text.count("\n", 0, at) + 1
            out.append((first, first + n.rstrip("\n").count("\n")))
            at = text.find(n, at + 1)
    return sorted(set(out))


def buffer_violations(source: str, language: str, known: set[str], arities: dict[str, int]) -> list[tuple[str, str, int]]:
    """(violation, name, line): calls of names that neither the buffer nor the graph defines, and of known ones with another arity."""
    f = facts(source, language)
    if f is None:
        return []
    own = {s["name"] for s in f.symbols} | set(f.imports)
    text = blanked(source, language) if language in _STRING else source
    out = []
    for c in f.calls:
        if c["callee"] not in own and c["callee"] not in known:
            out.append(("unknown_identifier", c["callee"], c["line"]))
        elif c["callee"] in arities and c["callee"] not in own:
            m = re.search(rf"\b{re.escape(c['callee'])}\s*\(([^()]*)\)", text.split("\n")[c["line"] - 1])
            if m and (len([a for a in m[1].split(",") if a.strip()])) != arities[c["callee"]]:
                out.append(("wrong_arity", c["callee"], c["line"]))
    return out


def dataflow(source: str) -> list[dict]:
    """(function, dependent, depends_on, line): what each `let` of a function takes from its parameters and earlier lets."""
    text, out = blanked(source, "rust"), []
    for m in re.finditer(rf"\bfn\s+{_NAME}\s*\(([^)]*)\)", text):
        end = body_end(text, m.end())
        known = set(re.findall(r"(?:^|,)\s*(?:mut\s+)?(\w+)\s*:", m[2]))
        for s in re.finditer(r"\blet\s+(?:mut\s+)?(\w+)\s*(?::[^=;]+)?=\s*([^;]*);", text[m.end() : end]):
            line = text.count("\n", 0, m.end() + s.start()) + 1
            for v in dict.fromkeys(re.findall(r"[A-Za-z_]\w*", s[2])):
                if v in known and v != s[1]:
                    out.append({"function": m[1], "dependent": s[1], "depends_on": v, "line": line})
            known.add(s[1])
    return out
