"""Syntax nodes as rows, and structural selectors compiled to joins over them.

A source becomes a table of nodes: (hash, node, parent, last, at, kind, field, start, end, start_line, end_line, language). Nodes are
numbered before their children, so those below a node are the numbers up to `last`; `at` is the place
among the named nodes of one parent, start and end are code points. Equal contents are parsed once.

A selector is read on the driver and becomes equi-joins: a pattern's children meet their parents by
(hash, parent), in the order of `at`, each side cut down to its kinds first; text is cut from
the sources only for the captures that a predicate or a result needs. Nothing is searched node by node.

Trees of brace languages come from tokens and brackets: declarations, bodies, parameters, calls, macros, control flow,
comments and literals, named as usual grammars name them; a call's function is the name before its
parenthesis. Python comes from its own parser, with comments added. Other node kinds are not made, and a selector
that asks for one is an error, never an empty result. So are quantifiers, negated fields and quoted tokens.

Defined results: null sources and languages without a grammar have no nodes, nor do sources that
cannot be parsed; `grammar` tells which languages have one. Repeated rows have the captures of each.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import rules as R
from skein.scratch import settle

# Names of node kinds by language. A declaration is (kind, kind of its name, kind of its body).
_BRACE = {
    "rust": {
        "root": "source_file", "line": "line_comment", "block": "block_comment", "string": "string_literal", "raw": "raw_string_literal", "char": "char_literal", "int": "integer_literal", "float": "float_literal", "name": "identifier",
        "body": "block", "params": "parameters", "args": "arguments", "call": ("call_expression", "function"), "group": {"(": "parenthesized_expression", "[": "array_expression"}, "statement": "expression_statement",
        "decl": {"fn": ("function_item", "identifier", "block"), "struct": ("struct_item", "type_identifier", "field_declaration_list"), "enum": ("enum_item", "type_identifier", "enum_variant_list"), "union": ("union_item", "type_identifier", "field_declaration_list"), "trait": ("trait_item", "type_identifier", "declaration_list"), "impl": ("impl_item", "type_identifier", "declaration_list"), "mod": ("mod_item", "identifier", "declaration_list"), "use": ("use_declaration", "identifier", "use_list"), "const": ("const_item", "identifier", "block"), "static": ("static_item", "identifier", "block"), "type": ("type_item", "type_identifier", "block"), "let": ("let_declaration", "identifier", "block")},
        "control": {"if": "if_expression", "for": "for_expression", "while": "while_expression", "loop": "loop_expression", "match": "match_expression", "return": "return_expression", "unsafe": "unsafe_block"},
    },
    "go": {
        "root": "source_file", "line": "comment", "block": "comment", "string": "interpreted_string_literal", "raw": "raw_string_literal", "char": "rune_literal", "int": "int_literal", "float": "float_literal", "name": "identifier",
        "body": "block", "params": "parameter_list", "args": "argument_list", "call": ("call_expression", "function"), "group": {"(": "parenthesized_expression", "[": "index_expression"}, "statement": None,
        "decl": {"func": ("function_declaration", "identifier", "block"), "type": ("type_declaration", "type_identifier", "field_declaration_list"), "import": ("import_declaration", "package_identifier", "block"), "package": ("package_clause", "package_identifier", "block"), "var": ("var_declaration", "identifier", "block"), "const": ("const_declaration", "identifier", "block")},
        "control": {"if": "if_statement", "for": "for_statement", "switch": "expression_switch_statement", "return": "return_statement", "go": "go_statement", "defer": "defer_statement"},
    },
    "typescript": {
        "root": "program", "line": "comment", "block": "comment", "string": "string", "raw": "template_string", "char": "string", "int": "number", "float": "number", "name": "identifier",
        "body": "statement_block", "params": "formal_parameters", "args": "arguments", "call": ("call_expression", "function"), "group": {"(": "parenthesized_expression", "[": "array"}, "statement": "expression_statement",
        "decl": {"function": ("function_declaration", "identifier", "statement_block"), "class": ("class_declaration", "type_identifier", "class_body"), "interface": ("interface_declaration", "type_identifier", "interface_body"), "enum": ("enum_declaration", "identifier", "enum_body"), "import": ("import_statement", "identifier", "named_imports"), "const": ("lexical_declaration", "identifier", "object"), "let": ("lexical_declaration", "identifier", "object")},
        "control": {"if": "if_statement", "for": "for_statement", "while": "while_statement", "switch": "switch_statement", "return": "return_statement", "throw": "throw_statement", "try": "try_statement"}, "method": ("method_definition", "property_identifier"), "holds": ("class_body",),
    },
    "java": {
        "root": "program", "line": "line_comment", "block": "block_comment", "string": "string_literal", "raw": "string_literal", "char": "character_literal", "int": "decimal_integer_literal", "float": "decimal_floating_point_literal", "name": "identifier",
        "body": "block", "params": "formal_parameters", "args": "argument_list", "call": ("method_invocation", "name"), "group": {"(": "parenthesized_expression", "[": "array_access"}, "statement": "expression_statement",
        "decl": {"class": ("class_declaration", "identifier", "class_body"), "interface": ("interface_declaration", "identifier", "interface_body"), "enum": ("enum_declaration", "identifier", "enum_body"), "record": ("record_declaration", "identifier", "class_body"), "import": ("import_declaration", "identifier", "block"), "package": ("package_declaration", "identifier", "block")},
        "control": {"if": "if_statement", "for": "for_statement", "while": "while_statement", "switch": "switch_expression", "return": "return_statement", "throw": "throw_statement", "try": "try_statement"}, "method": ("method_declaration", "identifier"), "holds": ("class_body", "interface_body", "enum_body"),
    },
    "cpp": {
        "root": "translation_unit", "line": "comment", "block": "comment", "string": "string_literal", "raw": "raw_string_literal", "char": "char_literal", "int": "number_literal", "float": "number_literal", "name": "identifier",
        "body": "compound_statement", "params": "parameter_list", "args": "argument_list", "call": ("call_expression", "function"), "group": {"(": "parenthesized_expression", "[": "subscript_argument_list"}, "statement": "expression_statement",
        "decl": {"struct": ("struct_specifier", "type_identifier", "field_declaration_list"), "class": ("class_specifier", "type_identifier", "field_declaration_list"), "union": ("union_specifier", "type_identifier", "field_declaration_list"), "enum": ("enum_specifier", "type_identifier", "enumerator_list"), "namespace": ("namespace_definition", "namespace_identifier", "declaration_list")},
        "control": {"if": "if_statement", "for": "for_statement", "while": "while_statement", "switch": "switch_statement", "return": "return_statement", "throw": "throw_statement", "try": "try_statement"}, "method": ("function_definition", "identifier"), "holds": ("translation_unit", "field_declaration_list", "declaration_list"),
    },
}
for _name, _g in _BRACE.items():
    _g["newline"] = _name in ("go", "typescript")  # a line's end can end a declaration
_BRACE["tsx"] = _BRACE["typescript"]
_PYTHON = {
    "Module": "module", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Call": "call", "Name": "identifier", "Attribute": "attribute", "Import": "import_statement", "ImportFrom": "import_from_statement", "If": "if_statement", "For": "for_statement", "While": "while_statement", "With": "with_statement", "Try": "try_statement",
    "Return": "return_statement", "Raise": "raise_statement", "Assert": "assert_statement", "Assign": "assignment", "AnnAssign": "assignment", "AugAssign": "augmented_assignment", "Lambda": "lambda", "Subscript": "subscript", "List": "list", "Tuple": "tuple", "Dict": "dictionary", "Set": "set", "BinOp": "binary_operator", "Compare": "comparison_operator", "Delete": "delete_statement", "Global": "global_statement", "Pass": "pass_statement",
}
_FIELDS = {"func": "function", "test": "condition", "value": "value", "target": "left", "targets": "left", "returns": "return_type", "iter": "right"}
LANGUAGES = (*_BRACE, "python")

_TOKENS = {
    language: re.compile(
        r"(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))"
        + (r'|(?P<raw>r(#*)".*?"\4)|(?P<char>\'(?:\\.[^\']*|[^\'\\\n])\')' if language == "rust" else r"|(?P<raw>`(?:[^`\\]|\\.)*`)|(?P<char>'(?:[^'\\\n]|\\.)*')")
        + r'|(?P<string>"(?:[^"\\]|\\.)*")|(?P<float>\d[\d_]*\.\d[\w]*)|(?P<int>\d\w*)|(?P<name>[^\W\d]\w*)|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<mark>[^\w\s])',
        re.S,
    )
    for language in _BRACE
}


@dataclass
class Tree:
    """Nodes in order of their start, as lists of [parent, at, kind, field, start, end, last, children so far]."""

    nodes: list = field(default_factory=list)

    def open(self, parent: int, kind: str, start: int, end: int, name: str | None = None) -> int:
        at = 0
        if parent >= 0:
            at = self.nodes[parent][7]
            self.nodes[parent][7] += 1
        self.nodes.append([parent, at, kind, name, start, end, len(self.nodes), 0])
        return len(self.nodes) - 1

    def close(self, node: int, end: int | None = None) -> None:
        self.nodes[node][6] = len(self.nodes) - 1
        if end is not None:
            self.nodes[node][5] = end


def brace_tree(source: str, language: str) -> Tree:
    g, tree = _BRACE[language], Tree()
    tokens = [(m.lastgroup, m.start(), m.end(), m[0]) for m in _TOKENS[language].finditer(source)]
    mate, stack = {}, []
    for i, t in enumerate(tokens):
        if t[0] == "open":
            stack.append(i)
        elif t[0] == "close" and stack:
            mate[stack.pop()] = i
    for i in stack:  # never closed: to the end
        mate[i] = len(tokens)
    end_of = lambda i: tokens[i][2] if i < len(tokens) else len(source)
    text = lambda i: tokens[i][3] if i < len(tokens) else ""

    def group(i: int, parent: int, kind: str, name: str | None = None) -> int:
        node = tree.open(parent, kind, tokens[i][1], end_of(mate[i]), name)
        fill(i + 1, mate[i], node)
        tree.close(node)
        return mate[i] + 1

    def level(i: int, stop: int):
        """The tokens of this level, brackets' insides passed over."""
        while i < stop:
            yield i
            i = mate[i] + 1 if tokens[i][0] == "open" else i + 1

    def until(i: int, stop: int, marks: tuple) -> int:
        """The first of these marks at this level, or stop."""
        return next((j for j in level(i, stop) if tokens[j][3] in marks), stop)

    def declared(i: int, stop: int, parent: int, kinds: tuple) -> int:
        kind, name, body = kinds
        at = i + 1
        if language == "go" and text(i) == "func" and text(at) == "(":
            kind = "method_declaration"
        node = tree.open(parent, kind, tokens[i][1], tokens[i][2])
        if kind == "method_declaration":
            at = group(at, node, g["params"], "receiver")
        while text(at) in ("mut", "class", "ref"):
            at += 1
        if at < stop and tokens[at][0] == "name":
            tree.open(node, name, tokens[at][1], tokens[at][2], "name")
            at += 1
        last = until(at, stop, ("{", ";"))
        if text(i) in ("let", "const", "static", "var", "type", "import", "package") and body in ("block", "object"):
            last = until(at, stop, (";",))
        if g["newline"] and text(last) != "{":
            last = next((j for j in level(at, last) if "\n" in source[tokens[j - 1][2] : tokens[j][1]]), last)
        params = until(at, last, ("(",))
        if params < last and body not in ("object", "use_list") and name in ("identifier",) and text(i) in ("fn", "func", "function"):
            fill(at, params, node)
            at = group(params, node, g["params"], "parameters")
        fill(at, last, node)
        if last < stop and text(last) == "{":
            after = group(last, node, body, "body")
        else:
            after = last + 1 if last < stop and text(last) == ";" else last
        tree.close(node, end_of(after - 1))
        return after

    def controlled(i: int, stop: int, parent: int, kind: str) -> int:
        node = tree.open(parent, kind, tokens[i][1], tokens[i][2])
        plain = kind.startswith(("return", "throw", "go_", "defer"))
        last = until(i + 1, stop, (";",) if plain else ("{", ";"))
        fill(i + 1, last, node)
        after = last
        if last < stop and text(last) == "{":
            after = group(last, node, g["body"], "consequence" if text(i) == "if" else "body")
            while after < stop and text(after) in ("else", "catch", "finally"):
                last = until(after + 1, stop, ("{", ";"))
                fill(after + 1, last, node)
                after = group(last, node, g["body"], "alternative") if last < stop and text(last) == "{" else min(last + 1, stop)
        elif last < stop and not plain:
            after = last + 1
        tree.close(node, end_of(max(after - 1, i)))
        return after

    def called(i: int, stop: int, parent: int, first: bool) -> int:
        at = i + 1
        bang = language == "rust" and text(at) == "!" and at + 1 < stop and tokens[at + 1][0] == "open"
        paren = at + 1 if bang else at
        close = mate[paren]
        method = g.get("method")
        body = until(close + 1, stop, ("{", ";", "=", ",")) if method and tree.nodes[parent][2] in g["holds"] else stop
        if body < stop and text(body) == "{":
            node = tree.open(parent, method[0], tokens[i][1], tokens[i][2])
            tree.open(node, method[1], tokens[i][1], tokens[i][2], "name")
            at = group(paren, node, g["params"], "parameters")
            fill(at, body, node)
            after = group(body, node, g["body"], "body")
            tree.close(node, end_of(after - 1))
            return after
        ends = first and g["statement"] and text(close + 1) == ";" and close + 1 < stop
        holder = tree.open(parent, g["statement"], tokens[i][1], end_of(close + 1)) if ends else parent
        kind, name = ("macro_invocation", "macro") if bang else g["call"]
        node = tree.open(holder, kind, tokens[i][1], end_of(close))
        tree.open(node, g["name"], tokens[i][1], tokens[i][2], name)
        after = group(paren, node, "token_tree" if bang else g["args"], None if bang else "arguments")
        tree.close(node)
        if ends:
            tree.close(holder)
            return after + 1
        return after

    def fill(i: int, stop: int, parent: int) -> None:
        first = True
        while i < stop:
            kind, start, end, word = tokens[i]
            begins, first = first, False
            if kind in ("line", "block", "string", "raw", "char", "int", "float"):
                tree.open(parent, g[kind], start, end)
                first = begins and kind in ("line", "block")
                i += 1
            elif kind == "open":
                i = group(i, parent, g["body"] if word == "{" else g["group"][word])
                first = word == "{"
            elif kind != "name":
                first = word in ";}"
                i += 1
            elif word in g["decl"] and i + 1 < stop:
                i, first = declared(i, stop, parent, g["decl"][word]), True
            elif word in g["control"]:
                i, first = controlled(i, stop, parent, g["control"][word]), True
            elif i + 1 < stop and (text(i + 1) == "(" or language == "rust" and text(i + 1) == "!" and i + 2 < stop and tokens[i + 2][0] == "open"):
                i = called(i, stop, parent, begins)
                first = text(i - 1) in ";}"
            else:
                tree.open(parent, g["name"], start, end)
                i += 1

    root = tree.open(-1, g["root"], 0, len(source))
    fill(0, len(tokens), root)
    tree.close(root)
    return tree


def python_tree(source: str) -> Tree:
    tree, lines = Tree(), source.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    place = lambda row, col: starts[row - 1] + len(lines[row - 1].encode()[:col].decode(errors="ignore")) if row <= len(lines) else len(source)
    notes = [(starts[t.start[0] - 1] + t.start[1], t.string) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]

    def span(node):
        return place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)

    def comments(before: int, parent: int) -> None:
        while notes and notes[0][0] < before:
            at, said = notes.pop(0)
            tree.open(parent, "comment", at, at + len(said))

    def add(node, parent: int, name: str | None) -> None:
        if isinstance(node, ast.Constant):
            kind = {str: "string", bytes: "string", bool: "true" if node.value else "false", int: "integer", float: "float"}.get(type(node.value), "none")
        else:
            kind = _PYTHON.get(type(node).__name__)
        if kind is None or not hasattr(node, "lineno"):
            for key, child in children(node):
                add(child, parent, key)
            return
        start, end = span(node)
        comments(start, parent)
        here = tree.open(parent, kind, start, end, name)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            at = source.index(node.name, start)
            tree.open(here, "identifier", at, at + len(node.name), "name")
        holder = here
        if isinstance(node, ast.Call):
            add(node.func, here, "function")
            holder = tree.open(here, "argument_list", source.index("(", span(node.func)[1]), end, "arguments")
        for key, child in children(node):
            if isinstance(node, ast.Call) and child is node.func:
                continue
            if key == "body" and isinstance(child, ast.stmt) and holder == here:
                comments(span(child)[0], here)
                holder = tree.open(here, "block", span(child)[0], end, "body")
            elif key == "orelse" and isinstance(child, ast.stmt) and holder != here:
                tree.close(holder)
                holder = here
            add(child, holder, None if holder != here else key)
        comments(end, holder)
        if holder != here:
            tree.close(holder)
        tree.close(here)

    def children(node):
        for key, value in ast.iter_fields(node):
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST):
                    yield _FIELDS.get(key, key), child

    root = tree.open(-1, "module", 0, len(source))
    for child in ast.parse(source).body:
        add(child, root, None)
    comments(len(source) + 1, root)
    tree.close(root)
    return tree


def tree_of(source: str | None, language: str | None) -> Tree | None:
    """None where the language has no grammar here or the source cannot be read."""
    if source is None or language not in LANGUAGES:
        return None
    try:
        return python_tree(source) if language == "python" else brace_tree(source, language)
    except (SyntaxError, ValueError, RecursionError, IndexError, tokenize.TokenError):
        return None


KINDS = {language: {"true", "false", "none", "string", "integer", "float", "comment", "block", "argument_list", *_PYTHON.values()} for language in ("python",)}
for _name, _g in _BRACE.items():
    _decl = {x for d in _g["decl"].values() for x in d}
    KINDS[_name] = {_g[k] for k in ("root", "line", "block", "string", "raw", "char", "int", "float", "name", "body", "params", "args")} | _decl | set(_g["control"].values()) | set(_g["group"].values()) | {_g["call"][0], *(_g.get("method") or ()), *([_g["statement"]] if _g["statement"] else [])}
KINDS["rust"] |= {"macro_invocation", "token_tree"}
KINDS["go"] |= {"method_declaration"}

_NODES = "hash string, node int, parent int, last int, at int, kind string, field string, start int, end int, start_line int, end_line int, language string"


def content_hash(source: Column, language: Column) -> Column:
    return F.sha2(F.encode(F.concat_ws("\x00", language, source), "utf-8"), 256)


def nodes(contents: DataFrame) -> DataFrame:
    """Node rows of (hash, language, source), one row a content."""

    names = [c.split()[0] for c in _NODES.split(", ")]

    def run(batches):
        for pdf in batches:
            rows: list[tuple] = []
            for key, language, source in zip(pdf["hash"], pdf["language"], pdf["source"]):
                tree = tree_of(source, language)
                ends = [m.start() for m in re.finditer("\n", source)] if tree else []
                for i, (parent, at, kind, label, start, end, last, _) in enumerate(tree.nodes if tree else []):
                    rows.append((key, i, parent, last, at, kind, label, start, end, bisect_left(ends, start) + 1, bisect_left(ends, max(end - 1, 0)) + 1, language))
                if len(rows) > 100_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return contents.select("hash", "language", "source").mapInPandas(run, _NODES)


# ---- selectors ----


class SelectorError(ValueError):
    pass


@dataclass
class Pattern:
    """kinds None: any node. children are (pattern, must follow at once); tight: nothing may follow the last child."""

    kinds: tuple[str, ...] | None
    label: str | None = None
    captures: list[str] = field(default_factory=list)
    children: list[tuple[Pattern, bool]] = field(default_factory=list)
    tight: bool = False
    either: list[Pattern] = field(default_factory=list)


_LEX = re.compile(r'\s+|;[^\n]*|(?P<string>"(?:[^"\\]|\\.)*")|(?P<word>[A-Za-z_][\w.-]*)(?P<colon>\s*:)?|@(?P<capture>[\w.-]+)|(?P<predicate>#[\w-]+\?)|(?P<mark>[()\[\].])')
_PREDICATES = ("#eq?", "#not-eq?", "#match?", "#not-match?", "#any-of?", "#not-any-of?")


def read_selector(text: str, language: str) -> list[tuple[Pattern, list[tuple]]]:
    """The selector's patterns, each with its predicates (name, capture, operands); a SelectorError says what is wrong."""
    if language not in KINDS:
        raise SelectorError(f"no grammar for {language}")
    tokens, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise SelectorError(f"not understood at {text[at : at + 12]!r}")
        if m.lastgroup:
            kind = "field" if m["colon"] else m.lastgroup
            tokens.append((kind, m["word"] if kind == "field" else m[m.lastgroup]))
        at = m.end()
    pos = 0

    def peek():
        return tokens[pos] if pos < len(tokens) else (None, None)

    def take(kind=None, value=None):
        nonlocal pos
        found = peek()
        if kind and found[0] != kind or value and found[1] != value:
            raise SelectorError(f"expected {value or kind}, found {found[1]!r}")
        pos += 1
        return found[1]

    def captures(p: Pattern) -> Pattern:
        while peek()[0] == "capture":
            p.captures.append(take())
        return p

    def pattern(said: list) -> Pattern:
        name = take() if peek()[0] == "field" else None
        if peek() == ("mark", "["):
            take()
            p = Pattern(None, name)
            while peek() != ("mark", "]"):
                p.either.append(pattern(said))
            take()
            if not p.either:
                raise SelectorError("no alternatives")
            return captures(p)
        if peek() == ("word", "_"):
            take()
            return captures(Pattern(None, name))
        take("mark", "(")
        if peek() == ("mark", "("):  # a group of one pattern and its predicates
            p = pattern(said)
            while peek() != ("mark", ")"):
                predicate(said)
            take()
            return captures(p)
        kind = take("word")
        if kind != "_" and kind not in KINDS[language]:
            raise SelectorError(f"no node kind {kind} in {language}")
        p, follows = Pattern(None if kind == "_" else (kind,), name), False
        while peek() != ("mark", ")"):
            if peek() == ("mark", "."):
                take()
                follows = True
            elif peek()[0] == "mark" and pos + 1 < len(tokens) and tokens[pos + 1][0] == "predicate":
                predicate(said)
            else:
                p.children.append((pattern(said), follows))
                follows = False
        p.tight = follows
        take()
        return captures(p)

    def predicate(said: list) -> None:
        take("mark", "(")
        name, capture, operands = take("predicate"), take("capture"), []
        while peek() != ("mark", ")"):
            kind = peek()[0]
            if kind not in ("string", "capture"):
                raise SelectorError(f"{name} takes captures and strings")
            value = take()
            operands.append((kind, re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]) if kind == "string" else value))
        take()
        if name not in _PREDICATES or not operands:
            raise SelectorError(f"{name} is not a predicate here")
        if "match" in name:
            R.compile_pattern(operands[0][1])
        said.append((name, capture, operands))

    out = []
    while pos < len(tokens):
        said: list = []
        p = pattern(said)
        while peek()[0] == "mark" and pos + 1 < len(tokens) and tokens[pos + 1][0] == "predicate":
            predicate(said)
        known = set(captured(p))
        if lost := {c for _, c, ops in said for c in (c, *(v for k, v in ops if k == "capture"))} - known:
            raise SelectorError(f"no capture @{min(lost)}")
        out.append((p, said))
    if not out:
        raise SelectorError("empty selector")
    return out


def captured(p: Pattern) -> list[str]:
    return list(dict.fromkeys([*p.captures, *(c for child, _ in p.children for c in captured(child)), *(c for e in p.either for c in captured(e))]))


def _frame(table: DataFrame, p: Pattern, names: list[str]) -> DataFrame:
    """hash, node, parent, at and a column of node numbers for each capture: the nodes that the pattern matches."""
    if p.either:
        out = reduce(DataFrame.unionByName, [_frame(table, e, names) for e in p.either])
    else:
        out = (table if p.kinds is None else table.where(F.col("kind").isin(*p.kinds))).select("hash", "node", "parent", "at", "field", *(F.lit(None).cast("int").alias(f"c_{c}") for c in names))
        before = None
        for i, (child, follows) in enumerate(p.children):
            mine = set(captured(child))
            below = _frame(table, child, names).select(F.col("hash").alias("h"), F.col("parent").alias("up"), F.col("at").alias(f"at{i}"), *(F.col(f"c_{c}").alias(f"new_{c}") for c in names if c in mine))
            meets = (F.col("hash") == F.col("h")) & (F.col("node") == F.col("up"))
            if before is not None:
                meets &= (F.col(f"at{i}") == F.col(before) + 1) if follows else (F.col(f"at{i}") > F.col(before))
            elif follows:
                meets &= F.col(f"at{i}") == 0
            out = out.join(below, meets).drop("h", "up", *([before] if before else []))
            for c in mine:
                out = out.withColumn(f"c_{c}", F.coalesce(f"new_{c}", f"c_{c}")).drop(f"new_{c}")
            before = f"at{i}"
        if before:
            if p.tight:  # nothing follows the last child
                size = table.groupBy(F.col("hash").alias("h"), F.col("parent").alias("up")).agg(F.count(F.lit(1)).alias("size"))
                out = out.join(size, (F.col("hash") == F.col("h")) & (F.col("node") == F.col("up"))).where(F.col(before) == F.col("size") - 1).drop("h", "up", "size")
            out = out.drop(before)
    if p.label:
        out = out.where(F.col("field") == p.label)
    for c in p.captures:
        out = out.withColumn(f"c_{c}", F.col("node"))
    return out


def matches(table: DataFrame, contents: DataFrame, selector: str, language: str) -> DataFrame:
    """hash and captures, an array of (capture, text, start_line, end_line): one row a match; matches of the same captures are one."""
    place = table.select("hash", "node", "start", "end", "start_line", "end_line")
    every = []
    for p, said in read_selector(selector, language):
        names = captured(p)
        if not names:
            continue
        found = _frame(table, p, names).select("hash", *(f"c_{c}" for c in names)).distinct()
        for c in names:
            one = place.select(F.col("hash").alias("h"), F.col("node").alias("n"), F.struct("start", "end", "start_line", "end_line").alias(f"p_{c}"))
            found = found.join(one, (F.col("hash") == F.col("h")) & (F.col(f"c_{c}") == F.col("n")), "left").drop("h", "n")
        found = found.join(contents.select("hash", "source"), "hash")
        text = lambda c: F.substring(F.col("source"), F.col(f"p_{c}.start") + 1, F.col(f"p_{c}.end") - F.col(f"p_{c}.start"))
        for name, capture, operands in said:
            values = [text(v) if k == "capture" else F.lit(v) for k, v in operands]
            if "match" in name:
                holds = text(capture).rlike(R.compile_pattern(operands[0][1]))
            else:
                holds = text(capture).isin(*values) if "any-of" in name else text(capture) == values[0]
            found = found.where(F.coalesce(~holds if "not-" in name else holds, F.lit(True)))  # a capture that is not there says nothing
        each = [F.when(F.col(f"c_{c}").isNotNull(), F.struct(F.lit(c).alias("capture"), text(c).alias("text"), F.col(f"p_{c}.start_line").alias("start_line"), F.col(f"p_{c}.end_line").alias("end_line"))) for c in names]
        every.append(found.select("hash", F.array_compact(F.array(*each)).alias("captures")))
    if not every:
        return table.where("false").select("hash", F.array().cast("array<struct<capture:string,text:string,start_line:int,end_line:int>>").alias("captures"))
    return reduce(DataFrame.unionByName, every)


@dataclass
class Parsed:
    """files with their hash, their distinct contents (hash, language, source), and those contents' nodes, written once."""

    files: DataFrame
    contents: DataFrame
    nodes: DataFrame

    def of(self, language: str) -> Parsed:
        return Parsed(*(table.where(F.col("language") == language) for table in (self.files, self.contents, self.nodes)))


def parsed(files: DataFrame) -> Parsed:
    keyed = files.withColumn("hash", content_hash(F.col("source"), F.col("language"))).where(F.col("source").isNotNull())
    contents = keyed.select("hash", "language", "source").dropDuplicates(["hash"])
    # as many sources to a task as a task parses in seconds, however few files they come from
    return Parsed(keyed, contents, settle(nodes(contents.repartition("hash"))))


def captures(files: DataFrame | Parsed, selector: str, language: str) -> DataFrame:
    """rel, capture, text, start_line, end_line of files (rel, source, language) of one language; parsed() files serve many selectors."""
    read_selector(selector, language)
    p = (files if isinstance(files, Parsed) else parsed(files.where(F.col("language") == language))).of(language)
    found = matches(p.nodes, p.contents, selector, language).withColumn("c", F.explode("captures")).select("hash", "c.*")
    return p.files.select("rel", "hash").join(found, "hash").drop("hash")


def captures_of(files: DataFrame, selectors: Iterable[tuple[str, str, str]]) -> DataFrame:
    """rel, selector, capture, text, start_line, end_line for selectors (language, name, text), over files parsed once.

    Each selector's captures are written before the next one is planned: a selector is a dozen joins, and the driver
    holds one such plan at a time, however many selectors there are."""
    p = parsed(files)
    each = [settle(captures(p, text, language).select("rel", F.lit(name).alias("selector"), "capture", "text", "start_line", "end_line")) for language, name, text in selectors]
    return reduce(DataFrame.unionByName, each)


def enclosing_kinds(files: DataFrame, needle: str) -> DataFrame:
    """rel, kind: the smallest node around the first `needle` of each file (rel, source, language) that has it and a tree."""
    p = parsed(files)
    at = p.files.withColumn("first", F.locate(needle, "source") - 1).where("first >= 0").select("rel", "hash", "first")
    around = p.nodes.select("hash", "node", "kind", "start", "end").join(at, "hash").where((F.col("start") <= F.col("first")) & (F.col("end") >= F.col("first") + len(needle)))
    return around.groupBy("rel").agg(F.min_by("kind", F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("node")).alias("deep"))).alias("kind"))


# ---- rules over captures ----


def rule_errors(rules: list[dict]) -> list[tuple[str, str]]:
    """(rule, what is wrong) of selectors, patterns and globs that cannot be used."""
    bad = []
    for r in rules:
        try:
            read_selector(r["query"], r["language"])
        except (SelectorError, R.RuleError) as e:
            bad.append((r["name"], f"selector: {e}"))
        bad += [(r["name"], f"{part}: {e}") for part in ("pattern", "gate") if r.get(part) is not None for _, e in R.compile_errors([r[part]])]
        bad += [(r["name"], f"path {g}: {e}") for g, e in R.glob_errors(r.get("applies_to", []))]
    return bad


def structural_findings(texts: DataFrame, rules: list[dict], keys: list[str], mode: str = "enforce", governed: bool = False) -> DataFrame:
    """keys, rule, line, offending, explanation, blocking: what rules object to in texts (keys, rel, language, source).

    A rule is name, language, query (selector), pattern and match_type: every captured text must match (must-match), none may
    (must-not-match), or one at least must (must-exist, one finding a text without line). A gate keeps the captures that it matches,
    applies_to the paths; a rule looks at texts of its language alone. Findings of local rules block as the mode says; whether
    those of governed ones do is up to the rule's class, or else effect, and only those for before the edit speak here. A
    rule with errors finds nothing: rule_errors() tells of it. Texts that cannot be parsed are not judged."""
    broken = {name for name, _ in rule_errors(rules)}
    live = [r for r in rules if r["name"] not in broken]
    blank = texts.where("false").select(*keys, *(F.lit(None).cast(t).alias(c) for c, t in (("rule", "string"), ("line", "int"), ("offending", "string"), ("explanation", "string"), ("blocking", "boolean"))))
    if not live:
        return blank
    whole = parsed(texts.where(F.col("language").isin(*{r["language"] for r in live})))
    said = {"must-match": "each selected text must match", "must-not-match": "no selected text may match", "must-exist": "at least one selected text must match"}
    out = [blank]
    for r in live:
        p = whole.of(r["language"])
        mine = p.files.where(R.any_glob(F.col("rel"), r["applies_to"])) if r.get("applies_to") else p.files
        found = matches(p.nodes, p.contents, r["query"], r["language"]).select("hash", F.explode("captures").alias("c")).select("hash", "c.*")
        if r.get("gate"):
            found = found.where(F.col("text").rlike(R.compile_pattern(r["gate"])))
        hit = F.col("text").rlike(R.compile_pattern(r["pattern"]))
        if r["match_type"] == "must-exist":
            rows = mine.join(p.nodes.where("node = 0").select("hash"), "hash", "left_semi").join(found.where(hit).select("hash"), "hash", "left_anti").select(*keys, F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("text"))
        else:
            rows = mine.join(found.where(~hit if r["match_type"] == "must-match" else hit), "hash").select(*keys, F.col("start_line").alias("line"), "text")
        first = F.substring_index("text", "\n", 1)
        short = F.when(F.length(first) > 80, F.concat(F.substring(first, 1, 79), F.lit("…"))).otherwise(first)
        lit = lambda k, r=r: F.lit(r.get(k)).cast("string")
        if governed:
            rows = rows.where(R.before_edit(lit("verification_point")))
        blocking = R.blocks(lit("class"), lit("effect"), F.lit(mode)) if governed else F.lit(mode == "enforce")
        out.append(rows.select(*keys, F.lit(r["name"]).alias("rule"), "line", short.alias("offending"), F.lit(r.get("message") or f"{said[r['match_type']]} /{r['pattern']}/").alias("explanation"), blocking.alias("blocking")))
    return reduce(DataFrame.unionByName, out)
