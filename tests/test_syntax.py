"""Syntax nodes and selectors against a recursive walk."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skein.operators import syntax

SOURCES = {
    "rust": ['/* top */\nuse a::b;\nfn one(x: u8, y: Vec<u8>) -> u8 { two(three(x), "a)b"); if x { return y; } else { four(1.5, 2) } }\n', "impl Box {\n  fn grow(&self) { self.push(1); print!(\"{}\", 2); }\n  // end\n}\nstruct Odd;\nenum E { A, B }", "fn broken( { \"open", "", "fn a() {} }}} fn b() { c() }"],
    "python": ["import os\n# first\ndef one(x, y=2):\n    # in\n    return two(three(x), 'é', 1.5)\n\nclass A:\n    '''doc'''\n    def run(self):\n        if self.x:\n            go(1)\n        else:\n            stop()\n", "def broken(:\n", "", "x = [1, 2]\n"],
    "go": ['package m\nimport "fmt"\ntype T struct { a int }\nfunc (t *T) Run(x int) int { helper(x); return 1 }\nfunc helper(x int) { fmt.Println(`raw`) }\n'],
    "typescript": ["import { q } from './lib';\nexport class C {\n  run(a: number) { return helper(a, 'x'); }\n}\nfunction helper(x) { q(`t`); }\n"],
    "java": ['import a.b.C;\npublic class J {\n  int n = 1;\n  void run(int x) { helper("s"); }\n  private int helper(String s) { return s.length(); }\n}\n'],
    "cpp": ['#include "x.h"\nnamespace n {\nstruct S { int a; };\nint helper(int x) { return x; }\nint run() { return helper(2); }\n}\n'],
}
SELECTORS = {
    "rust": ["(function_item name: (identifier) @f parameters: (parameters) @p)", "(call_expression function: (identifier) @f arguments: (arguments (call_expression function: (identifier) @g)))", "(arguments (_) @a . (_) @b)", "(arguments . (_) @first)", "(block (_) @last .)", '((identifier) @x (#match? @x "^t") (#not-eq? @x "two"))',
             "[(struct_item name: (type_identifier) @n) (enum_item name: (type_identifier) @n) (impl_item)] @whole", "(function_item body: (block [(expression_statement) (if_expression)] @s))", '(arguments (_) @a (_) @b (#any-of? @b "2" "1"))', "(macro_invocation (token_tree) @t) (line_comment) @c"],
    "python": ["(function_definition name: (identifier) @f)", "(class_definition body: (block (function_definition) @m))", "(call function: (identifier) @f arguments: (argument_list (call) @inner))", "(comment) @c", "(if_statement body: (block (_) @x))", "[(string) (float)] @literal"],
    "go": ["(method_declaration receiver: (parameter_list) @r name: (identifier) @n)", "(call_expression function: (identifier) @f)", "(raw_string_literal) @s"],
    "typescript": ["(method_definition name: (property_identifier) @n parameters: (formal_parameters) @p)", "(call_expression arguments: (arguments (_) @a))"],
    "java": ["(method_declaration name: (identifier) @n body: (block (expression_statement (method_invocation name: (identifier) @c))))", "(class_declaration name: (identifier) @c)"],
    "cpp": ["(function_definition name: (identifier) @n body: (compound_statement (return_statement (_) @r)))", "(struct_specifier name: (type_identifier) @s)"],
}


def walk(source, language, selector):
    """The captures of each distinct match, by trying every node and every choice of children."""
    tree = syntax.tree_of(source, language)
    if tree is None:
        return set()
    below = {}
    for i, n in enumerate(tree.nodes):
        below.setdefault(n[0], []).append(i)

    def at(p, i):
        node = tree.nodes[i]
        if p.label and node[3] != p.label:
            return
        inner = [got for e in p.either for got in at(e, i)] if p.either else [] if p.kinds and node[2] not in p.kinds else list(kids(p, 0, below.get(i, []), -1))
        for got in inner:
            yield {**got, **dict.fromkeys(p.captures, i)}

    def kids(p, k, children, before):
        if k == len(p.children):
            if not (p.tight and p.children and before != len(children) - 1):
                yield {}
            return
        child, follows = p.children[k]
        for place in range(before + 1, len(children)):
            if follows and place != before + 1:
                break
            for got in at(child, children[place]):
                for rest in kids(p, k + 1, children, place):
                    yield {**got, **rest}

    text = lambda i: source[tree.nodes[i][4] : tree.nodes[i][5]]
    out = set()
    for n, (p, said) in enumerate(syntax.read_selector(selector, language)):
        for i in range(len(tree.nodes)):
            for got in at(p, i):
                fine = True
                for name, capture, operands in said:
                    if capture in got:
                        values = [text(got[v]) if kind == "capture" else v for kind, v in operands]
                        holds = bool(re.search(values[0], text(got[capture]))) if "match" in name else text(got[capture]) in values
                        fine &= holds != ("not-" in name)
                if fine and got:
                    out.add((n, tuple(sorted(got.items()))))
    line = lambda place: source.count("\n", 0, place) + 1
    return sorted((c, text(i), line(tree.nodes[i][4]), line(max(tree.nodes[i][5] - 1, 0))) for _, got in out for c, i in got)


@pytest.mark.parametrize("language", list(SOURCES))
def test_captures_equal_a_walk(spark, language):
    every = SOURCES[language]
    if language == "rust":
        r = random.Random(1)
        parts = ["fn f(a: u8) {", "}", "g(1, h(2));", '"s"', "// c\n", "let x = t(1);", "two", "if a {", "m!(1, \"q\")", "mod i {", "(", ")", ";"]
        every = every + [" ".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(25)]
    files = spark.createDataFrame([(f"f{i}", s, language) for i, s in enumerate(every)] + [("again", every[0], language), ("none", None, language)], "rel string, source string, language string")
    names = {f"f{i}": s for i, s in enumerate(every)} | {"again": every[0]}
    found = 0
    read = syntax.parsed(files)
    for selector in SELECTORS[language]:
        got = {}
        for x in syntax.captures(read, selector, language).collect():
            got.setdefault(x["rel"], []).append((x["capture"], x["text"], x["start_line"], x["end_line"]))
        for rel, source in names.items():
            want = list(walk(source, language, selector))
            assert sorted(got.get(rel, [])) == want, (selector, source)
            found += len(want)
    assert found > len(SELECTORS[language])


def test_nodes_are_intervals():
    for language, sources in SOURCES.items():
        for source in sources:
            tree = syntax.tree_of(source, language)
            for i, (parent, _, kind, _, start, end, last, _) in enumerate(tree.nodes if tree else []):
                assert kind in syntax.KINDS[language] and i <= last and start <= end
                if i:
                    up = tree.nodes[parent]
                    assert parent < i and last <= up[6] and up[4] <= start and end <= up[5]


def test_selectors_that_cannot_be_read():
    for bad in ["(no_such_node) @x", "(line_comment", "", "(line_comment)* @c", '((line_comment) @c (#match? @c "("))', '((line_comment) @c (#eq? @d "x"))', "(line_comment) @c )", '("fn") @k', "[] @x", '((line_comment) @c (#odd? @c "x"))']:
        with pytest.raises((syntax.SelectorError, syntax.R.RuleError)):
            syntax.read_selector(bad, "rust")
    with pytest.raises(syntax.SelectorError):
        syntax.read_selector("(comment) @c", "cobol")


def test_rules_over_captures(spark):
    ticket = r"\b[A-Z]+-[0-9]+\b"
    base = {"language": "rust", "query": "(line_comment) @c"}
    rules = [
        base | {"name": "cite", "match_type": "must-match", "pattern": ticket, "gate": r"\bTODO\b"},
        base | {"name": "none", "match_type": "must-not-match", "pattern": ticket, "applies_to": ["src/**"], "class": "soft"},
        base | {"name": "header", "match_type": "must-exist", "pattern": "SPDX", "verification_point": "PAA"},
        base | {"name": "bad", "match_type": "must-match", "pattern": "("}, base | {"name": "lost", "query": "(odd) @c", "match_type": "must-match", "pattern": "x"},
    ]
    assert {n for n, _ in syntax.rule_errors(rules)} == {"bad", "lost"}
    texts = spark.createDataFrame([(1, "src/a.rs", "rust", "// TODO: later\n// SPDX\nfn f() {}"), (2, "src/a.rs", "rust", "// TODO A-1 " + "x" * 90), (3, "lib/a.rs", "rust", "// A-1"), (4, "a.py", "python", "# A-1"), (5, "x.rs", "rust", None)], "key int, rel string, language string, source string")
    got = lambda **k: sorted((x["key"], x["rule"], x["line"], x["blocking"]) for x in syntax.structural_findings(texts, rules, ["key"], **k).collect())
    assert got() == [(1, "cite", 1, True), (2, "header", None, True), (2, "none", 1, True), (3, "header", None, True)]
    assert got(mode="advise")[0] == (1, "cite", 1, False)
    assert got(governed=True) == [(1, "cite", 1, True), (2, "none", 1, False)]
    said = {x["rule"]: x["offending"] for x in syntax.structural_findings(texts.where("key = 2"), rules, ["key"]).collect()}
    assert said["none"].endswith("…") and len(said["none"]) == 80 and said["header"] is None
    assert syntax.structural_findings(texts, [], ["key"]).count() == 0
    kinds = {x["rel"]: x["kind"] for x in syntax.enclosing_kinds(texts.where("key in (1, 4)"), "A-1").collect()}
    assert kinds == {"a.py": "comment"}
    assert syntax.parsed(texts).nodes.where(F.col("kind") == "line_comment").count() == 4


def test_captures_of_many_selectors_leave_no_joins_to_the_driver(spark):
    files = spark.createDataFrame([(f"{language}{i}", language, s) for language, found in SOURCES.items() for i, s in enumerate(found)], "rel string, language string, source string")
    asked = [(language, f"{language}{i}", s) for language in ("rust", "python") for i, s in enumerate(SELECTORS[language])]
    got = syntax.captures_of(files, asked)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    read = syntax.parsed(files)
    want = [(x["rel"], name, *x[1:]) for language, name, s in asked[::4] for x in syntax.captures(read, s, language).select("rel", "capture", "text", "start_line", "end_line").collect()]
    assert want and sorted(want) == sorted(tuple(x) for x in got.where(F.col("selector").isin([n for _, n, _ in asked[::4]])).collect())
    assert {x["language"] for x in read.of("python").nodes.select("language").distinct().collect()} == {"python"}
