"""Structural queries over sources that differ by part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import syntax
from skein.plans.tables import read

#: K is the part's key and Z its size; three languages in turn.
CODE = (
    ("rust", "src/pK.rs", '// TODO: part K\nfn topK(a: i32) -> i32 {\n    leafZ(a);\n    log!("size Z");\n    a\n}\nmod inner {\n    /* note "K" */\n    fn leafZ() -> i32 { K }\n}\n'),
    ("python", "lib/pK.py", '# TODO T-K: later\nclass BoxK:\n    def run(self):\n        return leafZ("size Z", K)\n\n\ndef leafZ(x, y):\n    return x  # T-Z\n'),
    ("typescript", "web/pK.ts", "// T-K done\nclass BoxK {\n  run(a: number) { leafZ(`size Z`); }\n}\nfunction leafZ(x) { return K; }\n"),
)
SELECTORS = (
    ("rust", "calls", "(function_item name: (identifier) @name body: (block (expression_statement (call_expression function: (identifier) @callee))))"),
    ("rust", "inner", '(mod_item body: (declaration_list (function_item name: (identifier) @inner) (#match? @inner "[02468]$")))'),
    ("rust", "notes", "[(line_comment) (block_comment)] @note"),
    ("rust", "macros", '((macro_invocation macro: (identifier) @macro (token_tree . (string_literal) @text .)) (#eq? @macro "log"))'),
    ("python", "notes", "(comment) @note"),
    ("python", "methods", "(class_definition name: (identifier) @class body: (block (function_definition name: (identifier) @method)))"),
    ("python", "numbers", "(call function: (identifier) @f arguments: (argument_list (string) (integer) @n))"),
    ("typescript", "methods", "(class_body (method_definition name: (property_identifier) @method body: (statement_block (expression_statement (call_expression arguments: (arguments (template_string) @text))))))"),
    ("typescript", "returns", "(function_declaration name: (identifier) @name body: (statement_block (return_statement (number) @value)))"),
)
RULES = [
    {"name": "todo-ticket", "language": "rust", "query": "(line_comment) @c", "gate": r"\bTODO\b", "match_type": "must-match", "pattern": r"\b[A-Z]+-[0-9]+\b"},
    {"name": "no-ticket", "language": "python", "query": "(comment) @c", "match_type": "must-not-match", "pattern": r"\b[A-Z]+-[0-9]*[13579]\b", "class": "soft"},
    {"name": "has-ticket", "language": "typescript", "query": "(comment) @c", "match_type": "must-exist", "pattern": "T-[0-9]*[02468] ", "applies_to": ["web/*[0-4].ts"], "effect": "mystery"},
    {"name": "later", "language": "rust", "query": "(identifier) @i", "match_type": "must-not-match", "pattern": ".", "verification_point": "PAA"},
    {"name": "broken", "language": "rust", "query": "(no_such_node) @i", "match_type": "must-not-match", "pattern": "."},
]


def sources(spark, d) -> DataFrame:
    p = read(spark, d, "part", "p_partkey", "p_size")
    key = F.col("p_partkey")
    pick = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in CODE)), (key % len(CODE) + 1).cast("int"))
    # a name keeps its letters: only a capital K or Z with no letter after it is a place
    put = lambda text: F.regexp_replace(F.regexp_replace(text, "K(?![a-z])", key.cast("string")), "Z(?![a-z])", F.col("p_size").cast("string"))
    return p.select("p_partkey", pick(0).alias("language"), put(pick(1)).alias("rel"), put(pick(2)).alias("source"))


def structural_captures(spark, d):
    return syntax.captures_of(sources(spark, d), SELECTORS)


def structural_rules(spark, d):
    """Governed rules over whole sources: what each finds and whether it blocks."""
    return syntax.structural_findings(sources(spark, d), RULES, ["p_partkey"], governed=True).select("p_partkey", "rule", "line", "offending", "blocking")


def enclosing_kinds(spark, d):
    return syntax.enclosing_kinds(sources(spark, d), "size")


QUERIES = {f.__name__: f for f in (structural_captures, structural_rules, enclosing_kinds)}

_P = "p AS (SELECT *, p_partkey AS k, p_size AS z, ['src/p' || p_partkey || '.rs', 'lib/p' || p_partkey || '.py', 'web/p' || p_partkey || '.ts'][p_partkey % 3 + 1] AS rel FROM part)"
ORACLES = {
    "structural_captures": f"""WITH {_P}, v AS (
        SELECT rel, 'calls' AS selector, 'name' AS capture, 'top' || k AS text, 2 AS start_line, 2 AS end_line FROM p WHERE k % 3 = 0 UNION ALL SELECT rel, 'calls', 'callee', 'leaf' || z, 3, 3 FROM p WHERE k % 3 = 0
        UNION ALL SELECT rel, 'inner', 'inner', 'leaf' || z, 9, 9 FROM p WHERE k % 3 = 0 AND z % 2 = 0
        UNION ALL SELECT rel, 'notes', 'note', '// TODO: part ' || k, 1, 1 FROM p WHERE k % 3 = 0 UNION ALL SELECT rel, 'notes', 'note', '/* note "' || k || '" */', 8, 8 FROM p WHERE k % 3 = 0
        UNION ALL SELECT rel, 'macros', 'macro', 'log', 4, 4 FROM p WHERE k % 3 = 0 UNION ALL SELECT rel, 'macros', 'text', '"size ' || z || '"', 4, 4 FROM p WHERE k % 3 = 0
        UNION ALL SELECT rel, 'notes', 'note', '# TODO T-' || k || ': later', 1, 1 FROM p WHERE k % 3 = 1 UNION ALL SELECT rel, 'notes', 'note', '# T-' || z, 8, 8 FROM p WHERE k % 3 = 1
        UNION ALL SELECT rel, 'methods', 'class', 'Box' || k, 2, 2 FROM p WHERE k % 3 = 1 UNION ALL SELECT rel, 'methods', 'method', 'run', 3, 3 FROM p WHERE k % 3 = 1
        UNION ALL SELECT rel, 'numbers', 'f', 'leaf' || z, 4, 4 FROM p WHERE k % 3 = 1 UNION ALL SELECT rel, 'numbers', 'n', k::VARCHAR, 4, 4 FROM p WHERE k % 3 = 1
        UNION ALL SELECT rel, 'methods', 'method', 'run', 3, 3 FROM p WHERE k % 3 = 2 UNION ALL SELECT rel, 'methods', 'text', '`size ' || z || '`', 3, 3 FROM p WHERE k % 3 = 2
        UNION ALL SELECT rel, 'returns', 'name', 'leaf' || z, 5, 5 FROM p WHERE k % 3 = 2 UNION ALL SELECT rel, 'returns', 'value', k::VARCHAR, 5, 5 FROM p WHERE k % 3 = 2) SELECT * FROM v""",
    "structural_rules": f"""WITH {_P} SELECT p_partkey, 'todo-ticket' AS rule, 1 AS line, '// TODO: part ' || k AS offending, true AS blocking FROM p WHERE k % 3 = 0
        UNION ALL SELECT p_partkey, 'no-ticket', 1, '# TODO T-' || k || ': later', false FROM p WHERE k % 3 = 1 AND k % 2 = 1 UNION ALL SELECT p_partkey, 'no-ticket', 8, '# T-' || z, false FROM p WHERE k % 3 = 1 AND z % 2 = 1
        UNION ALL SELECT p_partkey, 'has-ticket', NULL, NULL, true FROM p WHERE k % 3 = 2 AND k % 10 < 5 AND k % 2 = 1""",
    "enclosing_kinds": f"WITH {_P} SELECT rel, ['string_literal', 'string', 'template_string'][k % 3 + 1] AS kind FROM p",
}
