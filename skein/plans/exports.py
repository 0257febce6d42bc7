"""Document, export and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import functions as fn
from skein.operators import docs, extract, rules
from skein.plans.tables import read
from skein.sources import ignores


def slug_unique(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_brand", "p_type")
    rows = p.select("p_brand", "p_partkey", fn.slug(F.concat_ws(" ", "p_type", F.lit("& Co_"))).alias("slug"))
    return docs.unique_slugs(rows, "p_brand", "slug", "p_partkey")


def _markdown(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand")
    head = F.concat(F.lit("# "), "p_type", F.lit("\n\nuses `"), F.regexp_replace("p_name", "[^A-Za-z]", "_"), F.lit("` and `mod::Run()`\n```\n# not a heading\n```\n## "), "p_type", F.lit("\n[see](../x.md)\n"))
    return p.select("p_partkey", head.alias("text"))


def doc_sections(spark, d):
    s = docs.sections(_markdown(spark, d), "p_partkey", "text")
    return s.select("p_partkey", "pos", "heading", "depth", "slug", F.array_join(F.transform("mentions", lambda m: F.concat_ws(".", m["qualifier"], m["symbol"])), ",").alias("mentions"), F.array_join("links", ",").alias("links"))


def _triples(spark, d):
    r, n, c = (read(spark, d, t) for t in ("region", "nation", "customer"))
    region, nation, customer = F.concat(F.lit("urn:r:"), "r_regionkey"), F.concat(F.lit("urn:n:"), "n_nationkey"), F.concat(F.lit("urn:c:"), "c_custkey")
    return docs.triples(
        docs.statements(r, region, "rdf:type", F.lit("geo:Region"), "iri"),
        docs.statements(n, nation, "rdf:type", F.lit("geo:Nation"), "iri"),
        docs.statements(n, nation, "geo:name", F.col("n_name"), "literal"),
        docs.statements(n, nation, "geo:in", F.concat(F.lit("urn:r:"), "n_regionkey"), "iri"),
        docs.statements(c, customer, "rdf:type", F.lit("geo:Customer"), "iri"),
        docs.statements(c.where("c_custkey % 13 <> 0"), customer, "geo:lives", F.when(F.col("c_custkey") % 17 == 0, F.lit("urn:n:99")).otherwise(F.concat(F.lit("urn:n:"), "c_nationkey")), "iri"),
        docs.statements(c, customer, "geo:segment", F.col("c_mktsegment"), "literal"),
        docs.statements(c.where("c_custkey % 19 = 0"), customer, "geo:segment", F.lit("OTHER"), "literal"),
    )


def triples_export(spark, d):
    return _triples(spark, d)


def turtle_lines(spark, d):
    return docs.turtle(_triples(spark, d).where("p = 'geo:name' OR p = 'geo:in' OR o = 'geo:Region'"))


SHAPES = [
    {"target": "geo:Customer", "path": "geo:lives", "min": 1, "max": 1, "node_kind": "iri", "to_class": "geo:Nation"},
    {"target": "geo:Customer", "path": "geo:segment", "max": 1, "values": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]},
]


def shape_violations(spark, d):
    return docs.shape_violations(_triples(spark, d), SHAPES)


def shape_conforms(spark, d):
    return docs.conforms(docs.shape_violations(_triples(spark, d), SHAPES))


def chunk_assignment(spark, d):
    """Every chunk holds its subjects whole and the types that its links need; sizes are bounded."""
    c = docs.chunks(_triples(spark, d), 4000, docs.class_predicates(SHAPES))
    return c.groupBy("chunk").agg(F.min(F.when(~F.col("carried"), F.col("s"))).alias("first"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("carried").cast("long")).alias("carried"))


def iri_dedupe(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_size")
    rows = p.select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("iri"), "p_partkey", F.col("p_type").alias("kind"))
    return docs.first_of(rows, "iri", ["p_partkey"], "kind").select("iri", "p_partkey", "kind", F.array_join("kinds", "|").alias("kinds"))


def mention_links(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_brand", "p_size", "p_type")
    symbols = p.select(F.col("p_partkey").alias("node"), F.concat(F.lit("s"), "p_size").alias("name"), F.concat(F.lit("lib/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/mod.rs")).alias("file"))
    mentions = p.select(F.col("p_partkey").alias("mention"), F.concat(F.lit("s"), "p_size").alias("symbol"), F.when(F.col("p_partkey") % 2 == 0, F.upper(F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("qualifier"))
    return docs.mention_links(mentions, symbols)


#: (command, verb, target, class) with the user in place of U: what resolves, and what must not.
COMMANDS = (
    ("ssh -o Batch=yes root@webU.example", "ssh", "webU.example", "host"), ("scp ./b nodeU.example:/opt/x", "scp", "nodeU.example", "host"), ("/usr/bin/ssh 'op@hU'", "ssh", "hU", "host"), ("ssh hU", None, None, "unknown"),
    ("ansible-playbook site.yml --limit hU,", "ansible-playbook", "hU", "host"), ("ansible all -l hU -m ping", "ansible", "hU", "host"), ("ansible groupU -m ping", None, None, "unknown"), ("systemctl --now restart svcU.service", "restart", "svcU", "service"), ("systemctl frob svcU", None, None, "unknown"),
    ("git push git@h:team/rU.git main", "push", "rU", "repo"), ("git clone https://h/team/rU/", "clone", "rU", "repo"), ("git commit -m U", None, None, "unknown"), ("docker --debug stop cU", "stop", "cU", "container"), ("pct exec U & date", "exec", "U", "container"), ("docker ps U", None, None, "unknown"),
    ("ssh root@webU.example | tee log", None, None, "unknown"), ("echo $(ssh root@webU.example)", None, None, "unknown"), ("cat U", None, None, "unknown"), ("", None, None, "unknown"),
)


def _commands(spark, d):
    ev = read(spark, d, "events", "event_id", "user_id")
    text = F.replace(F.element_at(F.array(*(F.lit(c[0]) for c in COMMANDS)), (F.col("event_id") % len(COMMANDS) + 1).cast("int")), F.lit("U"), F.col("user_id").cast("string"))
    return ev.select("event_id", fn.command(text).alias("c")).select("event_id", "c.verb", "c.target", "c.class")


def commands(spark, d):
    return _commands(spark, d)


def action_scope(spark, d):
    """Commands as class:target in a tenant's scope of targets; what names no target is not judged."""
    c = _commands(spark, d).where("target IS NOT NULL").withColumn("action", F.concat_ws(":", "class", "target"))
    return c.select("event_id", "action", rules.in_scope(F.col("action"), ["host:web1*", "repo:*", "service:svc?"], ["*:r13"]).alias("inside"))


_COMMAND_ROWS = ", ".join(f"({i}, " + ", ".join("NULL" if x is None else f"'{x}'" for x in c[1:]) + ")" for i, c in enumerate(COMMANDS))
_COMMANDS_SQL = f"""co AS (SELECT event_id, v.verb, replace(v.target, 'U', user_id::VARCHAR) AS target, v.class FROM events JOIN (VALUES {_COMMAND_ROWS}) AS v(n, verb, target, class) ON v.n = event_id % {len(COMMANDS)})"""


PATHS = ("mod.rs", "__init__.py", "main.go", "x.min.js", "index.ts", "a.mjs", "b.jsx", "types.pyi", "v.hxx", "notes.md", "dist/out.cts", "vendored/lib.c", "thirdparty/z.cc", "myvendor/q.java", "bundle-min.css", "x.min", ".rs", "Upper.RS")


def stems(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_brand", "p_size")
    rel = F.concat(F.lit("a/b"), F.col("p_size").cast("string"), F.lit("/"), F.element_at(F.array(*map(F.lit, PATHS)), (F.col("p_partkey") % len(PATHS) + 1).cast("int")))
    return p.select("p_partkey", rel.alias("rel"), fn.module_stem(rel).alias("stem"), fn.language(rel).alias("language"), fn.vendored(rel).alias("vendored"))


def extracted_symbols(spark, d):
    """Symbols of sources in six languages; every name holds its part's key."""
    return extract.symbols(_sources(spark, d)).select("rel", "name", "kind", "start_line")


def extracted_calls(spark, d):
    return extract.calls(_sources(spark, d)).select("rel", "caller", "callee", "line")


def extracted_imports(spark, d):
    return extract.imports(_sources(spark, d)).select("rel", "name")


_CODE = {
    "rs": "mod inner {\n fn leaf() {}\n}\npub fn top(a: i32) -> i32 {\n leaf();\n // leaf();\n a\n}\nstruct P;\n",
    "py": "import os.path\nclass A:\n    def run(self):\n        helper(1)\n\ndef helper(x):\n    return x\n",
    "ts": "import { q } from './lib';\nexport class C {\n  run(a: number) { return helper(a); }\n}\nfunction helper(x) { return x; }\n",
    "go": "package m\nimport \"fmt\"\ntype T struct {}\nfunc (t *T) Run() { helper() }\nfunc helper() { fmt.Println(1) }\n",
    "java": "import a.b.C;\npublic class J {\n  J() {}\n  void run() { helper(); }\n  void helper() {}\n}\n",
    "cpp": "#include \"x.h\"\nstruct S { int a; };\nint helper(int x) { return x; }\nint run() { return helper(2); }\n",
}


def _sources(spark, d):
    p = read(spark, d, "part", "p_partkey")
    exts = list(_CODE)
    ext = F.element_at(F.array(*map(F.lit, exts)), (F.col("p_partkey") % len(exts) + 1).cast("int"))
    text = F.create_map(*(F.lit(x) for kv in _CODE.items() for x in kv))[ext]
    text = F.regexp_replace(text, F.lit(r"\b(inner|leaf|top|helper|run|Run|P|A|T|J|S)\b"), F.concat(F.lit("$1"), F.col("p_partkey").cast("string")))
    rel = F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit("."), ext)
    return p.select(rel.alias("rel"), text.alias("source"), fn.language(rel).alias("language"))


IGNORES = (
    (".gitignore", "*.log\n!keep*.log\n/build\ntarget/\n**/gen/*.rs\n"),
    ("lib/.gitignore", "!*.log\n/skip\n"),
    (".ignore", "lib/odd?.rs\n"),
)
PLACES = ("a.log", "keep.log", "build/K.rs", "lib/build/K.rs", "x/target/K.rs", "x/gen/pK.rs", "x/gen/y/pK.rs", "lib/K.log", "lib/skip/K.rs", "lib/in/skip", "lib/oddK.rs", ".dot/K.rs", "src/K.rs")


def ignored_paths(spark, d):
    """Which of a tree's paths its own rule files take out, by the kinds of rules there are."""
    p = read(spark, d, "part", "p_partkey")
    key = F.col("p_partkey")
    rel = F.replace(F.element_at(F.array(*map(F.lit, PLACES)), (key % len(PLACES) + 1).cast("int")), F.lit("K"), key.cast("string"))
    rules_at = ignores.rules_of(spark.createDataFrame(IGNORES, "rel string, source string"))
    return ignores.ignored(p.select("p_partkey", rel.alias("rel")), rules_at)


QUERIES = {f.__name__: f for f in (ignored_paths, slug_unique, doc_sections, triples_export, turtle_lines, shape_violations, shape_conforms, chunk_assignment, iri_dedupe, mention_links, commands, action_scope, stems, extracted_symbols, extracted_calls, extracted_imports)}

_TRI = """tr AS (SELECT 'urn:r:' || r_regionkey AS s, 'rdf:type' AS p, 'geo:Region' AS o, 'iri' AS o_kind FROM region UNION SELECT 'urn:n:' || n_nationkey, 'rdf:type', 'geo:Nation', 'iri' FROM nation
 UNION SELECT 'urn:n:' || n_nationkey, 'geo:name', n_name, 'literal' FROM nation UNION SELECT 'urn:n:' || n_nationkey, 'geo:in', 'urn:r:' || n_regionkey, 'iri' FROM nation
 UNION SELECT 'urn:c:' || c_custkey, 'rdf:type', 'geo:Customer', 'iri' FROM customer UNION SELECT 'urn:c:' || c_custkey, 'geo:lives', CASE WHEN c_custkey % 17 = 0 THEN 'urn:n:99' ELSE 'urn:n:' || c_nationkey END, 'iri' FROM customer WHERE c_custkey % 13 <> 0
 UNION SELECT 'urn:c:' || c_custkey, 'geo:segment', c_mktsegment, 'literal' FROM customer UNION SELECT 'urn:c:' || c_custkey, 'geo:segment', 'OTHER', 'literal' FROM customer WHERE c_custkey % 19 = 0)"""
_VIO = """SELECT 'urn:c:' || c_custkey AS focus, 'geo:lives' AS path, 'minCount' AS "constraint", '0' AS value FROM customer WHERE c_custkey % 13 = 0
 UNION ALL SELECT 'urn:c:' || c_custkey, 'geo:lives', 'class', 'urn:n:99' FROM customer WHERE c_custkey % 17 = 0 AND c_custkey % 13 <> 0
 UNION ALL SELECT 'urn:c:' || c_custkey, 'geo:segment', 'maxCount', '2' FROM customer WHERE c_custkey % 19 = 0 UNION ALL SELECT 'urn:c:' || c_custkey, 'geo:segment', 'in', 'OTHER' FROM customer WHERE c_custkey % 19 = 0"""

#: (language, name, kind, line), (language, caller, callee, line) and (language, import) of each source, names without the key.
_SYMBOLS = (("rs", "inner", "module", 1), ("rs", "leaf", "function", 2), ("rs", "top", "function", 4), ("rs", "P", "struct", 9), ("py", "A", "class", 2), ("py", "run", "method", 3), ("py", "helper", "function", 6), ("ts", "C", "class", 2), ("ts", "run", "method", 3), ("ts", "helper", "function", 5),
            ("go", "T", "struct", 3), ("go", "Run", "method", 4), ("go", "helper", "function", 5), ("java", "J", "class", 2), ("java", "J", "constructor", 3), ("java", "run", "method", 4), ("java", "helper", "method", 5), ("cpp", "S", "struct", 2), ("cpp", "helper", "function", 3), ("cpp", "run", "function", 4))
_CALLED = (("rs", "top", "leaf", 5), ("py", "run", "helper", 4), ("ts", "run", "helper", 3), ("go", "Run", "helper", 4), ("go", "helper", "Println", 5), ("java", "run", "helper", 4), ("cpp", "run", "helper", 4))
_IMPORTED = (("py", "os"), ("py", "path"), ("ts", "./lib"), ("go", "fmt"), ("java", "a"), ("java", "b"), ("java", "C"), ("cpp", "x.h"))
_values = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
_PLAIN = "('C', 'Println')"
_SRC = f"so AS (SELECT p_partkey AS k, [{', '.join(repr(e) for e in _CODE)}][p_partkey % {len(_CODE)} + 1] AS ext FROM part)"
_of = lambda c: f"CASE WHEN {c} IN {_PLAIN} THEN {c} ELSE {c} || k END"

ORACLES = {
    "extracted_symbols": f"WITH {_SRC} SELECT 'src/f' || k || '.' || so.ext AS rel, {_of('v.name')} AS name, v.kind, v.line AS start_line FROM so JOIN (VALUES {_values(_SYMBOLS)}) AS v(ext, name, kind, line) ON v.ext = so.ext",
    "extracted_calls": f"WITH {_SRC} SELECT 'src/f' || k || '.' || so.ext AS rel, {_of('v.a')} AS caller, {_of('v.b')} AS callee, v.line FROM so JOIN (VALUES {_values(_CALLED)}) AS v(ext, a, b, line) ON v.ext = so.ext",
    "extracted_imports": f"WITH {_SRC} SELECT 'src/f' || k || '.' || so.ext AS rel, v.name FROM so JOIN (VALUES {_values(_IMPORTED)}) AS v(ext, name) ON v.ext = so.ext",
    "ignored_paths": f"""WITH p AS (SELECT p_partkey, p_partkey % {len(PLACES)} AS n, replace([{', '.join(f"'{x}'" for x in PLACES)}][p_partkey % {len(PLACES)} + 1], 'K', p_partkey::VARCHAR) AS rel FROM part)
        SELECT p_partkey, rel, CASE WHEN n IN (0, 2, 4, 5, 8, 11) THEN true WHEN n = 10 THEN p_partkey < 10 ELSE false END AS ignored FROM p""",
    "slug_unique": """WITH s AS (SELECT p_brand, p_partkey, trim(regexp_replace(regexp_replace(lower(p_type || ' & Co_'), '[^\\p{L}\\p{N} _-]', '', 'g'), '[ _-]+', '-', 'g'), '-') AS slug FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, slug ORDER BY p_partkey) - 1 AS n FROM s)
        SELECT p_brand, p_partkey, CASE WHEN n > 0 THEN slug || '-' || n ELSE slug END AS slug FROM r""",
    "doc_sections": """WITH s AS (SELECT *, trim(regexp_replace(regexp_replace(lower(p_type), '[^\\p{L}\\p{N} _-]', '', 'g'), '[ _-]+', '-', 'g'), '-') AS slug FROM part)
        SELECT p_partkey, 0 AS pos, p_type AS heading, 1 AS depth, slug, regexp_replace(p_name, '[^A-Za-z]', '_', 'g') || ',mod.Run' AS mentions, '' AS links FROM s UNION ALL SELECT p_partkey, 1, p_type, 2, slug || '-1', '', '../x.md' FROM s""",
    "triples_export": f"WITH {_TRI} SELECT * FROM tr",
    "turtle_lines": f"WITH {_TRI} SELECT '<' || s || '> ' || p || ' ' || CASE WHEN o_kind = 'literal' THEN '\"' || o || '\"' WHEN o = 'geo:Region' THEN o ELSE '<' || o || '>' END || ' .' AS value FROM tr WHERE p = 'geo:name' OR p = 'geo:in' OR o = 'geo:Region'",
    "shape_violations": _VIO,
    "shape_conforms": f"SELECT count(*) = 0 AS conforms, count(*) AS violations FROM ({_VIO})",
    "chunk_assignment": f"""WITH RECURSIVE {_TRI}, ty AS (SELECT DISTINCT s AS o2, o AS class FROM tr WHERE p = 'rdf:type'), co AS (SELECT o2, sum(strlen(o2) + 8 + strlen(class) + 12) AS cost FROM ty GROUP BY 1),
        ln AS (SELECT DISTINCT s, o AS o2 FROM tr WHERE p = 'geo:lives'), mo AS (SELECT s, sum(cost) AS more FROM ln JOIN co USING (o2) GROUP BY 1),
        su AS (SELECT s, sum(strlen(s) + strlen(p) + strlen(o) + 12) + coalesce(any_value(more), 0) AS b FROM tr LEFT JOIN mo USING (s) GROUP BY s),
        po AS (SELECT s, b, row_number() OVER (ORDER BY s) - 1 AS pos, sum(b) OVER (ORDER BY s) AS upto FROM su),
        nx AS (SELECT a.pos, greatest(a.pos + 1, coalesce(min(c.pos), (SELECT count(*) FROM po))) AS nxt FROM po a LEFT JOIN po c ON c.upto > a.upto - a.b + 4000 GROUP BY a.pos),
        st(pos) AS (SELECT 0::BIGINT UNION ALL SELECT nxt FROM st JOIN nx USING (pos) WHERE nxt < (SELECT count(*) FROM po)),
        ho AS (SELECT s, (SELECT count(*) - 1 FROM st WHERE st.pos <= po.pos) AS chunk FROM po),
        al AS (SELECT chunk, s, false AS carried FROM tr JOIN ho USING (s) UNION ALL
               SELECT w.chunk, w.o2, true FROM (SELECT DISTINCT h.chunk, ln.o2 FROM ln JOIN ho h USING (s)) w JOIN ho g ON g.s = w.o2 AND g.chunk <> w.chunk JOIN ty ON ty.o2 = w.o2)
        SELECT chunk, min(s) FILTER (WHERE NOT carried) AS first, count(*) AS rows, sum(carried::BIGINT)::BIGINT AS carried FROM al GROUP BY chunk""",
    "iri_dedupe": "SELECT p_brand || '/' || p_size AS iri, min(p_partkey) AS p_partkey, arg_min(p_type, p_partkey) AS kind, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS kinds FROM part GROUP BY 1",
    "mention_links": """WITH s AS (SELECT p_partkey AS node, p_size, replace(p_brand, '#', '_') AS stem FROM part), m AS (SELECT p_partkey AS mention, p_size, CASE WHEN p_partkey % 2 = 0 THEN replace(p_brand, '#', '_') END AS q FROM part)
        SELECT mention, node FROM m JOIN s USING (p_size) WHERE q IS NULL OR stem = q""",
    "commands": f"WITH {_COMMANDS_SQL} SELECT * FROM co",
    "action_scope": f"""WITH {_COMMANDS_SQL} SELECT event_id, class || ':' || target AS action, NOT target = 'r13' AND (class = 'host' AND target LIKE 'web1%' OR class = 'repo' OR class = 'service' AND length(target) = 4) AS inside FROM co WHERE target IS NOT NULL""",
    "stems": """SELECT p_partkey, 'a/b' || p_size || '/' || v.path AS rel, coalesce(v.stem, 'b' || p_size) AS stem, v.language, v.vendored FROM part JOIN (VALUES (0, 'mod.rs', NULL, 'rust', false), (1, '__init__.py', NULL, 'python', false), (2, 'main.go', 'main', 'go', false), (3, 'x.min.js', 'x.min', 'typescript', true), (4, 'index.ts', NULL, 'typescript', false), (5, 'a.mjs', 'a', 'typescript', false), (6, 'b.jsx', 'b', 'tsx', false), (7, 'types.pyi', 'types', 'python', false), (8, 'v.hxx', 'v', 'cpp', false), (9, 'notes.md', 'notes', NULL, false), (10, 'dist/out.cts', 'out', 'typescript', false), (11, 'vendored/lib.c', 'lib', 'cpp', true), (12, 'thirdparty/z.cc', 'z', 'cpp', true), (13, 'myvendor/q.java', 'q', 'java', false), (14, 'bundle-min.css', 'bundle-min', NULL, true), (15, 'x.min', 'x', NULL, false), (16, '.rs', '.rs', NULL, false), (17, 'Upper.RS', 'Upper', NULL, false)) AS v(n, path, stem, language, vendored) ON v.n = p_partkey % 18""",
}
