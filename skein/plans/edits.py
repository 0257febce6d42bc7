"""Queries of the edit planes: every part is a Rust file whose function calls those of half and a third of its key.

Rare parts (by size) are files of another kind, and each part is edited once; tenants go by key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import build, hooks, verify
from skein.plans.tables import read


def _key():
    return F.col("p_partkey")


def _part(spark, d):
    return read(spark, d, "part", "p_partkey", "p_size", "p_brand")


def _files(spark, d):
    """(key, rel, source, language): sizes over 48 are text files, those over 46 hold no symbol, those over 44 have no source."""
    p = _part(spark, d)
    rel = F.concat(F.lit("src/m"), (_key() % 10).cast("string"), F.lit("/p"), _key(), F.when(F.col("p_size") > 48, ".txt").otherwise(".rs"))
    code = F.concat(F.lit("fn p"), _key(), F.lit("() {\n    p"), F.floor(_key() / 2), F.lit("();\n    p"), F.floor(_key() / 3), F.lit("();\n}\n"))
    source = F.when(F.col("p_size") > 48, "p1();").when(F.col("p_size") > 46, "// nothing\n").when(F.col("p_size") > 44, F.lit(None).cast("string")).otherwise(code)
    return p.select(_key().alias("key"), "p_size", rel.alias("rel"), source.alias("source"))


FILES_SQL = """fi AS (SELECT p_partkey AS key, p_size, 'src/m' || p_partkey % 10 || '/p' || p_partkey || CASE WHEN p_size > 48 THEN '.txt' ELSE '.rs' END AS rel,
     CASE WHEN p_size > 48 THEN 'p1();' WHEN p_size > 46 THEN '// nothing' || chr(10) WHEN p_size > 44 THEN NULL
          ELSE 'fn p' || p_partkey || '() {' || chr(10) || '    p' || p_partkey // 2 || '();' || chr(10) || '    p' || p_partkey // 3 || '();' || chr(10) || '}' || chr(10) END AS source FROM part),
     good AS (SELECT key, rel FROM fi WHERE p_size <= 44),
     calls AS (SELECT a.key AS src, b.key AS dst FROM good a JOIN good b ON b.key = a.key // 2 UNION ALL SELECT a.key, b.key FROM good a JOIN good b ON b.key = a.key // 3 )"""


def _blobs(spark, d):
    f = _files(spark, d).where("source IS NOT NULL")
    blobs = f.select(F.lit("c0ffee0123456789").alias("commit"), "rel", "source").unionByName(f.select(F.lit("c0ffee9876543210").alias("commit"), "rel", F.lit("fn old() {}\n").alias("source")))
    refs = spark.sql("SELECT * FROM VALUES ('main', 'c0ffee0123456789'), ('old', 'c0ffee9876543210') AS t(ref, commit)")
    return blobs, refs


def _graph(spark, d):
    return build.build_checked(*_blobs(spark, d), "main")


def built_graph(spark, d):
    """Symbols with the calls out of and into each."""
    g = _graph(spark, d)
    n = lambda end, name: g.edges.groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias(name))
    return g.symbols.join(n("src", "calls"), "node", "left").join(n("dst", "callers"), "node", "left").fillna(0).select("file", "name", "start_line", "end_line", "calls", "callers")


def base_files(spark, d):
    b = build.base(*_blobs(spark, d), "c0ffee01")
    return b.files.select("rel", "hash", F.array_join("symbols", ",").alias("symbols"), F.lit(b.commit).alias("commit"))


def edit_cycles(spark, d):
    """Every file is edited: what its change reaches within two hops."""
    g = _graph(spark, d)
    out = build.edit_cycle(g.symbols, g.edges, g.symbols.select("file").distinct(), hops=2, fan_limit=None)
    return out.select("file", "symbols", F.array_join("advised", ",").alias("advised"), F.size("files").alias("files"), "frontier")


def _buffers(spark, d):
    """(key, rel, proposed, baseline): calls of a name by key that odd sizes lack, in one of seven surroundings."""
    p = _part(spark, d)
    call = F.concat(F.lit("h"), _key())
    kind = _key() % 7
    body = (
        F.when(kind == 0, F.concat(F.lit("fn f() { "), call, F.lit("(1); }")))
        .when(kind == 1, F.concat(F.lit("use other::"), call, F.lit(";\nfn f() { "), call, F.lit("(1); }")))
        .when(kind == 2, F.concat(F.lit("fn f(x: T) { x."), call, F.lit("(); other::"), call, F.lit('(); println!("{}", '), call, F.lit("()); }")))
        .when(kind == 3, F.concat(F.lit("fn two(a: u8, b: Vec<(u8, u8)>) {}\nfn f() { two(1, vec![(1, 2)]); two("), F.when(_key() % 2 == 0, F.lit('"a, b"')).otherwise("1, 2"), F.lit("); }")))
        .when(kind == 4, F.concat(F.lit("mod m"), _key(), F.lit(";\nmod own { fn g() {} }")))
        .when(kind == 5, F.concat(F.lit("fn f() {\n  old(1);\n  "), call, F.lit("(1);\n}")))
        .otherwise(F.concat(F.lit("// "), call, F.lit("()\nfn f() { let "), call, F.lit(" = |x| x; "), call, F.lit("(1); }")))
    )
    return p.select(_key().alias("key"), F.concat(F.lit("src/e"), _key(), F.lit(".rs")).alias("rel"), body.alias("proposed"), F.when(kind == 5, "fn f() { old(1); }").alias("baseline"))


def buffer_verdicts(spark, d):
    p = _part(spark, d)
    known = p.where("p_size % 2 = 0").select(F.concat(F.lit("h"), _key()).alias("name"))
    files = p.where("p_size % 3 = 0").select(F.concat(F.lit("src/m"), _key(), F.when(_key() % 2 == 0, "/mod.rs").otherwise(".rs")).alias("rel"))
    out = verify.verdicts(_buffers(spark, d), known, files)
    return out.select("key", "rel", "ok", F.array_join(F.transform("violations", lambda v: F.concat_ws(":", v["kind"], v["symbol"], v["line"].cast("string"))), ",").alias("found"))


def _edits(spark, d):
    """(key, tenant, session, rel, anchors, text, late, proposed, baseline)."""
    f = _files(spark, d)
    anchors = F.when(F.col("key") % 3 == 0, F.array(F.concat(F.lit("p"), F.floor(F.col("key") / 3), F.lit("();")))).when(F.col("key") % 3 == 1, F.array(F.lit("nowhere"))).otherwise(F.array().cast("array<string>"))
    text = F.when(F.col("key") % 17 == 0, F.concat(F.lit("ask a"), "key", F.lit("@example.org"))).when(F.col("key") % 19 == 0, F.lit("TODO")).otherwise("plain")
    proposed = F.when(F.col("key") % 23 == 0, "fn f() { gone(1); }")
    return f.select("key", F.concat(F.lit("t"), (F.col("key") % 4).cast("string")).alias("tenant"), F.concat(F.lit("s"), (F.col("key") % 100).cast("string")).alias("session"), "rel", anchors.alias("anchors"), text.alias("text"), (F.col("key") % 29 == 0).alias("late"), proposed.alias("proposed"), F.lit(None).cast("string").alias("baseline"))


def _sources(spark, d):
    return _files(spark, d).select("rel", "source", F.lit(True).alias("parsed"))


def edit_sizing(spark, d):
    g = _graph(spark, d)
    return hooks.sizing(_edits(spark, d), _sources(spark, d), g.symbols, g.edges, hops=2)


RULES = [{"name": "mail", "pattern": r"[a-z0-9]+@[a-z]+\.[a-z]+", "tier": "block"}, {"name": "todo", "pattern": "TODO", "tier": "warn"}]
SCOPES = {"t0": hooks.Scope(), "t1": hooks.Scope(allow=["src/**"], deny=["src/m3/*", "src/m5/**"]), "t2": hooks.Scope(allow=["src/m[0-7]/*"], max_symbols=8, max_files=20)}


def pre_edit(spark, d):
    g = _graph(spark, d)
    out = hooks.pre_edit(_edits(spark, d), RULES, _sources(spark, d), g.symbols, g.edges, SCOPES, hops=2)
    return out.select("key", "outcome", "plane", "rule", F.size("constraints").alias("constraints"), "freshness")


def payload_edits(spark, d):
    """Payloads of four forms, read back: single edits, many edits, whole files, and broken or pathless ones (left out)."""
    p = _part(spark, d)
    path = F.concat(F.when(_key() % 2 == 0, "/w/").otherwise("/other/"), F.lit("p"), _key(), F.lit(".rs"))
    q = lambda name, v: F.concat(F.lit(f'"{name}":"'), v, F.lit('"'))
    tool = (
        F.when(_key() % 4 == 0, F.concat(q("file_path", path), F.lit(","), q("old_string", F.lit("a")), F.lit(","), q("new_string", F.lit("b"))))
        .when(_key() % 4 == 1, F.concat(q("file_path", path), F.lit(',"edits":[{"old_string":"x","new_string":"y"},{"old_string":"z","new_string":"w"}]')))
        .when(_key() % 4 == 2, F.concat(q("file_path", path), F.lit(","), q("content", F.lit("whole"))))
        .otherwise(q("command", F.lit("ls")))
    )
    value = F.concat(F.lit('{"session_id":"s","cwd":"/w","tool_input":{'), tool, F.when(_key() % 8 == 0, "").otherwise("}}"))
    out = hooks.payloads(p.select(_key().alias("key"), value.alias("value")))
    return out.select("key", "rel", F.array_join("anchors", ",").alias("anchors"), "text")


def post_audit(spark, d):
    f = _files(spark, d).where("source IS NOT NULL").select("rel", "source", F.when(F.col("rel").endswith(".rs"), "rust").alias("language"), F.lit("s1").alias("scope"))
    found = [{"name": "few-calls", "language": "rust", "pattern": r"p[0-9]+\(\);", "backoff": "exp(min(overage / 2, 6))"}, {"name": "no-old", "language": "rust", "paths": ["src/m1/*"], "pattern": r"old\("}]
    return hooks.post_audit(f, found, 1000)


def out_of_ground(spark, d):
    """Events as edits of users' items, half of their paths already theirs."""
    ev = read(spark, d, "events", "event_id", "user_id", "event_type")
    item = F.concat(F.lit("i"), (F.col("user_id") % 50).cast("string"))
    path = F.concat("event_type", F.lit("/"), (F.col("event_id") % 20).cast("string"))
    prior = ev.where("user_id % 50 < 25 AND event_id % 2 = 0").select(item.alias("item"), path.alias("path"), F.when(F.col("user_id") % 50 % 2 == 0, "done").alias("outcome"))
    out = hooks.out_of_ground(ev.select(F.col("event_id").alias("key"), item.alias("item"), path.alias("rel")), prior, prior)
    return out.select("key", "item", "rel", F.array_join("prior", ",").alias("prior"))


def provenance_chain(spark, d):
    """Orders as commits: they implement their customer and modify the parts of their lines."""
    o, li, c, p = (read(spark, d, *t) for t in (("orders", "o_orderkey", "o_custkey"), ("lineitem", "l_orderkey", "l_partkey"), ("customer", "c_custkey"), ("part", "p_partkey", "p_brand")))
    t = lambda rows, s, name, v: rows.select(s.alias("s"), F.lit(name).alias("p"), v.cast("string").alias("o"))
    tag = lambda letter, col: F.concat(F.lit(letter), col)
    triples = t(o, tag("o", "o_orderkey"), "implements", tag("c", "o_custkey")).unionByName(t(li, tag("o", "l_orderkey"), "modifies", tag("p", "l_partkey"))).unionByName(t(c, tag("c", "c_custkey"), "identifier", F.col("c_custkey"))).unionByName(t(p, tag("p", "p_partkey"), "path", F.col("p_brand")))
    found = hooks.provenance_chain(triples, "implements", "modifies", "path", "identifier")
    return found.groupBy("item").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("commit").alias("commits"), F.count_distinct("path").alias("paths"))


def rule_set_states(spark, d):
    p = _part(spark, d)
    return p.select(_key().alias("key"), hooks.rule_set_state(_key() % 5 != 0, F.when(_key() % 3 != 0, _key() % 2), F.when(_key() % 7 == 0, "down"), F.when(_key() % 4 == 0, _key())).alias("state"))


def policy_statuses(spark, d):
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    return hooks.policy_status(c.select(F.col("c_custkey").alias("tenant")), c.where("c_nationkey < 12").select(F.col("c_custkey").alias("tenant")), "enforce")


def query_texts(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_name", "p_type")
    odd = F.concat("p_name", F.lit('"\\'), "p_type", F.lit("/a.rs"))
    return p.select("p_partkey", hooks.query_literal(odd).alias("literal"), hooks.query_id(odd).alias("id"), hooks.deny_envelope(F.col("p_name")).alias("deny"), hooks.notice_envelope(F.col("p_name")).alias("notice"))


QUERIES = {f.__name__: f for f in (built_graph, base_files, edit_cycles, buffer_verdicts, edit_sizing, pre_edit, payload_edits, post_audit, out_of_ground, provenance_chain, rule_set_states, policy_statuses, query_texts)}

_NEAR = """near(a, b) AS (SELECT src, dst FROM calls WHERE src <> dst), far AS (SELECT a, b FROM near UNION SELECT x.a, y.b FROM near x JOIN near y ON y.a = x.b)"""
_SIZES = """ed AS (SELECT fi.*, key % 29 = 0 AS late, CASE WHEN key % 29 = 0 THEN 'deadline' WHEN p_size > 48 THEN 'no-grammar' WHEN p_size > 46 THEN 'no-anchors' WHEN p_size > 44 THEN 'unreadable' ELSE 'measured' END AS kind FROM fi),
    sz AS (SELECT e.key, e.rel, e.kind, CASE WHEN e.kind = 'measured' THEN count(DISTINCT f.a) END AS symbols, CASE WHEN e.kind = 'measured' THEN count(DISTINCT f.a) END AS files FROM {src} e LEFT JOIN far f ON f.b = e.key AND f.a <> e.key GROUP BY e.key, e.rel, e.kind)"""

ORACLES = {
    "built_graph": f"WITH {FILES_SQL} SELECT rel AS file, 'p' || key AS name, 1::INTEGER AS start_line, 4::INTEGER AS end_line, (SELECT count(*) FROM calls WHERE src = g.key AND src <> dst) AS calls, (SELECT count(*) FROM calls WHERE dst = g.key AND src <> dst) AS callers FROM good g",
    "base_files": f"WITH {FILES_SQL} SELECT rel, sha256(source) AS hash, CASE WHEN p_size <= 44 THEN 'p' || key ELSE '' END AS symbols, 'c0ffee0123456789' AS commit FROM fi WHERE p_size <= 44 OR p_size IN (47, 48)",
    "edit_cycles": f"""WITH {FILES_SQL}, {_NEAR}, around AS (SELECT a AS n, b AS m FROM far UNION SELECT b, a FROM far)
        SELECT rel AS file, 1::BIGINT AS symbols, CASE WHEN EXISTS (SELECT 1 FROM near WHERE b = g.key) THEN 'p' || key ELSE '' END AS advised, (SELECT count(DISTINCT a) FROM near WHERE b = g.key)::INTEGER AS files,
               (SELECT count(DISTINCT m) FROM around WHERE n = g.key AND m <> g.key) AS frontier FROM good g""",
    "buffer_verdicts": """WITH b AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 7 = 0 AND p_size % 2 = 1 THEN 'identifier-does-not-exist:h' || p_partkey || ':1' WHEN p_partkey % 7 = 3 AND p_partkey % 2 = 0 THEN 'wrong-arity:two:2'
            WHEN p_partkey % 7 = 4 AND p_size % 3 <> 0 THEN 'unresolved-import:m' || p_partkey || ':0' WHEN p_partkey % 7 = 5 AND p_size % 2 = 1 THEN 'identifier-does-not-exist:h' || p_partkey || ':3' ELSE '' END AS found FROM part)
        SELECT key, 'src/e' || key || '.rs' AS rel, found = '' AS ok, found FROM b""",
    "edit_sizing": f"WITH {FILES_SQL}, {_NEAR}, {_SIZES.format(src='ed')} SELECT * FROM sz",
    "pre_edit": f"""WITH {FILES_SQL}, {_NEAR}, {_SIZES.format(src='ed')},
        x AS (SELECT sz.*, key % 4 AS t, key % 10 AS m, key % 100 AS s, CASE WHEN key % 17 = 0 THEN 'deny:rules:mail' WHEN key % 19 = 0 THEN 'notify:rules:todo' WHEN key % 23 = 0 AND rel LIKE '%.rs' THEN 'deny:verify:verify:identifier-does-not-exist'
              WHEN key % 4 = 1 AND key % 10 = 3 THEN 'deny:paths:deny_paths:src/m3/*' WHEN key % 4 = 1 AND key % 10 = 5 THEN 'deny:paths:deny_paths:src/m5/**' WHEN key % 4 = 2 AND key % 10 > 7 THEN 'deny:paths:allow_paths' END AS early FROM sz),
        y AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN t = 3 AND row_number() OVER (PARTITION BY early IS NULL, t, s ORDER BY key) = 1 THEN 'notify:paths:unscoped' WHEN t = 2 AND kind <> 'measured' THEN 'notify:radius:unmeasured'
              WHEN t = 2 AND symbols > 8 THEN 'deny:radius:max-symbols' || CASE WHEN files > 20 THEN '+max-files' ELSE '' END END AS got FROM x)
        SELECT key, coalesce(split_part(got, ':', 1), 'allow') AS outcome, split_part(got, ':', 2) AS plane, regexp_replace(got, '^[a-z]+:[a-z]+:', '') AS rule, (got IS NOT NULL)::INTEGER AS constraints, 'fresh' AS freshness FROM y""",
    "payload_edits": """SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'p' || p_partkey || '.rs' ELSE '/other/p' || p_partkey || '.rs' END AS rel, CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'x,z' ELSE '' END AS anchors,
        CASE p_partkey % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'y' || chr(10) || 'w' ELSE 'whole' END AS text FROM part WHERE p_partkey % 4 <> 3 AND p_partkey % 8 <> 0""",
    "post_audit": f"""WITH {FILES_SQL}, r AS (SELECT *, 'few-calls' AS rule, len(regexp_extract_all(source, 'p[0-9]+\\(\\);'))::INTEGER AS found FROM fi WHERE rel LIKE '%.rs' AND source IS NOT NULL UNION ALL SELECT *, 'no-old', 0 FROM fi WHERE rel LIKE 'src/m1/%.rs' AND source IS NOT NULL),
        z AS (SELECT *, CASE WHEN found > 0 THEN floor(exp(least(found / 2.0, 6.0)))::BIGINT END AS secs FROM r)
        SELECT rel, 's1' AS scope, rule, CASE WHEN found > 0 THEN 'unsatisfied' ELSE 'satisfied' END AS outcome, CASE WHEN found > 0 THEN 'warned' ELSE 'logged' END AS response, found, secs, secs + 1000 AS until FROM z""",
    "out_of_ground": """WITH e AS (SELECT event_id, user_id % 50 AS i, event_type || '/' || event_id % 20 AS rel FROM events), g AS (SELECT DISTINCT i, 'i' || i AS item, rel, CASE WHEN i % 2 = 0 THEN 'done' ELSE 'open' END AS o FROM e WHERE i < 25 AND event_id % 2 = 0),
        l AS (SELECT rel, string_agg(item || ':' || o, ',' ORDER BY item) AS prior FROM (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY item) AS n FROM g) WHERE n <= 5 GROUP BY rel)
        SELECT event_id AS key, 'i' || i AS item, e.rel, coalesce(prior, '') AS prior FROM e LEFT JOIN l ON l.rel = e.rel WHERE i IN (SELECT i FROM g) AND NOT EXISTS (SELECT 1 FROM g WHERE g.i = e.i AND g.rel = e.rel)""",
    "provenance_chain": """SELECT c_custkey::VARCHAR AS item, count(DISTINCT (o_orderkey, l_partkey)) AS links, count(DISTINCT o_orderkey) AS commits, count(DISTINCT p_brand) AS paths
        FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    "rule_set_states": "SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN 'off' WHEN p_partkey % 7 = 0 AND p_partkey % 4 = 0 THEN 'stale' WHEN p_partkey % 7 = 0 OR p_partkey % 3 = 0 THEN 'degraded' WHEN p_partkey % 2 = 0 THEN 'empty' ELSE 'loaded' END AS state FROM part",
    "policy_statuses": "SELECT c_custkey AS tenant, 'enforce' AS mode, bool_or(coalesce(c_nationkey < 12, false)) AS scope_configured, NOT bool_or(coalesce(c_nationkey < 12, false)) AS enforcing_without_scope FROM customer GROUP BY 1",
    "query_texts": """SELECT p_partkey, p_name || '\\"\\\\' || p_type || '/a.rs' AS literal, regexp_replace(p_name || p_type || 'ars', '[^A-Za-z0-9_-]', '', 'g') AS id, '{"hookSpecificOutput":{"hookEventName":"PreToolUse","permissionDecision":"deny","permissionDecisionReason":"' || p_name || '"}}' AS deny, '{"systemMessage":"' || p_name || '"}' AS notice FROM part""",
}
