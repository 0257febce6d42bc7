"""Buffers, builds and edit planes on small hand-made inputs."""

import json

import pytest

from skein.operators import build, hooks, verify


def kinds(proposed, baseline=None):
    return [(check, symbol) for check, symbol, *_ in verify.introduced(proposed, baseline)]


def test_only_what_the_edit_brings_in():
    assert kinds("fn f() { old(1); }", "fn g() { old(1, 2); }") == [("name", "old")]
    assert kinds("fn f() { old(1); fresh(); }", "fn g() { old(1); }") == [("name", "fresh")]
    assert kinds("fn f() { x.m(); a::b(); gen::<T>(); Some(1); vec![lost(1)]; }\n#[cfg(test)]\nfn g() {}") == []
    assert kinds('// gone()\n/* gone() */ fn f() { let s = "gone()"; if (true) {} }') == []


def test_bound_names():
    text = "use a::{b, c as d};\nfn f(run: fn(u8) -> u8, (l, r): (F, F)) {\n let mut w: Vec<u8> = z;\n b(); d(); run(1); l(); r(); w(2); z(3);\n}"
    assert kinds(text) == [("name", "z")]


@pytest.mark.parametrize("args, n", [("", 0), ("1,", 1), ("g::<A, B>(1), 2", 2), ("|a, b| a + b, 1", 2), ('"x, y", \',\', [1, 2]', 3), ("a < b, c > d", 2)])
def test_arity(args, n):
    assert [c["arity"] for c in verify.analyze(f"fn f() {{ t({args}); }}")["calls"] if c["name"] == "t"] == [n]


def test_parameters():
    found = verify.analyze("impl S { fn m<'a, T: Fn(u8, u8)>(&'a mut self, x: HashMap<K, V>, y: fn(u8) -> u8) {} }\nfn free(a: u8, b: [u8; 2],) {}")["functions"]
    assert [(f["name"], f["params"], f["takes_self"]) for f in found if f["name"] == "free"] == [("free", 2, False)]
    truck = "trait Haul { fn load(&mut self, crates: u32, late: bool) -> bool; fn rest(&self) {} }\n"
    assert kinds(truck + "fn day() { load(7, false); rest(); }") == [] and kinds(truck + "fn day() { park(); }") == [("name", "park")]
    assert kinds("fn t(a: u8) {}\nmod x { fn t(a: u8, b: u8) {} }\nfn f() { t(1, 2, 3); }") == []


@pytest.mark.parametrize("broken", ["fn f() { b(1, ", "fn f( { }", "", "}}}", 'fn f() { "', "use x", "let"])
def test_broken_buffers_are_read_as_far_as_they_go(broken):
    assert set(verify.analyze(broken)) == {"functions", "calls", "modules", "bound"}


def test_verdicts(spark):
    edits = spark.createDataFrame([(1, "a/x.rs", "mod y; mod z; mod q;", None), (2, "x.py", "gone()", None), (3, "b.rs", None, None), (4, "b.rs", "fn f() { known(); gone(); }", None)], "key int, rel string, proposed string, baseline string")
    known = spark.createDataFrame([("known",), (None,)], "name string")
    files = spark.createDataFrame([("a/y.rs",), ("a/z/mod.rs",), ("q.rs",)], "rel string")
    got = {r.key: [(v.symbol, v.kind) for v in r.violations] for r in verify.verdicts(edits, known, files).collect()}
    assert got == {1: [("q", "unresolved-import")], 2: [], 3: [], 4: [("gone", "identifier-does-not-exist")]}


@pytest.fixture(scope="module")
def tree(spark):
    rows = [("c1000000", "a.rs", "fn low() {}\nfn quiet() {}\n"), ("c1000000", "b.rs", "fn mid() { low(); }\n"), ("c1000000", "c.rs", "fn top() { mid(); }\n"), ("c1000000", "d.py", "def low():\n    pass\ndef user():\n    low()\n"), ("c1000000", "bad.py", "def ("), ("c1000000", "vendor/v.rs", "fn v() { low(); }\n"), ("c2000000", "a.rs", "")]
    blobs = spark.createDataFrame(rows, "commit string, rel string, source string")
    return blobs, spark.createDataFrame([("main", "c1000000"), ("bare", "c2000000")], "ref string, commit string")


def test_builds(spark, tree):
    blobs, refs = tree
    base = build.base(blobs, refs, "main")
    names = {r.node: r.name for r in base.graph.symbols.collect()}
    assert sorted((names[r.src], names[r.dst]) for r in base.graph.edges.collect()) == [("mid", "low"), ("top", "mid"), ("user", "low")]
    assert base.commit == "c1000000" and [r.rel for r in base.graph.skipped.collect()] == ["bad.py"]
    assert {r.rel: r.symbols for r in base.files.collect()} == {"a.rs": ["low", "quiet"], "b.rs": ["mid"], "c.rs": ["top"], "d.py": ["low", "user"], "bad.py": []}
    assert build.resolve(refs, "c200000") == "c2000000" and build.resolve(refs, "c20") is None
    assert build.build_checked(blobs, refs, "bare").symbols.count() == 0 and build.build_at(blobs, refs, "nope").symbols.count() == 0
    with pytest.raises(build.UnresolvedRef):
        build.build_checked(blobs, refs, "nope")
    with pytest.raises(build.NoRepository):
        build.base(blobs, refs.where("false"), "main")


def test_sizing_and_decisions(spark, tree):
    g = build.build_checked(*tree, "main")
    files = tree[0].where("commit = 'c1000000'").selectExpr("rel", "source", "rel <> 'bad.py' AS parsed")
    rows = [(1, "a.rs", ["fn low"]), (2, "a.rs", ["fn quiet"]), (3, "a.rs", ["nowhere"]), (4, "a.rs", []), (5, "n.txt", []), (6, "new.rs", []), (7, "bad.py", []), (8, "c.rs", ["top"])]
    edits = spark.createDataFrame(rows, "key int, rel string, anchors array<string>")
    got = {r.key: (r.kind, r.symbols, r.files) for r in hooks.sizing(edits, files, g.symbols, g.edges).collect()}
    assert got == {1: ("measured", 2, 2), 2: ("measured", 0, 0), 3: ("measured", 2, 2), 4: ("measured", 2, 2), 5: ("no-grammar", None, None), 6: ("unreadable", None, None), 7: ("no-grammar", None, None), 8: ("measured", 0, 0)}

    full = edits.selectExpr("key", "'s' AS session", "CASE WHEN key = 8 THEN 'other' ELSE 'me' END AS tenant", "rel", "anchors", "CASE WHEN key = 2 THEN '// TODO' ELSE '' END AS text", "CAST(NULL AS string) AS proposed", "CAST(NULL AS string) AS baseline")
    rules = [{"name": "todo", "pattern": "TODO"}]
    scopes = {"me": hooks.Scope(deny=["bad*"], max_symbols=1)}
    run = lambda **kw: {r.key: (r.outcome, r.rule) for r in hooks.pre_edit(full, rules, files, g.symbols, g.edges, scopes, **kw).collect()}
    assert run() == {1: ("deny", "max-symbols"), 2: ("notify", "todo"), 3: ("deny", "max-symbols"), 4: ("deny", "max-symbols"), 5: ("notify", "unmeasured"), 6: ("notify", "unmeasured"), 7: ("deny", "deny_paths:bad*"), 8: ("notify", "unscoped")}
    assert run(mode="advise")[1] == ("notify", "max-symbols")
    assert set(run(mode="off").values()) == {("allow", None)}
    named = {"name": "no-todo", "language": "rust", "query": "(line_comment) @c", "pattern": "TODO", "match_type": "must-not-match"}
    assert run(structural=[named])[2] == ("deny", "no-todo")
    soft, hard, late = named | {"class": "soft"}, named | {"name": "gone", "effect": "mystery"}, named | {"name": "late", "verification_point": "PAA"}
    assert run(governed=[soft, hard, late])[2] == ("deny", "gone+no-todo+todo")
    none = hooks.pre_edit(full, [], files, g.symbols, g.edges, {}).collect()
    assert sorted(r.outcome for r in none) == ["allow"] * 7 + ["notify"]


def test_payloads_and_envelopes(spark):
    rows = [(1, '{"cwd":"/w","tool_input":{"file_path":"/w/a.rs","old_string":"x","new_string":"y"}}'), (2, "not json"), (3, '{"tool_input":{}}'), (4, None), (5, '{"tool_input":{"file_path":"b.rs"}}')]
    got = {r.key: (r.rel, r.anchors, r.text) for r in hooks.payloads(spark.createDataFrame(rows, "key int, value string")).collect()}
    assert got == {1: ("a.rs", ["x"], "y"), 5: ("b.rs", [], "")}
    from pyspark.sql import functions as F

    deny, tell = spark.range(1).select(hooks.deny_envelope(F.lit('a"b')), hooks.notice_envelope(F.lit("n"))).first()
    assert json.loads(deny)["hookSpecificOutput"]["permissionDecisionReason"] == 'a"b' and json.loads(tell) == {"systemMessage": "n"}
    assert [json.loads(r.value) for r in hooks.json_lines(spark.range(1)).collect()] == [{"id": 0}]
