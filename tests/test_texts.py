import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein import sources, streaming
from skein.operators import docs, extract, rules
from skein.plans.exports import _CODE


def test_sections():
    text = "`pre::Fix` intro\n# Title `run`\n```\n# not\n```\n~~~\n`no`\n~~~\n## Title\n[a](b.md) ``x`y``  `A.b()`\n####### deep\n"
    out = docs.sections_of(text)
    assert [(s["heading"], s["depth"]) for s in out] == [(None, 0), ("Title `run`", 1), ("Title", 2)]
    assert out[0]["mentions"] == [{"symbol": "Fix", "qualifier": "pre"}] and out[1]["mentions"] == [{"symbol": "run", "qualifier": None}]
    assert out[2]["mentions"] == [{"symbol": "b", "qualifier": "A"}] and out[2]["links"] == ["b.md"] and docs.sections_of(None) == []


def test_mention_links_make_no_pairs_but_those_they_return(spark, monkeypatch):
    monkeypatch.setattr(docs, "PART", 4)
    r = random.Random(4)
    pick = lambda n: [(i, r.choice("abc"), r.choice(["Web", "cli", "x", None])) for i in range(n)]
    for again in (False, True):  # ids that stand once, then also repeated ones, with other names
        m, s = pick(40) + [(90, None, "x")], pick(30) + [(None, "a", "x")]
        if again:
            m, s = m + pick(9) + m[:3], s + pick(9) + s[:3] + [(None, "b", "cli")]
        mentions = spark.createDataFrame(m, "mention int, symbol string, qualifier string")
        symbols = spark.createDataFrame([(n, a, f and f"src/{f.upper()}.rs") for n, a, f in s], "node int, name string, file string")
        rows = [(i, n, q is not None and f is not None and q.lower() == f.lower()) for i, a, q in m for n, b, f in s if a is not None and a == b]
        any_fit = {i for i, _, fit in rows if fit}
        got = docs.mention_links(mentions, symbols)
        assert Counter(map(tuple, got.collect())) == Counter({(i, n) for i, n, fit in rows if fit or i not in any_fit})
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and ("Aggregate [mention" in plan) == again


def test_mention_links_send_no_mentions_through_the_driver(spark):
    """Settled tables look small as files; a mention stood there once for every part of its name's nodes."""
    ids = spark.range(4000).withColumnRenamed("id", "mention")
    mentions, symbols = ids.selectExpr("mention", "'a' AS symbol", "IF(mention < 2000, 'x', NULL) AS qualifier"), ids.selectExpr("mention AS node", "'a' AS name", "IF(mention % 2 = 0, 'src/x.rs', 'src/y.rs') AS file")
    got = docs.mention_links(mentions, symbols)
    assert tuple(got.agg(F.count("node"), F.count_distinct("mention"), F.sum("node")).first()) == (2000 * 2000 + 2000 * 4000, 4000, 2000 * sum(range(0, 4000, 2)) + 2000 * sum(range(4000)))
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x, line in zip(plan, plan[1:]) if "BroadcastExchange" in x and ("mention" in line or "node" in line)]


def test_unique_slugs_and_mentions(spark):
    rows = spark.createDataFrame([(1, "# A\n# A\n# B\n# A")], "k int, t string")
    assert [x["slug"] for x in docs.sections(rows, "k", "t").orderBy("pos").collect()] == ["a", "a-1", "b", "a-2"]
    symbols = spark.createDataFrame([(1, "run", "src/cli.rs"), (2, "run", "src/web/mod.rs"), (3, "go", "x.rs")], "node int, name string, file string")
    mentions = spark.createDataFrame([(1, "run", "WEB"), (2, "run", "nothing"), (3, "run", None), (4, "absent", None)], "mention int, symbol string, qualifier string")
    assert sorted(map(tuple, docs.mention_links(mentions, symbols).collect())) == [(1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]


SHAPES = '''@prefix sh: <http://www.w3.org/ns/shacl#> . # the vocabulary
@prefix k: <urn:k#> .
k:LinkShape a sh:NodeShape ; rdfs:comment "links; they \\"point\\"." ; sh:targetSubjectsOf k:links ;
  sh:property [ sh:path k:links ; sh:nodeKind sh:IRI ; sh:minCount 1 ; ] .
k:ThingShape a sh:NodeShape ;
  sh:targetClass k:Thing , k:Other ;
  sh:property [ sh:path k:size ; sh:datatype xsd:integer ; sh:maxCount 1 ] ;
  sh:property [ sh:path k:tag ; sh:datatype xsd:string ; sh:in ( "a" "b c" ) ; sh:pattern "^[ab]" ] ;
  sh:property [ sh:path k:home ; sh:class k:Thing ] .
k:note k:about "nothing"^^xsd:string .
'''


def test_shape_files(spark):
    shapes = docs.read_shapes(SHAPES)
    assert len(shapes) == 7 and docs.class_predicates(shapes) == ["k:home"]
    assert shapes[0] == {"subjects_of": "k:links", "path": "k:links", "min": 1, "node_kind": "iri"}
    assert {"target": "k:Other", "path": "k:tag", "datatype": "xsd:string", "values": ["a", "b c"], "pattern": "^[ab]"} in shapes
    for bad in ('k:X a sh:NodeShape ; sh:property [ sh:path k:p ; sh:uniqueLang true ] .', "k:X a sh:NodeShape ; sh:closed true .", "k:X a"):
        with pytest.raises(ValueError):
            docs.read_shapes(bad)
    t = [("x", "rdf:type", "k:Thing", "iri"), ("y", "rdf:type", "k:Other", "iri"), ("y", "rdf:type", "k:Thing", "iri"), ("x", "k:size", "12", "literal"), ("x", "k:size", "1.5", "literal"), ("y", "k:size", "u", "iri"), ("x", "k:tag", "b c", "literal"), ("y", "k:tag", "c", "literal"),
         ("x", "k:home", "y", "iri"), ("y", "k:home", "z", "iri"), ("z", "k:links", "text", "literal"), ("w", "k:links", "x", "iri"), ("free", "k:tag", "c", "literal")]
    out = docs.shape_violations(spark.createDataFrame(t, "s string, p string, o string, o_kind string"), shapes).collect()
    got = sorted((x["focus"], x["path"], x["constraint"], x["value"]) for x in out)
    both = [("y", "k:home", "class", "z"), ("y", "k:size", "datatype", "u"), ("y", "k:tag", "in", "c"), ("y", "k:tag", "pattern", "c")]  # y is of two target classes
    assert got == sorted([("x", "k:size", "datatype", "1.5"), ("x", "k:size", "maxCount", "2"), ("z", "k:links", "nodeKind", "text"), *both, *both])
    assert docs.shape_violations(spark.createDataFrame([], "s string, p string, o string, o_kind string"), shapes).count() == 0


def test_chunks_are_those_of_a_sequential_packing(spark):
    r = random.Random(6)
    for most, sizes in [(100, [r.choice([1, 5, 30, 99, 100, 101, 450]) for _ in range(120)]), (50, [50] * 9), (10, [])]:
        starts, full = [], 0
        for i, b in enumerate(sizes):
            if i == 0 or full + b > most:
                starts, full = [*starts, i], 0
            full += b
        got = docs.greedy_starts(spark.createDataFrame(list(enumerate(sizes)), "pos long, bytes long").repartition(3), most)
        assert sorted(x["pos"] for x in got.collect()) == starts
    rows = spark.createDataFrame([(i, r.randint(0, 9)) for i in range(95)], "pos long, v long").repartition(4)
    values = {x["pos"]: x["v"] for x in rows.collect()}
    assert {x["pos"]: x["t"] for x in docs.running(rows, "v", "t", block=10).collect()} == {p: sum(values[q] for q in range(p + 1)) for p in values}


def test_shapes_and_chunks(spark):
    t = [("a", "rdf:type", "S", "iri"), ("b", "rdf:type", "S", "iri"), ("m", "rdf:type", "M", "iri"), ("a", "in", "m", "iri"), ("b", "in", "x", "iri"), ("a", "kind", "f", "literal"), ("a", "kind", "g", "literal"), ("b", "tier", "vibes", "literal"), ("b", "calls", "text", "literal")]
    rows = spark.createDataFrame(t, "s string, p string, o string, o_kind string")
    shapes = [{"target": "S", "path": "kind", "min": 1, "max": 1}, {"target": "S", "path": "in", "to_class": "M"}, {"target": "S", "path": "tier", "values": ["treesitter"]}, {"target": "S", "path": "calls", "node_kind": "iri"}]
    out = docs.shape_violations(rows, shapes)
    assert sorted((x["focus"], x["constraint"]) for x in out.collect()) == [("a", "maxCount"), ("b", "class"), ("b", "in"), ("b", "minCount"), ("b", "nodeKind")]
    with pytest.raises(sources.Refused):
        sources.publish(rows, out, lambda r: None)
    many = spark.createDataFrame([(f"s{i:03}", "rdf:type", "S", "iri") for i in range(60)] + [(f"s{i:03}", "code:calls", f"s{(i * 7) % 60:03}", "iri") for i in range(60)], "s string, p string, o string, o_kind string")
    c = docs.chunks(many, 500, ["code:calls"]).collect()
    assert all(sum(len(x["s"]) + len(x["p"]) + len(x["o"]) + 12 for x in c if x["chunk"] == k) <= 500 for k in {x["chunk"] for x in c})
    home = {x["s"]: x["chunk"] for x in c if not x["carried"]}
    held = {(x["chunk"], x["s"]) for x in c if x["p"] == "rdf:type"}
    assert len(set(home.values())) > 5 and sum(not x["carried"] for x in c) == 120
    assert all((home[x["s"]], x["o"]) in held for x in c if x["p"] == "code:calls")
    sub = spark.createDataFrame([("b", "rdfs:subClassOf", "a", "iri"), ("c", "rdfs:subClassOf", "b", "iri"), ("d", "rdfs:subClassOf", "z", "iri")], "s string, p string, o string, o_kind string")
    assert {tuple(x) for x in docs.subclasses(sub, "a").collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert docs.turtle(rows.where("o = 'f'")).first()[0] == '<a> kind "f" .'


WANT = {
    "rs": ({("inner", "module"), ("leaf", "function"), ("top", "function"), ("P", "struct")}, {("top", "leaf")}, []),
    "py": ({("A", "class"), ("run", "method"), ("helper", "function")}, {("run", "helper")}, ["os", "path"]),
    "ts": ({("C", "class"), ("run", "method"), ("helper", "function")}, {("run", "helper")}, ["./lib"]),
    "go": ({("T", "struct"), ("Run", "method"), ("helper", "function")}, {("Run", "helper"), ("helper", "Println")}, ["fmt"]),
    "java": ({("J", "class"), ("J", "constructor"), ("run", "method"), ("helper", "method")}, {("run", "helper")}, ["C", "a", "b"]),
    "cpp": ({("S", "struct"), ("helper", "function"), ("run", "function")}, {("run", "helper")}, ["x.h"]),
}


@pytest.mark.parametrize("ext", sorted(_CODE))
def test_extraction(ext):
    from skein.functions import LANGUAGES

    f = extract.facts(_CODE[ext], LANGUAGES[ext])
    symbols, calls, imports = WANT[ext]
    assert {(s["name"], s["kind"]) for s in f.symbols} == symbols
    assert {(c["caller"], c["callee"]) for c in f.calls} == calls
    assert [i for i in f.imports if i in imports] == imports


def test_extraction_details(spark):
    f = extract.facts(_CODE["rs"], "rust")
    assert {s["name"]: s["scope"] for s in f.symbols}["leaf"] == ["inner"] and f.tier == "lexer"
    assert {s["name"]: (s["start_line"], s["end_line"]) for s in f.symbols}["top"] == (4, 8)
    assert extract.facts("def broken(", "python") is None and extract.facts(None, "python") is None and extract.facts("x", "cobol") is None
    files = spark.createDataFrame([("a.rs", _CODE["rs"], "rust"), ("b.rs", _CODE["rs"], "rust"), ("c.py", "def (", "python"), ("d.rs", "", "rust")], "rel string, source string, language string")
    assert tuple(extract.summary(files).first()) == (4, 1, 8)
    assert extract.calls(files).count() == 2 and extract.imports(files).count() == 0 and extract.symbols(files).where("name = 'P'").count() == 2


def test_buffers_and_flow():
    src = "fn a(x: i32, y: i32) {\n let s = x + 1;\n let t = s * y;\n known(t);\n ghost(t);\n pair(1);\n}\n"
    assert extract.buffer_violations(src, "rust", {"known", "pair"}, {"pair": 2}) == [("unknown_identifier", "ghost", 5), ("wrong_arity", "pair", 6)]
    assert [(e["dependent"], e["depends_on"], e["line"]) for e in extract.dataflow(src)] == [("s", "x", 2), ("t", "s", 3), ("t", "y", 3)]


def test_import_names():
    got = lambda source, language: extract.facts(source, language).imports
    assert got("use crate::a::{b, self};\npub(crate) use std::io as io2;\nmod far;\nmod near { }\nuse super::*;\n", "rust") == ["a", "b", "far", "io", "io2", "std"]
    assert got("import a.b as c\nfrom .d import e as f, g\nfrom h import *\n", "python") == ["a", "b", "c", "d", "e", "f", "g", "h"]
    assert got('import (\n\t"a/b"\n\tx "c"\n)\nimport . "d"\n', "go") == ["a/b", "c", "d"]
    assert got("import {\n a,\n b } from './x';\nimport 'y';\nexport { q } from 'z';\nimport('dyn');\n", "typescript") == ["./x", "y"]
    assert got("import static a.B.c;\nimport d.*;\n", "java") == ["B", "a", "c", "d"]
    assert got('#include <cstdio>\n#include "a/b.h"\n', "cpp") == ["a/b.h", "cstdio"]


def test_proposed_buffers():
    assert extract.proposed("a b a", [("a", "x"), ("b", "y")]) == "x y a" and extract.proposed("a", [("z", "x")]) is None
    assert extract.edited_spans("one\ntwo\nthree\ntwo\n", ["two\nthree", "two", ""]) == [(2, 2), (2, 3), (4, 4)]


def test_trees_and_spools(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "vendor").mkdir()
    for name, text in {"src/a.rs": "fn a() {}", "src/b.min.js": "x", "src/c.txt": "x", "vendor/d.py": "x=1", "e.py": "y=2", "doc.md": "# T"}.items():
        (tmp_path / name).write_text(text)
    root = f"file://{tmp_path}"
    assert sorted((x["rel"], x["language"]) for x in sources.working_tree(spark, root).collect()) == [("e.py", "python"), ("src/a.rs", "rust")]
    assert [x["rel"] for x in sources.working_tree(spark, root, ["src/*"]).collect()] == ["e.py"]
    assert [x["rel"] for x in sources.working_tree(spark, root, languages=["rust"]).collect()] == ["src/a.rs"]
    assert [x["rel"] for x in sources.markdown_tree(spark, root).collect()] == ["doc.md"]
    log = tmp_path / "spool.jsonl"
    log.write_text('{"kind":"edit","ts":5}\nnot json\n{"kind":"deny","ts":9,"rule":"r"}\n')
    rows = sources.spool(spark, str(log), sources.METRICS).cache()
    assert rows.count() == 3 and sources.well_formed(rows).count() == 2
    assert sources.spool_watermark(spark, str(log)).endswith(f":{log.stat().st_size}")
    sources.append_spool(sources.well_formed(rows).select("kind", "ts", "rule"), str(tmp_path / "out"))
    assert sorted(json.loads(x[0]).get("rule", "-") for x in spark.read.text(str(tmp_path / "out")).collect()) == ["-", "r"]


def test_commits_and_results(spark):
    files = spark.createDataFrame([("c1", "a", "1"), ("c1", "b", "1"), ("c2", "b", "2"), ("c2", "d", "1")], "commit string, rel string, hash string")
    state, rows = sources.checked_diff(files, "c1", "c2")
    assert state == "evaluated" and {tuple(x) for x in rows.collect()} == {("a", "removed"), ("b", "modified"), ("d", "added")}
    assert sources.checked_diff(files, "c1", "zz") == ("unresolved:zz", None)
    b = sources.bindings(spark, json.dumps({"results": {"bindings": [{"p": {"value": "x"}, "l": {"value": "L"}, "t": {"value": "1"}}, {"p": {"value": "x"}, "l": {"value": "L"}, "t": {"value": "2"}}, {"p": {"value": "y"}, "l": {"value": "A"}}, {"p": {"value": "y"}, "l": {"value": "B"}}]}}))
    out = {x["p"]: (x["t"], x["error"]) for x in sources.decode(b, "p", ["l"], ["t"]).collect()}
    assert out == {"x": ("1 — 2", None), "y": ("", "l")}
    two = spark.createDataFrame([('["a","b"]',), ("b\nc\n",)], "t string")
    assert sorted(x[0] for x in sources.cochange(two, "t").collect()) == ["a", "b", "c"]
    assert sources.plate('{"item": "i", "at": 10}', 20) == "i" and sources.plate('{"item": "i", "at": 10}', 1e6) is None and sources.plate("x", 0) is None
    e = sources.exposure(spark.createDataFrame([("r",), ("s",)], "repo string"), spark.createDataFrame([("r", "public")], "repo string, exposure string"))
    assert {tuple(x) for x in e.collect()} == {("r", "public"), ("s", "unknown")}


def test_config_and_publish(spark, tmp_path):
    user = '[app]\nbase_ref = "dev"\nodd = 1\n[app.policy]\nmode = "enforce"\nmax_hops = 3\n[app.policy.scopes.crew]\nallow_paths = ["a/**"]\nmax_impacted_files = 4\n[app.tenancy]\noverlay_eviction = "lru"'
    project = '[other]\nx = 1\n[app.policy]\nmode = "advise"\n[app.graphs]\nenabled = true'
    c = sources.config(user, project, table="app", store_table="graphs")
    assert (c.base_ref, c.policy.mode, c.policy.max_hops, c.tenancy.overlay_eviction, c.tenancy.max_overlays, c.store.enabled) == ("dev", "advise", 3, "lru", 32, True)
    assert c.policy.scopes["crew"].allow_paths == ["a/**"] and c.policy.scopes["crew"].max_impacted_files == 4 and sources.config("").policy.mode == "off"
    assert sources.mode_source(user, project, "app") == ("advise", "project", True) and sources.mode_source(None, None) == ("off", "default", False)
    for bad in ('[policy]\nmode = "observe"', "[policy]\nmax_hops = -1", "[tenancy]\nmax_overlays = true", "policy = 3", '[[policy.rules]]\nname = "x"'):
        with pytest.raises(ValueError):
            sources.config(bad, '[policy]\nmode = "off"')
    rows, fine, calls = spark.createDataFrame([("s", "p", "o")], "s string, p string, o string"), spark.createDataFrame([], "x int"), []

    def flaky(r):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError

    assert sources.publish(rows, fine, flaky, sleep=lambda s: None)["attempts"] == 3
    assert sources.publish(rows, fine, flaky, dry_run=True) == {"triples": 1, "written": False}
    with pytest.raises(ValueError):
        sources.publish(rows, fine, lambda r: (_ for _ in ()).throw(ValueError()))
    sources.quarantine(rows, str(tmp_path / "bad"), "no")
    assert spark.read.json(str(tmp_path / "bad")).first()["refused"] == "no"
    rel = spark.createDataFrame([("a",), ("b",)], "rel string")
    assert sources.changed(rel, rel.where("rel = 'a'"), rel).count() == 2
    path = str(tmp_path / "snap")
    both = spark.createDataFrame([("a", 1), ("b", 2)], "snapshot string, v int")
    sources.replace_snapshot(both, path)
    sources.replace_snapshot(spark.createDataFrame([("a", 9)], "snapshot string, v int"), path)
    assert sorted(x["v"] for x in spark.read.parquet(path).collect()) == [2, 9]
    spool = str(tmp_path / "verdicts")
    both.write.json(spool)
    assert not sources.drain(spark.read.json(spool), spool, lambda r: r.where("v = 1")) and sources.drain(spark.read.json(spool), spool, lambda r: r.where("false"))
    assert not (tmp_path / "verdicts").exists()


def test_debounce_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "key string, ts timestamp"
    first = [("a", "2024-01-01 00:00:00.000"), ("a", "2024-01-01 00:00:00.200"), ("b", "2024-01-01 00:00:00.000")]
    later = [("c", "2024-01-01 00:00:10.000"), ("a", "2024-01-01 00:00:20.000")]
    put = lambda rows: spark.createDataFrame(rows, "key string, ts string").select("key", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(src)
    put(first)
    q = streaming.debounce(spark.readStream.schema(schema).parquet(src), 300).writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        put(later)
        q.processAllAvailable()
        put([("d", "2024-01-01 00:01:00.000")])
        q.processAllAvailable()
        out = {(x["key"], x["events"]) for x in spark.sql("SELECT * FROM flushed").collect()}
        assert {("a", 2), ("b", 1)} <= out
    finally:
        q.stop()


def test_stream_batches_and_freshness(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    spark.createDataFrame([("a", "fast"), ("b", "heavy")], "key string, tier string").write.parquet(src)
    stream = spark.readStream.schema("key string, tier string").parquet(src)
    q = streaming.refresh(stream, {"fast": lambda r, e: seen.append(("fast", r.count())), "heavy": lambda r, e: seen.append(("heavy", r.count()))}, str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert seen == [("fast", 1), ("heavy", 1)]
    q = streaming.once(stream, ["tier"]).writeStream.format("memory").queryName("onced").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM onced").count() == 2
    q = streaming.append_log(stream, str(tmp_path / "log"), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    flushes = spark.createDataFrame([("a", "fast", 1), ("a", "heavy", 1), ("b", "heavy", 1), ("b", "fast", 2)], "key string, tier string, last int")
    assert {tuple(x) for x in streaming.freshness(flushes).collect()} == {("a", "fresh"), ("b", "recomputing")}
    cache = spark.createDataFrame([("v", "e", 100), ("w", "e", 100), ("v", "e", 9999), ("v", "e", -4000), ("v", "f", 1)], "version string, endpoint string, written long")
    assert [x["miss"] for x in streaming.cached(cache, "v", "e", 200).collect()] == [None, "version", "future", "stale", "endpoint"]
    assert streaming.live(cache, "written", 100).count() == 1


def test_two_tiers_by_processing_time(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([("a",), ("a",), ("b",)], "key string").write.parquet(str(tmp_path / "in"))
    stream = streaming.two_tier(spark.readStream.schema("key string").parquet(str(tmp_path / "in")), 200, 1200)
    q = stream.writeStream.format("memory").queryName("tiers").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 60
        while spark.sql("SELECT * FROM tiers").count() < 4 and time.time() < until:
            time.sleep(0.5)
        assert {(x["key"], x["tier"], x["events"]) for x in spark.sql("SELECT * FROM tiers").collect()} == {("a", "fast", 2), ("a", "heavy", 2), ("b", "fast", 1), ("b", "heavy", 1)}
    finally:
        q.stop()
        spark.conf.unset(provider)


def test_scope_in_rules_is_used_by_sources():
    assert sources.any_glob is rules.any_glob
