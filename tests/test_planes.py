import math
import random

import pytest
from pyspark.sql import functions as F

from skein import functions as fn
from skein.operators import audit, paths, rules, similarity
from skein.plans import catalog


def test_globs():
    import re

    hit = lambda g, p: bool(re.match(rules.glob_regex(g), p))
    assert hit("src/**", "src/a") and hit("src/**", "src/a/b.rs") and not hit("src/**", "lib/a")
    assert hit("*.md", "a.md") and not hit("*.md", "d/a.md") and hit("**/*.md", "a.md") and hit("**/*.md", "d/e/a.md")
    assert hit("a?c/[xy]*", "abc/x1") and not hit("a?c/[!x]*", "abc/x1") and not hit("a.c", "abc")
    assert rules.glob_errors(["ok/*", "bad/[x"])[0][0] == "bad/[x"
    assert [p for p, _ in rules.compile_errors(["a+", "(?=x)", r"(a)\1", "("])] == ["(?=x)", r"(a)\1", "("]


def test_scope_and_ceiling(spark):
    rows = spark.createDataFrame([("src/a",), ("src/secret/k",), ("lib/x",)], "p string")
    out = rows.select(rules.scope_decision(F.col("p"), ["src/**"], ["**/secret/*"])).collect()
    assert [x[0] for x in out] == ["allowed", "denied", "outside"]
    assert [x[0] for x in rows.select(rules.in_scope(F.col("p"), [], ["lib/*"])).collect()] == [True, True, False]
    c = spark.createDataFrame([(1, 1), (9, 1), (9, 9)], "s int, f int")
    assert [x[0] for x in c.select(rules.ceiling(F.col("s"), F.col("f"), 5, 5)).collect()] == ["", "max-symbols", "max-symbols+max-files"]


def test_text_rules(spark):
    rows = spark.createDataFrame([("a.py", "k=AKIA1 x AKIA2 AKIA1", "public"), ("skip/b.py", "AKIA9", "public"), ("c.py", "AKIA3", None), ("d.py", None, "public")], "path string, text string, exposure string")
    out = rules.text_findings(rows, [{"name": "key", "pattern": "AKIA[0-9]", "tier": "block", "exempt": "^skip/"}], "path", "text").collect()
    assert [(x["path"], x["tokens"], x["blocking"]) for x in out] == [("a.py", ["AKIA1", "AKIA2"], True), ("c.py", ["AKIA3"], False)]


def test_grounding(spark):
    ids = spark.createDataFrame([("proj-abc",), ("proj-def",), ("solo",)], "id string")
    texts = spark.createDataFrame([(1, "see proj-abc"), (2, "see proj-zzz and solo"), (3, "nothing-here"), (4, None), (5, "proj- trailing")], "k int, t string")
    found = rules.ground(texts, ids, "k", "t")
    got = {(x["k"], x["token"]): x["outcome"] for x in found.collect()}
    assert got[1, "proj-abc"] == got[2, "solo"] == "grounded" and got[2, "proj-zzz"] == "fabricated" and got[3, "nothing-here"] == "unrelated" and got[5, "proj-"] == "unrelated"
    must = {x["k"]: x["outcome"] for x in rules.grounding_rules(texts, found, "k", "must-ground").collect()}
    assert must == {1: "ok", 2: "fabricated", 3: "breach", 4: "breach", 5: "breach"}
    assert {x["k"]: x["outcome"] for x in rules.grounding_rules(texts, found, "k", "must-not-ground").collect()}[1] == "breach"


def test_ladder_and_outcomes(spark):
    req = spark.createDataFrame([("i", "a"), ("i", "z"), ("child", "a"), ("seen", "q"), ("new", "a")], "item string, path string")
    declared = spark.createDataFrame([("i", "a"), ("p", "a")], "item string, path string")
    parents = spark.createDataFrame([("child", "p", 1), ("child", "other", 2)], "item string, parent string, ordinal int")
    seen = spark.createDataFrame([("seen", "q")], "item string, path string")
    got = {(x["item"], x["path"]): (x["rung"], x["inside"], x["decides"]) for x in rules.scope_ladder(req, declared, parents, seen).collect()}
    assert got == {("i", "a"): ("declared", True, True), ("i", "z"): ("declared", False, True), ("child", "a"): ("derived", True, False), ("seen", "q"): ("observed", True, False), ("new", "a"): ("unknown", False, False)}
    m = spark.createDataFrame([("enforce", "declared"), ("enforce", "derived"), ("advise", "unknown")], "m string, r string")
    assert [x[0] for x in m.select(rules.outcome(F.col("m"), F.col("r"))).collect()] == ["enforce", "advise", "off"]
    b = spark.createDataFrame([("hard", "warn", "enforce", "PAG"), ("soft", "deny", "enforce", None), (None, "deny", "enforce", None), (None, "mystery", "enforce", None), (None, "throttle", "enforce", None), ("escalation", "deny", "advise", None), ("hard", "deny", "enforce", "PAA"), ("weird", "record", "enforce", "nowhere")], "c string, e string, m string, p string").coalesce(1)
    assert [x[0] for x in b.select(rules.blocks(*map(F.col, "cemp"))).collect()] == [True, False, True, True, False, False, False, False]
    f = spark.createDataFrame([("e", 1, "a", False), ("e", 2, "b", True), ("e", 3, "c", True), ("g", 2, "z", False)], "k string, plane int, rule string, blocking boolean")
    assert {x["k"]: (x["rule"], x["rules"]) for x in rules.first_decision(f, "k", "plane", "rule").collect()} == {"e": ("b", "a+b+c"), "g": ("z", "z")}


def test_shapes_of_tokens():
    import re

    p = rules.narrowing_pattern(["abc-12", "x_9"])
    assert p == r"\b[A-Za-z]+\-[0-9]+\b|\b[A-Za-z]+_[0-9]+\b" and re.search(p, "see zz-7")


def test_drafts():
    d = rules.draft("see proj-12 and proj-34 see")
    assert d["tokens"] == ["see", "proj-12", "and", "proj-34"] and d["pattern"].count("|") == 1


def test_cosine(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [0.0, 2.0]), (3, [1.0], [1.0, 2.0]), (4, [], []), (5, [0.0, 0.0], [1.0, 1.0]), (6, [1.0, 1.0], [1.0, 0.0])], "k int, a array<float>, b array<float>")
    out = {x["k"]: x["c"] for x in rows.select("k", similarity.cosine(F.col("a"), F.col("b")).alias("c")).collect()}
    assert out[1] == 1.0 and out[2] == 0.0 and out[3] is out[4] is out[5] is None and abs(out[6] - math.sqrt(0.5)) < 1e-12
    corpus = rows.select(F.col("k").alias("id"), F.col("b").alias("vector"), F.lit("m").alias("model"))
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query int, vector array<float>")
    assert [(x["id"], x["rank"]) for x in similarity.top_k(q, corpus, 2, 0.1, "m").orderBy("rank").collect()] == [(1, 1), (6, 2)]
    with pytest.raises(similarity.MatrixError):
        similarity.top_k(q, corpus, 2, model="other")


def test_token_buckets(spark):
    def fnv(token):
        h = 0xCBF29CE484222325
        for b in token.lower().encode():
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return h % 256

    words = ["a", "Hello", "x-9_z", "UPPER", "k" * 40]
    out = spark.createDataFrame([(w,) for w in words], "t string").select("t", similarity.token_bucket(F.col("t")).alias("b")).collect()
    assert {x["t"]: x["b"] for x in out} == {w: fnv(w) for w in words}


def test_votes(spark):
    hits = spark.createDataFrame([("q", "a", "phrase", 0.0), ("q", "a", "semantic", 0.9), ("q", "b", "semantic", 0.75), ("q", "c", "semantic", 0.5), ("q", "d", "term", 0.0), ("r", "e", "semantic", 0.3), ("r", "f", "term", 0.1)], "query string, item string, source string, score double")
    out = {(x["query"], x["item"]): (x["vote"], x["rank"]) for x in similarity.similar_items(hits).collect()}
    assert out == {("q", "a"): (4, 1), ("q", "b"): (2, 2), ("r", "f"): (1, 1)}
    t = spark.createDataFrame([("the longest tokens winning longest tokens",)], "t string").select(similarity.probe_terms(F.col("t"))).first()[0]
    assert t == ["longest", "winning", "longest"]
    got, want = spark.createDataFrame([("p", 1), ("p", 2), ("z", 1)], "probe string, item int"), spark.createDataFrame([("p", 2), ("p", 3), ("y", 1)], "probe string, item int")
    s = similarity.scores(got, want)
    assert {x["probe"]: (x["precision"], x["recall"], x["f1"]) for x in s.collect()} == {"p": (0.5, 0.5, 0.5), "z": (0, 0, 0), "y": (0, 0, 0)}
    assert similarity.macro_f1(s).first()["macro_f1"] == 0.167


def test_related(spark):
    touches = spark.createDataFrame([(i, "hub") for i in range(7)] + [(1, "x"), (2, "x"), (1, "y"), (3, "y")], "item int, entity string")
    assert sorted((x["item"], x["related"]) for x in similarity.related(touches).collect()) == [(1, 2), (1, 3), (2, 1), (3, 1)]


def greedy(pattern, sigs):
    m, last = 0, None
    for i, s in enumerate(sigs):
        if m < len(pattern) and s == pattern[m]:
            m, last = m + 1, i
    return m, last


def test_paths(spark):
    r = random.Random(3)
    runs = {f"r{i}": [(r.choice("abc"), r.choice([None, "x"])) for _ in range(r.randint(1, 8))] for i in range(40)}
    rows = [(k, n, a, t) for k, v in runs.items() for n, (a, t) in enumerate(v)] + [("odd", 0, None, "x")]
    steps = spark.createDataFrame(rows, "run_id string, step int, action_kind string, target_class string")
    path = {"path": "p", "grammar": "g", "pattern": ["a/x", "b/none", "c/x"], "level": "blessed", "dead_ends": [("b/x", "first"), ("b/x", "second")]}
    every = {(m, deny): {x["run_id"]: x for x in paths.check(steps, [path], "p", "g", m, deny).collect()} for m in ("plan", "progress") for deny in (True, False)}
    for k, v in runs.items():
        sigs = [f"{a}/{t or 'none'}" for a, t in v]
        m, last = greedy(path["pattern"], sigs)
        bad = [(i, "first") for i, s in enumerate(sigs) if s == "b/x"]
        for (mode, deny), out in every.items():
            off = mode == "plan" and m < 3
            assert (out[k]["outcome"], out[k]["matched"], out[k]["deviation"], out[k]["last"]) == ("evaluated", m, m if off else None, last if off else None)
            assert [tuple(h) for h in out[k]["hazards"]] == bad
            assert out[k]["effect"] == ("deny" if off and deny else "warn" if off or bad else "none")
    odd = every["plan", True]["odd"]
    assert (odd["outcome"], odd["effect"], odd["unevaluated"], odd["deviation"], odd["last"]) == ("evaluated", "deny", [0], 0, None)
    assert {x["effect"] for x in paths.check(steps, [path | {"level": "draft"}], "p", "g", "plan", True).collect()} == {"warn", "none"}
    said = [{(x["outcome"], x["effect"], x["reason"]) for x in paths.check(steps, *t).collect()} for t in (([], "p", "g"), ([path], "q", "g"), ([path], "p", "h"))]
    assert said == [{("refused", None, r)} for r in ("empty registry", "unknown path", "other grammar")]
    dead = spark.createDataFrame([("a/x", "first", 1), ("a/x", "second", 2)], "sig string, note string, ordinal int")
    assert {x["note"] for x in paths.hazards(steps, dead).collect()} == {"first"}


def test_backoff_and_throttles(spark):
    rows = [("exp(min(overage / 2, 8))", 4.0), ("exp( min( overage/2 ,8 ) )", 400.0), ("exp(min(overage / 0, 8))", 4.0), ("exp(min(overage / 2, 99))", 400.0), ("fast", 1.0), (None, 1.0)]
    out = spark.createDataFrame(rows, "e string, o double").select(audit.backoff(F.col("e"), F.col("o"))).collect()
    assert [x[0] for x in out] == [7, 2980, None, 21600, None, None]
    log = spark.createDataFrame([("c", "s", 10), ("c", "s", 30), ("d", "s", 20), ("e", None, 99)], "constraint_id string, scope string, until long")
    assert [tuple(x) for x in audit.active_throttles(log, "s", 20).collect()] == [("c", 30)]


def test_tail_and_percentiles(spark):
    spool = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(200)], "n int, line string").repartition(5)
    want, size = [], 0
    for i in range(199, -1, -1):
        size += i % 7 + 1
        if size > 100:
            break
        want.append(i)
    assert sorted(x["n"] for x in audit.tail(spool, "n", "line", 100).collect()) == sorted(want)
    values = [5.0, 1.0, 1.0, 3.0, 9.0, 2.0]
    out = audit.percentiles(spark.createDataFrame([("k", v) for v in values], "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95}).first()
    s = sorted(values)
    assert (out["p50"], out["p95"], out["n"]) == (s[int(0.5 * 5)], s[int(0.95 * 5)], 6)


def test_tail_does_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    """Many input tasks: ranges sampled twice differ from each other."""
    n = 60_000
    spark.range(n).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.when(F.col("id") % 5 > 0, F.lit("{}")).alias("props")).repartition(23).write.parquet(f"{tmp_path}/events.parquet")
    want, size = set(), 0
    for i in range(n - 1, -1, -1):
        size += len(f"{i}|view|{{}}") + 1 if i % 5 else 0
        if size > 20_000:
            break
        want.add((i, f"{i}|view|{{}}" if i % 5 else None))
    assert {tuple(x) for x in catalog.queries()["tail_denials"](spark, str(tmp_path)).collect()} == want


def test_tail_of_lines_at_one_place(spark):
    spool = spark.createDataFrame([(3, "abc"), (2, "abc"), (2, "abcd"), (1, "a")], "n int, line string")
    assert [[(x["n"], x["line"]) for x in audit.tail(spool, "n", "line", size).orderBy("n", "line").collect()] for size in (3, 4, 12, 13)] == [[], [(3, "abc")], [(3, "abc")], [(2, "abc"), (2, "abcd"), (3, "abc")]]
    assert audit.tail(spool.where("n = 0"), "n", "line", 9).count() == 0 and audit.tail(spool, "n", "line").count() == 4


def test_session_audits(spark):
    rows = [("s", 0, "read", "f", 0.0, 10.0), ("s", 1, "read", "f", 5.0, 8.0), ("s", 2, "edit", "f", None, None), ("s", 3, "read", "f", 0.0, 4.0), ("s", 4, "compact", None, None, None), ("s", 5, "read", "f", 0.0, 4.0), ("s", 6, "read", "f", 4.0, 9.0), ("t", 7, "read", "f", 0.0, 4.0)]
    ev = spark.createDataFrame(rows, "session string, idx int, kind string, path string, lo double, hi double")
    assert [(x["idx"], x["prior"]) for x in audit.rereads(ev).collect()] == [(1, 0)]
    w = spark.createDataFrame([("s", 0, "write", "p", "a"), ("s", 1, "item", None, "a"), ("s", 2, "write", "p", "a"), ("s", 3, "write", "q", "A"), ("s", 4, "write", "u", "a")], "session string, idx int, kind string, path string, crew string")
    owners = spark.createDataFrame([("p", "B"), ("q", "a")], "path string, owner string")
    assert [(x["idx"], x["owner"]) for x in audit.foreign_writes(w, owners).collect()] == [(2, "B")]
    reg = spark.createDataFrame([("t1", "me", 100), ("t1", "you", 100), ("t1", "old", 1), ("t2", "you", 100)], "tree string, who string, ts long")
    assert [(x["tree"], x["who"]) for x in audit.concurrent(reg, "me", 950).collect()] == [("t1", "you")]


def test_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(fn.slug(F.lit("Hello,  World_- Ünï 2!"))) == "hello-world-ünï-2"
    assert one(fn.turtle_literal(F.lit('a"b\\c\nd'))) == '"a\\"b\\\\c\\nd"'
    assert one(fn.symbol_iri("urn:", F.lit("r p"), F.lit("a/b.rs"), F.array(F.lit("m")), F.lit("f"))) == "urn:r%20p/a%2Fb.rs#m::f"
    assert one(fn.repo_identity(F.lit("git@host:team/tool.git"))) == one(fn.repo_identity(F.lit("https://h/x/tool/"))) == "tool"
    assert one(fn.provenance(F.lit("ad"), F.lit(3), F.lit("red"))) == "ad@turn3/red" and one(fn.provenance(F.lit("ad"), F.lit(None).cast("int"), F.lit(None).cast("string"))) == "ad"
    assert one(fn.first_line(F.lit("ab\ncd"))) == "ab" and len(one(fn.first_line(F.lit("x" * 99)))) == 80
    assert one(fn.age(F.lit(5), F.lit(9))) == 0 and one(fn.signed_message(F.lit("a"), F.lit("b"))) == "v1|a|b"
    assert one(fn.introduced(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == "a\nb"
    nothing = (None, None, "unknown")
    for text, want in {
        "ssh ops@db.example": ("ssh", "db.example", "host"), "  scp  db.example:/a/b ./c": ("scp", "db.example", "host"), "scp ./a/b.c ./d": nothing, "ssh db": nothing, "ssh -i key.pem db": ("ssh", "key.pem", "host"),
        "ansible x --limit=db,": ("ansible", "db", "host"), "ansible x -l": nothing, "systemctl": nothing, "systemctl stop a.service.service": ("stop", "a", "service"), "systemctl -q status": nothing,
        "git fetch -q ../up/side.git/": ("fetch", "side", "repo"), "git push": nothing, "git pull /": nothing, "podman rm -f box": ("rm", "box", "container"), "/bin/docker kill \"box\"": ("kill", "box", "container"),
        "ssh a@b && true": nothing, "ssh a@b; true": nothing, "ssh a@b < f": nothing, "ssh `h`": nothing, "ssh a@b &": ("ssh", "b", "host"), "ssh\ta@b\n": ("ssh", "b", "host"), "rm -rf /": nothing, "": nothing, None: nothing,
    }.items():
        assert tuple(one(fn.command(F.lit(text).cast("string")))) == want, text
