"""Rolling spools and ignore rules."""

import os
import shutil
import subprocess

import pytest

from skein import sources
from skein.sources import METRICS, ignores, spools


def test_spool_rolls_and_reads_across(spark, tmp_path):
    path = str(tmp_path / "m")
    assert spools.read(spark, path, METRICS).count() == 0
    rows = lambda a, b: spark.range(a, b).selectExpr("'guard' AS kind", "id AS ts", "repeat('é\\n', 20) AS rule", "CAST(NULL AS string) AS mode").repartition(3)
    spools.append(rows(0, 100), path, ceiling=2000)
    folder = spools.Folder(path, 2000)
    assert folder.size() > 2000 and not folder.old.exists() and all(p.stat().st_size <= 2000 for p in folder.live.iterdir())
    spools.append(rows(100, 110), path, ceiling=2000)  # the first hundred are the old generation now
    assert sorted(r["ts"] for r in spools.read(spark, path, METRICS).collect()) == list(range(110)) and folder.old.exists()
    spools.append(rows(110, 111), path, ceiling=10)
    assert sorted(r["ts"] for r in spools.read(spark, path, METRICS).where("_corrupt_record IS NULL").collect()) == list(range(100, 111))
    assert not any(p.suffix == ".manifest" for p in folder.staged.iterdir())
    assert all("mode" not in line for p in folder.live.iterdir() for line in p.read_text().splitlines())


def test_killed_and_repeated_tasks_leave_no_line_twice(tmp_path):
    folder = spools.Folder(str(tmp_path), 50)
    lines = [f'{{"ts": {i}}}' for i in range(20)]
    held = lambda: sorted(x for p in folder.live.glob("*") for x in p.read_text().splitlines())
    folder.stage(iter(lines[:7]))  # killed before it could tell
    folder.commit([folder.stage(iter(lines)), None])
    assert held() == sorted(lines)
    folder.drop(folder.stage(iter(lines)).names)
    assert held() == sorted(lines)
    said = folder.stage(iter(["late"]))
    (folder.staged / "x.manifest").write_text(__import__("json").dumps({"names": said.names, "mark": 4, "roll": True}))
    (folder.at / "rolled-x").mkdir()  # broke off in the middle of rolling
    for p in folder.live.iterdir():
        p.rename(folder.at / "rolled-x" / p.name)
    folder.recover()
    folder.recover()
    assert held() == ["late"] and len(list(folder.old.iterdir())) > 3 and folder.last_mark() == 4
    folder.commit([folder.stage(iter(["again"]))], mark=4)
    assert held() == ["late"]


def test_spool_of_a_stream(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(2):
        spark.range(n * 5, n * 5 + 5).selectExpr("id AS ts", "'x' AS kind").write.mode("append").parquet(src)
        q = spools.append_stream(spark.readStream.schema("ts long, kind string").parquet(src), path, str(tmp_path / "c"))
        q.processAllAvailable()
        q.stop()
    shutil.rmtree(tmp_path / "c" / "commits")  # the last batch is run again
    q = spools.append_stream(spark.readStream.schema("ts long, kind string").parquet(src), path, str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r["ts"] for r in spools.read(spark, path, METRICS).collect()) == list(range(10))


def test_verdict_lines(spark):
    rows = spark.createDataFrame([(1, "p", "t", o, "ttl", "e" * 600) for o in ("satisfied", "unsatisfied", "unknown")], "ts long, predicate_id string, target_ref string, outcome string, turtle string, evidence string")
    assert [(r["denied_excerpt"] or "")[-1:] + str(len(r["denied_excerpt"] or "")) for r in spools.verdict_lines(rows).orderBy("outcome").collect()] == ["0", "e512"]


RULES = {
    ".gitignore": "# note\n\n*.log\n!keep.log\n/build\ntarget/\ndocs/*.md\na/**/z.txt\n**/tmp\nsp\\ ace \n\\#odd\n[ab]?.x\n!.shown\nlogs/**\n!logs/stay.txt\nq[!0-9].y\n",
    "sub/.gitignore": "!*.log\n/only.txt\nbuild\n*.md\n!docs/in.md\n",
    "sub/deep/.ignore": "*.log\n!only.txt\n",
}
PATHS = """x.log keep.log d/x.log build build/a.txt d/build target/a/b.rs d/target/a.rs target2 f/target docs/a.md docs/d/a.md d/docs/a.md a/z.txt a/b/z.txt a/b/c/z.txt b/a/z.txt tmp/a d/tmp/a/b d/tmp "sp ace" #odd ax.x bcc.x cx.x .hidden .shown d/.env/x
logs/a logs/b/c logs/stay.txt q1.y qq.y sub/x.log sub/only.txt sub/d/only.txt sub/build/a sub/d/build sub/a.md sub/docs/in.md sub/docs/out.md sub/deep/x.log sub/deep/only.txt sub/deep/e/x.log é/ü.log é/ü.txt""".replace("\n", " ")


def tree():
    import shlex

    return [p for p in shlex.split(PATHS, comments=False)]


def test_ignore_rules_are_those_of_the_tool(spark, tmp_path):
    if not shutil.which("git"):
        pytest.skip("no tool here")
    files = [p for p in tree() if not any(o.startswith(f"{p}/") for o in tree())]
    for rel, text in [*RULES.items(), *((p, "") for p in files)]:
        at = tmp_path / rel
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    env = {**os.environ, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], env=env, capture_output=True, text=True, check=True).stdout
    git("init", "-q")
    (tmp_path / "sub" / "deep" / ".ignore").rename(tmp_path / "sub" / "deep" / ".gitignore")
    seen = {p for p in git("ls-files", "-z", "-o", "--exclude-standard").split("\0") if p}
    rows = [(r.replace(".ignore", ".gitignore"), t) for r, t in RULES.items()] + [(p, "") for p in files]
    got = {x["rel"] for x in ignores.kept(spark.createDataFrame(rows, "rel string, source string"), hidden=False).collect()}
    assert got == seen


def test_ignore_order_and_hidden_names(spark):
    rows = [*RULES.items(), (".git/info/exclude", "only-here\nkeep.log\n"), *((p, "") for p in [*tree(), "only-here", ".github/a.yml"])]
    out = {x["rel"]: x["ignored"] for x in ignores.ignored(spark.createDataFrame(rows, "rel string, source string"), ignores.rules_of(spark.createDataFrame(rows, "rel string, source string"))).collect()}
    assert out["only-here"] and not out["keep.log"] and out[".hidden"] and not out[".shown"] and out[".github/a.yml"] and out["d/.env/x"]
    assert out["sub/deep/x.log"] and not out["sub/x.log"] and not out["sub/deep/only.txt"] and out["logs/b/c"]
    assert ignores.compiled("[x") is None and ignores.compiled("/") is None and ignores.compiled("!") is None


def test_working_tree_reads_every_name(spark, tmp_path):
    for rel, text in {"pkg/__init__.py": "x = 1", "_lead.rs": "fn a() {}", "out/gen.rs": "fn g() {}", ".gitignore": "/out\n", ".dot/a.py": "", "vendor/v.go": "", "notes/_a.md": "# t", "data.txt": "", "bad.go": None}.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(b"\xff" if text is None else text.encode())
    read = lambda **k: {r["rel"]: r["source"] for r in sources.working_tree(spark, str(tmp_path), **k).collect()}
    assert read() == {"pkg/__init__.py": "x = 1", "_lead.rs": "fn a() {}", "bad.go": None}
    assert set(read(hidden=True, rule_files=False, languages=["python", "rust"], ignore=["pkg/**"])) == {"_lead.rs", "out/gen.rs", ".dot/a.py"}
    assert read() == {r["rel"]: r["source"] for r in sources.working_tree(spark, f"file://{tmp_path}").collect()}
    assert [r["rel"] for r in sources.markdown_tree(spark, str(tmp_path)).collect()] == ["notes/_a.md"]


def test_publish_sends_chunk_by_chunk(spark):
    rows, fine, got, fails = spark.createDataFrame([(n // 3, f"s{n}") for n in range(8)], "chunk int, s string"), spark.createDataFrame([], "x int"), [], [1]

    def send(part, n):
        if n == 1 and fails and fails.pop():
            raise ConnectionError
        got.append((n, sorted(r["s"] for r in part.collect())))

    assert sources.publish_chunks(rows, fine, send, sleep=lambda s: None) == {"chunks": 3, "written": True, "attempts": 4}
    assert got == [(0, ["s0", "s1", "s2"]), (1, ["s3", "s4", "s5"]), (2, ["s6", "s7"])]
    assert sources.publish_chunks(rows, fine, send, dry_run=True) == {"chunks": 3, "written": False, "attempts": 0} and len(got) == 3

    def never(part, n):
        if n:
            raise TimeoutError("late")

    with pytest.raises(sources.Refused, match="chunk 1 after 1"):
        sources.publish_chunks(rows, fine, never, sleep=lambda s: None)
    with pytest.raises(sources.Refused, match="1 violations"):
        sources.publish_chunks(rows, spark.range(1), send)
