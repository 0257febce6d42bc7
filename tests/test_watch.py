"""The watched folder: every change once, over restarts, and a graph that follows."""

import os
import random

from skein.operators import build
from skein.streaming import watch


def drained(spark, root, home, seen):
    q = watch.changes(spark, root, f"{home}/listings").writeStream.foreachBatch(lambda rows, n: seen.extend(tuple(r)[:2] for r in rows.collect())).option("checkpointLocation", f"{home}/c").start()
    q.processAllAvailable()
    q.stop()


def test_events_over_restarts(spark, tmp_path):
    root, home, seen = tmp_path / "src", str(tmp_path / "home"), []
    (root / "a").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "a" / "x.rs").write_text("fn a() {}")
    (root / ".hidden" / "y.rs").write_text("")
    drained(spark, str(root), home, seen)
    drained(spark, str(root), home, seen)
    assert seen == [("a/x.rs", "create")]
    (root / "a" / "x.rs").write_text("fn ab() {}")
    (root / "é b.py").write_text("x = 1")
    drained(spark, str(root), home, seen)
    (root / "a" / "x.rs").unlink()
    (root / "gone.rs").write_text("")
    (root / "gone.rs").unlink()
    drained(spark, str(root), home, seen)
    assert sorted(seen[1:3]) == [("a/x.rs", "modify"), ("é b.py", "create")] and seen[3:] == [("a/x.rs", "remove")]
    assert len(os.listdir(f"{home}/listings")) <= 2


def test_a_batch_run_again_gives_the_same_events(tmp_path):
    root, r, seen = tmp_path / "src", random.Random(2), {}
    root.mkdir()
    reader = watch.ChangeReader({"path": str(root), "state": str(tmp_path / "state"), "shares": 3})
    at, have = reader.initialOffset(), {}
    for _ in range(12):
        for _ in range(r.randint(0, 4)):
            p = root / f"f{r.randrange(6)}"
            if p.exists() and r.random() < 0.4:
                p.unlink()
            else:
                p.write_text("x" * r.randint(0, 50))
        again = watch.ChangeReader({"path": str(root), "state": str(tmp_path / "state"), "shares": 3})  # a restart
        to = again.latestOffset()
        read = lambda q: sorted(x for p in q.partitions(at, to) for b in q.read(p) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))  # noqa: B023, E731
        events = read(again)
        assert events == read(reader)
        for rel, change, size in events:
            assert (rel in have) != (change == "create")
            have.pop(rel, None) if change == "remove" else have.update({rel: size})
        assert have == {p.name: p.stat().st_size for p in root.iterdir()}
        seen[to["listing"]] = events
        again.commit(to)
        at = to
    assert len(seen) > 5


def test_the_graph_follows_the_folder(spark, tmp_path):
    root, home = tmp_path / "src", str(tmp_path / "home")
    root.mkdir()
    keeper, query = watch.follow(spark, str(root), home)

    def step():
        q = query.start()
        q.processAllAvailable()
        q.stop()
        rows = lambda g: (sorted((x["node"], x["name"]) for x in g.symbols.collect()), sorted(tuple(x) for x in g.edges.collect()), sorted(x["rel"] for x in g.skipped.collect()))
        got = rows(keeper.graph())
        assert got == rows(build.build(watch.read_files(spark, str(root), [str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()])))
        return got

    (root / "leaf.rs").write_text("fn leaf() {}\n")
    (root / "top one.rs").write_text("fn top() { leaf(); }\n")
    (root / "notes.txt").write_text("leaf()")
    assert len(step()[1]) == 1
    (root / "leaf.rs").write_text("// moved\nfn leaf() {}\nfn twig() { leaf(); }\n")
    (root / "bad.py").write_text("def broken(:\n")
    (root / "raw.rs").write_bytes(b"\xff\xfe")
    symbols, edges, skipped = step()
    assert len(edges) == 2 and "bad.py" in skipped
    (root / "leaf.rs").unlink()
    assert step()[1] == []
