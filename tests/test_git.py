"""A repository's store, written byte by byte and by the tool itself."""

import hashlib
import os
import shutil
import struct
import subprocess
import zlib

import pytest

from skein.operators import build
from skein.sources import git


def object_id(kind, content):
    return hashlib.sha1(b"%s %d\0" % (kind.encode(), len(content)) + content).hexdigest()


def loose(at, kind, content):
    oid = object_id(kind, content)
    path = at / "objects" / oid[:2] / oid[2:]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(zlib.compress(b"%s %d\0" % (kind.encode(), len(content)) + content))
    return oid


def tree(*entries):
    return b"".join(b"%s %s\0" % (m.encode(), n.encode()) + bytes.fromhex(o) for m, n, o in entries)


def varint(n):
    out = bytearray()
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def header(kind, size):
    first, size = kind << 4 | size & 15, size >> 4
    return bytes([first | (0x80 if size else 0)]) + (varint(size) if size else b"")


def pack(at, items):
    """items: (oid, kind number, content or (base oid, delta)); offset deltas to what stands before, id deltas else."""
    body, places = b"PACK" + struct.pack(">II", 2, len(items)), {}
    for oid, kind, content in items:
        places[oid] = len(body)
        if kind in (6, 7):
            base, delta = content
            if kind == 6:
                back = places[oid] - places[base]
                said = [back & 0x7F]
                while back := back >> 7:
                    back -= 1
                    said.append(0x80 | back & 0x7F)
                body += header(6, len(delta)) + bytes(reversed(said)) + zlib.compress(delta)
            else:
                body += header(7, len(delta)) + bytes.fromhex(base) + zlib.compress(delta)
        else:
            body += header(kind, len(content)) + zlib.compress(content)
    body += hashlib.sha1(body).digest()
    ids = sorted(places)
    fan = [sum(int(i[:2], 16) <= b for i in ids) for b in range(256)]
    index = b"\xfftOc" + struct.pack(">I", 2) + struct.pack(">256I", *fan) + b"".join(map(bytes.fromhex, ids)) + bytes(4 * len(ids))
    far = ids[-1]  # one place in the table of long ones
    index += b"".join(struct.pack(">I", 1 << 31 if i == far else places[i]) for i in ids) + struct.pack(">Q", places[far]) + body[-20:]
    index += hashlib.sha1(index).digest()
    folder = at / "objects" / "pack"
    folder.mkdir(parents=True)
    (folder / "pack-1.pack").write_bytes(body)
    (folder / "pack-1.idx").write_bytes(index)


def delta(base, new, keep):
    """Copies the first `keep` bytes of the base and adds the rest of new."""
    assert base[:keep] == new[:keep] and len(new) - keep < 128
    copy = bytes([0x90 | 0x20, keep & 255, keep >> 8])
    return varint(len(base)) + varint(len(new)) + copy + bytes([len(new) - keep]) + new[keep:]


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    store = at / ".git"
    old = b"fn leaf() {}\n" + b"// padding\n" * 40
    new, newer = old + b"fn mid() { leaf(); }\n", old + b"fn mid() { leaf(); }\nfn top() { mid(); }\n"
    ids = {n: object_id("blob", c) for n, c in (("old", old), ("new", new), ("newer", newer))}
    raw = loose(store, "blob", b"\xff\xfe\0binary")
    inner = tree(("100644", "lib.rs", ids["new"]))
    first, second = tree(("100644", "lib.rs", ids["old"])), tree(("40000", "deep", object_id("tree", inner)), ("160000", "linked", "1" * 40), ("100644", "main.rs", ids["newer"]), ("100644", "raw.rs", raw))
    said = lambda t, *parents: (f"tree {t}\n" + "".join(f"parent {p}\n" for p in parents) + "author A B <a@b> 5 +0000\ncommitter A B <a@b> 9 +0000\n\nsay\n\nmore\n").encode()
    c1 = said(object_id("tree", first))
    c2 = said(object_id("tree", second), object_id("commit", c1))
    c3 = loose(store, "commit", said(object_id("tree", first), object_id("commit", c2), object_id("commit", c1)))
    pack(store, [
        (ids["old"], 3, old), (ids["new"], 6, (ids["old"], delta(old, new, len(old)))), (ids["newer"], 7, (ids["new"], delta(new, newer, len(new)))),
        (object_id("tree", first), 2, first), (object_id("tree", inner), 2, inner), (object_id("tree", second), 2, second), (object_id("commit", c1), 1, c1), (object_id("commit", c2), 1, c2),
    ])
    tag = loose(store, "tag", f"object {object_id('commit', c1)}\ntype commit\ntag v1\ntagger A <a> 1 +0000\n\nx\n".encode())
    (store / "refs" / "heads").mkdir(parents=True)
    (store / "HEAD").write_text("ref: refs/heads/main\n")
    (store / "refs" / "heads" / "main").write_text(c3 + "\n")
    (store / "packed-refs").write_text(f"# pack-refs\n{object_id('commit', c2)} refs/heads/side\n{'0' * 40} refs/heads/main\n{tag} refs/tags/v1\n^{object_id('commit', c1)}\n")
    return str(at), [object_id("commit", c1), object_id("commit", c2), c3], (old, new, newer)


def test_names_of_commits(repository):
    path, (c1, c2, c3), _ = repository
    for name, want in {"HEAD": c3, "main": c3, "side": c2, "refs/heads/side": c2, "v1": c1, "v1^{commit}": c1, "HEAD~1": c2, "HEAD~2": c1, "HEAD~3": None, "HEAD^2": c1, "main^": c2, "HEAD~1^": c1, "HEAD^3": None, "main^0": c3, c2: c2, c2[:9]: c2, "nope": None, "zz": None, "": None}.items():
        assert git.resolve(path, name) == want, name


def test_trees_and_blobs(spark, repository):
    path, (c1, c2, c3), (old, new, newer) = repository
    blobs, refs = git.blobs(spark, path, "side", "v1", "nope")
    assert {(x["commit"], x["rel"]): x["source"] for x in blobs.collect()} == {(c1, "lib.rs"): old.decode(), (c2, "deep/lib.rs"): new.decode(), (c2, "main.rs"): newer.decode(), (c2, "raw.rs"): None}
    made = build.build_checked(blobs, refs, "side")
    assert {x["name"] for x in made.symbols.where("file = 'main.rs'").collect()} == {"leaf", "mid", "top"} and [x["rel"] for x in made.skipped.collect()] == ["raw.rs"]
    assert build.build_at(blobs, refs, "nope").symbols.count() == 0
    with pytest.raises(build.UnresolvedRef):
        build.build_checked(blobs, refs, "nope")
    assert {tuple(x) for x in git.changed(spark, path, "v1", "side").collect()} == {("lib.rs", "removed"), ("deep/lib.rs", "added"), ("main.rs", "added"), ("raw.rs", "added")}
    assert git.changed(spark, path, "v1", "main").count() == git.changed(spark, path, "v1", "nope").count() == 0


@pytest.mark.parametrize("entries", [3, 20_000])
def test_all_objects(spark, repository, entries):
    path, ids, (old, new, newer) = repository
    rows = git.objects(spark, path, entries=entries).collect()
    assert len(rows) == 11 and all(object_id(r["kind"], bytes(r["content"])) == r["oid"] for r in rows)
    assert {bytes(r["content"]) for r in git.objects(spark, path, "blob").collect()} == {old, new, newer, b"\xff\xfe\0binary"}
    history = {x["oid"]: x for x in git.commits(spark, path).collect()}
    assert set(history) == set(ids) and history[ids[2]]["parents"] == [ids[1], ids[0]] and history[ids[0]]["message"] == "say\n\nmore\n"
    assert (history[ids[1]]["author"], history[ids[1]]["at"]) == ("A B", 9)


def test_not_a_repository(spark, tmp_path):
    with pytest.raises(git.NotARepository):
        git.resolve(str(tmp_path), "HEAD")


@pytest.mark.skipif(not shutil.which("git"), reason="no tool here")
def test_what_the_tool_writes(spark, tmp_path):
    env = {**os.environ, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", "-c", "init.defaultBranch=main", *a], env=env, check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    text = "".join(f"fn f{i}() {{}}\n" for i in range(300))
    for n in range(6):
        (tmp_path / "d" / "e").mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / "e" / "a.rs").write_text(text + f"fn g{n}() {{ f{n}(); }}\n")
        (tmp_path / "é.py").write_text(f"x = {n}\n")
        run("add", "-A")
        run("commit", "-q", "-m", f"c{n}")
    run("tag", "-a", "old", "-m", "x", "HEAD~3")
    run("gc", "-q", "--aggressive")
    (tmp_path / "late.go").write_text("package m\n")
    run("add", "-A")
    run("commit", "-q", "-m", "late")
    for name in ("HEAD", "main", "old", "HEAD~4", "main^"):
        assert git.resolve(str(tmp_path), name) == run("rev-parse", f"{name}^{{commit}}")
    blobs, _ = git.blobs(spark, str(tmp_path), "old", "HEAD")
    got = {(x["commit"], x["rel"]): x["source"] for x in blobs.collect()}
    want = {}
    for name in ("old", "HEAD"):
        for rel in run("ls-tree", "-r", "--name-only", "-z", name).split("\0"):
            if rel:
                want[run("rev-parse", f"{name}^{{commit}}"), rel] = run("show", f"{name}:{rel}") + "\n"
    assert got == want and len(got) == 5
    every = set(run("cat-file", "--batch-all-objects", "--batch-check=%(objectname)").split("\n"))
    assert {x["oid"] for x in git.objects(spark, str(tmp_path), entries=4).collect()} == every
