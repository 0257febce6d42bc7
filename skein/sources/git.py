"""A repository's commits, trees and blobs, read from its object store as Spark sources.

Objects lie as single files or in packs. `git_objects` is a batch data source over all of them: a partition is some folders of
single files, or a range of a pack's entries in the order of their place, since a delta's base stands near it.
Where only some objects are asked for (the tree at a commit, its blobs), ids are dealt out as rows and each
task looks them up by the packs' indexes, so that history which nobody asked for is not read. A tree is
walked level by level: a level's folders are the rows of the next.

The repository folder must be seen under one path by the driver and all executors. One object must fit a task. Names of
commits are resolved on the driver: refs, tags (peeled), ids or their prefixes, with `~n` and `^n`.

Defined results: a blob that is not UTF-8, or whose object is not there, has a null source; links to other
repositories are left out; a name that stands for no commit is None. A store without packs, or without
single files, is read like any other; a path that is no repository is refused.
"""

from __future__ import annotations

import mmap
import re
import zlib
from bisect import bisect_left
from collections import OrderedDict
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.scratch import settle

# Fixed values of the store's format.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, ID_DELTA = 6, 7
INDEX_MARK = b"\xfftOc"
FOLDER, LINKED = "40000", "160000"
CACHE = 64 << 20  # bytes of bases that a task keeps


class NotARepository(ValueError):
    pass


def delta_applied(base: bytes, delta: bytes) -> bytes:
    """The object that a delta makes of its base: copies of the base's ranges, and new bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = delta[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    size, out = (number(), number())[1], bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            fields = []
            for bit in range(7):
                fields.append(delta[at] if op >> bit & 1 else 0)
                at += op >> bit & 1
            start, length = int.from_bytes(bytes(fields[:4]), "little"), int.from_bytes(bytes(fields[4:]), "little") or 0x10000
            out += base[start : start + length]
        else:
            out += delta[at : at + op]
            at += op
    if len(out) != size:
        raise ValueError("a delta does not make what it says")
    return bytes(out)


def mapped(path: str) -> mmap.mmap:
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


class Pack:
    def __init__(self, index: str):
        self.path = index[:-4]
        raw = mapped(index)
        if raw[:4] != INDEX_MARK or raw[4:8] != b"\0\0\0\2":
            raise ValueError(f"{index}: an index of another version")
        self.fan = np.frombuffer(raw, ">u4", 256, 8)
        self.count = int(self.fan[255])
        self.ids = memoryview(raw)[1032 : 1032 + 20 * self.count]
        short = np.frombuffer(raw, ">u4", self.count, 1032 + 24 * self.count).astype(np.int64)
        far = np.flatnonzero(short >> 31)
        if len(far):
            long = np.frombuffer(raw, ">u8", len(far), 1032 + 28 * self.count).astype(np.int64)
            short[far] = long[short[far] & 0x7FFFFFFF]
        self.places = short

    @cached_property
    def data(self):
        return mapped(self.path + ".pack")

    @cached_property
    def order(self) -> np.ndarray:
        """Entries in the order of their place."""
        return np.argsort(self.places, kind="stable")

    @cached_property
    def ends(self) -> dict[int, int]:
        sorted_ = self.places[self.order]
        return dict(zip(sorted_.tolist(), [*sorted_[1:].tolist(), len(self.data) - 20]))

    @cached_property
    def kept(self) -> OrderedDict:
        self.held = 0
        return OrderedDict()

    def id_of(self, i: int) -> bytes:
        return bytes(self.ids[20 * i : 20 * i + 20])

    def find(self, oid: bytes) -> int | None:
        """The entry of a full or shortened id: the first that is not below it, if it begins so."""
        low, high = int(self.fan[oid[0] - 1]) if oid[0] else 0, int(self.fan[oid[0]])
        i = bisect_left(range(low, high), oid, key=lambda i: self.id_of(i)[: len(oid)]) + low
        return i if i < high and self.id_of(i).startswith(oid) else None

    def head(self, place: int) -> tuple[int, int, int | None]:
        """Kind, where the packed bytes begin, and the place of the base."""
        data, at = self.data, place
        byte = data[at]
        kind = byte >> 4 & 7
        while byte & 0x80:
            at += 1
            byte = data[at]
        at += 1
        base = None
        if kind == OFFSET_DELTA:
            byte = data[at]
            back = byte & 0x7F
            while byte & 0x80:
                at += 1
                byte = data[at]
                back = (back + 1) << 7 | byte & 0x7F
            at, base = at + 1, place - back
        elif kind == ID_DELTA:
            found = self.find(data[at : at + 20])
            if found is None:
                raise ValueError(f"{self.path}: a delta's base is not in the pack")
            at, base = at + 20, int(self.places[found])
        return kind, at, base

    def kind(self, place: int) -> str:
        kind, _, base = self.head(place)
        while base is not None:
            kind, _, base = self.head(base)
        return KINDS[kind]

    def read(self, place: int) -> tuple[str, bytes]:
        deltas, at = [], place
        while at not in self.kept:
            kind, start, base = self.head(at)
            content = zlib.decompress(self.data[start : self.ends[at]])
            if base is None:
                self.keep(at, (KINDS[kind], content))
                break
            deltas.append((at, content))
            at = base
        kind, content = self.kept[at]
        self.kept.move_to_end(at)
        for at, delta in reversed(deltas):
            content = delta_applied(content, delta)
            self.keep(at, (kind, content))
        return kind, content

    def keep(self, place: int, found: tuple[str, bytes]) -> None:
        self.kept[place] = found
        self.held += len(found[1])
        while self.held > CACHE and len(self.kept) > 1:
            self.held -= len(self.kept.popitem(last=False)[1][1])


def git_folder(path: str) -> Path:
    """The store of a work tree or a bare repository."""
    at = Path(path.removeprefix("file://"))
    if (at / ".git").is_file():  # a linked work tree says where its store is
        at = at / (at / ".git").read_text().split(":", 1)[1].strip()
    at = at / ".git" if (at / ".git").is_dir() else at
    if (at / "commondir").exists():
        at = at / (at / "commondir").read_text().strip()
    if not (at / "objects").is_dir():
        raise NotARepository(path)
    return at


class Store:
    """Objects by id, for one process."""

    def __init__(self, path: str):
        self.at = git_folder(path)
        self.packs = [Pack(str(p)) for p in sorted((self.at / "objects" / "pack").glob("*.idx"))]

    def read(self, oid: str) -> tuple[str, bytes] | None:
        single = self.at / "objects" / oid[:2] / oid[2:]
        if single.exists():
            return single_object(single)
        for pack in self.packs:
            i = pack.find(bytes.fromhex(oid))
            if i is not None:
                return pack.read(int(pack.places[i]))
        return None

    def with_prefix(self, prefix: str) -> set[str]:
        """Up to two ids that begin so."""
        found = {prefix[:2] + p.name for p in (self.at / "objects" / prefix[:2]).glob(f"{prefix[2:]}*")}
        whole = bytes.fromhex(prefix[: len(prefix) // 2 * 2])
        for pack in self.packs:
            i = pack.find(whole)
            while i is not None and i < pack.count and len(found) < 2 and pack.id_of(i).startswith(whole):
                if pack.id_of(i).hex().startswith(prefix):
                    found.add(pack.id_of(i).hex())
                i += 1
        return found


def single_object(path: Path) -> tuple[str, bytes]:
    head, _, content = zlib.decompress(path.read_bytes()).partition(b"\0")
    return head.split(b" ")[0].decode(), content


@dataclass
class Part(InputPartition):
    pack: str | None
    low: int
    high: int


class Objects(DataSource):
    """Options: path, kinds (commit,tree,blob,tag; all if not given) and entries (of a pack, in one partition)."""

    @classmethod
    def name(cls):
        return "git_objects"

    def schema(self):
        return "oid string, kind string, content binary"

    def reader(self, schema):
        return ObjectReader(self.options)


class ObjectReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.entries = options["path"], int(options.get("entries", 20_000))
        self.kinds = set(options.get("kinds", "commit,tree,blob,tag").split(","))

    def partitions(self):
        store = Store(self.path)
        packed = [Part(p.path, low, min(low + self.entries, p.count)) for p in store.packs for low in range(0, p.count, self.entries)]
        return [Part(None, low, low + 16) for low in range(0, 256, 16)] + packed

    def read(self, part):
        rows, size = [], 0
        for row in self.rows(part):
            rows.append(row)
            size += len(row[2])
            if size > 8 << 20 or len(rows) == 10_000:
                yield self.batch(rows)
                rows, size = [], 0
        yield self.batch(rows)

    def batch(self, rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["oid", "kind", "content"])

    def rows(self, part):
        if part.pack:
            pack = Pack(part.pack + ".idx")
            for i in pack.order[part.low : part.high].tolist():
                place = int(pack.places[i])
                if pack.kind(place) in self.kinds:
                    yield (pack.id_of(i).hex(), *pack.read(place))
            return
        for folder in range(part.low, part.high):
            for p in sorted((git_folder(self.path) / "objects" / f"{folder:02x}").glob("*")):
                if re.fullmatch("[0-9a-f]{38}", p.name):
                    kind, content = single_object(p)
                    if kind in self.kinds:
                        yield f"{folder:02x}{p.name}", kind, content


def objects(spark: SparkSession, path: str, kinds: str = "commit,tree,blob,tag", entries: int = 20_000) -> DataFrame:
    """oid, kind, content of all objects of these kinds; one that lies in several places comes as often."""
    spark.dataSource.register(Objects)
    return spark.read.format("git_objects").options(path=path, kinds=kinds, entries=entries).load()


def commits(spark: SparkSession, path: str) -> DataFrame:
    """oid, tree, parents, author, at (seconds), message of the whole history."""
    text = F.decode("content", "utf-8")
    head = F.substring_index(text, "\n\n", 1)
    one = lambda pattern, group=1: F.regexp_extract(head, pattern, group)
    parts = objects(spark, path, "commit").dropDuplicates(["oid"])
    return parts.select("oid", one(r"^tree ([0-9a-f]{40})").alias("tree"), F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]{40})$"), F.lit(1)).alias("parents"), one(r"(?m)^author (.*) <").alias("author"), one(r"(?m)^committer .* (\d+) [+-]\d{4}$").cast("long").alias("at"), F.expr("substring(decode(content, 'utf-8'), length(substring_index(decode(content, 'utf-8'), '\n\n', 1)) + 3)").alias("message"))


def refs(path: str) -> dict[str, str]:
    """Full names of refs with the ids they stand for, HEAD among them; single files before the packed list."""
    at, out = git_folder(path), {}
    packed = at / "packed-refs"
    if packed.exists():
        for line in packed.read_text().splitlines():
            if m := re.fullmatch(r"([0-9a-f]{40}) (\S+)", line):
                out[m[2]] = m[1]
    links = {}
    for p in [at / "HEAD", *(p for p in (at / "refs").rglob("*") if p.is_file())]:
        said = p.read_text().strip() if p.exists() else ""
        name = str(p.relative_to(at))
        if said.startswith("ref:"):
            links[name] = said[4:].strip()
        elif re.fullmatch("[0-9a-f]{40}", said):
            out[name] = said
    for name, to in links.items():
        for _ in range(5):
            to = links.get(to, to)
        if to in out:
            out[name] = out[to]
    return out


def resolve(path: str, name: str) -> str | None:
    """The full id of the commit that a name stands for: a ref, a tag, an id or at least four digits of one, then any of ~n and ^n."""
    m = re.fullmatch(r"(.+?)((?:[~^]\d*)*)(?:\^\{commit\})?", name)
    if not m:
        return None
    known, store, base = refs(path), Store(path), m[1]
    found = next((known[n] for n in (base, f"refs/{base}", f"refs/tags/{base}", f"refs/heads/{base}", f"refs/remotes/{base}", f"refs/remotes/{base}/HEAD") if n in known), None)
    if found is None and re.fullmatch("[0-9a-f]{4,40}", base):
        ids = store.with_prefix(base)
        found = ids.pop() if len(ids) == 1 else None

    def commit_of(oid):
        while oid:
            got = store.read(oid)
            if got is None or got[0] not in ("commit", "tag"):
                return None
            if got[0] == "commit":
                return oid, re.findall(rb"(?m)^parent ([0-9a-f]{40})$", got[1].split(b"\n\n", 1)[0])
            oid = re.match(rb"object ([0-9a-f]{40})", got[1])[1].decode()
        return None

    here = commit_of(found)
    for kind, many in re.findall(r"([~^])(\d*)", m[2]):
        steps = [int(many or 1)] if kind == "^" else [1] * int(many or 1)
        for nth in steps:
            if here is None or nth == 0:
                continue
            here = commit_of(here[1][nth - 1].decode()) if nth <= len(here[1]) else None
    return here[0] if here else None


def _looked_up(rows: DataFrame, path: str, use, schema: str) -> DataFrame:
    """use(columns of a row as a dict, kind, content) for the object of each row's oid; rows without one are given None."""

    def run(batches):
        store = Store(path)
        names = [c.split(" ")[0] for c in schema.split(", ")]
        for batch in batches:
            out = [made for row in batch.to_pylist() for made in use(row, *(store.read(row["oid"]) or (None, None)))]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=pa.schema([(n, pa.string()) for n in names]))

    return rows.mapInArrow(run, schema)


def tree_at(spark: SparkSession, path: str, commit: str) -> DataFrame:
    """rel, oid of all files of a commit; one job a level of folders."""
    _, content = Store(path).read(commit)
    level = spark.createDataFrame([("", content.split(b"\n", 1)[0].split(b" ")[1].decode())], "prefix string, oid string")

    def entries(row, kind, content):
        at = 0
        while kind == "tree" and at < len(content):
            space, nul = content.index(b" ", at), content.index(b"\0", at)
            mode, name = content[at:space].decode(), content[space + 1 : nul].decode(errors="replace")
            oid, at = content[nul + 1 : nul + 21].hex(), nul + 21
            if mode != LINKED:
                yield mode, row["prefix"] + name, oid

    files = None
    while True:
        found = settle(_looked_up(level.repartition("oid") if files is not None else level, path, entries, "mode string, rel string, oid string"))
        own = found.where(F.col("mode") != FOLDER).select("rel", "oid")
        files = own if files is None else files.unionByName(own)
        level = found.where(F.col("mode") == FOLDER).select(F.concat("rel", F.lit("/")).alias("prefix"), "oid")
        if level.isEmpty():
            return files


def sources(files: DataFrame, path: str) -> DataFrame:
    """rel, oid, source of files (rel, oid): each distinct blob is read once."""

    def text(row, kind, content):
        try:
            yield row["oid"], content.decode() if kind == "blob" else None
        except UnicodeDecodeError:
            yield row["oid"], None

    read = _looked_up(files.select("oid").distinct(), path, text, "oid string, source string")
    return files.join(read, "oid").select("rel", "oid", "source")


def blobs(spark: SparkSession, path: str, *names: str) -> tuple[DataFrame, DataFrame]:
    """(commit, rel, source) of the commits that the names stand for, and (ref, commit): what build.build_at and build.base read."""
    found = {n: resolve(path, n) for n in names}
    trees = [tree_at(spark, path, c).withColumn("commit", F.lit(c)) for c in dict.fromkeys(filter(None, found.values()))]
    every = trees[0] if trees else spark.createDataFrame([], "rel string, oid string, commit string")
    for t in trees[1:]:
        every = every.unionByName(t)
    read = sources(every.select("oid", F.lit("").alias("rel")).distinct(), path).select("oid", "source")
    return every.join(read, "oid").select("commit", "rel", "source"), spark.createDataFrame([(n, c) for n, c in found.items() if c], "ref string, commit string")


def changed(spark: SparkSession, path: str, before: str, after: str) -> DataFrame:
    """rel, change (added, removed, modified) between two names; none where either stands for no commit."""
    ends = [resolve(path, n) for n in (before, after)]
    if None in ends:
        return spark.createDataFrame([], "rel string, change string")
    a, b = (tree_at(spark, path, c).withColumnRenamed("oid", n) for c, n in zip(ends, ("_a", "_b")))
    both = a.join(b, "rel", "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select("rel", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("modified").alias("change"))
