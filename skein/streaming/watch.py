"""A folder watched as a stream of changes, and a graph of its files that follows them.

The `file_changes` source lists the folder on the driver, as Spark's own file sources do, and writes each
listing that differs from the last to a state folder; an offset is such a listing's number. The events between
two offsets are the difference of two written listings, made in the tasks, each for its share of the names:
the same however often a batch is run again, so that a restart from a checkpoint neither loses nor repeats any.

The folder and the state folder must be seen under one path by the driver and all executors. A file is known by its
size and time of change. Listings that no batch can ask for again are deleted.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from skein.functions import language, vendored
from skein.operators import build, extract
from skein.sources import folders

SCHEMA = "rel string, change string, size long, changed timestamp, listing long"
_ARROW = pa.schema([("rel", pa.string()), ("change", pa.string()), ("size", pa.int64()), ("changed", pa.timestamp("us", "UTC")), ("listing", pa.int64())])


def listing(root: str) -> dict[str, tuple[int, int]]:
    """Size and time of change (ns) of every file below root, hidden folders left out; one that goes meanwhile is not there."""
    found = {}
    for folder, below, names in os.walk(root):
        below[:] = [b for b in below if not b.startswith(".")]
        for name in names:
            path = os.path.join(folder, name)
            try:
                s = os.stat(path)
            except OSError:
                continue
            found[os.path.relpath(path, root)] = (s.st_size, s.st_mtime_ns)
    return found


class Listings:
    """Numbered listings in the state folder; number 0 is the empty one unless it is written."""

    def __init__(self, state: str):
        self.at = Path(state)

    def path(self, n: int) -> Path:
        return self.at / f"listing-{n}.json"

    def numbers(self) -> list[int]:
        return sorted(int(p.stem.split("-")[1]) for p in self.at.glob("listing-*.json"))

    def read(self, n: int) -> dict[str, tuple[int, int]]:
        p = self.path(n)
        return {k: tuple(v) for k, v in json.loads(p.read_text()).items()} if n or p.exists() else {}

    def write(self, n: int, found: dict) -> None:
        self.at.mkdir(parents=True, exist_ok=True)
        part = self.at / f".listing-{n}.part"
        part.write_text(json.dumps(found))
        part.rename(self.path(n))  # there whole or not at all


@dataclass
class Share(InputPartition):
    before: int
    after: int
    share: int
    shares: int


class FileChanges(DataSource):
    """Options: path, state, existing (true: files that are there at first are created ones) and shares (tasks)."""

    @classmethod
    def name(cls):
        return "file_changes"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return ChangeReader(self.options)


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.kept = options["path"].removeprefix("file://"), Listings(options["state"].removeprefix("file://"))
        self.existing, self.shares = options.get("existing", "true") == "true", int(options.get("shares", 4))

    def initialOffset(self):
        if not self.existing and not self.kept.path(0).exists():
            self.kept.write(0, listing(self.root))
        return {"listing": 0}

    def latestOffset(self):
        last, now = max(self.kept.numbers(), default=0), listing(self.root)
        if now == self.kept.read(last):
            return {"listing": last}
        self.kept.write(last + 1, now)
        return {"listing": last + 1}

    def partitions(self, start, end):
        return [Share(start["listing"], end["listing"], i, self.shares) for i in range(self.shares)]

    def read(self, part):
        before, after = self.kept.read(part.before), self.kept.read(part.after)
        rows = []
        for rel in sorted(before.keys() | after.keys()):
            if before.get(rel) != after.get(rel) and xxhash.xxh64_intdigest(rel) % part.shares == part.share:
                size, at = after.get(rel, (None, None))
                rows.append((rel, "remove" if rel not in after else "create" if rel not in before else "modify", size, at and at // 1000, part.after))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, _ARROW)], schema=_ARROW)

    def commit(self, end):
        for n in self.kept.numbers():
            if n < end["listing"]:
                self.kept.path(n).unlink(missing_ok=True)


def changes(spark: SparkSession, root: str, state: str, existing: bool = True) -> DataFrame:
    """A stream of rel, change (create, modify, remove), size, changed, listing."""
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").options(path=root, state=state, existing=str(existing).lower()).load()


# ---- a graph that follows ----


def read_files(spark: SparkSession, root: str, rels: list[str]) -> DataFrame:
    """(rel, source, language) of those of these files that are still there and of a known language."""
    found = folders.texts(folders.contents(spark.createDataFrame([(r,) for r in rels], "rel string"), root))
    return found.withColumn("language", language(F.col("rel"))).where(F.col("language").isNotNull() & ~vendored(F.col("rel")))


class Follower:
    """What a graph is made of (extract.structures), kept below a folder, one version a batch; a batch run again writes the same version."""

    def __init__(self, spark: SparkSession, root: str, home: str):
        self.spark, self.root, self.home = spark, root, home.removeprefix("file://")

    def versions(self) -> list[int]:
        return sorted(int(p.name.split("-")[1]) for p in Path(self.home).glob("facts-*") if (p / "_SUCCESS").exists())

    def facts(self, before: int | None = None) -> DataFrame | None:
        known = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"file://{self.home}/facts-{known[-1]}") if known else None

    def graph(self) -> build.Graph:
        found = self.facts()
        return build.assembled(found if found is not None else extract.structures(self.spark.createDataFrame([], "rel string, source string, language string")))

    def __call__(self, events: DataFrame, epoch: int) -> None:
        """Parse the files of a batch of changes anew and take the rest over; the last event of a file counts."""
        last = events.withColumn("_n", F.row_number().over(Window.partitionBy("rel").orderBy(F.desc("listing")))).where("_n = 1").select("rel")
        touched = [r["rel"] for r in last.collect()]  # names of one batch, which the driver has listed itself
        fresh = extract.structures(read_files(self.spark, self.root, touched))
        old = self.facts(before=epoch)
        whole = fresh if old is None else old.join(last, "rel", "left_anti").unionByName(fresh)
        whole.write.mode("overwrite").parquet(f"file://{self.home}/facts-{epoch}")


def follow(spark: SparkSession, root: str, home: str, then: Callable[[build.Graph, int], None] | None = None, existing: bool = True):
    """Start a query that keeps a Follower's graph up to the folder's state; then() gets the graph after each batch."""
    keeper = Follower(spark, root, f"{home}/graph")

    def batch(events: DataFrame, epoch: int) -> None:
        keeper(events, epoch)
        if then:
            then(keeper.graph(), epoch)

    stream = changes(spark, root, f"{home}/listings", existing)
    return keeper, stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{home}/checkpoint").outputMode("append")
