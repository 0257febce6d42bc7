"""A spool of JSON lines that tasks write together and that rolls over at a ceiling.

Below the spool's folder, `live` holds the files that count and `old` the one generation before them. A task writes whole
lines to files of its own in `staged`, each of at most `ceiling` bytes, and tells the driver their names; the commit notes
them in a manifest and then moves them to `live`. What a failed or repeated task has staged is in no manifest, so no line is
there twice or in part; a commit that broke off is finished by the next one, or by recover(). Once `live` holds more than the ceiling,
the next commit makes it `old`, in place of the generation before.

As a stream's sink a batch that is run again is known by its number and adds nothing. The folder must be seen under one path by
the driver and all executors. Readers see both generations.
"""

from __future__ import annotations

import json
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from skein import sources

CEILING = 64 << 20  # a fixed value


@dataclass
class Staged(WriterCommitMessage):
    names: list[str]


class Folder:
    def __init__(self, path: str, ceiling: int = CEILING):
        self.at, self.ceiling = Path(path.removeprefix("file://")), ceiling
        self.live, self.old, self.staged = (self.at / n for n in ("live", "old", "staged"))

    def stage(self, lines: Iterator[str]) -> Staged:
        self.staged.mkdir(parents=True, exist_ok=True)
        names, out, size = [], None, 0
        for line in lines:
            data = line.encode() + b"\n"
            if out is None or size + len(data) > self.ceiling:
                if out:
                    out.close()
                names.append(f"{uuid.uuid4().hex}.jsonl")
                out, size = open(self.staged / names[-1], "wb"), 0
            out.write(data)
            size += len(data)
        if out:
            out.close()
        return Staged(names)

    def commit(self, messages, mark: int | None = None) -> None:
        self.recover()
        names = [n for m in messages if m for n in m.names]
        if mark is not None and mark <= self.last_mark():
            return self.drop(names)
        part = self.staged / f"{uuid.uuid4().hex}.part"
        self.staged.mkdir(parents=True, exist_ok=True)
        part.write_text(json.dumps({"names": names, "mark": mark, "roll": self.size() > self.ceiling}))
        part.rename(part.with_suffix(".manifest"))  # from here on the commit will be finished
        self.recover()

    def recover(self) -> None:
        """Finish what a commit that broke off has noted."""
        for manifest in self.staged.glob("*.manifest"):
            said = json.loads(manifest.read_text())
            if said["roll"]:
                moved = self.at / f"rolled-{manifest.stem}"  # a second time finds it there, and live begun anew
                if self.live.exists() and not moved.exists():
                    self.live.rename(moved)
                self.live.mkdir(parents=True, exist_ok=True)
            self.live.mkdir(parents=True, exist_ok=True)
            for n in said["names"]:
                if (self.staged / n).exists():
                    (self.staged / n).rename(self.live / n)
            if said["mark"] is not None:
                (self.at / "mark.part").write_text(str(said["mark"]))
                (self.at / "mark.part").rename(self.at / "mark")
            if said["roll"]:
                shutil.rmtree(self.old, ignore_errors=True)
                if (self.at / f"rolled-{manifest.stem}").exists():
                    (self.at / f"rolled-{manifest.stem}").rename(self.old)
            manifest.unlink()

    def last_mark(self) -> int:
        return int((self.at / "mark").read_text()) if (self.at / "mark").exists() else -1

    def size(self) -> int:
        return sum(p.stat().st_size for p in self.live.glob("*.jsonl"))

    def drop(self, names: list[str]) -> None:
        for n in names:
            (self.staged / n).unlink(missing_ok=True)


class Spool(DataSource):
    """Write only, rows of one string column, a line each. Options: path and ceiling (bytes)."""

    @classmethod
    def name(cls):
        return "spool"

    def writer(self, schema, overwrite):
        return Writer(Folder(self.options["path"], int(self.options.get("ceiling", CEILING))))

    def streamWriter(self, schema, overwrite):
        return StreamWriter(Folder(self.options["path"], int(self.options.get("ceiling", CEILING))))


class Writer(DataSourceWriter):
    def __init__(self, folder: Folder):
        self.folder = folder

    def write(self, iterator):
        return self.folder.stage(row[0] for row in iterator)

    def commit(self, messages):
        self.folder.commit(messages)

    def abort(self, messages):
        self.folder.drop([n for m in messages if m for n in m.names])


class StreamWriter(DataSourceStreamWriter):
    def __init__(self, folder: Folder):
        self.folder = folder

    def write(self, iterator):
        return self.folder.stage(row[0] for row in iterator)

    def commit(self, messages, batchId):
        self.folder.commit(messages, batchId)

    def abort(self, messages, batchId):
        self.folder.drop([n for m in messages if m for n in m.names])


def lines_of(rows: DataFrame) -> DataFrame:
    """One JSON line a row, null fields left out; a line never holds a line end."""
    return rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("value"))


def append(rows: DataFrame, path: str, ceiling: int = CEILING) -> None:
    """Add rows to a spool: all of them or none."""
    rows.sparkSession.dataSource.register(Spool)
    lines_of(rows).write.format("spool").mode("append").option("path", path).option("ceiling", ceiling).save()


def append_stream(rows: DataFrame, path: str, checkpoint: str, ceiling: int = CEILING):
    """Start a query that adds a stream's rows to a spool, each once."""
    rows.sparkSession.dataSource.register(Spool)
    return lines_of(rows).writeStream.format("spool").option("path", path).option("ceiling", ceiling).option("checkpointLocation", checkpoint).outputMode("append").start()


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Both generations; lines that do not parse keep their text in _corrupt_record. None yet: no rows."""
    folder = Folder(path)
    folder.recover()
    there = [f"file://{p}" for p in (folder.old, folder.live) if p.exists() and any(p.iterdir())]
    return sources.spool(spark, there, schema) if there else spark.createDataFrame([], schema)


def verdict_lines(evaluations: DataFrame) -> DataFrame:
    """What a verdict spool holds of evaluations (ts, predicate_id, target_ref, outcome, turtle, evidence): those that concluded
    something, with an excerpt of the judged text where it was found wanting."""
    known = evaluations.where(F.col("outcome").isin("satisfied", "unsatisfied"))
    return known.select("ts", "predicate_id", "target_ref", "turtle", F.when(F.col("outcome") == "unsatisfied", F.substring("evidence", 1, 512)).alias("denied_excerpt"))
