"""Files of a folder, names first: Spark's own file sources pass over names that begin with `_` or `.`, such as `__init__.py`."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 16 << 20  # bytes of files in one batch of a task


def local(root: str) -> str | None:
    """The path of a folder that all processes see under one path; None for other stores."""
    return root.removeprefix("file://") if "://" not in root or root.startswith("file://") else None


def names(spark: SparkSession, root: str) -> DataFrame:
    """(rel) of all files below root; links are not followed."""
    found = [os.path.relpath(os.path.join(folder, name), root) for folder, _, files in os.walk(root) for name in files]
    return spark.createDataFrame([(f,) for f in sorted(found)], "rel string")


def contents(rels: DataFrame, root: str) -> DataFrame:
    """(rel, content) of files (rel, ...), read in the tasks; those that are gone or no files are left out."""

    def run(batches):
        for batch in batches:
            got, size = [], 0
            for rel in batch.column(0).to_pylist():
                try:
                    with open(os.path.join(root, rel), "rb") as f:
                        got.append((rel, f.read()))
                except OSError:
                    continue
                size += len(got[-1][1])
                if size > BATCH:
                    yield as_batch(got)
                    got, size = [], 0
            yield as_batch(got)

    def as_batch(got):
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.binary())], names=["rel", "content"])

    return rels.select("rel").repartition("rel").mapInArrow(run, "rel string, content binary")


def texts(files: DataFrame) -> DataFrame:
    """(rel, source) of (rel, content); null where it is not UTF-8."""
    return files.select("rel", F.expr("try_validate_utf8(CAST(content AS STRING))").alias("source"))


def below(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(rel, source) below root, as far as the store lets Spark see the names."""
    at = local(root)
    if at is not None:
        rels = names(spark, at)
        if glob:
            rels = rels.where(F.col("rel").rlike(glob))
        return texts(contents(rels, at))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    start = F.expr("substring(path, locate(base, path) + length(base))")
    found = raw.withColumn("base", F.lit(os.path.join(root, ""))).select(start.alias("rel"), "content")
    return texts(found.where(F.col("rel").rlike(glob)) if glob else found)
