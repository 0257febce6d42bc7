"""Shared scratch tables: cut lineage without leaving files on one machine."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
_SIMPLE = ("Project", "Filter", "Relation", "RelationV2")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a temporary one if all tasks run in this
    process (tests, one machine); a cluster without one is refused, since its executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not getattr(context, "_skein_dir", None):
            context._skein_dir = "file://" + tempfile.mkdtemp(prefix="skein-")
        found = context._skein_dir
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again. The files go with discard(), or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def is_scan(df: DataFrame) -> bool:
    """Whether df only reads, filters and projects files by fixed rules, so that reading it again gives the same rows in the same order."""
    plan = df._jdf.queryExecution().optimizedPlan()
    simple = all(line.lstrip(" +-:").split(" ")[0].split("[")[0] in _SIMPLE for line in plan.toString().strip().splitlines())
    return simple and plan.deterministic()


def stable(df: DataFrame) -> DataFrame:
    """df itself if it is a plain scan, else its rows written and read: for what is read many times."""
    return df if is_scan(df) else settle(df)


def discard(df: DataFrame | None) -> None:
    """Delete what settle() wrote for df: for the earlier rounds of a loop, which nothing reads again."""
    path = getattr(df, "_skein_path", None)
    spark = _made.pop(path, None)
    if spark is None:
        return
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: its folder is the cluster's to clear
        return


def settle_alone(make, *spent: DataFrame) -> DataFrame:
    """settle(make()), and then delete what make() settled on its way and the spent tables."""
    before = set(_made)
    out = settle(make())
    for path in set(_made) - before - {out._skein_path}:
        discard(type("Written", (), {"_skein_path": path}))
    for df in spent:
        discard(df)
    return out


def forget() -> None:
    """Delete every table that settle() has written."""
    for path in list(_made):
        discard(type("Written", (), {"_skein_path": path}))


atexit.register(forget)
