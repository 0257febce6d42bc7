"""Readers and writers: source trees, commits, spools, transcripts, results and sinks."""

from __future__ import annotations

import json
import re
import time
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, is_dataclass
from pathlib import Path
from types import NoneType, UnionType
from typing import get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import language, vendored
from skein.operators.rules import any_glob
from skein.scratch import stable
from skein.sources import folders, ignores


def working_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, languages: list[str] | None = None, hidden: bool = False, rule_files: bool = True) -> DataFrame:
    """(rel, source, language) of the parseable files below root, without vendored and minified ones, those that the tree's own
    rule files ignore (ignores.py), hidden ones unless asked for, and those that the globs `ignore` name. A file that is not UTF-8 has no source."""
    files = folders.below(spark, root)
    own = ignores.ignored(files, ignores.rules_of(files) if rule_files else ignores.no_rules(spark), not hidden).where(~F.col("ignored")).drop("ignored")
    out = own.withColumn("language", language(F.col("rel"))).where(F.col("language").isNotNull() & ~vendored(F.col("rel")) & ~any_glob(F.col("rel"), ignore or []))
    return out.where(F.col("language").isin(*languages)) if languages else out


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """(rel, text) of markdown files below root."""
    return folders.below(spark, root, r"\.(?:md|markdown)$").where(~vendored(F.col("rel"))).select("rel", F.col("source").alias("text"))


def at_commit(files: DataFrame, commit: str) -> DataFrame:
    """One commit of a files table partitioned by commit."""
    return files.where(F.col("commit") == commit)


def diff(files: DataFrame, a: str, b: str) -> DataFrame:
    """(rel, change) between two commits by content hash."""
    left, right = at_commit(files, a).select("rel", F.col("hash").alias("_a")), at_commit(files, b).select("rel", F.col("hash").alias("_b"))
    both = left.join(right, "rel", "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return both.select("rel", change.alias("change")).where("change IS NOT NULL")


def checked_diff(files: DataFrame, a: str, b: str) -> tuple[str, DataFrame | None]:
    """evaluated and the rows, or why not: an unresolved commit is not an empty difference."""
    known = {r[0] for r in files.where(F.col("commit").isin(a, b)).select("commit").distinct().collect()}
    missing = [c for c in (a, b) if c not in known]
    return (f"unresolved:{','.join(missing)}", None) if missing else ("evaluated", diff(files, a, b))


METRICS = "kind string, ts long, agent string, tenant string, item string, session string, result string, mode string, rule string, ext string, path string, verb string, target string, target_class string, duration_ms long, _corrupt_record string"
VERDICTS = "ts long, predicate_id string, target_ref string, turtle string, denied_excerpt string, _corrupt_record string"
THROTTLES = "constraint_id string, scope string, until long, _corrupt_record string"


def spool(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A JSON-lines spool; lines that do not parse keep their text in _corrupt_record."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def well_formed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def spool_watermark(spark: SparkSession, path: str) -> str:
    """spool@mtime:length of the newest file."""
    row = spark.read.format("binaryFile").load(path).agg(F.max("modificationTime").alias("m"), F.sum("length").alias("n")).first()
    return f"spool@{int(row['m'].timestamp())}:{row['n']}"


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """(session, idx, kind, path, lo, hi, cmd) events of session transcripts, one JSON object a line."""
    schema = "session string, idx int, tool string, input struct<file_path:string,offset:double,limit:double,command:string>, type string"
    raw = spark.read.schema(schema).json(path)
    kind = F.when(F.col("type") == "compact", "compact").when(F.col("tool") == "Read", "read").when(F.col("tool").isin("Edit", "Write"), "edit").when(F.col("tool") == "Bash", "bash")
    lo = F.coalesce("input.offset", F.lit(0.0))
    return raw.select("session", "idx", kind.alias("kind"), F.col("input.file_path").alias("path"), lo.alias("lo"), (lo + F.coalesce("input.limit", F.lit(float("inf")))).alias("hi"), F.col("input.command").alias("cmd")).where("kind IS NOT NULL")


def cochange(rows: DataFrame, text: str) -> DataFrame:
    """(file) of a JSON array or a list of lines."""
    t = F.trim(F.col(text))
    items = F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.split(t, r"\r?\n"))
    return rows.select(F.explode(items).alias("file")).where("file <> ''").distinct()


def bindings(spark: SparkSession, results: str) -> DataFrame:
    """(row, var, value) of a SPARQL-results JSON text."""
    data = json.loads(results)["results"]["bindings"]
    return spark.createDataFrame([(i, v, b[v]["value"]) for i, b in enumerate(data) for v in b], "row int, var string, value string")


def decode(rows: DataFrame, key: str, required: list[str], many: list[str]) -> DataFrame:
    """One row a key of (row, var, value) bindings: `many` variables collected, required ones single, else `error` says which."""
    wide = rows.groupBy("row").pivot("var", [key, *required, *many]).agg(F.first("value"))
    out = wide.groupBy(key).agg(*(F.count_distinct(r).alias(f"_{r}") for r in required), *(F.min(r).alias(r) for r in required), *(F.array_join(F.array_sort(F.collect_set(m)), " — ").alias(m) for m in many))
    bad = F.concat_ws(",", *(F.when(F.col(f"_{r}") != 1, r) for r in required))
    return out.select(key, *required, *many, F.nullif(bad, F.lit("")).alias("error"))


def exposure(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """paths (repo, ...) with exposure public, internal or unknown, from a dimension (repo, exposure)."""
    return paths.join(repos.select("repo", "exposure"), "repo", "left").fillna("unknown", ["exposure"])


def plate(text: str | None, now: float, max_age: float = 4 * 3600) -> str | None:
    """The item of a {item, at} record, unless it is unreadable or stale."""
    try:
        row = json.loads(text or "")
        return row["item"] if now - float(row["at"]) <= max_age else None
    except (ValueError, KeyError, TypeError):
        return None


# Tables, keys, defaults and allowed words of the settings file.
@dataclass
class Freshness:
    debounce_ms: int = 300
    heavy_debounce_ms: int = 1500
    lsp_on: str = "save"


@dataclass
class Tenancy:
    max_overlays: int = 32
    high_fanin_threshold: int = 200
    overlay_eviction: str = "on_session_close"


@dataclass
class Serve:
    bind_address: str = "127.0.0.1"
    mcp_http_port: int = 3040
    read_only: bool = False
    use_daemon: bool = False


@dataclass
class Governed:
    """The store that rules are projected from and facts promoted to; its table's name is the caller's (`store_table`)."""

    enabled: bool = False
    promote_on: str = "merge"
    branch_model: str = "named_graph"
    shapes_path: str = "shapes/"
    endpoint: str = ""
    signing_key_path: str = ""
    projection_cache_ttl_secs: int = 3600


@dataclass
class PathScope:
    allow_paths: list[str] = field(default_factory=list)
    deny_paths: list[str] = field(default_factory=list)
    max_impacted_symbols: int | None = None
    max_impacted_files: int | None = None
    allow_targets: list[str] = field(default_factory=list)
    deny_targets: list[str] = field(default_factory=list)


@dataclass
class Policy:
    mode: str = "off"
    deadline_ms: int = 100
    notify_on_fail_open: bool = True
    max_hops: int = 5
    scopes: dict[str, PathScope] = field(default_factory=dict)
    rules: list[dict] = field(default_factory=list)
    verify: bool = False
    work_item_scope: str = "off"
    action_scope: str = "off"


@dataclass
class Metrics:
    record_paths: str = "off"


@dataclass
class Config:
    base_ref: str = "main"
    enable_lsp: bool = True
    enable_cpg: bool = False
    languages: list[str] = field(default_factory=lambda: ["rust", "typescript", "python", "go", "java", "cpp"])
    freshness: Freshness = field(default_factory=Freshness)
    tenancy: Tenancy = field(default_factory=Tenancy)
    serve: Serve = field(default_factory=Serve)
    store: Governed = field(default_factory=Governed)
    policy: Policy = field(default_factory=Policy)
    metrics: Metrics = field(default_factory=Metrics)


_MODES = ("off", "advise", "enforce")
ENUMS = {("policy", "mode"): _MODES, ("policy", "work_item_scope"): _MODES, ("policy", "action_scope"): _MODES, ("metrics", "record_paths"): ("off", "relative", "absolute")}
RULE_KEYS = ("name", "language", "query", "match_type", "pattern")


def merged(a: dict, b: dict) -> dict:
    """b over a, table by table."""
    return a | {k: merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


def config(*texts: str, table: str | None = None, store_table: str = "store") -> Config:
    """Defaults under TOML texts, later ones over earlier ones, table by table. Only `table` of a file counts, where that is given; a
    text without it changes nothing. Keys that are not known are passed over; values of another type, and words that are not
    among a setting's, are errors, also in a text that a later one overrules."""
    raw: dict = {}
    for t in texts:
        one = tomllib.loads(t)
        one = one.get(table, {}) if table else one
        _filled(one, store_table)
        raw = merged(raw, one)
    return _filled(raw, store_table)


def _filled(raw: dict, store_table: str) -> Config:
    def typed(value, hint, where: tuple):
        said = ".".join(where)
        if is_dataclass(hint):
            return fill(hint(), value, where)
        if get_origin(hint) is UnionType:
            hint = next(h for h in get_args(hint) if h is not NoneType)
        if get_origin(hint) is dict:
            return {k: typed(v, get_args(hint)[1], (*where, k)) for k, v in (value.items() if isinstance(value, dict) else [(None, None)])}
        if get_origin(hint) is list:
            if not isinstance(value, list):
                raise ValueError(f"{said} must be a list")
            return [typed(v, get_args(hint)[0], where) for v in value]
        if hint is int and (isinstance(value, bool) or not isinstance(value, int) or value < 0) or not isinstance(value, hint):
            raise ValueError(f"{said} must be of type {hint.__name__}")
        if value not in ENUMS.get(where, (value,)):
            raise ValueError(f"{said} must be one of {', '.join(ENUMS[where])}")
        if where == ("policy", "rules") and (missing := [k for k in RULE_KEYS if k not in value]):
            raise ValueError(f"{said} needs {', '.join(missing)}")
        return value

    def fill(target, values, where: tuple):
        if not isinstance(values, dict):
            raise ValueError(f"{'.'.join(where)} must be a table")
        hints = get_type_hints(type(target))
        for k, v in values.items():
            name = "store" if not where and k == store_table else k
            if name in hints:
                setattr(target, name, typed(v, hints[name], (*where, name)))
        return target

    return fill(Config(), raw, ())


def mode_source(user: str | None, project: str | None, table: str | None = None) -> tuple[str, str, bool]:
    """(mode, whose it is, whether the project lowers what the user set): for the two settings texts."""
    said = []
    for text in (user, project):
        one = tomllib.loads(text or "")
        said.append((one.get(table, {}) if table else one).get("policy", {}).get("mode"))
    mode = config(*(t for t in (user, project) if t), table=table).policy.mode
    source = "project" if said[1] is not None else "user" if said[0] is not None else "default"
    return mode, source, said[0] is not None and said[1] is not None and _MODES.index(mode) < _MODES.index(said[0])


# ---- sinks ----


def write_text(rows: DataFrame, path: str) -> None:
    """A (value) frame as text files."""
    rows.write.mode("overwrite").text(path)


def append_spool(rows: DataFrame, path: str) -> None:
    """JSON lines without null fields, added to a spool."""
    rows.write.mode("append").option("ignoreNullFields", "true").json(path)


class Refused(RuntimeError):
    """Nothing was written, and why."""


def publish(triples: DataFrame, violations: DataFrame, write: Callable[[DataFrame], None], attempts: int = 3, wait: float = 2.0, dry_run: bool = False, sleep: Callable[[float], None] = time.sleep) -> dict:
    """All or nothing: any violation refuses the whole; transient failures (ConnectionError, TimeoutError) are tried again."""
    bad = violations.count()
    if bad:
        raise Refused(f"{bad} violations")
    n = triples.count()
    if dry_run:
        return {"triples": n, "written": False}
    return {"triples": n, "written": True, "attempts": tried(lambda: write(triples), attempts, wait, sleep)}


def tried(send: Callable[[], None], attempts: int, wait: float, sleep: Callable[[float], None]) -> int:
    """send(), again after transient failures, waiting longer each time; returns how often."""
    for attempt in range(1, attempts + 1):
        try:
            send()
            return attempt
        except (ConnectionError, TimeoutError):
            if attempt == attempts:
                raise
            sleep(wait * attempt)
    raise AssertionError


def publish_chunks(chunks: DataFrame, violations: DataFrame, write: Callable[[DataFrame, int], None], attempts: int = 3, wait: float = 2.0, dry_run: bool = False, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Send chunks (chunk, ...) one after the other, each whole and in order; any violation refuses all before the first is sent. A chunk that
    cannot be sent ends it: the error names it, and what went before it has been written."""
    bad = violations.count()
    if bad:
        raise Refused(f"{bad} violations")
    held = stable(chunks)
    sent, tries = 0, 0
    for row in held.select("chunk").distinct().orderBy("chunk").toLocalIterator():
        if dry_run:
            sent += 1
            continue
        try:
            tries += tried(lambda n=row["chunk"]: write(held.where(F.col("chunk") == n).drop("chunk"), n), attempts, wait, sleep)
        except (ConnectionError, TimeoutError) as e:
            raise Refused(f"chunk {row['chunk']} after {sent} that were written: {e}") from e
        sent += 1
    return {"chunks": sent, "written": not dry_run, "attempts": tries}


def quarantine(rows: DataFrame, path: str, reason: str) -> None:
    """Keep a refused payload with the reason."""
    rows.withColumn("refused", F.lit(reason)).write.mode("append").json(path)


def changed(*lists: DataFrame) -> DataFrame:
    """(rel) of several change lists: committed, uncommitted, untracked."""
    out = lists[0].select("rel")
    for other in lists[1:]:
        out = out.unionByName(other.select("rel"))
    return out.distinct()


def replace_snapshot(rows: DataFrame, path: str, partition: str = "snapshot") -> None:
    """Overwrite only the partitions that rows hold."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def drain(rows: DataFrame, path: str, write: Callable[[DataFrame], DataFrame]) -> bool:
    """Write a spool's rows and delete the spool only if write() rejected none; returns whether it went."""
    if not write(rows).isEmpty():
        return False
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def read_config(*paths: str, table: str | None = None, store_table: str = "store") -> Config:
    return config(*(Path(p).read_text() for p in paths if Path(p).exists()), table=table, store_table=store_table)
