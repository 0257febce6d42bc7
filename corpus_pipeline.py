"""The corpus pipeline: five stages from raw documents to a mixed training order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's
rows as Parquet in the shared folder and reads them as the next one's documents. All but the
last return the columns of documents; other columns are not carried.

Line dedup is for lines that otherwise different documents share. A document that would lose
half of its characters or more is a copy rather than a carrier of such lines: it stays whole, so
that near duplicates, which come next, see copies as they are and one of each group stays.

Defined results. Null and empty texts: they score as clean, have no lines to lose, link with
nothing, are never contaminated and have no tokens, so the last stage gives them budget only
along with their block. Null ids: rows like others; null-id copies go like others. Repeated rows:
each row is judged by itself, and of repeated texts one row stays, that with the smallest id (null
ids last), of equal ids the first read. Long texts: each must fit a task. Empty tables give an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, jaccard, lines, mixing, toxicity
from skein.scratch import settle, settle_alone

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(docs.select(*COLUMNS), labels).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first alone; documents mostly made of such lines are left to the next stage."""
    out = lines.dedup_lines(docs.select(*COLUMNS))
    cut = (F.col("n_dropped") > 0) & (2 * F.length("kept_text") > F.length("text"))
    return out.select("doc_id", F.when(cut, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the row of the smallest id stays."""
    rows = settle(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))  # ids can be null or repeated
    found = jaccard.near_duplicates(rows, k=5, percent=80, id_col="_row", links=False)
    named = found.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id"), "_row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    return rows.join(first.select(F.col("first._row").alias("_row")), "_row", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, by the share of their words, go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs.select(*COLUMNS), benchmark).where(~F.col("contaminated")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: one row for each time a document is read."""
    return mixing.mix(docs.select("doc_id", "text", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Toxicity is learned, so SQL cannot give the rows; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
