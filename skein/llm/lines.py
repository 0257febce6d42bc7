"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble.

A line's key is the line without the given blanks at both ends and with A-Z lower-cased.
Keys of at least `min_chars` code points found in at least `min_docs` documents lose their
lines everywhere but in the smallest document that holds them.

Lines are exploded and hashed once: 16-byte key hashes and positions are written, and shuffled
by key (pre-aggregated on the map side, so a line that every document repeats is one row a
task); where positions meet their keys, keys with over a thousandth of the rows (fewer than a
thousand, so they are broadcast) are salted. The text moves once, by document, and is put
together again from its kept positions in time linear in its lines.

Defined results: a null or empty text is one empty line. A null id counts as the largest
document. Rows that repeat an id are one document, and each row is cleaned by itself.
An empty table gives an empty result. One text must fit a task. Columns of the input named
like an output give way; any other names are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.scratch import settle, stable

HOT, SALTS = 1000, 64
OUT = ("kept_text", "n_lines", "n_dropped")
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    line = F.btrim(line, F.lit(BLANKS))
    # lower() has a fast path and means the same where all characters are ASCII
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs plus kept_text, n_lines and n_dropped."""
    docs = stable(docs)
    own = [F.col(f"`{c}`") for c in docs.columns if c not in OUT]
    # the input's columns travel in one struct, so that no name of theirs meets one of these
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(*own).alias("row"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    flat = settle(
        rows.select("doc", "hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("doc", "hash", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.reverse("key"), F.lit(7)).alias("g"))
    )
    per_doc = flat.groupBy("h", "g", "doc").agg(F.lit(1).alias("one")) if min_docs > 2 else flat
    often = per_doc.groupBy("h", "g").agg(F.min("doc").alias("keep"), F.max("doc").alias("top"), F.count(F.lit(1)).alias("n"))
    often = settle(often.where(F.col("n") >= min_docs if min_docs > 2 else F.col("top") > F.col("keep") if min_docs == 2 else F.lit(True)))
    # fewer than HOT keys can each have over 1 / HOT of the rows: their rows are salted
    total = often.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(often.where(F.col("n") * HOT > total).select("h", "g", F.lit(SALTS).alias("salts")))
    salted = flat.join(hot, ["h", "g"], "left").withColumn("salt", F.pmod(F.xxhash64("doc"), F.coalesce("salts", F.lit(1))))
    keys = often.select("h", "g", "keep", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") * HOT > total, SALTS - 1).otherwise(0).cast("long"))).alias("salt"))
    drops = salted.join(keys, ["h", "g", "salt"]).where(F.col("doc") != F.col("keep")).groupBy("doc", "hash").agg(F.collect_set("pos").alias("drop"))
    # written, so that rows that share an id and a text can be split where they meet their positions
    joined = rows.join(settle(drops), ["doc", "hash"], "left")
    kept = F.transform(F.array(F.split("text", "\n", -1)), lambda every: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("drop")), lambda i: F.get(every, i)), "\n"))
    done = joined.select(
        "row",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept[0]).alias("kept_text"),
        (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return done.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in OUT), *OUT)


def report(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


SQL = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS pos FROM parts),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
often AS (SELECT k, min(doc_id) AS keep FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE keep IS NOT NULL AND keep <> doc_id))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep IS NULL OR keep = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (k) GROUP BY doc_id
"""
