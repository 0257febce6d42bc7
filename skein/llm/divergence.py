"""Source divergence audit: how far each source's vocabulary is from its language's and from other sources'.

Each language keeps the terms that at least `min_docs` of its documents hold. A group (language,
source) and its language give every kept term p = 1 + floor(UNIT * (count + 2) / (N + 2 V)); two
such values are f(p, q) = floor((p - q)^2 / (p + q)) apart.

Terms that lead a group are ranked by radix select: histograms over ten bits of f at a time (ten
bits, at most 1024 bins a group, counted before they are shuffled) find each group's k-th value;
terms above it are in, and terms at it are narrowed byte by byte of their UTF-8 form, past what
all that are left share, until the wanted number is left. No group is sorted.

Pairs of sources are sums over all kept terms, but most terms are missing in most sources. A term
that both lack is the same for all such terms; so V times that baseline is corrected by the terms
of each side alone (by distinct p) and by those of both. Sources are dealt to tiles of about
`tile`, and a task gets two tiles' terms of one hash bucket and adds up in matrices of
tile x tile whole numbers, so neither terms nor pairs are expanded into rows; tasks grow with the
terms of a language and with the square of its tiles, as the result does.

Counts are made in the tasks that read the texts and shuffled as one row a distinct term, group
and slice. Where rows meet figures of their group, both sides are salted, so that a group with a
third of all rows is spread.

Defined results: null text, lang and source read as ''. Each row is a document, also where ids
repeat or are null; ids are not read. A text without terms still makes its group occur. A language
without kept terms has pairs of value 0 and no terms. Ties go to the smaller UTF-8 bytes. Very
long texts must fit a task, at some 60 bytes a byte, very long terms too. No rows give no rows.
"""

from __future__ import annotations

from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import textops as X
from skein.scratch import discard, settle

UNIT = 1_000_000_000
BITS, VALUE_BITS = 10, 30  # f is at most UNIT, under 2**30
SALTS = 64
LETTER = np.zeros(256, bool)  # [^\x00-\x40\x5B-\x60\x7B-\x7F]
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
GROUP = ["lang", "source"]
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_TABLE = "lang string, source string, term string, n long, docs long"


def slice_counts(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """A row a distinct group and term: occurrences and documents; and one with a null term for each group."""
    data, offsets = X.buffer_of(texts)
    starts, ends, at = X.tokens(data, offsets, LETTER)
    sizes = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(X.LOWER[data[LETTER[data]]] if len(data) else data)]).dictionary_encode()
    code, terms = np.asarray(words.indices).astype(np.int64), words.dictionary.cast(pa.string())
    own = [c.dictionary_encode() for c in (langs, sources)]
    many = max(len(own[1].dictionary), 1)
    groups, group = np.unique(np.asarray(own[0].indices).astype(np.int64) * many + np.asarray(own[1].indices), return_inverse=True)
    step = max(len(terms), 1)
    pairs, often = np.unique(np.repeat(np.arange(len(texts)), np.diff(at)) * step + code, return_counts=True)
    keys, place = np.unique(group[pairs // step] * step + pairs % step, return_inverse=True)
    n, docs = np.bincount(place, often, len(keys)).astype(np.int64), np.bincount(place, minlength=len(keys))
    of = groups[np.concatenate([keys // step, np.arange(len(groups))])]
    name = [own[i].dictionary.take(pa.array(x)) for i, x in enumerate((of // many, of % many))]
    none = np.zeros(len(groups), np.int64)
    held = pa.array(np.concatenate([keys % step, none]), mask=np.concatenate([np.zeros(len(keys), bool), np.ones(len(groups), bool)]))
    return pa.RecordBatch.from_arrays([*name, terms.take(held), pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs.astype(np.int64), none]))], schema=_COUNTS)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", slice_bytes: int = 8 << 20) -> DataFrame:
    """lang, source, term, n, docs: over all rows; a null term stands for the group itself."""
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            for low, high in X.slices(np.diff(X.buffer_of(texts)[1]), slice_bytes):
                yield slice_counts(*(batch.column(i).slice(low, high - low) for i in range(3)))

    made = docs.select(filled(lang_col), filled(source_col), filled(text_col)).mapInArrow(run, _TABLE)
    return made.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p, exact: decimals hold what 64 bits would not. Asked only where something is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", (wide(count) + F.lit(2)) * F.lit(UNIT).cast("decimal(10,0)"), wide(total) + wide(kept) + wide(kept)) + 1


def apart(p: Column, q: Column) -> Column:
    """f: p and q are at most UNIT + 1, so 64 bits hold the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def spread_join(rows: DataFrame, figures: DataFrame, on: list[str], deal: str) -> DataFrame:
    """Inner join of rows with the one row of figures of their key; a key's rows are dealt to SALTS tasks by `deal`."""
    copies = figures.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(deal), F.lit(SALTS)).cast("int")).join(copies, [*on, "salt"]).drop("salt")


def wanted_bin(bins: DataFrame, falling: bool) -> DataFrame:
    """Of each group's counted bins, the one that holds the last wanted row, and how many of its rows are wanted.
    Groups with no more rows than wanted keep the last bin whole."""
    order = Window.partitionBy(*GROUP).orderBy(F.desc("bin") if falling else "bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = bins.withColumn("upto", F.sum("count").over(order)).withColumn("all", F.sum("count").over(Window.partitionBy(*GROUP)))
    goal = F.least("need", "all")
    return upto.where((F.col("upto") >= goal) & (F.col("upto") - F.col("count") < goal)).select(*GROUP, F.col("bin").alias("cut"), (goal - F.col("upto") + F.col("count")).alias("need"))


def leading_terms(scored: DataFrame, k: int) -> DataFrame:
    """lang, source, term, f, rank: the k rows of largest f of each group, ties by the terms' bytes."""
    left, need, floor = scored, scored.select(*GROUP).distinct().withColumn("need", F.lit(k).cast("long")), None
    for shift in range(VALUE_BITS - BITS, -1, -BITS):
        bin_of = F.shiftright("f", shift).bitwiseAND(F.lit((1 << BITS) - 1))
        bins = left.groupBy(*GROUP, bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("count")).join(need, GROUP)
        cut = settle(wanted_bin(bins, falling=True))
        left = spread_join(left, cut.select(*GROUP, "cut"), GROUP, "term").where(bin_of == F.col("cut")).drop("cut")
        part = cut.select(*GROUP, F.shiftleft(F.col("cut"), shift).alias("part"))
        floor = part if floor is None else floor.join(part.withColumnRenamed("part", "more"), GROUP).select(*GROUP, (F.col("part") + F.col("more")).alias("part"))
        need = cut.select(*GROUP, "need")
    floor = settle(floor.withColumnRenamed("part", "floor"))
    above = spread_join(scored, floor, GROUP, "term").where(F.col("f") > F.col("floor")).drop("floor")
    taken = [above]
    ties = settle(left)
    while True:
        of = ties.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("all"), F.min("term").alias("low"), F.max("term").alias("high")).join(need, GROUP)
        of = settle(of.select(*GROUP, "all", "need", common_bytes("low", "high").alias("same")))
        whole = of.where(F.col("all") <= F.col("need")).select(*GROUP)
        taken.append(spread_join(ties, whole, GROUP, "term"))
        open_ = of.where(F.col("all") > F.col("need")).select(*GROUP, "need", "same")
        if open_.isEmpty():
            break
        # the byte after what all tied terms share; the end of a term comes before any byte
        split = settle(spread_join(ties, open_.select(*GROUP, "same"), GROUP, "term").withColumn("byte", F.substring(F.encode("term", "utf-8"), F.col("same") + 1, F.lit(1))).drop("same"))
        bins = split.groupBy(*GROUP, F.col("byte").alias("bin")).agg(F.count(F.lit(1)).alias("count")).join(open_.select(*GROUP, "need"), GROUP)
        cut = settle(wanted_bin(bins, falling=False))
        met = settle(spread_join(split, cut.select(*GROUP, "cut"), GROUP, "term"))
        taken.append(met.where(F.col("byte") < F.col("cut")).drop("byte", "cut"))
        ties, need = met.where(F.col("byte") == F.col("cut")).drop("byte", "cut"), cut.select(*GROUP, "need")
    every = taken[0]
    for one in taken[1:]:
        every = every.unionByName(one)
    # at most k rows a group are left
    return every.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("f"), "term")))


def common_bytes(low: str, high: str) -> Column:
    """How many leading bytes two columns of terms share."""

    def count(low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([len(commonprefix([a.encode(), b.encode()])) for a, b in zip(low, high)], dtype="int32")

    return F.pandas_udf(count, "int")(low, high)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tile_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """The part of each pair's sum that one bucket of terms of two tiles adds. Rows without a term give the groups: p is
    what a missing term has there, and kept is V in one bucket and 0 in the others."""
    mine, terms = rows[rows["term"].isna()], rows[rows["term"].notna()]
    source = pd.Index(mine["source"])
    tile, base, kept = (mine[c].to_numpy() for c in ("tile", "p", "kept"))
    at, p = source.get_indexer(terms["source"]), terms["p"].to_numpy()
    n = len(source)
    alone, both = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
    none = _f(base[:, None], base[None, :])
    values = pd.DataFrame({"at": at, "p": p}).groupby(["at", "p"]).size()  # distinct p: few, as few counts are
    g, v = (values.index.get_level_values(i).to_numpy() for i in (0, 1))
    for low in range(0, len(g), 4096):
        part = slice(low, low + 4096)
        np.add.at(alone, g[part], (_f(v[part, None], base[None, :]) - none[g[part]]) * values.to_numpy()[part, None])
    order = np.argsort(pd.factorize(terms["term"])[0], kind="stable")
    code, at, p = pd.factorize(terms["term"])[0][order], at[order], p[order]
    step = 1
    while len(code) > step:  # the holders of a term stand together: meet those `step` apart
        left = np.flatnonzero(code[step:] == code[:-step])
        if not len(left):
            break
        a, b, x, y = at[left], at[left + step], p[left], p[left + step]
        np.add.at(both, (a, b), _f(x, y) - _f(x, base[b]) - _f(base[a], y) + none[a, b])
        step += 1
    total = alone + alone.T + both + both.T + none * kept[:, None]
    first, second = (rows["a"].iloc[0], rows["b"].iloc[0])
    i, j = np.nonzero(np.triu(np.ones((n, n), bool), 1) if first == second else (tile[:, None] == first) & (tile[None, :] == second))
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "one": source[i], "other": source[j], "value": total[i, j]})


def pair_sums(terms: DataFrame, groups: DataFrame, tile: int, bucket_terms: int) -> DataFrame:
    """lang, source, item, value: each pair of sources of a language, both ways. terms has p, groups has base and v."""
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    held = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("held"))
    plan = sizes.join(held, "lang", "left").select("lang", F.ceil(F.col("sources") / tile).cast("int").alias("tiles"), F.ceil(F.coalesce("held", F.lit(0)) / bucket_terms).cast("int").alias("fill"))
    plan = settle(plan.select("lang", "tiles", F.greatest(F.lit(16), "fill").alias("buckets")))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(F.least("tile", u).alias("a"), F.greatest("tile", u).alias("b"))))
    in_tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    rows = spread_join(terms, plan, ["lang"], "term").withColumn("tile", in_tile).withColumn("pair", pairs)
    rows = rows.select("lang", "pair.*", F.pmod(F.xxhash64("term", F.lit(3)), F.col("buckets")).cast("int").alias("bucket"), "tile", "source", "term", "p", F.lit(0).cast("long").alias("kept"))
    marks = spread_join(groups, plan, ["lang"], "source").withColumn("tile", in_tile).withColumn("pair", pairs).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    marks = marks.select("lang", "pair.*", "bucket", "tile", "source", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), F.when(F.col("bucket") == 0, F.col("v")).otherwise(0).cast("long").alias("kept"))
    sums = rows.unionByName(marks).groupBy("lang", "a", "b", "bucket").applyInPandas(tile_sums, "lang string, one string, other string, value long")
    sums = sums.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    return sums.withColumn("way", ways).select("lang", "way.*", "value")


def audit(
    docs: DataFrame, k: int = 10, min_docs: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", tile: int = 256, bucket_terms: int = 50_000
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = settle(term_counts(docs, lang_col, source_col, text_col))
    kept = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    held = settle(counts.join(kept, ["lang", "term"]).select(*GROUP, "term", "n", "lang_n"))
    # a term's total stands with each of its sources: one of them speaks for it
    vocabulary = settle(held.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")))
    groups = counts.where(F.col("term").isNull()).select(*GROUP).join(held.groupBy(*GROUP).agg(F.sum("n").alias("total")), GROUP, "left")
    groups = spread_join(groups.fillna(0, ["total"]), counts.select("lang").distinct().join(vocabulary, "lang", "left").fillna(0), ["lang"], "source")
    groups = settle(groups.withColumn("base", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.when(F.col("v") > 0, F.col("v")))).otherwise(1)))
    scored = spread_join(held, groups, GROUP, "term").withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("v")))
    scored = settle(scored.select(*GROUP, "term", "p", F.when(F.col("p") > F.col("q"), apart(F.col("p"), F.col("q"))).alias("f")))
    discard(counts)
    lead = leading_terms(scored.where(F.col("f").isNotNull()).select(*GROUP, "term", "f"), k)
    pairs = pair_sums(scored.select(*GROUP, "term", "p"), groups, tile, bucket_terms)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))
    lead = lead.select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), F.col("f").alias("value"), F.col("rank").cast("int").alias("rank"))
    return pairs.select(*GROUP, F.lit("pair").alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")).unionByName(lead)


def report(docs: DataFrame) -> DataFrame:
    return audit(docs.select("text", "lang", "source"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
kept AS (SELECT lang, term, count(*) AS n FROM d GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
voc AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
c AS (SELECT d.lang, d.source, d.term, count(*) AS n FROM d JOIN kept USING (lang, term) GROUP BY ALL),
gt AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT k.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gt.total, 0) + 2 * voc.v))::HUGEINT AS p,
      (1 + (1000000000::HUGEINT * (k.n + 2)) // (voc.total + 2 * voc.v))::HUGEINT AS q
      FROM kept k JOIN voc USING (lang) JOIN grp g USING (lang) LEFT JOIN c ON c.lang = k.lang AND c.source = g.source AND c.term = k.term LEFT JOIN gt ON gt.lang = k.lang AND gt.source = g.source),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pr.value, 0)::BIGINT AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
