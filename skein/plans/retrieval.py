"""Similarity, votes and retrieval scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import briefing, similarity
from skein.plans.tables import EDGES_SQL, SYMBOLS_SQL, part_edges, part_symbols, read


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def cosine_topk(spark, d):
    v = _vectors(spark, d)
    return similarity.top_k(v.where("id % 20 = 0").select(F.col("id").alias("query"), "vector"), v, 5, others=True)


def cosine_threshold(spark, d):
    v = _vectors(spark, d)
    return similarity.top_k(v.where("id = 7").select(F.col("id").alias("query"), "vector"), v, 20, 0.25).select("id", "score")


def token_hash_embedding(spark, d):
    """What each document's vector holds: buckets in use, tokens, and their weighted sum."""
    v = similarity.token_counts(read(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").cast("long").alias("tokens"), F.sum(F.col("bucket") * F.col("n")).cast("long").alias("weighted"))


def recurrence_best(spark, d):
    docs = read(spark, d, "documents", "doc_id", "text")
    new = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text")
    return similarity.recurrence(new, docs.select(F.col("doc_id").alias("id"), "text"), 0.3, others=True)


def related_items(spark, d):
    li = read(spark, d, "lineitem", "l_orderkey", "l_partkey")
    touches = li.select(F.col("l_orderkey").alias("item"), F.concat_ws("/", F.col("l_partkey").cast("string"), (F.col("l_orderkey") % 50).cast("string")).alias("entity"))
    return similarity.related(touches)


def _hits(spark, d):
    ev = read(spark, d, "events", "event_id", "user_id", "event_type", "value")
    source = F.when(F.col("event_type") == "click", "phrase").when(F.col("event_type") == "view", "term").when(F.col("event_type") == "purchase", "provenance").otherwise("semantic")
    return ev.select((F.col("user_id") % 10).alias("query"), (F.col("event_id") % 37).alias("item"), source.alias("source"), F.round(F.col("value") / 100, 4).alias("score"))


def vote_rank(spark, d):
    return similarity.similar_items(_hits(spark, d))


def semantic_band(spark, d):
    return similarity.band(_hits(spark, d).where("source = 'semantic'"))


def probe_terms(spark, d):
    b = read(spark, d, "benchmark")
    return b.select("item_id", F.array_join(similarity.probe_terms(F.col("text")), "|").alias("terms"))


def _touches(spark, d):
    p = read(spark, d, "part", "p_brand", "p_size")
    return p.select((F.col("p_size") % 5).alias("item"), F.col("p_brand").alias("path")).distinct()


def ground_neighbourhood(spark, d):
    return briefing.neighbourhood(_touches(spark, d), part_symbols(spark, d), part_edges(spark, d))


def briefs(spark, d):
    return briefing.brief(briefing.neighbourhood(_touches(spark, d), part_symbols(spark, d), part_edges(spark, d), off=("caller_file",)))


def f1_by_probe(spark, d):
    lab = read(spark, d, "labels")
    docs = read(spark, d, "documents", "doc_id", "lang")
    probe = lab.join(docs, "doc_id")
    got = probe.where("quality = 1").select(F.col("lang").alias("probe"), F.col("doc_id").alias("item"))
    want = probe.where("toxic = 0").select(F.col("lang").alias("probe"), F.col("doc_id").alias("item"))
    return similarity.scores(got, want)


def f1_macro(spark, d):
    return similarity.macro_f1(f1_by_probe(spark, d))


QUERIES = {f.__name__: f for f in (cosine_topk, cosine_threshold, token_hash_embedding, recurrence_best, related_items, vote_rank, semantic_band, probe_terms, ground_neighbourhood, briefs, f1_by_probe, f1_macro)}

_BUCKET = "(CASE WHEN len(t) > 0 THEN list_reduce([37] || list_transform(range(1, length(hex(encode(lower(t)))), 2), lambda i: ('0x' || substr(hex(encode(lower(t))), i, 2))::INTEGER), lambda h, b: (xor(h, b) * 179) % 256) ELSE 37 END)"
_HITS = "hi AS (SELECT user_id % 10 AS query, event_id % 37 AS item, CASE event_type WHEN 'click' THEN 'phrase' WHEN 'view' THEN 'term' WHEN 'purchase' THEN 'provenance' ELSE 'semantic' END AS source, round(value / 100, 4) AS score FROM events)"
_BAND = _HITS + ", ba AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query) AS m FROM hi WHERE source = 'semantic') WHERE m >= 0.4 AND score >= 0.8 * m)"
_COS = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6)"
_RAW = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 12)"
_F1 = """SELECT l.lang AS probe, sum((quality = 1 AND toxic = 0)::INTEGER) AS hit, sum((quality = 1)::INTEGER) AS got, sum((toxic = 0)::INTEGER) AS want FROM (SELECT DISTINCT doc_id, quality, toxic FROM labels) JOIN documents l USING (doc_id) WHERE quality = 1 OR toxic = 0 GROUP BY 1"""
_F1 = f"SELECT probe, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT probe, CASE WHEN got > 0 THEN hit / got ELSE 0 END AS p, CASE WHEN want > 0 THEN hit / want ELSE 0 END AS r FROM ({_F1}))"
_NEAR = f"""WITH {EDGES_SQL},{SYMBOLS_SQL}, tc AS (SELECT DISTINCT p_size % 5 AS item, p_brand AS file FROM part),
al AS (SELECT item, 'path' AS section, file AS value, 12 AS cap FROM tc UNION SELECT item, 'symbol', name, 10 FROM tc JOIN sy USING (file)
  UNION SELECT tc.item, 'caller_file', a.file, 6 FROM tc JOIN sy b ON b.file = tc.file JOIN pe ON pe.dst = b.node JOIN sy a ON a.node = pe.src WHERE NOT EXISTS (SELECT 1 FROM tc x WHERE x.item = tc.item AND x.file = a.file)),
nb AS (SELECT item, section, value, row_number() OVER (PARTITION BY item, section ORDER BY value)::INTEGER AS rank, greatest(count(*) OVER (PARTITION BY item, section) - cap, 0) AS withheld, cap FROM al QUALIFY rank <= cap)"""
ORACLES = {
    "ground_neighbourhood": f"{_NEAR} SELECT item, section, value, rank, withheld FROM nb",
    "briefs": f"{_NEAR}, l AS (SELECT item, section || ': ' || string_agg(value, ', ' ORDER BY rank) || CASE WHEN max(withheld) > 0 THEN ' (+' || max(withheld) || ')' ELSE '' END AS t FROM nb WHERE section <> 'caller_file' GROUP BY item, section) SELECT item, string_agg(t, chr(10) ORDER BY t) AS text FROM l GROUP BY item",
    "cosine_topk": f"SELECT a.vec_id AS query, b.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_RAW} DESC, b.vec_id)::INTEGER AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 5",
    "cosine_threshold": f"SELECT b.vec_id AS id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND {_COS} >= 0.25 ORDER BY score DESC, id LIMIT 20",
    "token_hash_embedding": f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_-]+')) AS t FROM documents), w AS (SELECT t, {_BUCKET} AS b FROM (SELECT DISTINCT t FROM t))
        SELECT doc_id, count(DISTINCT b) AS buckets, count(*) AS tokens, sum(b)::BIGINT AS weighted FROM t JOIN w USING (t) GROUP BY doc_id""",
    "recurrence_best": f"""WITH t AS (SELECT doc_id AS item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_-]+')) AS t FROM documents), v AS (SELECT item_id, {_BUCKET} AS b, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2), l AS (SELECT item_id, sqrt(sum(n * n)) AS l FROM v GROUP BY 1),
        s AS (SELECT a.item_id AS query, b.item_id AS id, sum(a.n * b.n) / (any_value(la.l) * any_value(lb.l)) AS raw FROM v a JOIN v b ON a.b = b.b JOIN l la ON la.item_id = a.item_id JOIN l lb ON lb.item_id = b.item_id WHERE a.item_id % 20 = 0 AND b.item_id <> a.item_id GROUP BY 1, 2)
        SELECT query, id, round(raw, 6) AS score FROM s WHERE raw >= 0.3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(raw, 12) DESC, id) = 1""",
    "related_items": """WITH t AS (SELECT DISTINCT l_orderkey AS item, l_partkey || '/' || (l_orderkey % 50) AS entity FROM lineitem), k AS (SELECT entity FROM t GROUP BY 1 HAVING count(*) <= 5),
        p AS (SELECT DISTINCT a.item, b.item AS related FROM t a JOIN t b USING (entity) JOIN k USING (entity) WHERE a.item <> b.item)
        SELECT item, related, row_number() OVER (PARTITION BY item ORDER BY related)::INTEGER AS rank FROM p QUALIFY rank <= 8""",
    "vote_rank": f"""WITH {_BAND}, al AS (SELECT query, item, source, score FROM ba UNION ALL SELECT * FROM hi WHERE source <> 'semantic'), o AS (SELECT query, item, source, max(score) AS score FROM al GROUP BY 1, 2, 3),
        v AS (SELECT query, item, sum(CASE source WHEN 'term' THEN 1 ELSE 2 END)::BIGINT AS vote, max(score) AS score FROM o GROUP BY 1, 2), p AS (SELECT * FROM (SELECT *, max(vote) OVER (PARTITION BY query) AS m FROM v) WHERE m < 2 OR vote >= 2)
        SELECT query, item, vote, score, row_number() OVER (PARTITION BY query ORDER BY vote DESC, score DESC, item)::INTEGER AS rank FROM p QUALIFY rank <= 5""",
    "semantic_band": f"WITH {_BAND} SELECT query, item, source, score FROM ba",
    "probe_terms": """WITH t AS (SELECT item_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9_-]+') AS w FROM benchmark)), o AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY length(t) DESC, i) AS r FROM t WHERE length(t) >= 5),
        u AS (SELECT *, lag(t) OVER (PARTITION BY item_id ORDER BY r) AS p FROM o), k AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY r) AS n FROM u WHERE p IS NULL OR p <> t)
        SELECT b.item_id, coalesce(string_agg(t, '|' ORDER BY n) FILTER (WHERE n <= 3), '') AS terms FROM benchmark b LEFT JOIN k USING (item_id) GROUP BY 1""",
    "f1_by_probe": _F1,
    "f1_macro": f"SELECT round(avg(f1), 3) AS macro_f1, count(*) AS probes FROM ({_F1})",
}
