"""Smaller facts and functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import functions as fn
from skein import sources
from skein.operators import docs, extract, graph
from skein.plans import syntax
from skein.plans.graphs import weights_folded
from skein.plans.tables import CALLS_SQL, SYMBOLS_SQL, part_symbols, read

NAME = "small rod Brand#10"


def definitions(spark, d):
    return graph.definitions(part_symbols(spark, d), NAME).select("node", "name", "file", "kind")


def modularity_by_brand(spark, d):
    """How good a division of the folded part graph the brands are."""
    members = part_symbols(spark, d).select(F.col("name").alias("node"), F.col("file").alias("community")).distinct()
    return graph.modularity(members, weights_folded(spark, d)).select(F.round("modularity", 9).alias("modularity"))


def import_edges(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_size")
    key = F.col("p_partkey")
    rel = F.concat(F.lit("pkg"), (F.col("p_size") % 7).cast("string"), F.lit("/p"), key, F.when(key % 3 == 0, ".rs").otherwise(".py"))
    modules = p.select(rel.alias("rel"), fn.language(rel).alias("language"), key)
    refs = modules.withColumn("name", F.explode(F.array(F.concat(F.lit("p"), F.floor(key / 2)), F.concat(F.lit("p"), key), F.lit("os")))).select("rel", "language", "name")
    return docs.import_edges(refs, modules.select("rel", "language"))


def subclass_paths(spark, d):
    n, c = read(spark, d, "nation", "n_nationkey", "n_regionkey"), read(spark, d, "customer", "c_custkey", "c_nationkey")
    of = lambda frame, a, x, b, y: docs.statements(frame, F.concat(F.lit(a), x), "rdfs:subClassOf", F.concat(F.lit(b), y), "iri")
    return docs.subclasses(of(n, "n", "n_nationkey", "r", "n_regionkey").unionByName(of(c, "c", "c_custkey", "n", "c_nationkey")), "r1")


def first_lines(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", fn.first_line(F.col("text")).alias("line"))


def symbol_iris(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_brand", "p_size", "p_type", "p_name")
    file = F.concat(F.lit("src/m"), F.col("p_size").cast("string"), F.lit(".rs"))
    return p.select("p_partkey", fn.symbol_iri("urn:", F.col("p_brand"), file, F.array("p_type"), F.col("p_name")).alias("iri"))


def provenance_texts(spark, d):
    c = read(spark, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    key = F.col("c_custkey")
    turn, crew = F.when(key % 3 != 0, key), F.when(key % 5 != 0, F.concat(F.lit("n"), "c_nationkey"))
    return c.select("c_custkey", fn.provenance(F.col("c_mktsegment"), turn, crew).alias("provenance"))


def ages(spark, d):
    return read(spark, d, "events", "event_id").select("event_id", fn.age(F.lit(500), F.col("event_id") % 1000).alias("age"))


def changed_paths(spark, d):
    """Committed, uncommitted and untracked changes as one list."""
    p = read(spark, d, "part", "p_partkey", "p_size", "p_brand")
    rel = F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("rel")
    return sources.changed(p.where("p_size < 10").select(rel), p.where("p_size % 2 = 0").select(rel), p.where("p_brand = 'Brand#11'").select(rel))


def repo_identities(spark, d):
    url = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit(".git/"))).otherwise(F.concat(F.lit("git@host:team/tool"), F.col("page_id").cast("string"), F.lit(".git")))
    return read(spark, d, "pages", "page_id", "url").select("page_id", fn.repo_identity(url).alias("name"))


def tree_diff(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_size")
    rel, size = F.col("p_partkey").cast("string").alias("rel"), F.col("p_size")
    files = p.where(size < 40).select(F.lit("a").alias("commit"), rel, size.alias("hash")).unionByName(p.where(size > 10).select(F.lit("b").alias("commit"), rel, (size + F.col("p_partkey") % 2).alias("hash")))
    said, rows = sources.checked_diff(files, "a", "b")
    return rows if said == "evaluated" else sources.diff(files, "a", "b")


def sources_summary(spark, d):
    return extract.summary(syntax.sources(spark, d))


QUERIES = {f.__name__: f for f in (definitions, modularity_by_brand, import_edges, subclass_paths, first_lines, symbol_iris, provenance_texts, ages, changed_paths, repo_identities, tree_diff, sources_summary)}

_IRI = "replace(replace(replace({}, '%', '%25'), '#', '%23'), ' ', '%20')"
ORACLES = {
    "definitions": f"WITH {SYMBOLS_SQL} SELECT node, name, file, kind FROM sy WHERE name = '{NAME}'",
    "modularity_by_brand": f"""WITH {CALLS_SQL}, fo AS (SELECT least(caller, callee) AS a, greatest(caller, callee) AS b, count(*) AS w FROM ca WHERE caller <> callee GROUP BY 1, 2), br AS (SELECT DISTINCT name, file FROM sy),
        e AS (SELECT a AS n, w FROM fo UNION ALL SELECT b, w FROM fo), dg AS (SELECT file, sum(w) AS d FROM e JOIN br ON br.name = e.n GROUP BY 1),
        ins AS (SELECT x.file, sum(w) AS w FROM fo JOIN br x ON x.name = fo.a JOIN br y ON y.name = fo.b WHERE x.file = y.file GROUP BY 1), m AS (SELECT sum(w) AS m FROM fo)
        SELECT round(sum(coalesce(ins.w, 0) / m - pow(d / (2 * m), 2)), 9) AS modularity FROM dg LEFT JOIN ins USING (file), m""",
    "import_edges": """WITH m AS (SELECT p_partkey AS k, 'pkg' || p_size % 7 || '/p' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.rs' ELSE '.py' END AS rel FROM part)
        SELECT a.rel, b.rel AS target FROM m a JOIN m b ON b.k = a.k // 2 WHERE (a.k % 3 = 0) = (b.k % 3 = 0) AND a.k <> b.k""",
    "subclass_paths": "SELECT 'r1' AS node, 0 AS distance UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1",
    "first_lines": "WITH l AS (SELECT doc_id, string_split(text, chr(10))[1] AS l FROM documents) SELECT doc_id, CASE WHEN length(l) > 80 THEN l[1:79] || '…' ELSE l END AS line FROM l",
    "symbol_iris": f"SELECT p_partkey, 'urn:' || {_IRI.format('p_brand')} || '/src%2Fm' || p_size || '.rs#' || {_IRI.format('p_type')} || '::' || {_IRI.format('p_name')} AS iri FROM part",
    "provenance_texts": "SELECT c_custkey, c_mktsegment || CASE WHEN c_custkey % 3 <> 0 THEN '@turn' || c_custkey ELSE '' END || CASE WHEN c_custkey % 5 <> 0 THEN '/n' || c_nationkey ELSE '' END AS provenance FROM customer",
    "ages": "SELECT event_id, greatest(500 - event_id % 1000, 0) AS age FROM events",
    "changed_paths": "SELECT 'f' || p_partkey AS rel FROM part WHERE p_size < 10 OR p_size % 2 = 0 OR p_brand = 'Brand#11'",
    "repo_identities": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '([^/:]+)$', 1) ELSE 'tool' || page_id END AS name FROM pages",
    "tree_diff": """SELECT p_partkey::VARCHAR AS rel, CASE WHEN p_size <= 10 THEN 'removed' WHEN p_size >= 40 THEN 'added' ELSE 'modified' END AS change FROM part WHERE p_size <= 10 OR p_size >= 40 OR p_partkey % 2 = 1""",
    "sources_summary": "SELECT count(*) AS files, 0::BIGINT AS unparsed, 3 * count(*) AS symbols FROM part",
}
