"""Overlay queries: parts are files of a base, tenants touch some of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import graph, overlay
from skein.plans.tables import EDGES_SQL, part_edges, read


def _base(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_name", "p_size")
    return p.select(F.col("p_partkey").alias("rel"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.md5(F.col("p_name")).alias("hash"))


def _writes(spark, d):
    """Each event of a user writes one file of tenant user % 4; every third write restores the base."""
    ev = read(spark, d, "events", "event_id", "user_id").withColumn("rel", F.col("event_id") % 97 + 1)
    base = _base(spark, d).select("rel", F.col("hash").alias("old"))
    text = F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string"))
    return ev.join(base, "rel").select((F.col("user_id") % 4).alias("tenant"), "rel", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.col("old")).otherwise(F.md5(text)).alias("hash"), (F.col("event_id") % 11).cast("int").alias("size"))


def _touched(spark, d):
    return overlay.touches(_base(spark, d), _writes(spark, d))


_TOUCH = """
base AS (SELECT p_partkey AS rel, p_name AS name, p_size AS size, md5(p_name) AS hash FROM part),
wr AS (SELECT user_id % 4 AS tenant, event_id % 97 + 1 AS rel, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN base.hash ELSE md5('v' || (event_id % 5)) END AS hash, (event_id % 11)::INTEGER AS size
       FROM events JOIN base ON base.rel = event_id % 97 + 1),
lt AS (SELECT * FROM wr QUALIFY row_number() OVER (PARTITION BY tenant, rel ORDER BY seq DESC) = 1),
tc AS (SELECT lt.* FROM lt WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rel = lt.rel AND base.hash = lt.hash))"""


def overlay_touches(spark, d):
    return _touched(spark, d).select("tenant", "rel", "seq", "hash")


def overlay_view(spark, d):
    """All tenants' views; a touched file of size 0 is deleted."""
    t = _touched(spark, d)
    own = t.where("size > 0").select("tenant", "rel", F.lit("edited").alias("name"), "size", "hash")
    return overlay.view(_base(spark, d), t, own)


def tenant_view(spark, d):
    t = _touched(spark, d)
    own = t.where("size > 0").select("tenant", "rel", F.lit("edited").alias("name"), "size", "hash")
    return overlay.tenant_view(_base(spark, d), t, own, 2)


def overlay_reach(spark, d):
    """Reachability in tenant 1's view: edges at files that it touched are gone."""
    hidden = _touched(spark, d).where("tenant = 1").select("rel").distinct()
    e = part_edges(spark, d).join(hidden.withColumnRenamed("rel", "src"), "src", "left_anti").join(hidden.withColumnRenamed("rel", "dst"), "dst", "left_anti")
    return graph.reach(e, spark.createDataFrame([(100,)], "node long"), "callees", 2)


def sharing_stats(spark, d):
    return overlay.sharing_stats(_touched(spark, d))


def registry_status(spark, d):
    return overlay.registry_status(_touched(spark, d))


def session_eviction(spark, d):
    ev = read(spark, d, "events", "event_id", "user_id")
    s = ev.groupBy(F.col("user_id").alias("tenant")).agg(F.min("event_id").alias("created"), F.max("event_id").alias("last_used"))
    return overlay.evict(s, 8, "lru").select("tenant", "kept")


def intern_sweep(spark, d):
    w = _writes(spark, d).select("hash").distinct()
    return overlay.sweep(w, _touched(spark, d))


def composed_edges(spark, d):
    """Tenant 3's composed graph: brands are files, touched brands get one new part each that calls a base name."""
    p = read(spark, d, "part", "p_partkey", "p_name", "p_brand")
    sy = p.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.lit("x").alias("language"), F.col("p_brand").alias("file"))
    e = part_edges(spark, d)
    names = sy.select(F.col("node").alias("dst"), F.col("name").alias("callee"))
    callers = e.join(names, "dst").select(F.lit("x").alias("language"), "callee", F.col("src").alias("caller_node")).distinct()
    touched = spark.createDataFrame([("Brand#11",), ("Brand#23",)], "file string")
    own = p.join(touched, F.col("p_brand") == F.col("file")).groupBy("file").agg(F.min("p_name").alias("name"), (F.min("p_partkey") + 10_000_000).alias("node")).select("node", "name", F.lit("x").alias("language"), "file")
    other = p.where("p_brand NOT IN ('Brand#11', 'Brand#23')").agg(F.min("p_name").alias("callee"))
    calls = own.select("file", F.col("name").alias("caller"), "language").join(other, F.lit(True)).select("file", "language", "caller", "callee")
    return overlay.view_edges(e, sy, callers, own, calls, touched)


QUERIES = {f.__name__: f for f in (overlay_touches, overlay_view, tenant_view, overlay_reach, sharing_stats, registry_status, session_eviction, intern_sweep, composed_edges)}

ORACLES = {
    "overlay_touches": f"WITH {_TOUCH} SELECT tenant, rel, seq, hash FROM tc",
    "overlay_view": f"""WITH {_TOUCH}, tn AS (SELECT DISTINCT tenant FROM tc)
        SELECT tenant, rel, name, size, hash FROM base, tn WHERE NOT EXISTS (SELECT 1 FROM tc WHERE tc.tenant = tn.tenant AND tc.rel = base.rel)
        UNION ALL SELECT tenant, rel, 'edited', size, hash FROM tc WHERE size > 0""",
    "tenant_view": f"""WITH {_TOUCH} SELECT rel, name, size, hash FROM base WHERE NOT EXISTS (SELECT 1 FROM tc WHERE tc.tenant = 2 AND tc.rel = base.rel)
        UNION ALL SELECT rel, 'edited', size, hash FROM tc WHERE size > 0 AND tenant = 2""",
    "overlay_reach": f"""WITH RECURSIVE {EDGES_SQL},{_TOUCH}, h AS (SELECT rel FROM tc WHERE tenant = 1), ve AS (SELECT * FROM pe WHERE src NOT IN (SELECT rel FROM h) AND dst NOT IN (SELECT rel FROM h)),
        w(node, d) AS (SELECT 100, 0 UNION SELECT dst, d + 1 FROM w JOIN ve ON src = w.node WHERE d < 2) SELECT node, min(d) AS distance FROM w GROUP BY node HAVING min(d) > 0""",
    "sharing_stats": f"WITH {_TOUCH} SELECT count(*) AS touches, count(DISTINCT hash) AS live, count(*) - count(DISTINCT hash) AS saved, CASE WHEN count(*) > 0 THEN round((count(*) - count(DISTINCT hash)) / count(*), 6) ELSE 0.0 END AS ratio FROM tc",
    "registry_status": f"WITH {_TOUCH} SELECT tenant, count(DISTINCT rel) AS files, count(DISTINCT hash) AS contents FROM tc GROUP BY tenant",
    "session_eviction": "SELECT tenant, row_number() OVER (ORDER BY last_used DESC, tenant) <= 8 AS kept FROM (SELECT user_id AS tenant, max(event_id) AS last_used FROM events GROUP BY 1)",
    "intern_sweep": f"WITH {_TOUCH} SELECT DISTINCT hash FROM wr WHERE hash IN (SELECT hash FROM tc)",
    "composed_edges": f"""WITH {EDGES_SQL}, h AS (SELECT unnest(['Brand#11', 'Brand#23']) AS file), sy AS (SELECT p_partkey AS node, p_name AS name, p_brand AS file FROM part),
        kept AS (SELECT * FROM sy WHERE file NOT IN (SELECT file FROM h)),
        own AS (SELECT min(p_partkey) + 10000000 AS node, min(p_name) AS name, p_brand AS file FROM part WHERE p_brand IN (SELECT file FROM h) GROUP BY p_brand),
        whole AS (SELECT node, name FROM kept UNION ALL SELECT node, name FROM own), other AS (SELECT min(name) AS callee FROM kept)
        SELECT DISTINCT src, dst FROM (
          SELECT src, dst FROM pe WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept)
          UNION ALL SELECT pe.src, own.node FROM pe JOIN sy b ON b.node = pe.dst JOIN own ON own.name = b.name WHERE pe.src IN (SELECT node FROM kept)
          UNION ALL SELECT own.node, whole.node FROM own, other JOIN whole ON whole.name = other.callee) WHERE src <> dst""",
}
