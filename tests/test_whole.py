"""Registered queries against brute force on small tables of which every row counts."""

import math
import random

from skein.plans import catalog


def lineitem(spark, d, seed, orders=90, parts=12):
    r = random.Random(seed)
    rows = [(o, r.randrange(1, parts + 1), n) for o in range(1, orders + 1) for n in range(1, r.randint(1, 5) + 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    return rows


def test_related_items_reads_every_part(spark, tmp_path):
    rows = lineitem(spark, str(tmp_path), 1, orders=150)
    holders = {}
    for o, p, _ in rows:
        holders.setdefault((p, o % 50), set()).add(o)
    want = {}
    for items in holders.values():
        for o in items if len(items) <= 5 else ():
            want.setdefault(o, set()).update(items - {o})
    want = {(o, x, i + 1) for o, found in want.items() for i, x in enumerate(sorted(found)[:8])}
    got = [(x["item"], x["related"], x["rank"]) for x in catalog.queries()["related_items"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_dataflow_flow_follows_every_order(spark, tmp_path):
    rows = lineitem(spark, str(tmp_path), 2)
    want = {}
    for o in {x[0] for x in rows}:
        parts = [p for x, p, _ in rows if x == o]
        steps = {(a, b) for a, b in zip(parts, parts[1:]) if a != b}
        far, last = {parts[0]: 0}, {parts[0]}
        for hop in range(1, 5):
            last = {b for a, b in steps if a in last and b not in far}
            far |= {p: hop for p in last}
        if len(far) > 1:
            want[str(o)] = (len(far) - 1, max(far.values()))
    assert {x["key"]: (x["reached"], x["depth"]) for x in catalog.queries()["dataflow_flow"](spark, str(tmp_path)).collect()} == want


def test_communities_of_parts(spark, tmp_path):
    d, groups = str(tmp_path), [range(1, 31), range(31, 56)]
    spark.createDataFrame([(p, f"part {p}", "Brand#11", "T", p % 9) for p in range(1, 58)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{d}/part.parquet")
    pairs = [(a, b) for g in groups for a in g for b in g if a < b] + [(30, 31)]
    rows = [(o, p, 1, n, 1.0, 1.0, "x") for o, ab in enumerate(pairs) for n, p in enumerate(ab)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate string").write.parquet(f"{d}/lineitem.parquet")
    found = {}
    for x in catalog.queries()["communities"](spark, d).collect():
        found.setdefault(x["community"], set()).add(x["node"])
    name = lambda ps: {f"part {p} Brand#11" for p in ps}
    assert found == {0: name(groups[0]), 1: name(groups[1]), 2: name([56]), 3: name([57])}


def cosine(a, b):
    return round(sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))), 6)


def test_cosine_topk_asks_for_every_twentieth_row(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, [float(r.randint(-4, 4)) for _ in range(5)] + [1.0], 0) for i in range(100)]
    rows[41] = (41, rows[40][1], 0)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {(q, i, n + 1) for q, v, _ in rows[::20] for n, (_, i) in enumerate(sorted((-cosine(v, w), i) for i, w, _ in rows if i != q)[:5])}
    assert {(x["query"], x["id"], x["rank"]) for x in catalog.queries()["cosine_topk"](spark, str(tmp_path)).collect()} == want


def test_recurrence_best_searches_all_documents(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(12))) for i in range(61)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {i: [t.split().count(c) for c in "abcdefgh"] for i, t in rows}
    want = {q: min((-cosine(counts[q], counts[i]), i) for i in counts if i != q) for q in range(0, 61, 20)}
    got = catalog.queries()["recurrence_best"](spark, str(tmp_path)).collect()
    assert {x["query"]: (-x["score"], x["id"]) for x in got} == want


def test_search_in_rounds_makes_its_vectors_once(spark):
    """Vectors that must be made are made once, not once a round, and many rounds find what one finds."""
    from pyspark.sql import functions as F

    from skein.operators import similarity

    r = random.Random(6)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(4)] + [1.0]) for i in range(90)]
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    corpus = spark.createDataFrame(rows, "id long, vector array<double>").mapInArrow(make, "id long, vector array<double>")
    queries = spark.createDataFrame(rows[::9], "query long, vector array<double>")
    want = {(q, i, n + 1) for q, v in rows[::9] for n, (_, i) in enumerate(sorted((-cosine(v, w), i) for i, w in rows if i != q)[:3])}
    got = similarity.top_k(queries, corpus, 3, others=True, query_bytes=200).select("query", "id", F.col("rank")).collect()
    assert {tuple(x) for x in got} == want and made.value == len(rows)


def test_token_vectors_shuffle_no_tokens(spark):
    from skein.operators import similarity

    r = random.Random(7)
    words = ["Ab", "ab", "x-1", "Q_9", "zeta", "omega"]
    rows = [(i, ", ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for i in range(50)] + [(60, None), (61, "é !")]

    def bucket(token):
        h = 0xCBF29CE484222325
        for b in token.lower().encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h % 256

    for again in ([], [(3, "zeta zeta"), (3, None), (60, "ab")]):
        want = {}
        for i, text in rows + again:
            for w in (text or "").replace(",", "").split():
                if w[0].isascii() and w[0].isalnum():
                    v = want.setdefault(i, [0.0] * 256)
                    v[bucket(w)] += 1
        out = similarity.token_vectors(spark.createDataFrame(rows + again, "k long, t string"), "k", "t")
        assert {x["k"]: list(x["vector"]) for x in out.collect()} == want
        assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == bool(again)
