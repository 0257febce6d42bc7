"""Search, chat, toxicity, mixing, components and the pipeline."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash

from skein.llm import chat, components, mixing, topk, toxicity
from tests.llm import brute


def plain_top(rows, k=5, every=50):
    sound = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for p, (i, q) in enumerate(sound):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for o, (j, v) in enumerate(sound) if o != p)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [{}, {"query_bytes": 500, "shard_rows": 40}])
def test_top_k(spark, blocks):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 20)]) for i in range(200)]
    rows[3] = (3, None)
    rows[4] = (4, [float("nan")] + [0.0] * 19)
    rows[5] = (5, [None] + [0.0] * 19)
    rows[6] = (6, [float("inf")] * 20)
    rows[8] = (8, rows[7][1])
    rows[9] = (9, [0.5] * 4)
    rows += [(None, [1.0] * 20), (50, rows[50][1]), (50, rows[60][1]), (3, rows[50][1]), (7, []), (11, rows[12][1] + [2.0])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=10, **blocks)
    import struct

    single = [(i, v if v is None else [x if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v in rows]
    assert sorted(tuple(x) for x in out.collect()) == plain_top(single, every=10)


def test_top_k_few_rows_and_large_values(spark):
    rows = [(0, [1e6, 2e6]), (50, [3e6, -1e6]), (7, [1e6, 1e6])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(x) for x in out.collect()) == plain_top(rows)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


TALK = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi <|im_end|>\n\\ there"), (1, 2, "assistant", "<|im_start|>assistant\\n"), (1, 3, "user", None), (1, 4, "assistant", "é✓"),
    (2, 0, "user", "only a question"), (3, 0, "assistant", ""), (4, 1, None, "odd"), (4, 0, "us\ner<|", "x"), (5, 2, "user", "b"), (5, 1, "assistant", "a"), (5, None, "assistant", "first"), (None, 0, "assistant", "no id"),
]


def test_chat(spark):
    rows = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.report(rows).collect()}
    groups = {}
    hard = "<|im_end|><|im_start|>assistant ok"
    for c, t, role, text in [*TALK, (-1, 0, "user", hard), (-1, 1, "assistant", hard)]:
        groups.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(out) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (out[c]["n_turns"], out[c]["turns_sha256"], out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    ex = chat.expand(rows).where("conv_id = 1").orderBy("example").collect()
    assert len(ex) == 2 and sum(len(e["formatted"]) for e in ex) == out[1]["formatted_chars"]
    assert [chat.unescape_text(e["formatted"][e["loss_start"] : e["loss_end"]]) for e in ex] == ["<|im_start|>assistant\\n", "é✓"]
    assert list(chat.read(ex[1]["formatted"]))[:3] == [("system", "be brief"), ("user", "hi <|im_end|>\n\\ there"), ("assistant", "<|im_start|>assistant\\n")]


def test_chat_round_trip_of_any_text():
    r = random.Random(1)
    for _ in range(500):
        turns = [(r.choice(["user", "assistant", "a<|\n"]), "".join(r.choice("<|\\n\nim_end>ä") for _ in range(r.randint(0, 20)))) for _ in range(r.randint(1, 5))]
        *_, (text, _, _) = chat.examples(turns)
        assert list(chat.read(text)) == turns


def test_chat_empty(spark):
    assert [r["conv_id"] for r in chat.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()] == [-1]


def talk(r, toxic):
    w = ["".join(r.choice(["ta", "ro", "mi", "ne", "lu", "so"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 120))]
    for _ in range(2 if toxic else 0):
        w[r.randrange(len(w))] = r.choice(["grumblor", "grumbla", "vexkin", "vexkord"]) + r.choice(["", "mi", "so"])
    return " ".join(w)


def test_toxicity(spark):
    r = random.Random(2)
    rows = [(i, talk(r, i % 4 == 0), int(i % 4 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (2000, None), (2001, ""), (2002, "so GRUMBLORS mi ta ro")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x for x in toxicity.report(docs, labels).collect()}
    assert len(out) == 904
    held = [(x, out[i]["predicted"]) for i, _, x in rows if out[i]["held_out"]]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) > 0.95
    assert out[2002]["predicted"] == 1 and out[2000]["predicted"] == out[2001]["predicted"] == 0
    assert all(0 <= x["score"] <= 1 for x in out.values())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.report(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity.report(docs, one).collect())


def test_exponents():
    t = [1000.0, 100.0, 10.0]
    e = mixing.exponent_for(t, 1110, 0.8, None)
    assert abs(mixing.entropy(mixing.weights(t, e)) - 0.8 * np.log(3)) < 1e-6
    e = mixing.exponent_for(t, 1110, None, 3.0)
    assert abs(1110 * mixing.weights(t, e)[2] / 10 - 3) < 1e-6
    assert mixing.exponent_for([5.0], 5, 0.9, 2) == 1.0 and mixing.exponent_for([5.0, 5.0], 10, 0.99, 2) == 1.0


def test_mixing(spark):
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randint(1, 40)), ["big", "big", "big", "mid", None][i % 5] if i % 50 else "tiny") for i in range(2000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), blocks=64)
    got = out.collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    budget = sum(size.values())
    for s in size:
        mine = [x for x in got if x["source"] == s]
        w = mine[0]["weight"]
        assert abs(sum(x["n_tokens"] for x in mine) - budget * w) <= max(size[s] / 64 * 3, 40)
        assert max(x["epoch"] for x in mine) <= 4
        for e in range(int(budget * w // size[s])):
            assert sorted(x["doc_id"] for x in mine if x["epoch"] == e) == sorted(i for i, _, o in rows if o == s)
    assert mixing.report(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_mixing_odd_rows(spark):
    rows = [(None, "a b", "s", 1), (1, None, "s", 2), (1, "a b", None, 3), (1, "a b", None, 3), (2, "", "none", 4)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, block int"))
    assert out.where("source IS NULL").count() >= 2 and out.columns.count("block") == 1 and out.where("source = 'none'").count() == 0


def test_mixing_of_many_sources(spark):
    totals = [max(1, 600 // (i + 1)) for i in range(120)]
    each = {t: totals.count(t) for t in totals}
    for target, most in ((0.97, 4.0), (0.8, None), (None, 3.0)):
        flat = mixing.exponent_for(totals, 4 * sum(totals), target, most)
        assert abs(mixing.exponent_for(list(each), 4 * sum(totals), target, most, list(each.values())) - flat) < 1e-9
    docs = spark.createDataFrame([(i, " ".join(["w"] * t), f"s{i}") for i, t in enumerate(totals)], "doc_id long, text string, source string")
    want = mixing.weights(totals, mixing.exponent_for(totals, sum(totals), 0.97, 4.0))
    got = {x["source"]: x["weight"] for x in mixing.mix(docs).collect()}  # sources of one document each: those of under half a pass go
    assert len(got) > 100 and all(abs(w - want[int(s[1:])]) < 1e-8 for s, w in got.items())


def spark_hash(*values):
    """xxhash64 of strings, ints and longs as Spark chains it."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[1].to_bytes(v[0], "little", signed=True)
        h = xxhash.xxh64(raw, seed=h).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


@pytest.mark.parametrize("rule", [(None, 0.97, 4.0), (3000, 0.8, None), (20_000, None, 3.0)])
def test_mixing_against_plain_python(spark, rule):
    budget, target, most = rule
    r, blocks, seed = random.Random(9), 16, 17
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), ["a", "a", "a", "b", "c"][r.randrange(5)] if i % 40 else "tiny") for i in range(400)]
    tokens = {s: sum(len(t.split()) for _, t, o in rows if o == s) for s in "a b c tiny".split()}
    total = sum(tokens.values())
    budget = budget or total

    def shares(e):
        raised = {s: (t / total) ** e for s, t in tokens.items()}
        return {s: x / sum(raised.values()) for s, x in raised.items()}

    grid = [i / 20000 for i in range(20001)]
    flat = lambda e: target is None or -sum(x * math.log(x) for x in shares(e).values()) >= target * math.log(4)
    few = lambda e: most is None or all(budget * x <= max(most, budget / total) * tokens[s] * (1 + 1e-9) for s, x in shares(e).items())
    found = max([e for e in grid if flat(e)] or [0.0]) if target is not None else (0.0 if most is not None else 1.0)
    found = max(found, min(e for e in grid if few(e)))
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), budget_tokens=budget, target_entropy=target, max_repeats=most, blocks=blocks).collect()
    weight = {x["source"]: x["weight"] for x in out}
    assert all(abs(weight[s] - x) < 2e-4 for s, x in shares(found).items())
    inverse = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    want = []
    for s, t in tokens.items():
        in_block = {}
        for i, text, o in rows:
            if o == s:
                in_block.setdefault(inverse(spark_hash(str(i), (8, spark_hash(text)), (4, seed))) % blocks, []).append((i, len(text.split())))
        w = weight[s] * budget
        full = int(w // t)
        for epoch in range(full + 1):
            order = sorted(in_block, key=lambda b: (spark_hash(s, (4, epoch), (4, b), (4, seed)), b))
            before = 0
            for rank, b in enumerate(order):
                size = sum(n for _, n in in_block[b])
                if epoch < full or before + size / 2 <= w - full * t:
                    want += [(i, n, epoch, b, rank + 1) for i, n in in_block[b]]
                before += size
    assert sorted(want) == sorted((x["doc_id"], x["n_tokens"], x["epoch"], x["block"], x["block_rank"]) for x in out)


def test_mixing_refuses_endless_repeats(spark):
    docs = spark.createDataFrame([(1, "one", "tiny"), (2, "w " * 90_000, "big")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="max_repeats"):
        mixing.mix(docs, target_entropy=1.0, max_repeats=None)
    assert mixing.mix(docs).where("source = 'tiny'").count() <= 4


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1064)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    out = {x["node"]: x["label"] for x in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def staged(spark, d, docs):
    """Rows after each stage of the pipeline."""
    import corpus_pipeline as P

    now, seen = docs, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, d)
        out.write.parquet(f"{d}/stage{k}")
        now = spark.read.parquet(f"{d}/stage{k}")
        seen[name] = now.collect()
        if k < len(P.STAGES) - 1:
            assert now.columns == list(P.COLUMNS)
    return seen


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, talk(r, toxic) + f" unique{i} words{i} here{i}", "en", f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    item = " ".join(f"q{j}" for j in range(20))
    page = "\n".join(" ".join(r.choice("ta ro mi ne lu so".split()) + str(r.randrange(99)) for _ in range(9)) for _ in range(12))
    rows += [(500, rows[1][1] + " tail", "en", "s0"), (501, item + " some more", "en", "s1"), (502, None, "en", "s1"), (503, "", None, None), (504, "A line that is shared\nown text five with some more words in it", "en", "s2"), (505, "other text of which there is rather more\na LINE that is shared ", "en", "s2")]
    rows += [(600 + i, page + f"\nlast line number {i}", "en", "s0") for i in range(30)] + [(None, page, "en", "s0"), (None, page, "en", "s1"), (700, "alone and twice, word for word", "en", "s0"), (700, "alone and twice, word for word", "en", "s0")]
    d = str(tmp_path)
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], DOCS)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    seen = staged(spark, d, spark.read.parquet(f"{d}/documents.parquet"))
    of = lambda n: [(x["doc_id"], x["text"], x["lang"], x["source"], x["n_chars"]) for x in seen[n]]
    ids = lambda n: {x["doc_id"] for x in seen[n]}
    key = lambda x: str(x)
    gone = set(range(400)) - ids("toxicity")
    assert len(gone & set(range(0, 400, 5))) >= 76 and len(gone - set(range(0, 400, 5))) <= 4 and ids("toxicity") >= {x[0] for x in rows[400:]}
    # line dedup: every row of the stage before, cut where at least half stays
    kept = brute.kept_lines([x[:2] for x in of("toxicity")])
    want = [x if k is None or 2 * len(k) <= len(x[1]) else (x[0], k, *x[2:4], len(k)) for x, k in zip(of("toxicity"), kept)]
    assert sorted(of("line_dedup"), key=key) == sorted(want, key=key)
    text = {x["doc_id"]: x for x in seen["line_dedup"]}
    assert text[505]["text"] == "other text of which there is rather more" and text[601]["n_chars"] == len(page) + len("\nlast line number 1")
    # near duplicates: one row of each component of brute force over rows, that of the smallest id
    before = of("line_dedup")
    whole = brute.jaccard([(i, x[1]) for i, x in enumerate(before)], 5, 80)
    groups = {}
    for i, x in enumerate(before):
        groups.setdefault(whole[i][1], []).append(((x[0] is None, x[0] or 0), x))
    want = [min(g, key=lambda y: y[0])[1] for g in groups.values()]
    assert sorted(x[0] is None and (9**9,) or (x[0],) for x in of("near_duplicates")) == sorted(x[0] is None and (9**9,) or (x[0],) for x in want)
    assert {(x[0], x[1]) for x in of("near_duplicates")} == {(x[0], x[1]) for x in want}
    assert None not in ids("near_duplicates") and ids("near_duplicates") & set(range(600, 630)) == {600} and len([x for x in of("near_duplicates") if x[0] == 700]) == 1
    judged = brute.contamination([(i, x[1]) for i, x in enumerate(of("near_duplicates"))], [(1, item)])
    assert sorted(of("decontamination"), key=key) == sorted((x for i, x in enumerate(of("near_duplicates")) if not judged[i][4]), key=key)
    assert ids("near_duplicates") - ids("decontamination") == {501}
    assert ids("mixing") <= ids("decontamination")
    assert P.run(spark, d).count() == len(seen["mixing"])


def test_pipeline_of_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert not any(staged(spark, d, spark.createDataFrame([], DOCS)).values())
