"""Whitening, personal data and the divergence audit against plain Python."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from skein.llm import divergence, personal, toxicity, whitening

BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 13 <= len(only(m)) <= 19 and luhn(only(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(only(m)) <= 15),
]


def only(m):
    return re.sub("[^0-9]", "", m)


def luhn(d):
    double = lambda v: v - 9 if v > 9 else v
    return sum(double(2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, pattern, valid in BASE for m in pattern.finditer(text or "") if valid(m[0])]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def odd_texts():
    r = random.Random(3)
    parts = ["a@b.c", "@", ".", "x.y-z@d-e.f.g", "_q@", "1.2.3.4", "256.1.1.1", "001.002.3.255", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713", "3530111333300000", "1 2 3 4", "+1 (508) 555-6565",
             "+49 30 1234", "+1((((", "+", "-", " ", "  ", "\n", "é", "😀", "Z", "0", "12", "(508) 555-6565", "phone", "IBAN DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE89370400440532013001", "tel 030/1234567"]
    return [None, "", *("".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(400))]


def test_base_spans_are_those_of_the_patterns(spark):
    texts = odd_texts()
    rows = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    for text, got in zip(texts, personal.report(rows).collect(), strict=True):
        want = plain_spans(text)
        assert tuple(got[f"n_{k}"] for k, _, _ in BASE) == tuple(sum(w[0] == k for w in want) for k, _, _ in BASE), text
        assert got["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest(), text
        assert {listed([w]) for w in want} <= set(got["spans"].split(",")), text
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in got["spans"].split(",") if x)]
        order = [(personal.ORDER.index(k), a) for k, a, _ in spans]
        assert order == sorted(order)
        assert all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(spans, spans[1:])), text


def test_added_spans_and_scores(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "IBAN DE88 3704 0044 0532 0130 00 ok", "x GB82WEST12345698765432.", "call (508) 555-6565 now", "see (508) 555-6565 now", "version 1.2.3.4", "host 1.2.3.4", "pay by card 4111 1111 1111 1111", "order 4111 1111 1111 1111"]
    out = personal.personal_data(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()
    found = [[(s["kind"], t[s["start"] : s["end"]], s["base"]) for s in row["spans"]] for t, row in zip(texts, out)]
    assert found[:5] == [[("iban", "DE89 3704 0044 0532 0130 00", False)], [], [("iban", "GB82WEST12345698765432", False)], [("phone", "(508) 555-6565", False)], []]
    score = [row["spans"][0]["score"] for row in out[5:]]
    assert score[0] < 0.7 < score[1] and score[3] < 0.9 < score[2]


def test_long_texts_stay_linear(spark):
    """Texts on which a pattern that tries every start would not end; the plain one does not either, so what is in them is said."""
    every = lambda kind, n, step, size: [(kind, step * i, step * i + size) for i in range(n)]
    texts = [("1" * 300_000, []), ("a" * 300_000, []), ("a@" * 100_000, []), ("1.1.1.1 " * 40_000, every("ip", 40_000, 8, 7)), ("+1" + "(" * 300_000, []), ("1 " * 100_000, []), ("x@y.z " * 40_000, every("email", 40_000, 6, 5)), ("A1" * 100_000, [])]
    out = personal.report(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").repartition(4)).collect()
    for row in out:
        assert row["base_sha256"] == hashlib.sha256(listed(texts[row["doc_id"]][1]).encode()).hexdigest()


def test_toxicity_keeps_any_other_column(spark):
    rows = spark.createDataFrame([(i, "a fine day" if i % 2 else "awful rubbish", 5, "r", "t") for i in range(12)], "doc_id long, txt string, `a.b` int, row string, text string")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(12)], "doc_id long, toxic int")
    out = toxicity.toxicity(rows, labels, text_col="txt")
    assert out.columns == ["doc_id", "txt", "a.b", "row", "text", "score", "predicted"]
    assert all(x["a.b"] == 5 and x["row"] == "r" and 0 <= x["score"] <= 1 for x in out.collect())


def test_personal_data_keeps_other_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a@b.c", 5, "s", "r"), (1, "a@b.c", 5, "s", "r")], "doc_id long, text string, `a.b` int, spans string, row string")
    out = personal.personal_data(rows)
    assert sorted(out.columns) == ["a.b", "doc_id", "row", "spans", "text"] and [len(r["spans"]) for r in out.collect()] == [1, 1]
    assert personal.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def plain_whitening(vectors, k=32):
    """Exact sums and covariances by fractions, the eigenvectors by numpy."""
    sound = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in sound), default=0)
    sound = [(i, v + [1_000_000] * (width - len(v))) for i, v in sound]
    n, sums = len(sound), [sum(col) for col in zip(*(v for _, v in sound))]
    centre = [[n * x - s for x, s in zip(v, sums)] for _, v in sound]
    cov = np.array([[float(Fraction(sum(c[a] * c[b] for c in centre), n**3)) for b in range(width)] for a in range(width)])
    return sound, n, centre, cov


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening(spark, parts):
    r = np.random.default_rng(5)
    mix = r.normal(0, 0.3, (6, 6))
    vectors = [(i, [single(x) for x in r.normal(0, 1, 6) @ mix]) for i in range(120)]
    vectors[3], vectors[4], vectors[5], vectors[6] = (3, None), (4, [float("nan")] * 6), (5, [None, *[0.0] * 5]), (6, [float("-inf")] * 6)
    vectors += [(None, vectors[8][1]), (8, vectors[8][1]), (9, [0.5, -0.25])]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(parts)
    sound, n, centre, cov = plain_whitening(vectors)
    got = defaultdict(list)
    for x in whitening.report(rows).collect():
        got[x["vec_id"], x["component"]].append(x)
    values, found = np.linalg.eigh(cov)
    values, found = values[::-1], found[:, ::-1]
    want = np.array(centre, float) / n @ found / np.sqrt(values)
    assert sum(map(len, got.values())) == 6 * n and all(x["n"] == n and x["identity_error"] < 1e-9 for v in got.values() for x in v)
    for j in range(6):
        every = [(i, sorted(x["whitened"] for x in got[i, j + 1])) for i, _ in sound]
        flip = 1 if every[0][1][0] * want[0, j] > 0 else -1
        for (i, have), w in zip(every, want[:, j]):
            assert min(abs(flip * h - w) for h in have) < 1e-7
    for (i, _), c in zip(sound, centre):
        assert sum(x * x for x in c) in {x["deviation"] for x in got[i, 1]}
    assert abs(sum(got[0, j + 1][0]["explained"] for j in range(6)) - 1) < 1e-9


def test_whitening_without_variance_and_with_large_values(spark):
    flat = spark.createDataFrame([(1, [0.5, 0.5, 1.0], 1), (2, [0.5, 0.5, 2.0], 1)], "vec_id long, embedding array<double>, `a.b` int")
    out = {(r["vec_id"], r["component"]): r for r in whitening.report(flat).collect()}
    assert len(out) == 6 and abs(abs(out[1, 1]["whitened"]) - 1) < 1e-12 and out[1, 2]["whitened"] is None and out[1, 1]["identity_error"] < 1e-9
    kept = whitening.whiten(flat, whitening.fit(flat))
    assert kept.columns == ["vec_id", "embedding", "a.b", "deviation", "whitened"] and kept.count() == 2
    one = spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<double>")
    assert [(r["whitened"], r["explained"], r["deviation"]) for r in whitening.report(one).collect()] == [(None, None, 0)]
    large = spark.createDataFrame([(1, [1e9, 3.0]), (2, [-1e9, 1.0]), (3, [2e7, 0.0]), (4, [1e300, 0.0])], "vec_id long, embedding array<double>")
    _, n, centre, _ = plain_whitening([(1, [1e9, 3.0]), (2, [-1e9, 1.0]), (3, [2e7, 0.0])])
    got = {r["vec_id"]: r["deviation"] for r in whitening.report(large).collect()}
    exact = [sum(x * x for x in c) for c in centre]
    assert got == {i + 1: x if x < 2**63 else None for i, x in enumerate(exact)}
    for none in ([], [(1, None)], [(1, [])]):
        assert whitening.report(spark.createDataFrame(none, "vec_id long, embedding array<float>")).count() == 0


LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, k=10, min_docs=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [tuple(x or "" for x in row) for row in rows]
    count, docs = Counter(), Counter()
    for lang, source, text in rows:
        terms = LETTERS.findall(text.translate(lower))
        count.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    share = lambda c, n, v: 1 + 1_000_000_000 * (c + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {x[0] for x in rows}:
        kept = sorted(t for (of, t), n in docs.items() if of == lang and n >= min_docs)
        sources = sorted({x[1] for x in rows if x[0] == lang})
        n = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: share(count[lang, s, t], n[s], len(kept)) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s, t] for s in sources), sum(n.values()), len(kept)) for t in kept}
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s, t] and p[s][t] > q[t])[:k]
            out += [(lang, s, part, item, -v, r + 1) for part, found in (("pair", pairs), ("term", terms)) for r, (v, _, item) in enumerate(found)]
    return sorted(out)


def corpus(seed=2, n=300):
    r = random.Random(seed)
    words = ["".join(r.choice("abéß") for _ in range(r.randint(1, 3))) for _ in range(60)] + ["long" * 50 + x for x in ("", "a", "b", "é", "bb")] + ["😀", "Ünder", "ABC"]
    rows = [(r.choice(["en", "en", "de", None, "xx"]), r.choice(["s1", "s2", "é", "", None, "Z"]), " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for _ in range(n)]
    rows += [("none", "a", "only once"), ("none", "b", None), ("none", "c", "12 34"), ("en", "empty", ""), ("tie", "t", "x")]
    return rows + [("tie", s, " ".join(f"t{chr(97 + i)}" for i in range(26))) for s in ("t", "u") for _ in range(6)] + [("tie", "v", "ta") for _ in range(3)]


@pytest.mark.parametrize("settings", [{}, {"tile": 2, "bucket_terms": 3}])
def test_audit(spark, settings):
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert sorted(tuple(x) for x in divergence.audit(docs, **settings).select("lang", "source", "part", "item", "value", "rank").collect()) == plain_audit(rows)


def test_audit_slices_other_names_and_empty_tables(spark):
    rows = corpus(5, 60)
    docs = spark.createDataFrame([(*x, 1, "q") for x in rows], "lang string, source string, text string, `a.b` int, term string").coalesce(1)
    counts = divergence.term_counts(docs, slice_bytes=200).where("term is not null")
    want = Counter((lang or "", source or "", t) for lang, source, text in rows for t in LETTERS.findall((text or "").replace("ABC", "abc").replace("Ünder", "Ünder")))
    assert {(x["lang"], x["source"], x["term"]): x["n"] for x in counts.collect()} == dict(want)
    assert divergence.report(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
