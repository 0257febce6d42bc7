"""The text operators against plain Python, awkward rows included."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import decontaminate, exchange, jaccard, licences, lines, mixing, passages, suffixes
from skein.llm import textops as X
from tests.llm import brute

ROWS = brute.documents()
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def got(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_passages(docs):
    assert got(passages.report(docs), "n_words", "n_removed", "n_spans", "kept_sha256") == brute.passages(ROWS)


def test_passages_other_window_and_text(docs):
    out = passages.dedup_passages(docs, window=8)
    assert got(out, "n_words", "n_removed", "n_spans", "kept_sha256") == brute.passages(ROWS, 8)
    assert all(brute.sha(r["kept_text"]) == r["kept_sha256"] for r in out.collect())


def test_suffixes(docs):
    assert got(suffixes.report(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffixes(ROWS)


def test_suffixes_short_strings(docs):
    assert got(suffixes.dedup_suffixes(docs, length=20, k=8), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffixes(ROWS, 20)


def test_suffixes_split_hot_anchors(spark, docs):
    assert got(suffixes.dedup_suffixes(docs, hot=2), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffixes(ROWS)
    r = random.Random(11)
    own = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    notice = "this notice of some sixty bytes stands in every one of the texts"
    rows = [(i, own(60) + notice + own(60)) for i in range(120)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(suffixes.dedup_suffixes(d, hot=50), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffixes(rows)
    payloads = suffixes.ask_anchors(d, 50, 24, 4, 1 << 20).collect()
    of = {b: [x["payload"] for x in payloads if x["b"] == b] for b in {x["b"] for x in payloads}}
    wide = [exchange.unbits(a[-(-int.from_bytes(p[:4], "little") // 8) :], int.from_bytes(p[:4], "little")).sum() for ps in of.values() for p, a in zip(ps, suffixes.resolve_anchors(ps, 50))]
    assert sum(wide) > 0  # the notice's anchor has as many stretches as there are texts


@pytest.mark.parametrize("rule", [(10, 2), (1, 2), (3, 4)])
def test_lines(docs, rule):
    out = lines.dedup_lines(docs, min_chars=rule[0], min_docs=rule[1])
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"], brute.sha(r["kept_text"])) for r in out.collect()}
    assert found == brute.lines(ROWS, *rule)


@pytest.mark.parametrize("rule", [(4, 85), (5, 80), (2, 50), (1, 100)])
def test_jaccard(docs, rule):
    assert got(jaccard.near_duplicates(docs, *rule), "n_shingles", "component_id", "n_links") == brute.jaccard(ROWS, *rule)


def test_jaccard_cuts_blocks_into_chunks(docs):
    assert got(jaccard.near_duplicates(docs, block_tokens=200), "n_shingles", "component_id", "n_links") == brute.jaccard(ROWS)


def test_jaccard_planted_hub(spark):
    """Copies of one text that differ from each other more than from it are tied through it alone."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    rows = [(100, " ".join(base))]
    for i in range(30):
        w = list(base)
        for p in r.sample(range(400), 7):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(r.choice(base) for _ in range(100))) for i in range(20)]
    out = got(jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA), block_tokens=2000), "n_shingles", "component_id", "n_links")
    assert out == brute.jaccard(rows)
    assert out[29][1] == 0


def test_jaccard_without_counting_links(docs):
    assert got(jaccard.near_duplicates(docs, links=False), "n_shingles", "component_id") == {i: x[:2] for i, x in brute.jaccard(ROWS).items()}


def test_jaccard_of_one_text_in_most_rows(spark):
    r = random.Random(12)
    base = " ".join(r.choice("abcdefghijklm") for _ in range(60))
    rows = [(i, base) for i in range(150)] + [(200 + i, base[:-2] + f" {i}") for i in range(40)] + [(300 + i, " ".join(r.choice("abcdefghijklm") for _ in range(40))) for i in range(50)] + [(400 + i, "") for i in range(30)]
    assert got(jaccard.report(spark.createDataFrame(rows, SCHEMA)), "n_shingles", "component_id", "n_links") == brute.jaccard(rows)


ITEMS = [(1, " ".join(["Item", "one"] + [f"t{i}" for i in range(20)])), (2, "short ONE, here"), (3, None), (4, ""), (5, " ".join(f"t{i}" for i in range(5, 19))), (10, "single")]


def contaminated():
    t = [f"t{i}" for i in range(20)]
    return [(1, "item-one: " + "/".join(t)), (2, "Short, one HERE and more " + "x " * 200), (3, " ".join(t[3:16])), (4, " ".join(t[:12])), (5, None), (6, "a single word"), (7, "y " * 39 + "single"), (8, " ".join(t[5:19]) * 2)] + ROWS[8:14]


@pytest.mark.parametrize("part", [1 << 20, 1024])
def test_decontaminate(spark, part):
    rows = [(i + 1000 * (n > 7), t) for n, (i, t) in enumerate(contaminated())]
    d = spark.createDataFrame(rows, SCHEMA)
    out = decontaminate.contamination(d, spark.createDataFrame(ITEMS, "item_id long, text string"), part_bytes=part, cut=True)
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"])), r["contaminated"]) for r in out.collect()}
    assert found == brute.contamination(rows, ITEMS)
    text = {r["doc_id"]: r["clean_text"] for r in out.collect()}
    assert text[6] == "a  word" and text[1] == "" and text[4] == rows[3][1]


def test_decontaminate_repeated_rows_in_parts(spark):
    d = spark.createDataFrame([(1, "a single word")] * 3, SCHEMA)
    out = decontaminate.contamination(d, spark.createDataFrame(ITEMS, "item_id long, text string"), part_bytes=1024)
    assert out.count() == 3


def plain_licences(text, templates, least):
    """Every licence of a text by Dice over all windows, in plain Python."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.AZ))
    w, best = words(text), {}
    for name, t in templates.items():
        t = words(t)
        want = set(zip(t, t[1:]))
        for at, part in [(0, w)] + [(i, w[i : i + len(t)]) for i in range(max(1, len(w) - len(t) + 1))]:
            own = set(zip(part, part[1:]))
            if own and want:
                d = 2 * len(own & want) / (len(own) + len(want))
                if d >= least:
                    kind = name.split("/")[0]
                    best[kind] = min(best.get(kind, (1,)), (-d, -len(t), at, name))
    return [(x[3], round(-x[0], 6), x[2]) for x in sorted(best.values())]


def test_licences(spark):
    T = licences.TEMPLATES
    rows = [(i, f"intro words here {t} and then some more text") for i, t in enumerate(T.values())]
    rows += [(50, T["MIT/notice"].upper()), (51, None), (52, ""), (53, "Licensed"), (54, "licensed under the sky"), (55, "Licensed under the Apache License, Version 2"), (56, "x " * 5000 + T["GPL-3.0/notice"])]
    rows += [(57, T["MIT/notice"] + " or, at your choice, " + T["Apache-2.0/notice"]), (58, "Copyright (c) 2020 A. Author " + T["BSD-3-Clause"].replace("copyright holder", "University"))]
    out = {r["doc_id"]: r for r in licences.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[i]["licence"] for i in range(len(T))] == [n.split("/")[0] for n in T]
    assert all(out[i]["dice"] == 1.0 and out[i]["first_word"] == 3 for i in range(len(T)))
    assert out[50]["licence"] == "MIT" and out[55]["licence"] == "Apache-2.0" and out[56]["first_word"] == 5000 and out[57]["n_found"] == 2 and out[58]["licence"] == "BSD-3-Clause"
    assert all(out[i]["licence"] is None and out[i]["n_found"] == 0 for i in (51, 52, 53, 54))


def test_licences_against_plain_dice(spark):
    r = random.Random(5)
    words = list("abcdefgh")
    T = {"t": "a b c d e f g a", "t/two": "c d e", "u": "a a b", "v": " ".join(r.choice(words) for _ in range(30))}
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(300)] + [(300 + i, " ".join(["x"] * i + T["v"].split()[i:])) for i in range(12)]
    out = licences.licences(spark.createDataFrame(rows, SCHEMA), templates=T, least=0.6).collect()
    for x in out:
        assert [(f["template"], f["dice"], f["first_word"]) for f in x["found"]] == plain_licences(x["text"], T, 0.6)
    assert sum(x["n_found"] for x in out) > 40
    table = spark.createDataFrame([(n, t) for n, t in T.items()] + [("w", None)], "name string, text string")
    assert licences.from_table(table) == T
    with pytest.raises(ValueError):
        licences.from_table(table, 10)
    assert licences.licences(spark.createDataFrame(rows[:3], SCHEMA), templates={}).where("n_found > 0").count() == 0


def test_registered_licence_scan_against_plain_dice(spark):
    """The whole default set on the given documents."""
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path).select("doc_id", "text")
    marks = re.compile("licen|permission|mozilla|software|copyright", re.I)
    for x in licences.licences(docs).collect():
        if marks.search(x["text"] or ""):
            assert [(f["template"], f["dice"], f["first_word"]) for f in x["found"]] == plain_licences(x["text"], licences.TEMPLATES, 0.8)
        else:
            assert not x["found"]


@pytest.mark.parametrize("report", [passages.report, suffixes.report, lines.report, jaccard.report, licences.report])
def test_empty_tables(spark, report):
    assert report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_empty_benchmark(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.report(docs, none)
    assert out.where("n_hit > 0 OR contaminated").count() == 0 and out.count() == len(ROWS)
    assert decontaminate.report(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_null_ids_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(None, long), (None, "other words"), (7, long), (7, long), (7, "short")], SCHEMA)
    p = sorted((r["doc_id"] is None, r["n_words"], r["n_removed"]) for r in passages.report(d).collect())
    assert p == [(False, 1, 0), (False, 60, 60), (False, 60, 60), (True, 2, 0), (True, 60, 60)]
    s = sorted((r["doc_id"] is None, r["n_bytes"], r["n_removed"]) for r in suffixes.report(d).collect())
    assert s == [(False, 5, 0), (False, len(long), 0), (False, len(long), 0), (True, 11, 0), (True, len(long), len(long))]
    j = sorted((r["doc_id"] is None, r["n_shingles"], r["component_id"]) for r in jaccard.report(d).collect() if r["component_id"] is not None)
    assert j == [(False, 1, 7), (False, 57, 7), (False, 57, 7), (True, 57, 7)]
    k = sorted((r["doc_id"] is None, r["n_dropped"]) for r in lines.report(d).collect())
    assert k == [(False, 0), (False, 0), (False, 0), (True, 0), (True, 1)]


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "some text of a line\nmore", 5, "x", 9)], "doc_id long, text string, n_lines int, kept_text string, n_words int")
    out = lines.dedup_lines(d).first()
    assert (out["n_lines"], out["kept_text"], out["n_words"]) == (2, "some text of a line\nmore", 9)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(d, bench).first()["n_words"] == 6
    assert licences.licences(d).first()["n_words"] == 6


def test_any_other_column_name(spark):
    names = "doc text row d x hash pos drop keep at all which source total of in tokens count h g n i t _d _x _s _drop spans2".split()
    d = spark.createDataFrame([(i, f"a shared line of text\nown {i}", "s", *range(len(names))) for i in range(3)], "doc_id long, txt string, src string, " + ", ".join(f"`{n}` int" for n in names))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for out in (lines.dedup_lines(d, text_col="txt"), licences.licences(d, text_col="txt"), decontaminate.contamination(d, bench, text_col="txt"), decontaminate.contamination(d, bench, text_col="txt", part_bytes=1024), mixing.mix(d, text_col="txt", source_col="src")):
        assert set(names) <= set(out.columns) and all(x[names[5]] == 5 and x[names[-1]] == len(names) - 1 for x in out.collect())


def test_lines_of_one_long_document_take_linear_time(spark):
    text = "\n".join(f"line number {i} of them" for i in range(120_000))
    began = time.time()
    out = {r["doc_id"]: r for r in lines.report(spark.createDataFrame([(1, text), (2, text + "\nlast one")], SCHEMA)).collect()}
    assert time.time() - began < 20
    assert (out[1]["n_dropped"], out[2]["n_dropped"], out[2]["n_lines"], out[2]["kept_sha256"]) == (0, 120_000, 120_001, brute.sha("last one"))


def test_index_parts_keep_to_their_bytes(spark):
    r = random.Random(4)
    items = [(f"i{i}", " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 60)))) for i in range(300)] + [("w", "a b " * 3000)]
    index = decontaminate.build([n for n, _ in items], pa.array([t for _, t in items]), 13)
    budget = sum(len(t) * decontaminate.INDEX_BYTES[0] + len(n) + decontaminate.INDEX_BYTES[1] for n, t in items)
    assert decontaminate.index_bytes(index) <= budget
    docs = [(i, " ".join([t[10:] for _, t in r.sample(items, 2)] + ["x"] * 20)) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    one, many = (sorted(map(tuple, decontaminate.report(spark.createDataFrame(docs, SCHEMA), bench).collect())) if p == 1 else sorted((x["doc_id"], x["n_words"], x["n_hit"], len(x["items"]), brute.sha(",".join(x["items"])), x["contaminated"]) for x in decontaminate.contamination(spark.createDataFrame(docs, SCHEMA), bench, part_bytes=budget // 4).collect()) for p in (1, 2))
    assert one == many and any(x[2] for x in one)


def test_very_long_texts(spark):
    """Texts over the two MB of a group stand alone in one and are read whole."""
    r = random.Random(13)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    long = " ".join(r.choice(words) for _ in range(420_000))
    tail = " ".join(r.choice(words) for _ in range(60))
    rows = [(1, long + " " + tail), (2, "short text"), (3, tail)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert len(long) > 2 << 20
    p = got(passages.report(d), "n_words", "n_removed")
    assert p == {1: (420_060, 60), 2: (2, 0), 3: (60, 60)}
    s = got(suffixes.report(d), "n_bytes", "n_removed")
    assert s[1] == (len(rows[0][1]), 0) and s[3] == (len(tail), len(tail))
    j = got(jaccard.report(d), "n_shingles", "component_id")
    assert j[1][1] == 1 and j[3] == (57, 3)


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for t in range(200):
        n = rng.integers(1, 60)
        a = rng.integers(2, 2 + rng.integers(1, 5), n)
        s = np.append(a, 0).astype(np.uint8)
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        suffixes.RECURSE = 2048 if t % 2 else 2
        assert suffixes.suffix_array(s, 258).tolist() == want
        for j in rng.integers(1, n + 1, 3):
            if s[j] and s[j - 1] != 1 and s[j + 1] != 1:
                s[j] = 1
        sa = suffixes.suffix_array(s, 258, mark=1)
        room = np.zeros(len(s), np.int32)
        for i in range(len(s) - 2, -1, -1):
            room[i] = 0 if s[i] <= 1 else room[i + 1] + 1
        prefix = suffixes.permuted_prefixes(s, sa, room)
        for x, y in zip(sa[:-1], sa[1:]):
            same = 0
            while same < min(room[x], room[y]) and s[x + same] == s[y + same]:
                same += 1
            assert prefix[y] == same
    suffixes.RECURSE = 2048


def test_packing():
    rng = np.random.default_rng(2)
    for top in (1, 300, 1 << 20, 1 << 30, 1 << 40):
        v = np.unique(rng.integers(0, top, 50).astype(np.uint64))
        assert (exchange.unpack_differences(exchange.pack_differences(v)) == v).all()


def test_windows_stay_in_their_text():
    data, offsets = X.buffer_of(pa.array(["a b c", None, "d", "e f g h"]))
    _, _, at = X.tokens(data, offsets, X.WORD)
    assert at.tolist() == [0, 3, 3, 4, 8] and X.windows(at, 3).tolist() == [0, 4, 5] and X.windows(at, 9).tolist() == []
