"""Plain Python versions of the contracts, and small documents that hold the awkward cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def documents(seed=1, n=40):
    """(doc_id, text): copies, near copies, shared passages and lines, odd blanks, nulls, long and empty texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéü9") for _ in range(r.randint(1, 7))) for _ in range(400)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, base = words(60), words(150)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "Word"), (4, "word"), (5, "a b c d"), (6, "a  b\x0bc\x0cd"), (7, "a\xa0b\x85c d e f")]
    for i in range(8, n):
        kind = r.randrange(7)
        if kind == 0:
            w = words(r.randint(1, 200))
        elif kind == 1:
            w = words(r.randint(0, 40)) + passage + words(r.randint(0, 40))
        elif kind == 2:
            w = list(base)
        elif kind == 3:
            w = list(base)
            for _ in range(r.randint(1, 6)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        elif kind == 4:
            w = words(20) * 5
        elif kind == 5:
            w = words(30) + ["\nShared Line of text here\n"] + words(5) + ["\n  shared line OF text here \n"]
        else:
            w = passage[: r.randint(30, 40)]
        rows.append((i, " ".join(w)))
    rows += [(n, "x " * 3000), (n + 1, "aaaa" * 2000), (n + 2, "\n" * 50), (n + 3, "ÀÉ ÀÉ end"), (n + 4, "ß" * 80 + " " + "ß" * 80)]
    return rows


def passages(rows, k=35):
    split = {i: [w.encode() for w in WORD.findall(t or "")] for i, t in rows}
    count = Counter(tuple(w[j : j + k]) for w in split.values() for j in range(len(w) - k + 1))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if count[tuple(w[j : j + k])] > 1:
                gone[j : j + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone)), sha(kept))
    return out


def suffixes(rows, k=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - k + 1):
            first[b[p : p + k]] = min(i, first.get(b[p : p + k], i))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - k + 1):
            if first[b[p : p + k]] < i:
                m[p : p + k] = b"\1" * k
        out[i] = (len(b), sum(m), sum(m[j] and (j == 0 or not m[j - 1]) for j in range(len(m))), sha(bytes(x for x, y in zip(b, m) if not y)))
    return out


def kept_lines(rows, least=10, docs=2):
    """Each row's text without its dropped lines; None where none is dropped. A null id is the largest."""
    key = lambda s: s.strip(" \t\n\x0b\f\r").translate(AZ)
    last = 2**63 - 1
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(last if i is None else i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < least or len(held[key(x)]) < docs or min(held[key(x)]) == (last if i is None else i)]
        out.append("\n".join(kept) if len(kept) < len(own) else None)
    return out


def lines(rows, least=10, docs=2):
    out = {}
    for (i, t), kept in zip(rows, kept_lines(rows, least, docs)):
        n, text = len((t or "").split("\n")), (t or "") if kept is None else kept
        lost = 0 if kept is None else n - (len(kept.split("\n")) if kept or any(not x for x in t.split("\n")) else 0)
        out[i] = (n, lost, sha(text))
    return out


def jaccard(rows, k=4, percent=85):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(AZ))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, links = sorted(sets), dict.fromkeys(sets, 0)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def contamination(rows, items, n=13):
    grams = defaultdict(set)
    for name, t in items:
        w = ALNUM.findall((t or "").translate(AZ))
        k = min(n, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            grams[tuple(w[j : j + k])].add(str(name))
    out = {}
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(AZ))
        hit, found = set(), set()
        for k in {len(g) for g in grams}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in grams:
                    hit.update(range(j, j + k))
                    found |= grams[tuple(w[j : j + k])]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out
