"""Substring dedup, spelling variants and hard negatives against brute force, and their edge rows."""

import re
from collections import Counter
from zlib import crc32

import numpy as np

from shelflight.llm import hard_negatives, spelling, substring_dedup

DOCS = "doc_id long, text string, kept string, row string, mark long, hashes string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "r", 7, "h") for i, t in rows], DOCS)


# --- repeated passages ---------------------------------------------------------------------

def brute_repeats(rows, size=13):
    found = [(i, re.findall(r"[^ \t\n\x0b\x0c\r]+", t or "")) for i, t in rows]
    least = {}
    for i, w in found:
        for p in range(len(w) - size + 1) if i is not None else ():
            key = tuple(w[p : p + size])
            least[key] = min(i, least.get(key, i))
    for i, w in found:
        gone = {q for p in range(len(w) - size + 1) if i is not None and least[tuple(w[p : p + size])] < i
                for q in range(p, p + size)}
        spans = [p for p in range(len(w) + 1) if (p in gone) != (p - 1 in gone)]
        yield i, len(w), spans, " ".join(x for p, x in enumerate(w) if p not in gone)


def test_repeated_passages_go(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LEAST_SLOTS", 4)
    rng = np.random.default_rng(5)
    pool = [" ".join(rng.choice(["a", "b", "é", "日本", "word,"], 30)) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 25))), str(rng.choice(pool)), f"own {i}"]
        rows.append((int(rng.integers(0, 60)), "\n\t".join(rng.permutation(parts))))
    rows += rows[:10] + [(None, pool[0]), (None, pool[0]), (3, None), (4, ""), (5, " \n"), (61, "x " * 12), (62, "x " * 12),
                         (63, "x " * 13), (64, "x " * 14), (-9, pool[0]), (65, pool[0] * 2000), (66, pool[0] * 2000 + " z")]
    got = sorted(((r.row.doc_id, r.n_words, r.spans, r.kept) for r in substring_dedup.cut_repeats(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(brute_repeats(rows), key=repr)
    assert substring_dedup.cut_repeats(frame(spark, [])).count() == 0


def test_chunks_agree_with_slots(spark):
    rows = [(i, " ".join(f"w{(i % 3) * 5 + k}" for k in range(40))) for i in range(40)]
    want = sorted(brute_repeats(rows))
    for size in (1, 1 << 20):
        docs = frame(spark, rows).repartition(2)
        assert sorted((r.row.doc_id, r.n_words, r.spans, r.kept) for r in substring_dedup.cut_repeats(docs, size).collect()) == want


def test_packed_windows_come_back():
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    c, r = rng.integers(0, 1 << 16, 1000).astype(np.uint16), rng.integers(0, 99, 1000).astype(np.uint32)
    for a, b in zip((h, c, r), substring_dedup.unpack(substring_dedup.pack(h, c, r), 1000), strict=True):
        assert (a == b).all()
    order, new = substring_dedup.by_window(np.array([5, 5, 5, 2], np.uint64), np.array([1, 0, 1, 0], np.uint16))
    assert order.tolist() == [3, 1, 0, 2] and new.tolist() == [True, True, True, False]


# --- spelling variants ---------------------------------------------------------------------

def edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def brute_variants(rows):
    counts = brute_words(rows)
    near = {w: [v for v in counts if edit_one(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, n, len(near[w]), counts.get(form[w])


def test_spelling_variants(spark):
    rng = np.random.default_rng(8)
    letters = list("abcÀéÿß")
    words = ["".join(rng.choice(letters, rng.integers(6, 10))) for _ in range(25)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaabaaa", "Documentation", "documentatiom", "docunentatiom", "x" * 9000, "x" * 9001]
    rows = []
    for i in range(700):
        own = []
        for w in rng.choice(words, 12, p=(p := 1 / np.arange(1, len(words) + 1) ** 1.5) / p.sum()):
            k = int(rng.integers(0, len(w)))
            kind = rng.random()
            own.append(w[:k] + str(rng.choice(letters)) + w[k + 1 :] if kind < 0.05 else w[:k] + w[k + 1 :] if kind < 0.1 else w)
        rows.append((i % 500 if i % 9 else None, rng.choice([" ", "1", "ā", "\n"]).join(own)))
    rows += [(1, None), (2, ""), (3, "123"), (4, words[-1] + " " + words[-2]), (5, words[-1] + " " + words[-2])]
    rows += [(1000 + i, w) for w, n in (("wonderful", 900), ("wonderfil", 60), ("wonderfxil", 4)) for i in range(n)]
    want = sorted(brute_variants(rows), key=repr)
    assert any(r[2] != r[1] and r[1] for r in want) and sum(r[4] for r in want) > 200
    for most in (4096, 3):
        got = sorted((tuple(r) for r in spelling.variants(frame(spark, rows), most).collect()), key=repr)
        assert got == want
    assert spelling.variants(frame(spark, [])).count() == 0


# --- hard negatives ------------------------------------------------------------------------

def brute_negatives(rows):
    use = []
    for u, (i, label, vec) in enumerate(rows):
        if i is None or label is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        use.append((u, i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in vec]))
    for u, i, label, vec in use:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vec, v)), j, other == label) for w, j, other, v in use if w != u)
        for p, j, _ in [s for s in scored if s[2]][:5]:
            fit = [s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            for rank, (s, n, _) in enumerate(fit, 1):
                yield i, j, rank, n, -p, -s


def test_hard_negatives(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(900):
        rows.append((i, int(rng.integers(0, 10)), (base[rng.integers(0, 12)] + 0.4 * rng.normal(size=8)).tolist()))
    rows += [(1000, 3, rows[5][2]), (1001, None, rows[5][2]), (1002, 3, None), (1003, 3, [float("nan")] * 8), (1004, 3, [None] * 8),
             (None, 3, rows[5][2]), (1005, 3, []), (1100, 4, [0.0] * 8), (1200, 5, [1.0]), (1300, 77, rows[5][2]),
             (1400, 3, [1e5, -1e6, 3.0]), (1500, 3, [2e6, 4e6]), (-100, 2, rows[7][2]), rows[100], rows[8], (1006, 3, [float("inf")])]
    schema = "vec_id long, label int, embedding array<double>, uid long, part int, cluster int, list int"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema)
    want = sorted(brute_negatives(rows))
    for chunk, pack in ((256, 4096), (8, 50)):
        got = hard_negatives.mine(hard_negatives.flipped(hard_negatives.usable(df)), chunk=chunk, pack=pack)
        assert sorted(tuple(r) for r in got.collect()) == want
    empty = hard_negatives.mine(hard_negatives.flipped(hard_negatives.usable(df.limit(0))))
    assert empty.count() == 0


def test_bounds_hold_and_end_the_walk():
    rng = np.random.default_rng(4)
    members = np.rint(100 * (rng.normal(size=6) + 0.2 * rng.normal(size=(20, 6))))
    rows = np.rint(100 * rng.normal(size=(500, 6)))
    order, bound = hard_negatives.bounds(members, rows)
    norm = np.sqrt((members**2).sum(axis=1))
    assert (hard_negatives.inner(members, rows[order]) <= norm[:, None] * bound[None] + 1e-3).all()
    assert (np.diff(bound) <= 0).all()
