"""Words at one edit from each other against brute force, and the counts and forms on small tables."""

import random
import zlib
from collections import Counter

from fitloom.llm import spelling as S


def one_edit(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def near_pairs(spark, words):
    return sorted(tuple(r) for r in S.neighbours(spark.createDataFrame([(w, "x", 1) for w in words], "word string, w string, node int")).collect())


def edited(rng, w, letters):
    i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
    return w[:i] + ("" if kind == 0 else rng.choice(letters)) + w[i + (kind > 0 and kind == 1):]


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(11)
    letters = "abcé"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(250)}
    # Runs of one letter, and words so long that their walks take long edges.
    words |= {"a" * k for k in range(1, 9)} | {"\U0001f600a\U0001f600", "\U0001f600b\U0001f600", "\U0001f600\U0001f600"}
    for n in (15, 17, 30, 33, 34, 35, 70, 400):
        base = "".join(rng.choice(letters) for _ in range(n))
        words |= {base, base[1:], base[:-1], "b" + base} | {edited(rng, base, letters) for _ in range(12)}
    words = sorted(words - {""})
    assert near_pairs(spark, words) == sorted((u, v) for u in words for v in words if one_edit(u, v))


def test_very_long_words(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("xyz") for _ in range(60_000))
    other = base[:20_000] + "w" + base[20_001:]
    less = base[:45_000] + base[45_001:]
    got = near_pairs(spark, [base, other, less, "w" + base, base[::-1]])
    assert got == sorted([(base, other), (other, base), (base, less), (less, base), (base, "w" + base), ("w" + base, base)])


def test_few_or_no_words(spark):
    assert near_pairs(spark, []) == []
    assert near_pairs(spark, ["abc"]) == []
    assert near_pairs(spark, ["a", "b"]) == [("a", "b"), ("b", "a")]


def brute(rows, least=6, least_n=5, every=199):
    import re

    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= least_n}
    out = {}
    for w, k in n.items():
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best is not None and n[best] >= 5 * k else None, k, len(near))
    rows = []
    for w, (form, k, m) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, k, m, n[form] if form else None))
    return sorted(rows, key=str)


def test_forms_and_roots(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["colour", "color", "Colours", "ÉTAGES", "étages", "étagés", "naïves", "words", "chœurs", "a1b"]) for _ in range(60))) for i in range(30)]
    rows += [(100, "kitten " * 700), (101, "kittens " * 130 + "mittens " * 20), (102, "sittens " * 5 + "bittens" * 1), (103, "bittens-" * 5)]
    rows += [(None, None), (None, "kitten, kitten"), (7, ""), (100, "kitten " * 700), (104, "q" * 5000), (105, ("q" * 4999 + " ") * 6)]
    docs = spark.createDataFrame([(i, t, 1, "c", 0) for i, t in rows], "doc_id long, text string, n long, word string, w int")
    # A small divisor, so that many runs lose a code point.
    for every in (199, 3):
        got = S.group_variants(docs, drop_every=every).select("word", "form", "root", "n", "n_near", "form_n")
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, every=every)


def test_empty_table(spark):
    assert S.group_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
