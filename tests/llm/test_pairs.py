"""Operators that match texts or vectors with each other, against brute force on small fixtures."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fitloom.llm import decontaminate as D, simhash as S, spans as P, vectors as V
from fitloom.llm.common import components

DOCS = "doc_id long, text string, lang string, n_words long, fp long, hash string"  # the last three clash with inner names


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 7, "x") for i, t in rows], DOCS)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def smallest(n, pairs):
    up = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    return up


def test_components_of_chain_star_and_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_phrases_equal_brute_force(spark):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([25, 14, 10, 4, 1, 0, 12, 30])] + [(8, None), (None, "w1 w2"), (2, None)]
    items.append((11, "A b A b A b a b a b a b"))
    rows = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 80))
        source = (items[rng.randrange(8)][1] or "").split()
        lo = rng.randrange(max(len(source) - 9, 1))
        w[len(w) // 2:len(w) // 2] = source[lo:lo + rng.choice([9, 10, 11, 30])]
        rows.append((i, "  ".join(w).replace("w1", "W1") + "!"))
    rows += [(60, None), (61, ""), (None, items[0][1]), (5, rows[5][1]), (62, "a b " * 3000), (63, "É" + items[2][1])]
    got = D.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 10).collect()
    assert len(got) == len(rows)

    def split(text):
        return [w for w in spark_words(text or "") if w]

    want = []
    for i, t in rows:
        w, hit, named = split(t), set(), set()
        for item, text in items:
            x = split(text)
            if not x or item is None:
                continue
            n = min(10, len(x))
            grams = {tuple(x[s:s + n]) for s in range(len(x) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in grams:
                    hit |= set(range(s, s + n))
                    named.add(str(item))
        want.append((i, len(w), len(hit), tuple(sorted(named)), bool(hit)))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got], key=key) == sorted(want, key=key)


def spark_words(text):
    import re
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_proximity_finds_shifted_rare_words(spark):
    item = "alpha the beta the gamma the delta the epsilon the"
    rows = [(0, item), (1, "alpha the the beta x x x"), (2, "alpha " + "z " * 40 + "beta"), (3, None)]
    index, items, pairs = D.prepare(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"), 10)
    near = {(r["_d"], r["off"]) for r in D.proximity_hits(index, items, pairs, 3).collect()}
    assert (0, 0) in near and not any(d in (2, 3) for d, _ in near)


def test_contaminated_documents_go_and_columns_stay(spark):
    bench = spark.createDataFrame([(1, "a1 b1 c1")], "item_id long, text string")
    df = docs(spark, [(1, "x a1 b1 c1 y"), (2, "a1 b1"), (3, None), (None, "clean")])
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, None}
    assert D.decontaminate(df.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in D.decontaminate(df, bench.limit(0)).collect())


def plain_fingerprint(text, width):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    w = [x for x in w.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if x]
    grams = [b" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two", "É Ü\u00a0x y z é", "a b c d e a b c d e " * 50])
def test_fingerprint(text):
    assert S.fingerprint(text, 4) == plain_fingerprint(text, 4)


def test_every_block_value_has_one_home_within_the_radius():
    homes = S.hamming_homes()
    values = np.arange(1 << S.CODED)
    assert len(set(homes.tolist())) == 2048 and (homes[homes] == homes).all()
    assert np.bitwise_count(homes ^ values).max() == S.RADIUS


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    fps = [0, -1]
    for b in base.tolist():
        fps.append(b)
        for k in (1, 3, 4, 5):
            flip = sum(1 << int(x) for x in rng.choice(64, k, replace=False))
            fps.append(int(np.array([b], np.int64).view(np.uint64)[0]) ^ flip)
    fps = sorted({int(np.array([f & (2**64 - 1)], np.uint64).view(np.int64)[0]) for f in fps})
    bits = np.array(fps, np.int64).view(np.uint64)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if np.bitwise_count(bits[i] ^ bits[j]) <= 4]
    want = smallest(len(fps), pairs)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = [(r["a"], r["b"]) for r in S.links(nodes, 4).collect()]
    at = {f: i for i, f in enumerate(fps)}
    assert all(np.bitwise_count(bits[at[a]] ^ bits[at[b]]) <= 4 for a, b in links)
    assert smallest(len(fps), [(at[a], at[b]) for a, b in links]) == want


def test_crowded_anchor_is_split_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL", 3)
    fps = [0] + [1 << i for i in range(64)] + [(1 << 40) | (1 << 50) | (1 << 60) | (1 << 3) | (1 << 10) | (1 << 63) - (1 << 62)]
    fps = [int(np.array([f], np.uint64).view(np.int64)[0]) for f in fps]
    links = S.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert len({roots.get(f, f) for f in fps[:65]}) == 1


def test_near_copies_and_kept_rows(spark):
    rng = random.Random(8)
    long = " ".join(words(rng, 600, 5000))
    rows = [(9, long), (4, long), (7, long + " tail"), (2, None), (3, ""), (11, " ".join(words(rng, 50))), (None, long), (9, long)]
    got = {(r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs(spark, rows)).collect()}
    assert got == {(9, 4), (4, 4), (7, 4), (2, 2), (3, 2), (11, 11), (None, 4)}
    kept = S.keep_first(docs(spark, rows))
    assert sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)) == [2, 4, 11]
    assert kept.columns == docs(spark, rows).columns
    assert S.near_duplicates(docs(spark, [])).count() == 0


def test_only_the_first_copy_of_a_passage_stays(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join(words(rng, 9, 9000)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(6))
    own = [[sentence() for _ in range(4)] for _ in range(5)]
    rows = [(i, " ".join(o[:2]) + " " + passage.replace(" ", "  ") + "\n" + " ".join(o[2:])) for i, o in enumerate(own)]
    rows += [(20, passage + "\n" + passage), (21, "Yes. No. Yes."), (22, "Yes. No. Yes."), (23, None), (24, ""), (0, rows[0][1]), (None, own[0][3] + " x.")]
    got = {}
    for r in P.dedup_spans(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [r["n_removed"] for r in got[0]] == [0, 0] and len(got[0]) == 2 and got[0][0]["text"] == rows[0][1]
    for i in range(1, 5):
        assert got[i][0]["n_removed"] == 6 and got[i][0]["text"].split() == " ".join(own[i]).split()
    assert got[20][0]["text"] == "" and got[20][0]["n_removed"] == 12
    assert got[21][0]["text"] == got[22][0]["text"] == "Yes. No. Yes." and got[23][0]["text"] is None and got[24][0]["n_sentences"] == 0
    assert P.dedup_spans(docs(spark, [])).count() == 0


def test_runs_are_the_shortest_that_are_long_enough():
    w = [["x"] * n for n in (10, 3, 4, 50, 1, 1)]
    assert list(P.runs(w, 16, 40)) == [(0, 3), (1, 4), (2, 4), (3, 4)]


def brute_vectors(rows, threshold=0.9):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold]
    up = {i: i for i, _ in rows}
    for _ in ids:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    n = {i: sum(i in p for p in pairs) for i, _ in rows}
    return {i: (n[i], up[i]) for i, _ in rows}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, at = [], 1000
    for size in (1, 1, 2, 5, 30, 90):  # the last one has more members than the window
        centre = rng.normal(size=8)
        for _ in range(size):
            rows.append((at, [float(np.float32(x)) for x in centre + rng.normal(size=8) * 0.02]))
            at -= 1
    rows += [(2000, rows[3][1]), (1, rows[3][1]), (3000, None), (3001, [0.0] * 8), (3002, [float("nan")] * 8), (3003, [None] * 8), (3004, [1.0] * 3), (3005, [])]
    # Other lengths are compared among themselves: equal, near and far ones.
    rows += [(3100, [1.0, 2.0, 3.0]), (3101, [1.0, 2.0, 3.0]), (3102, [1.0, 2.0, 3.5]), (3103, [-1.0, 0.0, 1.0]), (3104, [2.0]), (3105, [5.0]), (3106, [-1.0])]
    df = spark.createDataFrame([(i, v, "l", 1) for i, v in rows], "vec_id long, embedding array<float>, label string, rank int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.near_duplicates(df, window=16).collect()}
    assert got == brute_vectors(rows)
    kept = [r["vec_id"] for r in V.near_duplicates(df, window=16).where("kept").collect()]
    assert sorted(kept) == sorted({c for _, c in got.values()})
    assert V.near_duplicates(df.limit(0)).count() == 0
    alone = V.near_duplicates(df.where("vec_id >= 3000").withColumn("vec_id", F.lit(None).cast("long"))).collect()
    assert {(r["n_links"], r["component_id"], r["kept"]) for r in alone} == {(0, None, False)}


def in_a_window(n, pairs, passes, window=64, d=32, seed=3, mean_cosine=0.0, centre=True):
    """Share of the planted pairs at cosine 0.9, among n vectors of a mean cosine, that some pass has in one window."""
    rng = np.random.default_rng(seed)

    def within(x, base):
        """Unit vectors at right angles to the base ones."""
        x = x - (x * base).sum(axis=1, keepdims=True) * base
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    axis = np.eye(1, d)
    own = within(rng.normal(size=(n, d)), axis)
    near = (0.9 - mean_cosine) / (1 - mean_cosine)  # of what the axis does not account for
    side = rng.normal(size=(pairs, d))
    side -= side @ axis.T * axis
    own[pairs:2 * pairs] = near * own[:pairs] + np.sqrt(1 - near * near) * within(side, own[:pairs])
    x = np.sqrt(mean_cosine) * axis + np.sqrt(1 - mean_cosine) * own
    assert np.allclose((x[:pairs] * x[pairs:2 * pairs]).sum(axis=1), 0.9)
    mean, met = x.mean(axis=0) * centre, np.zeros(pairs, bool)
    for p in range(passes(float(x.mean(axis=0) @ x.mean(axis=0)))):
        rank = np.empty(n, np.int64)
        rank[np.argsort(V.sign_bits(x, mean, p), kind="stable")] = np.arange(n)
        met |= np.abs(rank[:pairs] - rank[pairs:2 * pairs]) <= window
    return met.mean()


@pytest.mark.parametrize("n, mean_cosine", [(20_000, 0.0), (20_000, 0.5), (20_000, 0.7), (100_000, 0.5), (100_000, 0.7)])
def test_planted_pairs_meet_whatever_the_mean_cosine(n, mean_cosine):
    assert in_a_window(n, 1000, lambda m: V.passes_for(n, mean_cosine=m), mean_cosine=mean_cosine) >= 0.98


def test_passes_grow_with_the_classes_and_keep_the_miss_rate():
    assert [V.passes_for(n) for n in (0, 64, 1000)] == [10, 10, 10]
    assert V.passes_for(10**5) < V.passes_for(10**6) < V.passes_for(10**7)
    assert in_a_window(100_000, 2000, lambda m: V.passes_for(100_000)) >= 0.98 > in_a_window(100_000, 2000, lambda m: 10)


def test_links_of_small_components_are_counted_exactly(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(60):
        centre = rng.normal(size=8)
        rows += [(len(rows) + k, [float(x) for x in centre + rng.normal(size=8) * 0.15]) for k in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = V.near_duplicates(df, window=8, passes=1).collect()  # one pass: components can be parts of the true ones
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    root = {r["vec_id"]: r["component_id"] for r in got}
    inside = {i: sum(root[j] == root[i] and j != i and x[i] @ x[j] >= 0.9 for j in root) for i in root}
    assert {r["vec_id"]: r["n_links"] for r in got} == inside


def test_every_sentence_of_a_passage_is_in_a_run_inside_it():
    rng = random.Random(6)
    cases = [[45, 10], [45, 5, 5], [8, 8, 5], [16, 1], [20]] + [[rng.randrange(1, 50) for _ in range(rng.randrange(2, 9))] for _ in range(300)]
    for sizes in cases:
        if sum(sizes) < 16:
            continue
        before, after = ([], []) if len(sizes) == 1 else ([3, 9], [2, 50])
        text = [["x"] * n for n in before + sizes + after]
        low, high = len(before), len(before) + len(sizes)
        inside = [(i, j) for i, j in P.all_runs(text, 16, 40) if low <= i and j <= high]
        assert {k for i, j in inside for k in range(i, j)} == set(range(low, high)), sizes


def test_tails_of_copies_go(spark):
    text = lambda *sizes: " ".join(" ".join(f"v{k}x{j}" for j in range(n)) + "." for k, n in enumerate(sizes))
    rows = [(3 * k + c, f"Own {k} {c}.\n" * (k < 3) + text(*sizes).replace("v", f"p{k}v")) for k, sizes in enumerate([(45, 10), (45, 5, 5), (8, 8, 5), (20,)]) for c in (0, 1)]
    got = {r["doc_id"]: r["n_removed"] for r in P.dedup_spans(docs(spark, rows)).collect()}
    assert got == {0: 0, 1: 2, 3: 0, 4: 3, 6: 0, 7: 3, 9: 0, 10: 1}
