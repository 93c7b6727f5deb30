"""Language-model scores: contract columns against brute force, chances that add up, gradients, and held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fitloom.llm import maxent as M
from fitloom.llm.common import table
from fitloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held(key):
    return key is None or zlib.crc32(str(key).encode()) % 10 == 0


def brute(rows):
    c = Counter(w for key, text in rows if not held(key) for w in words(text))
    n, v = c.total(), len(c)
    return [(key, held(key), len(words(text)), sum(c[w] > 0 for w in words(text)), n,
             sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(text)) if n else 0.0) for key, text in rows]


def compare(got, rows):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and g[6] <= 0 and math.isfinite(g[6]) for g, w in zip(got, want))
    return got


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = compare(QUERIES["op12_hashed_maxent"](spark, SF).collect(), rows)
    # Learned texts and held-out ones are both likelier than under the base model.
    for side in (False, True):
        assert sum(g[6] for g in got if g[1] == side) > sum(g[5] for g in got if g[1] == side)


@pytest.mark.parametrize("sent", [1 << 17, 3])
def test_odd_texts_and_words_that_are_joined(spark, monkeypatch, sent):
    monkeypatch.setattr(M, "SENT_WORDS", sent)
    texts = [None, "", " \t\n", "A a É é", "one\x0btwo\x0cthree \x1c x y", "word", "word", "rare " * 40, "x" * 100_000, "the the of the end " * 30,
             "\U0001f600 中文", "UPPER lower", " new words only here"]
    rows = [(i, t) for i, t in enumerate(texts * 2)] + [(None, "a null id"), (5, "word"), (5, None)]
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, c long, word binary")
    compare(M.score(docs).collect(), rows)


def test_no_rows_and_nothing_to_learn_from(spark):
    assert M.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    key = next(k for k in range(1000) if held(k))
    compare(M.score(spark.createDataFrame([(key, "a b"), (None, None)], "doc_id long, text string")).collect(), [(key, "a b"), (None, None)])


def test_chances_add_up_and_equal_a_plain_walk():
    rng = np.random.default_rng(4)
    model = M.Model(rng.normal(size=(M._NODES, M.WAYS)).astype(np.float32), rng.normal(size=(M.ROWS, M.WAYS)).astype(np.float32))
    text = rng.integers(0, M.LEAVES, 9)
    every = np.concatenate([np.append(text, leaf) for leaf in range(M.LEAVES)])
    starts = np.arange(M.LEAVES) * 10
    total = model.scores(every, starts)
    alone = model.scores(text, np.array([0]))
    assert abs((10 ** (total - alone)).sum() - 1) < 1e-3
    # Neighbouring texts in a slice, and short ones, do not change each other.
    assert np.allclose(model.scores(np.concatenate([text[:1], text, text[:2], text]), np.array([0, 1, 10, 12]))[[1, 3]], alone)
    assert np.allclose(model.scores(np.concatenate([text[:1], text]), np.array([0, 1]))[0], model.scores(text[:1], np.array([0])))


def test_training_raises_the_chance_of_what_it_sees():
    rng = np.random.default_rng(0)
    text = np.tile(rng.permutation(M.LEAVES)[:40], 200)
    flat = np.zeros((M._NODES, M.WAYS), np.float32)
    task = M.Trainer(flat, np.zeros((M.ROWS, M.WAYS), np.float32))
    before = task.scores(text, np.array([0]))[0]
    task.learn(text, np.array([0]))
    after = task.scores(text, np.array([0]))[0]
    assert after > before / 2 and before < after < 0
