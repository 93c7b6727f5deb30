"""Tokenizer alignment against whole texts encoded at once, and the fragment monoid on random cuts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from fitloom.llm import alignment as A
from fitloom.llm.common import table
from fitloom.llm.queries import QUERIES

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def groups_of(worker, text):
    """Groups of a whole text, both tokenizers run over all of it; None if it has no tokens."""
    if not text:
        return None
    raw = b" " + text.encode()
    a = worker.a.encode(" " + text, add_special_tokens=False).ids
    b = worker.b.encode(text)
    own, other = [worker.a_bytes[i] for i in a], [worker.b_bytes[i] for i in b]
    if b"".join(own) != raw or b"".join(other) != raw:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in own]).tolist(), np.cumsum([len(x) for x in other]).tolist()
    groups, lo_a, lo_b = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        hi_a, hi_b = ends_a.index(cut, lo_a) + 1, ends_b.index(cut, lo_b) + 1
        groups.append((a[lo_a:hi_a], b[lo_b:hi_b]))
        lo_a, lo_b = hi_a, hi_b
    return groups


def expected(texts):
    worker = A.tokenizers(*PATHS)
    every = [groups_of(worker, t) for t in texts]
    linked = [Counter((x, y) for a, b in g or [] for x in a for y in b) for g in every]
    df = Counter(p for c in linked for p in c)
    high = {}
    for (x, _), n in df.items():
        high[x] = max(high.get(x, 0), n)
    out = []
    for g, links in zip(every, linked):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        out.append((sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), links.total(),
                    sum(k for p, k in links.items() if df[p] == high[p[0]]), sum(k * df[p] for p, k in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def test_query_equals_whole_texts(spark):
    rows = table(spark, "/root/testdata/sf0.001", "documents").collect()
    want = {r["doc_id"]: w for r, w in zip(rows, expected([r["text"] for r in rows]))}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_fragment_monoid"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want


TEXTS = [None, "", " ", "  ", "a", " a  b ", "two words", "two words", "tabs\tand\n\nlines \n end", "café naïve 中文 \U0001f600\U0001f468‍\U0001f469‍\U0001f467",
         "a mark ▁ here", "▁", "nul \x00 and \x1c x", "<|endoftext|> <s> </s> <unk> <0x41>", "it's we'll 12345 !!! ...", " x　y z",
         "x" * 3000 + " " + "y " * 500, "nón ﬁ Å 가 ﻿bom", "\r\n\r\n", "end "]


@pytest.mark.parametrize("part_chars, hot_pairs", [(200_000, 1 << 20), (7, 4), (40, 0)])
def test_odd_texts_in_parts_and_with_cold_pairs(spark, part_chars, hot_pairs):
    rows = [(i, t, 3, "x") for i, t in enumerate(TEXTS)] + [(None, "a null id", 1, "y"), (6, "two words", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a long, groups string")
    got = sorted(str((r["doc_id"], *(r[c] for c in COLUMNS))) for r in A.align(docs, *PATHS, part_chars=part_chars, hot_pairs=hot_pairs).collect())
    assert got == sorted(str((r[0], *w)) for r, w in zip(rows, expected([r[1] for r in rows])))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.align(docs, *PATHS).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=12), st.integers(0, 1 << 30))
def test_fragments_compose_in_any_order(sizes_a, sizes_b, seed):
    rng = random.Random(seed)
    gap = sum(sizes_a) - sum(sizes_b)
    (sizes_b if gap > 0 else sizes_a).extend([abs(gap)] * (gap != 0))
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    ids_a, ids_b = [rng.randrange(5) for _ in sizes_a], [rng.randrange(5) for _ in sizes_b]
    total = int(ends_a[-1])
    whole = A.closed(A.fragment(ids_a, ends_a, ids_b, ends_b, 0, total))
    cuts = sorted({0, total, *(rng.randrange(total + 1) for _ in range(4))})
    some = [A.fragment(ids_a, ends_a, ids_b, ends_b, lo, hi) for lo, hi in zip(cuts, cuts[1:])]
    while len(some) > 1:
        i = rng.randrange(len(some) - 1)
        some[i:i + 2] = [A.compose(some[i], some[i + 1])]
    assert A.closed(some[0]) == whole
    assert (whole.n_a, whole.n_b) == (len(ids_a), len(ids_b)) and whole.pairs.total() == whole.n_links
