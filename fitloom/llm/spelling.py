"""Spelling variant grouping: words at one edit from each other, found by walking a distributed trie.

The trie is a table of edges (node, rest, label, child): a node stands for a prefix, rest is how many code points its word
still has, so words of different lengths never meet. A state is (word, position, node, edits). Every word has its
zero-edit states on its own path. Each of them branches once: it replaces the next code point by joining the other
edges of its node, or deletes it by going on at the node itself. The one-edit states then walk level by level, a join
with the edge table each, and those that reach the end of a word are its neighbours. An insertion is the
deletion seen from the other word.

Only edits in the second half of a word need to branch in the trie of words, those in the first half do in the trie of
the words read backwards; so all states begin below a path that half a word fixes, where few words are left. States never
outnumber words times lengths times the alphabet. The last LEVELS code points are walked one a level; before that an edge
spans a power of two of them, so a word of a million letters takes about LEVELS + 20 levels. Nodes and long labels are 61-bit
hashes; what they find is checked on the words themselves.

Null texts have no words, and a null id counts as an empty one in the hash. Repeated rows count each time. Words of any
length are handled; of an empty table there are none. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import stored

#: Code points at a word's end that are walked one a level.
LEVELS = 16
#: Words that a task counts before it passes them on.
COUNTED = 300_000
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_RUN = re.compile(rb"[A-Za-z\xc0-\xff]+").findall


def counted_words(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5,
                  drop_every: int = 199) -> DataFrame:
    """(word, n): runs of Latin letters, A-Z lower-cased, of least_length code points and least_n occurrences.

    Of a run whose crc32 of <id>:<run> drop_every divides, the code point at that crc32 modulo its length is left out.
    Tasks add up before the shuffle.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                # One byte is one code point here; others than Latin-1 end a run just as "?" does.
                own: dict[bytes, int] = {}
                for run in _RUN(text.encode("latin-1", "replace").lower()):
                    if len(run) >= least_length:
                        own[run] = own.get(run, 0) + 1
                for run, k in own.items():
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % drop_every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < least_length:
                            continue
                    n[run] = n.get(run, 0) + k
                if len(n) >= COUNTED:
                    yield out()
                    n.clear()
        if n:
            yield out()

    parts = documents.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def stride(rest: int) -> int:
    """How many code points an edge spans for a word that still has rest of them."""
    return 1 if rest <= LEVELS else 1 << (rest - LEVELS).bit_length() - 1


def path(word: str, start: int, first: int) -> Iterator[tuple]:
    """A word's own path from position first on: position, node, rest, letter and child, the long edge there, labels behind.

    start tells tries apart. The long edge is (label, child) where a walk would take one, else nulls. The labels are
    those of the edges that an unedited walk takes from the next position on.
    """
    n = len(word)
    h = [start]
    for c in word:
        h.append((h[-1] * _BASE + ord(c)) % _PRIME)
    powers: dict[int, int] = {}

    def label(at: int) -> int:
        span = stride(n - at)
        if span == 1:
            return ord(word[at])
        if span not in powers:
            powers[span] = pow(_BASE, span, _PRIME)
        return (h[at + span] - h[at] * powers[span]) % _PRIME

    for at in range(first, n):
        labels, p = [], at + 1
        while p < n:
            labels.append(label(p))
            p += stride(n - p)
        long = n - at > LEVELS
        yield at, h[at], n - at, ord(word[at]), h[at + 1], label(at) if long else None, h[at + stride(n - at)] if long else None, labels


_PATH = "w long, at long, node long, rest long, letter long, child long, jump long, landing long, labels array<long>"


def paths(words: DataFrame) -> DataFrame:
    """The zero-edit states of words (w, word) where they may branch: forwards from the middle on, backwards before it."""
    names = [c.split(" ")[0] for c in _PATH.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for b in batches:
            for w, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for start, text, first in ((1, word, len(word) // 2), (2, word[::-1], min((len(word) + 1) // 2, len(word) - 1))):
                    for row in path(text, start, first):
                        rows.append((w, *row))
                        if len(rows) >= 20_000:
                            yield batch()
                            rows = []
        if rows:
            yield batch()

    return words.select("w", "word").mapInArrow(walk, _PATH).sortWithinPartitions("rest")


def found(spine: DataFrame) -> DataFrame:
    """(w, v): words whose paths the one-edit states of w end on; hashes may let a few others in."""
    edges = spine.groupBy("node", "rest", F.col("letter").alias("label")).agg(F.first("child").alias("child"))
    # Which labels go on at a node, as bits: most branches have no edge to follow and are not made at all.
    bit = F.expr("shiftleft(1L, cast(label % 63 AS int))")
    walk = stored(
        edges.where(F.col("rest") <= LEVELS)
        .unionByName(spine.where(F.col("rest") > LEVELS).groupBy("node", "rest", F.col("jump").alias("label")).agg(F.first("landing").alias("child")))
        .sortWithinPartitions("rest"))
    goes_on = walk.groupBy(F.col("node").alias("child"), (F.col("rest") + 1).alias("rest")).agg(F.bit_or(bit).alias("bits"))
    branch = edges.join(goes_on, ["child", "rest"], "left").select("node", "rest", "label", F.col("child").alias("other"), "bits")
    next_bit = F.expr("shiftright(bits, cast(labels[0] % 63 AS int)) & 1L")
    replaced = stored(
        spine.join(branch, ["node", "rest"]).where((F.col("label") != F.col("letter")) & ((F.size("labels") == 0) | (next_bit == 1)))
        .select("w", F.col("other").alias("node"), (F.col("rest") - 1).alias("rest"), "labels").sortWithinPartitions("rest"))
    # Of equal code points in a row only the last is deleted.
    deleted = spine.where((F.col("rest") > LEVELS + 1) | (F.size("labels") == 0) | (F.col("labels")[0] != F.col("letter"))).select(
        "w", "node", (F.col("rest") - 1).alias("rest"), "labels")
    fresh = replaced.unionByName(deleted)

    def level(states: DataFrame, edges: DataFrame) -> DataFrame:
        """States one edge further."""
        rest = F.col("rest")
        span = F.when(rest <= LEVELS, 1).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(rest - LEVELS, F.lit(1)) + 0.5))).cast("long"))
        return stored(states.withColumn("label", F.col("labels")[0]).join(edges, ["node", "rest", "label"]).select(
            "w", F.col("child").alias("node"), (rest - span).alias("rest"), F.slice("labels", 2, 1 << 30).alias("labels")))

    arrived = None
    deep = fresh.where(F.col("rest") > LEVELS)
    far = F.col("rest") > LEVELS
    while deep.limit(1).count():  # halves what is left of a word, so ends after about twenty levels
        moved = level(deep, walk.where(far))
        near = moved.where(~far)
        arrived = near if arrived is None else arrived.unionByName(near)
        deep = moved.where(far)
    deepest = walk.where(~far).agg(F.max("rest")).first()[0] or 0
    on_the_way = fresh.where(~far) if arrived is None else fresh.where(~far).unionByName(arrived)
    moved = None
    for rest in range(deepest, 0, -1):
        here = on_the_way.where(F.col("rest") == rest)
        moved = level(here if moved is None else here.unionByName(moved), walk.where(F.col("rest") == rest))
    last = on_the_way.where("rest = 0")
    last = last if moved is None else last.unionByName(moved)
    # Where a word ends: the node that its last code point leads to.
    ends = spine.where("rest = 1").select(F.col("child").alias("node"), F.col("w").alias("v"))
    return last.select("w", "node").join(ends, "node").select("w", "v")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near) of the distinct words in column word that differ by exactly one code point inserted, deleted or replaced; both ways.

    Null and empty words have none.
    """
    numbered = stored(words.select("word").where(F.length("word") > 0).withColumn("w", F.monotonically_increasing_id()))
    pairs = found(stored(paths(numbered)))
    both = stored(pairs.unionByName(pairs.select(F.col("v").alias("w"), F.col("w").alias("v"))).where("w != v").distinct())
    return (
        both.join(numbered, "w").join(numbered.select(F.col("w").alias("v"), F.col("word").alias("near")), "v")
        .where(F.levenshtein("word", "near", 1) == 1).select("word", "near")
    )


def group_variants(documents: DataFrame, times: int = 5, id_col: str = "doc_id", text_col: str = "text", **words_of) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    The form is the near word of largest n (ties: the smallest in code-point order) if it is times as frequent at least;
    the root is where following forms ends. Along forms n grows times-fold, so doubling the step ends after a few rounds.
    """
    words = stored(counted_words(documents, id_col, text_col, **words_of))
    near = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    is_form = -F.col("best.less") >= times * F.col("n")
    formed = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    up = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            break
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
