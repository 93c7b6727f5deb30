"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

The outcomes are leaves of a tree of LEVELS levels with WAYS branches each: class, subclass, word. The commonest words and the
end of a text have leaves of their own; all other words share ENDINGS leaves by their last letters, and the chance of a
word inside such a leaf is its share of the training tokens there, 0.1 being added to every count and kept for unseen
words, so the chances of all words add up to one. At each node the branch is a softmax over its bias and the weights of the
context's n-gram and skip features (the word before, the one before that alone, both), hashed with the node into ROWS rows
of weights. Biases are the exact logarithms of training counts, so an untrained
model is the unigram model.

Training is one pass over all training texts: every task starts from the weights it is sent, goes through its rows in
minibatches with AdaGrad steps, and sends what each row of weights moved by and how often it was met; the moves
are averaged by these numbers, block by block. Tasks take about TASK_TOKENS tokens, so what they send grows with the
input, and the weights themselves stay ROWS x WAYS numbers. Texts are encoded once, to leaves, for training and scoring.

A null text is an empty one, whose only token is its end. A null id is held out. Repeated rows are scored each and count
each. Words of any length are whole. Without training texts every word is unseen. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import stored

WAYS, LEVELS = 16, 3
LEAVES = WAYS ** LEVELS
#: Leaves that words without one of their own share, and rows of weights.
ENDINGS, ROWS = 512, 1 << 17
#: Words whose counts every task is sent; other words meet their counts in a join.
SENT_WORDS = 1 << 17
#: Tokens of a training task, of a minibatch, the step, and rows of weights in a block.
TASK_TOKENS, BATCH, STEP, BLOCK = 2_000_000, 1024, 0.15, 1024
COUNTED = 300_000
END = b""
_START = LEAVES
#: A row of weights and a place in a minibatch share 32 bits.
_PLACE_BITS = (LEVELS * BATCH).bit_length()
assert ROWS << _PLACE_BITS <= 1 << 32
_NODES = sum(WAYS ** k for k in range(LEVELS))


def train_fold(doc_id: Column) -> Column:
    """Whether texts of this id may be learned from: crc32 of the id as text, modulo 10, is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 != 0, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, in UTF-8, and the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def counts_of(documents: DataFrame, text_col: str) -> DataFrame:
    """(word, c) of all tokens; tasks add up before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for text in b.column(0):
                n.update(tokens(text.as_py()))
                if len(n) >= COUNTED:
                    yield out()
                    n.clear()
        if n:
            yield out()

    return documents.select(text_col).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def ending(word: bytes) -> int:
    """The shared leaf of a word, by its last three bytes."""
    return LEAVES - ENDINGS + zlib.crc32(word[-3:]) % ENDINGS


def ending_column(word: Column) -> Column:
    """ending() as a column."""
    return F.crc32(F.substring(word, -3, 3)) % ENDINGS + (LEAVES - ENDINGS)


class Lexicon:
    """Leaves, counts and in-leaf chances of the words that tasks are sent, and the totals of all."""

    def __init__(self, words: list[tuple[bytes, int]], total: int, distinct: int, masses: np.ndarray):
        own = LEAVES - ENDINGS
        self.total, self.distinct = total, distinct
        #: masses: counts plus 0.1 for each word of a shared leaf, and 0.1 for its unseen words.
        self.masses = masses
        self.places = {w: k for k, (w, _) in enumerate(words)}
        #: Leaf, base chance and chance inside the leaf of each place; the last place is that of words not sent.
        self.leaves = np.array([k if k < own else ending(w) for k, (w, _) in enumerate(words)] + [0], np.int16)
        self.bases = np.array([self.base_log(c) for _, c in words] + [0.0])
        self.insides = np.array([0.0 if k < own else math.log10((c + 0.1) / masses[leaf]) for k, ((_, c), leaf) in enumerate(zip(words, self.leaves))] + [0.0])

    def base_log(self, c: int) -> float:
        return math.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def biases(self) -> np.ndarray:
        """Logarithms of the masses below each branch of each node."""
        out, below = [], self.masses
        for _ in range(LEVELS):
            branches = below.reshape(-1, WAYS)
            below = branches.sum(1)
            out.append(np.log(branches / below[:, None]))
        return np.concatenate(out[::-1]).astype(np.float32)


def lexicon(counts: DataFrame) -> Lexicon:
    """The lexicon of all training counts: whole bands of an eighth octave of the commonest words, at most SENT_WORDS."""
    band = F.floor(F.log2("c") * 8).cast("int")
    bands = sorted(((r["band"], r["words"], r["c"]) for r in counts.groupBy(band.alias("band")).agg(F.count("*").alias("words"), F.sum("c").alias("c")).collect()), reverse=True)
    least, n = 1 << 30, 0
    for k, words, _ in bands:
        n += words
        if n > SENT_WORDS:
            break
        least = k
    words = sorted(((bytes(r["word"]), r["c"]) for r in counts.where(band >= least).collect()), key=lambda r: (-r[1], r[0]))
    # The end of a text always has a leaf of its own.
    words.sort(key=lambda r: r[0] != END)
    own = words[:LEAVES - ENDINGS]
    total, distinct = sum(c for *_, c in bands), sum(w for _, w, _ in bands)
    masses = np.full(LEAVES, 0.1)
    for k, (_, c) in enumerate(own):
        masses[k] += c
    shared = counts.groupBy(ending_column(F.col("word")).cast("int").alias("leaf")).agg(F.sum(F.col("c") + F.lit(0.1).cast("double")).alias("mass")).collect()
    for r in shared:
        masses[r["leaf"]] += r["mass"]
    for w, c in own:
        masses[ending(w)] -= c + 0.1
    return Lexicon(words, total, distinct, np.maximum(masses, 0.1))


_ENCODED = "_u long, doc_id long, learn boolean, n_tokens long, n_known long, base double, inside double, leaves binary, rare array<binary>, times array<int>"


def encoded(documents: DataFrame, lex: Lexicon, id_col: str, text_col: str) -> DataFrame:
    """Per row the leaves of its tokens, what the sent words give to its sums, and the other words."""
    shared = documents.sparkSession.sparkContext.broadcast(lex)
    names = [c.split(" ")[0] for c in _ENCODED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        place = lex.places.get
        other = len(lex.places)
        for b in batches:
            rows, size = [], 0
            for u, key, learn, text in zip(*b.columns):
                own = tokens(text.as_py())
                at = np.fromiter(map(place, own, repeat(other)), np.int64, len(own))
                leaves, unknown = lex.leaves[at], np.flatnonzero(at == other)
                rare = Counter([own[i] for i in unknown.tolist()])
                if rare:
                    leaves[unknown] = [ending(own[i]) for i in unknown.tolist()]
                rows.append((u.as_py(), key.as_py(), learn.as_py(), len(own), len(own) - len(unknown), float(lex.bases[at].sum()), float(lex.insides[at].sum()),
                             leaves.tobytes(), list(rare), list(rare.values())))
                size += len(own)
                if size > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return documents.select(F.monotonically_increasing_id().alias("_u"), F.col(id_col).cast("long"), train_fold(F.col(id_col)).alias("learn"), text_col).mapInArrow(encode, _ENCODED)


def contexts(leaves: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A key per feature and token; no feature reaches back over the start of its text."""
    one, two = (np.concatenate([np.full(k, _START, np.int64), leaves[:len(leaves) - k]])[:len(leaves)] for k in (1, 2))
    one[starts] = two[starts] = _START
    second = starts + 1
    two[second[second < len(leaves)]] = _START  # in a text of one token this is the next one's start
    pair = LEAVES + 1
    keys = np.stack([one, pair + two, 2 * pair + two * pair + one]).astype(np.uint64)
    return keys * np.uint64(0x9E3779B97F4A7C15)


class Model:
    """Weights and biases; the forward pass over a slice of tokens."""

    def __init__(self, biases: np.ndarray, weights: np.ndarray):
        self.biases, self.weights = biases, weights

    @staticmethod
    def tree(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes passed and branches taken, one row per level."""
        nodes, digits, first = [], [], 0
        for level in range(LEVELS):
            above = leaves // WAYS ** (LEVELS - level)
            nodes.append(first + above)
            digits.append(leaves // WAYS ** (LEVELS - level - 1) % WAYS)
            first += WAYS ** level
        return np.stack(nodes), np.stack(digits)

    def forward(self, keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of weights (features x levels x tokens) and the branches' exponentials, not yet divided by their sum (levels x tokens x WAYS)."""
        h = keys[:, None, :] ^ (nodes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        rows = ((h >> np.uint64(32)) & np.uint64(ROWS - 1)).astype(np.int64)
        z = self.biases.take(nodes, axis=0)
        for f in range(len(rows)):
            z += self.weights.take(rows[f], axis=0)
        # Biases are logarithms of chances, so sums stay small; the bounds only keep the exponentials finite and above zero.
        np.clip(z, -80, 80, out=z)
        return rows, np.exp(z, out=z)

    def scores(self, leaves: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 chance of each text of a slice."""
        keys, total = contexts(leaves, starts), np.empty(len(leaves))
        for lo in range(0, len(leaves), BATCH):
            nodes, digits = self.tree(leaves[lo:lo + BATCH])
            _, e = self.forward(keys[:, lo:lo + BATCH], nodes)
            flat = e.reshape(-1, WAYS)
            taken = flat[np.arange(len(flat)), digits.ravel()] / flat.sum(1)
            total[lo:lo + BATCH] = np.log10(taken.astype(np.float64)).reshape(LEVELS, -1).sum(0)
        return np.add.reduceat(total, starts) if len(starts) else np.empty(0)


class Trainer(Model):
    """A task's own copy of the weights, its AdaGrad sums, and how often each row was met."""

    def __init__(self, biases: np.ndarray, weights: np.ndarray):
        super().__init__(biases, weights.copy())
        self.begin, self.squares, self.met = weights, np.full(len(weights), 1e-2, np.float32), np.zeros(len(weights), np.float32)

    def learn(self, leaves: np.ndarray, starts: np.ndarray) -> None:
        keys = contexts(leaves, starts)
        for lo in range(0, len(leaves), BATCH):
            nodes, digits = self.tree(leaves[lo:lo + BATCH])
            rows, e = self.forward(keys[:, lo:lo + BATCH], nodes)
            g = e.reshape(-1, WAYS)
            g /= g.sum(1, keepdims=True)
            places = np.arange(len(g))
            g[places, digits.ravel()] -= 1
            # Row and place in one number: a plain sort is quicker than an indirect one.
            packed = ((rows.reshape(len(rows), -1) << _PLACE_BITS) | places).ravel().astype(np.uint32)
            packed.sort()
            ordered, order = packed >> _PLACE_BITS, packed & ((1 << _PLACE_BITS) - 1)
            heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            at = ordered[heads]
            met = np.diff(np.append(heads, len(ordered)))
            # Most rows are met once; only the others need a sum.
            step, often = g.take(order.take(heads), axis=0), met > 1
            if often.any():
                runs = met[often]
                step[often] = np.add.reduceat(g.take(order[np.repeat(often, met)], axis=0), np.cumsum(runs) - runs, axis=0)
            squares = self.squares.take(at) + np.einsum("ij,ij->i", step, step) / WAYS
            self.squares[at] = squares
            step *= (STEP / np.sqrt(squares))[:, None]
            self.weights[at] = self.weights.take(at, axis=0) - step
            self.met[at] += met


def slices(batches: Iterator[pa.RecordBatch], at: int, most: int = 300_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about so many tokens at most, one at least: the rows, all leaves, and where each text starts."""
    for b in batches:
        lo = 0
        while lo < b.num_rows:
            parts, size, hi = [], 0, lo
            while hi < b.num_rows and (hi == lo or size < most):
                parts.append(np.frombuffer(b.column(at)[hi].as_py(), np.int16))
                size += len(parts[-1])
                hi += 1
            yield b.slice(lo, hi - lo), np.concatenate(parts).astype(np.int64), np.cumsum([0, *map(len, parts[:-1])])
            lo = hi


def trained(rows: DataFrame, biases: np.ndarray, weights: np.ndarray, n_tokens: int) -> np.ndarray:
    """Weights after one pass over the rows' leaves; every task's moves are averaged by how often it met each row."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((biases, weights))
    schema = "block int, salt int, move binary, met binary"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Trainer(*sent.value)
        for _, leaves, starts in slices(batches, 0):
            task.learn(leaves, starts)
        salt = int(task.met.sum()) % 64
        for k in range(0, len(task.met), BLOCK):
            met = task.met[k:k + BLOCK]
            if met.any():
                move = (task.weights[k:k + BLOCK] - task.begin[k:k + BLOCK]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([salt], pa.int32()), pa.array([move.tobytes()]), pa.array([met.tobytes()])],
                                                 ["block", "salt", "move", "met"])

    def mix(t: pa.Table) -> pa.Table:
        total, met = 0.0, 0.0
        for move, n in zip(t["move"], t["met"]):
            n = np.frombuffer(n.as_py(), np.float32)
            total = total + np.frombuffer(move.as_py(), np.float16).reshape(-1, WAYS).astype(np.float64) * n[:, None]
            met = met + n.astype(np.float64)
        move = (total / np.maximum(met, 1)[:, None]).astype(np.float16)
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "move": [move.tobytes()], "met": [met.astype(np.float32).tobytes()]})

    tasks = max(1, math.ceil(n_tokens / TASK_TOKENS))
    moves = rows.select("leaves").coalesce(tasks).mapInArrow(learn, schema)
    mixed = moves.groupBy("block", "salt").applyInArrow(mix, schema).groupBy("block").applyInArrow(mix, schema)
    out = weights.copy()
    for r in mixed.collect():
        lo = r["block"] * BLOCK
        out[lo:lo + BLOCK] += np.frombuffer(r["move"], np.float16).reshape(-1, WAYS)[:len(out) - lo]
    return out


def score(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    counts = stored(counts_of(documents.where(train_fold(F.col(id_col))), text_col))
    lex = lexicon(counts)
    rows = stored(encoded(documents, lex, id_col, text_col))
    biases = lex.biases()
    weights = trained(rows.where("learn"), biases, np.zeros((ROWS, WAYS), np.float32), lex.total) if lex.total else np.zeros((ROWS, WAYS), np.float32)
    # Words that were not sent: their counts are joined once per text and word.
    unseen = lex.base_log(0) if lex.total else 0.0
    masses = lex.masses.tolist()
    mass = F.array(*[F.lit(float(m)) for m in masses[LEAVES - ENDINGS:]])
    rare = (
        rows.where(F.size("rare") > 0).select("_u", F.explode(F.arrays_zip("rare", "times")).alias("r"))
        .select("_u", F.col("r.rare").alias("word"), F.col("r.times").alias("k")).join(counts, "word", "left")
        .select("_u", "k", F.coalesce("c", F.lit(0).cast("long")).alias("c"), F.element_at(mass, (ending_column(F.col("word")) - (LEAVES - ENDINGS) + 1).cast("int")).alias("mass"))
        .groupBy("_u").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more_known"),
                           F.sum(F.col("k") * F.log10((F.col("c") + 0.1) / (lex.total + 0.1 * (lex.distinct + 1)))).alias("more_base"),
                           F.sum(F.col("k") * F.log10(F.when(F.col("c") > 0, F.col("c") + 0.1).otherwise(0.1) / F.col("mass"))).alias("more_inside"))
    )
    sent = spark.sparkContext.broadcast((biases, weights))
    schema = "_u long, doc_id long, learn boolean, n_tokens long, n_known long, base double, inside double, model double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for b, leaves, starts in slices(batches, 7):
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(7)), pa.array(model.scores(leaves, starts), pa.float64())], [c.split(" ")[0] for c in schema.split(", ")])

    scored = rows.select("_u", "doc_id", "learn", "n_tokens", "n_known", "base", "inside", "leaves").mapInArrow(run, schema)
    plus = lambda name, more: F.col(name) + F.coalesce(F.col(more), F.lit(0))
    return scored.join(rare, "_u", "left").select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"),
        (F.col("model") + plus("inside", "more_inside")).alias("score"))
