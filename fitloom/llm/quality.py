"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a sparse ternary index vector drawn from its hash. A word's vector is its own index
vector plus the sum of those of its neighbours in the training texts. A document is the mean vector of
its words, of the shapes of its words (capitals, digits, kinds of marks) and of a mark for long words that
come again. The network has one hidden layer; its probabilities are calibrated by a temperature on
training rows that the fit did not see.

The classifier is fitted on a bounded sample of labelled rows, sample_per_class texts of each label,
chosen by a hash of their ids and weighted back to the labels' frequencies. Scores use whole texts and
nothing else. Null texts are empty ones; an empty text is scored from the zero vector. Labels that are
null or without a document are left out; of several labels of a document the highest counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM, HIDDEN, NEIGHBOURS, VOCABULARY = 64, 24, 2, 20_000
_TOKEN = re.compile(r"\w+|[^\w\s]+").findall
AGAIN = "<again>"


def index_vector(word: str) -> np.ndarray:
    """Eight places of +1 or -1, from the word's hash."""
    rng = np.random.default_rng(zlib.crc32(word.encode("utf-8", "surrogatepass")))
    out = np.zeros(DIM, np.float32)
    out[rng.permutation(DIM)[:8]] = rng.choice(np.array([-1, 1], np.float32), 8)
    return out


def shape(token: str) -> str:
    """What kind of word it is, as a word of its own."""
    if token.isalpha():
        return "<low>" if token.islower() else "<cap>" if token[1:].islower() else "<upper>" if len(token) > 1 else "<letter>"
    if token.isdigit():
        return "<digits>"
    if token.isalnum() or "_" in token:
        return "<mixed>"
    return f"<mark {token[0]} {min(len(token), 3)}>"


class Vectors:
    """Word and shape vectors, and the pooled vector of a text."""

    def __init__(self, words: dict[str, int], matrix: np.ndarray):
        self.words, self.matrix, self.shapes = words, matrix, {}

    def shape_vector(self, name: str) -> np.ndarray:
        if name not in self.shapes:
            if len(self.shapes) > 50_000:
                self.shapes.clear()
            self.shapes[name] = index_vector(name)
        return self.shapes[name]

    def pool(self, text: str | None) -> np.ndarray:
        counts = Counter(_TOKEN(text or ""))
        n = counts.total()
        if not n:
            return np.zeros(2 * DIM)
        rows, weights, kinds, again = [], [], Counter(), 0
        for token, k in counts.items():
            at = self.words.get(token.lower())
            if at is not None:
                rows.append(at)
                weights.append(k)
            kinds[shape(token)] += k
            if len(token) > 7:
                again += k - 1
        kinds[AGAIN] = again
        words = np.array(weights, np.float64) @ self.matrix[rows] if rows else np.zeros(DIM)
        shapes = sum((k * self.shape_vector(s).astype(np.float64) for s, k in sorted(kinds.items())), np.zeros(DIM))
        return np.concatenate([words, shapes]) / n


def learn_vectors(texts: list[str]) -> Vectors:
    """Random indexing over the sample's words; the VOCABULARY most frequent get vectors."""
    counts: Counter = Counter()
    for x in texts:
        counts.update(t.lower() for t in _TOKEN(x or ""))
    words = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY])}
    index = np.array([index_vector(w) for w in words], np.float32).reshape(len(words), DIM)
    gap = np.full(NEIGHBOURS, -1, np.int32)
    lines = [np.fromiter((words.get(t.lower(), -1) for t in _TOKEN(x or "")), np.int32) for x in texts]
    flat = np.concatenate([gap, *(part for line in lines for part in (line, gap))]).astype(np.int64)
    context = np.zeros((len(words), DIM), np.float64)
    for off in range(1, NEIGHBOURS + 1):
        left, right = flat[:-off], flat[off:]
        ok = (left >= 0) & (right >= 0)
        joint, k = np.unique(left[ok] * max(len(words), 1) + right[ok], return_counts=True)
        left, right = joint // max(len(words), 1), joint % max(len(words), 1)
        for x, y in ((left, right), (right, left)):
            order = np.argsort(x, kind="stable")
            for lo in range(0, len(order), 20_000):  # a bounded block of neighbours at a time
                part = order[lo:lo + 20_000]
                heads = np.flatnonzero(np.append(True, x[part][1:] != x[part][:-1]))
                context[x[part][heads]] += np.add.reduceat(index[y[part]] * k[part, None], heads, axis=0)
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return Vectors(words, (context / np.maximum(length, 1e-9)).astype(np.float32) + index / np.sqrt(8).astype(np.float32))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Network:
    """Standardised inputs, one hidden layer of tanh units, one output divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, epochs: int = 150, seed: int = 7):
        rng = np.random.default_rng(seed)
        held = np.arange(len(x)) % 5 == 4
        fit = ~held
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-6
        z = (x - self.mean) / self.scale
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        rows = np.flatnonzero(fit)
        for _ in range(epochs):
            rng.shuffle(rows)
            for lo in range(0, len(rows), 128):
                r = rows[lo:lo + 128]
                h = np.tanh(z[r] @ self.p[0] + self.p[1])
                g = (sigmoid(h @ self.p[2] + self.p[3]) - y[r]) * w[r] / len(r)
                gh = np.outer(g, self.p[2]) * (1 - h * h)
                grads = [z[r].T @ gh + 1e-3 * self.p[0], gh.sum(0), h.T @ g + 1e-3 * self.p[2], g.sum(keepdims=True)]
                step += 1
                for i, gr in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * gr
                    v[i] = 0.999 * v[i] + 0.001 * gr * gr
                    self.p[i] = self.p[i] - 0.003 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
        self.temperature = 1.0
        if held.any():
            out = self.logits(x[held])
            loss = lambda t: float((w[held] * np.logaddexp(0, np.where(y[held] > 0, -out, out) / t)).sum())
            self.temperature = min(np.geomspace(0.5, 8, 60), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def train_fold(doc_id) -> "F.Column":
    """Whether labels of this id may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def fit(documents: DataFrame, labels: DataFrame, sample_per_class: int = 2000) -> tuple[Vectors, Network | None]:
    """Vectors and network from the bounded sample; no network if a class is missing."""
    known = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(train_fold(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .join(documents.select("doc_id"), "doc_id", "left_semi")
    )
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    pick = lambda q: known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_class)
    rows = (
        documents.select("doc_id", "text").join(F.broadcast(pick(0).unionByName(pick(1))), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality")).collect()
    )
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    vectors = learn_vectors([r["text"] for r in rows])
    y = np.array([r["quality"] for r in rows], np.float64)
    if len(set(y)) < 2:
        return vectors, None
    share = np.array([shares[0], shares[1]]) / sum(shares.values())
    w = np.where(y > 0, share[1] / (y > 0).mean(), share[0] / (y == 0).mean())
    return vectors, Network(np.array([vectors.pool(r["text"]) for r in rows]), y, w)


def scores(documents: DataFrame, labels: DataFrame, sample_per_class: int = 2000) -> DataFrame:
    """documents with score (0 to 1, higher: label 1 likelier) added; without two classes to learn from every score is 1."""
    vectors, network = fit(documents, labels, sample_per_class)
    model = documents.sparkSession.sparkContext.broadcast((vectors, network))
    base = documents.drop("score")
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())])
    at = base.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = model.value
        for b in batches:
            if not b.num_rows:
                continue
            x = [vectors.pool(t.as_py()) for t in b.column(at)]
            score = network.score(np.array(x)) if network else np.ones(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*b.schema.names, "score"])

    return base.mapInArrow(run, schema)


def keep_good(documents: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose score is at least so high, with their own columns."""
    return scores(documents, labels).where(F.col("score") >= least).select(*documents.columns)
