"""Substring dedup over sliding sentence spans.

From every sentence on, and back from every sentence, the shortest run of consecutive sentences with at least
two sentences and min_words words is hashed, so every sentence of a repeated passage of that length is in a hashed
run (a single sentence of lone_words or more counts by itself too, and so does a text that is one sentence of
min_words or more). Shorter texts are never removed. Equal hashes meet
in one grouped minimum over the whole table; a run that is not the first of its hash, by id, text and
place, has all its sentences removed. Only the first copy of a repeated passage stays.

Sentences end at . ! or ? before white space, and at line ends; case and white space do not count.
Null and empty texts have no sentences. Rows that repeat id and text are one document. Other columns
are ignored. Hashes have 128 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import row_keys, stored

_SENTENCE = re.compile(r"(?:(?<=[.!?])\s+|\n+)")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence with its words, white space after it left out."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if text[at:m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def runs(words: list[list[str]], min_words: int, lone_words: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the shortest run from each sentence that is long enough."""
    sizes = [len(w) for w in words]
    end, held = 0, 0
    for first, size in enumerate(sizes):
        if end <= first:
            end, held = first, 0
        while end < len(sizes) and (held < min_words or end - first < 2):
            held += sizes[end]
            end += 1
        if size >= lone_words:
            yield first, first + 1
        elif held >= min_words and end - first >= 2:
            yield first, end
        held -= size


def all_runs(words: list[list[str]], min_words: int, lone_words: int) -> list[tuple[int, int]]:
    """Every (first, end) that is hashed: runs(), the runs of several from long sentences, the shortest back from each end."""
    n = len(words)
    if n == 1:
        return [(0, 1)] if len(words[0]) >= min(min_words, lone_words) else []
    several = runs(words, min_words, sum(map(len, words)) + 1)
    back = ((n - end, n - first) for first, end in runs(words[::-1], min_words, sum(map(len, words)) + 1))
    return sorted({*runs(words, min_words, lone_words), *several, *back})


def span_hashes(documents: DataFrame, min_words: int, lone_words: int, id_col: str, text_col: str) -> DataFrame:
    """One row per run: _d, _k, first, end (sentence numbers) and hash."""
    schema = "_d long, _k long, first int, end int, hash binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, firsts, ends, hashes = [], [], [], [], []
            for d, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = t.as_py() or ""
                words = [text[i:j].lower().split() for i, j in sentences(text)]
                joined = [" ".join(w) for w in words]
                for first, end in all_runs(words, min_words, lone_words):
                    ids.append(d)
                    keys.append(k)
                    firsts.append(first)
                    ends.append(end)
                    hashes.append(xxhash.xxh3_128_digest(" ".join(joined[first:end]).encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(firsts, pa.int32()), pa.array(ends, pa.int32()),
                 pa.array(hashes, pa.binary())], ["_d", "_k", "first", "end", "hash"])

    return documents.select(*row_keys(id_col, text_col), F.col(text_col)).mapInArrow(run, schema)


def covered(documents: DataFrame, min_words: int = 16, lone_words: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs that are not the first of their hash: _d, _k, first, end."""
    spans = stored(span_hashes(documents, min_words, lone_words, id_col, text_col))
    firsts = stored(
        spans.groupBy("hash").agg(F.min(F.struct("_d", "_k", "first")).alias("f"), F.count("*").alias("n"))
        .where("n > 1").select("hash", F.col("f._d").alias("fd"), F.col("f._k").alias("fk"), F.col("f.first").alias("ff"))
    )
    return spans.join(firsts, "hash").where("_d != fd OR _k != fk OR first != ff").select("_d", "_k", "first", "end")


def dedup_spans(documents: DataFrame, min_words: int = 16, lone_words: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text without the covered sentences, n_sentences, n_removed."""
    ranges = (
        covered(documents, min_words, lone_words, id_col, text_col)
        .groupBy("_d", "_k").agg(F.collect_list(F.struct("first", "end")).alias("cut"))
    )
    joined = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row_keys(id_col, text_col)).join(ranges, ["_d", "_k"], "left")
    schema = "doc_id long, text string, n_sentences long, n_removed long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, totals, removed = [], [], []
            for t, c in zip(b.column(1), b.column(2)):
                text, cut = t.as_py(), c.as_py() or []
                places = sentences(text or "")
                gone = {i for r in cut for i in range(r["first"], r["end"])}
                totals.append(len(places))
                removed.append(len(gone))
                if gone:
                    edges = [0, *[i for i, _ in places[1:]], len(text)]
                    text = "".join(text[edges[i]:edges[i + 1]] for i in range(len(places)) if i not in gone)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())],
                                             ["doc_id", "text", "n_sentences", "n_removed"])

    return joined.select("doc_id", "text", "cut").mapInArrow(run, schema)
