"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into blocks of 21, 21 and 22 bits. Two fingerprints at most 4 bits apart
differ by at most 1 bit in one block. Anchors of a block are the words of the perfect Hamming code on
its first 15 bits, next to any value of the other bits: every block value is within 1 bit (the covering
radius) of exactly one anchor, its home. Each fingerprint goes to every anchor within radius plus
block threshold; at an anchor, fingerprints that have their home there are compared with all that came.

Equal fingerprints are one node, so copies are never paired. An anchor reports a spanning set of its
links, not all pairs; an anchor with very many fingerprints is split into a grid of cells.

Null and empty texts have fingerprint zero. Rows may repeat; all are answered. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import LOWER, UPPER, components, stored

BLOCKS = ((0, 21), (21, 21), (42, 22))
CODED, RADIUS = 15, 1
#: Fingerprints of one anchor that one cell compares.
CELL = 4096
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, width: int) -> int:
    """64-bit SimHash over width-word shingles, repeats counted; bit set if over half of the hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    n = max(len(words) - width + 1, 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), 42)
                              for i in range(lo, min(lo + 65536, n))), np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(documents: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and fp (the fingerprint as a signed long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return documents.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, fp long")


def hamming_homes() -> np.ndarray:
    """Nearest code word of every 15-bit value: the syndrome is the XOR of the places of set bits."""
    values = np.arange(1 << CODED)
    syndrome = np.zeros_like(values)
    for bit in range(CODED):
        syndrome ^= np.where(values >> bit & 1, bit + 1, 0)
    return np.where(syndrome > 0, values ^ (1 << np.maximum(syndrome - 1, 0)), values)


def flips(width: int, within: int) -> np.ndarray:
    """All differences of at most so many bits; two are enough for the thresholds here."""
    one = [1 << i for i in range(width)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    return np.array([0, *one[: width if within > 0 else 0], *(two if within > 1 else [])], np.int64)


def block_threshold(distance: int) -> int:
    """Bits that the closest of the blocks may differ in."""
    return distance // len(BLOCKS)


def anchors_of(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, anchor key, home) of every anchor within radius plus block threshold, block by block."""
    homes, reach = hamming_homes(), RADIUS + block_threshold(distance)
    is_word = homes == np.arange(len(homes))
    for at, (shift, bits) in enumerate(BLOCKS):
        value = (fps.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
        home = homes[value & ((1 << CODED) - 1)] | (value >> CODED << CODED)
        for flip in flips(bits, reach):
            anchor = value ^ flip
            ok = np.flatnonzero(is_word[anchor & ((1 << CODED) - 1)])
            if len(ok):
                yield ok, anchor[ok] | at << 32, anchor[ok] == home[ok]


def replicate(nodes: DataFrame, distance: int) -> DataFrame:
    """Copies of fp at its anchors: anchor, fp, home."""
    if block_threshold(distance) > 1:
        raise ValueError("anchors are laid out for at most 5 differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, anchor, home in anchors_of(fps, distance):
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[rows]), pa.array(home)], ["anchor", "fp", "home"])

    return nodes.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def cell_links(fps: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning links of one cell: every home against all, links that join what is joined already left out."""
    label = np.unique(fps, return_inverse=True)[1]  # a home and its own copy are one from the start
    bits, out = fps.view(np.uint64), []
    for h in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(bits ^ bits[h]) <= distance)
        other = near[label[near] != label[h]]
        if len(other):
            groups, first = np.unique(label[other], return_index=True)
            out += [(int(fps[h]), int(fps[other[i]])) for i in first]
            label[np.isin(label, groups)] = label[h]
    return out


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all within so many bits, found at shared anchors."""
    copies = stored(replicate(nodes, distance))
    crowded = stored(
        copies.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
        .select("anchor", F.ceil(F.col("n") / CELL).cast("int").alias("k"))
    )
    # Row i of an anchor's grid holds a part of its homes, column j a part of all its copies.
    split = copies.join(crowded, "anchor", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    every = F.sequence(F.lit(0), F.col("k") - 1)
    part = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    columns = split.select("anchor", "fp", F.lit(False).alias("home"), F.explode(every).alias("i"), part.alias("j"))
    rows = split.where("home").select("anchor", "fp", "home", part.alias("i"), F.explode(every).alias("j"))
    cells = (
        columns.unionByName(rows).repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
        .select("anchor", "i", "j", "fp", "home")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = ((b["anchor"] != b["anchor"].iloc[-1]) | (b["i"] != b["i"].iloc[-1]) | (b["j"] != b["j"].iloc[-1])).to_numpy()
            cut = int(last.nonzero()[0][-1]) + 1 if last.any() else 0
            rest = b.iloc[cut:]
            if cut:
                yield compare(b.iloc[:cut])
        if rest is not None:
            yield compare(rest)

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        key = b[["anchor", "i", "j"]].to_numpy()
        ends = np.flatnonzero(np.append((key[1:] != key[:-1]).any(axis=1), True)) + 1
        fps, home = b["fp"].to_numpy(), b["home"].to_numpy()
        out, lo = [], 0
        for hi in ends:
            if hi - lo > 1 and home[lo:hi].any():
                out += cell_links(fps[lo:hi], home[lo:hi], distance)
            lo = hi
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return cells.mapInPandas(run, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """Per document row: doc_id, fp, component_id (smallest doc_id that links reach, itself included; null ids do not count)."""
    prints = stored(fingerprints(documents, width))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes, distance))
    rooted = stored(nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
                    .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    least = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = stored(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(documents: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """One document of each group, that of the smallest id, with the columns of documents.

    Rows without id all stay: they cannot be told to be the first. Of rows that repeat a kept id one stays.
    """
    kept = near_duplicates(documents.where("doc_id IS NOT NULL"), width, distance).where("doc_id = component_id").select("doc_id").distinct()
    named = documents.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(documents.where("doc_id IS NULL"))
