"""Embedding near-duplicates by sorted projection passes.

Vectors of one length are compared with each other; equal ones are one class. Each pass sorts the classes of a length by 64 sign
bits of random projections, read as one string of bits, and compares every class with the window before it. The mean of a length's
unit vectors is taken off before the signs, so that vectors that share a direction do not share their bits; cosines are those of
the vectors as given. Passes report a spanning set of links, never all pairs. The number of passes follows from the number of
classes and their mean cosine: at least ten, and so many that of pairs at just the threshold among vectors spread evenly around
their mean at most MISS are in no window. Crowded regions, and mean cosines above about 0.71, can lose more. Links are
joined across passes to components. Within every component of several classes links are counted exactly:
its classes are compared in a grid of blocks, counts only; components of one block share tasks.

Vectors that are null, zero, or hold nulls or non-finite numbers link with
nothing; rows without an id link with nothing and have no component. Rows that repeat an id
are one vector, which holds the links of all of them. Cosines are in double precision. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import components, stored
from fitloom.operators.ranking import row_index

BITS, BLOCK, GRID = 64, 1024, 2048
#: The passes there always are, and the share of pairs at the threshold that may be in no window of any pass.
LEAST_PASSES, MISS = 10, 0.01
#: The least cosine, after the mean is taken off, that passes are numbered for.
LEAST_CENTRED = 0.65


def passes_for(classes: int, window: int = 64, threshold: float = 0.9, miss: float = MISS, mean_cosine: float = 0.0) -> int:
    """Passes after which a pair at the threshold is in no window with probability miss, vectors being evenly spread around their mean."""
    # A window holds the classes that share the first log2(classes / window) sign bits; each agrees with p.
    centred = (threshold - mean_cosine) / (1 - mean_cosine) if mean_cosine < threshold else 0.0
    p = 1 - math.acos(max(centred, LEAST_CENTRED)) / math.pi
    found = min(p ** max(math.log2(max(classes, 1) / window), 0), 1 - 1e-9)
    return max(LEAST_PASSES, math.ceil(math.log(miss) / math.log(1 - found)))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v (floats as given, else doubles) of the rows that can link."""
    kind = vectors.select(vec_col).schema[0].dataType.simpleString()
    v = F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    )


def classes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rep, n, v) per distinct vector, and (vec_id, rep) per row; rep is the class's smallest id."""
    rows = usable(vectors, id_col, vec_col).distinct()
    reps = stored(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    return reps, rows.join(reps.select("v", "rep"), "v").select("vec_id", "rep")


def unit(rows) -> np.ndarray:
    x = np.stack(rows).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def directions(reps: DataFrame) -> DataFrame:
    """(d, classes, mean) per length: how many classes it has and the mean of their unit vectors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part in b.groupby("d"):
                yield pd.DataFrame({"d": d, "classes": len(part), "at": np.arange(d), "x": unit(part["v"]).sum(axis=0)})

    sums = reps.select(F.size("v").alias("d"), "v").mapInPandas(run, "d int, classes long, at int, x double")
    means = sums.groupBy("d", "at").agg(F.sum("classes").alias("classes"), (F.sum("x") / F.sum("classes")).alias("x"))
    listed = F.array_sort(F.collect_list(F.struct("at", "x")))
    return means.groupBy("d").agg(F.first("classes").alias("classes"), F.transform(listed, lambda m: m["x"]).alias("mean"))


def sign_bits(x: np.ndarray, mean: np.ndarray, p: int, seed: int = 5) -> np.ndarray:
    """A pass's sort key per unit vector, as an ordered long."""
    planes = np.random.default_rng([seed, p]).normal(size=(x.shape[1], BITS))
    bits = np.packbits((x - mean) @ planes > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)
    return (bits ^ np.uint64(1 << 63)).view(np.int64)


def sort_keys(reps: DataFrame, passes: int | None, window: int, threshold: float) -> DataFrame:
    """One row per class and pass: d (the length), pass, key (sign bits as an ordered long), rep."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part in b.groupby("d"):
                x, mean = unit(part["v"]), np.array(part["mean"].iloc[0])
                count = passes or passes_for(int(part["classes"].iloc[0]), window, threshold, mean_cosine=float(mean @ mean))
                for p in range(count):
                    yield pd.DataFrame({"d": d, "pass": np.int32(p), "key": sign_bits(x, mean, p), "rep": part["rep"]})

    # Stored: sums of doubles depend on their order, and all keys must come from one mean.
    shapes = stored(directions(reps))
    return reps.withColumn("d", F.size("v")).join(shapes, "d").select("d", "classes", "mean", "rep", "v").mapInPandas(
        run, "d int, pass int, key long, rep long")


class Joined:
    """Union-find over the rows of one block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def window_links(ranked: DataFrame, reps: DataFrame, threshold: float, window: int) -> DataFrame:
    """Links (a, b) that span the linked classes of every block of a pass. ranked: d, pass, rep, rank."""
    home = F.floor(F.col("rank") / BLOCK)
    late = (F.col("rank") % BLOCK) >= BLOCK - window
    placed = ranked.join(reps.select("rep", "v"), "rep").select(
        "d", "rank", "pass", "rep", "v",
        F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home))).alias("block"),
    )

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rank", ignore_index=True)
        rank, own, which = b["rank"].to_numpy(), (b["rank"] // BLOCK == b["block"]).to_numpy(), b["pass"].to_numpy()
        x, rep = unit(b["v"]), b["rep"].to_numpy()
        i, j = np.nonzero(np.tril(x @ x.T >= threshold, -1))
        ok = own[i] & (rank[i] - rank[j] <= window) & (which[i] == which[j])
        sets = Joined(len(b))
        joined = [sets.join(p, q) for p, q in zip(i[ok].tolist(), j[ok].tolist())]
        return pd.DataFrame({"a": rep[i[ok]][joined], "b": rep[j[ok]][joined]}, dtype="int64")

    # A length's ranks follow each other, so a block that holds two lengths is two groups.
    return placed.groupBy("d", "block").applyInPandas(compare, "a long, b long").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def exact_counts(members: DataFrame, threshold: float) -> DataFrame:
    """Linked vectors per class within components: rep, n_links. members: root, size, rep, n, v."""
    k = F.ceil(F.col("size") / GRID).cast("int")
    # Components of one block are dealt to packs of about GRID classes; a larger one has its own cells.
    packs = math.ceil(members.where(F.col("size") <= GRID).count() / GRID) or 1
    cell = F.when(k > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(packs)))
    part = F.pmod(F.xxhash64("rep"), k).cast("int")
    spread = members.withColumn("part", part).select(
        (k > 1).alias("own"), cell.alias("cell"), "root", "rep", "n", "v", "part", F.explode(F.sequence(F.lit(0), k - 1)).alias("other"),
    ).select("own", "cell", "root", "rep", "n", "v", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([count(c) for _, c in b.groupby("root")], ignore_index=True)

    def count(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rep", ignore_index=True)
        x, part, n = unit(b["v"]), b["part"].to_numpy(), b["n"].to_numpy()
        i, j = b["i"].iloc[0], b["j"].iloc[0]
        counts = np.zeros(len(b), np.int64)
        for lo in range(0, len(b), 512):
            near = x[lo:lo + 512] @ x.T >= threshold
            near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
            if i != j:  # pairs within a part belong to the cells on the diagonal
                near &= part[lo:lo + 512, None] != part[None, :]
            counts[lo:lo + 512] = near @ n
        return pd.DataFrame({"rep": b["rep"], "n": counts})

    return (
        spread.groupBy("own", "cell", "i", "j").applyInPandas(compare, "rep long, n long")
        .groupBy("rep").agg(F.sum("n").alias("n_links"))
    )


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, passes: int | None = None, window: int = 64, id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept. passes: by default as many as passes_for each length's classes and mean cosine."""
    reps, members = classes(vectors, id_col, vec_col)
    # Numbers over all lengths and passes at once: a window never looks across one.
    order = [F.col(c) for c in ("d", "pass", "key", "rep")]
    ranked = row_index(sort_keys(reps, passes, window, threshold), order, "rank").select("d", "pass", "rep", "rank")
    roots = stored(components(stored(window_links(ranked, reps, threshold, window))).select(F.col("node").alias("rep"), "root"))

    # Every root stands for itself too; links between the classes of a component are counted exactly.
    linked = roots.unionByName(roots.select(F.col("root").alias("rep"), "root")).distinct()
    sizes = linked.groupBy("root").agg(F.count("*").alias("size"))
    exact = stored(exact_counts(stored(linked.join(sizes, "root").join(reps, "rep")), threshold))
    counted = stored(
        reps.select("rep", "n").join(linked, "rep", "left").join(exact, "rep", "left")
        .select("rep", F.coalesce("root", "rep").alias("root"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    answered = stored(
        members.join(counted, "rep").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("root").alias("component_id"))
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    return (
        rows.join(answered, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
