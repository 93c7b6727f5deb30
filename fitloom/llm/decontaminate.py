"""Benchmark decontamination with a distributed positional inverted index.

The index holds one posting (term, document, position) per word of the training texts that any test
item uses, in document order, so that building it needs no shuffle. For every window of a test item
the two rarest words are looked up; their postings, shifted by their place in the item, meet on
(document, item, diagonal). Only diagonals where both meet are checked against the postings of all
other words of the item.

Null and empty texts have no words: such a document gets zeros, such an item is never found. Rows
that repeat id and text are each answered, alike. A null item id is left out. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.llm.common import ascii_lower, row_keys, small, stored

#: What stands between words, before A-Z are lower-cased (fixed by the contract of words).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
HEAD = ""  # posting at position 0 of every document, so that none is lost


def words(text: Column) -> Column:
    """Words of a whole text in their order, not yet lower-cased."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per word of a test item: item_id, _i (item key), n (words), p (place from 0), term."""
    return (
        items.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("item_id"), F.xxhash64(id_col, text_col).alias("_i"), words(F.col(text_col)).alias("_w"))
        .select("item_id", "_i", F.size("_w").alias("n"), F.posexplode("_w").alias("p", "word"))
        .withColumn("word", ascii_lower(F.col("word")))
        .distinct()
    )


def build_index(documents: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (doc_id, _d, _k, n_words, pos from 1, term) of the vocabulary (word, term); term 0 at pos 0 per row."""
    tokens = (
        documents.select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col), words(F.col(text_col)).alias("_w"))
        .select("doc_id", "_d", "_k", F.size("_w").alias("n_words"),
                F.posexplode(F.concat(F.array(F.lit(HEAD)), "_w")).alias("pos", "word"))
        .withColumn("word", ascii_lower(F.col("word")))
    )
    head = vocabulary.sparkSession.range(1).select(F.lit(HEAD).alias("word"), F.lit(0).cast("long").alias("term"))
    return tokens.join(small(vocabulary.unionByName(head)), "word").drop("word")


def rarest_pairs(index: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """Per window of width words (or whole shorter item) its two rarest words: _i, n, p1, t1, p2, t2.

    Windows with a word that no document has are left out. A one-word item has its word twice.
    """
    counts = index.where("pos > 0").groupBy("term").agg(F.count("*").alias("df"))
    last = F.greatest(F.col("n") - width, F.lit(0))
    members = items.join(counts, "term", "left").select(
        "_i", "n", "p", "term", F.coalesce("df", F.lit(0)).alias("df"),
        F.explode(F.sequence(F.greatest(F.col("p") - width + 1, F.lit(0)), F.least(F.col("p"), last))).alias("s"),
    )
    return (
        members.groupBy("_i", "n", "s")
        .agg(F.array_sort(F.collect_list(F.struct("df", "p", "term"))).alias("m"))
        .where(F.col("m")[0]["df"] > 0)
        .withColumn("second", F.col("m")[F.least(F.lit(1), F.size("m") - 1)])
        .select("_i", "n", F.col("m")[0]["p"].alias("p1"), F.col("m")[0]["term"].alias("t1"),
                F.col("second.p").alias("p2"), F.col("second.term").alias("t2"))
        .distinct()
    )


def seeds(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Postings of the rare words, shifted to the item's start: _d, _k, _i, n, p1, p2, diag, role (bits 1 and 2)."""
    role = lambda n: pairs.select("_i", "n", "p1", "p2", F.col(f"t{n}").alias("term"), F.col(f"p{n}").alias("p"), F.lit(n).alias("role"))
    return (
        index.where("pos > 0").join(small(stored(role(1).unionByName(role(2)))), "term")
        .select("_d", "_k", "_i", "n", "p1", "p2", (F.col("pos") - F.col("p")).alias("diag"), "role")
    )


def phrase_hits(index: DataFrame, items: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Words of documents inside an exact window: _d, _k, item_id, pos."""
    found = (
        seeds(index, pairs).groupBy("_d", "_k", "_i", "n", "p1", "p2", "diag").agg(F.bit_or("role").alias("role"))
        .where("role = 3").select("_d", "_k", "_i", "diag").distinct()
    )
    wanted = (
        found.join(items, "_i").select("_d", "_k", "item_id", "_i", "n", "p", "diag", "term",
                                       (F.col("diag") + F.col("p")).alias("pos")).where("pos > 0")
    )
    matched = wanted.join(index.select("_d", "_k", "pos", "term"), ["_d", "_k", "pos", "term"]).distinct()
    line = ["_d", "_k", "_i", "diag"]
    runs = matched.withColumn("run", F.col("p") - F.row_number().over(Window.partitionBy(*line).orderBy("p")))
    return (
        runs.withColumn("len", F.count("*").over(Window.partitionBy(*line, "run")))
        .where(F.col("len") >= F.least(F.col("n"), F.lit(width))).select("_d", "_k", "item_id", "pos").distinct()
    )


def proximity_hits(index: DataFrame, items: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """Items whose window's two rarest words stand within slop words of their distance: _d, _k, item_id, off (least shift)."""
    rows = stored(seeds(index, pairs))
    cell = F.floor(F.col("diag") / (slop + 1))
    key = ["_d", "_k", "_i", "p1", "p2", "cell"]
    left = rows.where("role = 1").select(*key[:-1], F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"), F.col("diag").alias("d1"))
    right = rows.where("role = 2").select(*key[:-1], cell.alias("cell"), F.col("diag").alias("d2"))
    near = left.join(right, key).where(F.abs(F.col("d1") - F.col("d2")) <= slop)
    return (
        near.groupBy("_d", "_k", "_i").agg(F.min(F.abs(F.col("d1") - F.col("d2"))).alias("off"))
        .join(items.select("_i", "item_id").distinct(), "_i").drop("_i")
    )


def prepare(documents: DataFrame, benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored index, test item words and their rarest pairs, for any number of searches."""
    named = stored(item_words(benchmark).withColumn("term", F.xxhash64("word")))
    index = stored(build_index(documents, named.select("word", "term").distinct()))
    items = named.drop("word")
    return index, items, stored(rarest_pairs(index, items, width))


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items (ids as sorted strings), contaminated, _d, _k."""
    index, items, pairs = prepare(documents, benchmark, width)
    hits = phrase_hits(index, items, pairs, width)
    found = (
        hits.groupBy("_d", "_k", "pos").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
        .groupBy("_d", "_k").agg(F.count("*").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    )
    return (
        index.where("pos = 0").select("doc_id", "_d", "_k", F.col("n_words").cast("long").alias("n_words"))
        .join(found, ["_d", "_k"], "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Documents without any window of the benchmark, with their own columns."""
    bad = decontaminate(documents, benchmark, width).where("contaminated").select("_d", "_k").distinct()
    keyed = documents.select("*", *row_keys())
    return keyed.join(bad, ["_d", "_k"], "left_anti").select(*documents.columns)
