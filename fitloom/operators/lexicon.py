"""Lexicons and rules that are tables: words of any number found in texts through an inverted index of character grams.

Every word is anchored at one of its grams, the one that fewest other words hold. A text's distinct grams meet the anchors in
an equi-join; what they bring back is gathered per text, at most the words that share a gram with it, and tested on the
text itself in its own row. So no text is tested against the whole lexicon, and a text is shuffled once.

Of a text's grams only those of the anchors are cut where these are few; then the anchors go to the texts, and no text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitloom.functions.lexicons import FALLBACK_ROLE, ROLE_CAP, RoleRule
from fitloom.functions.text import let
from fitloom.operators.roles import _FIELDS, keyword_union
from fitloom.session import stored_once

#: Code points of a gram; shorter words are grams themselves.
GRAM = 4
#: Words of a lexicon that is few: their grams fit one pattern.
FEW = 256


def _quoted(text: str) -> str:
    return re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", text)


def _any_of(words: Iterable[str]) -> str:
    """A pattern of the words, those with one first character tried together."""
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[0], []).append(_quoted(w[1:]))
    return "|".join(f"{_quoted(c)}(?:{'|'.join(t)})" for c, t in tails.items())


def grams(low: Column, size: int, among: Iterable[str] = ()) -> Column:
    """All grams of a text, repeats kept, in one pass; only those among some of that size where these are named."""
    # No gram begins inside a character that Java keeps as two.
    wanted = _any_of(among) or rf"[^\x{{DC00}}-\x{{DFFF}}].{{{size - 1}}}"
    return F.regexp_extract_all(low, F.lit(f"(?s)(?=({wanted}))"), F.lit(1))


def anchors(lexicon: DataFrame, word_col: str = "word", fold: bool = True) -> DataFrame:
    """(gram, size, key, word): every distinct word at its rarest gram; key is what a text must hold. Null and empty words are left out."""
    words = lexicon.select(F.col(word_col).alias("word"), (F.lower(word_col) if fold else F.col(word_col)).alias("key")).where("key <> ''").distinct()
    sized = words.withColumn("size", F.least(F.char_length("key"), F.lit(GRAM)))
    own = F.coalesce(*[F.when(F.col("size") == n, F.array_distinct(grams(F.col("key"), n))) for n in range(1, GRAM + 1)])
    listed = sized.withColumn("gram", F.explode(own))
    counts = listed.groupBy("gram").agg(F.count("*").alias("n"))
    return listed.join(counts, "gram").groupBy("word", "key", "size").agg(
        F.min(F.struct("n", "gram")).alias("a")).select(F.col("a.gram").alias("gram"), "size", "key", "word")


def table_hits(texts: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", word_col: str = "word",
               fold: bool = True) -> DataFrame:
    """(id, word): words of the lexicon that the lower-cased text holds as substrings; ids name one text each.

    With fold words are lower-cased, too; without it a word with capitals is in no text.
    """
    # Stored, so that its size is known before the join: only a large lexicon makes the texts' grams be shuffled.
    index = stored_once(anchors(lexicon, word_col, fold))
    few = index.select("size", "gram").limit(FEW + 1).collect()
    if not few:
        return texts.select(id_col, F.lit("").alias("word")).limit(0)
    if len(few) <= FEW:
        return _few_hits(texts, index, sorted({(r["size"], r["gram"]) for r in few}), id_col, text_col)
    # At most GRAM sizes.
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())
    low = F.lower(text_col)
    held = texts.select(id_col, F.explode(F.array_distinct(let(low, lambda t: F.concat(*[grams(t, n) for n in sizes])))).alias("gram"))
    near = held.join(index, "gram").groupBy(id_col).agg(F.collect_set(F.struct("key", "word")).alias("near"))
    found = let(low, lambda t: F.filter("near", lambda w: F.contains(t, w["key"])))
    return texts.select(id_col, text_col).join(near, id_col).select(id_col, F.explode(found).alias("w")).select(id_col, F.col("w.word").alias("word"))


def _few_hits(texts: DataFrame, index: DataFrame, listed: list[tuple[int, str]], id_col: str, text_col: str) -> DataFrame:
    """table_hits for an index of FEW rows at most: each text meets it where it was read, and its words are tested there."""
    low = F.col("_low")
    # Grams under GRAM code points are common: a test for each ends early, where a pattern would bring every place of them.
    short = [F.when(F.contains(low, F.lit(g)), F.lit(g)) for n, g in listed if n < GRAM]
    whole = [g for n, g in listed if n == GRAM]
    cut = [F.array_distinct(grams(low, GRAM, whole))] if whole else []
    held = texts.where(F.col(id_col).isNotNull()).select(id_col, F.lower(text_col).alias("_low")).select(
        id_col, "_low", F.explode(F.concat(*cut, F.array_compact(F.array(*short)) if short else F.array().cast("array<string>"))).alias("gram"))
    return held.join(F.broadcast(index), "gram").where(F.contains("_low", "key")).select(id_col, "word")


def rules_table(spark: SparkSession, rules: Iterable[RoleRule]) -> DataFrame:
    """Rules as rows, one per trigger."""
    rows = [(i, r.role, r.min_matches, t) for i, r in enumerate(rules) for t in r.triggers]
    return spark.createDataFrame(rows, "rule_ord int, role string, min_matches int, trigger string")


def match_rules(texts: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text", keywords: str | None = None) -> DataFrame:
    """(id, rule_ord, role, matches) of the rules that hold their least number of triggers in the text or among its keywords.

    A division of the hits by the rules table: hits are joined to the rules of their trigger and counted per text and rule.
    A rule that asks for none is given where it has a hit.
    """
    triggers = rules.select("trigger").where("trigger <> ''").distinct()
    hits = table_hits(texts, triggers, id_col, text_col, "trigger", fold=False).withColumnRenamed("word", "trigger")
    if keywords is not None:
        # A plain column in explode would be tested for rows first, and all that makes it be computed twice.
        hits = hits.unionByName(texts.select(id_col, F.explode(F.array_distinct(keywords)).alias("trigger")).join(triggers, "trigger").select(id_col, "trigger")).distinct()
    return hits.join(rules.distinct(), "trigger").groupBy(id_col, "rule_ord", "role", "min_matches").agg(
        F.count("*").cast("int").alias("matches")).where("matches >= min_matches").select(id_col, "rule_ord", "role", "matches")


def infer_roles(profiles: DataFrame, rules: DataFrame, id_col: str = "resume_id", fallback: str = FALLBACK_ROLE, cap: int = ROLE_CAP) -> DataFrame:
    """(id, rank, role, matches) as roles.infer_roles gives them, the rules being a table of any length."""
    texts = profiles.select(id_col, F.coalesce("raw_text", F.lit("")).alias("raw_text"), keyword_union(*[F.col(f) for f in _FIELDS]).alias("keywords"))
    found = match_rules(texts, rules, id_col, "raw_text", "keywords")
    best = found.groupBy(id_col, "role").agg(F.min(F.struct((-F.col("matches")).alias("less"), "rule_ord")).alias("b")).select(
        id_col, "role", F.lit(0).alias("spare"), F.col("b.less").alias("less"), F.col("b.rule_ord").alias("rule_ord"))
    spare = profiles.where(F.size("programming_languages") > 0).select(
        id_col, F.lit(fallback).alias("role"), F.lit(1).alias("spare"), F.lit(0).alias("less"), F.lit(0).alias("rule_ord"))
    # A role that a rule found comes before the same role as fallback; the cap counts each once.
    once = best.unionByName(spare).groupBy(id_col, "role").agg(F.min(F.struct("spare", "less", "rule_ord")).alias("o"))
    order = Window.partitionBy(id_col).orderBy("o.spare", "o.less", "o.rule_ord")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select(id_col, "rank", "role", (-F.col("o.less")).alias("matches"))
