"""Secret scan: a random forest removes false positives among secret-like strings. DataFrame functions only.

Candidates are runs of key characters with a digit in them, found in every word of whole texts.
Features: length, kinds of characters and the changes between them, share of distinct characters,
how much of it common words cover, whether it stands in a path or address, and what the neighbouring
words say. The forest learns from findings labelled by rules of high precision (formats with a fixed
prefix, values assigned to a name of a secret; numbers, mail addresses, paths and counted things), from a
bounded sample per label chosen by hash. Where one label has no findings, the rules decide.

A null or empty text has no candidates. A string found twice in a text is one finding. Rows that repeat
id and text are one document; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import row_keys, stored

#: Names that secrets are assigned to, words that stand by other codes, and common words.
SECRET_NAMES = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "access_key", "private_key", "credential", "auth", "bearer")
OTHER_NAMES = ("commit", "sha1", "sha256", "md5", "checksum", "uuid", "guid", "isbn", "version", "order", "invoice", "phone", "call", "page", "id")
COMMON_WORDS = (
    "about", "after", "also", "and", "are", "but", "card", "code", "data", "der", "die", "del", "des", "example", "file", "for", "from", "have",
    "html", "http", "index", "les", "mail", "not", "one", "page", "para", "por", "pour", "que", "site", "test", "that", "the", "this", "und", "user",
    "was", "web", "with", "www", "you",
)
CANDIDATE = r"[A-Za-z0-9+/_=.~-]*[0-9][A-Za-z0-9+/_=.~-]*"
FEATURES = ("length", "digits", "lowers", "uppers", "marks", "hexes", "changes", "distinct", "covered", "in_path", "in_mail",
            "named", "assigned", "other", "quoted", "prefixed")
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abprs]-|sk-|sk_live_|AIza|glpat-|eyJ)"
MASK = "[SECRET]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _names(words: tuple[str, ...]) -> str:
    return r"(?i)(?:^|[^a-z])(?:" + "|".join(words) + r")s?(?:[^a-z]|$)"


def candidates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 8) -> DataFrame:
    """Distinct candidates per document: doc_id, _d, _k, value, word, before (three words joined), after, start, n."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), *row_keys(id_col, text_col), text.alias("text"),
        F.split(text, r"\s+").alias("w"),
    ).select("doc_id", "_d", "_k", "text", "w", F.posexplode("w").alias("at", "word"))
    near = lambda off: F.coalesce(F.get("w", F.col("at") + off), F.lit(""))
    short = lambda c: F.substring(c, 1, 64)  # noqa: E731  context of a candidate, not the text that is scanned
    odd = (
        words.where(F.octet_length("word") >= least).where(F.col("word").rlike("[0-9]"))
        .select("doc_id", "_d", "_k", "text", "at", "word", F.concat_ws(" ", short(near(-3)), short(near(-2)), short(near(-1))).alias("before"),
                short(near(1)).alias("after"), F.explode(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))).alias("run"))
    )
    # name=value and name:value: the value is the candidate; marks at the edges belong to the sentence.
    value = F.regexp_replace(F.regexp_replace("run", r"^(?:[A-Za-z_]+=+)+", ""), r"^[.=~/-]+|[.~-]+$", "")
    named = odd.withColumn("value", value).where(F.octet_length("value") >= least).where(F.col("value").rlike("[0-9]"))
    return (
        named.withColumn("start", F.expr("instr(text, value)") - 1)
        .withColumn("n", ((F.length("text") - F.length(F.replace("text", F.col("value"), F.lit("")))) / F.length("value")).cast("long"))
        # Of several places the first one by a name of a secret tells the context, else the first.
        .withColumn("unnamed", ~F.concat_ws(" ", "before", F.substring("word", 1, 256)).rlike(_names(SECRET_NAMES)))
        .groupBy("_d", "_k", "value")
        .agg(F.min(F.struct("unnamed", "at", "doc_id", "start", "n", "word", "before", "after")).alias("m"))
        .select("m.doc_id", "_d", "_k", "value", F.substring("m.word", 1, 256).alias("word"), "m.before", "m.after", "m.start", "m.n")
    )


def features(found: DataFrame) -> DataFrame:
    """Adds the numbers that the forest sees."""
    v, length = F.col("value"), F.length("value").cast("double")
    share = lambda p: _count(v, p) / length
    flag = lambda c: c.cast("double")
    name = F.concat_ws(" ", "before", F.regexp_extract("word", r"^[\"']?([A-Za-z_]+)[=:]", 1))
    return found.select(
        "*", length.alias("length"), share("[0-9]").alias("digits"), share("[a-z]").alias("lowers"), share("[A-Z]").alias("uppers"),
        share("[^A-Za-z0-9]").alias("marks"), share("[0-9a-fA-F]").alias("hexes"),
        (_count(v, "(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]") / length).alias("changes"),
        (F.size(F.array_distinct(F.split(v, ""))) / length).alias("distinct"),
        (1 - F.length(F.regexp_replace(F.lower(v), "|".join(sorted(COMMON_WORDS, key=lambda w: (-len(w), w))), "")) / length).alias("covered"),
        flag(F.col("word").rlike(r"://|^/|/[^/]*/|\.(?:html?|php|com|net|org)")).alias("in_path"), flag(F.col("word").contains("@")).alias("in_mail"),
        flag(name.rlike(_names(SECRET_NAMES))).alias("named"),
        flag(F.col("before").rlike(r"[=:]$") | F.col("word").rlike(r"^[\"']?[A-Za-z_]+[=:]")).alias("assigned"),
        flag(name.rlike(_names(OTHER_NAMES))).alias("other"), flag(F.col("word").rlike("[\"']")).alias("quoted"), flag(v.rlike(PREFIXES)).alias("prefixed"),
    )


def rule_label(found: DataFrame) -> DataFrame:
    """Adds label: 1 or 0 where a rule of high precision speaks, else null."""
    secret = ((F.col("prefixed") == 1) & (F.col("length") >= 16)) | ((F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("length") >= 8))
    clean = (F.col("in_mail") == 1) | (F.col("in_path") == 1) | (F.col("digits") + F.col("marks") >= 1) | ((F.col("named") == 0) & (F.col("other") == 1))
    return found.withColumn("label", F.when(secret & (F.col("in_mail") == 0), 1.0).when(clean & (F.col("named") == 0), 0.0))


def scan(documents: DataFrame, sample_per_label: int = 5000, threshold: float = 0.5, trees: int = 20, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per finding: candidates' columns, features, label (of the rules), probability, is_secret."""
    found = stored(rule_label(features(candidates(documents, id_col, text_col))))
    order = [F.xxhash64("value", "before"), F.col("value"), F.col("_d"), F.col("_k")]
    taught = stored(
        found.where("label = 1").orderBy(*order).limit(sample_per_label)
        .unionByName(found.where("label = 0").orderBy(*order).limit(sample_per_label)).coalesce(1)
    )
    have = {r["label"] for r in taught.select("label").distinct().collect()}
    if len(have) < 2:
        return found.withColumn("probability", F.coalesce("label", F.lit(0.0))).withColumn("is_secret", F.col("probability") >= threshold)
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=trees, maxDepth=7, seed=11, featureSubsetStrategy="sqrt")
    model = forest.fit(assemble.transform(taught))
    scored = model.transform(assemble.transform(found.withColumnRenamed("label", "_label")))
    return (
        scored.withColumn("p", F.round(vector_to_array(F.col("probability"))[1], 9))
        .select(*[c for c in found.columns if c != "label"], F.col("_label").alias("label"), F.col("p").alias("probability"), (F.col("p") >= threshold).alias("is_secret"))
    )


def redact(documents: DataFrame, sample_per_label: int = 5000, threshold: float = 0.5) -> DataFrame:
    """Documents with every secret masked wherever its text has it; longer secrets first. Columns stay."""
    secrets = (
        scan(documents, sample_per_label, threshold).where("is_secret").groupBy("_d", "_k")
        .agg(F.array_sort(F.collect_set(F.struct((-F.length("value")).alias("n"), F.col("value").alias("v")))).alias("_secrets"))
    )
    masked = F.aggregate("_secrets", F.col("text"), lambda t, s: F.replace(t, s["v"], F.lit(MASK)))
    joined = documents.select("*", *row_keys()).join(secrets, ["_d", "_k"], "left")
    return joined.withColumn("text", F.when(F.col("_secrets").isNull(), F.col("text")).otherwise(masked)).select(*documents.columns)
