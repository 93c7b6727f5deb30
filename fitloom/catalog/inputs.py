"""The shared test tables in the shapes the operators expect, and the word lists used on them.

The texts of these tables are invented, so the default lexicons hardly occur in them. The lists
below are frequent pieces of those texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.functions.lexicons import MatchTerms, ProfileTerms, RoleRule
from fitloom.session import spread
from fitloom.sources import payloads as P

AS_OF = "2026-03-12"

MATCH_TERMS = MatchTerms(
    stop_words=("the", "and", "of", "to", "in", "a", "de", "la"),
    tech_terms=("thth", "thon", "erin", "than", "onth", "ingan", "menten"),
    title_signals=(("ert", "que"), ("tion", "ou"), ("th", "an")),
    title_noise=("is", "on", "le"),
)
HEADERS = {
    "education": ("the", "la"),
    "projects": ("of", "de"),
    "experience": ("and", "to", "en"),
    "certifications": ("was", "der"),
    "skills": ("in", "the and"),
}
LEXICON = ("th", "thon", "on", "thon erin", "que", "tion", "schein", "ere", "a", "the", "de la", "ción")
TECH_LEXICON = ("ing", "ment", "ung", "erst", "nd")
DOMAINS = {
    "north": ("thth", "queque"),
    "south": ("erin", "schein"),
    "east": ("ción", "eaux"),
    "west": ("ndwh",),
    "never": ("zzzz",),
}
LEVELS = (("student", ("erth", "queque")), ("senior", ("thble",)), ("mid-level", ("schein",)))
ROLE_RULES = (
    RoleRule("Ther Lead", 2, ("the", "of", "thth", "que")),
    RoleRule("Que Lead", 1, ("erin", "schein", "tion")),
    RoleRule("Und Lead", 3, ("a", "e", "thon", "und")),
    RoleRule("Ment Lead", 2, ("en la", "de la", "ung", "ble")),
    RoleRule("Erin Lead", 1, ("ción", "eaux")),
    RoleRule("Tion Lead", 2, ("and", "that", "with")),
    RoleRule("Ing Lead", 1, ("ing", "lich")),
    RoleRule("Sch Lead", 1, ("ou", "sch")),
    RoleRule("On Lead", 4, ("in", "to", "is", "on", "it")),
)
CERT_WORDS = ("ther", "queau", "heit")
PROFILE_TERMS = ProfileTerms(
    languages=LEXICON, technologies=TECH_LEXICON, domains=DOMAINS, headers=HEADERS,
    levels=LEVELS, certificate_words=CERT_WORDS,
)
ROLES = ("Ther Lead", "Que Lead")
MUST, FALLBACK, LEVEL_WORDS = "er", ("que", "ung"), ("ing", "le", "sch")
BOARDS = tuple(f"src{i}" for i in range(20))
BOARD_CAP = 300
STATUS_OF = {"O": "Not Applied", "F": "Applied", "P": "Interview"}


def day() -> Column:
    return F.lit(AS_OF).cast("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a label: the rows a sink is taken to hold already."""
    return table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"
    )


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("resume_id"), F.col("text").alias("raw_text")
    )


def doc_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("resume_id"), F.col("text").alias("raw_text")
    )


def first_line(text: str = "text") -> Column:
    return F.get(F.split(text, "\n"), F.lit(0))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as a posting: first line = title, whole text = description."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("posting_id"), first_line().alias("title"),
        F.col("text").alias("description"), F.col("source").alias("company"),
    )


def keyed_postings(df: DataFrame) -> DataFrame:
    """Documents with their second line as link: blank for one-line texts, shared by copies."""
    return df.select(
        "doc_id", first_line().alias("title"), F.col("source").alias("company"),
        F.col("lang").alias("location"), F.lit("Internship").alias("type"),
        F.pmod("n_chars", F.lit(11)).cast("int").alias("match_score"),
        F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit("")).alias("link"),
        F.lit(None).cast("string").alias("date_posted"), F.col("source").alias("source"),
        F.lit(None).cast("string").alias("salary"), F.lit("").alias("description"),
    )


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a stored job with a score of 0..10."""
    status = F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv])
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_found"),
        status[F.col("o_orderstatus")].alias("application_status"),
        F.least(F.lit(10), F.floor(F.col("o_totalprice") / 45000)).cast("int").alias("match_score"),
    )


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _lines() -> Column:
    return F.split("text", "\n")


def _url(i: Column) -> Column:
    return F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string"), F.lit("/"), i.cast("string"))


#: Columns that payloads take over from tagged documents.
TAGS = ("tag_lang", "tag_src")


def _payload(df: DataFrame, source: str, body: Column, slug: Column | None = None,
             role: Column | None = None, url: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    # Bodies name the document's source src: a payload has a source of its own.
    return df.withColumnRenamed("source", "src").select(
        "doc_id", *[c for c in TAGS if c in df.columns], F.lit(source).alias("source"),
        (none if slug is None else slug).alias("slug"),
        (none if role is None else role).alias("role"),
        (none if url is None else url).alias("url"),
        F.lit(200).alias("status"), body.alias("body"),
    )


def thread_payloads(docs: DataFrame) -> DataFrame:
    """One thread per document, one comment per line; some comments carry a link."""
    child = lambda l, i: F.struct(
        (F.col("doc_id") * 1000 + i).alias("id"),
        F.concat(
            F.lit("<p>"), _escaped(l), F.lit("</p>"),
            F.when(l.contains("ea"), F.concat(F.lit('<a href="'), _url(i), F.lit('">more</a>'))).otherwise(""),
        ).alias("text"),
    )
    return _payload(docs, P.THREAD, F.to_json(F.struct(F.transform(_lines(), child).alias("children"))))


def board_a_payloads(docs: DataFrame) -> DataFrame:
    """One board per document; its location is an object, a text or missing by language."""
    def body(location: Column | None) -> Column:
        def job(l, i):
            fields = [l.alias("title"), _url(i).alias("absolute_url"),
                      F.when(l.contains("th"), F.lit("2026-02-01T10:00:00Z")).alias("updated_at")]
            if location is not None:
                fields.append(location.alias("location"))
            return F.struct(*fields)
        return F.to_json(F.struct(F.transform(_lines(), job).alias("jobs")))

    return _payload(
        docs, P.BOARD_A,
        F.when(F.col("lang") == "en", body(F.struct(F.col("src").alias("name"))))
        .when(F.col("lang") == "fr", body(F.col("src")))
        .otherwise(body(None)),
        slug=F.col("src"),
    )


def board_b_payloads(docs: DataFrame) -> DataFrame:
    job = lambda l, i: F.struct(
        l.alias("text"),
        F.struct(F.when(F.col("lang") != "de", F.col("lang")).alias("location")).alias("categories"),
        F.when(l.contains("e"), F.col("text")).alias("descriptionPlain"),
        _url(i).alias("hostedUrl"),
    )
    return _payload(docs, P.BOARD_B, F.to_json(F.transform(_lines(), job)), slug=F.col("src"))


def curated_json_payloads(docs: DataFrame) -> DataFrame:
    item = lambda l, i: F.struct(
        F.when(l.contains("the"), ~l.contains("that")).alias("active"),
        l.alias("title"),
        F.when(F.col("lang") != "es", F.col("src")).alias("company_name"),
        F.slice(F.split(l, " "), 1, F.pmod(i, F.lit(5))).alias("locations"),
        _url(i).alias("url"),
        F.when(l.contains("in"), F.lit("2026-01-15 08:00")).alias("date_posted"),
    )
    return _payload(
        docs, P.CURATED, F.to_json(F.transform(_lines(), item)),
        slug=F.col("doc_id").cast("string"), url=F.lit("list.json"),
    )


def table_text(docs: DataFrame) -> DataFrame:
    """Markdown per document: its lines as table headers, rule lines, plain lines or table rows."""
    row = lambda l, i: (
        F.when(l.contains(" the "), "| Company | Role | Location | Date |")
        .when(l.contains("que"), l)
        .when(l.contains("ung"), "|---|---|---|---|")
        .otherwise(
            F.concat(
                F.lit("| "), F.get(F.split(l, " "), F.lit(0)), F.lit(" | ["), l, F.lit("]("), _url(i),
                F.lit(") | "), F.col("lang"), F.when(l.contains("er"), F.lit(" | now |")).otherwise(F.lit(" |")),
            )
        )
    )
    return docs.withColumn(
        "markdown",
        F.concat(F.lit("| Company | Role | Location | Date |\n|---|---|---|---|\n"),
                 F.array_join(F.transform(_lines(), row), "\n")),
    )


def card_payloads(docs: DataFrame) -> DataFrame:
    """A result page per document, one card per line, answering the first role."""
    card = lambda l, i: F.concat(
        F.lit('<li class="x result-card"><h3 class="base-search-card__title"> <b>'), _escaped(l),
        F.lit("</b></h3>"),
        F.when(l.contains("e"), F.concat(
            F.lit('<h4 class="base-search-card__subtitle"><a>'), F.col("src"), F.lit("</a></h4>"))).otherwise(""),
        F.when(l.contains("th"), F.concat(
            F.lit('<a class="base-card__full-link" href="'), _url(i), F.lit('">go</a>'))).otherwise(""),
        F.when(l.contains("in"), F.lit('<time datetime="2026-02-03T00:00">x</time>')).otherwise(""),
        F.lit("</li>"),
    )
    return _payload(
        docs, P.CARDS,
        F.concat(F.lit("<html><body><ul>"), F.array_join(F.transform(_lines(), card), "\n"), F.lit("</ul></body></html>")),
        role=F.lit(ROLES[0]),
    )


def raw_payloads(docs: DataFrame) -> DataFrame:
    return (
        card_payloads(docs)
        .unionByName(thread_payloads(docs))
        .unionByName(board_a_payloads(docs))
        .unionByName(board_b_payloads(docs))
        .unionByName(curated_json_payloads(docs))
    )


def damaged_payloads(docs: DataFrame) -> DataFrame:
    """All payloads of the documents: French ones cut short, German ones not fetched, Spanish ones inside another object,
    English ones of src3 with other names for title and text, the others as they are.
    """
    # The tags meet the texts: the bodies written from them are many times as long.
    tagged = raw_payloads(docs.join(docs.select("doc_id", F.col("lang").alias(TAGS[0]), F.col("source").alias(TAGS[1])), "doc_id"))
    lang, src = map(F.col, TAGS)
    renamed = F.replace(F.replace("body", F.lit('"title"'), F.lit('"heading"')), F.lit('"text"'), F.lit('"words"'))
    body = (
        F.when(lang == "fr", F.expr("substr(body, 1, length(body) - 5)"))
        .when(lang == "es", F.concat(F.lit('{"other":'), "body", F.lit("}")))
        .when((lang == "en") & (src == "src3"), renamed)
        .otherwise(F.col("body"))
    )
    return tagged.withColumn("body", body).withColumn("status", F.when(lang == "de", 500).otherwise(200)).drop(*TAGS)


def project_text(c: Column) -> Column:
    """Documents rewritten into titled, bulleted and wrapped lines."""
    for a, b in ((". ", "\n- "), (" the ", "\nthe "), (" of ", " (of, 2023) "), (" in ", " (in, it) ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def experience_text(c: Column) -> Column:
    for a, b in ((". ", "\n"), (", ", " - "), (" and ", "\n- "), (" the ", " | May 2021 "),
                 (" la ", "\n  la 1999 "), (" is ", " — lead ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def education_text(c: Column) -> Column:
    for a, b in ((". ", "\n"), (" and ", "\nBachelor of "), (" the ", " GPA 3.5, "), (" de ", " May 2024 ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
