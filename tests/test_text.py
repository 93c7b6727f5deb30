from pyspark.sql import functions as F

import pytest

from fitloom.functions import text as X
from fitloom.functions.lexicons import KEYWORD_STOP_WORDS, LANGUAGES, LEVEL_RULES, TECHNOLOGIES, DOMAINS


@pytest.fixture
def value(spark):
    def get(text, column):
        return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]
    return get


def test_tokens(value):
    text = "c++ and c#, node.js. python. 3d r&d scikit-learn éa aé _x next.js-"
    assert value(text, X.tokens) == [
        "c", "and", "c", "node.js", "python", "r", "d", "scikit-learn", "aé", "next.js"]
    assert value("ci/cd", X.tokens) == ["ci", "cd"]
    assert value("", X.tokens) == []


def test_strip_takes_all_white_space(value):
    assert value(" \t x y \r\n", X.strip) == "x y"


def test_lexicon_is_substring_longest_first(value):
    assert value("Spring Boot, REST", lambda c: X.lexicon_hits(c, TECHNOLOGIES)) == [
        "spring boot", "spring", "rest"]
    assert value("Rust", lambda c: X.lexicon_hits(c, LANGUAGES)) == ["rust", "r"]
    assert value("rust", lambda c: X.lexicon_hits(c, LANGUAGES, mode="token")) == ["rust"]


def test_domains_in_map_order(value):
    assert value("SQL and ML", lambda c: X.domain_hits(c, DOMAINS)) == ["machine learning", "database"]


def test_contacts(value):
    text = "x a.b+c@d-e.org (415) 555-1234"
    assert value(text, X.email) == "a.b+c@d-e.org"
    assert value(text, X.phone) == "(415) 555-1234"
    assert value("none", X.email) is None and value("none", X.phone) is None


@pytest.mark.parametrize("text,want", [
    ("\n  \n jane@x.org\nhttp page\n Jo O'Neil-Ray \nOther", "Jo O'Neil-Ray"),
    ("123\n" + "a" * 50, "Unknown"),
])
def test_name_line(value, text, want):
    assert value(text, X.name_line) == want


def test_keywords_count_then_first_place(value):
    text = "beta alpha Beta gamma the the the alpha xx xx once"
    got = value(text, lambda c: X.top_keywords(c, KEYWORD_STOP_WORDS))
    assert [(k.word, k.n) for k in got] == [("beta", 2), ("alpha", 2)]
    assert value("", lambda c: X.top_keywords(c, KEYWORD_STOP_WORDS)) == []


def test_keywords_cut_before_count_test(value):
    words = [f"w{i:02}" for i in range(40)]
    got = value(" ".join(words * 2), lambda c: X.top_keywords(c, ()))
    assert [k.word for k in got] == words[:30]


@pytest.mark.parametrize("text,n,want", [
    ("Director at a University", 0, "student"), ("Principal", 0, "senior"), ("3+ years", 0, "mid-level"),
    ("x", 3, "mid-level"), ("x", 1, "entry-level"), ("x", 0, "student"),
])
def test_level(value, text, n, want):
    assert value(text, lambda c: X.experience_level(c, F.lit(n), LEVEL_RULES)) == want


def test_small_formats(value):
    assert value("weights-and-biases", X.display_name) == "Weights And Biases"
    assert value("mid-level", X.level_label) == "Mid-Level"
    assert value("Acme AI!", X.path_key) == "acme_ai"
    assert value("7", X.stars) == "★★★★★★★☆☆☆"


def test_skill_overlap_repeats(value):
    lists = [F.array(F.lit("Python"), F.lit("SQL")), F.array(F.lit("Python")), F.array(F.lit("Go"))]
    assert value("use python", lambda c: X.skill_overlap(*lists, c)) == ["Python"]
    assert value("use python", lambda c: X.skill_overlap(*lists, c, repeats=True)) == ["Python", "Python"]


def test_words_are_counted_by_run_and_ranked_by_first_sight(spark):
    text = "Beta alpha beta. ALPHA gamma delta gamma the the the of é1 zeta"
    got = spark.createDataFrame([(text,), ("",), (None,), ("one",)], "t string").select(
        F.transform(X.word_counts(F.col("t"), ("the",)), lambda r: F.struct("t", r["word"].alias("word"), r["n"].alias("n"))).alias("c"),
        X.top_keywords(F.col("t"), ("the",), 2).alias("k")).collect()
    assert {(r.word, r.n) for r in got[0].c} == {("beta", 2), ("alpha", 2), ("gamma", 2), ("delta", 1), ("zeta", 1)}
    assert [(r.word, r.n) for r in got[0].k] == [("beta", 2), ("alpha", 2)]
    assert got[1].c == [] and got[1].k == [] and got[2].c is None and got[2].k is None and got[3].k == []


def test_an_address_is_found_from_where_its_characters_begin(spark):
    texts = ["no", "a@b @c.de x@y.z", "..%a.b@c.example.org, d@e.fr", "a@b@c.de", "ü.x@y.com", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.email(F.col("t")).alias("e")).collect()
    assert [r.e for r in sorted(rows)] == [None, None, "..%a.b@c.example.org", "b@c.de", ".x@y.com", None]
