"""Table lexicons and rule tables against plain loops and the literal forms."""

import random

import pytest
from pyspark.sql import functions as F

from fitloom.functions.lexicons import ROLE_RULES, RoleRule
from fitloom.operators import lexicon as L, roles
from fitloom.plans.profiles import parse_profiles


def hits(spark, texts, words, **options):
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    w = spark.createDataFrame([(x,) for x in words], "word string")
    return sorted(tuple(r) for r in L.table_hits(t, w, **options).collect())


def test_equals_a_loop(spark):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcé \n|(東") for _ in range(n))
    texts = [make(rng.randrange(0, 60)) for _ in range(60)] + ["AbCa", "abc" * 4000, "", None]
    words = [make(rng.randrange(1, 7)) for _ in range(300)] + ["a", "東", "\U0001f600", "ABC", "abc", "x" * 50, ".", "a.c", "%", None, "", "abcabcabcabcé"]
    want = sorted((i, w) for i, t in enumerate(texts) if t for w in {x for x in words if x} if w.lower() in t.lower())
    assert hits(spark, texts, words + words) == want


def test_capitals_without_folding_and_empty_tables(spark):
    assert hits(spark, ["Some TEXT"], ["text", "TEXT", "Text"]) == [(0, "TEXT"), (0, "Text"), (0, "text")]
    assert hits(spark, ["Some TEXT"], ["text", "TEXT"], fold=False) == [(0, "text")]
    assert hits(spark, ["some text"], [None, ""]) == [] and hits(spark, [], ["a"]) == [] and hits(spark, ["a"], []) == []


def test_words_are_anchored_once_and_joined_by_equality(spark):
    words = spark.createDataFrame([(w,) for w in ("station", "nation", "ration", "at", "t")], "word string")
    rows = L.anchors(words).collect()
    assert len(rows) == 5 and all(r["gram"] in r["key"] for r in rows)
    assert {r["word"]: r["size"] for r in rows} == {"station": 4, "nation": 4, "ration": 4, "at": 2, "t": 1}
    assert len({r["gram"] for r in rows}) == 5  # each has a gram that no other word holds
    texts = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    plan = L.table_hits(texts, words)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_few_words_equal_many(spark, monkeypatch):
    rng = random.Random(9)
    alphabet = "ab_é \n|(.$^\\E\U0001f600東"
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [make(rng.randrange(0, 80)) for _ in range(80)] + ["\\Q", "", None]
    words = [make(rng.randrange(1, 7)) for _ in range(60)] + ["_", "\\E", "\\", "$a", "^", "\n", "\U0001f600", "a\U0001f600b_.", "a", "b", "ab", None, ""]
    want = sorted((i, w) for i, t in enumerate(texts) if t for w in {x for x in words if x} if w.lower() in t.lower())
    assert hits(spark, texts, words) == want
    monkeypatch.setattr(L, "FEW", 0, raising=False)
    assert hits(spark, texts, words) == want


def test_few_words_meet_a_text_where_it_was_read(spark):
    texts = spark.createDataFrame([(1, "a north wind"), (1, "the south"), (None, "north")], "doc_id long, text string")
    found = L.table_hits(texts, spark.createDataFrame([("north",), ("th",)], "word string"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, "north"), (1, "th"), (1, "th")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1 and ".{" not in plan


def test_keywords_are_made_once(spark):
    texts = spark.createDataFrame([(1, "py", "sql go"), (2, "", None)], "doc_id int, text string, words string").select(
        "doc_id", "text", F.split("words", " ").alias("kws"))
    found = L.match_rules(texts, L.rules_table(spark, RULES), keywords="kws")
    assert {(r["doc_id"], r["role"], r["matches"]) for r in found.collect()} == {(1, "A", 2), (1, "A", 1)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(words") == 1


RULES = [RoleRule("A", 2, ("py", "sql", "py", "c++")), RoleRule("B", 1, ("Java", "java")), RoleRule("A", 1, ("go",)), RoleRule("C", 0, ("zz",))]


def test_rules_equal_the_literal_form(spark):
    texts = spark.createDataFrame([(1, "py sql", []), (2, "PYTHON and C++", ["x"]), (3, "java go", None), (4, None, ["py", "sql", "go"]), (5, "", [])],
                                  "doc_id int, text string, kws array<string>")
    got = {(r["doc_id"], r["rule_ord"], r["matches"]) for r in L.match_rules(texts, L.rules_table(spark, RULES), keywords="kws").collect()}
    literal = texts.select("doc_id", F.inline(roles.rule_matches(
        F.coalesce("kws", F.array().cast("array<string>")), F.lower(F.coalesce("text", F.lit(""))), RULES))).collect()
    assert got == {(r["doc_id"], r["rule_ord"], r["matches"]) for r in literal if r["matches"]}


@pytest.mark.parametrize("cap", [1, 2, 8])
def test_ranked_roles_equal_the_literal_form(spark, cap):
    texts = ["Dee Dev\nPython, Django and Flask backend api work with SQL and docker\npython sql", "pandas numpy tableau analytics with sql and excel",
             "nothing", "Java python c++ react aws docker kubernetes machine learning tensorflow", ""]
    resumes = spark.createDataFrame([(str(i), t, "f") for i, t in enumerate(texts)], "resume_id string, raw_text string, source_file string")
    profiles = parse_profiles(resumes)
    read = lambda df: sorted(tuple(r) for r in df.select("resume_id", "rank", "role", "matches").collect())
    assert read(L.infer_roles(profiles, L.rules_table(spark, ROLE_RULES), cap=cap)) == read(roles.infer_roles(profiles, cap=cap))
