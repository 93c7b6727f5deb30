"""What large inputs ask of the plans: wide rows stay where they were read."""

import collections
import glob
import json

import pyarrow as pa
from pyspark.sql import functions as F

from fitloom import schemas
from fitloom.catalog import inputs as I
from fitloom.functions import markup
from fitloom.functions.lexicons import MatchTerms
from fitloom.llm import pii
from fitloom.operators import lexicon
from fitloom.plans import discovery, search
from fitloom.session import shared_dir
from fitloom.sources import payloads as P


def day():
    return F.lit("2026-03-12").cast("date")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_settled_in_their_own_row(spark):
    posts = [  # title, link, role, role_ord, seq
        ("python intern", "u1", "A", 0, 1), ("python intern", "u1", "B", 1, 0), ("java intern", "u1", None, 9, 0),
        ("python intern", "", "A", 0, 2), ("python intern", "", "A", 0, 2), ("python intern", "u2", "C", 2, 0), ("python", None, "A", 0, 3)]
    postings = spark.createDataFrame(
        [(t, "C", "L", "I", None, "python sql spark", u, None, "s", r, o, 0, n) for t, u, r, o, n in posts], schemas.POSTING)
    profiles = spark.createDataFrame([(1, "python sql spark"), (2, "python sql spark"), (None, "python sql spark")], "resume_id long, raw_text string")
    roles = spark.createDataFrame([(1, "B", 1), (1, "A", 2)], "resume_id long, role string, rank int")
    found = discovery.match_offered(profiles, roles, postings, MatchTerms(), 0)
    got = sorted((r["resume_id"], r["link"], r["role"] or "", r["role_ord"], r["seq"], r["title"]) for r in found.collect())
    assert got == [(1, "", "A", 1, 2, "python intern"), (1, "", "A", 1, 2, "python intern"), (1, "u1", "B", 0, 0, "python intern"),
                   (2, "u1", "", 9, 0, "java intern")]
    assert "Window" not in optimized(found) and "sha2" not in optimized(found)


def test_turns_change_nothing_and_keep_only_what_is_read(spark, monkeypatch):
    own_dir = shared_dir(spark).removeprefix("file:")
    folders = lambda: {f for f in glob.glob(f"{own_dir}/fitloom-*/*") if glob.glob(f"{f}/**/*.parquet", recursive=True)}
    posts = [(t, f"u{i % 9}" if i % 4 else "", r, o, i % 3) for i in range(60) for t, r, o in (("python intern", "A", 0), ("java intern", None, 9))]
    postings = spark.createDataFrame(
        [(t, "C", "L", "I", None, "python sql spark", u, None, "s", r, o, 0, n) for t, u, r, o, n in posts], schemas.POSTING)
    # A resume that comes twice has its matches twice, and at a place without a link once per named role.
    profiles = spark.createDataFrame([(1, "python sql spark"), (2, "sql"), (2, "sql"), (None, "sql")], "resume_id long, raw_text string")
    roles = spark.createDataFrame([(1, "B", 1), (2, "A", 1), (2, "A", 1)], "resume_id long, role string, rank int")
    monkeypatch.setattr(discovery, "PARTS", 3, raising=False)
    seen = []
    for rows in (1000, 1):
        monkeypatch.setattr(discovery, "ROUND_ROWS", rows, raising=False)
        before = folders()
        found = discovery.match_offered(profiles, roles, postings, MatchTerms(), 0)
        # The resumes' roles and tokens, and what each turn found.
        assert len(folders() - before) <= 2 + (1 if rows == 1000 else 3)
        seen.append(collections.Counter((r["resume_id"], r["link"], r["role"], r["role_ord"], r["seq"], r["title"]) for r in found.collect()))
    assert seen[0] == seen[1]
    assert {k[0] for k in seen[0]} == {1, 2}
    at = lambda who, link, role: sum(n for k, n in seen[0].items() if k[:3] == (who, link, role))
    assert (at(1, "", "A"), at(1, "", None), at(2, "", "A"), at(2, "", None)) == (0, 15, 60, 30)
    assert all((at(1, f"u{i}", "A"), at(1, f"u{i}", None), at(2, f"u{i}", "A"), at(2, f"u{i}", None)) == (0, 1, 2, 0) for i in range(9))


def test_capped_boards_are_chosen_before_their_items(spark):
    bodies = [("b0", ["x er", "y"]), ("b1", ["z er", "w er"]), ("b2", ["v er"])]
    rows = [(s, b, None, None, 200, None, json.dumps(items if s == P.BOARD_B else {"jobs": items})) for s, key in ((P.BOARD_A, "title"), (P.BOARD_B, "text"))
            for b, titles in bodies for items in [[{key: t} for t in titles]]]
    raw = spark.createDataFrame(rows, schemas.RAW_PAYLOAD)
    slugs = ["b0", "b1", "b2"]
    for read in (P.board_a_postings, P.board_b_postings):
        part = read(raw, ["er", "x"], day(), slugs, 2, "er")
        got = sorted((r["role"], r["title"]) for r in part.collect())
        # Board a: per role until two rows were found; board b: the same boards for all roles.
        wide = [("er", "w er"), ("er", "x er"), ("er", "z er")]
        assert got == wide + ([("x", "x er")] if read is P.board_a_postings else [("x", t) for _, t in wide])
        join = optimized(part).split("Join", 1)[1].split("\n", 1)[0]
        assert "broadcast" in join


def test_what_was_read_is_read_once(spark):
    raw = spark.createDataFrame([(P.CURATED, "s", None, "l.json", 200, None, json.dumps([{"title": "t", "url": u} for u in ("", "a", "a")]))], schemas.RAW_PAYLOAD)
    found = search.collect_postings(raw, ["dev"], day())
    assert sorted(r["link"] for r in found.collect()) == ["", "a"] and "from_json" not in optimized(found)


def test_tags_meet_texts_not_bodies(spark):
    rows = [(1, "a b\nthe c", "en", "src3", 9), (1, "d", "fr", "src1", 1), (2, None, "de", "s", None), (None, "x", "es", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    damaged = I.damaged_payloads(docs)
    assert damaged.groupBy("source").count().where("count <> 5").count() == 0
    assert damaged.columns == ["doc_id", "source", "slug", "role", "url", "status", "body"]
    below = optimized(damaged).split("Join", 1)[1].split("Join", 1)[0].split("Union")[0]
    assert "to_json" not in below.split("Project")[-1]


def test_cards_are_objects_for_a_slice_at_a_time(monkeypatch):
    held = []
    monkeypatch.setattr(markup, "SLICE_CHARS", 100)
    monkeypatch.setattr(markup.pa, "array", lambda rows, kind, make=pa.array: held.append(len(rows)) or make(rows, kind))
    page = '<li class="result-card"><h3 class="base-search-card__title">T</h3></li>'
    pages = pa.Array.from_pandas([page, None, page] * 20)
    got = markup.card_reader().func(pages)
    assert [len(c) for c in got.to_pylist()] == [1, 0, 1] * 20 and got[0][0]["title"].as_py() == "T"
    assert max(held) <= 4


def test_a_small_lexicon_moves_no_grams(spark):
    texts = spark.createDataFrame([(1, "a north wind"), (2, "the south"), (3, None)], "doc_id long, text string")
    found = lexicon.table_hits(texts, spark.createDataFrame([("north",), ("th",)], "word string"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, "north"), (1, "th"), (2, "th")]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("BroadcastHashJoin") < plan.index("regexp_extract_all")


def test_pii_learns_from_every_row(spark, monkeypatch):
    text = "call 555-123-4567 or +1 555 123 4567, card 4111 1111 1111 1111, no card 1234 5678 1234 5678 9"
    texts = [(i, f"{text} {i % 7}") for i in range(4000)] + [(9999, None), (9998, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(pii.Model, "of_counts", classmethod(lambda cls, *counts: seen.append(counts)))
    for groups in (pii.GROUPS, 3):
        pii.fit_all(df, groups)
    n = sum(1 for _, t in texts for _ in pii.labelled(t or ""))
    assert n > 4000 and [sum(c[2]) for c in seen] == [n, n] and len(seen[1][0]) <= 3
