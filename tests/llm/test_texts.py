"""Operators that read one text or url at a time: brute force, round trips, held-out accuracy, defined cases."""

import hashlib
import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from fitloom.llm import bpe, pii, quality, secrets, toolcalls, urlfilter
from fitloom.llm.queries import URL_RULES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, score string, label string, n long"  # the last three clash with inner names


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "l", 1) for i, t in rows], DOCS)


def test_tokens_equal_the_library_and_decode_to_the_text(spark):
    rng = random.Random(1)
    alphabet = list(" \n\t\r\x0b\x1c\x85\xa0    ab'sStTre1½²٣éÉ漢😀.,!-_") + ["<|endoftext|>", " the", "'ll "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += [None, "", "a" * 3000, "ab" * 400 + " " + "x" * 301, "".join(rng.choice("abcdefgh") for _ in range(3000)), " " * 999, "\n" * 300 + "a", texts[0]]
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = bpe.encode(docs(spark, list(enumerate(texts))), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = known.encode_ordinary(text)
        assert list(r["ids"] or []) == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(docs(spark, []), RANKS, public_tokenizers.PATTERN, digests_only=True).count() == 0


def test_chunks_rejoin():
    rng = random.Random(2)
    for _ in range(500):
        t = "".join(rng.choice("a \n.\x1c") for _ in range(rng.randrange(15)))
        assert "".join(bpe.chunks_of(t)) == t


def test_forgetting_codec_gives_the_same(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    texts = ["one two three four five six", "six five four, three two one", ""]
    small = bpe.Codec(RANKS, public_tokenizers.PATTERN).encode(texts)
    assert [raw.decode() for *_, raw in small] == texts


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(9)
    parts = list("0123456789+-. @()aZ_%é") + ["4111 1111 1111 1111", "4111-1111-1111-1111 ", "192.168.0.1", "+1 (499) 555-6503", "a.b@c-d.org", "256.1.1.1", "@@", "0000"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+" * 100_000, "1 " * 100_000, "%" * 200_000 + "@x"):
        pii.base_spans(text)


def test_spans_are_added_and_base_spans_stay(spark):
    rng = random.Random(4)
    number = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    rows = [(i, f"call +1 {number()} or see /{rng.randrange(10**4)}.{rng.randrange(10**4)}-{rng.randrange(10**4)} at 999.{i % 250}.4.900") for i in range(300)]
    rows += [(900, f"call {number()} now"), (901, None), (902, ""), (903, "nothing here"), (900, "x")]
    df = docs(spark, rows)
    got = {(r["doc_id"], r["spans"]): r for r in pii.find(df, pii.fit(df), mask=True).collect()}
    assert len(got) == len(rows)
    for (i, spans), r in got.items():
        text = dict(rows[:-1])[i] if spans or i != 900 else "x"
        base = ",".join("%s:%d:%d" % s for s in pii.base_spans(text or ""))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(spans.split(","))
    assert any(i == 900 and s.startswith("phone:5:") and "[phone]" in r["redacted"] for (i, s), r in got.items())
    assert got[(903, "")]["redacted"] == "nothing here"
    empty = df.limit(0)
    assert pii.find(empty, pii.fit(empty)).count() == 0


def test_pii_sample_is_the_lowest_hashes_whatever_the_size(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('call ', id) AS text")
    df = df.unionByName(df.where("doc_id < 500")).repartition(7)
    monkeypatch.setattr(pii, "Model", lambda texts: texts)
    hashed = {r["text"]: r["h"] for r in df.selectExpr("xxhash64(doc_id, text) AS h", "text").distinct().collect()}
    for sample in (40, 400, 5000):
        assert pii.fit(df, sample) == sorted(hashed, key=hashed.get)[:sample]


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fits, default=(0, 0, None, "allow"))
    return host, path, rule, verdict


@pytest.mark.parametrize("size", [2, 100])
def test_urls_equal_a_scan_of_all_rules(spark, monkeypatch, size):
    monkeypatch.setattr(urlfilter, "TRIE_RULES", size)
    urls = [None, "", "no scheme", "://", "http://", "http://org", "http://ORG/", "https://a.example.org/es/x?q", "http://example.org/es", "http://example.org/en/12#t",
            "http://xexample.org/en/1", "http://a.b.com/fr/", "http://com/de/1", "x://y://com/de/", "http://com?/de/", "http://É.com/de//", "http://example.org/en/1\n/x", "http://a..org/"]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df, URL_RULES).collect()}
    assert got == {i: plain_rule(u) for i, u in enumerate(urls)}
    assert urlfilter.judge(df.limit(0), URL_RULES).count() == 0 and {r["verdict"] for r in urlfilter.judge(df, []).collect()} == {"allow"}


def test_quality_tells_held_out_texts_apart(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "river", "house", "walks", "green", "slowly"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "now!!", "$$$", "click", "WIN***", "free###"]) for _ in range(60))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(600)] + [(700, None), (701, ""), (None, good())]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(600)] + [(1, 1), (None, 0), (5, None), (9999, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.scores(docs(spark, rows), labels, 200).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values()) and got[700] == got[701]
    assert sum((got[i] >= 0.5) == (i % 4 != 0) for i in range(600)) >= 595
    kept = quality.keep_good(docs(spark, rows), labels)
    assert kept.columns == docs(spark, rows).columns
    assert quality.scores(docs(spark, []), labels).count() == 0
    assert {r["score"] for r in quality.scores(docs(spark, rows), labels.where("quality = 1")).collect()} == {1.0}


def test_secrets_are_found_and_masked(spark):
    rng = random.Random(7)
    code = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, planted = [], {}
    for i in range(200):
        secret = f"AKIA{code(16).upper()}" if i % 3 == 0 else code(40)
        planted[i] = secret
        start = secret if i % 3 == 0 else f'token = "{secret}"' if i % 3 == 1 else f"password={secret}"
        rows.append((i, f"some words {start} then mail{i}1@example.com and /path/{code(12)}/x.html call 4155550{i:04d}1 done {secret}."))
    rows += [(300, None), (301, ""), (302, "plain words only"), (0, rows[0][1]), (None, rows[1][1])]
    df = docs(spark, rows)
    found = secrets.scan(df).collect()
    hit = {(r["doc_id"], r["value"]) for r in found if r["is_secret"]}
    assert {(i, s) for i, s in planted.items()} <= hit and all(v in planted.values() for _, v in hit)
    assert all(r["n"] == 2 for r in found if r["is_secret"])
    masked = secrets.redact(df)
    assert masked.columns == df.columns
    for r in masked.collect():
        if r["doc_id"] in planted:
            assert planted[r["doc_id"]] not in r["text"] and f"mail{r['doc_id']}1@example.com" in r["text"]
        elif r["doc_id"] is not None:
            assert r["text"] == dict(rows[:203])[r["doc_id"]]
    assert secrets.scan(df.limit(0)).count() == 0 and secrets.redact(df.limit(0)).count() == 0
    assert secrets.scan(docs(spark, [(1, "a password=abc12345 here")])).where("is_secret").count() == 1


def test_no_python_in_the_native_plans(spark):
    df = docs(spark, [(1, 'token = "0123456789abcdef0123"')])
    plan = secrets.redact(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


CALL = "conv_id long, call_id string, tool string, arguments string, needs array<string>, place long"


def test_calls_are_linked_ordered_and_checked(spark):
    calls = spark.createDataFrame([
        (1, "a", "get", '{"z": 1.5, "a": "x\\"y", "n": {"b":2}}', [], 1), (1, "b", "get", '{"a": 3}', ["a", "a"], 2), (1, "c", "get", "no json", ["a", "b", "zz"], 3),
        (1, "d", "get", None, ["e"], 4), (1, "e", "get", '["x"]', ["d"], 5), (1, "f", "put", "{}", ["d"], 6), (1, "a", "late", "{}", None, 9),
        (2, "a", "get", '{"a":"é","extra":null}', None, 1), (None, "x", "get", "{}", [], 1), (3, None, "get", "{}", [], 1)], CALL)
    results = spark.createDataFrame([(1, "a", "first", 2), (1, "a", "second", 3), (1, "q", "alone", 4), (2, "a", None, 2), (None, "a", "x", 1)],
                                    "conv_id long, call_id string, content string, place long")
    schemas = spark.createDataFrame([("get", "a", "string", True), ("get", "z", "number", False), ("get", "n", "object", False)],
                                    "tool string, field string, type string, required boolean")
    got = {(r["conv_id"], r["call_id"]): r for r in toolcalls.link(calls, results, schemas).collect()}
    assert {k: r["level"] for k, r in got.items()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): None, (1, "e"): None, (1, "f"): None, (1, "q"): None, (2, "a"): 0}
    a = got[(1, "a")]
    assert (a["valid"], a["n_results"], a["content"], a["arguments"]) == (True, 2, "first", '{"a":"x\\"y","n":{"b":2},"z":1.5}')
    assert a["message"] == '{"arguments":' + a["arguments"] + ',"id":"a","name":"get","result":"first"}'
    assert got[(1, "b")]["problems"] == ["type of a"] and got[(1, "c")]["n_missing"] == 1 and not got[(1, "c")]["valid"]
    assert got[(1, "e")]["arguments"] == "{}" and got[(2, "a")]["problems"] == ["unknown extra"] and got[(1, "q")]["tool"] is None
    assert toolcalls.link(calls.limit(0), results.limit(0), schemas).count() == 0


def test_levels_of_long_chains_and_cycles(spark):
    needs = {**{str(i): [str(i - 1)] if i else [] for i in range(40)}, "two": ["39", "5"], "over": ["two"], "x": ["y"], "y": ["x"], "z": ["x", "3"], "free": ["absent"]}
    want = {**{str(i): i for i in range(40)}, "two": 40, "over": 41, "x": None, "y": None, "z": None, "free": 0}
    calls = spark.createDataFrame([(1, k, v) for k, v in needs.items()], "conv_id int, call_id string, needs array<string>")
    assert {r.call_id: r.level for r in toolcalls.levels(calls).collect()} == want


def test_byte_pair_matches_are_spelled_by_columns_and_cut_without_a_search():
    worker = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    ranks = bpe.read_ranks(RANKS)
    toks = pa.array([[ranks[b"a"], ranks[b"b"]], [ranks[b" "]], [ranks[b"\xff"]]], pa.list_(pa.int32()))
    assert worker.spelled(toks) == ([f"{ranks[b'a']} {ranks[b'b']}", str(ranks[b" "]), str(ranks[b"\xff"])], [b"ab", b" ", b"\xff"])
    assert not any(map(bpe._ODD, ("a\n\nb c", "\na b\n", "a\tb")))
    assert all(map(bpe._ODD, ("a  b", "a \nb", "a\n b", "a b ")))
    assert bpe.chunks_of(" a  b c ") == [" a  b", " c "] and bpe.chunks_of("a\n\nb c") == ["a\n\nb", " c"]


def test_matches_are_kept_beside_any_number_of_chunks_and_plain_words_need_no_search(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 12)
    worker = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    merge, split, merged, searched = worker.merge, worker.split, [], []
    worker.merge = lambda matches: merged.append(len(matches)) or merge(matches)
    worker.split = lambda chunk: searched.append(chunk) or split(chunk)
    worker.matches = lambda chunk, plain=worker.matches: searched.append(chunk) or plain(chunk)
    words = ["erntly", "whessh", "tionoire", "boring", "ueco"]
    slices = [["".join(f" {w}{mark}" for w in words)[1:] for mark in marks] for marks in (("", ".", ",", "!"), ("?", ";"), (":", ""))]
    for texts in slices:
        assert worker.encode(texts) == [(" ".join(map(str, ids)), len(ids), t.encode()) for t in texts for ids in [known.encode_ordinary(t)]]
    # Five words and three marks, then only the new marks: no match goes to the queries twice.
    assert merged == [8, 2, 1] and not searched
    # What has a space at an edge, two spaces, other letters or figures is searched, in the texts' order; an empty text is none.
    texts = ["", "ueco 3 é. it's", " a", "b  c", "ueco", "", "d \n e.\nF", "whessh, ueco."]
    assert worker.encode(texts) == [(" ".join(map(str, ids)), len(ids), t.encode()) for t in texts for ids in [known.encode_ordinary(t)]]
    assert set(searched) >= {" 3", " é.", " it's", "b  c"} and "ueco" not in searched
    assert worker.encode([]) == [] and worker.encode(["", ""]) == [("", 0, b"")] * 2
