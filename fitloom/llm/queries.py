"""The registered queries of the training-data operators: whole tables, production parameters, full results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.llm import alignment, bpe, decontaminate, maxent, pii, quality, secrets, simhash, spans, spelling, toolcalls, urlfilter, vectors
from fitloom.llm.common import table

#: Fixed values of the URL rules: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
TOOL_SCHEMAS = [("ask", "text", "string", True), ("ask", "turn", "integer", True),
                ("follow", "text", "string", True), ("follow", "turn", "integer", True), ("follow", "after", "string", True)]


def op1_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """User turns are calls of ask or follow, which need the call before; the assistant's next turn is the result."""
    turns = table(spark, d, "conversations")
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    later, turn = F.col("turn") >= 2, F.col("turn")
    before = F.when(later, name(turn - 2))
    calls = turns.where("role = 'user'").select(
        "conv_id", name(turn).alias("call_id"), F.when(later, "follow").otherwise("ask").alias("tool"),
        F.to_json(F.struct("turn", "text", before.alias("after"))).alias("arguments"),
        F.when(later, F.array(before)).otherwise(F.array().cast("array<string>")).alias("needs"), turn.alias("place"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), F.col("text").alias("content"), turn.alias("place"))
    schemas = spark.createDataFrame(TOOL_SCHEMAS, "tool string, field string, type string, required boolean")
    return toolcalls.link(calls, results, schemas).select(
        "conv_id", "call_id", "tool", F.col("level").cast("long").alias("level"), "place", "valid", "n_missing", "n_results",
        F.sha2("arguments", 256).alias("arguments_sha256"), F.sha2("content", 256).alias("content_sha256"))


def op2_sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.dedup_spans(table(spark, d, "documents"))


def op3_benchmark_index(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"), 10).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_simhash_anchors(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"), 4, 4).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests_only=True)


def op6_secret_forest(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(table(spark, d, "documents")).select(
        "doc_id", "start", "n", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "label", "probability", "is_secret")


def op7_url_trie(spark: SparkSession, d: str) -> DataFrame:
    return urlfilter.judge(table(spark, d, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_pii_boosting(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return pii.find(documents, pii.fit_all(documents))


def op9_quality_network(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    return quality.scores(documents, table(spark, d, "labels")).select(
        "doc_id", F.coalesce(~quality.train_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_projection_passes(spark: SparkSession, d: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, d, "embeddings"))


def op11_trie_frontier(spark: SparkSession, d: str) -> DataFrame:
    return spelling.group_variants(table(spark, d, "documents"))


def op12_hashed_maxent(spark: SparkSession, d: str) -> DataFrame:
    return maxent.score(table(spark, d, "documents"))


def op13_fragment_monoid(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_tool_calls, op2_sentence_spans, op3_benchmark_index, op4_simhash_anchors, op5_byte_bpe,
                                   op6_secret_forest, op7_url_trie, op8_pii_boosting, op9_quality_network, op10_projection_passes, op11_trie_frontier, op12_hashed_maxent, op13_fragment_monoid)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op1_tool_calls": """
        WITH RECURSIVE calls AS (
          SELECT conv_id, turn, conv_id || ':' || turn AS call_id, text, CASE WHEN turn >= 2 THEN 'follow' ELSE 'ask' END AS tool,
                 CASE WHEN turn >= 2 THEN conv_id || ':' || (turn - 2) END AS need
          FROM conversations WHERE role = 'user'),
        results AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, turn, text FROM conversations WHERE role = 'assistant'),
        leveled AS (
          SELECT call_id, 0 AS level FROM calls WHERE need IS NULL OR need NOT IN (SELECT call_id FROM calls)
          UNION ALL SELECT c.call_id, l.level + 1 FROM leveled l JOIN calls c ON c.need = l.call_id)
        SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, tool, level::BIGINT AS level,
               coalesce(c.turn, r.turn) AS place, c.call_id IS NOT NULL AS valid,
               CASE WHEN need IS NOT NULL AND need NOT IN (SELECT call_id FROM calls) THEN 1 ELSE 0 END::BIGINT AS n_missing,
               CASE WHEN r.call_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_results,
               sha256(CASE WHEN c.call_id IS NULL THEN '{}' ELSE '{' || CASE WHEN need IS NULL THEN '' ELSE '"after":"' || need || '",' END
                 || '"text":' || to_json(c.text)::VARCHAR || ',"turn":' || c.turn || '}' END) AS arguments_sha256,
               CASE WHEN r.text IS NOT NULL THEN sha256(r.text) END AS content_sha256
        FROM calls c FULL JOIN results r USING (conv_id, call_id) LEFT JOIN leveled l ON l.call_id = c.call_id""",
    "op3_benchmark_index": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        windows AS (
          SELECT DISTINCT item_id, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g, least(len(w), 10) AS n
          FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
        widths AS (SELECT DISTINCT n FROM windows),
        grams AS (
          SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, widths WHERE len(w) >= n)),
        hits AS (SELECT doc_id, item_id, s, n FROM grams JOIN windows USING (g, n)),
        places AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits),
        n_hits AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n_hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_url_trie": r"""
        WITH u AS (
          SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        best AS (
          SELECT page_id, arg_max(h || p, len(h || p)) AS rule, arg_max(verdict, len(h || p)) AS verdict
          FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id)""",
    # The crc32 of a string is a walk over its bytes with the table of the reversed polynomial 0xEDB88320.
    "op11_trie_frontier": r"""
        WITH RECURSIVE steps(i, k, c) AS (
          SELECT i, 0, i FROM range(256) r(i) UNION ALL
          SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
        t AS (SELECT list(c ORDER BY i) AS crc FROM steps WHERE k = 8),
        runs AS (
          SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
          FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
        hashed AS (
          SELECT run, k, xor(4294967295, list_reduce(
            list_transform(range(1, strlen(s) + 1), lambda i: ('0x' || hex(encode(s))[2 * i - 1:2 * i])::BIGINT),
            lambda h, b: xor(h >> 8, crc[xor(h & 255, b) + 1]), 4294967295)) AS h
          FROM (SELECT run, k, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs WHERE length(run) >= 6), t),
        words AS (
          SELECT CASE WHEN h % 199 = 0 THEN run[:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word, sum(k)::BIGINT AS n
          FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND n >= 5),
        keys AS (
          SELECT word, n, i, word[:i - 1] || chr(1) || word[i + 1:] AS k FROM words, range(1, 10000) r(i) WHERE i <= length(word)
          UNION ALL SELECT word, n, i, word[:i - 1] || word[i + 1:] FROM words, range(1, 10000) r(i) WHERE i <= length(word)),
        pairs AS (
          SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM keys a JOIN keys b USING (k) WHERE a.word <> b.word AND length(a.word) = length(b.word) AND contains(k, chr(1))
          UNION SELECT a.word, b.word, b.n FROM keys a JOIN words b ON a.k = b.word
          UNION SELECT b.word, a.word, a.n FROM keys a JOIN words b ON a.k = b.word),
        best AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM pairs GROUP BY word),
        forms AS (
          SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN most END AS form_n,
                 CASE WHEN most >= 5 * w.n THEN (SELECT min(near) FROM pairs p WHERE p.word = w.word AND p.near_n = best.most) END AS form
          FROM words w LEFT JOIN best USING (word)),
        chain(word, place, hops) AS (
          SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, hops + 1 FROM chain c JOIN forms f ON f.word = c.place WHERE f.form IS NOT NULL),
        roots AS (SELECT word, arg_max(place, hops) AS root FROM chain GROUP BY word)
        SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN roots USING (word)""",
    "op10_projection_passes": """
        WITH RECURSIVE v AS (
          SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
          WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
        reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
        low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
               vec_id <= coalesce(low.b, vec_id) AS kept
        FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id""",
}
