"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside Spark tasks.

A text is cut at single spaces between words, where no match of the split pattern can cross, and the
distinct chunks of a slice of texts into the pattern's matches. Distinct matches not met before in the
task go to DuckDB: a recursive query joins the token pairs of each with the merge table and contracts its
leftmost pair of least rank until no pair is left. Long matches contract all non-overlapping pairs of the
least rank in one step, left to right, which gives the same tokens. Tokens' bytes are looked up and joined
as Arrow columns, to matches, chunks and texts in turn; matches met lately are kept as columns as well.

Null texts are encoded as empty ones; empty texts have no tokens. Rows may repeat. Special tokens are
ordinary text. Every row is answered; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import string
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Matches that a worker keeps, with their tokens.
CACHE = 300_000
#: Matches in one recursive query, and bytes from which a match counts as long.
QUERY_WORDS, LONG = 16_000, 200

#: Marks that end a match of letters before them, and are one by themselves at the end of a chunk.
MARKS = ".,!?;:"
_LETTER, _MARK = (np.isin(np.arange(256), list(map(ord, chars))) for chars in (string.ascii_letters, MARKS))
SPELLED = pa.schema([("match", pa.large_binary()), ("ids", pa.large_string()), ("bytes", pa.large_binary())])

_STEP = """
WITH RECURSIVE states(word, toks) AS (
  SELECT word, toks FROM start
  UNION ALL
  SELECT s.word, list_concat(list_append(toks[:(best & 16777215) - 1], (best >> 24)::INT), toks[(best & 16777215) + 2:])
  FROM states s JOIN (
    SELECT word, min(rank * 16777216 + p) AS best
    FROM (SELECT word, unnest(range(1, len(toks))) AS p, unnest(toks[:-2])::BIGINT * 65536 + unnest(toks[2:]) AS pair FROM states)
    JOIN merges USING (pair) GROUP BY word) b USING (word)
), step AS (SELECT word, arg_min(toks, len(toks)) AS toks FROM states GROUP BY word)"""
_STEP_LONG = """
WITH RECURSIVE step(word, toks, round) USING KEY (word) AS (
  SELECT word, toks, 0 FROM start
  UNION
  SELECT word, list(CASE WHEN heads THEN rank ELSE tok END ORDER BY p) FILTER (NOT tails), any_value(round) + 1
  FROM (
    SELECT *, coalesce(lag(heads) OVER (PARTITION BY word ORDER BY p), FALSE) AS tails
    FROM (
      SELECT *, is_pair AND (row_number() OVER (PARTITION BY word, is_pair, island ORDER BY p)) % 2 = 1 AS heads
      FROM (
        SELECT *, coalesce(rank = least_rank, FALSE) AS is_pair,
               p - sum(CASE WHEN rank = least_rank THEN 1 ELSE 0 END) OVER (PARTITION BY word ORDER BY p) AS island
        FROM (
          SELECT word, round, p, tok, rank, min(rank) OVER (PARTITION BY word) AS least_rank
          FROM (SELECT word, round, unnest(range(1, len(toks) + 1)) AS p, unnest(toks) AS tok,
                       unnest(toks)::BIGINT * 65536 + unnest(list_append(toks[2:], NULL)) AS pair FROM step WHERE round < 12)
          LEFT JOIN merges USING (pair)
        ) WHERE least_rank IS NOT NULL
      )
    )
  ) GROUP BY word
) SELECT word, toks, round FROM step
"""
_RESULT = " SELECT word, toks FROM step"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Recent:
    """A bounded table of the matches met lately, with their token ids and bytes; the latest stand first."""

    def __init__(self, size: int):
        self.size, self.rows = size, pa.RecordBatch.from_pylist([], SPELLED)

    def get(self, matches: pa.Array, learn) -> pa.RecordBatch:
        """The rows of distinct matches, in their order; what is not kept is learnt."""
        found = pc.index_in(matches, value_set=self.rows.column("match"))
        at, absent = found.fill_null(0).to_numpy(), found.is_null().to_numpy(zero_copy_only=False)
        older = np.ones(len(self.rows), bool)
        older[at[~absent]] = False
        at = np.where(absent, len(self.rows) + np.cumsum(absent) - 1, at)
        rows = pa.concat_batches([self.rows, learn(matches.filter(pa.array(absent)))]).take(pa.array(at))
        self.rows = pa.concat_batches([rows, self.rows.filter(pa.array(older))]).slice(0, self.size)
        return rows


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, rank_path: str, pattern: str):
        ranks = read_ranks(rank_path)
        self.split = regex.compile(pattern).findall
        self.letters_match = self.split("Ab cé, d") == ["Ab", " cé", ",", " d"]  # as in the usual pattern
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.seen = Recent(CACHE)
        pairs = [(ranks[t[:i]] * 65536 + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks]
        merges = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "rank": pa.array([r for _, r in pairs], pa.int64())})
        token_of = {r: t for t, r in ranks.items()}
        self.token_bytes = pa.array([token_of.get(r) for r in range(max(token_of) + 1)], pa.large_binary())
        self.token_names = pa.array(list(map(str, range(len(self.token_bytes)))), pa.large_string())
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self.db.register("rows", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM rows")
        self.db.unregister("rows")

    def begin(self, words: pa.Array, toks: pa.Array) -> None:
        self.db.register("start", pa.table({"word": words, "toks": toks}))

    def byte_tokens(self, raw: pa.Array) -> pa.Array:
        """Lists of the tokens of single bytes."""
        data, ends = bytes_of(raw)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.byte_ids[data]))

    def joined(self, toks: pa.ListArray) -> tuple[pa.Array, pa.Array]:
        """Token ids, joined by one space, and decoded bytes of lists of tokens."""
        return join(toks.offsets, self.token_names.take(toks.values), " "), join(toks.offsets, self.token_bytes.take(toks.values), b"")

    def spelled(self, toks: pa.ListArray) -> tuple[list[str], list[bytes]]:
        ids, raw = self.joined(toks)
        return ids.to_pylist(), raw.to_pylist()

    def merge(self, matches: pa.Array) -> pa.RecordBatch:
        """Token ids, joined by one space, and decoded bytes of distinct matches.

        Matches go to the queries by length: a query has as many rounds as its longest match asks for.
        """
        sizes = pc.binary_length(matches).to_numpy()
        order = np.argsort(sizes, kind="stable")
        ends, n_short = np.cumsum(sizes[order]), int(np.count_nonzero(sizes < LONG))
        done, at = [pa.RecordBatch.from_pylist([], SPELLED)], 0
        while at < len(order):
            # As many matches as hold about 20 bytes each, one at least, and all short or all long.
            before = ends[at - 1] if at else 0
            stop = max(at + 1, min(at + QUERY_WORDS, int(np.searchsorted(ends, before + 20 * QUERY_WORDS, "right"))))
            query, stop = (_STEP, min(stop, n_short)) if at < n_short else (_STEP_LONG, stop)
            part = matches.take(pa.array(order[at:stop]))
            self.begin(pa.array(range(len(part)), pa.int32()), self.byte_tokens(part))
            if query is _STEP_LONG:
                # A recursion keeps the states of its rounds, so a long match goes through several short ones.
                while (rows := self.db.execute(_STEP_LONG).fetchall()) and max(r for *_, r in rows) > 0:
                    self.begin(pa.array([w for w, *_ in rows], pa.int32()), pa.array([t for _, t, _ in rows], pa.list_(pa.int32())))
                query = "WITH step AS (SELECT * FROM start)"
            rows = self.db.sql(query + _RESULT).to_arrow_table().combine_chunks()
            done.append(pa.RecordBatch.from_arrays([part.take(rows.column("word").chunk(0)), *self.joined(rows.column("toks").chunk(0))], schema=SPELLED))
            at = stop
        done = pa.concat_batches(done)
        return done.take(pc.index_in(matches, value_set=done.column("match")))

    def matches(self, chunk: str) -> list[str]:
        """Matches of the split pattern in a chunk; a word of letters, and one with a mark behind, need no search."""
        word, mark = (chunk[:-1], chunk[-1:]) if chunk[-1] in MARKS else (chunk, "")
        if self.letters_match and (word.isalpha() or word[:1] == " " and word[1:].isalpha()):
            return [word, mark] if mark else [word]
        return self.split(chunk)

    def cut(self, chunks: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
        """Where the matches of each chunk begin and end, and these matches.

        Words of plain letters, and such with a mark behind, are told by counting their bytes; the others are searched.
        """
        data, ends = bytes_of(chunks)
        letters = np.diff(np.concatenate([[0], np.cumsum(_LETTER[data])])[ends])
        beside = np.diff(ends) - (data[ends[:-1]] == ord(" ")) - letters  # bytes that are neither letters nor a space in front
        word = self.letters_match & (letters > 0) & (beside == 0)
        marked = self.letters_match & (letters > 0) & (beside == 1) & _MARK[data[ends[1:] - 1]]
        kind = np.where(word, 0, np.where(marked, 1, 2))
        other = [self.matches(c.decode("utf-8", "surrogatepass")) for c in chunks.filter(pa.array(kind == 2)).to_pylist()]
        with_mark = chunks.filter(pa.array(marked))
        found = pa.concat_arrays([chunks.filter(pa.array(word)), pc.binary_slice(with_mark, 0, -1), pc.binary_slice(with_mark, -1),
                                  as_bytes([m for ms in other for m in ms])]).dictionary_encode()
        counts = kind + 1
        counts[kind == 2] = list(map(len, other))
        # From words, words with marks, their marks and the others back to the order of the chunks.
        kind = np.repeat(kind, counts)
        n_words, n_marked = int(word.sum()), len(with_mark)
        place = np.empty(len(kind), np.int64)
        place[kind == 0] = np.arange(n_words)
        place[kind == 1] = (n_words + np.arange(2 * n_marked)).reshape(2, n_marked).T.ravel()
        place[kind == 2] = np.arange(n_words + 2 * n_marked, len(found))
        return np.concatenate([[0], np.cumsum(counts)]), found.take(pa.array(place))

    def encode(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """(ids joined by one space, number of ids, decoded bytes) of whole texts."""
        order, ends, chunks = chunked(texts)
        inner, found = self.cut(chunks.dictionary)
        matches = self.seen.get(found.dictionary, self.merge)
        columns = []
        for name, between in (("ids", " "), ("bytes", b"")):
            of_chunk = join(inner, matches.column(name).take(found.indices), between)
            columns.append(join(ends, of_chunk.take(chunks.indices), between).to_pylist())
        out: list = [None] * len(texts)
        for i, ids, raw in zip(order, *columns):
            out[i] = (ids, ids.count(" ") + 1 if ids else 0, raw)
        return out


def join(ends, parts: pa.Array, between: str | bytes) -> pa.Array:
    """The parts between two ends, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts), pa.scalar(between, parts.type))


def as_bytes(texts: list[str]) -> pa.Array:
    return pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary())


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, one value behind the other, and where they end."""
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


#: A space beside white space or at the end; beginning with the space, the search passes over all else quickly.
_ODD = re.compile(r" (?:\s|\Z|(?<=\s ))").search
_CUT = re.compile(r"(?<=\S) (?=\S)").split


def chunks_of(text: str) -> list[str]:
    """The text cut before each single space that stands between two non-space characters."""
    if not text:
        return []
    first, *rest = _CUT(text) if text[0] == " " or _ODD(text) else text.split(" ")
    return [first, *[" " + p for p in rest]]


def chunked(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """The chunks of all texts, one text behind the other: the texts' order, where each ends, the chunks.

    Texts whose spaces all stand between two words, as most do, are cut and counted as columns.
    """
    odd = np.array([not t or t[0] == " " or bool(_ODD(t)) for t in texts], bool)
    order = np.argsort(odd, kind="stable")
    n = len(texts) - int(odd.sum())
    plain = pc.split_pattern(as_bytes([texts[i] for i in order[:n]]), " ")
    others = [chunks_of(texts[i]) for i in order[n:]]
    ends, words = plain.offsets.to_numpy(), plain.values
    inner = np.ones(len(words), bool)
    inner[ends[:-1]] = False
    spaced = words.filter(pa.array(inner)).dictionary_encode()
    chunks = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(b"", words.type), spaced.dictionary, pa.scalar(b" ", words.type)),
                               words.filter(pa.array(~inner)), as_bytes([c for cs in others for c in cs])]).dictionary_encode()
    at = chunks.indices.to_numpy()
    codes = np.empty(len(words), np.int32)
    codes[inner] = at[:len(spaced.dictionary)][spaced.indices.to_numpy()]
    codes[~inner] = at[len(spaced.dictionary):len(spaced.dictionary) + n]
    codes = np.concatenate([codes, at[len(spaced.dictionary) + n:]])
    ends = np.concatenate([ends, ends[-1] + np.cumsum(list(map(len, others)), dtype=np.int64)])
    return order, ends, pa.DictionaryArray.from_arrays(pa.array(codes), chunks.dictionary)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(rank_path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key = (rank_path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encode(documents: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           digests_only: bool = False, slice_bytes: int = 1 << 21) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and unless digests_only ids and decoded (binary).

    rank_path must be readable on every executor, as installed vocabularies are. Rows are encoded in
    slices of about slice_bytes, so memory follows the longest text, not the batch.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ("" if digests_only else ", ids array<int>, decoded binary")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        for b in batches:
            keys, texts, size = [], [], 0
            for k, t in zip(b.column(0), b.column(1)):
                text = t.as_py() or ""
                keys.append(k.as_py())
                texts.append(text)
                size += len(text)
                if size >= slice_bytes:
                    yield keys, texts
                    keys, texts, size = [], [], 0
            if keys:
                yield keys, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = codec(rank_path, pattern)
        for keys, texts in slices(batches):
            rows = worker.encode(texts)
            sha = lambda b: hashlib.sha256(b).hexdigest()
            columns = [pa.array(keys, pa.int64()), pa.array([n for _, n, _ in rows], pa.int64()),
                       pa.array([sha(ids.encode()) for ids, _, _ in rows], pa.string()), pa.array([sha(raw) for *_, raw in rows], pa.string())]
            if not digests_only:
                columns += [pa.array([[int(i) for i in ids.split()] for ids, _, _ in rows], pa.list_(pa.int32())),
                            pa.array([raw for *_, raw in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in schema.split(", ")])

    return documents.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
