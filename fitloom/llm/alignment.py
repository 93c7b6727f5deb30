"""Alignment of two tokenizers by an associative monoid of fragments.

A text is cut into byte-range chunks. A chunk yields a Fragment: the tokens of both tokenizers up to the first
place where both end (open prefix), the groups between such places (closed), and the tokens behind the last one
(open suffix). Fragments compose associatively, a suffix and the next prefix closing to a group, so a text may be
composed in any order: inside a task the chunks are the stretches between single spaces, whose fragments are kept
in a bounded cache; texts longer than part_chars are cut into parts that are dealt to different tasks, and their
fragments are composed by a tree reduction of FAN neighbours a level.

The single space between two other characters is a place where both tokenizers end: the split pattern of the byte-level
one never crosses it, and no piece of the other holds a space mark behind another character, which is checked
when the model is loaded. A single line break between two other characters is one, too, if no piece holds a
line break; a break is also the neutral start that keeps the second tokenizer from adding a space. A last mark behind a
letter is a fragment of its own where no piece holds both. A stretch without such a place stays whole, as long as it may be.

Null and empty texts, and texts whose joined token bytes are not a space and the text (characters that a
tokenizer changes, such as U+2581), have no tokens: zeros and an empty digest. Rows that repeat an id or are equal
are counted as documents of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import stored

#: Fragments that are composed into one at each level of the tree, and the code points of a part.
FAN, PART_CHARS = 16, 200_000
#: Stretches from which a task's cache begins its next generation; pairs whose counts are broadcast.
CACHE, HOT_PAIRS = 200_000, 1 << 20
#: An id pair is one number: the first id times SHIFT plus the second.
SHIFT = 1 << 31
MARK = "▁"
#: What stands for a stretch whose bytes differ.
WRONG = (-1, 0, 0, 0, "", b"")
SUMS = ("n_a", "n_b", "n_groups", "n_links")


@dataclass
class Fragment:
    """Tokens of a byte range, of both tokenizers. Without a common end (cut False) all tokens stand in prefix.

    An empty prefix behind a cut, or an empty suffix before one, means that the range begins or ends at a common end.
    """

    prefix: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())
    cut: bool = False
    groups: list[str] = field(default_factory=list)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    pairs: Counter = field(default_factory=Counter)
    suffix: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())

    def add(self, other: Fragment) -> None:
        """Add the other's closed groups behind the own ones."""
        self.groups += other.groups
        self.pairs.update(other.pairs)
        for name in SUMS:
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def close(self, a: tuple[int, ...], b: tuple[int, ...]) -> None:
        """Add one closed group; nothing if it has no tokens."""
        if not a and not b:
            return
        self.n_a, self.n_b = self.n_a + len(a), self.n_b + len(b)
        self.groups.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
        self.n_groups += 1
        self.n_links += len(a) * len(b)
        for x in a:
            for y in b:
                self.pairs[x * SHIFT + y] += 1


def fragment(ids_a, ends_a, ids_b, ends_b, begin: int, end: int) -> Fragment:
    """The fragment of the tokens that end in the byte range (begin, end]; ends rise within their text."""
    a = [(int(e), int(i)) for i, e in zip(ids_a, ends_a) if begin < e <= end]
    b = [(int(e), int(i)) for i, e in zip(ids_b, ends_b) if begin < e <= end]
    cuts = sorted({e for e, _ in a} & {e for e, _ in b})
    out, pa_, pb_ = Fragment(cut=bool(cuts)), 0, 0
    for k, stop in enumerate([*cuts, end]):
        qa, qb = pa_, pb_
        while qa < len(a) and a[qa][0] <= stop:
            qa += 1
        while qb < len(b) and b[qb][0] <= stop:
            qb += 1
        tokens = tuple(i for _, i in a[pa_:qa]), tuple(i for _, i in b[pb_:qb])
        pa_, pb_ = qa, qb
        if k == 0:
            out.prefix = tokens
        elif k < len(cuts):
            out.close(*tokens)
        else:
            out.suffix = tokens
    return out


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges. Associative; Fragment() is neutral."""
    join = lambda s, t: (s[0] + t[0], s[1] + t[1])
    out = Fragment(x.prefix, x.cut, suffix=x.suffix)
    out.add(x)
    if not x.cut:
        out.prefix, out.cut, out.suffix = join(x.prefix, y.prefix), y.cut, y.suffix
        out.add(y)
    elif not y.cut:
        out.suffix = join(x.suffix, y.prefix)
    else:
        out.close(*join(x.suffix, y.prefix))
        out.add(y)
        out.suffix = y.suffix
    return out


def closed(x: Fragment) -> Fragment:
    """A whole text's fragment with its ends closed."""
    end = Fragment(cut=True)
    return compose(compose(end, x), end)


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers of one worker process, and the fragments of stretches met lately."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        chars = byte_level()
        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for t, i in vocabulary.items():
            if all(c in chars for c in t):
                self.a_bytes[i] = bytes(chars[c] for c in t)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece of the second vocabulary crosses a space or a line: texts cannot be cut there")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        # A mark behind a letter begins a match of the first tokenizer, and a piece of the second unless one goes on with it.
        inside = {y for p in pieces for x, y in zip(p, p[1:]) if x.isalpha()}
        self.marks = [m for m in ".,;:!?" if m not in inside]
        self.neutral = len(self.b.encode("\n"))
        self.a_size, self.b_size = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = ([str(i) for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        self.seen: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}

    def stretches(self, text: str) -> list[str]:
        """A space and the text, cut before each single space or line break between two other characters."""
        if not text:
            return []
        if "\x1f" in text or len(text.split()) - 1 != text.count(" ") + text.count("\n"):
            return [s for x in _CUT(text) for s in _LINES(" " + x)]
        # Each white space is one space or line break between two other characters.
        return (" " + text).replace(" ", "\x1f ").replace("\n", "\x1f\n").split("\x1f")[1:]

    def joined(self, stretches: list[str], raw: list[bytes], size: np.ndarray) -> tuple | None:
        """Ids of all stretches and the stretch of each, by both tokenizers, encoded as lines of one text; None if a line does not stand alone."""
        stops, out = np.cumsum(size + 1) - 1, []
        text = "\n".join(stretches)
        whole = b"\n".join(raw)
        for ids, sizes, texts in ((self.a.encode(text, add_special_tokens=False).ids, self.a_size, self.a_bytes),
                                  (self.b.encode("\n" + text)[self.neutral:], self.b_size, self.b_bytes)):
            if b"".join([texts[i] for i in ids]) != whole:
                return None
            flat = np.array(ids, np.int64)
            ends = np.cumsum(sizes[flat])
            place = np.searchsorted(stops, ends)
            # A stretch's last token is followed by a break alone.
            breaks = np.flatnonzero(ends == stops[place])[:-1] + 1
            if len(breaks) != len(stretches) - 1 or (sizes[flat[breaks]] != 1).any():
                return None
            keep = np.ones(len(flat), bool)
            keep[breaks] = False
            out += [flat[keep], place[keep]]
        return tuple(out)

    def fragments(self, stretches: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, pairs with repeats) of each stretch, whose ends are common; WRONG if bytes differ.

        The same as closed(fragment(...)) of the stretch's whole range, for many stretches in one walk over arrays.
        """
        raw = [s.encode("utf-8", "surrogatepass") for s in stretches]
        size = np.array([len(r) for r in raw])
        tokens = self.joined(stretches, raw, size)
        if tokens is None and len(stretches) > 1:
            half = len(stretches) // 2
            return self.fragments(stretches[:half]) + self.fragments(stretches[half:])
        if tokens is None:  # a stretch with white space at an end, or one that a tokenizer changes
            a = self.a.encode(stretches[0], add_special_tokens=False).ids
            b = self.b.encode("\n" + stretches[0])[self.neutral:]
            if b"".join([self.a_bytes[i] for i in a]) != raw[0] or b"".join([self.b_bytes[i] for i in b]) != raw[0]:
                return [WRONG]
            tokens = np.array(a, np.int64), np.zeros(len(a), np.int64), np.array(b, np.int64), np.zeros(len(b), np.int64)
        a, at_a, b, at_b = tokens
        n_a, n_b = np.bincount(at_a, minlength=len(raw)), np.bincount(at_b, minlength=len(raw))
        size_a, size_b = self.a_size, self.b_size
        ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_b = np.bincount(group_b, minlength=len(cuts))
        begin_b = np.cumsum(in_b) - in_b
        n_groups = np.diff(np.searchsorted(cuts, np.cumsum(size), side="right"), prepend=0)
        links = in_b[group_a]  # of each token of the first tokenizer
        n_links = np.bincount(at_a, links, len(raw)).astype(np.int64)
        step = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
        codes = (np.repeat(a, links) * len(self.b_bytes) + b[np.repeat(begin_b[group_a], links) + step]).tobytes()
        text_a, text_b = [self.a_text[i] for i in a.tolist()], [self.b_text[i] for i in b.tolist()]
        hi_a, hi_b = np.searchsorted(ends_a, cuts, side="right").tolist(), np.searchsorted(ends_b, cuts, side="right").tolist()
        groups = [f"{text_a[x] if y - x == 1 else ','.join(text_a[x:y])}|{text_b[p] if q - p == 1 else ','.join(text_b[p:q])}"
                  for x, y, p, q in zip([0, *hi_a], hi_a, [0, *hi_b], hi_b)]
        out, g, k = [], 0, 0
        for na, nb, ng, nl in zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist()):
            out.append((na, nb, ng, nl, groups[g] if ng == 1 else ";".join(groups[g:g + ng]), codes[8 * k:8 * (k + nl)]))
            g, k = g + ng, k + nl
        return out

    def learn(self, stretches: set[str]) -> dict[str, tuple]:
        """Fragments of all these stretches, those not kept being encoded in batches; the cache has two generations."""
        young, old = self.seen, self.before
        out, new, ended = {}, [], []

        def kept(s: str) -> tuple | None:
            value = young.get(s)
            if value is None and (value := old.get(s)) is not None:
                young[s] = value
            return value

        for s in stretches:
            if s[-1] in self.marks and s[-2:-1].isalpha():
                ended.append(s)
            elif (value := kept(s)) is None:
                new.append(s)
            else:
                out[s] = value
        heads = {}
        for s in chain((s[:-1] for s in ended), self.marks):
            if s not in out and s not in heads and (value := kept(s)) is not None:
                heads[s] = value
        new += {s for s in chain((s[:-1] for s in ended), self.marks if ended else ()) if s not in out and s not in heads} - set(new)
        for lo in range(0, len(new), 8000):
            part = new[lo:lo + 8000]
            for s, value in zip(part, self.fragments(part)):
                heads[s] = value
                if len(s) < 60:
                    young[s] = value
        out.update((s, heads[s]) for s in new if s in stretches)
        for s in ended:
            x, y = heads.get(s[:-1]) or out[s[:-1]], heads.get(s[-1]) or out[s[-1]]
            out[s] = (x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] + y[3], x[4] + ";" + y[4], x[5] + y[5]) if x[0] >= 0 <= y[0] else WRONG
        if len(young) >= CACHE:
            self.before, self.seen = young, {}
        return out


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizers(a_path: str, b_path: str) -> Pair:
    """One pair per worker process and vocabularies."""
    key = (a_path, b_path)
    if key not in _pairs:
        _pairs[key] = Pair(*key)
    return _pairs[key]


_CUT = re.compile(r"(?<=\S) (?=\S)").split
_LINES = re.compile(r"(?<=\S)(?=\n\S)").split
_SAFE = re.compile(r"(?<=\S) (?=\S)").search


def parts(text: str, size: int) -> list[str]:
    """Parts of about size characters, cut at single spaces between two other characters; longer where there is none."""
    out, at = [], 0
    while len(text) - at > size and (m := _SAFE(text, at + size)):
        out.append(text[at:m.start()])
        at = m.end()
    return [*out, text[at:]]


_PARTS = "_u long, _doc long, _part long, _parts long, _text string"
#: A document's or a part's fragment, both of whose ends are common; groups: their text, of whole documents its digest.
_PIECE = ("_u long, _doc long, _part long, _parts long, valid boolean, n_a long, n_b long, n_groups long, n_links long, "
          "groups string, pa array<int>, pb array<int>, pk array<int>")


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _pair_lists(pairs: dict[int, int]) -> list[pa.Array]:
    codes = np.array(sorted(pairs), np.int64)
    return [pa.array([x], pa.list_(pa.int32())) for x in (codes // SHIFT, codes % SHIFT, [pairs[c] for c in codes.tolist()])]


def _composed(worker: Pair, texts: list[str]) -> tuple[list[bool], list[np.ndarray], list[str], list[pa.ListArray]]:
    """Whether each text's bytes are right, its sums, its groups, and its distinct pairs with their numbers.

    The ends of stretches are common, so composing their fragments comes to sums and one list of groups.
    """
    cut = [worker.stretches(t) for t in texts]
    known = worker.learn(set().union(*cut))
    index = {w: i for i, w in enumerate(known)}
    value = list(known.values())
    places = [[index[w] for w in words] for words in cut]
    at = np.repeat(np.arange(len(texts)), [len(p) for p in places])
    word = np.fromiter(chain.from_iterable(places), np.int64, len(at))
    sums = np.array([v[:4] for v in value], np.int64).reshape(-1, 4)
    wrong = np.bincount(at, sums[word, 0] < 0, len(texts)) > 0
    ok = ~wrong[at]
    at, word = at[ok], word[ok]
    both, times = np.unique(at * max(len(value), 1) + word, return_counts=True)
    at, word = both // max(len(value), 1), both % max(len(value), 1)
    totals = [np.bincount(at, sums[word, i] * times, len(texts)).astype(np.int64) for i in range(4)]
    codes = np.frombuffer(b"".join([v[5] for v in value]), np.int64)
    links = np.maximum(sums[:, 3], 0)
    begin, n = np.cumsum(links) - links, links[word]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    base = len(worker.a_bytes) * len(worker.b_bytes)
    key = np.repeat(at, n) * base + codes[np.repeat(begin[word], n) + step]
    order = np.argsort(key, kind="stable")
    key, k = key[order], np.repeat(times, n)[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    k = np.add.reduceat(k, heads) if len(heads) else np.empty(0, np.int64)
    key = key[heads]
    ends = np.concatenate([[0], np.cumsum(np.bincount(key // base, minlength=len(texts)))]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
             for x in (key % base // len(worker.b_bytes), key % base % len(worker.b_bytes), k)]
    group = [v[4] for v in value]
    return (~wrong).tolist(), totals, ["" if bad else ";".join([group[i] for i in p]) for bad, p in zip(wrong, places)], lists


def pieces(documents: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, part_chars: int) -> DataFrame:
    """One row per document with its groups and its distinct id pairs; long texts are composed by a tree reduction."""
    spark = documents.sparkSession
    # Even numbers are short texts, odd ones long texts: each kind is computed once, so numbers stay unique.
    long = F.char_length(F.coalesce(F.col(text_col), F.lit(""))) > part_chars
    numbered = documents.select((F.monotonically_increasing_id() * 2 + long.cast("long")).alias("_u"), F.col(id_col).cast("long").alias("_doc"),
                                F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u, doc, text in zip(*(b.column(i) for i in range(3))):
                found = parts(text.as_py(), part_chars)
                for lo in range(0, len(found), 8):
                    some = found[lo:lo + 8]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([u.as_py()] * len(some), pa.int64()), pa.array([doc.as_py()] * len(some), pa.int64()),
                         pa.array(range(lo, lo + len(some)), pa.int64()), pa.array([len(found)] * len(some), pa.int64()),
                         pa.array(some, pa.string())], _names(_PARTS))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = tokenizers(a_path, b_path)
        for b in batches:
            lo, n = 0, b.num_rows
            while lo < n:
                texts, size, hi = [], 0, lo
                while hi < n and (hi == lo or size < 1 << 21):
                    texts.append(b.column(4)[hi].as_py())
                    size += len(texts[-1])
                    hi += 1
                valid, sums, groups, pairs = _composed(worker, texts)
                whole = b.column(3).slice(lo, hi - lo).to_pylist()
                groups = [g if n > 1 else _digest(g) for g, n in zip(groups, whole)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(lo, hi - lo) for i in range(4)), pa.array(valid, pa.bool_()), *map(pa.array, sums), pa.array(groups, pa.string()), *pairs], _names(_PIECE))
                lo = hi

    def compose_level(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["_part"])
        first, valid = rows[0], all(r["valid"] for r in rows)
        whole = Fragment(cut=True)
        for r in rows if valid else []:
            codes = Counter({x * SHIFT + y: k for x, y, k in zip(r["pa"], r["pb"], r["pk"])})
            whole = compose(whole, Fragment(cut=True, groups=[r["groups"]], pairs=codes, **{c: r[c] for c in SUMS}))
        text = ";".join(whole.groups)
        if len(rows) == first["_parts"]:
            text = _digest(text)
        return pa.Table.from_arrays(
            [pa.array([x], kind) for x, kind in zip(
                [first["_u"], first["_doc"], first["_part"] // FAN, -(-first["_parts"] // FAN), valid, *(getattr(whole, c) for c in SUMS), text],
                [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 4 + [pa.string()])]
            + _pair_lists(whole.pairs), names=_names(_PIECE))

    long = F.char_length("_text") > part_chars
    short_rows = numbered.where(~long).select("_u", "_doc", F.lit(0).cast("long").alias("_part"), F.lit(1).cast("long").alias("_parts"), "_text")
    done = [short_rows.mapInArrow(encode, _PIECE)]
    # Parts of long texts go to their own tasks; the texts are few against the table, so only they are shuffled.
    waiting = stored(numbered.where(long).mapInArrow(cut, _PARTS).repartition("_u", "_part").mapInArrow(encode, _PIECE))
    done.append(waiting.where("_parts = 1"))
    waiting = waiting.where("_parts > 1")
    while waiting.limit(1).count():
        level = stored(waiting.withColumn("_node", F.floor(F.col("_part") / FAN)).groupBy("_u", "_node").applyInArrow(
            lambda t: compose_level(t.drop_columns(["_node"])), _PIECE))
        done.append(level.where("_parts = 1"))
        waiting = level.where("_parts > 1")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return stored(out)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, count): in how many documents the two ids are linked. Tasks add up before the shuffle."""
    schema = "a int, b int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting: list[np.ndarray] = []

        def settle():
            nonlocal codes, n
            new, k = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            both, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
            codes, n = both, np.bincount(at, np.concatenate([n, k])).astype(np.int64)

        def out():
            for lo in range(0, len(codes), 200_000):
                c = codes[lo:lo + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array((c // SHIFT).astype(np.int32)), pa.array((c % SHIFT).astype(np.int32)),
                                                  pa.array(n[lo:lo + 200_000])], ["a", "b", "n"])

        size = 0
        for b in batches:
            own = [c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
            waiting.append(own[0] * SHIFT + own[1])
            size += len(waiting[-1])
            if size > 2_000_000:
                settle()
                size = 0
                if len(codes) > 2_000_000:  # a task's own table stays bounded
                    yield from out()
                    codes, n = codes[:0], n[:0]
        if waiting:
            settle()
        yield from out()

    return rows.select("pa", "pb").mapInArrow(count, schema).groupBy("a", "b").agg(F.sum("n").alias("count"))


def align(documents: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          part_chars: int = PART_CHARS, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Paths must be readable on every executor. The counts of at most hot_pairs pairs, the commonest by powers of two, and
    the highest count of each first id (as many rows as its vocabulary has) are broadcast; other pairs are joined.
    """
    spark = documents.sparkSession
    rows = pieces(documents, a_path, b_path, id_col, text_col, part_chars)
    counts = stored(pair_counts(rows))
    band = F.floor(F.log2("count")).cast("int")
    bands = sorted(((r["band"], r["n"]) for r in counts.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for k, n in bands:
        total += n
        if total > hot_pairs:
            break
        least = k
    hot_rows = counts.where(band >= least).select("a", "b", "count").toArrow() if least is not None else None
    top = stored(counts.groupBy("a").agg(F.max("count").alias("highest")))
    best = top.toArrow()
    highest = np.zeros(1 + max(best["a"].to_pylist(), default=0), np.int64)
    highest[best["a"].to_numpy()] = best["highest"].to_numpy()
    if hot_rows is not None:
        codes = hot_rows["a"].to_numpy().astype(np.int64) * SHIFT + hot_rows["b"].to_numpy()
        order = np.argsort(codes)
        hot = codes[order], hot_rows["count"].to_numpy()[order]
    else:
        hot = np.empty(0, np.int64), np.empty(0, np.int64)
    shared = spark.sparkContext.broadcast((*hot, highest))
    schema = ("_u long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, "
              "ra array<int>, rb array<int>, rk array<int>")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, highest = shared.value
        for b in batches:
            lists = b.column(7)
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            a, c, k = (b.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (7, 8, 9))
            at = np.repeat(np.arange(b.num_rows), sizes)
            code = a * SHIFT + c
            place = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            known = codes[place] == code if len(codes) else np.zeros(len(code), bool)
            value = np.where(known, n[place], 0) if len(codes) else np.zeros(len(code), np.int64)
            sums = np.zeros(b.num_rows, np.int64)
            bests = np.zeros(b.num_rows, np.int64)
            np.add.at(sums, at, value * k)
            is_best = known & (value == highest[a]) if len(a) else known
            np.add.at(bests, at[is_best], k[is_best])
            rest = ~known
            ends = np.concatenate([[0], np.cumsum(np.bincount(at[rest], minlength=b.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(6)), pa.array(bests), pa.array(sums), b.column(6),
                 *(pa.ListArray.from_arrays(pa.array(ends), pa.array(x[rest].astype(np.int32))) for x in (a, c, k))], _names(schema))

    found = rows.select("_u", F.col("_doc").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.col("groups").alias("groups_sha256"),
                        "pa", "pb", "pk").mapInArrow(look_up, schema)
    if least is not None and least == bands[-1][0] or not bands:
        return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = stored(found)
    rest = (
        found.where(F.size("ra") > 0).select("_u", F.explode(F.arrays_zip("ra", "rb", "rk")).alias("p"))
        .select("_u", F.col("p.ra").alias("a"), F.col("p.rb").alias("b"), F.col("p.rk").alias("k"))
        .join(counts, ["a", "b"]).join(top, "a")
        .groupBy("_u").agg(F.sum(F.col("k") * F.col("count")).alias("more"), F.sum(F.when(F.col("count") == F.col("highest"), F.col("k")).otherwise(0)).alias("more_best"))
    )
    return found.join(rest, "_u", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256")
