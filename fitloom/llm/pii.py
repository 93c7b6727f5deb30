"""Personal data: base formats, and more spans chosen by boosted trees among wide candidates.

Base spans (mail, ip, card, phone) follow fixed formats and checks and always stay. Generators of high
recall propose further, overlapping spans: numbers in groups, written-out mail addresses, account
numbers. Trees judge each by its format and its context; they learn from the candidates of all
texts (fit_all, or those of a bounded sample: fit), labelled by the base formats: what overlaps a valid base span is personal, what failed
a check or stands in an address is not. The threshold is calibrated on candidates the trees did not see: the
least score at which precision holds. Accepted spans that overlap no base span nor a better one are added.

Null texts are empty ones. Places are code points, ends exclusive. Every row is answered.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.boosting import QUANTILES, Boosted
from fitloom.session import stored_once

KINDS = ("email", "ip", "card", "phone", "account")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").finditer
# Possessive runs that begin at the start of a run of digits: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_WIDE = (
    ("phone", re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,5}(?![0-9])").finditer),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{0,2}[0-9]{4}){2,3}[0-9]{0,3}(?![0-9])").finditer),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[\x20]?\.[\x20]?[0-9]{1,3}){3}(?![0-9])").finditer),
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])").finditer),
    ("email", re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z]{2,24}").finditer),
)
#: Words that announce personal data.
CUES = ("tel", "phone", "call", "fax", "mobile", "card", "visa", "iban", "account", "mail", "email", "contact", "ip", "address", "ssn")
#: Columns of a candidate's description.
COLUMNS = 17
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Mail addresses: from each @ with a domain back over the characters of a name, not into the address before."""
    floor = 0
    for m in _DOMAIN(text):
        at = start = m.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            floor = m.end()
            yield "email", start, floor


def numbers(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Matches of the number formats, and whether they pass their checks."""
    for m in _IP(text):
        yield "ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
    for m in _CARD(text):
        digits = m[0].replace(" ", "").replace("-", "")
        yield "card", *m.span(), 14 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE(text):
        yield "phone", *m.span(), 10 <= sum(c in "0123456789" for c in m[0]) <= 15


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(text: str) -> list[Span]:
    return in_order([*emails(text), *((k, i, j) for k, i, j, ok in numbers(text) if ok)])


def proposals(text: str) -> list[Span]:
    """Candidates of all generators, in their order."""
    return [(k, *m.span()) for k, find in _WIDE for m in find(text)]


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate; nothing that only base formats have, as those are the labels."""
    kind, i, j = span
    s, left, right = text[i:j], text[max(0, i - 32):i], text[j:j + 8]
    digits = "".join(c for c in s if c in "0123456789")
    groups = re.findall("[0-9]+", s)
    before = re.findall(r"[^\W\d_]+", left.lower())[-2:]
    return [
        KINDS.index(kind), len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(len(digits) > 11 and luhn(digits)), s.count("."), s.count("-"), s.count(" "), s.count("("), len(set(digits)),
        float(any(w in CUES for w in before)),
        float(left[-1:].isalnum() or right[:1].isalnum()), float("/" in left[-6:] or "=" in left[-2:]), float(left[-1:] == "." or right[:1] == "@"),
        max((int(g) for g in groups if len(g) < 5), default=0),
    ]


def overlaps(a: Span, others: list[Span]) -> bool:
    return any(a[1] < o[2] and o[1] < a[2] for o in others)


def labelled(text: str) -> Iterator[tuple[list[float], float, tuple[int, int]]]:
    """Candidates that base formats or an address before them label: description, label, place."""
    candidates = proposals(text)
    if not candidates:
        return
    found = base_spans(text)
    failed = [(k, i, j) for k, i, j, ok in numbers(text) if not ok and j - i > 6]
    for c in candidates:
        if overlaps(c, found):
            yield describe(text, c), 1.0, c[1:]
        elif overlaps(c, failed) or "/" in text[max(0, c[1] - 6):c[1]]:
            yield describe(text, c), 0.0, c[1:]


class Model:
    """Trees and their threshold; without findings of both labels nothing is added."""

    def __init__(self, texts: list[str], precision: float = 0.98):
        rows = [row for text in texts for row in labelled(text)]
        x, y = np.array([x for x, _, _ in rows]), np.array([y for _, y, _ in rows])
        self._learn(x, y, np.ones(len(y)), np.arange(len(y)) % 3 == 2, precision)

    @classmethod
    def of_counts(cls, x: np.ndarray, y: np.ndarray, n: np.ndarray, held: np.ndarray, cuts: list[np.ndarray], precision: float = 0.98) -> Model:
        """From distinct candidates that occur n times each, their columns being cuts that no value between is told from."""
        model = cls([])
        model._learn(x, y, n, held, precision, cuts)
        return model

    def _learn(self, x, y, n, held, precision, cuts=None) -> None:
        self.trees, self.threshold = None, 1.1
        if len(set(y)) == 2 and n.sum() >= 20 and len(set(y[~held])) == 2:
            self.trees = Boosted(x[~held], y[~held], weights=n[~held], cuts=cuts)
            p = self.trees.probability(x[held])
            order = np.argsort(-p, kind="stable")
            right = np.cumsum((n * y)[held][order]) / np.cumsum(n[held][order])
            good = np.flatnonzero(right >= precision)
            if len(good):
                self.threshold = max(float(p[order][good[-1]]), 0.5)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans."""
        base = base_spans(text)
        if self.trees is None:
            return base, base
        free = [c for c in proposals(text) if not overlaps(c, base)]
        if not free:
            return base, base
        p = self.trees.probability(np.array([describe(text, c) for c in free]))
        added: list[Span] = []
        for at in np.argsort(-p, kind="stable"):
            if p[at] >= self.threshold and not overlaps(free[at], added):
                added.append(free[at])
        return base, in_order([*base, *added])


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


def fit(documents: DataFrame, sample: int = 3000) -> Model:
    """A model from at most sample texts with digits, those of the lowest hashes of id and text.

    The rows are counted first; hashes are even, so a fifth more than the sample lie below the bound that follows,
    and all tasks together send about the sample to the driver, not a sample each. Repeated rows count once.
    """
    rows = documents.select(F.xxhash64("doc_id", "text").alias("h"), "text").where(F.col("text").rlike("[0-9]"))
    share = (1.2 * sample + 100) / max(rows.count(), 1)
    if share < 1:
        rows = rows.where(F.col("h") < int((share - 0.5) * 2 ** 64))
    return Model([r["text"] for r in rows.distinct().orderBy("h", "text").limit(sample).collect()])


#: Distinct candidates, told apart by the thresholds alone, that the driver learns from.
GROUPS = 50_000


def fit_all(documents: DataFrame, groups: int = GROUPS) -> Model:
    """A model from the candidates of all rows; each row counts, repeated ones too.

    Tasks describe the candidates and Spark counts equal ones, takes each column's quantiles over all of them and counts again by
    the thresholds that a value lies between: trees ask for nothing else, so these counts are all they can learn from. Should
    there be more than groups of them, every second threshold goes until there are not; no candidate is left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(0):
                text = t.as_py()
                # A third is held back, by a checksum of what stands around the place.
                rows += [(x, int(y), zlib.crc32(text[max(0, i - 32):j].encode("utf-8", "surrogatepass")) % 3 == 2) for x, y, (i, j) in labelled(text)]
            x, y, held = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(held, pa.bool_())], ["x", "y", "held"])

    rows = documents.select("text").where(F.col("text").rlike("[0-9]")).mapInArrow(run, "x array<double>, y int, held boolean")
    counts = stored_once(rows.groupBy("x", "y", "held").agg(F.count("*").alias("n")))
    # A column has few distinct values: the formats bound lengths and groups.
    quantiles = counts.select(*[F.percentile(F.col("x")[k], [float(q) for q in QUANTILES], F.col("n")) for k in range(COLUMNS)]).first()
    cuts = [np.unique(q) if q is not None else np.zeros(0) for q in quantiles]
    while True:
        at = F.array(*[F.size(F.filter(F.array(*[F.lit(float(c)) for c in cs]).cast("array<double>"), lambda c, k=k: c < F.col("x")[k])) for k, cs in enumerate(cuts)])
        told = counts.groupBy(at.alias("at"), "y", "held").agg(F.sum("n").alias("n"))
        found = told.limit(groups + 1).collect()
        if len(found) <= groups:
            break
        cuts = [cs[::2] if len(cs) > 1 else cs[:0] for cs in cuts]
    found.sort(key=lambda r: (r["at"], r["y"], r["held"]))
    x = np.array([[[*cs, np.inf][i] for i, cs in zip(r["at"], cuts)] for r in found])
    column = lambda name, kind: np.array([r[name] for r in found], kind)
    return Model.of_counts(x, column("y", float), column("n", float), column("held", bool), cuts)


def find(documents: DataFrame, model: Model, mask: bool = False) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all, base and added), and with mask the redacted text."""
    broadcast = documents.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + (", redacted string" if mask else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                base, every = broadcast.value.spans(text)
                kinds = [k for k, *_ in base]
                row = [d, *(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(written(base).encode()).hexdigest(), written(every)]
                rows.append([*row, redacted(text, every)] if mask else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows), types)], names) if rows else pa.RecordBatch.from_arrays(
                [pa.array([], f) for f in types], names)

    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = [pa.int64()] * 5 + [pa.string()] * (len(names) - 5)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones joined, replaced by the kind of the first."""
    out, at = [], 0
    for k, i, j in spans:
        if i >= at:
            out += [text[at:i], f"[{k}]"]
        at = max(at, j)
    return "".join([*out, text[at:]])
