"""Text features as Column expressions: no shuffle, no Python in the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitloom.functions.lexicons import by_length

# Patterns that decide what counts as a token, an address, a number, a name.
TOKEN = r"(?U)\b[a-z][\w.+#-]*\b"
WORD = r"(?U)\b[A-Za-z][\w.+#-]*\b"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"[\(]?\d{3}[\)]?[-.\s]?\d{3}[-.\s]?\d{4}"
NAME = r"(?U)^[A-Za-z\s.\-']+$"
PATH_UNSAFE = r"(?U)[^\w\-]"
# End of fixed values.

_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value once and use it many times inside one expression.

    A plain column reference may be inlined by the optimizer and then be computed again for
    every element a lambda visits; a lambda variable never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_array(words: Iterable[str]) -> Column:
    items = [F.lit(w) for w in words]
    return F.array(*items) if items else F.array().cast("array<string>")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_SPACE, "")


def rstrip_chars(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


def lstrip_chars(c: Column, chars: str) -> Column:
    return F.ltrim(c, F.lit(chars))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """First match of pattern, or null."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def tokens(c: Column) -> Column:
    """All tokens of the lower-cased text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def title_words(c: Column) -> Column:
    """White-space words of a title, as a set."""
    return F.filter(
        F.array_distinct(F.split(F.lower(c), r"(?U)[\s\x1c-\x1f]+")), lambda w: w != ""
    )


def contains_any(c: Column, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def lexicon_hits(c: Column, words: Iterable[str], mode: str = "substring") -> Column:
    """Lexicon words found in the text, longest first.

    Substring is the default rule, so "r" is found in almost any text; mode="token" asks for
    whole tokens instead. The text is lower-cased once, however many words are tested.
    """
    ordered = by_length(words)
    if mode == "token":
        return F.array_intersect(words_array(ordered), token_set(c))
    return let(
        F.lower(c),
        lambda low: F.filter(words_array(ordered), lambda w: F.contains(low, F.lower(w))),
    )


def domain_hits(c: Column, domains: dict[str, Iterable[str]]) -> Column:
    """Domains with at least one keyword in the text, in map order."""
    return let(
        F.lower(c),
        lambda low: F.array_compact(
            F.array(*[F.when(contains_any(low, kws), F.lit(d)) for d, kws in domains.items()])
        ),
    )


def email(c: Column) -> Column:
    # The first match always begins where a run of its characters does, so none is searched again from within.
    return blank_to_null(F.regexp_extract(c, r"(?<![a-zA-Z0-9._%+-])" + EMAIL, 0))


def phone(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, PHONE, 0))


def name_line(c: Column) -> Column:
    """First short line made of letters, spaces, dots, hyphens and apostrophes."""

    def fits(line: Column) -> Column:
        return (
            (line != "")
            & (F.length(line) < 50)
            & ~line.contains("http")
            & line.rlike(NAME)
        )

    lines = F.transform(F.split(c, "\n"), strip)
    return F.coalesce(F.get(F.filter(lines, fits), F.lit(0)), F.lit("Unknown"))


def experience_level(c: Column, n_experience: Column, levels) -> Column:
    """First level whose words occur in the text, else by number of experience entries."""
    low = F.lower(c)
    level = None
    for name, words in levels:
        test = contains_any(low, words)
        level = F.when(test, name) if level is None else level.when(test, name)
    tail = (
        F.when(n_experience >= 3, "mid-level").when(n_experience >= 1, "entry-level").otherwise("student")
    )
    return tail if level is None else level.otherwise(tail)


def word_counts(c: Column, stop_words: Iterable[str]) -> Column:
    """Per-text word counts as array<struct<n, pos, word>>; pos is a word's place among the distinct words as first seen.

    Words are sorted inside the row and each run of equal words is measured by where the next
    run starts, so counting needs no shuffle and one long text stays one row.
    """
    ignored = [w for w in stop_words if len(w) > 2]

    def counted(words: Column) -> Column:
        # Only distinct words are sorted with their places; both arrays have the words in the same order.
        placed = F.sort_array(
            F.transform(F.array_distinct(words), lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
        )

        def starts(ordered: Column) -> Column:
            return F.array_compact(
                F.transform(ordered, lambda w, i: F.when((i == 0) | (F.get(ordered, i - 1) != w), i))
            )

        def runs(at: Column) -> Column:
            return F.transform(
                placed,
                lambda r, k: F.struct(
                    (F.coalesce(F.get(at, k + 1), F.size(words)) - F.get(at, k)).alias("n"),
                    r["pos"].alias("pos"),
                    r["word"].alias("word"),
                ),
            )

        return F.filter(
            let(let(F.sort_array(words), starts), runs),
            lambda r: (F.length(r["word"]) > 2) & ~r["word"].isin(ignored),
        )

    return let(F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.lower), counted)


def top_keywords(c: Column, stop_words: Iterable[str], k: int = 30, min_count: int = 2) -> Column:
    """The k most frequent words, earlier word first on ties, then those seen min_count times."""
    ranked = F.sort_array(
        F.transform(
            F.filter(word_counts(c, stop_words), lambda r: r["n"] >= min_count),
            lambda r: F.struct(
                (-r["n"]).alias("neg"), r["pos"].alias("pos"),
                r["word"].alias("word"), r["n"].alias("n"),
            ),
        )
    )
    return F.transform(
        F.slice(ranked, 1, k),
        lambda r: F.struct(r["word"].alias("word"), r["n"].alias("n")),
    )


def display_name(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def level_label(level: Column) -> Column:
    """Every hyphen-separated part capitalised."""
    return F.array_join(F.transform(F.split(level, "-"), F.initcap), "-")


def path_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), PATH_UNSAFE, "_"), F.lit("_"))


def stars(score: Column, width: int = 10) -> Column:
    s = score.cast("int")
    return F.concat(F.repeat(F.lit("★"), s), F.repeat(F.lit("☆"), F.lit(width) - s))


def skill_overlap(skills: Column, languages: Column, technologies: Column, posting_text: Column,
                  repeats: bool = False) -> Column:
    """Profile skills named in a posting. repeats=True lists a word once per list holding it."""
    named = F.concat(skills, languages, technologies)
    if not repeats:
        named = F.array_distinct(named)
    return let(
        F.lower(posting_text),
        lambda low: F.filter(named, lambda s: F.contains(low, F.lower(s))),
    )
