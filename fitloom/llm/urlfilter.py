"""URL filter: a trie over reversed host labels and path segments, broadcast to the tasks.

A rule fits its host and all subdomains if the path starts with the rule's path. Among fitting rules
the one with the longest host and path wins; block wins over allow if both are equally long. Urls that
no rule fits get the default. The last path segment of a rule is a prefix, so it is kept at its node.

A null url, or one without ://, has an empty host and path and gets the default. Very many rules are
split into several tries of bounded size, whose answers are compared. Rows may repeat; other columns stay.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import LOWER, UPPER

#: Rules of one broadcast trie.
TRIE_RULES = 200_000
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_MATCH = "struct<n:int,block:boolean,rule:string,verdict:string>"
_END = ""  # key of a node's own rules


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nested dicts from rules (verdict, host, path): host labels from the right, then whole path segments."""
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(("host", label), {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(("path", segment), {})
        node.setdefault(_END, []).append((last, verdict, host + path))
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule that fits, else two nulls."""
    best: tuple = (-1, False, None, None)
    labels = host.split(".") if host else []
    segments = path.split("/")
    node = trie
    for depth in range(len(labels)):
        node = node.get(("host", labels[-1 - depth]))
        if node is None:
            break
        below = node
        for at, segment in enumerate(segments):
            for last, verdict, rule in below.get(_END, ()):
                if segment.startswith(last):
                    best = max(best, (len(rule), verdict == "block", rule, verdict))
            below = below.get(("path", segment))
            if below is None:
                break
    return best[2], best[3]


def matcher(trie):
    """A function from hosts and paths to the best rule of a broadcast trie."""
    @F.pandas_udf(_MATCH)
    def match(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        rows = [longest_match(trie.value, h, p) for h, p in zip(host, path)]
        return pd.DataFrame([(len(r or ""), v == "block", r, v) for r, v in rows], columns=["n", "block", "rule", "verdict"])

    return match


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to pages, in place of columns of these names."""
    sc = pages.sparkSession.sparkContext
    df = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    found = []
    for lo in range(0, len(rules), TRIE_RULES):
        found.append(matcher(sc.broadcast(build_trie(rules[lo:lo + TRIE_RULES])))(F.col("host"), F.col("path")))
    best = (F.array_max(F.array(*found)) if len(found) > 1 else found[0]) if found else F.lit(None).cast(_MATCH)
    return (
        df.withColumn("_best", best).withColumn("rule", F.col("_best.rule"))
        .withColumn("verdict", F.coalesce("_best.verdict", F.lit(default))).drop("_best")
    )
