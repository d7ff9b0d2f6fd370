"""URL rules found by their rarest literal token.

A rule is a regular expression over `host + path` (or the whole address) with the literal tokens,
runs of letters and digits, that every match must hold whole. The index keeps each rule under the
one of its tokens that the fewest URLs have; a URL fetches the rules of its own tokens, and only
these run. Rules without a whole token are tried on every URL. The rule list comes from the caller
and is held by every task, so its size is checked.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 200_000
TOKEN = re.compile("[A-Za-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """`pattern` is searched in `part` ("place": host + path, "url": the whole address).

    The rule of the greatest `rank` wins; ties go to the earlier one.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    part: str = "place"
    rank: int = 0


def place_rule(verdict: str, place: str) -> Rule:
    """A rule host/path for the host, all its subdomains, and every path that starts so."""
    host, _, path = place.partition("/")
    path = "/" + path
    literal = TOKEN.findall(host) + TOKEN.findall(path)
    if path[-1].isascii() and path[-1].isalnum():
        literal.pop()  # the URL's own token may go on
    pattern = rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(place, verdict, pattern, tuple(literal), rank=1_000_000 + len(place))


def word_rule(verdict: str, word: str) -> Rule:
    """A rule for one whole token anywhere in the address, in either case of its letters as given."""
    return Rule(word, verdict, rf"(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])", (word,), "url")


# Addresses that rarely hold running text.
DEFAULT_RULES = [
    word_rule("block", w)
    for w in ("login", "signup", "cart", "checkout", "adserver", "doubleclick", "casino", "viagra", "torrent", "cgi")
] + [
    Rule("archive", "block", r"\.(?:zip|gz|exe|iso|rar)\Z", ()),
    Rule("address", "block", r"\A\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?/", ()),
]


def host_of(url: Column) -> Column:
    """Between the first :// and / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, matched (name of the deciding rule or null) and verdict.

    A null url, or one without ://, has an empty host and path; whole-address rules still see it.
    Every row is judged alone, in place, without a shuffle; repeated rows give equal results.
    Columns of `pages` with these names are replaced.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a task holds {MAX_RULES}")
    parted = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    index = build_index(rules, token_counts(parted, {t for r in rules for t in r.tokens}, url))

    @F.pandas_udf("matched string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = Finder(rules, index)
        for urls, hosts, paths in batches:
            best = [find(u if isinstance(u, str) else "", h + p) for u, h, p in zip(urls, hosts, paths)]
            yield pd.DataFrame(
                {"matched": [r and r.name for r in best], "verdict": [r.verdict if r else default for r in best]}
            )

    column = judge(F.col(url), F.col("host"), F.col("path"))
    return parted.withColumn("_judged", column).withColumns(
        {"matched": F.col("_judged.matched"), "verdict": F.col("_judged.verdict")}
    ).drop("_judged")


def token_counts(parted: DataFrame, tokens: set[str], url: str) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; counted by Spark over all rows."""
    seen = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", F.col(url), "host"), F.lit("([A-Za-z0-9]+)"), F.lit(1)))
    words = parted.select(F.explode(seen).alias("token")).where(F.col("token").isin(sorted(tokens)))
    return {r["token"]: r["n"] for r in words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def build_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers by rarest token; "" holds those to be tried always."""
    index = defaultdict(list)
    for i, rule in enumerate(rules):
        index[min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(i)
    return dict(index)


class Finder:
    """The winning rule of an address."""

    def __init__(self, rules: list[Rule], index: dict[str, list[int]]):
        self.rules, self.index = rules, index
        self.compiled: dict[int, re.Pattern] = {}

    def __call__(self, url: str, place: str) -> Rule | None:
        tokens = {""}.union(TOKEN.findall(url), TOKEN.findall(place))
        best, rank = None, None
        for i in sorted(i for t in tokens & self.index.keys() for i in self.index[t]):
            rule = self.rules[i]
            if rank is not None and rule.rank <= rank:
                continue
            if i not in self.compiled:
                self.compiled[i] = re.compile(rule.pattern)
            if self.compiled[i].search(place if rule.part == "place" else url):
                best, rank = rule, rule.rank
        return best
