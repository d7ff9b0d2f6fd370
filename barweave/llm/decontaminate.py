"""Benchmark decontamination with one Aho-Corasick automaton over the items' windows.

Text and items are normalised to words alike. Every run of 13 words of an item (the whole item if
it is shorter) is a pattern; the automaton reads each text once, word by word, and reports where
patterns end. Words are single characters to the automaton: those of the benchmark have their own,
all others share one. Places are mapped back to the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
# An automaton holds about so many windows (1 KB each); more take further passes over the text.
WINDOWS_PER_PASS = 100_000
# The benchmark passes through the driver and must not be larger than this.
MAX_ITEM_WORDS = 20_000_000
# Words are runs of these after lower-casing A-Z.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD_BYTE = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Normalised words in UTF-8; only A-Z change case."""
    if not isinstance(text, str):
        return []
    return text.encode("utf-8", "surrogatepass").lower().translate(_WORD_BYTE).split()


class Windows:
    """Automaton over the windows of some items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        found: dict[str, set[str]] = {}
        for name, text in items:
            letters = "".join(self._letter(w) for w in words_of(text))
            for i in range(max(1, len(letters) - window + 1) if letters else 0):
                found.setdefault(letters[i : i + window], set()).add(name)
        self.automaton = ahocorasick.Automaton()
        for pattern, names in found.items():
            self.automaton.add_word(pattern, (len(pattern), sorted(names)))
        self.empty = not found
        if found:
            self.automaton.make_automaton()

    def _letter(self, word: bytes) -> str:
        if word not in self.letters:
            n = len(self.letters) + 1
            self.letters[word] = chr(n if n < 0xD800 else n + 0x800)  # no surrogates
        return self.letters[word]

    def scan(self, text: str | None) -> tuple[list[str], list[tuple[int, int]], int]:
        """Items with windows in the text, runs of hit words (first, last exclusive), number of words."""
        words = words_of(text)
        if self.empty or not words:
            return [], [], len(words)
        get, items, runs = self.letters.get, set(), []
        for at, (length, names) in self.automaton.iter("".join([get(w, "\0") for w in words])):
            items.update(names)
            runs.append((at + 1 - length, at + 1))
        return sorted(items), merged(runs), len(words)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def char_spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point ranges of the original text for runs of word numbers."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    places = [m.span() for m in WORD.finditer(lower)]
    return [(places[first][0], places[last - 1][1]) for first, last in hits]


def item_blocks(benchmark: DataFrame, item: str, text: str, window: int) -> list[list[tuple[str, str]]]:
    """The benchmark in blocks for one automaton each; long items are cut so that no window is lost."""
    blocks, room, total = [], 0, 0
    for name, body in benchmark.select(F.col(item).cast("string"), F.col(text)).orderBy(item, text).toLocalIterator():
        words = [w.decode("utf-8", "surrogatepass") for w in words_of(body)] if name is not None else []
        total += len(words)
        if total > MAX_ITEM_WORDS:
            raise ValueError(f"the benchmark has more than {MAX_ITEM_WORDS} words; scan it in parts")
        for start in range(0, len(words), WINDOWS_PER_PASS):
            part = words[start : start + WINDOWS_PER_PASS + window - 1]
            if start and len(part) < window:
                break
            if room < len(part):
                blocks.append([])
                room = WINDOWS_PER_PASS
            blocks[-1].append((name, " ".join(part)))
            room -= len(part)
    return blocks


def contamination(
    docs: DataFrame, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """`docs` with a struct `contamination`: items (names), hits (word numbers), spans (code points),
    n_words, n_hit. hits and spans list first, last (exclusive), first, last, ... of the runs.

    No shuffle, and each row is judged alone: repeated rows give equal results. Null or empty text
    has no words; null items and items without words match nothing; items that share an id count
    once. Each further block of the benchmark reads the texts once more. A column of `docs` named
    `contamination` is replaced.
    """
    none = F.struct(*[F.array().cast(kind).alias(name) for name, kind in (("items", "array<string>"), ("hits", "array<long>"))])
    column: Column = none
    for block in item_blocks(benchmark, item, item_text, window) or [[]]:
        column = _scanner(block, window)(F.col(text), column)
    return docs.withColumn("contamination", column)


def _scanner(block: list, window: int):
    @F.pandas_udf("items array<string>, hits array<long>, spans array<long>, n_words long, n_hit long")
    def scan(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        windows = Windows(block, window)
        for texts, before in batches:
            rows = []
            for t, items, hits in zip(texts, before["items"], before["hits"]):
                names, runs, n = windows.scan(t)
                if len(items):
                    names = sorted({*names, *items})
                    runs = merged(runs + list(zip(hits[::2], hits[1::2])))
                spans = char_spans(t, runs) if runs else []
                rows.append((names, _flat(runs), _flat(spans), n, sum(b - a for a, b in runs)))
            yield pd.DataFrame(rows, columns=["items", "hits", "spans", "n_words", "n_hit"])

    return scan


def _flat(pairs: list[tuple[int, int]]) -> list[int]:
    return [int(x) for pair in pairs for x in pair]


def is_contaminated(column: str = "contamination") -> Column:
    n_hit, n_words = F.col(f"{column}.n_hit"), F.col(f"{column}.n_words")
    return (n_hit > 0) & (20 * n_hit >= n_words)
