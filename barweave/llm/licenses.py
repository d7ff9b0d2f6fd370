"""License notices in text: winnowed fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import resources
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3  # words of a fingerprint
WINNOW = 4  # of so many fingerprints in a row the least is kept
FEW = 24  # of a template with fewer kept fingerprints all are indexed, of runs short enough to outlast the words it may lack
BAND = 12  # words by which a match may drift from its diagonal
LEAST_COVERAGE = 0.7
MAX_TEMPLATE_WORDS = 2_000_000
WORD = re.compile(r"[^\W_]+")
MATCH, MISS = 2, -1

# The notices the licenses' own authors ask for, whole.
NOTICES = {
    "Apache-2.0 (notice)": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "MPL-2.0 (notice)": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
} | {
    f"{name} (notice)": f"""This {kind} is free software: you can redistribute it and/or modify it under the terms of the GNU
        {title} as published by the Free Software Foundation, either version {version} of the License, or (at your
        option) any later version. This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        {title} for more details. You should have received a copy of the GNU {title} along with this {kind}. If not,
        see <http://www.gnu.org/licenses/>."""
    for name, kind, title, version in [
        ("GPL-2.0", "program", "General Public License", "2"),
        ("GPL-3.0", "program", "General Public License", "3"),
        ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
        ("LGPL-3.0", "library", "Lesser General Public License", "3"),
        ("AGPL-3.0", "program", "Affero General Public License", "3"),
    ]
}
# The whole license texts lie beside this module, one file each, named by their SPDX identifiers.
TEXTS = (
    "Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC",
    "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
TEMPLATES = {
    name: resources.files("barweave.llm").joinpath("license_texts", f"{name}.txt").read_text("utf-8") for name in TEXTS
} | NOTICES
# Templates that are variants of each other: over the same words, the one that matches most of them is reported.
RIVALS = {name: "BSD" for name in ("BSD-2-Clause", "BSD-3-Clause")}
RIVALS |= {name: "GNU" for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")}
RIVALS |= {name: "notice" for name in NOTICES if "GPL" in name}

# One sentence that names a license: a verb, "under" and the name. Names are read as written; of the other words one may
# be missing or changed, as far as the coverage allows.
GRANTS = frozenset(
    "licensed licenced relicensed sublicensed released distributed redistributed published provided available offered shared covered "
    "governed used reused usable protected".split()
)
FILLERS = frozenset("the a an this its terms term of conditions condition following and same either".split())
GNU = r"(?:GNU[\W_]+)?"
NAMES = [
    ("AGPL", GNU + r"(?:Affero[\W_]+General[\W_]+Public[\W_]+Licen[sc]e|AGPL)"),
    ("LGPL", GNU + r"(?:(?:Lesser|Library)[\W_]+General[\W_]+Public[\W_]+Licen[sc]e|LGPL)"),
    ("GPL", GNU + r"(?:General[\W_]+Public[\W_]+Licen[sc]e|GPL)"),
    ("MPL", r"(?:Mozilla[\W_]+Public[\W_]+Licen[sc]e|MPL)"),
    ("EPL", r"(?:Eclipse[\W_]+Public[\W_]+Licen[sc]e|EPL)"),
    ("Apache", r"Apache(?:[\W_]+Software)?(?:[\W_]+Licen[sc]e)?"),
    ("Artistic", r"Artistic[\W_]+Licen[sc]e"),
    ("CC0", r"(?:CC0|CC[\W_]+Zero|Creative[\W_]+Commons[\W_]+Zero)"),
    ("CC-BY", r"(?:CC[\W_]+BY(?![^\W_])|Creative[\W_]+Commons[\W_]+Attribution)"
        r"(?:[\W_]+(?:NC|SA|ND|Non[\W_]?Commercial|Share[\W_]?Alike|No[\W_]?Deriv(?:ative|ativ)?(?:e?s)?(?:[\W_]+Works)?)(?![^\W_]))*"),
    ("BSD-2-Clause", r"(?:(?:(?:2|two)[\W_]+clause|simplified|FreeBSD)[\W_]+BSD|BSD[\W_]+(?:2|two)[\W_]+clause)"),
    ("BSD-3-Clause", r"(?:(?:(?:3|three)[\W_]+clause|new|modified|revised)[\W_]+BSD|BSD[\W_]+(?:3|three)[\W_]+clause)"),
    ("BSD", r"BSD"),
    ("BSL", r"(?:Boost[\W_]+Software[\W_]+Licen[sc]e|BSL)"),
    ("MIT", r"(?:MIT|Expat)"),
    ("ISC", r"ISC"),
    ("Unlicense", r"Unlicense"),
    ("Zlib", r"zlib(?:[\W_]+libpng)?"),
]
NAMED = re.compile(
    r"(?<![^\W_])(?:" + "|".join(f"({pattern})" for _, pattern in NAMES) + r")(?![^\W_])(?:[\W_]+style(?![^\W_]))?"
    r"(?:[\W_]+(?:Public[\W_]+)?(?:Licen[sc]e|Dedication)(?![^\W_]))?"
    r"(?:[\W_]{0,3}(?:(?:version|v)\.?\s*)?(\d(?:\.\d){0,2})(?![^\W_]))?(?:[\W_]+(?:International|Unported|Universal)(?![^\W_]))?"
    r"(?:[\W_]+(?:Public[\W_]+)?Licen[sc]e(?![^\W_]))?",
    re.IGNORECASE,
)
FIRST_WORDS = frozenset(
    "gnu affero agpl lesser library lgpl general gpl mozilla mpl eclipse epl apache artistic cc0 cc creative 2 two simplified freebsd "
    "bsd 3 three new modified revised boost bsl mit expat isc unlicense zlib".split()
)
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
REACH = 160  # code points before a name in which the sentence begins


@dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    first: int
    last: int


def word_ids(text: str) -> tuple[np.ndarray, list[str]]:
    words = WORD.findall(text.lower())
    return np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)), words


def grams(ids: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash for every run of `size` words; one of all words if there are fewer."""
    if len(ids) == 0:
        return ids
    size = min(size, len(ids))
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + len(out)] + np.uint64(1)
        out ^= out >> np.uint64(29)
    return out


def winnow(prints: np.ndarray) -> list[int]:
    """Places of the kept fingerprints: the rightmost least of every WINNOW in a row."""
    kept = []
    for i in range(max(1, len(prints) - WINNOW + 1) if len(prints) else 0):
        view = prints[i : i + WINNOW]
        place = i + len(view) - 1 - int(view[::-1].argmin())
        if not kept or kept[-1] != place:
            kept.append(place)
    return kept


def spdx_matches(text: str) -> list[Match]:
    """The identifiers of every SPDX line, in the order read; an exception after WITH is part of its license."""
    out = []
    for line in SPDX.finditer(text):
        names, end, after = [], 0, True
        for token in re.finditer(r"[A-Za-z0-9.+:-]+|[()]|\S", line[1]):
            word = token[0].upper()
            if word in "()":
                continue
            if after == (word in ("AND", "OR", "WITH")) or not re.match(r"[A-Za-z0-9]", word):
                break
            if not after:
                after = word
                continue
            if after != "WITH":
                names.append(token[0].rstrip(".:-"))
            end, after = token.start() + len(token[0].rstrip(".:-")), False
        out += [Match(f"{name} (SPDX)", 1.0, line.start(), line.start(1) + end) for name in dict.fromkeys(names)]
    return out


def line_matches(text: str, words: list[str], least: float) -> list[Match]:
    """Sentences that name a license: the verb, "under" and the words of the name are counted, fillers are not."""
    if FIRST_WORDS.isdisjoint(words) or not ("under" in words or not GRANTS.isdisjoint(words)):
        return []
    out = []
    for name in NAMED.finditer(text):
        low = max(0, name.start() - REACH)
        before = [(m[0].lower(), low + m.start()) for m in WORD.finditer(text[low : name.start()])][::-1]
        before = [*before, ("", 0), ("", 0), ("", 0)]
        at = strange = 0
        while before[at][0] in FILLERS:
            at += 1
        if before[at][0] != "under" and before[at][0] not in GRANTS:
            at, strange = at + 1, 1
            while before[at][0] in FILLERS:
                at += 1
        first, cues = None, 0
        if before[at][0] == "under":
            first, cues, at = before[at][1], 1, at + 1
        if before[at][0] in GRANTS:
            first, cues = before[at][1], cues + 1
        size = len(WORD.findall(name[0]))
        coverage = (cues + size) / (2 + size + strange)
        if first is not None and coverage >= least:
            out.append(Match(f"{_identifier(name)} (line)", round(coverage, 6), first, name.end()))
    return out


def _identifier(name: re.Match) -> str:
    k = next(i for i in range(len(NAMES)) if name[i + 1])
    own, version = NAMES[k][0], name[len(NAMES) + 1]
    if own == "CC-BY":
        said = re.sub(r"[\W_]", "", name[k + 1]).lower()
        own += "".join(f"-{x}" for x, long in (("NC", "noncommercial"), ("SA", "sharealike"), ("ND", "noderiv")) if long in said
                       or re.search(rf"(?<![^\W_]){x}(?![^\W_])", name[k + 1], re.IGNORECASE))
    if version and own not in ("MIT", "ISC", "Unlicense", "Zlib") and not own.startswith("BSD"):
        own += "-" + (version if "." in version else version + ".0")
    return own


class Scanner:
    """The inverted index of the templates' fingerprints, and the search."""

    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE, lines: bool = False):
        self.least, self.lines = least, lines
        self.words, self.ids = {}, {}
        self.index: dict[int, dict[int, list[tuple[str, int]]]] = defaultdict(lambda: defaultdict(list))  # by words of a gram
        for name, text in templates.items():
            self.ids[name], self.words[name] = word_ids(text)
            kept = winnow(grams(self.ids[name]))
            size = GRAM if len(kept) >= FEW else unbroken(len(self.words[name]), least)
            prints = grams(self.ids[name], size)
            for place in kept if len(kept) >= FEW else range(len(prints)):
                self.index[size][int(prints[place])].append((name, place))
        self.known = {size: np.array(sorted(prints), np.uint64) for size, prints in self.index.items() if prints}

    def scan(self, text: str | None) -> list[Match]:
        """Matches in code points of the text. A run of template words that covers a winnowing window is
        found, and a short template whichever of its words are changed."""
        if not isinstance(text, str):
            return []
        ids, words = word_ids(text)
        out = spdx_matches(text) + line_matches(text, words, self.least) if self.lines else []
        found = self._aligned(ids, words)
        if found:
            places = [m.span() for m in WORD.finditer(text)]
            if len(places) != len(words):  # a character changed its length in lower case
                places = _places(text)
            out += [Match(name, round(c, 6), places[a][0], places[b][1]) for (name, a, b), c in found.items()]
        return sorted(out, key=lambda m: (m.first, m.last, m.license))

    def _aligned(self, ids: np.ndarray, words: list[str]) -> dict[tuple[str, int, int], float]:
        diagonals = defaultdict(set)
        for size, known in self.known.items():
            if len(ids) < size:
                continue
            prints = grams(ids, size)
            at = np.searchsorted(known, prints)
            for place in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == prints).tolist():
                for name, own in self.index[size][int(prints[place])]:
                    diagonals[name].add(place - own)
        if not diagonals:
            return {}
        found, present = {}, np.unique(ids)
        for name, offsets in diagonals.items():
            template, size = self.ids[name], len(self.words[name])
            if np.isin(template, present).sum() < self.least * size:
                continue
            for first, last, matched in self._apart(name, ids, words, near_ones(sorted(offsets), min(BAND, size - 1))):
                found[name, first, last] = matched / size
        return without_rivals(found, {name: len(w) for name, w in self.words.items()})

    def _apart(self, name: str, ids: np.ndarray, words: list[str], offsets: list[int]) -> list[tuple[int, int, int]]:
        """(first, last, matched) of the matches of one template, none over another's words: the best is taken first, and the
        search goes on in the words before and after it."""
        template, own = self.ids[name], self.words[name]
        least, taken, heap = self.least * len(own), [], []

        def look(offset: int, low: int, high: int) -> None:
            if high > low and most(template, ids[low:high], offset - low) >= least:
                matched, first, last = align(own, words[low:high], offset - low)
                if matched >= least:
                    heapq.heappush(heap, (-matched, first + low, last + low, offset, low, high))

        for offset in offsets:
            look(offset, 0, len(words))
        while heap:
            matched, first, last, offset, low, high = heapq.heappop(heap)
            over = next((t for t in taken if t[0] <= last and first <= t[1]), None)
            if over is None:
                taken.append(over := (first, last, -matched))
            look(offset, low, min(high, over[0]))
            look(offset, max(low, over[1] + 1), high)
        return taken


def unbroken(size: int, least: float) -> int:
    """Words, GRAM at most, that stay in a row in any choice of `least` of `size` words."""
    lost = int((1 - least) * size + 1e-9)
    return max(1, min(GRAM, -(-(size - lost) // (lost + 1))))


def most(template: np.ndarray, ids: np.ndarray, offset: int) -> int:
    """A bound for the words that `align` can match: those with an equal word anywhere in the band."""
    low, high = max(0, -offset - BAND), min(len(template), len(ids) - offset + BAND)
    if high <= low:
        return 0
    seen = np.zeros(high - low, bool)
    for drift in range(offset - BAND, offset + BAND + 1):
        a, b = max(low, -drift), min(high, len(ids) - drift)
        if a < b:
            seen[a - low : b - low] |= template[a:b] == ids[a + drift : b + drift]
    return int(seen.sum())


def without_rivals(found: dict[tuple[str, int, int], float], sizes: dict[str, int]) -> dict[tuple[str, int, int], float]:
    """Of rivals over mostly the same words the one with most words matched stays, then the one covered best."""
    kept: dict[tuple[str, int, int], float] = {}
    for (name, a, b), c in sorted(found.items(), key=lambda x: (-round(x[1] * sizes[x[0][0]]), -x[1], x[0])):
        beaten = any(
            name != other and name in RIVALS and RIVALS.get(other) == RIVALS[name]
            and 2 * (min(b, y) - max(a, x) + 1) > min(b - a, y - x) + 1
            for other, x, y in kept
        )
        if not beaten:
            kept[name, a, b] = c
    return kept


def _places(text: str) -> list[tuple[int, int]]:
    back = [i for i, ch in enumerate(text) for _ in ch.lower()]
    return [(back[m.start()], back[m.end() - 1] + 1) for m in WORD.finditer(text.lower())]


def near_ones(offsets: list[int], width: int = BAND) -> list[int]:
    """One offset for each run of offsets that lie within `width` of each other."""
    out, group = [], [offsets[0]]
    for x in offsets[1:]:
        if x - group[0] > width:
            out.append(group[len(group) // 2])
            group = []
        group.append(x)
    return [*out, group[len(group) // 2]]


def align(template: list[str], words: list[str], offset: int) -> tuple[int, int, int]:
    """Best local alignment within BAND of a diagonal: words matched, and the first and last text word."""
    width = 2 * BAND + 1
    low = offset - BAND
    above = [(0, 0, -1)] * (width + 1)  # score, matches, first text word
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        row, left = [], (0, 0, -1)
        for k in range(width):
            j = low + i + k
            cell = (0, 0, -1)
            if 0 <= j < len(words):
                score, n, first = above[k]
                if words[j] == word:
                    cell = (score + MATCH, n + 1, first if first >= 0 else j)
                elif score + MISS > 0:
                    cell = (score + MISS, n, first)
                for other in (above[k + 1], left):  # a template word or a text word without partner
                    if other[0] + MISS > cell[0]:
                        cell = (other[0] + MISS, other[1], other[2])
                if cell[0] > best[0] and words[j] == word:
                    best = (cell[0], cell[1], cell[2], j)
            row.append(cell)
            left = cell
        above = [*row, (0, 0, -1)]
    return best[1], best[2], best[3]


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE, text: str = "text"
) -> DataFrame:
    """`docs` with `licenses`: array of (license, coverage, first, last), by place in the text.

    coverage is the share of the template's words that are matched; first and last (exclusive) are
    code points. Without `templates` the scan knows TEMPLATES, of which variants of each other are told
    apart (RIVALS), sentences that name a license ("X (line)") and SPDX lines ("X (SPDX)"); given
    templates are looked for alone. Null or empty text has no matches. Rows are judged alone, without a shuffle;
    repeated rows give equal results; a column `licenses` of `docs` is replaced. The templates are
    held by every task and must have fewer than MAX_TEMPLATE_WORDS words in all.
    """
    chosen, lines = (TEMPLATES, True) if templates is None else (templates, False)
    if sum(len(WORD.findall(t)) for t in chosen.values()) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words; scan them in parts")

    @F.pandas_udf("array<struct<license:string,coverage:double,first:long,last:long>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(chosen, least, lines)
        for texts in batches:
            yield pd.Series([[vars(m) for m in scanner.scan(t)] for t in texts], dtype=object)

    return docs.withColumn("licenses", scan(F.col(text)))
