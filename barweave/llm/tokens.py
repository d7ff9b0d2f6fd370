"""Token ids of whole texts by the `tokenizers` library, with a memory of words already encoded.

Natural text repeats its words, and the pre-tokenizers used here cut at word borders before any
merge is looked up. For the two known kinds of pre-tokenizer a text is therefore cut the same way
here, and the library encodes each different piece once per memory. Texts with characters outside
the range where the cut is known to agree, and all other tokenizers, go to the library whole.
With `special` a text that holds the string of an added token goes to the library whole, which turns
the string into the token's id, as is its default; otherwise these strings are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np

# Letters, numbers and white space up to U+024F (Unicode general categories L, N, White_Space).
LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = r"\t-\r \x85\xa0"
MARK = f"[^{SPACE}{LETTER}{NUMBER}]"
SUFFIX = "'(?:[stmd]|re|ve|ll)"
# Outside of this range, or where the case or white-space rules differ, the library sees the text.
UNSURE = re.compile(r"[\u0130\u0250-\u200f\u2028-\u20ab\u20ad-\U0010ffff]")
WORD_PIECES = re.compile(f"[{LETTER}]+|{SUFFIX}|[{NUMBER}]|{MARK}+")
BYTE_PIECES = re.compile(
    f" ?[{LETTER}]+| ?[{NUMBER}]+|{SUFFIX}| ?{MARK}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
# White space other than the space: beside a space, it is not cut off by splitting at spaces.
OTHER_SPACE = "\t\n\v\f\r\x85\xa0"
MEMORY = 350_000


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 characters for
    themselves, the other bytes, in order, from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Memory(dict):
    """Results of `compute` by argument: the newest `limit` ones at least, twice as many at most."""

    def __init__(self, compute: Callable[[str], bytes], limit: int = MEMORY):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.pop(key, None)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """`encode(text)`: the ids of a text as little-endian bytes of `dtype`."""

    def __init__(self, path: str, dtype: str | None = None, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.dtype = np.dtype(dtype or id_type(self.library.get_vocab_size(True)))
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        added = config.get("added_tokens") or []
        # Sought in the normalized text, a token can be there without its string in the text; ordinary ones are always sought.
        kind = "" if any(t["normalized"] or not t["special"] for t in added) else _kind(config)
        self.added = [t["content"] for t in added] if special else []
        self.letters, self.item = byte_letters(), {2: "H", 4: "I"}[self.dtype.itemsize]
        self.pieces = Memory(self._piece)
        self.cutter = {"word": self._by_words, "byte": self._by_bytes, "": self._whole}[kind]
        self.encode = self._around_added if self.added else self.cutter
        pattern = {"word": WORD_PIECES, "byte": BYTE_PIECES}.get(kind)
        self.cut = pattern.findall if pattern else None
        self.words = Memory(self._cut_and_join)
        self.spaced = Memory(lambda word: self._cut_and_join(" " + word))

    def _around_added(self, text: str) -> bytes:
        return self._whole(text) if any(token in text for token in self.added) else self.cutter(text)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, text: str) -> bytes:
        """One piece of the pre-tokenizer: straight to the library's merges."""
        letters = text.encode("utf-8").decode("latin-1").translate(self.letters)
        return array(self.item, [t.id for t in self.library.model.tokenize(letters)]).tobytes()

    def _cut_and_join(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def _by_words(self, text: str) -> bytes:
        if _unsure(text) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.lower().split()))

    def _by_bytes(self, text: str) -> bytes:
        if _unsure(text):
            return self._whole(text)
        if _loose_space(text):
            return self._cut_and_join(text)
        first, *rest = text.split(" ")
        return self.words[first] + b"".join(map(self.spaced.__getitem__, rest))


def _unsure(text: str) -> bool:
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return UNSURE.search(text) is not None


def _loose_space(text: str) -> bool:
    """Whether white space does anything but stand alone between two words, or in lines without spaces beside."""
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return True
    return any(c in text and (c + " " in text or " " + c in text) for c in OTHER_SPACE)


def _kind(config: dict) -> str:
    """Which known way of cutting the tokenizer file describes, if any."""
    norm, pre = config.get("normalizer"), config.get("pre_tokenizer") or {}
    if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        return "byte"
    steps = [(s["type"], s.get("content")) for s in (norm or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [{}])
    pattern = parts[0].get("pattern", {}).get("Regex")
    same = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    if steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and pattern == same:
        if len(parts) == 2 and parts[1]["type"] == "ByteLevel" and not parts[1]["use_regex"]:
            return "word"
    return ""


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, dtype: str | None = None, special: bool = False) -> Encoder:
    """One encoder per Python worker, kept between tasks."""
    if (path, dtype, special) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, dtype, special] = Encoder(path, dtype, special)
    return _ENCODERS[path, dtype, special]
