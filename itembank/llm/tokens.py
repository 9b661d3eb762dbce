"""Token ids of whole texts with the ``tokenizers`` library.

:class:`Encoder` gives exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.
For the tokenizers that lower-case, split into words and then merge inside each word, the ids of
a word don't depend on its neighbours: texts of plain Latin letters are split here and the ids of
frequent words are kept in a bounded memo, filled by the library. Any other text, and any other
tokenizer, goes through the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

#: The normaliser and splitter for which splitting here is the same thing.
KNOWN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Characters that NFC leaves alone and that lower-case one to one.
PLAIN = [*"\t\n\r", *map(chr, range(0x20, 0x7F)), *(chr(c) for c in range(0xA1, 0x180) if c != 0x130), *"–—‘’“”…€"]


def _chars(chars) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


def _splitter():
    lower = [c for c in PLAIN if not c.isspace()]
    letters = [c for c in lower if unicodedata.category(c)[0] == "L"]
    numbers = [c for c in lower if unicodedata.category(c)[0] == "N"]
    other = [c for c in lower if unicodedata.category(c)[0] not in "LN"]
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{_chars(letters)}+|{_chars(numbers)}|{_chars(other)}+"), re.compile(f"{_chars(PLAIN)}*")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be
    printed in Latin-1, and else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class _Memo(dict):
    """Word to the bytes of its ids; words beyond the bounds are encoded each time."""

    def __init__(self, encode, most: int, longest: int = 64):
        self.encode, self.most, self.longest = encode, most, longest

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(self) < self.most and len(word) <= self.longest:
            self[word] = ids
        return ids


class Encoder:
    """Ids as numpy arrays, ``uint16`` where the vocabulary allows it and else ``uint32``."""

    def __init__(self, path: str, memo: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (
            (spec.get("normalizer") or {}).get("normalizers") == KNOWN_NORMALIZER
            and pre[0].get("pattern") == {"Regex": KNOWN_SPLIT} and pre[0].get("behavior") == "Removed" and pre[0].get("invert")
            and [p.get("type") for p in pre] == ["Split", "ByteLevel"] and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
            and not spec["model"].get("dropout") and not spec.get("truncation") and not spec.get("padding")
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.split, self.plain = _splitter()
        self.letters, self.model = _byte_letters(), self.tokenizer.model
        self.memo = _Memo(self._word, memo)

    def _word(self, word: str) -> bytes:
        spelt = "".join(map(self.letters.__getitem__, word.encode()))
        return np.array([t.id for t in self.model.tokenize(spelt)], dtype=self.dtype).tobytes()

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; null is empty."""
        if not text:
            return np.zeros(0, self.dtype)
        if not self.by_word or not self.plain.fullmatch(text) or any(a in text for a in self.added):
            return self._library(text)
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.split.findall(text.lower()))), self.dtype)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that tasks share its memo."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
