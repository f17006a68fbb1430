"""Token ids of whole texts as a tokenizer library gives them, with a cache of words where that is exact."""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Words that one worker remembers; then it starts afresh, so memory is bounded.
CACHE_WORDS = 400_000
CACHE_WORD_CHARS = 64


def tokenizer_path(name: str) -> str:
    """A path as it is, or the place of a public tokenizer's file by its name."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def version(name: str) -> str:
    """Digest of the tokenizer's file; counts of another version are never reused."""
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def splits_at_spaces(path: str) -> bool:
    """Whether this tokenizer encodes the parts of a text between blanks independently and drops blanks.

    So it is where the pre-tokenizer keeps only matches of a pattern without white space, the normalizer works
    character by character, and nothing is added around a text.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers") or [{}]
    return (
        [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and norm["normalizers"][1].get("pattern") == {"Regex": "\\s+"}
        and steps[0].get("type") == "Split"
        and steps[0].get("pattern") == {"Regex": SPLIT}
        and steps[0].get("behavior") == "Removed"
        and bool(steps[0].get("invert"))
        and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in steps[1:]] == [("ByteLevel", False, False)]
        and spec.get("truncation") is None
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] or "\n" in t["content"] for t in spec.get("added_tokens", []))
    )


#: The splitting pattern that ``_word_pattern`` spells out; a file with another one is left to its library.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters beyond which (or with special strings) the library itself gets the text.
_USUAL = "\\t-\\r -~\xa1-\u024f\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u20ac"
_UNUSUAL = re.compile(f"[^{_USUAL}]")
_CONTROL = re.compile("[\\0-\\x08\\x0e-\\x1f\\x7f]")


def _word_pattern() -> re.Pattern:
    """The splitting tokenizer's pattern, its classes spelt out for the usual characters."""
    kinds = [(chr(c), unicodedata.category(chr(c))[0]) for c in range(0xA1, 0x250)]
    letters = "a-z" + "".join(c for c, kind in kinds if kind == "L")
    numbers = "0-9" + "".join(c for c, kind in kinds if kind == "N")
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^\\s{letters}{numbers}]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets write each byte as a printable letter: itself, or the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """One per worker and tokenizer."""

    def __init__(self, path: str):
        self._known: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}
        self._by_word = splits_at_spaces(path)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda text: model.encode(text, num_threads=1)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        if self._by_word:
            self._find = _word_pattern().findall
            self._model, self._letters = tokenizer.model, _byte_letters()

    def _ids_of_part(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self._letters)
        out = np.asarray([t.id for t in self._model.tokenize(letters)], "<u4").tobytes()
        if len(part) <= CACHE_WORD_CHARS:
            self._parts[part] = out
        return out

    def _ids_of_word(self, word: str) -> bytes:
        known = self._parts
        return b"".join([known.get(part) or self._ids_of_part(part) for part in self._find(word)])

    def ids_bytes(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if not self._by_word or "<|" in text or not text.isascii() and _UNUSUAL.search(text):
            return np.asarray(self._encode(text), "<u4").tobytes()
        if not text.isprintable() and _CONTROL.search(text):
            return np.asarray(self._encode(text), "<u4").tobytes()
        words = unicodedata.normalize("NFC", text).lower().split()
        known = self._known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            if len(self._parts) > CACHE_WORDS:
                self._parts.clear()
            for word in set(words).difference(known):
                known[word] = self._ids_of_word(word)
        out = b"".join(map(known.__getitem__, words))
        if max(map(len, words)) > CACHE_WORD_CHARS:
            for word in [w for w in set(words) if len(w) > CACHE_WORD_CHARS]:
                del known[word]
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.ids_bytes(t), "<u4") for t in texts]

    def count(self, texts: list[str]) -> list[int]:
        return [len(self.ids_bytes(t)) // 4 for t in texts]


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    return Encoder(tokenizer_path(name))
