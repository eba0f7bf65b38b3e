"""Pre-tokens of whole texts, exactly as the tokenizers library cuts them.

Texts whose characters (lower-cased, if the tokenizer does that) all lie below U+0250 are cut by Python's ``re`` with the
letter, number and space classes of that range written out (there the
normalizer of the lower-casing tokenizer is plain ``lower``).  Any other text goes
through the library's own normalizer and pre-tokenizer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from tokenizers import Tokenizer

# Unicode letters, numbers and white space below U+0250, and the two
# published pre-token patterns written with them.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t\n\x0b\x0c\r \x85\xa0"
PATTERNS = {
    "ByteLevel": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
                            f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"),
    "Sequence": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+"),
}
BEYOND = re.compile("[^\x00-ɏ]")
PIECE = 1 << 16


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character, the published byte-level BPE rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PreTokenizer:
    """Cuts texts into pre-tokens; ``spec`` is the text of a tokenizer's JSON file."""

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        self.vocab, self.merges = parsed["model"]["vocab"], parsed["model"]["merges"]
        self.lower = parsed["normalizer"] is not None
        self.pattern = PATTERNS[parsed["pre_tokenizer"]["type"]]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        if any(t[k] for t in parsed["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.alphabet = byte_alphabet()

    def pieces(self, text: str) -> Iterator[str]:
        """The text cut where white space follows something else (never inside a pre-token)."""
        start, n = 0, len(text)
        while n - start > PIECE:
            end = start + PIECE
            while end < n and not (text[end] in " \n" and text[end - 1] not in SPACE and text[end - 1] < "ɐ"):
                end += 1
            yield text[start:end]
            start = end
        yield text[start:]

    def words(self, piece: str) -> list[str]:
        """Pre-tokens of a piece without special tokens."""
        plain = piece.lower() if self.lower else piece  # some capitals of the range leave it here
        if BEYOND.search(plain) is None:
            return self.pattern.findall(plain)
        if self.lower:
            piece = self.tokenizer.normalizer.normalize_str(piece)
        return [piece[s:e] for _, (s, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]

    def parts(self, text: str) -> Iterator[tuple[str | None, list[str]]]:
        """(special token, []) or (None, pre-tokens of a piece), in order."""
        spans = self.cut.split(text) if self.cut and "<" in text else [text]
        for k, span in enumerate(spans):
            if k % 2:
                yield span, []
            elif span:
                for piece in self.pieces(span):
                    yield None, self.words(piece)

    def exact(self, word: str) -> list[int]:
        """Ids of one pre-token by the library's merging."""
        mapped = "".join(map(self.alphabet.__getitem__, word.encode("utf-8")))
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]


_LOADED: dict[str, object] = {}


def per_worker(key: str, make):
    """One object per Python worker: rebuilt only when the broadcast changes."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = make()
    return _LOADED[key]
