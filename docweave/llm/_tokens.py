"""Token ids of whole texts, as little-endian unsigned 32-bit bytes, through a public tokenizer.

Encoding is a concatenation over pieces that a tokenizer never joins: what stands between white
space (word tokenizer), or what begins at a space (byte-level tokenizer). The library encodes
each distinct piece; results are kept in two generations of bounded size per worker, so memory
doesn't grow with the corpus and frequent pieces stay. Texts whose white space leaves a piece's
limits in doubt, and pieces outside Latin-1, go through the library as they are.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache

import regex

#: The patterns by which the two vocabularies split text before their merges.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_DOUBTFUL_SPACE = re.compile(r"(?:\s|\A) (?:\s|\Z)")
_NOT_RUST_SPACE = re.compile("[\x1c-\x1f]")


class _Recent(dict):
    """A cache that makes what it misses; the last two generations of `size` entries stay."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key) if self.old else None
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable character; others move past 255 in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> Encoder:
    """One per worker process: a worker runs many tasks, and later ones find the pieces of earlier ones."""
    return Encoder(path)


class Encoder:
    """ids(text): the ids of a text without special tokens, as bytes of 32-bit integers."""

    def __init__(self, path: str, pieces: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = self.tokenizer.normalizer is not None
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.simple = not any(t.rstrip(".,;:!?").lstrip().isalpha() for t in added)
        self.added = re.compile("|".join(re.escape(t) for t in added) or r"(?!)")
        self.split = regex.compile(WORD_SPLIT if self.words else BYTE_SPLIT)
        # the same pattern with Latin-1's letters and numerals written out, which the standard library's engine finds faster
        letters, numerals = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
        split = (WORD_SPLIT if self.words else BYTE_SPLIT).replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numerals}]")
        for name, members in ((r"\p{L}", letters), (r"\p{N}", numerals)):
            split = split.replace(f"[{name}]", f"[{members}]").replace(name, f"[{members}]")
        self.plain_split = re.compile(split)
        self.space = self.alphabet_of(" ")
        self.alphabet = str.maketrans(_byte_alphabet())
        self.core = _Recent(self._core, pieces)
        self.piece = _Recent(self._piece, pieces)
        self.spaced = _Recent(lambda p: self._piece(" " + p), pieces)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def alphabet_of(c: str) -> str:
        return _byte_alphabet()[ord(c)]

    def _core(self, pretoken: str) -> bytes:
        if pretoken.isascii():
            # of ASCII only blanks and control characters are written otherwise
            word = pretoken[1:] if pretoken[0] == " " else pretoken
            mapped = pretoken.translate(self.alphabet) if not word.isalnum() else word if word is pretoken else self.space + word
        else:
            mapped = pretoken.encode().decode("latin-1").translate(self.alphabet)
        return _packed([t.id for t in self.model.tokenize(mapped)])

    def _piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        if not piece.isascii() and max(piece) > "\xff":
            return self._whole(piece)
        if self.simple:
            # a word, or a word and one mark: what the pattern would find, without it
            word, mark = (piece[:-1], piece[-1]) if piece[-1] in ".,;:!?" else (piece, "")
            if (word[1:] if word[:1] == " " else word).isalpha():
                if self.words:
                    word = word.lstrip().lower()
                return self.core[word] + self.core[mark] if mark else self.core[word]
        if self.added.search(piece):
            return self._whole(piece)
        found = self.split.findall(piece.lower() if self.words else piece)
        return b"".join(map(self.core.__getitem__, found))

    def _plain(self, text: str) -> bool:
        """Latin-1 without added tokens or signs that engines take differently: the pattern finds all pieces of the whole text."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return not _NOT_RUST_SPACE.search(text) and "\x85" not in text and not self.added.search(text)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._plain(text):
            return b"".join(map(self.core.__getitem__, self.plain_split.findall(text.lower() if self.words else text)))
        if self.words:
            if _NOT_RUST_SPACE.search(text):
                return self._whole(text)
            return b"".join(map(self.piece.__getitem__, text.split()))
        if _DOUBTFUL_SPACE.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        return self.piece[first] + b"".join(map(self.spaced.__getitem__, rest))
