"""Encoding with a public tokenizer file, with a cache of the encodings of blank-separated pieces."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from siftlake.llm.held import hold

#: A blank between two blanks may belong to a longer run, which the tokenizer splits as a whole.
_RUN = re.compile(r"\s \s")
_ASCII_BLANKS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_BLANKS = _ASCII_BLANKS + "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_CUT = re.compile(r"(?<!\s) | (?!\s)")
#: Latin letters, then other ASCII signs than letters, digits and blanks: always separate tokens.
_WORD_AND_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]+)")
#: Pieces that a cache holds, and characters of a piece that is kept at all: together they bound its memory.
CACHE_PIECES, CACHED_CHARS = 1_200_000, 64


class _Cache(dict):
    """Piece -> its ids as bytes; ``lead`` is what stands before the piece in the text.

    A new piece is put together from parts that recur more often, where the tokenizer's pattern is sure to cut:
    at a single line end between other signs, and between a word and the signs that follow it.
    """

    def __init__(self, tokenizer: Tokenizer, lead: str, code: str, first: _Cache | None = None) -> None:
        self.tokenizer, self.lead, self.code = tokenizer, lead, code
        self.first = self if first is None else first

    def _encode(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        line, end, rest = piece.partition("\n")
        if end and line and rest and not line[-1].isspace() and not rest[0].isspace():
            ids = self[line] + self.first["\n"] + self.first[rest]
        elif (parts := _WORD_AND_SIGNS.fullmatch(piece)) and "<|" not in piece:
            ids = self[parts[1]] + self.first[parts[2]]
        else:
            ids = self._encode(self.lead + piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def _has_runs(text: str) -> bool:
    """Whether a blank stands between white space; most texts have no candidates for it."""
    few = "  " not in text and "\n " not in text and " \n" not in text
    if few and not any(c in text for c in (_ASCII_BLANKS if text.isascii() else _BLANKS)):
        return False
    return _RUN.search(text) is not None


class Encoder:
    """Whole texts to ids, equal to encoding them in one call.

    The tokenizer's pattern never lets a token cross a blank's left side unless the blank stands between other
    white space. So a text is cut before such blanks and each piece's ids are kept: most pieces recur.
    """

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        parts = json.loads(tokenizer.to_str())
        splits = parts["pre_tokenizer"] or {}
        if parts["normalizer"] or splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex", True):
            raise ValueError(f"{path}: texts are cut before blanks, which is right for a plain byte-level pattern only")
        self.dtype = np.dtype("<u2") if tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        code = "H" if self.dtype.itemsize == 2 else "I"
        self.first = _Cache(tokenizer, "", code)
        self.rest = _Cache(tokenizer, " ", code, self.first)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        first, *rest = _CUT.split(text) if _has_runs(text) else text.split(" ")
        cache = self.rest
        return np.frombuffer((self.first[first] if first else b"") + b"".join([cache[piece] for piece in rest]), self.dtype)


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, so its cache lives across the tasks of an operator."""
    return hold(("encoder", path), lambda: Encoder(path))
