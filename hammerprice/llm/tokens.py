"""Token ids of whole texts, by the tokenizers library, with a memo of repeated words.

A byte-pair encoder never merges across the pieces that its pre-tokenizer cuts, so
ids of a text are the ids of its pieces, one after another. For texts whose
characters need no special care the pieces are looked up in a bounded memo and only
new ones go to the library's BPE model; any other text goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import held

#: Entries of one generation of a memo; two generations are kept.
MEMO = 400_000
#: Characters with which a text goes to the library whole: white space but blank and
#: line feed, controls, everything from U+0250, digits that aren't decimal ones, and
#: what may be a special token.
_CARE = re.compile("[^\n\x20-\x7e¡-ɏ]|[²³¹¼-¾]|<\\|")
#: White space that isn't a single blank or line feed between two words.
_LOOSE = re.compile("[ \n][ \n]|^[ \n]|[ \n]\\Z").search
#: Either, for a column of texts at once.
_UNFIT = _CARE.pattern + r"|[ \n][ \n]|^[ \n]|[ \n]\z"
_ENDS = "'s|'t|'re|'ve|'m|'ll|'d|"


class _Memo(dict):
    """word -> ids as bytes; old words leave when two generations are full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """``encode(text)`` gives the ids of one text as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        parts = spec["normalizer"]["normalizers"] if spec["normalizer"] else []
        self.folds = any(p["type"] == "Lowercase" for p in parts)
        drops = spec["pre_tokenizer"]["type"] == "Sequence"
        self.known = (drops and self.folds) or (spec["pre_tokenizer"]["type"] == "ByteLevel" and not parts and not spec["pre_tokenizer"]["add_prefix_space"])
        self.drops = drops
        if drops:  # white space is dropped: words between it, then letters, digits, others
            self.pieces = re.compile(_ENDS + r"[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
        else:  # a blank belongs to the word that follows
            self.chunks = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|\n").findall
            self.pieces = re.compile(_ENDS + r" ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}
        self.by_chunk = _Memo(self._chunk)
        self.by_word = _Memo(self._word)  # words after a blank

    def _word(self, word: str) -> bytes:
        """The ids of a blank and ``word``; of letters alone or with a point or comma no pieces are looked for."""
        if not self.drops:
            if word.isalpha():
                if word.isascii():
                    return array("I", [t.id for t in self.model.tokenize("\u0120" + word)]).tobytes()  # the blank's letter
                return self._piece(" " + word)
            if word[-1:] in (".", ",") and word[:-1].isalpha():
                return self.by_word[word[:-1]] + self.by_chunk[word[-1]]
        return self._chunk(" " + word)

    def _piece(self, piece: str) -> bytes:
        units = piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(units)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        pieces = self.pieces(chunk.lower() if self.folds else chunk)
        if len(pieces) == 1:
            return self._piece(pieces[0])
        return b"".join([self.by_word[p[1:]] if p[0] == " " and len(p) > 1 else self.by_chunk[p] for p in pieces])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known or _CARE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        memo = self.by_chunk
        if self.drops:
            return b"".join([memo[c] for c in text.split()])
        if _LOOSE(text):
            return b"".join([memo[c] for c in self.chunks(text)])
        return self._spaced(text)

    def _spaced(self, text: str) -> bytes:
        """The ids of a text that needs no care and whose words have one blank or line feed between them."""
        first, *lines = text.split("\n")
        out = self._line(first)
        for line in lines:
            out.append(self.by_chunk["\n"])
            out += self._line(line)
        return b"".join(out)

    def _line(self, line: str) -> list[bytes]:
        first, _, rest = line.partition(" ")
        return [self.by_chunk[first], *map(self.by_word.__getitem__, rest.split(" "))] if rest else [self.by_chunk[first]]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` of each text of a column."""
        if not self.known or self.drops:
            yield from map(self.encode, texts.to_pylist())
            return
        for text, unfit in zip(texts.to_pylist(), pc.match_substring_regex(texts, _UNFIT).to_pylist()):
            yield self.encode(text) if unfit or not text else self._spaced(text)


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; a Python worker opens it once and keeps it while it is in use."""
    return held(("encoder", path), lambda: Encoder(path))
