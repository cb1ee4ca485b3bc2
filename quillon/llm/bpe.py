"""Whole texts to token ids with a ``tokenizers`` file, one call of the library per distinct piece.

The byte-level pattern cuts a text into pieces that tokenize independently. No piece crosses the
place before a single space that precedes a visible character, so ``text.split(" ")`` finds
chunks that can be looked up as they are; only chunks not seen yet are cut by the pattern, and
only pieces not seen yet go to the library. A text in which the rule for spaces could fail (one before
another blank, one at its end, the mark of a special token) goes to the library whole.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

_LOADED: dict[int, ChunkEncoder] = {}
#: Chunks that a worker remembers, some 200 bytes each.
KEPT = 800_000
LONGEST_KEPT = 48
_BEFORE_BLANK = re.compile(r" \s")
#: The fixed pattern of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Byte-level vocabularies write a byte that Latin-1 can't print as a character from 256 on.
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_MARKS = dict(zip(sorted(set(range(256)) - PRINTED), range(256, 512), strict=False))


class _Known(dict):
    """What ``make`` gives for a text, kept for the first ``KEPT`` short ones: the common ones are among them."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        made = self.make(text)
        if len(self) < KEPT and len(text) <= LONGEST_KEPT:
            self[text] = made
        return made


class ChunkEncoder:
    """Encodes texts; what it remembers is bounded by ``KEPT`` and ``LONGEST_KEPT``."""

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.specials = tuple({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        wide = self.tokenizer.get_vocab_size() > 65536
        self.code, self.dtype = "I" if wide else "H", np.dtype("<u4" if wide else "<u2")
        rules = json.loads(tokenizer_json)
        before = rules.get("pre_tokenizer") or {}
        self.by_pieces = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not rules.get("normalizer")
        self.cut, self.tokenize = regex.compile(PATTERN).findall, self.tokenizer.model.tokenize
        self.known = _Known(self._chunk)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian words of ``dtype``."""
        of = self.known.__getitem__
        return [self._library(x) if self._whole(x) else b"".join(map(of, x.replace(" ", "\0 ").split("\0"))) for x in texts]

    def _library(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _whole(self, text: str) -> bool:
        return not self.by_pieces or text.endswith(" ") or "\0" in text or any(s in text for s in self.specials) or _BEFORE_BLANK.search(text) is not None

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk or of one piece; a piece is not cut further."""
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return self._piece(chunk)
        if chunk[1:-1].isalpha() and chunk[0] == " " and chunk[-1] in ".,!?;:":
            return self.known[chunk[:-1]] + self.known[chunk[-1]]
        pieces = self.cut(chunk)
        return self._piece(chunk) if len(pieces) == 1 else b"".join(map(self.known.__getitem__, pieces))

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha():
            marked = "\u0120" + piece[1:] if piece[0] == " " else piece
        else:
            marked = piece.encode().decode("latin-1").translate(BYTE_MARKS)
        return array(self.code, [t.id for t in self.tokenize(marked)]).tobytes()


def encoder(tokenizer_json: str) -> ChunkEncoder:
    """One encoder a worker process; it lives as long as the worker."""
    key = hash(tokenizer_json)
    if key not in _LOADED:
        _LOADED[key] = ChunkEncoder(tokenizer_json)
    return _LOADED[key]


def tokenizer_text(path: str) -> str:
    """The tokenizer file, read once on the driver; its size is that of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def as_u32(ids: bytes, dtype: np.dtype, end: int) -> np.ndarray:
    out = np.empty(len(ids) // dtype.itemsize + 1, "<u4")
    out[:-1] = np.frombuffer(ids, dtype)
    out[-1] = end
    return out
