"""Ids of whole texts by a public tokenizer file, with the ids of recurring pieces kept.

Both kinds of tokenizer handled here split a text before they merge bytes, and never across the places named below, so
a text's ids are those of its pieces in a row. A piece is encoded by the tokenizers library when first seen and then
looked up. A tokenizer of another kind encodes whole texts.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: Pieces kept by a Python worker for each tokenizer (under 100 MB), and the longest of them.
KEPT, SHORT = 480_000, 64
#: ASCII signs other than the apostrophe.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_GAP = re.compile(r"(?<=\S)(?= \S)")
#: White space other than the single space and the line feed.
_ODD = re.compile(r"[^\S \n]")
#: Letters that no normalizer changes, but for their case.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_signs() -> dict[int, str]:
    """The sign by which a byte-level vocabulary writes a byte: printable Latin-1 itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_SIGNS = _byte_signs()


class PieceIds(dict):
    """Piece of a text -> its ids as packed integers. ``before``: what precedes every piece; ``share``: pieces of a generation."""

    def __init__(self, tokenizer, kind: str, dtype, share: int, before: str = ""):
        super().__init__()
        self.tokenizer, self.model, self.kind, self.before = tokenizer, tokenizer.model, kind, before
        self.code = {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        self.share = self.room = share
        self.old: dict[str, bytes] = {}

    def encode(self, piece: str) -> bytes:
        if self.kind == "whole" or not _LETTERS.fullmatch(piece):
            return self.whole(self.before + piece)
        word = self.before + piece if self.kind == "space first" else piece.lower()  # one piece for the model, too
        return array(self.code, [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_SIGNS))]).tobytes()

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is not None:
            self.keep(piece, ids)
            return ids
        if piece.isalpha():
            ids = self.encode(piece)
        elif (body := piece.rstrip(_TAIL)) and len(body) < len(piece) and _LETTERS.fullmatch(body[-1]):  # either pattern splits after a letter that no normalizer changes
            ids = self[body] + self.plain[piece[len(body) :]]
        elif self.kind == "space first" and 0 < (i := piece.find("\n")) < len(piece) - 1 and not piece[i - 1].isspace() and not piece[i + 1].isspace():
            ids = self[piece[:i]] + self.plain["\n"] + self.plain[piece[i + 1 :]]
        else:
            ids = self.encode(piece)
        if len(piece) <= SHORT:
            self.keep(piece, ids)
        return ids

    def keep(self, piece: str, ids: bytes) -> None:
        if self.room == 0:  # what hasn't been looked up since the last time goes
            self.old = dict(self)
            self.clear()
            self.room = self.share
        self.room -= 1
        self[piece] = ids

    @property
    def plain(self) -> PieceIds:
        return self


class SpacedIds(PieceIds):
    """For pieces after a space, which their key leaves out."""

    plain: PieceIds = None


class TextIds:
    """Packed ids of whole texts."""

    def __init__(self, path: str, dtype=np.uint32):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # a text that holds an added token's string, in any case, is encoded whole
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        pre = spec["pre_tokenizer"] or {}
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]:
            self.kind = "space first"
        elif pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and pre["pretokenizers"][0].get("invert"):
            self.kind = "space dropped"
        # each keeps two generations of its share
        first = KEPT // (8 if self.kind == "space first" else 2)
        self.pieces = PieceIds(tokenizer, self.kind, dtype, first)
        self.spaced = SpacedIds(tokenizer, self.kind, dtype, KEPT // 2 - first, " ")
        self.spaced.plain = self.pieces

    def __call__(self, text: str) -> bytes:
        if self.added is not None and self.added.search(text):
            return self.pieces.whole(text)
        if self.kind == "space dropped":
            return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))
        if self.kind == "whole":
            return self.pieces.encode(text)
        if "  " in text or " \n" in text or "\n " in text or _ODD.search(text):  # runs of white space stay in one piece
            return b"".join(map(self.pieces.__getitem__, _GAP.split(text)))
        first, *rest = text.split(" ")
        return (self.pieces[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))


_kept: dict[tuple, TextIds] = {}


def encoder(path: str, dtype=np.uint32) -> TextIds:
    """One for each file and Python worker, kept between tasks."""
    key = (path, np.dtype(dtype).str)
    if key not in _kept:
        _kept[key] = TextIds(path, dtype)
    return _kept[key]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
