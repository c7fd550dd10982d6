"""Ids from the tokenizers library, looked up by piece: a text is cut where no token can span, each distinct piece is encoded once per worker."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: Pieces that a worker remembers in each of two generations; with spaces and case they are more.
PIECES = 250_000
SPACED_PIECES = 600_000

_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SAFE = re.compile(r" ?\S*[^\W_İ]")
_MARKS = re.compile(r" ?\S+")
#: A mark or white space before a comma or full stop, two spaces in a row, space at the end: cuts there may split a token.
_RISK = re.compile(r"[^\w\s][.,]|[_\sİ][.,]|\s\s|\s$")
_OWN = frozenset([",", ".", "\n"])


def byte_characters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


_CHARACTERS = byte_characters()
_SPACE = chr(_CHARACTERS[32])


class _Unsafe(Exception):
    """A piece after which a cut may not be where a token ends."""


class _Pieces(dict):
    """piece -> ids; what a full generation held stays in reach for one more."""

    def __init__(self, ids_of, most: int):
        super().__init__()
        self.ids_of, self.most, self.old = ids_of, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.ids_of(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """encode(text) -> little-endian unsigned 32-bit ids as bytes, equal to the library's for the whole text.

    A text is cut before each space, comma and full stop and around each line end, and the pieces' ids are
    joined. That is exact where no token spans a cut: both splitting rules here end a token between a letter
    or digit and a mark, and before a single space. A piece that does not end in a letter or digit (and is no
    comma, full stop or line end itself) could break that for the cut after it, so a text with such a piece is
    searched for marks before a comma or full stop and for white space in a row; if it has any, it is encoded
    whole by the library.

    spaced: whether a token may begin with the space before it. Where it may not, white space only separates,
    case does not matter, and texts of Latin-1 characters are lower-cased before they are cut."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = self.tokenizer.normalizer is None
        most = SPACED_PIECES if self.spaced else PIECES
        self.pieces = _Pieces(self._ids, most)
        self.marked = _Pieces(self._ids_of_marked, most)

    def clear(self) -> None:
        for pieces in (self.pieces, self.marked):
            pieces.clear()
            pieces.old = {}

    def direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, piece: str) -> bytes:
        if self.spaced and piece.isascii() and (piece.isalpha() or piece[:1] == " " and piece[1:].isalpha()):
            return array("I", [t.id for t in self.tokenizer.model.tokenize(piece.replace(" ", _SPACE))]).tobytes()
        if _LETTERS.fullmatch(piece):
            # one token-splitting unit of letters: only the model's merges are left to do
            units = (piece if self.spaced else piece.lower()).encode().decode("latin-1").translate(_CHARACTERS)
            return array("I", [t.id for t in self.tokenizer.model.tokenize(units)]).tobytes()
        if not piece:
            return b""
        if piece not in _OWN and not _SAFE.fullmatch(piece):
            raise _Unsafe
        return self.direct(piece)

    def _ids_of_marked(self, piece: str) -> bytes:
        try:
            return self.pieces[piece]
        except _Unsafe:
            if not _MARKS.fullmatch(piece):
                raise
            return self.direct(piece)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "\x01" in text or "\n\n" in text or ",." in text or ".," in text or ".." in text or ",," in text:
            return self.direct(text)
        if self.spaced:
            cut = text.replace(" ", "\x01 ").replace(",", "\x01,").replace(".", "\x01.").replace("\n", "\x01\n\x01").split("\x01")
        else:
            if "<|" not in text:
                try:
                    text.encode("latin-1")
                    text = text.lower()
                except UnicodeEncodeError:
                    pass
            cut = text.replace("\n", " ").replace(",", " ,").replace(".", " .").split(" ")
        try:
            return b"".join(map(self.pieces.__getitem__, cut))
        except _Unsafe:
            pass
        try:
            return self.direct(text) if _RISK.search(text) else b"".join(map(self.marked.__getitem__, cut))
        except _Unsafe:
            return self.direct(text)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
