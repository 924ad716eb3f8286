"""Token ids of whole texts with the tokenizers library, at the cost of distinct words rather than of all words.

Both vocabularies split a text before any merge, and a blank between two visible characters is always such a split.
So a text is cut there, and the ids of each piece are remembered in a table of bounded bytes. A piece of Latin letters is
one unit to both vocabularies and goes straight to the tokenizer's merges, any other through the whole tokenizer. A text
with any other white space than single blanks and line ends between visible characters is encoded whole. Results equal
those of encoding each text at once, which the tests hold against the library.

Defined cases: a null or empty text has no ids; pieces of any length are encoded whole, those over LONG characters are not
remembered; a text of more than PART pieces is looked up in parts, so the table exceeds its bound by one part at most.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

_ODD_SPACE = re.compile(r"\s\s")
#: Letters that neither normalisation nor splitting touches (but for case), with a blank before them or not.
_LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Visible ASCII marks other than the apostrophe, which can begin a unit of letters.
_MARKS = re.compile("[!-&(-/:-@\\[-`{-~]+")
#: What a table entry takes besides its characters and ids; pieces of more characters are not remembered; pieces looked up at a time.
ENTRY_BYTES, LONG, PART = 220, 64, 20_000


def _byte_alphabet() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: visible Latin-1 for themselves, the others from U+0100 up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = sorted(set(range(256)) - set(own))
    return {b: chr(256 + k) for k, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()
_BLANK = _ALPHABET[32]


class _Known:
    """Ids by piece, begun anew when the table has reached the bytes allowed."""

    def __init__(self, most_bytes: int):
        self.most, self.ids, self.bytes = most_bytes, {}, 0

    def put(self, piece: str, ids: bytes) -> None:
        self.ids[piece] = ids
        self.bytes += ENTRY_BYTES + len(piece) + len(ids)

    def bound(self) -> None:
        if self.bytes > self.most:
            self.ids, self.bytes = {}, 0


class Encoder:
    """ids of a text as the bytes of little-endian unsigned 32-bit integers.

    path: vocabulary file of the tokenizers library. leading_blank: whether a piece differs with a blank before it
    (byte-level vocabularies) or blanks are dropped (word-end vocabularies). most_bytes: size of the table of pieces.
    """

    def __init__(self, path: str, leading_blank: bool, most_bytes: int = 96 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.leading_blank = leading_blank
        self.known, self.tails = _Known(most_bytes), _Known(1 << 20)
        self.line_end = self._whole(["\n"])[0] if leading_blank else b""

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, word: str) -> bytes:
        """Ids of one unit of letters, by the tokenizer's model alone."""
        if not self.leading_blank:
            word = word.lower()
        if word.isascii():
            tokens = self.model.tokenize(word.replace(" ", _BLANK))
        else:
            tokens = self.model.tokenize(word.encode().decode("latin-1").translate(_ALPHABET))
        return array("I", [t.id for t in tokens]).tobytes()

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails.ids:
            self.tails.bound()
            self.tails.put(marks, self._whole([marks])[0])
        return self.tails.ids[marks]

    def _learn(self, pieces: set[str]) -> None:
        """Ids of unseen pieces. Letters and the marks after them are two units, which never merge; a line end before a piece is a unit too."""
        mixed, known, size = [], self.known.ids, 0
        blank = " " if self.leading_blank else ""
        for piece in pieces:
            before, bare = b"", blank + piece
            if blank and piece[:1] == "\n":
                before, bare = self.line_end, piece[1:]
            letters = _LETTERS.match(bare)
            end = letters.end() if letters else 0
            if end == len(bare) and end:
                ids = before + self._letters(bare)
            elif end and _MARKS.fullmatch(bare, end):
                stem = piece[: end - len(bare)]
                ids = known.get(stem)
                if ids is None:
                    ids = known[stem] = before + self._letters(bare[:end])
                    size += ENTRY_BYTES + len(stem) + len(ids)
                ids += self._tail(bare[end:])
            else:
                mixed.append((piece, before, bare))
                continue
            known[piece] = ids
            size += ENTRY_BYTES + len(piece) + len(ids)
        self.known.bytes += size
        if mixed:
            for (piece, before, _), ids in zip(mixed, self._whole([bare for _, _, bare in mixed])):
                self.known.put(piece, before + ids)

    def _look_up(self, pieces: list[str]) -> bytes:
        known = self.known
        known.bound()
        unseen = set(pieces).difference(known.ids)
        if unseen:
            self._learn(unseen)
        out = b"".join(map(known.ids.__getitem__, pieces))
        for piece in unseen:
            if len(piece) > LONG:
                known.bytes -= ENTRY_BYTES + len(piece) + len(known.ids.pop(piece))
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.leading_blank:
            if _ODD_SPACE.search(text):
                return self._whole([text])[0]
            pieces = text.replace("\n", " \n").split(" ")
            pieces[0] = "\n" + pieces[0]  # at the start of a text as at that of a line
        else:
            pieces = text.replace("\n", " ").split(" ")
        out = b"".join([self._look_up(pieces[k : k + PART]) for k in range(0, len(pieces), PART)])
        return out[len(self.line_end) :]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, leading_blank: bool) -> Encoder:
    """One encoder for each Python worker, which may outlive a task; its memory is the vocabulary and the bounded table."""
    key = (path, leading_blank)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, leading_blank)
    return _encoders[key]
