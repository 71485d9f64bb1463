"""Token ids of texts as bytes of little-endian unsigned 32-bit integers, with the tokenizers library.

Both vocabularies cut a text at blanks before they merge, so the ids of a text are the ids of its pieces in order. A task
keeps the ids of pieces it has met and calls the library for new ones only; the result is the library's own for the whole text.
A text that holds one of the vocabulary's added tokens, such as an end mark, goes to the library uncut.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator


def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Known(dict):
    """Ids by piece; `rare` has those of the batch at hand only."""

    rare: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        return self.rare[piece]


class Encoder:
    """Encodes batches of texts; a null text is an empty one. `pieces` cuts a text where the vocabulary always does."""

    most_known = 200_000  # pieces a Python worker keeps, about 200 bytes each; later ones are kept for their batch only

    def __init__(self, path: str):
        self.tokenizer = _load(path)
        self.known = _Known()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def pieces(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; the new pieces of all `texts` go to the library in one call."""
        known = self.known
        known.rare = {}
        cut = [([t] if any(a in t for a in self.added) else self.pieces(t)) if t else [] for t in texts]
        new = list(set().union(*cut).difference(known))
        kept = known if len(known) < self.most_known else known.rare
        for piece, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            (kept if len(piece) <= 40 else known.rare)[piece] = _packed(found.ids)
        for pieces in cut:
            yield b"".join(map(known.__getitem__, pieces))


# Letters that both vocabularies see as letters, and the characters after which a piece may end for certain.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+(?=[ \\n.,!?*$%&#|]|\\Z)"
_MARKS = "[.,!?*$%&#|]+(?=[ \\n]|\\Z)"


class WordEncoder(Encoder):
    """For vocabularies that drop white space: blanks and line ends part pieces, and so do letters and marks."""

    pieces = staticmethod(re.compile(rf"{_LETTERS}|{_MARKS}|[^ \n]+").findall)


class ByteEncoder(Encoder):
    """For byte-level vocabularies: a single blank belongs to the piece after it, a single line end is a piece.

    Texts with other white space, or with two such characters in a row or at an end, stay whole.
    """

    most_known = 1_000_000

    _cut = staticmethod(re.compile(rf" ?{_LETTERS}|{_MARKS}|\n| ?[^ \n]+").findall)

    def pieces(self, text: str) -> list[str]:
        return self._cut(text) if len(text.split()) == text.count(" ") + text.count("\n") + 1 else [text]


_ENCODERS: dict[tuple[type, str], Encoder] = {}


def encoder(kind: type[Encoder], path: str) -> Encoder:
    """One encoder for each Python worker, so that later tasks find its pieces known."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]
