"""Token ids of whole texts with a given tokenizer file, inside tasks."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np

from millrace.llm.common import sole_cache

#: Pieces between blanks that a task remembers, and their longest; only speed depends on them.
PIECES, LETTERS = 800_000, 40
#: Letters that every normaliser in use maps one to one, with the signs that may follow; see ``Encoder``.
_PLAIN, _CLOSING = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+"), ".,;:!?"
#: How the tokenizers in use split pieces of ASCII signs further, once in lower case.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Byte-level vocabularies write each byte as a character: itself if it is visible, else the next one from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
_BYTES = {b: b for b in _VISIBLE} | {b: 256 + i for i, b in enumerate(_HIDDEN)}

_ENCODERS: dict[tuple, Encoder] = {}


class _Memo(dict):
    """Ids of pieces, found when they are first asked for."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, piece: str) -> bytes:
        found = self.find(piece)
        if len(piece) <= LETTERS:
            self[piece] = found
        return found


class Encoder:
    """Encodes texts piece by piece, remembering the pieces.

    The tokenizers in use split at every blank and line feed and encode what stands between on its own, so
    a text's ids are those of its pieces. A piece of plain letters and closing signs splits further into the
    two, and its letters encode like their lower case, for which the library's model is asked directly, without
    the steps before it. Other pieces of ASCII signs split into runs of letters, digits and runs of signs. ``checked`` compares both with the whole tokenizer before they are used; with a tokenizer that
    differs, whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind, self.code = ("<u4", "I") if wide else ("<u2", "H")
        self.model = self.tokenizer.model
        self.added = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = _Memo(self._piece)
        self.by_piece = self.checked()

    def _packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def checked(self) -> bool:
        probe = "Reading writing, Êtres über!\nA Straße.. naïve: b? Zz;\n x çà-et-là 3.5 don't ÿ, Antidisestablishmentarianism "
        probe += "I'LL rock'n'roll A1b2-C3_d4 --'s '' 'S x@y.org/a?b=c&d=10,000.00!! (e.g.,) $5 #x <|endoftext|> ...'re 'd'm~`^"
        try:
            return self._whole(probe) == b"".join(map(self.pieces.__getitem__, probe.replace("\n", " ").split(" ")))
        except Exception:  # a kind of model that cannot be asked for words
            return False

    def _piece(self, piece: str) -> bytes:
        word = piece.rstrip(_CLOSING)
        if not word:
            return self._word(piece) if piece else b""
        if not (word.isascii() and word.isalpha() or _PLAIN.fullmatch(word)):
            lower = piece.lower()
            plain = piece.isascii() and piece.isprintable() and not any(x in lower for x in self.added)
            parts = _PARTS.findall(lower) if plain else []
            return b"".join(map(self.pieces.__getitem__, parts)) if len(parts) > 1 else self._whole(piece)
        lower = word.lower()
        # Words and signs are pieces too, so they share one memory with what they make up.
        found = self._word(word) if lower == piece else self.pieces[lower]
        return found if len(word) == len(piece) else found + self.pieces[piece[len(word) :]]

    def _word(self, word: str) -> bytes:
        written = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return self._packed([x.id for x in self.model.tokenize(written)])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned numbers of ``kind``; null counts as empty."""
        if not text:
            return b""
        if not self.by_piece:
            return self._whole(text)
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))

    def ids(self, text: str | None, end: int) -> bytes:
        """``encode`` with an end id."""
        return self.encode(text) + np.array([end], dtype=self.kind).tobytes()


def encoder(path: str) -> Encoder:
    """The task's encoder for a file, kept for the tasks to come."""
    sole_cache("tokens", _ENCODERS)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def wide(ids: bytes, kind: str) -> bytes:
    """The ids as little-endian unsigned 32-bit numbers."""
    return ids if kind == "<u4" else np.frombuffer(ids, dtype=kind).astype("<u4").tobytes()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where an installed public tokenizer lies; the same on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)
