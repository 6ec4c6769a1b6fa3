"""SentencePiece encoding and decoding with byte-pair models, by vectorised rounds of merges.

A text gets a leading blank, blanks are written as U+2581, and the pair of neighbours whose joined piece has the best score
is merged, the leftmost of equals first, until no pair forms a piece. Here the words of many texts are
one flat array of symbols. A word ends where two characters meet that stand side by side in no piece, since nothing can be
merged across. In each round every word finds its best pair by a segmented minimum; all its occurrences are merged
at once, leftmost first where they overlap, as far as none of them makes a new pair that is as good, which has its
turn first. Merged symbols are closed up and finished words leave, until none is left. In a word longer than ``LONG`` symbols a pair
is merged already where it is the best among those within the length of the longest piece on both sides: what
lies farther away cannot take part in a piece with it. Pieces of blanks alone have equal scores, so a run of blanks is
merged from its left end into the longest such piece, over and over, and is cut there beforehand. The ids are the library's, which tests compare.

Characters without a piece become the pieces of their bytes. Words are encoded once per task as long as they are remembered.

Defined results: a null or empty text has no ids and decodes to the empty text. Repeated rows are encoded each; an empty table
gives no rows. Marks of special pieces in a text are ordinary characters. A literal U+2581 decodes to a blank, as in
the library. Models other than byte-pair models with byte pieces, no normalisation and a leading blank are refused.
"""

from __future__ import annotations

import codecs
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import sole_cache

BLANK = "▁"
#: Characters that are encoded together; words of more than ``LONG`` symbols see their surroundings only.
CHUNK, LONG = 1 << 20, 64
#: Words that a task remembers, and the longest of them; only speed depends on them.
WORDS, LETTERS = 300_000, 40
_NONE = np.iinfo(np.int64).max
#: A key that no pair has.
_APART = 1 << 62
_PROBE = f"Hello  wörld, 3.50\n\t日本語 {BLANK}x\0 <s></s> <0x41> aaaaaaa     zz 😀\U0010ffff'll " + " " * 77 + "x" + " " * 50

_CODERS: dict[str, Coder] = {}


def _one_by_one(error):
    return "�", error.start + 1


codecs.register_error("millrace.bytewise", _one_by_one)


class _Table:
    """Values of non-negative keys, found for whole arrays of keys: open addressing in an array four times as long."""

    def __init__(self, values: dict[int, int]):
        bits = max(4, (4 * len(values)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int64)
        left = np.fromiter(values.keys(), dtype=np.int64, count=len(values))
        right = np.fromiter(values.values(), dtype=np.int64, count=len(values))
        slot = self._slots(left)
        while len(left):
            free = np.flatnonzero(self.keys[slot] < 0)
            at, one = np.unique(slot[free], return_index=True)
            one = free[one]
            self.keys[at], self.values[at] = left[one], right[one]
            rest = np.ones(len(left), dtype=bool)
            rest[one] = False
            left, right, slot = left[rest], right[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, -1 where there is none."""
        slot = self._slots(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.values[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & (len(self.keys) - 1)
            there = self.keys[slot]
            match = there == keys[open_]
            found[open_[match]] = self.values[slot[match]]
            go_on = ~match & (there >= 0)
            open_, slot = open_[go_on], slot[go_on]
        return found


class Coder:
    """Vocabulary of a model as arrays, with encoding and decoding."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.bytes_at = np.array([pieces.index(f"<0x{b:02X}>") for b in range(256)]) if model.is_byte(model.piece_to_id("<0x00>")) else None
        place = {pieces[i]: i for i in plain}
        _, order = np.unique([-model.get_score(i) for i in range(size)], return_inverse=True)
        self.rank = order.astype(np.int64)
        self.longest = max(map(len, place))
        #: The symbol of each character: its piece, or a number beyond the pieces.
        self.letters = np.arange(0x110000, dtype=np.int64) + size
        for p, i in place.items():
            if len(p) == 1:
                self.letters[ord(p)] = i
        merges = {}
        for p, i in place.items():
            for k in range(1, len(p)):
                if p[:k] in place and p[k:] in place:
                    merges[place[p[:k]] * size + place[p[k:]]] = i
        self.pairs = _Table(merges)
        self.meet = _Table({ord(a) << 21 | ord(b): 1 for p in place for a, b in zip(p, p[1:])})
        self.table = [b"" if model.is_control(i) else bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode()
                      for i, p in enumerate(pieces)]
        self.table[model.unk_id()] = model.decode([model.unk_id()]).encode()
        self.blank_first = np.array([p.startswith(BLANK) for p in pieces])
        self.words: dict[str, bytes] = {}
        run = max((len(p) for p in place if not p.strip(BLANK)), default=1)
        # As many blanks as the longest piece of them if as many follow; a word with the blanks before it; blanks at the end.
        self.word = re.compile(f"{BLANK}{{{run}}}(?={BLANK}{{{run}}})|{BLANK}*[^{BLANK}]+|{BLANK}+")
        blank_inside = any(BLANK in p.lstrip(BLANK) for p in place)
        if blank_inside or self.bytes_at is None or self.encode([_PROBE])[0].tolist() != model.encode(_PROBE):
            raise ValueError(f"{path} is not a byte-pair model with byte pieces, a leading blank and no normalisation")

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of two symbols, -1 where they form none."""
        apart = (left < 0) | (left >= self.size) | (right >= self.size)
        return self.pairs.find(np.where(apart, _APART, left * self.size + right))

    def _ranks(self, joined: np.ndarray) -> np.ndarray:
        return np.where(joined >= 0, self.rank[joined], _NONE)

    def _merged(self, symbols: np.ndarray, first: np.ndarray, windows: bool) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left after all merges and where each starts; ``first`` marks the symbols that begin a word."""
        at = np.arange(len(symbols))
        done_at, done_symbols = [], []
        reach = self.longest
        while len(symbols):
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(symbols)))
            joined = np.append(self._joined(symbols[:-1], symbols[1:]), -1)
            joined[starts[1:] - 1] = -1
            ranks = self._ranks(joined)
            least = np.minimum.reduceat(ranks, starts)
            if (least == _NONE).any():
                over = np.repeat(least == _NONE, sizes)
                done_at.append(at[over])
                done_symbols.append(symbols[over])
                symbols, first, at, joined, ranks = (x[~over] for x in (symbols, first, at, joined, ranks))
                if not len(symbols):
                    break
                sizes, least = sizes[least != _NONE], least[least != _NONE]
                starts = np.cumsum(sizes) - sizes
            if windows:
                best = np.minimum(_before(ranks, reach), _before(ranks[::-1], reach)[::-1])
                found = (ranks <= best) & (ranks != _NONE)
                # One that waits for something better around it makes those after it wait.
                waits = _before(np.where(found, _NONE, ranks), reach) == ranks
            else:
                found = ranks == np.repeat(least, sizes)
                waits = np.zeros(len(found), dtype=bool)
            # Of overlapping pairs every other one, from the left.
            position = np.flatnonzero(found)
            run = np.append(True, np.diff(position) > 1)
            begins = position[run][np.cumsum(run) - 1]
            chosen = position[(position - begins) % 2 == 0]
            new, rank = joined[chosen], ranks[chosen]
            touches = np.append(False, np.diff(chosen) == 2)
            before = np.where(touches, np.append(-1, new[:-1]), symbols[np.maximum(chosen - 1, 0)])
            left = np.where(first[chosen], -1, self._joined(before, new))
            after = np.minimum(chosen + 2, len(symbols) - 1)
            ends = (chosen + 2 >= len(symbols)) | first[after]
            right = np.where(ends, -1, self._joined(new, symbols[after]))
            stops = (self._ranks(left) <= rank) | (self._ranks(right) <= rank)
            # All of a chain up to the first that makes a better pair or waits.
            word = np.cumsum(first)[chosen]
            chain = np.append(True, (np.diff(chosen) > reach + 2) | (np.diff(word) > 0)) if windows else np.append(True, np.diff(word) > 0)
            halted = np.cumsum(stops) - stops + np.cumsum(waits[chosen])
            base = (halted - waits[chosen])[chain][np.cumsum(chain) - 1]
            kept = halted == base
            symbols[chosen[kept]] = new[kept]
            stay = np.ones(len(symbols), dtype=bool)
            stay[chosen[kept] + 1] = False
            symbols, first, at = symbols[stay], first[stay], at[stay]
        at, symbols = np.concatenate(done_at), np.concatenate(done_symbols)
        order = np.argsort(at)
        return at[order], symbols[order]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers; its blanks are written as U+2581."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        begins = np.array([0, *accumulate(map(len, words))])[:-1]
        symbols = self.letters[points]
        first = np.append(True, self.meet.find(points[:-1] << 21 | points[1:]) < 0)
        first[begins] = True
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(symbols)))
        far = np.repeat(sizes > LONG, sizes)
        places, out = [], []
        for part, windows in ((~far, False), (far, True)):
            if part.any():
                at, merged = self._merged(symbols[part], first[part], windows)
                places.append(np.flatnonzero(part)[at])
                out.append(merged)
        places, out = np.concatenate(places), np.concatenate(out)
        order = np.argsort(places, kind="stable")
        places, out = places[order], out[order]
        unknown = np.flatnonzero(out >= self.size)
        if len(unknown):
            bytes_of = [chr(c).encode("utf-8", "surrogatepass") for c in (out[unknown] - self.size).tolist()]
            sizes = np.ones(len(out), dtype=np.int64)
            sizes[unknown] = [len(b) for b in bytes_of]
            ends = np.cumsum(sizes)
            places, out = np.repeat(places, sizes), np.repeat(out, sizes)
            where = np.concatenate([np.arange(e - len(b), e) for e, b in zip(ends[unknown].tolist(), bytes_of)])
            out[where] = self.bytes_at[np.frombuffer(b"".join(bytes_of), dtype=np.uint8)]
        raw, ends = out.astype("<i4").tobytes(), (4 * np.append(np.searchsorted(places, begins), len(out))).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null counts as empty."""
        split = [self.word.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        known = self.words
        if len(known) > WORDS:
            known.clear()
        new = list(set().union(*split).difference(known))
        known.update(zip(new, self.encode_words(new)))
        found = [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<i4") for words in split]
        for w in new:
            if len(w) > LETTERS:
                del known[w]
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the leading blank; bytes that form no character become U+FFFD each."""
        if not len(ids):
            return ""
        raw = b"".join(map(self.table.__getitem__, ids.tolist()))
        return raw[1 if self.blank_first[ids[0]] else 0 :].decode("utf-8", "millrace.bytewise")


def _before(ranks: np.ndarray, reach: int) -> np.ndarray:
    """Least of the ``reach`` entries before each."""
    window, covered = np.append(_NONE, ranks[:-1]), 1
    while covered < reach:
        step = min(covered, reach - covered)
        window = np.minimum(window, np.append(np.full(min(step, len(ranks)), _NONE), window[:-step]))
        covered += step
    return window


def coder(path: str) -> Coder:
    """The task's coder for a model, kept for the tasks to come."""
    sole_cache("sentence_pieces", _CODERS)
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def _chunks(texts: pa.Array):
    """Consecutive slices of about ``CHUNK`` characters; only one of them is held as Python strings."""
    part, held = [], 0
    for t in texts:
        part.append(t.as_py())
        held += len(part[-1] or "")
        if held >= CHUNK:
            yield part
            part, held = [], 0
    if part:
        yield part


def encoded(docs: DataFrame, path: str, text: str = "text", column: str = "ids") -> DataFrame:
    """``docs`` without ``text`` and with its ids, an array of int, as ``column``, instead of any of that name."""
    keep = [c for c in docs.columns if c not in (text, column)]

    def encode(batches):
        own = coder(path)
        for batch in batches:
            at = 0
            for part in _chunks(batch.column(text)):
                ids = own.encode(part)
                sizes = np.array([0, *accumulate(map(len, ids))], dtype=np.int32)
                made = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(ids), pa.int32()))
                rest = batch.slice(at, len(part))
                yield pa.record_batch([*[rest.column(c) for c in keep], made], names=[*keep, column])
                at += len(part)

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], f"`{column}` array<int>"])
    return docs.select(*keep, F.col(text)).mapInArrow(encode, schema)


def decoded(table: DataFrame, path: str, ids: str = "ids", column: str = "text") -> DataFrame:
    """``table`` with the text of ``ids`` as ``column``, instead of any of that name; null ids decode to the empty text."""
    table = table.select(*[c for c in table.columns if c != column or c == ids])

    def decode(batches):
        own = coder(path)
        for batch in batches:
            lists = batch.column(ids)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [own.decode(flat[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, column])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema], f"`{column}` string"])
    return table.mapInArrow(decode, schema)
