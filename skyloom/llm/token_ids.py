"""Token ids of texts by a tokenizers file, each distinct piece encoded once.

A byte-level BPE file encodes each pre-token (piece) by itself, so the ids of a
text are the ids of its pieces in order.  A batch of texts is cut into pieces in
numpy, equal pieces are found by their bytes, and only those that the worker
hasn't met go to the library.  The numpy cut knows ASCII and the letters U+00C0 to
U+017F; texts with other characters, and texts with the string of an added token,
go to the library whole.
"""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np

from .common import keeps_cache, trim_memory, utf8
from .spans import distinct_spans

#: Pieces that a worker remembers before it starts anew.
REMEMBERED = 1_500_000
#: Runs of letters in a text that goes to the library: longer texts cost more a piece, as do single pieces.
TOGETHER = 100

_made: dict[str, PieceEncoder] = {}
keeps_cache("pieces", _made.clear)


#: Classes of bytes: letters (two-byte letters are letters byte by byte), digits, white space, others, not known here.
LETTER, DIGIT, SPACE, OTHER, UNKNOWN = 1, 2, 3, 4, 5
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[[*range(65, 91), *range(97, 123)]] = LETTER
CLASSES[48:58] = DIGIT
CLASSES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = SPACE
CLASSES[28:32] = UNKNOWN  # splitters differ on these
CLASSES[0x80:] = UNKNOWN
CLASSES[0x80:0xC0] = LETTER
CLASSES[[0xC3, 0xC4, 0xC5]] = LETTER


def piece_starts(raw: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece starts as a mask, class of each byte) of texts that stand one after another.

    A run of white space before another character is cut before its last character;
    a single blank joins what follows it.
    """
    kind = CLASSES[raw]
    before = np.empty_like(kind)
    before[0:1], before[1:] = 0, kind[:-1]
    after = np.zeros_like(kind)
    after[:-1] = kind[1:]
    first = text_starts[text_starts < len(raw)]
    before[first] = 0
    inner = first[first > 0]
    after[inner - 1] = 0
    blank = np.zeros(len(raw), bool)
    blank[1:] = (raw[:-1] == 32) & (before[1:] == SPACE)
    white = kind == SPACE
    start = np.where(white, (before != SPACE) | ((after != SPACE) & (after != 0)), (before != kind) & ~blank)
    marks = np.flatnonzero((raw == 39) & start & (after == LETTER))
    if len(marks):
        follow = np.concatenate([raw, np.zeros(3, np.uint8)])
        limit = np.append(first, len(raw))
        end = limit[np.searchsorted(first, marks, side="right")]
        one, two = follow[marks + 1], follow[marks + 2]
        room = end - marks
        length = np.where((room > 2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))), 2, np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0))
        marks, length, end = marks[length > 0], length[length > 0], end[length > 0]
        start[marks + 1] = False
        rest = marks + 1 + length
        inside = rest < end
        rest = rest[inside]
        start[rest[kind[rest] == LETTER]] = True
    return start, kind


class PieceEncoder:
    """Texts to little-endian unsigned 16- or 32-bit ids; one per worker and file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.wide = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        self.forget()

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in _made:
            _made[path] = cls(path)
        return _made[path]

    def forget(self) -> None:
        """Starts with no known pieces: number of a piece, and where its ids stand in the pool."""
        self.known: dict[bytes, int] = {}
        self.at, self.size, self.pool, self.filled = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.wide), 0

    def library_ids(self, runs: list[bytes], others: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, how many each has); ``runs`` are letters, with a blank before them or not.

        Runs go in texts of ``TOGETHER`` with a line feed after each: the splitter ends
        a run of letters there and gives the line feed a token of its own.
        """
        found = []
        if runs and len(self.line) == 1:
            texts = [(b"\n".join(runs[i : i + TOGETHER]) + b"\n").decode() for i in range(0, len(runs), TOGETHER)]
            ids, _ = self.whole_ids(texts)
            ends = np.flatnonzero(ids == self.line[0])
            if len(ends) == len(runs):
                found.append((np.delete(ids, ends), np.diff(ends, prepend=-1) - 1))
        found.append(self.whole_ids([p.decode() for p in (others if found else runs + others)]))
        ids, size = zip(*found, strict=True)
        return np.concatenate(ids), np.concatenate(size)

    def whole_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has) by the library."""
        each = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), self.wide, int(size.sum())), size

    def learn(self, pieces: list[bytes], letters: np.ndarray) -> np.ndarray:
        """Numbers of pieces that weren't known; ``letters`` marks those that are runs of letters."""
        order = np.argsort(~letters, kind="stable")
        pieces, many = [pieces[i] for i in order.tolist()], int(letters.sum())
        ids, size = self.library_ids(pieces[:many], pieces[many:])
        n = len(self.known)
        while n + len(size) > len(self.at):
            self.at, self.size = np.append(self.at, np.zeros_like(self.at)), np.append(self.size, np.zeros_like(self.size))
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.at[n : n + len(size)] = self.filled + np.cumsum(size) - size
        self.size[n : n + len(size)] = size
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        self.known.update(zip(pieces, range(n, n + len(size)), strict=True))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(n, n + len(size))
        return number

    def regular(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts that hold known characters only, none of them empty."""
        whole = b"".join(texts)
        raw = np.frombuffer(whole, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        firsts = np.cumsum(sizes) - sizes
        mask, kind = piece_starts(raw, firsts)
        start = np.flatnonzero(mask)
        end = np.append(start[1:], len(raw))
        first, group = distinct_spans(whole, start, end - start)
        pieces = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        number = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            at = first[fresh]
            letters = (kind[end[at] - 1] == LETTER) & (raw[start[at]] != 39)  # a mark and letters: a contraction
            number[fresh] = self.learn([pieces[i] for i in fresh.tolist()], letters)
        number = number[group]
        size = self.size[number]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[number] - ends + size, size) + np.arange(ends[-1])]
        cuts = np.append(0, ends)[np.append(np.searchsorted(start, firsts), len(start))]
        raw_ids, wide = ids.tobytes(), ids.itemsize
        return [raw_ids[a * wide : b * wide] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of ``wide``."""
        if len(self.known) > REMEMBERED:
            self.forget()
        out = [b""] * len(texts)
        raw = [utf8(t) for t in texts]
        plain, odd = [], []
        for i, x in enumerate(raw):
            if x:
                (plain if known_only(x) and not any(t in x for t in self.added) else odd).append(i)
        if plain:
            for i, ids in zip(plain, self.regular([raw[i] for i in plain]), strict=True):
                out[i] = ids
        for i, e in zip(odd, self.library.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.wide).tobytes()
        return out


#: Bytes that the numpy cut knows, to be struck out.
KNOWN_BYTES = bytes(int(b) for b in np.flatnonzero(CLASSES != UNKNOWN))


def known_only(x: bytes) -> bool:
    """Whether all characters are ASCII or letters of U+00C0 to U+017F (U+00D7 and U+00F7 are signs)."""
    return not x.translate(None, KNOWN_BYTES) and b"\xc3\x97" not in x and b"\xc3\xb7" not in x


def groups_by_size(batches, most_chars: int = 2_000_000):
    """(record batch, texts) in pieces of bounded text size; column 1 holds the texts.  Freed memory goes back at the end, as workers stay."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        lo = held = 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= most_chars:
                yield batch.slice(lo, i + 1 - lo), texts[lo : i + 1]
                lo, held = i + 1, 0
        if lo < len(texts):
            yield batch.slice(lo), texts[lo:]
    trim_memory()
