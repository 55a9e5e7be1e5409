"""Batch encoding over distinct pieces.

A tokenizer never joins across certain places of a text (its safe
boundaries), so a text's ids are the ids of its pieces, one after the other.
A batch of texts is cut at safe boundaries, its distinct pieces are encoded
in one library call, and the ids of every text are gathered by index.
Distinct pieces are kept per worker process up to a fixed size.

Texts in which the cheap cut could be unsafe are named by an expression and
go to the library whole (long ones in parts, again cut at safe boundaries).
"""

from __future__ import annotations

import ctypes
import functools
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEP = "\x01"
SLICE_BYTES = 4 << 20
KEEP_BYTES = 120 << 20
#: Pieces that go to a library at once (it makes about 1 kB of each).
ENCODE_PIECES = 4000


def utf8_lengths(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def byte_slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes each."""
    which = np.concatenate([[0], np.cumsum(lengths)[:-1]]) // limit if len(lengths) else lengths
    cuts = np.flatnonzero(np.diff(which)) + 1
    bounds = [0, *cuts.tolist(), len(lengths)]
    yield from zip(bounds[:-1], bounds[1:])


def safe_parts(text: str, limit: int, boundary: re.Pattern) -> list[str]:
    """``text`` in parts of about ``limit`` characters, cut where ``boundary`` matches empty."""
    parts, at = [], 0
    while len(text) - at > limit:
        found = boundary.search(text, at + limit)
        if not found or found.start() >= len(text):
            break
        parts.append(text[at:found.start()])
        at = found.start()
    return [*parts, text[at:]]


class Pieces:
    """Distinct pieces of one batch: ``words[codes[offsets[i]:offsets[i+1]]]`` is row i."""

    def __init__(self, lists: pa.ListArray):
        coded = lists.flatten().dictionary_encode()
        self.offsets = lists.offsets.to_numpy().astype(np.int64)
        self.offsets -= self.offsets[0]
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.words = coded.dictionary.to_pylist()


class Known:
    """Values of pieces seen by this worker process.

    All tables of a process share one bound: workers are reused by later
    stages, and what one operator kept goes when another needs the room."""

    tables: list[Known] = []
    #: Calls that drop what operators keep besides (tokenizers), and say whether there was something.
    holders: list[Callable[[], bool]] = []

    def __init__(self, encode: Callable[[list[str]], list], entry_bytes: int, limit: int = KEEP_BYTES):
        self.encode, self.entry_bytes, self.limit, self.table = encode, entry_bytes, limit, {}
        Known.tables.append(self)

    @classmethod
    def release(cls, but: Known | None = None) -> bool:
        """What operators kept in this process goes (not that of ``but``).  Whether there was something."""
        some = False
        for one in cls.tables:
            if one is not but:
                some |= bool(one.table)
                one.table.clear()
        return any([drop() for drop in cls.holders if but is None]) or some

    def __call__(self, words: list[str]) -> list:
        table = self.table
        new = [w for w in words if w not in table]
        more = len(new) * self.entry_bytes
        if more + sum(len(t.table) * t.entry_bytes for t in Known.tables) > self.limit:
            for other in Known.tables:
                if other is not self:
                    other.table.clear()
        if more + len(table) * self.entry_bytes > self.limit:
            table.clear()
            new = words
        for i in range(0, len(new), ENCODE_PIECES):
            part = new[i:i + ENCODE_PIECES]
            table.update(zip(part, self.encode(part)))
        return [table[w] for w in words]


def give_back() -> None:
    """Returns freed memory to the system: idle workers hold none while other stages run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def without_pieces(task: Callable) -> Callable:
    """A task that keeps no pieces: those of other operators go before it, freed memory goes back after it."""
    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if Known.release():
            give_back()
        yield from task(batches)
        give_back()
    return run


def gather(pieces: Pieces, packed: list[bytes], width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in one array, and the rows' offsets in it.  ``packed``: little-endian ids per word."""
    dtype = np.dtype(f"<u{width}")
    flat = np.frombuffer(b"".join(packed), dtype)
    lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // width
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    n = lengths[pieces.codes]
    ends = np.cumsum(n)
    where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[pieces.codes] - (ends - n), n)
    ends = np.concatenate([[0], ends])
    return flat[where], ends[pieces.offsets]


def ragged_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


#: The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: b for b in _PRINTABLE} | {
    b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}


def byte_level(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(BYTE_CHARS)


def plain_letters(word: str) -> bool:
    """Only letters below U+0250, each of them a single code point."""
    return word.isalpha() and (word.isascii() or max(word) < "ɐ")
