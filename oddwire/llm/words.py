"""Words of whole texts as 64-bit hashes, computed with numpy inside Spark tasks.

A word is a longest run of bytes other than ``[\\x20\\x09-\\x0D]``. Texts stay UTF-8 bytes: none of
the separators occurs inside a multi-byte character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.Generator(np.random.PCG64(20240517))


def _odd(count: int) -> np.ndarray:
    return _random.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = _odd(256)
_BASE = _odd(8)
_MIX = _odd(2)


#: Values hashed at a time; tables of powers are as long, whatever the texts are.
CHUNK = 1 << 16


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, one chunk of each."""

    def __init__(self, base: np.uint64):
        self.base = int(base)
        self.up, self.down = self._row(self.base), self._row(pow(self.base, -1, 2**64))

    @staticmethod
    def _row(base: int) -> np.ndarray:
        row = np.full(CHUNK + 1, base, dtype=np.uint64)
        row[0] = 1
        return np.multiply.accumulate(row)

    def sums(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, of=None) -> np.ndarray:
        """Polynomial hash of each slice of the values, or of what the table ``of`` makes of them.

        Starts and ends rise. Time is linear in the values and memory that of a chunk: a slice
        over several chunks is the sum of its parts, each times the power of its place.
        """
        if len(values) <= CHUNK:
            part = values if of is None else of[values]
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part * self.up[: len(part)], out=total[1:])
            return (total[ends] - total[starts]) * self.down[starts]
        found = np.zeros(len(starts), dtype=np.uint64)
        for begin in range(0, len(values), CHUNK):
            part = values[begin : begin + CHUNK]
            part = part if of is None else of[part]
            first = np.searchsorted(ends, begin, "right")
            last = np.searchsorted(starts, begin + len(part), "left")
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part * self.up[: len(part)], out=total[1:])
            low = np.maximum(starts[first:last] - begin, 0)
            high = np.minimum(ends[first:last] - begin, len(part))
            own = (total[high] - total[low]) * self.down[low]
            for k in range(np.searchsorted(starts[first:last], begin, "left")):
                power = pow(self.base, int(begin - starts[first + k]), 2**64)
                own[k] = int(own[k]) * power % 2**64
            found[first:last] += own
        return found


_OF_BYTES = Powers(_BASE[0])
_OF_WORDS = (Powers(_BASE[1]), Powers(_BASE[2]))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all of them."""
    values = values ^ (values >> np.uint64(32))
    values = values * _MIX[0]
    values = values ^ (values >> np.uint64(29))
    values = values * _MIX[1]
    return values ^ (values >> np.uint64(32))


def raw_texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text, without copies; a null counts as empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    ends = ends[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield bytes_[ends[k] : ends[k + 1]] if known[k] else bytes_[:0]


_NUMPY = {
    pa.int32(): np.int32,
    pa.int64(): np.int64,
    pa.float32(): np.float32,
    pa.float64(): np.float64,
}
_ARROW = {np.dtype(v): k for k, v in _NUMPY.items()}


def _bits(flags) -> pa.Buffer:
    return pa.py_buffer(np.packbits(np.asarray(flags, dtype=bool), bitorder="little").tobytes())


def arrow(values, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow array of numbers, flags, bytes, texts or lists of numbers, with None for nulls.

    Built from buffers: Arrow's own conversion loads pandas into every worker, 45 MB each.
    """
    if kind is None:
        kind = pa.bool_() if values.dtype == bool else _ARROW[values.dtype]
    size = len(values)
    valid = None
    if not isinstance(values, np.ndarray) and any(v is None for v in values):
        valid = _bits([v is not None for v in values])
    if kind == pa.bool_():
        return pa.Array.from_buffers(kind, size, [valid, _bits([bool(v) for v in values])])
    if kind in _NUMPY:
        plain = values if valid is None else [0 if v is None else v for v in values]
        data = np.ascontiguousarray(plain, dtype=_NUMPY[kind])
        return pa.Array.from_buffers(kind, size, [valid, pa.py_buffer(data)])
    if pa.types.is_list(kind):
        ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
        flat = arrow([x for v in values for x in v], kind.value_type)
        return pa.ListArray.from_arrays(arrow(ends), flat)
    plain = [v.encode() if isinstance(v, str) else v or b"" for v in values]
    ends = np.cumsum([0, *map(len, plain)], dtype=np.int32)
    buffers = [valid, pa.py_buffer(ends), pa.py_buffer(b"".join(plain))]
    return pa.Array.from_buffers(kind, size, buffers)


def give_back() -> None:
    """Return freed memory to the system: workers stay for later tasks, and share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


#: How to free what tasks of one operator keep in a worker for the next of their kind.
_kept: dict[str, Callable[[], None]] = {}


def keep(name: str, free: Callable[[], None]) -> None:
    """Note that a worker keeps something until a task calls ``let_go``."""
    _kept[name] = free


def let_go() -> None:
    """Free what earlier tasks of other operators keep in this worker."""
    if _kept:
        for free in _kept.values():
            free()
        _kept.clear()
        give_back()


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 2 << 20
) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``size`` bytes of a column, so that little is held at once."""
    let_go()
    for batch in batches:
        rows = max(1, len(batch) * size // max(batch.column(column).nbytes, size))
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)
        if not len(batch):
            yield batch
    give_back()


def spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    if len(text) <= CHUNK:
        space = np.ones(len(text) + 2, dtype=np.int8)
        space[1:-1] = _SPACE[text]
        change = np.flatnonzero(space[1:] != space[:-1])
        return change[::2], change[1::2]
    edges = [[], []]
    inside = False
    for begin in range(0, len(text), CHUNK):
        space = _SPACE[text[begin : begin + CHUNK]]
        change = np.flatnonzero(np.diff(space, prepend=not inside))
        edges[0].append(begin + change[int(inside) :: 2])
        edges[1].append(begin + change[1 - int(inside) :: 2])
        inside = not space[-1]
    if inside:
        edges[1].append(np.array([len(text)]))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *edges[0]]), np.concatenate([none, *edges[1]])


def hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash a word; equal words have equal hashes everywhere."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    return mix(_OF_BYTES.sums(text, starts, ends, _BYTES) + (ends - starts).astype(np.uint64))


def lower(text: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[text]


def runs(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of every ``size`` consecutive words; ``which`` picks one of two independent hashes."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    starts = np.arange(count)
    return mix(_OF_WORDS[which].sums(words, starts, starts + size) + np.uint64(size))


def shingle_set(text: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of a text in lower case; the whole sequence if it is shorter."""
    text = lower(text)
    words = hashes(text, *spans(text))
    return np.unique(runs(words, min(size, len(words)) or 1))
