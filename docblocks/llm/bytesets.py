"""Vectorised text primitives shared by the operators that run in Arrow workers.

Texts arrive as Arrow string columns. Everything here works on the UTF-8 bytes of many
texts laid end to end, so that one NumPy call handles a whole chunk of documents:

* ``chunks``       cuts a record batch into runs of rows of bounded bytes;
* ``Words``        words ``[^\\x20\\x09-\\x0D]+`` with their document and a 64-bit hash;
* ``span_hashes``  content hashes of arbitrary byte spans, equal wherever the bytes are equal.

Hashes use fixed seeds, so every executor and every retry computes the same values.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes handled by one vectorised call; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19

_held: dict[str, dict] = {}


def held(group: str) -> dict:
    """What a worker keeps for one group of tables and caches; another group's are let go, as workers serve many stages."""
    for other in [g for g in _held if g != group]:
        del _held[other]
    return _held.setdefault(group, {})


_rng = np.random.Generator(np.random.PCG64(20240607))


def _family() -> tuple[np.ndarray, int, int]:
    """A random odd value for each byte, one for the base of a polynomial and its inverse mod 2**64."""
    values = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
    base = int(_rng.integers(1, 2**61)) * 8 + 5
    return values, base, pow(base, -1, 2**64)


#: Two independent hash families: where equal hashes stand for equal bytes and decide, both are compared.
FAMILIES = (_family(), _family())

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def power_table(base: int, n: int) -> np.ndarray:
    """``base ** i`` mod 2**64 for i < n, kept and grown by doubling."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = 1 << max(10, (n - 1).bit_length())
        got = np.ones(size, dtype=U64)
        filled = 1
        while filled < size:
            step = U64(pow(base, filled, 2**64))
            got[filled : 2 * filled] = got[:filled] * step
            filled *= 2
        _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_sums(data: np.ndarray, family: int = 0) -> np.ndarray:
    """Running polynomial sums of the bytes; entry i covers data[:i]."""
    values, base, _ = FAMILIES[family]
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(values[data] * power_table(base, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    raw = (sums[ends] - sums[starts]) * power_table(FAMILIES[family][2], len(sums))[starts]
    return mix(raw + U64(0x9E3779B97F4A7C15) * (ends - starts).astype(U64))


def give_back() -> None:
    """Hand freed memory back to the system: workers are kept for later tasks and share the executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    column = column.fill_null("") if column.null_count else column
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes."""
    data, at = string_bytes(column)
    first, n = 0, len(at) - 1
    while first < n:
        end = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end
    give_back()


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per byte or word) over each row's range."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Words:
    """Words of a chunk: ``starts``/``ends`` byte positions, ``row`` of each, ``first`` word of each row (len rows + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        solid = ~IS_SPACE[data]
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        opens[cuts] = solid[cuts]
        closes = np.zeros(len(data) + 1, dtype=bool)
        closes[1:-1] = solid[:-1] & ~solid[1:]
        if len(data):
            closes[-1] = solid[-1]
            inner = cuts[cuts > 0]
            closes[inner] |= solid[inner - 1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes)
        self.first = np.searchsorted(self.starts, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._sums: np.ndarray | None = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            self._sums = prefix_sums(self.data)
        return self._sums

    def hashes(self) -> np.ndarray:
        return span_hashes(self.sums, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)


_GRAM = mix(np.arange(1, 65, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes (rows are not looked at)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = words[:n] * _GRAM[0]
    for i in range(1, k):
        out += words[i : i + n] * _GRAM[i]
    return mix(out)


def repeats(keys: np.ndarray) -> np.ndarray:
    """True for each key that occurs twice or more."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys), dtype=bool)
    equal = ranked[1:] == ranked[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    out = np.empty(len(keys), dtype=bool)
    out[order] = same
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, laid end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (ends - lengths), lengths)
    return out
