"""Op 8: byte-level BPE encoding and decoding.

Method: vectorised pre-tokenisation. Code points become small classes; each class is a
transition function on the states of the pre-tokeniser, and those functions are composed with an
associative scan (blocks side by side, then block totals, then blocks again), so that the state
before every code point is known without a regular expression. Where the state and the class
meet says whether a slice starts there. Slices go through a cache of pair merging; what is not
cached is merged for all slices of the chunk together. Token offsets come with the ids.

Results for odd inputs: a null or empty text gives no ids (and decodes to no bytes); very long
texts are one chunk of their own; ids are equal for equal texts; further columns are not looked at.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import chunks, held, ragged

# Character classes. A letter may end a contraction after an apostrophe ('s) or open one of two letters ('re).
LETTER, SHORT, OPENS, NUMBER, OTHER, QUOTE, BLANK, SPACE, BREAK = range(9)
# States: what the text before a code point leaves open.
(FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, AFTER_SPACE, AFTER_QUOTE, IN_SUFFIX, CLOSED) = range(9)
#: Code points with the White_Space property (fixed values of the Unicode standard).
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions that the pattern keeps as slices (fixed values).
SHORT_SUFFIXES = "stmd"
LONG_SUFFIXES = ("re", "ve", "ll")
#: Longer slices are merged with a heap, one by one.
LONG_SLICE = 48
#: Slices that a worker keeps before it starts its cache anew.
CACHE_SLICES = 200_000
#: Text bytes encoded at once: the working arrays take about sixty times as much.
ENCODE_BYTES = 1 << 19


def _after(state: int, kind: int) -> int:
    """The state after a code point of this class."""
    if kind in (LETTER, SHORT, OPENS):
        if state == AFTER_QUOTE and kind == SHORT:
            return CLOSED
        if state == AFTER_QUOTE and kind == OPENS:
            return IN_SUFFIX
        return CLOSED if state == IN_SUFFIX else IN_LETTERS
    if kind == QUOTE:
        return IN_OTHERS if state in (IN_OTHERS, AFTER_BLANK, AFTER_QUOTE) else AFTER_QUOTE
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE, BREAK: FRESH}[kind]


def _opens(state: int, kind: int) -> int:
    """1 if a slice starts at a code point of this class, 2 if that depends on the next code point."""
    if kind in (LETTER, SHORT, OPENS):
        if state == AFTER_QUOTE:
            return int(kind == LETTER)
        return int(state not in (AFTER_BLANK, IN_LETTERS, IN_SUFFIX))
    if kind == NUMBER:
        return int(state not in (AFTER_BLANK, IN_NUMBERS))
    if kind in (OTHER, QUOTE):
        return int(state not in (AFTER_BLANK, IN_OTHERS, AFTER_QUOTE))
    if kind in (BLANK, SPACE):
        return 2 if state in (AFTER_BLANK, AFTER_SPACE) else 1
    return 0


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """All compositions of the class functions: (element of each class, composition table, elements as functions, identity)."""
    identity = tuple(range(9))
    single = [tuple(_after(s, k) for s in range(9)) for k in range(9)]
    known = {identity: 0}
    todo = [identity]
    while todo:
        f = todo.pop()
        for g in single:
            h = tuple(g[f[s]] for s in range(9))
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    elements = np.array(list(known), dtype=np.uint8)
    n = len(elements)
    table = np.empty((n, n), dtype=np.uint16)
    for i in range(n):
        for j in range(n):
            table[i, j] = known[tuple(elements[j][elements[i]])]
    return np.array([known[g] for g in single], dtype=np.uint16), table, elements, 0


CLASS_ELEMENT, COMPOSE, APPLY, IDENTITY = _monoid()
OPEN_RULE = np.array([[_opens(s, k) for k in range(9)] for s in range(9)], dtype=np.uint8)
BLOCK = 64


def states_before(kinds: np.ndarray) -> np.ndarray:
    """State before every code point, by composing transition functions."""
    n = len(kinds)
    rows = -(-n // BLOCK) or 1
    grid = np.full(rows * BLOCK, IDENTITY, dtype=np.uint16)
    grid[:n] = CLASS_ELEMENT[kinds]
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat, width = COMPOSE.ravel(), COMPOSE.shape[1]
    for j in range(1, BLOCK):
        grid[j] = flat[grid[j - 1].astype(np.int32) * width + grid[j]]
    enter = np.zeros(rows, dtype=np.uint8)
    totals = grid[-1]
    if rows > 4 * BLOCK:  # block totals are transition functions again
        enter[1:] = _states_after(totals)[:-1]
    else:
        state = FRESH
        for i, f in enumerate(totals[:-1].tolist()):
            state = APPLY[f, state]
            enter[i + 1] = state
    after = APPLY.ravel()[grid.astype(np.int32) * 9 + enter]
    out = np.empty(rows * BLOCK + 1, dtype=np.uint8)
    out[0] = FRESH
    out[1:] = after.T.ravel()
    return out[:n]


def _states_after(elements: np.ndarray) -> np.ndarray:
    """State after each of a run of transition functions, from FRESH."""
    n = len(elements)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, IDENTITY, dtype=np.uint16)
    grid[:n] = elements
    grid = grid.reshape(rows, BLOCK).T.copy()
    for j in range(1, BLOCK):
        grid[j] = COMPOSE[grid[j - 1], grid[j]]
    enter, state = np.zeros(rows, dtype=np.uint8), FRESH
    for i, f in enumerate(grid[-1, :-1].tolist()):
        state = APPLY[f, state]
        enter[i + 1] = state
    return APPLY[grid, enter].T.ravel()[:n]


_classes: list[np.ndarray] = []


def code_point_classes() -> np.ndarray:
    """The class of every code point, without the two that depend on what follows."""
    if not _classes:
        table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
        major = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)], dtype=np.uint8)
        table[major == ord("L")] = LETTER
        table[major == ord("N")] = NUMBER
        table[WHITE_SPACE] = SPACE
        table[0x20] = BLANK
        table[ord("'")] = QUOTE
        table[[ord(c) for c in SHORT_SUFFIXES]] = SHORT
        _classes.append(table)
    return _classes[0]


def slice_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which slices start, for texts laid end to end; each text starts anew."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at_byte = np.flatnonzero((data & 0xC0) != 0x80)
    kinds = code_point_classes()[points]
    for a, b in LONG_SUFFIXES:
        two = np.flatnonzero((points[:-1] == ord(a)) & (points[1:] == ord(b)))
        kinds[two] = OPENS
    # a BREAK between texts: the first code points of texts see a fresh state
    firsts = np.unique(np.searchsorted(at_byte, offsets[:-1]))
    firsts = firsts[firsts < len(points)]
    lasts = np.append(firsts[1:], len(points)) - 1
    wide = np.insert(kinds, firsts, BREAK)
    states = np.delete(states_before(wide), firsts + np.arange(len(firsts)))
    crossing = kinds[lasts] == OPENS  # its second letter stands in the next text
    kinds[lasts[crossing]] = LETTER
    rule = OPEN_RULE[states, kinds]
    white = (kinds == BLANK) | (kinds == SPACE)
    solid_next = np.append(~white[1:], False)
    solid_next[lasts] = False
    return at_byte[(rule == 1) | ((rule == 2) & solid_next)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Tokens:
    """The bytes of every id, laid end to end: what decoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes laid end to end, first byte of each text + total)."""
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[ragged(self.begins[ids], lengths)], ends[cuts]


class Ranks(Tokens):
    """A rank file: token bytes, pair ranks and pair merging."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        super().__init__(ranks)
        size = len(self.lengths)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.shift = size.bit_length()
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << self.shift | right] = rank
        self.bits = max(10, (4 * len(pairs)).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << self.bits, self.NONE, dtype=np.int64)
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        values = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        slot = self._slots(keys)
        while len(keys):  # linear probing, all keys at once
            free = self.slot_key[slot] < 0
            first = np.zeros(len(keys), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.slot_key[slot[put]], self.slot_rank[slot[put]] = keys[put], values[put]
            keys, values = keys[~put], values[~put]
            slot = (slot[~put] + 1) & ((1 << self.bits) - 1)

    NONE = 1 << 40

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE for those that don't merge."""
        wanted = (left << self.shift) | right
        slot = self._slots(wanted)
        seen = self.slot_key[slot]
        out = np.where(seen == wanted, self.slot_rank[slot], self.NONE)
        open_ = np.flatnonzero((seen != wanted) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.slot_key[slot[open_]]
            hit = seen == wanted[open_]
            out[open_[hit]] = self.slot_rank[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def _rank(self, key: int) -> int | None:
        """Rank of one pair, None if it doesn't merge."""
        at = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits)
        while (seen := int(self.slot_key[at])) >= 0:
            if seen == key:
                return int(self.slot_rank[at])
            at = (at + 1) & ((1 << self.bits) - 1)
        return None

    def merge_all(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids laid end to end, ids of each slice): in each round, the leftmost pair of the lowest rank of every slice that has one."""
        sizes = np.fromiter(map(len, slices), dtype=np.int64, count=len(slices))
        kept_ids: list[np.ndarray] = []
        kept_owner: list[np.ndarray] = []
        for i in np.flatnonzero(sizes > LONG_SLICE).tolist():
            kept_ids.append(self.merge_long(slices[i]))
            kept_owner.append(np.full(len(kept_ids[-1]), i, dtype=np.int64))
        short = np.flatnonzero(sizes <= LONG_SLICE)
        ids = self.byte_ids[np.frombuffer(b"".join([slices[i] for i in short.tolist()]), dtype=np.uint8)]
        owner = np.repeat(short, sizes[short])
        rank = np.full(len(ids), self.NONE, dtype=np.int64)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.pair_ranks(ids[inner], ids[inner + 1])
        while len(ids):
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            counts = np.diff(np.append(begins, len(ids)))
            place = np.arange(len(ids)) - np.repeat(begins, counts)
            best = np.minimum.reduceat((rank << 8) | place, begins)
            has = (best >> 8) < self.NONE
            gone = np.repeat(~has, counts)
            kept_ids.append(ids[gone])
            kept_owner.append(owner[gone])
            at = begins[has] + (best[has] & 0xFF)
            ids[at] = best[has] >> 8
            gone[at + 1] = True
            stay = ~gone
            at = (np.cumsum(stay) - 1)[at]
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            last = len(ids) - 1
            inner = at[(at < last)]
            inner = inner[owner[inner] == owner[inner + 1]]
            rank[at] = self.NONE
            before = at[at > 0] - 1
            before = before[owner[before] == owner[before + 1]]
            touched = np.concatenate([inner, before])
            rank[touched] = self.pair_ranks(ids[touched], ids[touched + 1])
        flat, owners = np.concatenate(kept_ids), np.concatenate(kept_owner)
        order = np.argsort(owners, kind="stable")
        return flat[order], np.bincount(owners, minlength=len(slices))

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Pair merging with a heap: n log n for a slice of n bytes."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, shift = self._rank, self.shift
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << shift | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(rank << shift | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := get(ids[h] << shift | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], dtype=np.int64)


class Encoder:
    """Cached pair merging over the slices of whole chunks."""

    def __init__(self, path: str):
        self.ranks = Ranks(path)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.begins = np.zeros(1 << 14, dtype=np.int64)
        self.lengths = np.zeros(1 << 14, dtype=np.int64)

    def _add(self, slices: list[bytes]) -> None:
        merged, sizes = self.ranks.merge_all(slices)
        n, at, total = len(self.index), self.used, len(merged)
        while at + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(slices) > len(self.begins):
            self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[at : at + total] = merged
        self.begins[n : n + len(slices)] = at + np.cumsum(sizes) - sizes
        self.lengths[n : n + len(slices)] = sizes
        self.used += total
        self.index.update(zip(slices, range(n, n + len(slices)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text + total) of texts laid end to end."""
        starts = slice_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.index) > CACHE_SLICES:
            self._clear()
        raw = data.tobytes()
        cuts = starts.tolist()
        pieces = [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
        get = self.index.get
        found = [get(p, -1) for p in pieces]
        new = list(dict.fromkeys(p for p, i in zip(pieces, found, strict=True) if i < 0))
        if new:
            self._add(new)
            get = self.index.get
            found = [get(p, -1) for p in pieces]
        at = np.array(found, dtype=np.int64)
        lengths = self.lengths[at]
        ids = self.flat[ragged(self.begins[at], lengths)]
        before = np.concatenate([[0], np.cumsum(lengths)])
        return ids, before[np.searchsorted(starts, offsets)]


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    own = held("bpe")
    if ("encoder", path) not in own:
        own.clear()
        own["encoder", path] = Encoder(path)
    return own["encoder", path]


def tokens_of(path: str) -> Tokens:
    """Token bytes: an encoder's, if the worker has one."""
    own = held("bpe")
    if ("encoder", path) in own:
        return own["encoder", path].ranks
    if ("tokens", path) not in own:
        own["tokens", path] = Tokens(read_ranks(path))
    return own["tokens", path]


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column over ``values``, cut at the given items."""
    at = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True, decoded: bool = False) -> DataFrame:
    """(id, ids, offsets): ids and the byte offsets at which tokens start, both little-endian unsigned 32-bit.

    With ``decoded``, the bytes that the ids decode to come from the same worker, in a last column.
    """
    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = source.schema[id_col].dataType.simpleString()
    names = [id_col, "ids", *["offsets"] * offsets, *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for first, end, data, at in chunks(batch.column(1), ENCODE_BYTES):
                ids, cuts = enc.encode(data, at)
                columns = [batch.column(0).slice(first, end - first), _binary(ids.astype("<u4"), cuts)]
                if offsets:
                    lengths = enc.ranks.lengths[ids]
                    begins = np.cumsum(lengths) - lengths
                    begins = begins - np.repeat(at[:-1], np.diff(cuts))
                    columns.append(_binary(begins.astype("<u4"), cuts))
                if decoded:
                    columns.append(_binary(*enc.ranks.decode(ids.astype(np.int64), cuts)))
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, f"`{id_col}` {kind}" + "".join(f", {n} binary" for n in names[1:]))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``: the bytes of their ids."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields) + ", decoded binary"
    where = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                raw = [x or b"" for x in part.column(where).to_pylist()]
                cuts = np.concatenate([[0], np.cumsum(np.array([len(x) for x in raw], dtype=np.int64) // 4)])
                text, at = tokens.decode(np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int64), cuts)
                yield pa.RecordBatch.from_arrays([*part.columns, _binary(text, at)], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
