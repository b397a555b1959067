"""Operator 3: byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression.  Every code point gets a class from
a table; the class, with one or two code points of look-ahead, selects a
transition function of a small automaton.  Functions compose associatively, so
the state before every code point of a whole batch of texts follows from one
parallel prefix scan over function numbers with a composition table.  The slices
between token starts are numbered by Arrow, and each distinct one of a batch goes
once through a cache of merged pairs.  The code-point offset of each slice and the
number of ids that it gave stay with the result, so that ids decode back to spans
of the original text.

Defined results: a null text encodes as an empty one (no ids, empty bytes);
repeated rows give repeated results; a very long text is a batch of its own, and a
very long slice merges by a heap in nearly linear time; an empty table gives an
empty table; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, taken

# Symbols: what the automaton reads at a code point.
LETTER, NUMBER, OTHER, SHORT, LONG, JOINING, ALONE, INNER = range(8)
# States: what kind of token is open.  TAIL1 and TAIL2 are one or two letters before the end of a contraction.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHER, SPACE, IN_SPACES, TAIL1, TAIL2 = range(8)

#: Texts taken together in one pass of the class arrays; a longer text is a pass of its own.
SLICE_BYTES = 500_000

#: Letters and numbers that Unicode 16 added, for Pythons whose tables are older.
ADDED_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
ADDED_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Code points with the Unicode property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this code point."""
    if symbol == LETTER:
        if state in (TAIL1, TAIL2):
            return (CLOSED if state == TAIL1 else TAIL1), False
        return IN_LETTERS, state not in (IN_LETTERS, SPACE)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, SPACE)
    if symbol in (OTHER, SHORT, LONG):
        if symbol != OTHER and state not in (IN_OTHER, SPACE):
            return (TAIL1 if symbol == SHORT else TAIL2), True
        return IN_OTHER, state not in (IN_OTHER, SPACE)
    if symbol == JOINING:
        return SPACE, True
    if symbol == ALONE:
        return CLOSED, True
    return IN_SPACES, state != IN_SPACES


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function numbers of the symbols; of the symbols after a closed token (constant); the
    composition table; each function's value at CLOSED; starts by state and symbol."""
    of_symbol = [tuple(_step(s, x)[0] for s in range(8)) for x in range(8)]
    first = [(_step(CLOSED, x)[0],) * 8 for x in range(8)]
    number = {f: i for i, f in enumerate(dict.fromkeys(of_symbol + first))}
    todo = list(number)
    while todo:
        f = todo.pop()
        for g in list(number):
            for a, b in ((f, g), (g, f)):
                both = tuple(b[a[s]] for s in range(8))
                if both not in number:
                    number[both] = len(number)
                    todo.append(both)
    every = list(number)
    table = np.array([[number[tuple(b[a[s]] for s in range(8))] for b in every] for a in every], np.uint16)
    starts = np.array([[_step(s, x)[1] for x in range(8)] for s in range(8)])
    return np.array([number[f] for f in of_symbol], np.uint16), np.array([number[f] for f in first], np.uint16), table, np.array([f[CLOSED] for f in every], np.uint8), starts


@cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or INNER (white space) for each code point, from the general category."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            out[cp] = LETTER
        elif major == "N":
            out[cp] = NUMBER
    for kind, ranges in ((LETTER, ADDED_LETTERS), (NUMBER, ADDED_NUMBERS)):
        for low, high in ranges:
            out[low : high + 1] = kind
    out[WHITE] = INNER
    return out


def compose_scan(functions: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix compositions by halving: linear work, logarithmic depth."""
    n = len(functions)
    if n < 2:
        return functions
    width, flat = table.shape[0], table.ravel()
    pairs = flat[functions[0 : n - 1 : 2].astype(np.int32) * width + functions[1:n:2]]
    done = compose_scan(pairs, table)
    out = np.empty_like(functions)
    out[0] = functions[0]
    out[1::2] = done[: n // 2]
    out[2::2] = flat[done[: (n - 1) // 2].astype(np.int32) * width + functions[2::2]]
    return out


def token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where a token starts, in texts laid end to end; ``first``: where non-empty texts start."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    of_symbol, of_first, table, at_closed, starts = automaton()
    symbols = classes()[points]
    last = np.zeros(n, bool)
    last[first[1:] - 1] = True
    last[n - 1] = True
    one, two = np.zeros(n, points.dtype), np.zeros(n, points.dtype)
    one[:-1], two[:-2] = points[1:], points[2:]
    one[last] = 0
    ends = np.flatnonzero(last)
    two[ends] = 0
    two[ends[ends > 0] - 1] = 0
    quote = np.flatnonzero(points == 0x27)
    a, b = one[quote], two[quote]
    symbols[quote[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
    symbols[quote[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]] = LONG
    white = np.flatnonzero(symbols == INNER)
    before_text = white[~last[white]]
    before_text = before_text[symbols[before_text + 1] != INNER]
    symbols[before_text] = np.where(points[before_text] == 0x20, JOINING, ALONE)
    functions = of_symbol[symbols]
    functions[first] = of_first[symbols[first]]
    after = at_closed[compose_scan(functions, table)]
    before = np.empty(n, np.uint8)
    before[1:] = after[:-1]
    before[first] = CLOSED
    return np.flatnonzero(starts[before, symbols])


class Merger:
    """Merges the bytes of slices by rank, and remembers the ids of slices that it has seen.

    New slices of up to ``longest`` bytes merge side by side, one pair of each at a time.
    The cache is emptied when it holds ``capacity`` slices, so memory is bounded.
    """

    def __init__(self, ranks: dict[bytes, int], capacity: int = 1 << 16, longest: int = 48):
        self.ranks, self.capacity, self.longest, self.seen = ranks, capacity, longest, {}
        self.base, self.none = max(ranks.values(), default=0) + 1, np.iinfo(np.int32).max
        self.bytes = np.array([ranks.get(bytes([i]), 0) for i in range(256)], np.int32)
        pairs = {a * self.base + b: r for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}
        self.keys = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.keys.tolist()] + [self.none], np.int32)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that two neighbours merge to, which is also its rank."""
        wanted = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.joined[at], self.none)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each slice as little-endian 32-bit integers."""
        found = list(map(self.seen.get, pieces))
        if missing := [x for x, ids in zip(pieces, found) if ids is None]:
            new = {x: self.ranks[x].to_bytes(4, "little") for x in missing if x in self.ranks}
            rest = [x for x in missing if x not in new]
            for x in rest:
                if len(x) > self.longest:
                    new[x] = np.array(self.merged(x), "<u4").tobytes()
            for width in (8, 16, 32, self.longest):
                some = [x for x in rest if len(x) <= width and x not in new]
                new.update(zip(some, self.side_by_side(some, width)))
            found = [new[x] if ids is None else ids for x, ids in zip(pieces, found)]
            if len(self.seen) + len(new) > self.capacity:
                self.seen.clear()
            self.seen.update((x, ids) for x, ids in new.items() if len(x) <= self.longest)
        return found

    def side_by_side(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of slices of at most ``width`` bytes: in each the pair of lowest rank merges (leftmost first), until none has any."""
        out = [b""] * len(pieces)
        if not pieces:
            return out
        ids = self.bytes[np.frombuffer(b"".join([x.ljust(width, b"\0") for x in pieces]), np.uint8).reshape(-1, width)]
        n, at, columns = np.array([len(x) for x in pieces]), np.arange(len(pieces)), np.arange(width)
        ranks = np.full(ids.shape, self.none, np.int32)
        ranks[:, :-1] = np.where(columns[1:] < n[:, None], self.pair(ids[:, :-1], ids[:, 1:]), self.none)
        while len(at):
            place = ranks.argmin(1)
            rows = np.arange(len(at))
            best = ranks[rows, place]
            if (ended := best == self.none).any():
                for i, row, size in zip(at[ended].tolist(), ids[ended], n[ended].tolist()):
                    out[i] = row[:size].tobytes()
                going = ~ended
                ids, ranks, n, at, place, best, rows = ids[going], ranks[going], n[going] - 1, at[going], place[going], best[going], rows[: going.sum()]
            else:
                n = n - 1
            if not len(at):
                break
            after = np.minimum(columns + (columns > place[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, after, 1), np.take_along_axis(ranks, after, 1)
            ids[rows, place] = best
            follows = place + 1 < n
            ranks[rows, place] = np.where(follows, self.pair(best, ids[rows, np.minimum(place + 1, width - 1)]), self.none)
            ahead = np.flatnonzero(place)
            ranks[ahead, place[ahead] - 1] = self.pair(ids[ahead, place[ahead] - 1], best[ahead])
        return out

    def merged(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost among equal ranks; a heap keeps it near linear."""
        ranks, n = self.ranks, len(data)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@cache
def _merger(path: str) -> Merger:
    return Merger(load_ranks(path))


@cache
def _tokens(path: str) -> pa.Array:
    """The bytes of each id."""
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for data, rank in ranks.items():
        out[rank] = data
    return pa.array(out, pa.binary())


def _parts(data: pa.Buffer, edges: np.ndarray) -> pa.Array:
    """The bytes between ``edges``."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), data])


def decoded(ids: np.ndarray, edges: np.ndarray, tokens: pa.Array) -> pa.Array:
    """The bytes of the ids of each text; ``edges``: where texts start among the ids."""
    found = tokens.take(pa.array(ids))
    return _parts(found.buffers()[2] or pa.py_buffer(b""), np.frombuffer(found.buffers()[1], np.int32)[edges] if len(ids) else edges)


class Encoded(NamedTuple):
    """The ids of some texts."""

    ids: np.ndarray
    edges: np.ndarray  #: where each text starts among the ids, and the end
    starts: np.ndarray  #: code-point starts of the slices in their texts
    counts: np.ndarray  #: ids of each slice
    slices: np.ndarray  #: where each text starts among the slices, and the end


def encode_texts(texts: list[str], merger: Merger) -> Encoded:
    """Ids of the slices of the texts, each distinct slice merged once."""
    lengths = np.array([len(t) for t in texts], np.int64)
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    base = np.concatenate([[0], np.cumsum(lengths)])
    starts = token_starts(points, base[:-1][lengths > 0])
    data = whole.encode("utf-8", "surrogatepass")
    if len(data) == len(points):
        cuts = np.append(starts, len(data))
    else:
        sizes = (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000) + np.uint8(1)
        cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[np.append(starts, len(points))]
    numbered = _parts(pa.py_buffer(data), cuts).dictionary_encode()
    found = taken(merger(numbered.dictionary.to_pylist()), numbered.indices)
    ends = found.offsets.to_numpy().astype(np.int64) - found.offsets[0].as_py()
    edges = np.searchsorted(starts, base)
    return Encoded(found.flatten().to_numpy(), ends[edges], (starts - np.repeat(base[:-1], np.diff(edges))).astype("<i4"), np.diff(ends).astype("<i4"), edges)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (little-endian unsigned 32-bit integers), ``n_tokens``, ``slice_starts``
    (code-point offset of each pre-token, 32-bit) and ``slice_ids`` (how many ids each gave)."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(path)
        for part in slices(batches, 1, chars=SLICE_BYTES, rows=4096):
            x = encode_texts(part.column(1).to_pylist(), merger)
            columns = [_parts(pa.py_buffer(x.ids), 4 * x.edges), pa.array(np.diff(x.edges)), _parts(pa.py_buffer(x.starts), 4 * x.slices), _parts(pa.py_buffer(x.counts), 4 * x.slices)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[key, "ids", "n_tokens", "slice_starts", "slice_ids"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, ids binary, n_tokens bigint, slice_starts binary, slice_ids binary")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key`` and ``decoded``: the bytes of the ids, for the result of :func:`encode`.

    Other columns of ``encoded`` pass through.
    """
    rest = [c for c in encoded.columns if c not in (key, "ids")]
    rows = encoded.select(key, "ids", *rest)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for part in slices(batches, 1):
            ids = [x or b"" for x in part.column(1).to_pylist()]
            edges = np.concatenate([[0], np.cumsum([len(x) >> 2 for x in ids])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, decoded(np.frombuffer(b"".join(ids), "<i4"), edges, tokens)], names=[*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, decoded binary")


def span_of(slice_starts: bytes, slice_ids: bytes, token: int) -> tuple[int, int]:
    """The slice that token number ``token`` of a text comes from: its code-point start and its position."""
    starts, counts = np.frombuffer(slice_starts, "<i4"), np.frombuffer(slice_ids, "<i4")
    at = int(np.searchsorted(np.cumsum(counts), token, side="right"))
    return int(starts[at]), at


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids``, ``n_tokens`` and ``decoded``: encoded, and decoded from the ids, in one worker a task."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # of earlier tasks in this worker
        merger, tokens = _merger(path), _tokens(path)
        for part in slices(batches, 1, chars=SLICE_BYTES, rows=4096):
            x = encode_texts(part.column(1).to_pylist(), merger)
            yield pa.RecordBatch.from_arrays([part.column(0), _parts(pa.py_buffer(x.ids), 4 * x.edges), pa.array(np.diff(x.edges)), decoded(x.ids, x.edges, tokens)], names=[key, "ids", "n_tokens", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, ids binary, n_tokens bigint, decoded binary")
