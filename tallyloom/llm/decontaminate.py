"""Operator 8: benchmark decontamination with an Aho-Corasick automaton.

Test questions and answers are normalised to single-blank word sequences; every
window of ``window`` words (the whole of a shorter item) becomes a pattern with a
blank at both ends.  One automaton holds them all, and each document's normalised
text goes through it once.  Ends of matches map back to word numbers, and those to
code-point spans of the original text.

Scale: the automaton is built where the texts are, from a broadcast of the items.
Its size is bounded by ``block_windows``: pairs of a window and an item are made by Spark,
and more of them are dealt by hash into blocks of about that size, whichever item or
window they belong to.  The documents pass one automaton after another (the result so far
is kept in the shared folder), so no window is dropped.

Defined results: null texts have no words; items without words, without id or null
match nothing; rows of one item id count as one item; repeated documents give
repeated rows; a very long text is a batch of its own; other columns, whatever their
names, are neither read nor returned; an empty table on either side gives no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_built: dict[str, object] = {}


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and all other non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split(b" ")


def windows_of(text: str, window: int) -> set[str]:
    words = [w.decode("utf-8", "surrogatepass") for w in words_of(text) if w]
    return {" " + " ".join(words[i : i + window]) + " " for i in range(max(1, len(words) - window + 1))} if words else set()


def automaton(pairs: list[tuple[str, str]]):
    """An automaton over (item id, window) pairs whose matches carry (words in the window, item ids)."""
    import ahocorasick

    owners: dict[str, set[str]] = {}
    for item, pattern in pairs:
        owners.setdefault(pattern, set()).add(item)
    out = ahocorasick.Automaton()
    for pattern, ids in owners.items():
        out.add_word(pattern, (pattern.count(" ") - 1, tuple(sorted(ids))))
    out.make_automaton()
    return out if owners else None


def hits(text: str, found) -> tuple[int, list[int], list[str], list[tuple[int, int]]]:
    """Number of words, numbers of hit words, items found, code-point spans of runs of hit words."""
    words = [w for w in words_of(text) if w]
    if found is None or not words:
        return len(words), [], [], []
    normal = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
    matches = list(found.iter(normal))
    if not matches:
        return len(words), [], [], []
    blanks = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
    ends = np.searchsorted(blanks, [end for end, _ in matches]).tolist()
    change, items = np.zeros(len(words) + 1, np.int64), set()
    for end, (_, (size, ids)) in zip(ends, matches):
        change[end - size] += 1
        change[end] -= 1
        items.update(ids)
    hit = np.flatnonzero(np.cumsum(change)[:-1] > 0)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_NORMAL), np.uint8)
    inside = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return len(words), hit.tolist(), sorted(items), [(int(point[edges[r[0], 0]]), int(point[edges[r[-1], 1]])) for r in runs]


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``item`` and ``gram``: the distinct windows of each item, many at a time at most."""
    items = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            for item, text in zip(*(c.to_pylist() for c in part.columns)):
                grams = list(windows_of(text, window))
                for start in range(0, len(grams), 10_000):
                    own = grams[start : start + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array(own, pa.string())], names=["item", "gram"])

    return items.mapInArrow(run, "item string, gram string").distinct()


def _pass(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Add the hits of some windows to the columns of ``rows``."""
    shared, kind, name = rows.sparkSession.sparkContext.broadcast(pairs), rows.schema[0].dataType.simpleString(), uuid.uuid4().hex
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:  # once a worker process
            _built.clear()
            _built[name] = automaton(shared.value)
        found = _built[name]
        for part in slices(batches, 1):
            out = []
            for text, old_hit, old_items, old_spans in zip(*(part.column(i).to_pylist() for i in (1, 3, 4, 5))):
                n, hit, ids, spans = hits(text or "", found)
                if old_hit and hit:
                    spans = sorted({*spans, *((s["start"], s["stop"]) for s in old_spans)})
                    hit, ids = sorted({*hit, *old_hit}), sorted({*ids, *old_items})
                elif old_hit:
                    hit, ids, spans = old_hit, old_items, [(s["start"], s["stop"]) for s in old_spans]
                out.append((n, hit, ids, [{"start": a, "stop": b} for a, b in spans]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.list_(pa.string())), pa.array([x[3] for x in out], spans_type)],
                names=["doc_id", "text", "n_words", "hit_words", "items", "spans"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, text string, n_words bigint, hit_words array<int>, items array<string>, spans array<struct<start:int,stop:int>>")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = 50_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text``, ``n_words``, ``hit_words``, ``items`` and ``spans`` of every document."""
    pairs = cut(item_windows(benchmark, window))
    blocks = max(1, -(-pairs.count() // block_windows))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumns(
        {"n_words": F.lit(0).cast("long"), "hit_words": F.array().cast("array<int>"), "items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<start:int,stop:int>>")}
    )
    for block in range(blocks):
        own = pairs if blocks == 1 else pairs.filter(F.pmod(F.xxhash64("gram", "item"), F.lit(blocks)) == block)
        rows = _pass(cut(rows) if block else rows, [tuple(r) for r in own.select("item", "gram").collect()])  # about block_windows
    return rows
