"""Operator 6: SimHash near-duplicates with pivot distance tables.

Fingerprints link at ``most`` (2) or fewer differing bits.  Exact copies collapse
first: all later steps see distinct fingerprints.  Four 16-bit blocks leave at
least two blocks equal in a linked pair, so each fingerprint has six 32-bit block
keys; pairs are compared inside equal keys only.  A table of Hamming distances to
``pivots`` fixed reference fingerprints comes along: since distances to a pivot
differ by no more than the pair's own distance, a pair with a larger coordinate
difference is discarded in the join; survivors are verified bit by bit.

Scale: a key shared by more than ``crowd`` fingerprints isn't compared pairwise.
Its members instead go, each, to the 65 values within one bit; two fingerprints
lie within two bits exactly if they meet at such a value, where at most 65 can
meet.  That is linear and loses no link.  Fewer than 4096 fingerprints can be
those of very many documents each; their components reach the rows by a broadcast.

Defined results: null and empty texts have fingerprint zero and link like others;
texts with fewer words than a shingle have one shingle, the whole sequence; ties
in a bit count as 0; repeated rows stay repeated; an empty table gives none; null
ids stay null and never name a component that has another id; a very long text is a
batch of its own; other columns, whatever their names, are neither read nor returned.

Two bits are far less than what a similarity of 0.8 leaves: of 64 bits some ten differ
then.  For such thresholds ``least`` adds exact candidates and verifies whole sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, named_by, slices
from .graph import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_digests(text: str, width: int) -> bytes:
    """XXH64 digests (big-endian, seed 42) of a text's shingles, one after another; none without words."""
    from xxhash import xxh64_digest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    normal = b" ".join(words)
    if len(words) <= width:
        return xxh64_digest(normal, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-width].tolist()]
    return b"".join([xxh64_digest(normal[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())])


def majority(digests: bytes) -> int:
    """The signed 64-bit number whose bits are set in over half of the digests."""
    n = len(digests) >> 3
    each = np.frombuffer(digests, np.uint8).reshape(n, 8)
    if n > 2048:
        set_bits = np.concatenate([np.bincount(each[:, i], minlength=256) @ _BITS for i in range(8)])
    else:
        set_bits = np.unpackbits(each, axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big", signed=True)


def fingerprint(text: str, width: int = 3) -> int:
    """The signed 64-bit fingerprint of a text; zero without words."""
    return majority(shingle_digests(text, width)) if text.strip(" \t\n\r\x0b\x0c") else 0


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (signed long) of every row."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t, width) for t in part.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


def pivot_values(pivots: int) -> list[int]:
    """Reference fingerprints by a fixed rule: a multiplicative sequence over 64 bits."""
    values = [(i * 0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1) for i in range(1, pivots + 1)]
    return [v - 2**64 if v >= 2**63 else v for v in values]


def links(distinct: DataFrame, most: int = 2, pivots: int = 24, crowd: int = 64) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints (column ``fp``) that connect exactly the pairs within ``most`` bits."""
    if most != 2:
        raise ValueError("the six block keys and the one-bit neighbours are exact for two differing bits")
    fp = F.col("fp")
    table = F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("tinyint") for p in pivot_values(pivots)])
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = F.array(*[F.struct(F.lit(n).alias("n"), F.shiftleft(block[i], 16).bitwiseOR(block[j]).alias("k")) for n, (i, j) in enumerate(combinations(range(4), 2))])
    keyed = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.n", "key.k")
    shared = keyed.groupBy("n", "k").agg(F.count("*").alias("size")).filter("size > 1")
    busy = cut(keyed.join(shared, ["n", "k"]))
    few = busy.filter(F.col("size") <= crowd).select("n", "k", "fp", table.alias("table"))
    a, b = few.alias("a"), few.alias("b")
    near = F.forall(F.zip_with("a.table", "b.table", lambda x, y: F.abs(x - y) <= most), lambda x: x)
    pairs = a.join(b, (F.col("a.n") == F.col("b.n")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp")) & near)
    verified = pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    crowded = busy.filter(F.col("size") > crowd).select("fp").distinct()
    nearby = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    meeting = crowded.select("fp", F.explode(nearby).alias("at")).groupBy("at").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)  # 65 at most
    return verified.unionByName(meeting.select("a", F.explode("all").alias("b")).filter("a <> b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 2, pivots: int = 24, crowd: int = 64, key: str = "doc_id", text: str = "text", least: float | None = None) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (smallest doc_id reachable over links) of every row.

    With ``least``, documents link if their sets of shingles have that Jaccard similarity or
    more, and ``set_id`` stands for ``fp``: see :mod:`shingle_sets`.
    """
    if least is not None:
        from . import shingle_sets

        return shingle_sets.near_duplicates(docs, width, least, key=key, text=text)
    fps = cut(fingerprints(docs, width, key, text))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_rows")))
    roots = components(links(distinct.select("fp"), most, pivots, crowd), "a", "b")
    linked = roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    better = linked.join(least, "root").select("fp", "least")
    named = distinct.join(better, "fp", "left").select("fp", "n_rows", F.coalesce("least", "first").alias("component_id"))
    total = distinct.agg(F.sum("n_rows")).first()[0] or 0
    return named_by(fps, named, ["fp"], ["doc_id"], total).select("doc_id", "fp", "component_id")
