"""Operator 7: language identification by multilingual mixture inference.

Training counts hashed letter trigrams per language over all labelled rows (partial
counts per task, summed by key).  A document is modelled as a mixture of languages:
expectation-maximisation over its trigram counts gives the proportions.  The set of
languages is the smallest whose log-likelihood, less a penalty per language, is
best; the answer is the set's language with the largest share.

The model has ``buckets`` x languages numbers, whatever the corpus size; that is
what reaches the driver and is broadcast.

Defined results: a null text, one without a letter, and any text when there is no
labelled row get ``und`` with score 0; equal shares go to the first language by
name; repeated rows give repeated rows; an empty table gives an empty table; a very long
text is a batch of its own, read whole; other columns, whatever their names, are neither
read nor returned.

Sets are tried nested, by falling share in the mixture of all languages; tests hold the
choice against all sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import LETTER, classes
from .common import slices

UNKNOWN = "und"


def trigrams(text: str, buckets: int) -> np.ndarray:
    """Hashed trigrams around each letter, other characters read as one kind of blank."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = classes()[points] == LETTER
    x = np.where(letter, points, 0).astype(np.uint32)
    mixed = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16))[letter[1:-1]].astype(np.uint16) & np.uint16(buckets - 1)


def counts(labelled: DataFrame, buckets: int = 1 << 15) -> DataFrame:
    """``lang``, ``bucket``, ``n`` over all rows of ``labelled`` (columns ``lang``, ``text``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for part in slices(batches, 1):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if lang not in seen:
                    seen[lang] = np.zeros(buckets, np.int64)
                seen[lang] += np.bincount(trigrams(text, buckets), minlength=buckets)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities of trigram buckets by language."""

    def __init__(self, rows: Iterable[tuple[str, int, int]], buckets: int, smoothing: float = 0.5):
        rows = list(rows)
        self.langs, self.buckets = sorted({r[0] for r in rows}), buckets
        n = np.full((buckets, len(self.langs)), smoothing)
        place = {x: i for i, x in enumerate(self.langs)}
        for lang, bucket, count in rows:
            n[bucket, place[lang]] += count
        self.p = n / n.sum(0, keepdims=True) if rows else n

    def shares(self, text: str, penalty: float = 6.0, rounds: int = 30) -> dict[str, float]:
        """The chosen languages with their proportions; empty without letters or model."""
        grams = trigrams(text, self.buckets) if self.langs else np.zeros(0, np.uint16)
        if not len(grams):
            return {}
        grams = np.sort(grams)
        at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        n, p = np.diff(np.append(at, len(grams))).astype(float), self.p[grams[at]]
        single = n @ np.log(p)
        order = np.argsort(-single, kind="stable")
        best, chosen, shares = single[order[0]], order[:1], np.ones(1)
        if len(self.langs) > 1:
            full, full_shares = _mixture(n, p, rounds)
            order = np.argsort(-full_shares, kind="stable")
            for size in range(2, len(self.langs) + 1):
                if full - penalty * np.log(len(grams)) * (size - len(chosen)) <= best:
                    break  # not even the whole set is good enough
                value, some = _mixture(n, p[:, order[:size]], rounds)
                if value - penalty * np.log(len(grams)) * (size - len(chosen)) > best:
                    best, chosen, shares = value, order[:size], some
        return {self.langs[i]: float(s) for i, s in zip(chosen, shares)}


def _mixture(n: np.ndarray, p: np.ndarray, rounds: int) -> tuple[float, np.ndarray]:
    """Expectation-maximisation of mixing proportions: log-likelihood and proportions."""
    total, share = n.sum(), np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        mixed = p @ share
        new = share * ((n / mixed) @ p) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return float(n @ np.log(p @ share)), share


def fit(labelled: DataFrame, buckets: int = 1 << 15) -> Model:
    """The model from all labelled rows; ``buckets`` x languages counts reach the driver."""
    return Model((tuple(r) for r in counts(labelled, buckets).toLocalIterator()), buckets)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` (empty for null), ``lang_pred``, ``score`` (share of that language) and ``shares`` (map) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            found = [shared.value.shares(t) for t in part.column(1).to_pylist()]
            top = [min(x.items(), key=lambda kv: (-kv[1], kv[0])) if x else (UNKNOWN, 0.0) for x in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([t[0] for t in top], pa.string()), pa.array([min(1.0, t[1]) for t in top], pa.float64()), pa.array([list(x.items()) for x in found], pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "text", "lang_pred", "score", "shares"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, text string, lang_pred string, score double, shares map<string,double>")


def held_out(key: str = "doc_id"):
    """Whether a document is kept from training: checksum of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``lang`` and ``text`` of labelled rows that aren't held out."""
    return docs.filter(F.col(key).isNotNull() & ~held_out(key)).select("lang", "text")
