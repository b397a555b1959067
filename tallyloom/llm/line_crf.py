"""Operator 2: quality rules with line sequence labelling.

A linear-chain conditional random field labels each line of a text content or
boilerplate by Viterbi decoding; a document is kept if content lines hold at least
``least_share`` of its code points in lines, and no base rule fails it.  Features of
a line are counts of character and word kinds, cut into bins.

Labels of lines are latent: a quality label says only which label most of a document's
lines have.  The field is fitted by rounds of two forward-backward sums over a bounded
sample of labelled documents: expectations under the chain, and under the chain that is
pulled, document by document, just so far that ``most`` of a document's lines can be
expected to have its label.  The weights move by the difference; both qualities count
alike.  So a line that looks like those of the other kind keeps its own label inside a
document, and the transitions between labels are learned.

The sample is ``sample`` documents, those with the smallest id hashes, with whole texts;
only line features reach the driver.  Everything else covers all rows and whole texts.

Defined results: a null or empty text has no words, fails the base rules and isn't
kept; repeated rows repeat (in the sample an id counts once, with the text of the
smallest hash and its lowest quality); ties between label sequences go to content; a
very long text is a batch of its own, and in training a chain of ``PIECE`` lines at a
time; other columns, whatever their names, are neither read nor returned; an empty table
gives an empty table; without labels the field has no weights, calls every line content
and leaves the base rules to decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\f"
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
#: Upper bounds of the bins of each measure.
BINS = (
    (0.5, 3.5, 7.5, 15.5, 40.5),  # words
    (0.002, 0.02, 0.06, 0.15),  # share of symbols
    (0.05, 0.15, 0.4),  # share of capitals
    (0.02, 0.1, 0.3),  # share of digits
    (0.02, 0.08, 0.2),  # share of other punctuation
    (0.35, 0.6, 0.8, 0.95),  # distinct words by words
    (2.5, 4.5, 7.5, 12.5),  # code points a word
)
WIDTH = sum(len(b) + 1 for b in BINS) + 3
#: Longer documents are several chains in training, so that its arrays have few steps; no line is left out.
PIECE = 256
CONTENT, BOILERPLATE = 0, 1


def line_features(lines: list[str]) -> np.ndarray:
    """Feature numbers of each line: one per measure, one for its ending, one for a repeat."""
    out = np.empty((len(lines), len(BINS) + 2), np.int64)
    measures, seen = np.empty((len(lines), len(BINS))), set()
    for i, line in enumerate(lines):
        data = line.encode("utf-8", "surrogatepass")
        words, size = data.split(), max(1, len(data))
        rest = data.translate(None, SYMBOLS)
        capitals, digits = len(data) - len(data.translate(None, _UPPER)), len(data) - len(data.translate(None, _DIGIT))
        marks = len(rest.translate(None, b"!\"'()+,-./:;=?@[\\]^_`{}~"))
        n = len(words)
        measures[i] = (n, (len(data) - len(rest)) / size, capitals / size, digits / size, (len(rest) - marks) / size, len(set(words)) / max(1, n), (len(line) - max(0, n - 1)) / max(1, n))
        out[i, -2] = WIDTH - 3 if data.rstrip().endswith((b".", b"?", b"!", b'"', b":")) else WIDTH - 2
        out[i, -1] = WIDTH - 1 if n and line in seen else -1
        seen.add(line)
    start = 0
    for k, bounds in enumerate(BINS):
        out[:, k] = start + np.searchsorted(bounds, measures[:, k])
        start += len(bounds) + 1
    return out


class LineField:
    """Weights of line features by label, of the first label and of label pairs."""

    def __init__(self, emission: np.ndarray | None = None, first: np.ndarray | None = None, pair: np.ndarray | None = None):
        self.emission = np.zeros((WIDTH + 1, 2)) if emission is None else emission  # the last row stands for no feature
        self.first = np.zeros(2) if first is None else first
        self.pair = np.zeros((2, 2)) if pair is None else pair

    def viterbi(self, lines: list[str]) -> np.ndarray:
        """The best label sequence; ties go to content."""
        if not lines:
            return np.zeros(0, np.int64)
        scores = self.emission[line_features(lines)].sum(1).tolist()
        (aa, ab), (ba, bb) = self.pair.tolist()
        a, b = self.first[0] + scores[0][0], self.first[1] + scores[0][1]
        back = []
        for x, y in scores[1:]:
            to_a, to_b = (0 if a + aa >= b + ba else 1), (0 if a + ab >= b + bb else 1)
            a, b = (b + ba if to_a else a + aa) + x, (b + bb if to_b else a + ab) + y
            back.append((to_a, to_b))
        label = 0 if a >= b else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return np.array(out[::-1])

    def sums(self, e: np.ndarray, chains: Chains, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of each line's labels, and expected label pairs and first labels (weighted), for line scores ``e``."""
        forward, backward = np.empty_like(e), np.zeros_like(e)
        at, k, pair = chains.at, chains.k, self.pair
        forward[: k[0]] = self.first + e[: k[0]]
        for t in range(1, len(k)):
            last = forward[at[t - 1] : at[t - 1] + k[t]]
            forward[at[t] : at[t] + k[t]] = np.logaddexp(last[:, :1] + pair[0], last[:, 1:] + pair[1]) + e[at[t] : at[t] + k[t]]
        for t in range(len(k) - 2, -1, -1):
            some = slice(at[t + 1], at[t + 1] + k[t + 1])
            ahead = e[some] + backward[some]
            backward[at[t] : at[t] + k[t + 1]] = np.logaddexp(pair[:, 0] + ahead[:, :1], pair[:, 1] + ahead[:, 1:])
        z = np.logaddexp(forward[chains.last, 0], forward[chains.last, 1])[chains.chain]
        unary = np.exp(forward + backward - z[:, None])
        later = np.arange(k[0], len(e))
        both = np.exp(forward[chains.before][:, :, None] + pair + (e + backward)[later][:, None, :] - z[later, None, None])
        return unary, (both * weight[later, None, None]).sum(0), (unary[: k[0]] * weight[: k[0], None]).sum(0)

    def fit(self, texts: list[np.ndarray], labels: list[int], rounds: int = 80, rate: float = 0.3, decay: float = 1e-3, most: float = 0.75, pace: float = 0.5) -> LineField:
        """Fit to the line features of documents and their labels, all chains side by side."""
        texts, labels = (list(x) for x in zip(*[(x[i : i + PIECE], y) for x, y in zip(texts, labels) for i in range(0, len(x), PIECE)])) if texts else ([], [])
        if not texts:
            return self
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        chains = Chains([len(texts[i]) for i in order])
        features = chains.laid([texts[i] for i in order]).astype(np.int64)
        features[features < 0] = WIDTH
        labels = np.array([labels[i] for i in order])
        own, lengths = np.arange(len(features)), np.bincount(chains.chain)
        label = labels[chains.chain]
        size = np.bincount(label, minlength=2)
        alike = (len(features) / 2 / np.maximum(size, 1))[label]  # the weight of a line of each quality
        pull, places, step = np.full(len(labels), 2.0), features.ravel(), 0
        for turn in range(rounds):
            e = self.emission[features].sum(1)
            pulled = e.copy()
            pulled[own, label] += pull[chains.chain]
            wanted, wanted_pairs, wanted_first = self.sums(pulled, chains, alike)
            now, now_pairs, now_first = self.sums(e, chains, alike)
            share = np.bincount(chains.chain, wanted[own, label]) / lengths
            pull = np.clip(pull + pace * (most - share), 0, 4)
            missing = np.repeat((wanted - now) * alike[:, None], features.shape[1], axis=0)
            d_e = np.stack([np.bincount(places, missing[:, y], WIDTH + 1) for y in (0, 1)], axis=1)
            d_e[WIDTH] = 0
            gradient = np.concatenate([d_e.ravel(), wanted_first - now_first, (wanted_pairs - now_pairs).ravel()]) / len(e)
            weights = np.concatenate([self.emission.ravel(), self.first, self.pair.ravel()])
            if turn < rounds // 2:  # lines speak for themselves first, then in their order
                gradient[-6:] = 0
            step = 0.9 * step + gradient - decay * weights
            weights = weights + rate * step
            cut = self.emission.size
            self.emission, self.first, self.pair = weights[:cut].reshape(self.emission.shape), weights[cut : cut + 2], weights[cut + 2 :].reshape(2, 2)
        return self


class Chains:
    """The lines of chains of falling lengths, laid out step by step: all first lines, all second lines, and so on."""

    def __init__(self, lengths: list[int]):
        n = np.array(lengths)
        self.k = np.array([(n > t).sum() for t in range(n[0])])
        self.at = np.concatenate([[0], np.cumsum(self.k)[:-1]])
        self.chain = np.concatenate([np.arange(k) for k in self.k])
        self.last = self.at[n - 1] + np.arange(len(n))
        step = np.repeat(np.arange(len(self.k)), self.k)
        self.before = (self.at[step - 1] + self.chain)[self.k[0] :]

    def laid(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([[x[t] for x in rows[:k]] for t, k in enumerate(self.k)])


def train(docs: DataFrame, labels: DataFrame, sample: int = 1500, key: str = "doc_id", text: str = "text") -> LineField:
    """A field from at most ``sample`` labelled documents (a bound on training only)."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.length("text") > 0).join(F.broadcast(some), "id")
    rows = rows.groupBy("id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "quality", "text")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            found = [line_features(x.split("\n")).astype(np.int8).tobytes() for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["id", "quality", "features"])

    got = rows.mapInArrow(run, f"{kind}, features binary").orderBy(F.xxhash64("id"), "id").collect()
    return LineField().fit([np.frombuffer(r["features"], np.int8).reshape(-1, len(BINS) + 2) for r in got], [CONTENT if r["quality"] else BOILERPLATE for r in got])


def repeated_words(words: list[list[bytes]], window: int = 8) -> list[int]:
    """For each text, how many words lie in windows that stand in it twice or more."""
    sizes = np.array([len(w) for w in words], np.int64)
    n = int(sizes.sum())
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for some in words for w in some), np.uint64, n)
    if n < window:
        return [0] * len(words)
    spread = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    spread *= np.uint64(0xBF58476D1CE4E5B9)
    spread ^= spread >> np.uint64(32)
    hashed = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        hashed = hashed * np.uint64(0x100000001B3) + spread[k : n - window + 1 + k]
    text = np.repeat(np.arange(len(words)), sizes)
    hashed = hashed + text[: len(hashed)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    whole = np.flatnonzero(text[: len(hashed)] == text[window - 1 :])
    order = whole[np.argsort(hashed[whole], kind="stable")]
    same = hashed[order][1:] == hashed[order][:-1]
    twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + window, -1)
    covered = np.cumsum(change)[:-1] > 0
    return np.bincount(text[covered], minlength=len(words)).tolist()


def measure(texts: list[str], field: LineField) -> list[tuple]:
    """Base counts and the share of content of each text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    words = [x.split() for x in data]
    out = []
    for text, x, w, repeats in zip(texts, data, words, repeated_words(words)):
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if line in seen and line.encode("utf-8", "surrogatepass").split():
                dup += 1
            seen.add(line)
        chars = len(text) - (len(x) - len(x.translate(None, BLANKS)))
        sizes = np.array([len(line) for line in lines])
        labels = field.viterbi(lines)
        share = float(sizes[labels == CONTENT].sum() / max(1, sizes.sum()))
        out.append((len(w), chars, len(x) - len(x.translate(None, SYMBOLS)), dup, repeats, share, labels.astype(np.int8).tobytes()))
    return out


def judge(docs: DataFrame, field: LineField, least_share: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, ``content_share``, ``line_labels`` (one byte a line), ``base_failed`` and ``kept`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            columns = list(zip(*measure(part.column(1).to_pylist(), shared.value)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.float64()), pa.array(columns[6], pa.binary())], names=["doc_id", *counts, "content_share", "line_labels"])

    found = rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in counts)}, content_share double, line_labels binary")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= least_share))
