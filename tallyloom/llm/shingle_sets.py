"""Near-duplicates by the Jaccard similarity of word-shingle sets: operator 6 where a
similarity is asked for, which no distance of 64-bit fingerprints can decide.

A text's set holds the 64-bit hashes of its windows of ``width`` words (lower-case A to
Z, split at ASCII white space).  Texts with equal sets collapse first.  SimHash links
(fingerprints of the same shingles, pivot tables) propose the closest pairs; keys
propose all others:

- A set of n members has an order: first those that the texts don't hold often, then
  the others, each by hash.  Two sets of similarity ``least`` or more share
  one of the first n - ceil(least * n) + 1 members.  These are the keys of sets where they
  are ``FEW`` or less.
- Larger sets have the first k = ceil(FEW / least) + 1 rare members by hash and, if at
  most half of them are rare, the first k frequent ones.  Of two such sets of similarity
  0.8 either at least half of all rare members are common, or two thirds of all frequent
  ones and both sets have frequent keys; so no key is shared with a chance of at most
  2^-k, 2^-41 with the defaults.  (Below a similarity of 0.75 all sets have all keys.)

Keys come with their places in the order.  At a pair's first common key nothing before it
is common, so the members from there on must be enough; pairs that share a passage and
little else fail that, and only pairs that pass leave the join.

How often is counted over all texts and decides on speed, never on results.  Candidates are verified on whole sets:
first one pair for each set, then what is not connected by those.

Scale: a key shared by more than ``crowd`` sets isn't joined pairwise.  Pairs that are
already connected need no comparison, so in each round up to ``leaders`` members of such
a key that its largest component lacks are compared with all of its members.  A key
ends when one component holds all its members or at most ``crowd`` members are outside
the largest; those are then compared with all.  After ``rounds`` rounds every member
still outside is, inside the join, so that pairs that don't link are never written: no
pair is given up, and such a key costs at most its square in comparisons, its members in
room.

Defined results: null and empty texts have one set and link with each other; texts with
fewer words than a shingle have one shingle, the whole sequence; repeated rows stay
repeated; an empty table gives none; null ids stay null and never name a component that
has another id; a very long text is a batch of its own; other columns are not read.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep, named_by, slices, tasks
from .graph import components
from . import simhash_pivots

#: Members that eight in so many texts hold are frequent, and how many frequent members the order knows.
OFTEN, FREQUENT = 20_000, 1 << 17
#: Members that are sorted at once, texts that are worth a task of counting, and texts that are counted at once.
CHUNK, TEXTS, MOST_TEXTS = 500_000, 20_000, 200_000
#: The part of its share of a task's texts from which on a task proposes a member.
PART = 0.75
#: Bits of the filter of sets that are wanted again: 64 a word.
WORDS = 1 << 19
_SLACK = 1e-9
#: Sets have all keys of the prefix rule where these are so many or less.
FEW = 32


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    return np.unique(np.frombuffer(simhash_pivots.shingle_digests(text, width), np.int64))


def _set_id(members: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(members.tobytes(), 7)
    return value - 2**64 if value >= 2**63 else value


def release(rows: DataFrame) -> None:
    """Let Spark delete shuffles and checkpoints that nothing refers to any more."""
    gc.collect()
    rows.sparkSession.sparkContext._jvm.System.gc()


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))


def _chunks(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """The members of some texts at a time, and of how many."""
    sets, n = [], 0
    for part in slices(batches, 0):
        for text in part.column(0).to_pylist():
            sets.append(shingle_set(text, width))
            n += len(sets[-1])
            if n >= CHUNK:
                yield len(sets), np.concatenate(sets)
                sets, n = [], 0
    if sets:
        yield len(sets), np.concatenate(sets)


def frequent_members(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Members that eight in ``OFTEN`` of all texts hold (eight at least), sorted, and how many texts do.

    Counted exactly in two passes.  First each task counts its members in as many places as a
    filter of a fixed size has bits and proposes places that have ``PART`` of what is asked
    for, by its share of the texts, with their counts.  What tasks don't propose is less than
    ``PART`` of it in all, so a wanted member's place has at least the rest in proposals; a
    group of near copies within one task has not, once there are several times as many tasks.
    So what is kept is bounded by the share and not by the number of texts.  Then all texts are
    counted for what is kept, and what passes by chance has too low a count.
    """
    total = rows.count()
    least = max(8, -(-8 * total // OFTEN))
    texts = rows.select("text")

    def proposed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(WORDS * 64, np.uint8), 0

        def places() -> pa.RecordBatch:
            at = np.flatnonzero(counts >= min(255, max(1, math.ceil(PART * least * n / total - _SLACK))))
            c = counts[at].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.where(c == 255, n, c))], names=["at", "c"])

        for texts, members in _chunks(batches, width):
            values, found = np.unique(members & (WORDS * 64 - 1), return_counts=True)
            counts[values] = np.minimum(counts[values] + found, 255)
            n += texts
            if n >= MOST_TEXTS:
                yield places()
                counts[:], n = 0, 0
        if n:
            yield places()

    few = texts.coalesce(max(1, total // TEXTS)).mapInArrow(proposed, "at bigint, c bigint")  # small tasks would propose all they have
    kept = few.groupBy("at").agg(F.sum("c").alias("c")).filter(F.col("c") >= (1 - PART) * least - _SLACK)
    words = kept.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b")).toArrow()
    filled = np.zeros(WORDS, np.int64)
    filled[words.column("w").to_numpy()] = words.column("b").to_numpy()

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            members = np.concatenate([shingle_set(t, width) for t in part.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(members[(filled[(members >> 6) & (WORDS - 1)] >> (members & 63)) & 1 == 1])], names=["m"])

    counts = texts.mapInArrow(counted, "m bigint").groupBy("m").agg(F.count("*").alias("c")).filter(F.col("c") >= least)
    found = counts.orderBy(F.desc("c"), "m").limit(FREQUENT).toArrow()
    members, often = found.column("m").to_numpy(), found.column("c").to_numpy()
    order = np.argsort(members)
    return members[order], often[order]


def prefixes(rows: DataFrame, width: int, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id``, ``set_id``, ``n`` (members), ``fp`` (SimHash) and ``keys`` (members to join on) with their places ``at`` of each text."""
    common, _ = frequent
    kind, many = rows.schema["doc_id"].dataType.simpleString(), math.ceil(FEW / least) + 1

    def keys(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(members)
        often = common[np.minimum(np.searchsorted(common, members), len(common) - 1)] == members if len(common) else np.zeros(n, bool)
        rare, other, prefix = members[~often], members[often], n - math.ceil(least * n - _SLACK) + 1
        if prefix <= FEW or least < 0.75:
            return np.concatenate([rare, other])[:prefix], np.arange(prefix, dtype=np.int32)
        some = other[: many * (2 * len(rare) <= n)]
        place = np.concatenate([np.arange(min(many, len(rare))), len(rare) + np.arange(len(some))])
        return np.concatenate([rare[:many], some]), place.astype(np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            digests = [simhash_pivots.shingle_digests(t, width) for t in part.column(1).to_pylist()]
            sets = [np.unique(np.frombuffer(d, np.int64)) for d in digests]
            found = [keys(s) for s in sets]
            columns = [part.column(0), pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([simhash_pivots.majority(d) for d in digests], pa.int64()), _lists([k for k, _ in found]), _lists([at for _, at in found])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "set_id", "n", "fp", "keys", "at"])

    return rows.mapInArrow(run, f"doc_id {kind}, set_id bigint, n int, fp bigint, keys array<bigint>, at array<int>")


def _whole(rows: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """``set_id`` and ``members`` of the sets that ``wanted`` (a ``set_id`` column) names, and of a few others.

    Members are hashed again: writing all sets would take more room than the texts.  Here
    they are the low 32 bits of their hashes, for room as well: of two sets of n members n² in
    2^32 or so look common by chance, which moves a similarity by n in 2^32.
    The filter has a fixed size, whatever the input.
    """
    bit = F.pmod(F.xxhash64("set_id"), F.lit(WORDS * 64))
    words = wanted.select((bit / 64).cast("long").alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(set_id), 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    filled = np.zeros(WORDS, np.int64)
    filled[words.column("w").to_numpy()] = words.column("b").to_numpy()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            sets = [shingle_set(t, width) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in sets], pa.int64()), _lists([np.unique(s.astype(np.int32)) for s in sets])], names=["set_id", "members"])

    def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            at, low = part.column(1).to_numpy(), part.column(2).to_numpy()
            yield part.filter(pa.array((filled[at] >> low) & 1 == 1))

    made = rows.select("text").mapInArrow(run, "set_id bigint, members array<int>")
    placed = made.select("set_id", (bit / 64).cast("long").alias("w"), F.pmod(F.xxhash64("set_id"), F.lit(64)).alias("low"), "members")
    return placed.mapInArrow(chosen, "set_id bigint, w bigint, low bigint, members array<int>").select("set_id", "members").dropDuplicates(["set_id"])


def _possible(least: float) -> Column:
    """Whether rows ``x`` and ``y`` of a key can reach the similarity if it is the first that they have in common."""
    after = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    return after >= F.lit(least / (1 + least)) * (F.col("x.n") + F.col("y.n")) - _SLACK


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose whole sets reach the similarity."""
    a, b = (sets.select(F.col("set_id").alias(s), F.col("members").alias(f"_{s}")) for s in "ab")
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(a, "a").join(b, "b").filter(both >= F.lit(least) * (F.size("_a") + F.size("_b") - both) - _SLACK).select("a", "b")


def _met_in_place(held: DataFrame, picked: DataFrame, unique: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Verified pairs ``a``, ``b`` of ``picked`` members of keys with all other members, compared inside the join.

    Rows carry their whole sets and the keys before theirs, so a pair is compared once, at the
    first key that it has in common (an earlier one has compared it already, or will), and
    only pairs that reach the similarity leave the join: what is written grows with the
    members of a key and not with its pairs.
    """
    whole = held.join(unique.select("set_id", "keys"), "set_id").join(sets, "set_id")
    rows = cut(whole.select("key", "set_id", "n", "at", "root", F.slice("keys", 1, F.array_position("keys", F.col("key")).cast("int") - 1).alias("before"), "members"))
    x, y = rows.join(picked, ["key", "set_id"], "left_semi").alias("x"), rows.alias("y")
    enough = (1 + least) * F.size(F.array_intersect("x.members", "y.members")) >= F.lit(least) * (F.size("x.members") + F.size("y.members")) - _SLACK
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _possible(least) & ~F.arrays_overlap("x.before", "y.before") & enough
    return _ordered(x.join(y, met))


def _ordered(pairs: DataFrame) -> DataFrame:
    x, y = F.col("x.set_id"), F.col("y.set_id")
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _settled(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Verified ``pairs`` that connect what all verified pairs would: one for each set first, then those of sets that didn't meet in the same one."""
    first = cut(_verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, least))
    ra, rb = (first.select(F.col("b").alias(s), F.col("a").alias(f"r{s}")) for s in "ab")
    apart = F.coalesce("ra", "a") != F.coalesce("rb", "b")
    rest = pairs.join(ra, "a", "left").join(rb, "b", "left").filter(apart).select("a", "b")
    release(pairs)
    return cut(first.unionByName(_verified(rest, sets, least)))


def _close(unique: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of sets by SimHash links: the sets of a fingerprint with its first, and first sets of linked fingerprints."""
    firsts = cut(unique.groupBy("fp").agg(F.min("set_id").alias("a")))
    same = unique.select("fp", F.col("set_id").alias("b")).join(firsts, "fp").select("a", "b")
    near = simhash_pivots.links(firsts.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    x, y = (firsts.select(F.col("fp").alias(f"f{s}"), F.col("a").alias(s)) for s in "ab")
    return same.unionByName(near.join(x, "fa").join(y, "fb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).filter("a <> b").distinct()


def links(unique: DataFrame, rows: DataFrame, width: int, least: float, crowd: int = 32, leaders: int = 4, rounds: int = 1) -> DataFrame:
    """Edges ``a``, ``b`` that connect exactly what the pairs of similarity ``least`` or more connect.

    ``unique`` has ``set_id``, ``n``, ``fp``, ``keys`` and ``at`` of distinct sets, ``rows`` the texts.
    """
    dealt = unique.select("set_id", "n", F.explode(F.arrays_zip("keys", "at")).alias("k")).select("set_id", "n", "k.at", F.col("k.keys").alias("key")).repartition("key")
    shared = dealt.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    busy = cut(dealt.join(shared, "key"))
    del dealt, shared
    release(rows)
    few, many = busy.filter(F.col("size") <= crowd), cut(busy.filter(F.col("size") > crowd).select("key", "set_id", "n", "at", F.lit(False).alias("done")))
    met = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.set_id") < F.col("y.set_id")) & _possible(least))
    pairs = cut(met.select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).unionByName(_close(unique)).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(many.select("set_id"))
    sets = keep(_whole(rows, width, wanted), "sets")
    del busy, few, met
    release(rows)
    edges, tried = _settled(pairs, sets, least), pairs
    few_tasks = tasks(many.count() + pairs.count())  # what follows has some rows for each of these
    many, edges, tried = (x.coalesce(few_tasks) for x in (many, edges, tried))
    release(rows)
    for turn in range(rounds + 1):
        if many.isEmpty():
            break
        roots = components(edges, "a", "b").withColumnRenamed("node", "set_id")
        held = many.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")).coalesce(few_tasks)
        parts = held.groupBy("key", "root").agg(F.count("*").alias("c")).coalesce(few_tasks).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("size"), F.max("c").alias("most"))
        held = cut(held.join(parts.filter("most < size").coalesce(few_tasks), "key").coalesce(few_tasks))
        outside = held.filter((F.col("root") != F.col("main")) & ~F.col("done"))
        place = F.pmod(F.xxhash64("set_id", F.lit(turn)), F.lit(leaders))
        first = outside.groupBy("key", place.alias("place")).agg(F.min("set_id").alias("set_id"))
        if turn == rounds:
            edges = cut(edges.unionByName(_met_in_place(held, outside.select("key", "set_id"), unique, sets, least)))
            break
        limit = F.lit(crowd)
        ending = outside.groupBy("key").agg(F.count("*").alias("left")).select("key", (F.col("left") <= limit).alias("ends"))
        picked = first.select("key", "set_id").unionByName(outside.join(ending.filter("ends"), "key").select("key", "set_id")).distinct()
        probes = cut(held.join(picked.coalesce(few_tasks), ["key", "set_id"]).select("key", "set_id", "n", "at", "root").coalesce(few_tasks))
        met = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _possible(least)
        pairs = cut(_ordered(probes.alias("x").join(held.alias("y"), met)).join(tried, ["a", "b"], "left_anti"))
        edges = cut(edges.unionByName(_verified(pairs, sets, least))).coalesce(few_tasks)
        tried = cut(tried.unionByName(pairs).coalesce(few_tasks))
        on = held.join(ending.filter("not ends").select("key"), "key", "left_semi").drop("root", "main", "size", "most", "done")
        many = cut(on.coalesce(few_tasks).join(probes.select("key", "set_id", F.lit(True).alias("_done")), ["key", "set_id"], "left").withColumn("done", F.coalesce("_done", F.lit(False))).join(
            many.filter("done").select("key", "set_id", F.lit(True).alias("_before")), ["key", "set_id"], "left").select("key", "set_id", "n", "at", (F.col("done") | F.coalesce("_before", F.lit(False))).alias("done")).coalesce(few_tasks))
    return edges


def near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8, crowd: int = 32, leaders: int = 4, rounds: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``set_id`` and ``component_id`` (smallest doc_id reachable over links) of every row."""
    if not 0 < least <= 1:
        raise ValueError("the similarity is above 0 and at most 1")
    rows = _texts(docs, key, text)
    made = cut(prefixes(rows, width, least, frequent_members(rows, width)))
    found = cut(made.select("doc_id", "set_id"))
    distinct = cut(found.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_rows")))
    edges = links(cut(made.select("set_id", "n", "fp", "keys", "at").dropDuplicates(["set_id"])), rows, width, least, crowd, leaders, rounds)
    del made
    linked = components(edges, "a", "b").join(distinct, F.col("node") == F.col("set_id")).select("set_id", "root", "first")
    least_ids = linked.groupBy("root").agg(F.min("first").alias("least"))
    better = linked.join(least_ids, "root").select("set_id", "least")
    named = distinct.join(better, "set_id", "left").select("set_id", "n_rows", F.coalesce("least", "first").alias("component_id"))
    total = distinct.agg(F.sum("n_rows")).first()[0] or 0
    return named_by(found, named, ["set_id"], ["doc_id"], total)
