"""Numeric operators on glyph vectors, positions and votes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.glyphs import template_score
from ..session import cut

#: Glyphs and templates that a numpy matrix holds at once, so that it stays in a core's cache.
TILE = 64, 512
#: Glyphs that are held against a whole block in whole numbers at once, and the least levels of a dimension that 16 bits must leave.
STRIP, LEVELS = 64, 64
#: Pairs that are measured exactly at once, and the share of a strip's pairs above which all of them are.
EXACT, CROWDED = 1 << 16, 0.1


def template_distances(glyphs: DataFrame, templates: DataFrame, block: int = 4096) -> DataFrame:
    """Each glyph's best error for each label (J19): the glyphs against all templates but themselves.

    Both sides are dealt into blocks of about ``block`` rows; each pair of blocks is a group of
    bounded size and yields a minimum a glyph and label, so no side is broadcast or gathered.
    A vector is shuffled once for each block of the other side.
    """
    left, right = -(-glyphs.count() // block) or 1, -(-templates.count() // block) or 1

    def dealt(rows: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), "vec_id", "label", "embedding")

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"vec_id": [], "label": [], "error": []})
        x, y = np.array(a["embedding"].tolist(), float), np.array(b["embedding"].tolist(), float)
        labels, at = np.unique(b["label"].to_numpy(), return_inverse=True)
        best = least_errors(x, y, a["vec_id"].to_numpy(), b["vec_id"].to_numpy(), at, len(labels))
        i, j = np.nonzero(np.isfinite(best))
        return pd.DataFrame({"vec_id": a["vec_id"].to_numpy()[i], "label": labels[j], "error": best[i, j]})

    kinds = {f.name: f.dataType.simpleString() for f in templates.schema}
    pairs = dealt(glyphs, "i", left, "j", right).groupBy("i", "j").cogroup(dealt(templates, "j", right, "i", left).select("i", "j", "vec_id", "label", "embedding").groupBy("i", "j"))
    found = pairs.applyInPandas(nearest, f"vec_id {kinds['vec_id']}, label {kinds['label']}, error double")
    return found.groupBy("vec_id", "label").agg(F.min("error").alias("error"))


def least_errors(x: np.ndarray, y: np.ndarray, own: np.ndarray, others: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The least mean difference of each row of ``x`` to the rows of ``y`` with each label number ``at`` below ``n``, those of its own id left out; infinite where there is none.

    Entries are first rounded to so few levels that sums of their differences fit 16 bits.
    That is off by a level a dimension at most, so the least one is among those within two
    levels a dimension of the least rounded one; only these are measured exactly.
    """
    order = np.argsort(at, kind="stable")
    y, at, others = y[order], at[order], others[order]
    low = np.minimum(x.min(0), y.min(0))
    levels = 32766 // max(1, x.shape[1])
    level = (np.maximum(x.max(0), y.max(0)) - low).max(initial=0) / max(1, levels)
    if levels < LEVELS or not np.isfinite(level) or level <= 0:
        return (_exact_sums(x, y, own, others, at, n) / x.shape[1]).round(9)
    out, d = np.full((len(x), n), np.inf), x.shape[1]
    mine, theirs = (((v - low) / level).round().astype(np.int16) for v in (x, y))
    columns, exact_x, exact_y = np.ascontiguousarray(theirs.T), np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    sizes, far = np.diff(np.r_[starts, len(at)]), 32767  # no sum of levels
    for i in range(0, len(x), STRIP):
        part = np.ascontiguousarray(mine[i : i + STRIP].T)
        total, apart = np.zeros((part.shape[1], len(at)), np.int16), np.empty((part.shape[1], len(at)), np.int16)
        for a, b in zip(part, columns):
            np.subtract(a[:, None], b, out=apart)
            np.abs(apart, out=apart)
            total += apart
        total[own[i : i + STRIP, None] == others] = far
        most = np.minimum(np.minimum.reduceat(total, starts, axis=1).astype(np.int32) + (2 * d + 1), far - 1)
        one, other = np.divmod(np.flatnonzero(total <= np.repeat(most.astype(np.int16), sizes, axis=1)), len(at))
        if len(one) > CROWDED * total.size and len(at) > 1:
            out[i : i + STRIP] = _exact_sums(x[i : i + STRIP], y, own[i : i + STRIP], others, at, n)
            continue
        for j in range(0, len(one), EXACT):
            left, right = i + one[j : j + EXACT], other[j : j + EXACT]
            error = np.zeros(len(left))
            for a, b in zip(exact_x, exact_y):
                error += np.abs(a[left] - b[right])
            key = left * n + at[right]  # ascends, as rows of y are in the order of their labels
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            out.flat[key[first]] = np.minimum(out.flat[key[first]], np.minimum.reduceat(error, first))
    return (out / d).round(9)


def _exact_sums(x: np.ndarray, y: np.ndarray, own: np.ndarray, others: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The least sums of differences by measuring all pairs exactly; ``at`` ascends."""
    out = np.full((len(x), n), np.inf)
    columns = np.ascontiguousarray(y.T)
    rows, width = TILE
    for j in range(0, len(others), width):
        part, labels, ids = columns[:, j : j + width], at[j : j + width], others[j : j + width]
        starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
        for i in range(0, len(x), rows):
            tile = x[i : i + rows]
            total, apart = np.zeros((len(tile), part.shape[1])), np.empty((len(tile), part.shape[1]))
            for mine, theirs in zip(tile.T, part):
                np.subtract(mine[:, None], theirs, out=apart)
                np.abs(apart, out=apart)
                total += apart
            total[own[i : i + rows, None] == ids] = np.inf
            to = out[i : i + rows]
            to[:, labels[starts]] = np.minimum(to[:, labels[starts]], np.minimum.reduceat(total, starts, axis=1))
    return out


def best_readings(distances: DataFrame, most: float = 0.36, margin: float = 0.04) -> DataFrame:
    """Best label with its margin over the runner-up, and whether it is reliable."""
    ranked = W.partitionBy("vec_id").orderBy("error", "label")
    rows = distances.withColumns({"place": F.row_number().over(ranked), "next_error": F.lead("error").over(ranked)}).filter("place = 1")
    gap = F.round(F.col("next_error") - F.col("error"), 9)
    return rows.select("vec_id", "label", "error", gap.alias("margin"), ((F.col("error") <= most) & F.coalesce(gap >= margin, F.lit(True))).alias("reliable"))


def top_labels(distances: DataFrame, k: int = 3) -> DataFrame:
    """The k best labels of each glyph."""
    place = F.row_number().over(W.partitionBy("vec_id").orderBy("error", "label"))
    return distances.withColumn("place", place.cast("long")).filter(F.col("place") <= k)


def ensemble(first: DataFrame, second: DataFrame, k: int = 3) -> DataFrame:
    """Half the score of each of two models, summed by label; the k best."""
    both = first.unionByName(second).groupBy("vec_id", "label").agg(F.round(F.sum(F.col("score") / 2), 9).alias("score"))
    place = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("score"), "label"))
    return both.withColumn("place", place.cast("long")).filter(F.col("place") <= k)


def top_mean(distances: DataFrame, k: int = 3) -> DataFrame:
    """Mean of the k smallest errors of each label."""
    place = F.row_number().over(W.partitionBy("label").orderBy("error", "vec_id"))
    return distances.withColumn("place", place).filter(F.col("place") <= k).groupBy("label").agg(F.round(F.avg("error"), 6).alias("mean_error"), F.count("*").alias("examples"))


def nearest(distances: DataFrame, k: int = 25, most: float = 40.0) -> DataFrame:
    """The k nearest within a distance."""
    place = F.row_number().over(W.partitionBy("key").orderBy("distance", "other"))
    return distances.filter(F.col("distance") <= most).withColumn("place", place.cast("long")).filter(F.col("place") <= k)


def anchors(references: DataFrame, least: int = 3, labels: int = 6) -> DataFrame:
    """Reference glyphs near their label's others in an image: median distance up to the 60th percentile, or .06.

    A label needs ``least`` references before and after, an image ``labels`` such labels.
    References of a label are compared inside their image (a frame has few numbers).
    """
    some = references.join(references.groupBy("image_id", "label").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least), ["image_id", "label"], "left_semi")
    a, b = some.alias("a"), some.alias("b")
    d = F.round(template_score(F.col("a.embedding"), F.col("b.embedding")), 9)
    same = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") != F.col("b.vec_id"))
    # the distance to itself counts as infinite, so the median of n - 1 others is that of n values
    each = a.join(b, same).groupBy(F.col("a.image_id").alias("image_id"), F.col("a.label").alias("label"), F.col("a.vec_id").alias("vec_id")).agg(F.round(_median_with_infinity(F.array_sort(F.collect_list(d))), 6).alias("distance"))
    limits = each.groupBy("image_id", "label").agg(F.round(F.greatest(F.percentile("distance", F.lit(0.6)), F.lit(0.06)), 6).alias("limit"))
    kept = each.join(limits, ["image_id", "label"]).filter(F.col("distance") <= F.col("limit"))
    enough = kept.groupBy("image_id", "label").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    images = enough.groupBy("image_id").agg(F.count("*").alias("n")).filter(F.col("n") >= labels)
    return kept.join(enough, ["image_id", "label"], "left_semi").join(images, "image_id", "left_semi").select("image_id", "label", "vec_id", "distance")


def _median_with_infinity(others: Column) -> Column:
    """The median of sorted values and infinity."""
    n = F.size(others) + 1
    high = F.get(others, F.floor(n / 2).cast("int"))
    return F.when(n % 2 == 1, high).otherwise((F.get(others, F.floor(n / 2).cast("int") - 1) + high) / 2)


def leave_one_out(kept: DataFrame, references: DataFrame, least: float = 0.9) -> DataFrame:
    """Per image: how many anchors are nearest to another one of their own label, of all labels together, and whether it suffices."""
    rows = kept.select("image_id", "vec_id", "label").join(references.select("image_id", "vec_id", "embedding"), ["image_id", "vec_id"])
    a, b = rows.alias("a"), rows.alias("b")
    d = F.round(template_score(F.col("a.embedding"), F.col("b.embedding")), 9)
    pairs = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.vec_id") != F.col("b.vec_id")))
    best = pairs.groupBy(F.col("a.image_id").alias("image_id"), F.col("a.vec_id").alias("vec_id"), F.col("a.label").alias("label")).agg(F.min(F.struct(d.alias("d"), F.col("b.label").alias("label"))).alias("best"))
    return best.groupBy("image_id").agg(F.round(F.avg((F.col("best.label") == F.col("label")).cast("double")), 6).alias("accuracy"), F.count("*").alias("n")).withColumn("enough", F.col("accuracy") >= least)


def font_corrections(errors: DataFrame, examples: int = 3, most: float = 0.16, margin: float = 0.025) -> DataFrame:
    """The letter that a character is corrected to by its image's own font.

    ``errors``: vec_id, char, label, error of each example.  A label counts with ``examples``
    examples or more, by the mean of that many best errors; the best one must be near enough
    and lead the runner-up.
    """
    place = F.row_number().over(W.partitionBy("vec_id", "label").orderBy("error"))
    means = errors.withColumn("_k", place).filter(F.col("_k") <= examples).groupBy("vec_id", "char", "label").agg(F.round(F.avg("error"), 9).alias("error"), F.count("*").alias("_n")).filter(F.col("_n") == examples)
    order = W.partitionBy("vec_id").orderBy("error", "label")
    first = means.withColumns({"_k": F.row_number().over(order), "next_error": F.lead("error").over(order)}).filter("_k = 1")
    good = (F.col("error") <= most) & (F.round(F.col("next_error") - F.col("error"), 9) >= margin)
    return first.filter(good & (F.col("label") != F.col("char"))).select("vec_id", F.col("char").alias("old"), F.col("label").alias("new"), "error", "next_error")


#: A group of so many values is gathered to find its median; larger ones are narrowed first.
MOST_VALUES = 1_000_000
#: Ranges that a group's values are counted in at once.
RANGES = 256


def exact_medians(rows: DataFrame, keys: list[str], value: str, most: int = MOST_VALUES) -> DataFrame:
    """``median`` of each group (A14, A15, A19), exact whatever the group's size; null and NaN don't count, and a group without values has no row.

    Groups of more than ``most`` values, which are fewer than rows / ``most``, are never
    gathered: each round counts their values in ranges between bounds, combined before the
    shuffle, and goes on inside the range that holds the wanted rank, until at most ``most``
    values or a single one are left there.  A range's bounds are its own least and greatest
    value, so each round at least splits them off.
    """
    good = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = good.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    large = cut(sizes.filter(F.col("n") > most))
    if large.isEmpty():
        return good.groupBy(*keys).agg(F.median("_v").alias("median"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return reduce(Column.__and__, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys])

    def beside(facts: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
        """Facts with the state of their large group; there are few of those, so no fact is shuffled."""
        names = F.broadcast(few.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in few.columns]))
        return facts.join(names, same(facts, names), how).drop(*[f"_{k}" for k in keys])

    small = beside(good, large.select(*keys), "left_anti").groupBy(*keys).agg(F.median("_v").alias("median"))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    state = large.select(*keys, F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"))
    found = None
    while True:
        ended = state.filter((F.col("inside") <= most) | (F.col("low") == F.col("high")))
        inside = beside(good, ended).filter(F.col("_v").between(F.col("low"), F.col("high")) & (F.col("low") < F.col("high")))
        gathered = inside.groupBy(*keys, "rank").agg(F.array_sort(F.collect_list("_v")).alias("_all"), F.first("below").alias("_below"))  # at most ``most``
        values = gathered.select(*keys, F.get("_all", (F.col("rank") - F.col("_below")).cast("int")).alias("_v")).unionByName(ended.filter("low = high").select(*keys, F.col("low").alias("_v")))
        found = cut(values if found is None else found.unionByName(values))
        state = cut(state.filter((F.col("inside") > most) & (F.col("low") < F.col("high"))))
        if state.isEmpty():
            break
        half = F.col("high") / 2 - F.col("low") / 2  # a difference may be over the largest number
        range_ = F.least(F.lit(RANGES - 1), F.floor((F.col("_v") / 2 - F.col("low") / 2) / half * RANGES)).cast("int")
        counted = beside(good, state).filter(F.col("_v").between(F.col("low"), F.col("high"))).groupBy(*keys, "rank", "below", range_.alias("range")).agg(F.count("*").alias("inside"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        up = W.partitionBy(*keys, "rank").orderBy("range")
        placed = counted.withColumn("below", F.col("below") + F.sum("inside").over(up) - F.col("inside"))
        state = cut(placed.filter((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("inside"))).select(*state.columns))
    return small.unionByName(found.groupBy(*keys).agg((F.min("_v") / 2 + F.max("_v") / 2).alias("median")))


def mean_masks(glyphs: DataFrame) -> DataFrame:
    """Element-wise mean and median of a label's vectors (A15), for labels of any size."""
    each = glyphs.select("label", F.posexplode("embedding").alias("at", "value")).withColumn("value", F.col("value").cast("double"))
    means = each.groupBy("label", "at").agg(F.round(F.avg("value"), 5).alias("mean"))
    medians = exact_medians(each, ["label", "at"], "value").select(F.col("label").alias("_label"), F.col("at").alias("_at"), F.round("median", 5).alias("median"))
    return means.join(medians, F.col("label").eqNullSafe(F.col("_label")) & (F.col("at") == F.col("_at")), "left").select("label", "at", "mean", "median")


def agreed_words(averages: DataFrame, votes: DataFrame, allowed: DataFrame, least: int = 2) -> DataFrame:
    """Words that the mean and the median mask of a field both spell, with ``least`` votes, if allowed (A15): field, word.

    ``averages``: field, by (mean or median), word; ``allowed`` is the catalogue.
    """
    both = averages.groupBy("field").agg(F.count("*").alias("_n"), F.count_distinct("word").alias("_words"), F.min("word").alias("word")).filter("_n = 2 and _words = 1")
    return both.join(votes.filter(F.col("n") >= least).select("field", "word"), ["field", "word"], "left_semi").join(F.broadcast(allowed.select("word")), "word", "left_semi").select("field", "word")


def islands(events: DataFrame, gap: int) -> DataFrame:
    """Positions grouped where the step exceeds ``gap``: bounds, size, mean."""
    order = W.partitionBy("key").orderBy("pos", "event_id")
    started = events.withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(order) > gap).cast("int"), F.lit(0)))
    numbered = started.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("key", "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("weight"))


#: Fewest and most peaks of an axis, and the smallest step.
LEAST_POINTS, MOST_POINTS, LEAST_STEP = 6, 350, 6


#: Positions and steps are whole thousandths, so that every comparison is exact.
UNIT = 1000
#: Points times steps that are folded at once; a key has no more than four steps a point.
FOLDED = 1_000_000


def _phases(points: DataFrame) -> DataFrame:
    """The step and the phase (``p0``, a point's place) of each key's lattice: key, step, p0.

    A key's points are gathered, ``MOST_POINTS`` at most, and the keys of a batch are folded
    together.
    """
    gathered = points.groupBy("key").agg(F.first("length").alias("length"), F.first("points").alias("points"), F.collect_list("p").alias("ps"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).value_lengths().to_numpy()
            parts = np.cumsum(4 * sizes.astype(np.int64) ** 2) // FOLDED
            for ends in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(parts)) + 1):
                if len(ends):
                    part = batch.slice(ends[0], len(ends))
                    at, step, p = best_phases(part.column(3).flatten().to_numpy(), sizes[ends], part.column(1).to_numpy(), part.column(2).to_numpy())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(step), pa.array(p)], names=["key", "step", "p0"])

    kind = points.schema["key"].dataType.simpleString()
    return gathered.mapInArrow(run, f"key {kind}, step bigint, p0 bigint")


def best_phases(p: np.ndarray, sizes: np.ndarray, length: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which groups of ``sizes`` places each have a lattice, its step and the place that is its phase.

    Candidate steps are differences of neighbours over 1 to 4, to a tenth, from the least step
    to below a quarter of the axis.  Sorted phases of a group and step count what is near.
    """
    group = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((p, group))
    p, starts = p[order], np.cumsum(sizes) - sizes
    apart = np.diff(p)
    some = np.flatnonzero((np.diff(group) == 0) & (apart > 0))
    apart, of = apart[some], group[some]
    tenths = np.concatenate([(2 * apart + 100 * k) // (200 * k) for k in (1, 2, 3, 4)])
    of = np.tile(of, 4)
    good = (tenths >= 10 * LEAST_STEP) & (tenths * 400 < length[of])
    wide = int(tenths[good].max(initial=0)) + 1
    of, tenths = np.divmod(np.unique(of[good] * wide + tenths[good]), wide)
    step, n = tenths * 100, sizes[of].astype(np.int64)
    row = np.repeat(np.arange(len(of)), n)
    first = np.cumsum(n) - n
    p = p[np.arange(len(row)) - first[row] + starts[of][row]]
    near = np.maximum(1800, step // 25)[row]
    room, turn = 4 * 100 * wide, step[row]
    phase = p % turn
    order = np.argsort(row * room + phase, kind="stable")
    p, phase = p[order], phase[order]  # rows stay together
    base = row * room
    placed = base + phase
    upto = lambda value: np.searchsorted(placed, base + value, "right")
    counted = upto(phase + near - 1) - upto(phase - near) + (first + n)[row] - upto(phase + turn - near) + upto(phase + near - 1 - turn) - first[row]
    enough = np.flatnonzero(counted * 10 >= points[of][row] * 8)
    key, turn, p = of[row][enough], turn[enough], p[enough]
    order = np.lexsort((p, turn, -counted[enough] ** 2 * turn, key))
    key, turn, p = key[order], turn[order], p[order]
    best = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[best], turn[best], p[best]


def _tolerance(step: Column) -> Column:
    return F.greatest(F.lit(1800), F.floor(step / 25))


def lattice(points: DataFrame) -> DataFrame:
    """The one-dimensional lattice of each key's points.

    Every candidate step folds a key's points onto a circle; points within the tolerance of
    each other there are counted in sorted phases, also across the seam.  The point with most others near it, weighed by the root of the step, is the
    lattice's phase if four fifths of all are near (ties: smaller step, then position).  A
    regression over the lattice's indices gives step and start; rules that the edge of the
    axis may hide are added, one before and up to two behind.

    ``points``: key, pos, length (of the axis).  One row a key: ``points``, ``state`` (fitted,
    no-lattice, too-few or too-many), ``start``, ``end``, ``step``, ``share``.
    """
    counts = points.groupBy("key").agg(F.count("*").alias("points"), F.round(F.max("length") * UNIT).cast("bigint").alias("length"))
    size = F.when(F.col("points") > MOST_POINTS, "too-many").when(F.col("points") < LEAST_POINTS, "too-few")
    sized = counts.withColumn("_size", size)
    fit = points.select("key", F.round(F.col("pos") * UNIT).cast("bigint").alias("p")).join(sized.filter("_size is null").select("key", "points", "length"), "key")
    best = _phases(fit)
    off = F.pmod(F.col("p") - F.col("p0"), "step")
    on = fit.join(best, "key").withColumn("off", F.when(off < _tolerance(F.col("step")), off).when(F.col("step") - off < _tolerance(F.col("step")), off - F.col("step"))).filter("off is not null")
    place = ((F.col("p") - F.col("p0") - F.col("off")) / F.col("step")).alias("i")
    lines = on.select("key", "length", "points", (F.col("p") / UNIT).alias("y"), place).groupBy("key").agg(
        F.regr_slope("y", "i").alias("step"), F.regr_intercept("y", "i").alias("at"), F.min("i").alias("low"), F.max("i").alias("high"), (F.count("*") / F.max("points")).alias("share"), (F.max("length") / UNIT).alias("axis"),
    ).filter("step is not null").withColumns({"start": F.col("at") + F.col("low") * F.col("step"), "end": F.col("at") + F.col("high") * F.col("step")})
    close = F.greatest(F.lit(2.0), F.col("step") * 0.04)
    hidden = [F.abs(F.col("axis") - 1 - F.col("end") - k * F.col("step")) < close for k in (1, 2)]
    ends = lines.withColumns({"start": F.col("start") - F.when(F.abs(F.col("start") - F.col("step")) < close, F.col("step")).otherwise(0), "end": F.col("end") + F.col("step") * F.when(hidden[0], 1).when(hidden[1], 2).otherwise(0)})
    rows = sized.join(ends.drop("axis"), "key", "left")
    state = F.coalesce("_size", F.when(F.col("step").isNull(), "no-lattice").otherwise("fitted"))
    return rows.select("key", "points", state.alias("state"), *[F.round(c, 3).alias(c) for c in ("start", "end", "step", "share")])


def candidate_steps(points: DataFrame) -> DataFrame:
    """Candidate steps of each key: neighbour differences over 1 to 4, with their votes."""
    order = W.partitionBy("key").orderBy("pos", "event_id")
    steps = points.withColumn("d", F.col("pos") - F.lag("pos").over(order)).filter("d > 0")
    each = steps.select("key", F.explode(F.transform(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]), lambda k: F.floor(F.col("d") / k))).alias("step"))
    return each.groupBy("key", "step").agg(F.count("*").alias("votes"))


def votes(readings: DataFrame, least: int = 5, lead: int = 3) -> DataFrame:
    """The winner of each field if it has enough votes and leads the runner-up (A10)."""
    counted = readings.groupBy("field", "word").agg(F.count("*").alias("n"))
    order = W.partitionBy("field").orderBy(F.desc("n"), "word")
    first = counted.withColumns({"place": F.row_number().over(order), "runner_up": F.coalesce(F.lead("n").over(order), F.lit(0))}).filter("place = 1")
    return first.filter((F.col("n") >= least) & (F.col("n") >= lead * F.col("runner_up"))).select("field", "word", "n", "runner_up")


def shared_votes(readings: DataFrame, least: int = 5, lead: int = 2, percent: int = 55) -> DataFrame:
    """Winners that also hold a share of all votes and collide with no other field's winner."""
    total = readings.groupBy("field").agg(F.count("*").alias("total"))
    won = votes(readings, least, lead).join(total, "field").filter(F.col("n") * 100 > percent * F.col("total"))
    alone = won.groupBy("word").agg(F.count("*").alias("fields")).filter("fields = 1")
    return won.join(alone, "word", "left_semi")


def window_votes(readings: DataFrame) -> DataFrame:
    """Text with the largest sum of scores of each field, and its number of agreeing windows."""
    each = readings.groupBy("field", "word").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("windows"))
    place = F.row_number().over(W.partitionBy("field").orderBy(F.desc("score"), "word"))
    return each.withColumn("place", place).filter("place = 1").select("field", "word", "score", "windows", (F.col("windows") >= 2).alias("agreed"))


def best_variants(variants: DataFrame) -> DataFrame:
    """The variant of each field with the best coverage^.15 * score * (1 + .1 * sum of the scores that agree with it).

    ``variants``: field, id, decoded (null if it has no reading), score, coverage, tiny (agreement doesn't count then).
    Of equal values the smallest id counts, then the smallest reading, none first.
    """
    agreed = F.sum("score").over(W.partitionBy("field", "decoded"))
    consensus = F.when(F.col("decoded").isNull() | F.col("tiny"), F.lit(0.0)).otherwise(agreed)
    value = F.round(F.pow(F.col("coverage"), F.lit(0.15)) * F.col("score") * (1 + consensus * 0.1), 9)
    place = F.row_number().over(W.partitionBy("field").orderBy(F.desc("value"), "id", "decoded"))
    return variants.withColumn("value", value).withColumn("_k", place).filter("_k = 1").select("field", "id", "decoded", "value")


def ambiguous_fields(readings: DataFrame, least: float = 0.8) -> DataFrame:
    """Fields with more than one confident reading."""
    return readings.filter(F.col("score") > least).groupBy("field").agg(F.count_distinct("word").alias("readings")).filter("readings > 1")


def symbol_consensus(symbols: DataFrame) -> DataFrame:
    """Symbols seen in two variants or more and covered by fewer than two clear digits."""
    return symbols.groupBy("field", "symbol").agg(F.count_distinct("variant").alias("variants"), F.count_if("covered").alias("covering")).filter("variants >= 2 and covering < 2")


def word_alternatives(fields: DataFrame, allowed: DataFrame) -> DataFrame:
    """All words that a field's ranked characters can spell and that are allowed.

    ``fields``: field, first, second, third (arrays of characters): chained explodes, bounded by the arrays.
    """
    one = fields.select("field", F.explode("first").alias("a"), "second", "third")
    two = one.select("field", "a", F.explode("second").alias("b"), "third")
    words = two.select("field", "a", "b", F.explode("third").alias("c")).select("field", F.concat("a", "b", "c").alias("word"))
    return words.join(F.broadcast(allowed.select("word")), "word", "left_semi").distinct()  # the allowed words are catalogue codes


def run_times(runs: DataFrame) -> DataFrame:
    """Median and peak by sample and version."""
    sizes = runs.groupBy("key", "version").agg(F.round(F.max("value"), 6).alias("peak"), F.count("*").alias("n"))
    medians = exact_medians(runs, ["key", "version"], "value").select(F.col("key").alias("_key"), F.col("version").alias("_version"), F.round("median", 6).alias("median"))
    return sizes.join(medians, F.col("key").eqNullSafe(F.col("_key")) & F.col("version").eqNullSafe(F.col("_version")), "left").select("key", "version", "median", "peak", "n")


def arbitrated(readings: DataFrame, errors: DataFrame, weak: float = 0.9, digit: tuple[float, float] = (0.12, 0.03), other: tuple[float, float] = (0.16, 0.02)) -> DataFrame:
    """Digits replaced by their image's anchors, and what was changed (R12): field, pos, old, new, changed.

    ``readings``: field, pos, char, score; ``errors``: field, pos, label, error by anchor label.
    Digits read with score ``weak`` or more stay; a digit needs an error up to ``digit[0]`` and
    a margin of ``digit[1]``, another character those of ``other``.  A field that would not be
    all digits afterwards keeps what was read.
    """
    order = W.partitionBy("field", "pos").orderBy("error", "label")
    best = errors.withColumns({"_k": F.row_number().over(order), "_next": F.lead("error").over(order)}).filter("_k = 1").select("field", "pos", "label", "error", F.round(F.col("_next") - F.col("error"), 9).alias("margin"))
    rows = readings.join(best, ["field", "pos"], "left")
    is_digit = F.col("char").rlike("^[0-9]$")
    near = lambda gates: (F.col("error") <= gates[0]) & (F.col("margin") >= gates[1])
    good = F.coalesce(F.when(is_digit, (F.col("score") < weak) & near(digit)).otherwise(near(other)), F.lit(False))
    proposed = rows.withColumn("_new", F.when(good, F.col("label")).otherwise(F.col("char")))
    decodes = proposed.groupBy("field").agg(F.bool_and(F.col("_new").rlike("^[0-9]$")).alias("_whole"))
    new = F.when(F.col("_whole"), F.col("_new")).otherwise(F.col("char"))
    return proposed.join(decodes, "field").select("field", "pos", F.col("char").alias("old"), new.alias("new"), (new != F.col("char")).alias("changed"))


def repaired_prefixes(items: DataFrame, letters: DataFrame, variants: DataFrame, votes: DataFrame, allowed: DataFrame, most: float = 0.18, margin: float = 0.025) -> DataFrame:
    """Codes whose first letter is replaced by the nearest anchor letter (R14): field, old, new.

    ``items``: field, code; ``letters``: field, letter, error; ``variants``: field, word, score;
    ``votes``: field, word, n.  The letter must be near and lead; then the repaired code must be
    allowed and a variant over .3; else, if the old one isn't allowed, the allowed word of that
    letter with most votes, two at least, counts (ties by word).  ``allowed`` is the catalogue.
    """
    order = W.partitionBy("field").orderBy("error", "letter")
    best = letters.withColumns({"_k": F.row_number().over(order), "_next": F.lead("error").over(order)}).filter("_k = 1")
    best = best.filter((F.col("error") <= most) & F.coalesce(F.round(F.col("_next") - F.col("error"), 9) >= margin, F.lit(True))).select("field", "letter")
    known = F.broadcast(allowed.select(F.col("word").alias("_word"), F.lit(True).alias("_known")))  # catalogue codes
    rows = items.join(best, "field").withColumn("word", F.concat("letter", F.substring("code", 2, 20)))
    rows = rows.join(known, F.col("word") == F.col("_word"), "left").drop("_word").withColumnRenamed("_known", "_fits")
    rows = rows.join(known, F.col("code") == F.col("_word"), "left").drop("_word").withColumnRenamed("_known", "_was")
    supported = variants.filter("score > 0.3").select("field", "word", F.lit(True).alias("_supported")).distinct()
    valid = votes.join(known, F.col("word") == F.col("_word")).select("field", F.substring("word", 1, 1).alias("letter"), "word", "n")
    top = valid.groupBy("field", "letter").agg(F.min(F.struct((-F.col("n")).alias("n"), "word")).alias("_top"))
    rows = rows.join(supported, ["field", "word"], "left").join(top, ["field", "letter"], "left")
    repaired = F.when(F.col("_fits") & F.col("_supported"), F.col("word")).when(F.col("_was").isNull() & (F.col("_top.n") <= -2), F.col("_top.word"))
    return rows.withColumn("new", repaired).filter("new is not null").select("field", F.col("code").alias("old"), "new")
