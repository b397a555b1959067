"""Operator 10: line deduplication by a segment-partition edit join (native expressions only).

A line of a document goes if the same line stands earlier in that document, if a
document with a smaller id has the same line, or if a line within ``edits`` edits
(insertions, deletions, substitutions; 1 unless set) was first seen in a document with a
smaller id.  Equal lines count from ``min_exact`` code points on, close ones from
``min_chars`` on; shorter lines, empty ones among them, stay.

Edit join: a line of n code points is split into threshold-plus-one segments.  Within
so many edits one segment of the shorter line stands unchanged in the longer one, so a
line is indexed under (n, segment number, segment) and probes lengths n - ``edits`` to n
at those shifts only that leave enough edits for both sides of the segment.  Candidates
are verified by an edit automaton whose band of 2 * ``edits`` + 1 diagonals is one
integer for all error counts.

Scale: exact copies are combined before any shuffle of lines; segments travel as
hashes; texts are fetched for candidates only.  An index key shared by more than
``crowd`` lines isn't joined pairwise: its lines are grouped by what is left of them
without one code point, position by position, which is exact for one edit, linear in
the group, and needs only the smallest document id of each group (for more edits than
one, such keys are joined pairwise all the same).  Keys that hold more
than one in 4096 of all rows are found beforehand by counts in a fixed number of
buckets, and their lines go that way without being dealt by key.  A line that stands
in very many documents reaches them by a broadcast of fewer than 4096 such lines.
What goes comes back to a row as positions, by document id and text hash: rows without
an id are dealt like others, and a text of many lines costs no more than sorting them.

Defined results: null texts stay null; empty texts and documents without lines to drop
are unchanged; a document that loses all its lines gets an empty text; rows with
equal ids count as one document; null ids sort last; a very long text is one row, its
lines are dealt like others, and a line of a crowded key costs the square of its length;
an empty table gives an empty table; all columns of the input come back, with
``n_lines``, ``n_dropped`` and ``dropped_chars`` (their names are free to clash: the
operator's columns replace them).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep, let, named_by


def _key(line: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a line."""
    return F.xxhash64(line), F.xxhash64(F.lit(7), line)


def _repeats(lines: Column) -> Column:
    """Positions (from 0) of lines that stand earlier in the same array; by sorting, not by pairs."""
    def found(placed: Column) -> Column:
        marked = F.transform(placed, lambda s, k: F.when((k > 0) & (F.element_at(placed, F.greatest(k, F.lit(1))).getField("x") == s.getField("x")), s.getField("i")))
        return F.filter(marked, lambda i: i.isNotNull())

    placed = F.array_sort(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(lines)) == F.size(lines), F.array().cast("array<int>")).otherwise(let(placed, found))


#: The automaton's states for all error counts fit one long.
MOST_EDITS = 4


def within_edits(a: Column, b: Column, edits: int = 1) -> Column:
    """Whether two strings are within so many edits: bit-parallel over a band of diagonals.

    Bit d of a state is diagonal d - ``edits`` (position in ``a`` minus position in ``b``).
    For each code point of ``b`` its neighbours in ``a`` give a match mask; the states of
    all error counts advance together as one integer, ``2 * edits + 1`` bits each.
    """
    n, m, width = F.char_length(a), F.char_length(b), 2 * edits + 1
    band, start = (1 << width) - 1, sum(((1 << (e + 1)) - 1) << (edits + e * width) for e in range(edits + 1))

    def ends(left: Column) -> Column:
        def advance(state: Column, step: Column) -> Column:
            char, j = step.getField("c"), step.getField("j")
            mask = F.lit(0).cast("long")
            for d in range(width):
                mask = mask.bitwiseOR(F.when(F.get(left, j + d - edits) == char, F.lit(1 << d).cast("long")).otherwise(F.lit(0).cast("long")))

            def levels(mask: Column) -> Column:
                out, before, last = F.lit(0).cast("long"), None, None
                for e in range(edits + 1):
                    here = F.shiftrightunsigned(state, e * width).bitwiseAND(F.lit(band))
                    new = here.bitwiseAND(mask)
                    if e:
                        new = new.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(last, 1).bitwiseAND(F.lit(band)))
                    out, before, last = out.bitwiseOR(F.shiftleft(new, e * width)), here, new
                return out

            return levels(mask) if edits == 1 else let(mask, levels)

        steps = F.transform(F.filter(F.split(b, ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), i.alias("j")))
        return F.aggregate(steps, F.lit(start).cast("long"), advance)

    end = let(F.filter(F.split(a, ""), lambda c: c != ""), ends)
    end = let(end, lambda x: reduce(Column.bitwiseOR, [F.shiftrightunsigned(x, e * width) for e in range(edits + 1)]))
    wanted = F.get(F.array(*[F.lit(1 << d).cast("long") for d in range(width)]), n - m + edits)  # null if the lengths differ by more
    return F.coalesce(end.bitwiseAND(wanted) != 0, F.lit(False))


def _segments(lines: DataFrame, edits: int = 1) -> DataFrame:
    """Index and probe keys of each line; ``side`` tells which segment stands in the key."""
    n, line = F.col("n"), F.col("line")

    def row(length: Column, side: int, part: Column, probe: bool) -> Column:
        return F.struct(F.xxhash64(length, F.lit(side), part).alias("k"), F.lit(side).alias("side"), F.lit(probe).alias("probe"))

    rows = []
    for gap in range(edits + 1):
        length = n - gap if gap else n
        edge = [F.floor(length * k / (edits + 1)).cast("int") for k in range(edits + 2)]
        for i in range(1, edits + 2):
            low, high = max(1 - i, gap - (edits + 1 - i)), min(i - 1, gap + edits + 1 - i)
            for shift in range(low, high + 1):
                part = F.substring(line, edge[i - 1] + 1 + shift, edge[i] - edge[i - 1])
                rows.append(row(length, i, part, bool(gap or shift)))
    return lines.select("a", "b", "seen", F.explode(F.array_distinct(F.array(*rows)) if edits > 1 else F.array(*rows)).alias("r")).select("r.k", "r.side", "r.probe", "a", "b", "seen")


def _crowded(lines: DataFrame) -> DataFrame:
    """Lines of crowded keys that an earlier line is within one edit of: grouped without one code point.

    ``side`` 1: the first half is shared, the change is in the second half; 2: the reverse.
    A substitution leaves the same rest at the same position with the same length; a
    deletion leaves exactly the shorter line.
    """
    n, line, p = F.col("n"), F.col("line"), F.col("p")
    first = F.when(F.col("side") == 1, F.floor((n - 1) / 2) + 1).otherwise(1).cast("int")
    last = F.when(F.col("side") == 1, n).otherwise(F.floor(n / 2) + 1).cast("int")
    rest = F.concat(F.left(line, p - 1), F.substring(line, p + 1, n))
    cut_out = lines.select("a", "b", "seen", "n", "line", F.explode(F.sequence(first, last)).alias("p"))
    swapped = cut_out.select("a", "b", "seen", F.xxhash64(F.lit(1), n, p, rest).alias("k1"), F.xxhash64(F.lit(2), p, rest, n).alias("k2"))
    deleted = cut_out.select("a", "b", "seen", F.xxhash64(F.lit(3), rest).alias("k1"), F.xxhash64(F.lit(4), rest).alias("k2"))
    # two longer lines can share a deletion without being within one edit: only whole lines meet deletions
    whole = lines.select(F.xxhash64(F.lit(3), line).alias("k1"), F.xxhash64(F.lit(4), line).alias("k2"), F.col("a").alias("wa"), F.col("b").alias("wb"), F.col("seen").alias("whole_seen"))
    by_swap = swapped.groupBy("k1", "k2").agg(F.min("seen").alias("least"))
    swaps = swapped.join(by_swap, ["k1", "k2"]).filter(_earlier("least", "seen")).select("a", "b")
    by_whole = whole.groupBy("k1", "k2").agg(F.min("whole_seen").alias("least"))
    longer = deleted.join(by_whole, ["k1", "k2"]).filter(_earlier("least", "seen")).select("a", "b")
    by_deletion = deleted.groupBy("k1", "k2").agg(F.min("seen").alias("least"))
    shorter = whole.join(by_deletion, ["k1", "k2"]).filter(_earlier("least", "whole_seen")).select(F.col("wa").alias("a"), F.col("wb").alias("b"))
    return swaps.unionByName(longer).unionByName(shorter)


def _earlier(a: str, b: str) -> Column:
    """Whether document ``a`` comes before ``b``, nulls last."""
    return F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) < F.col(b)))


def _frequent(keys: DataFrame, crowd: int, share: int, buckets: int = 1 << 16) -> DataFrame:
    """``k`` of more than ``crowd`` rows and of more than one in ``share`` of all rows: fewer than ``share`` keys.

    Counts are combined before they are dealt: first by bucket, then by key in the
    fewer than ``share`` buckets that are full enough to hold such a key.
    """
    bucket = F.pmod(F.col("k"), F.lit(buckets)).alias("bucket")
    counts = cut(keys.groupBy(bucket).agg(F.count("*").alias("size")))
    least = max(crowd, (counts.agg(F.sum("size")).first()[0] or 0) // share)
    full = counts.filter(F.col("size") > least).select("bucket")
    held = keys.select("k", bucket).join(F.broadcast(full), "bucket", "left_semi")
    return cut(held.groupBy("k").agg(F.count("*").alias("size")).filter(F.col("size") > least).select("k"))


def near_lines(lines: DataFrame, crowd: int = 64, fetch_buckets: int = 1 << 20, share: int = 4096, edits: int = 1) -> DataFrame:
    """``a``, ``b`` of lines within ``edits`` edits of a line with smaller ``seen``.

    ``lines`` has distinct lines: ``line``, ``n``, ``a``, ``b`` (its key) and ``seen``.
    """
    halves = _segments(lines, edits)
    if edits == 1:
        frequent = F.broadcast(_frequent(halves.select("k"), crowd, share))
        dealt = halves.join(frequent, "k", "left_anti").repartition("k")
    else:
        dealt = halves.repartition("k")
    groups = dealt.groupBy("k").agg(
        F.count("*").alias("size"), F.min("a").alias("a1"), F.max("a").alias("a2"), F.min("b").alias("b1"), F.max("b").alias("b2"),
        F.min("seen").alias("s1"), F.max(F.coalesce(F.col("seen").cast("string"), F.lit(""))).alias("s2"), F.min("probe").alias("p"), F.max("side").alias("o"),
    )
    busy = groups.filter("size > 1 and (a1 <> a2 or b1 <> b2) and s1 is not null and not p and o > 0 and s2 is not null").select("k", "size")
    members = cut(dealt.join(busy, "k"))
    few = members.filter(F.col("size") <= crowd) if edits == 1 else members
    x, y = few.alias("x"), few.alias("y")
    ahead = F.col("y.seen").isNotNull() & (F.col("x.seen").isNull() | (F.col("y.seen") < F.col("x.seen")))
    pairs = cut(x.join(y, (F.col("x.k") == F.col("y.k")) & ~(F.col("x.probe") & F.col("y.probe")) & ahead).select(
        F.col("x.a").alias("xa"), F.col("x.b").alias("xb"), F.col("y.a").alias("ya"), F.col("y.b").alias("yb")
    ).distinct())
    bucket = F.pmod(F.col("a"), F.lit(fetch_buckets))
    wanted = pairs.select(F.explode(F.array("xa", "ya")).alias("a"))
    if edits == 1:
        shared = halves.join(frequent, "k", "left_semi").select("a", "b", "side")
        many = members.filter(F.col("size") > crowd).select("a", "b", "side").unionByName(shared).distinct()
        wanted = wanted.unionByName(many.select("a"))
    wanted = wanted.select(bucket.alias("bucket")).distinct()
    # at most fetch_buckets rows, whatever the input: a bounded filter before texts are shuffled
    texts = lines.select("a", "b", "n", "line", "seen", bucket.alias("bucket")).join(F.broadcast(wanted), "bucket", "left_semi")
    tx, ty = (texts.select(F.col("a").alias(f"{s}a"), F.col("b").alias(f"{s}b"), F.col("line").alias(f"{s}line")) for s in "xy")
    verified = pairs.join(tx, ["xa", "xb"]).join(ty, ["ya", "yb"]).filter(within_edits(F.col("xline"), F.col("yline"), edits)).select(F.col("xa").alias("a"), F.col("xb").alias("b"))
    if edits == 1:
        verified = verified.unionByName(_crowded(texts.join(many, ["a", "b"]).select("a", "b", "n", "line", "seen", "side")))
    return verified.distinct()


def dedup_lines(docs: DataFrame, min_chars: int = 20, crowd: int = 64, key: str = "doc_id", text: str = "text", share: int = 4096, edits: int = 1, min_exact: int = 1) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and ``n_lines``, ``n_dropped``, ``dropped_chars``."""
    if not 0 < edits <= MOST_EDITS or min_chars <= edits:
        raise ValueError(f"1 to {MOST_EDITS} edits, fewer than a line has code points")
    lines, hashed = F.split(F.col(text), "\n"), F.xxhash64(text).alias("row")
    own = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("doc"), hashed, F.posexplode(lines).alias("at", "line")).filter(F.char_length("line") >= min_exact)
    seen = own.groupBy("line").agg(F.min("doc").alias("seen"), F.count("*").alias("n_rows"))
    a, b = _key(F.col("line"))
    keyed = keep(seen.select("line", F.char_length("line").alias("n"), a.alias("a"), b.alias("b"), "seen", "n_rows"), "lines")
    near = cut(near_lines(keyed.filter(F.col("n") >= min_chars), crowd, share=share, edits=edits)).withColumn("near", F.lit(True))
    known = keyed.select("a", "b", "seen", "n_rows").join(near, ["a", "b"], "left")
    total = keyed.agg(F.sum("n_rows")).first()[0] or 0
    placed = named_by(own.select("doc", "row", "at", a.alias("a"), b.alias("b")), known, ["a", "b"], ["doc", "row", "at"], total, share)
    gone = placed.filter(F.coalesce("near", F.lit(False)) | _earlier("seen", "doc")).groupBy("doc", "row").agg(F.collect_set("at").alias("_gone"))
    named = gone.select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), "_gone")
    joined = docs.drop("n_lines", "n_dropped", "dropped_chars").join(named, F.col(key).eqNullSafe(F.col("_doc")) & (hashed == F.col("_row")), "left").drop("_doc", "_row")

    def judged(here: Column) -> Column:
        gone = F.coalesce("_gone", F.array().cast("array<int>"))
        left = F.array_except(F.array_except(F.sequence(F.lit(0), F.size(here) - 1), gone), F.filter(_repeats(here), lambda i: F.char_length(F.get(here, i)) >= min_exact))
        return let(left, lambda k: F.struct(
            F.size(here).cast("long").alias("n_lines"), (F.size(here) - F.size(k)).cast("long").alias("n_dropped"), F.array_join(F.transform(k, lambda i: F.get(here, i)), "\n").alias("_new"),
        ))

    none = F.struct(F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.lit(None).cast("string").alias("_new"))
    # a generator keeps later filters and projections from evaluating all this again
    out = joined.select("*", F.inline(F.array(F.when(F.col(text).isNotNull(), let(lines, judged)).otherwise(none))))
    out = out.withColumn("dropped_chars", F.coalesce(F.char_length(text) - F.char_length("_new"), F.lit(0)).cast("long"))
    return out.withColumn(text, F.col("_new")).drop("_new", "_gone")
