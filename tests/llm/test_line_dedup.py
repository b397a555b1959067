"""Line dedup against brute force, for one edit and more, with hot keys and rows without ids."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import line_dedup

DOCS = "doc_id bigint, text string, n_lines string"


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _earlier(a, b):
    return a is not None and (b is None or a < b)


def _brute(rows, least, exact, edits):
    seen = {}
    for d, t in rows:
        for line in t.split("\n") if t is not None else []:
            if line not in seen or _earlier(d, seen[line]):
                seen[line] = d
    near = {x for x in seen if len(x) >= least and any(len(y) >= least and _earlier(seen[y], seen[x]) and _distance(x, y) <= edits for y in seen)}
    out = []
    for d, t in rows:
        kept, had = [], set()
        for line in t.split("\n") if t is not None else []:
            if len(line) < exact or not (line in had or line in near or _earlier(seen[line], d)):
                kept.append(line)
            had.add(line)
        out.append((d, None if t is None else "\n".join(kept)))
    return out


def _rows():
    rng = random.Random(9)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(5, 14))) for _ in range(6)]

    def change(s):
        s = list(s)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            i = rng.randrange(len(s)) if s else 0
            s[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "é"])
        return "".join(s)

    rows = [(i, "\n".join(change(rng.choice(base)) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    return rows + [(None, "abc abc"), (None, "abc abc"), (None, None), (81, ""), (3, "abc abc\n\nabc abc\nb\nb"), (90, "b\n \n "), (None, "\n".join(base))]


@pytest.mark.parametrize(("crowd", "share", "edits", "exact"), [(64, 4096, 1, 1), (2, 4096, 1, 5), (2, 1, 1, 1), (2, 1, 2, 1), (64, 4096, 3, 2)])
def test_line_dedup(spark, crowd, share, edits, exact):
    """Pairs only; crowded half-lines found by key; frequent ones dealt apart; two and three edits."""
    rows = _rows()
    frame = spark.createDataFrame([(*r, "clash") for r in rows], DOCS)
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(frame, 5, crowd, share=share, edits=edits, min_exact=exact).collect()]
    assert sorted(got, key=str) == sorted(_brute(rows, 5, exact, edits), key=str)


def test_odd_tables(spark):
    frame = spark.createDataFrame([(1, "x", "clash")], DOCS)
    assert line_dedup.dedup_lines(frame.filter("false")).count() == 0
    with pytest.raises(ValueError, match="edits"):
        line_dedup.dedup_lines(frame, edits=5)


def test_within_edits(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
    pairs = spark.createDataFrame([(word(), word()) for _ in range(400)], "a string, b string")
    got = pairs.select("a", "b", *[line_dedup.within_edits(F.col("a"), F.col("b"), k).alias(f"k{k}") for k in (1, 2, 3, 4)]).collect()
    assert all(r[f"k{k}"] == (_distance(r.a, r.b) <= k) for r in got for k in (1, 2, 3, 4))


def test_crowd_without_ids(spark):
    """Half of the rows have no id: their lines are no single group."""
    rows = [(None if i % 2 else i, f"line number {i} of a longer text\nshared line of all texts here\n{i}") for i in range(400)]
    done = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert done.filter("doc_id is null").agg(F.sum("n_dropped")).first()[0] >= 200 and done.count() == 400
    own = spark.createDataFrame(rows, "doc_id bigint, text string").select(F.xxhash64("text").alias("row")).distinct().count()
    assert own == 400  # as many groups as texts
