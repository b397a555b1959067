"""Near-duplicates by shingle sets against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import shingle_sets

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _brute(texts, width, least):
    """The smallest id of each text's component, over all pairs."""
    sets = {}
    for i, t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9 and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def _texts():
    """Families of copies with more and more changed words, one large family, texts of one passage, and short texts."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, out = [word() for _ in range(40)], []
    for size, copies, most in [(200, 5, 1), (200, 5, 6), (500, 6, 12), (60, 5, 3), (30, 4, 1), (120, 70, 4)]:
        base = [word() for _ in range(size)]
        for _ in range(copies):
            new = list(base)
            for _ in range(rng.randint(0, most)):
                new[rng.randrange(size)] = word()
            out.append(" ".join(new))
    out += [" ".join([word() for _ in range(rng.randint(2, 12))] + passage + [word() for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    out += ["One two", "one  TWO", "one two three four five", "one two three four five six", "", " \n", "x"] + [" ".join(word() for _ in range(50)) for _ in range(20)]
    rng.shuffle(out)
    return list(enumerate(out)) + [(len(out), None)]


@pytest.mark.parametrize(("crowd", "rounds", "least", "width"), [(32, 4, 0.8, 5), (3, 1, 0.8, 5), (4, 3, 0.55, 3), (32, 0, 1.0, 5)])
def test_near_duplicates(spark, crowd, rounds, least, width):
    texts = _texts()
    found = shingle_sets.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"), width, least, crowd, 2, rounds).collect()
    assert {r.doc_id: r.component_id for r in found} == _brute(texts, width, least) and len(found) == len(texts)


def test_rows_without_ids(spark):
    rows = spark.createDataFrame([(None, "a b"), (3, "c d"), (None, "c d"), (3, "c d")], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in shingle_sets.near_duplicates(rows).collect()) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert shingle_sets.near_duplicates(rows.filter("false")).count() == 0


def test_pipeline_near_dedup(spark):
    """The stage keeps the smallest id of each group that brute force finds."""
    import corpus_pipeline

    texts = _texts()
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted(set(_brute(texts, 5, 0.8).values()))


def test_pipeline_rows_of_one_id(spark):
    """Rows are matched whole: a copy under an id that another text keeps goes; of equal rows one stays."""
    import corpus_pipeline

    x, y = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    rows = [(0, x), (1, y), (1, x), (2, "a b c d e f g"), (2, "a b c d e f g"), (None, x), (None, "q r s t u v")]
    docs = spark.createDataFrame([(i, t, "en", None, None, "clash") for i, t in rows], KIND + ", row string")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(((str(r.doc_id), r.text) for r in kept)) == sorted([("0", x), ("1", y), ("2", "a b c d e f g"), ("None", "q r s t u v")])
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0
