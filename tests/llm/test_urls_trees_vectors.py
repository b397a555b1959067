"""URL trees, Merkle windows and whitening against plain versions."""

import hashlib
import math
import random
import zlib
from unittest.mock import patch

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import merkle_windows, url_trees, whitening

DOC = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, grp int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, fan):
    """Root, and for each leaf its steps of (left, right)."""
    paths, level, owners = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(level) > 1:
        ups, up_owners = [], []
        for start in range(0, len(level), fan):
            run = level[start : start + fan]
            for k in range(len(run)):
                for i in owners[start + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            ups.append(sha("".join(run)))
            up_owners.append([i for own in owners[start : start + fan] for i in own])
        level, owners = ups, up_owners
    return level[0], paths


def plain_manifest(docs, fan):
    groups = {}
    for row in docs:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(*row[:5]), row))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fan) for g in langs}
    root, upper = tree([made[g][0] for g in langs], fan)
    out = []
    for g, up in zip(langs, upper):
        for (_, _, h, row), low in zip(sorted(groups[g], key=lambda x: x[:3]), made[g][1]):
            hit = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf(*row[:3], row[3] + 1, row[4]) if hit else h
            for left, right in low + up:
                node = sha(left + node + right)
            out.append((row[0], h, made[g][0], root, sha("".join(a + b for a, b in low + up)), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "fan", "levels"), [(1, 2, 10), (2, 2, 1), (83, 2, 3), (140, 3, 2), (64, 2, 10), (65, 5, 1)])
def test_manifest_is_the_plain_tree(spark, n, fan, levels):
    rng = random.Random(n)
    docs = [(rng.choice([None, *range(n)]), rng.choice([None, "a", ""]), rng.choice([None, "de", "é", "en", "en", "en"]), rng.choice([None, 0, 2**63 - 1, 7]), rng.choice([None, "", "x" * 5000, "ü\n"]), "clash", 1) for _ in range(n)]
    docs += docs[:2]  # repeated rows
    got = merkle_windows.verified(merkle_windows.manifest(spark.createDataFrame(docs, DOC), fan, levels))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(docs, fan)


def test_manifest_of_no_rows_and_of_a_very_long_text(spark):
    assert merkle_windows.verified(merkle_windows.manifest(spark.createDataFrame([], DOC))).collect() == []
    docs = [(5, None, "en", 1, "ab " * 1_000_000, None, None)]
    assert sorted(map(tuple, merkle_windows.verified(merkle_windows.manifest(spark.createDataFrame(docs, DOC))).collect()), key=repr) == plain_manifest(docs, 2)


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(i, "s", "en", 3, "abc", None, None) for i in range(100)], DOC)
    hit = {i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0}
    got = merkle_windows.verified(merkle_windows.manifest(docs)).collect()
    assert {r["doc_id"] for r in got if not r["verified"]} == hit


def plain_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, dtype=float)).astype(np.int64) + 100_000
    n, s = len(x), [int(v) for v in x.sum(0)]
    c = x - x.mean(0)
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x], c @ u / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("d", [1, 2, 9, 24])
def test_whitening_is_that_of_a_plain_decomposition(spark, d):
    rng = np.random.default_rng(d)
    good = rng.normal(size=(80, d)) @ rng.normal(size=(d, d)) / 8
    good[50:] = good[49]  # a third of the rows have one vector
    rows = [(i % 60, [float(a) for a in v], "x", 1) for i, v in enumerate(good)]  # repeated ids
    bad = [(100, None, "", 0), (101, [float("nan")] * d, "", 0), (102, [None] * d, "", 0), (103, [float("inf")] * d, "", 0), (104, [1.0] * (d + 1), "", 0), (105, [], "", 0)]
    got = whitening.whiten(spark.createDataFrame(rows + bad, "vec_id int, embedding array<double>, deviation string, n int"))
    n, deviation, white, explained = plain_whitening(good)
    found = got.collect()
    assert len(found) == len(good) * min(8, d) and {r["n"] for r in found} == {n}
    assert max(r["identity_error"] for r in found) < 1e-9
    for j in range(min(8, d)):
        own = sorted((r["vec_id"], int(r["deviation"]), r["whitened"], r["explained"]) for r in found if r["component"] == j + 1)
        wanted = [sorted((i % 60, deviation[i], s * white[i, j]) for i in range(n)) for s in (1, -1)]
        close = [all(a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-8) for a, b in zip(own, w)) for w in wanted]
        assert any(close)
        assert all(math.isclose(r[3], explained[j], rel_tol=1e-9) for r in own)


def test_whitening_without_variance(spark):
    kind = "vec_id int, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), float(2 * i)]) for i in range(9)], kind)).collect()
    assert {r["component"] for r in flat} == {1}  # the other direction has no variance
    wide = whitening.whiten(spark.createDataFrame([(i, [i * 2.0**38, -i * 2.0**38]) for i in range(5)], "vec_id int, embedding array<double>")).collect()
    assert [int(r["deviation"]) for r in sorted(wide)] == [2 * (5 * 2**48 * (i - 2)) ** 2 for i in range(5)]


@pytest.mark.parametrize("case", ["random", "equal", "pairs", "blocks", "close", "rank one"])
def test_eigenvectors(case):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    values = {"random": np.sort(rng.uniform(1, 9, 40)), "equal": np.ones(40), "pairs": np.repeat(np.arange(20.0), 2), "close": 5 + 1e-10 * np.arange(40.0), "rank one": np.eye(40)[-1], "blocks": np.arange(40.0)}[case]
    v = np.diag(values) if case == "blocks" else (q * values) @ q.T
    v = (v + v.T) / 2
    e, u = whitening.leading(v, 8)
    size = np.abs(v).max()
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:8], atol=1e-13 * size * 40)
    assert np.allclose(u.T @ u, np.eye(8), atol=1e-12)
    assert np.abs(v @ u - u * e).max() < 1e-12 * size * 40


def test_sturm_counts():
    rng = np.random.default_rng(4)
    d, e = rng.normal(size=30), rng.normal(size=29)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.sort(rng.normal(size=50) * 3)
    assert list(whitening.sturm_counts(d, e, at)) == [int((values < x).sum()) for x in at]


URLS = [
    ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://a.b.Example.COM/en/1?q=/#x", "a.b.example.com", "/en/1", "example.com/en/", "block"),
    ("x://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://com?a=/en/", "com", "", None, None),
    ("http://q.net/es/9", "q.net", "/es/9", "net/es/", "block"),
    ("http://q.net/es", "q.net", "/es", None, None),
    ("http://net/fr/://x", "net", "/fr/://x", "net/fr/", "block"),
    ("nothing", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None),
    ("http://É.org\n/a b", "É.org\n", "/a b", None, None),
]


def test_rules_and_defined_urls(spark):
    rows = [(i, u, "clash", "clash") for i, (u, *_) in enumerate(URLS)] * 2
    got = url_trees.judge(spark.createDataFrame(rows, "page_id int, url string, rule string, features string")).collect()
    assert len(got) == len(rows)
    for r in got:
        _, host, path, rule, verdict = URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_urls_without_labels_or_rows(spark):
    kind = "page_id int, url string"
    assert url_trees.judge(spark.createDataFrame([], kind)).collect() == []
    assert [r["verdict"] for r in url_trees.judge(spark.createDataFrame([(1, "http://a.org/"), (2, None)], kind)).collect()] == ["allow", "allow"]
    only = spark.createDataFrame([(1, "http://a.org/"), (2, "http://a.net/es/")], kind)
    assert [r["verdict"] for r in url_trees.judge(only).collect()] == ["block", "block"]
    long = spark.createDataFrame([(1, "http://a.net/es/" + "x" * 3_000_000), (2, "http://b.com/"), (3, "http://c.org/?" + "a=1&" * 300_000)], kind)
    assert [r["verdict"] for r in url_trees.judge(long).collect()][:2] == ["block", "allow"]


def test_lexical_features():
    assert url_trees.lexical("aabb", "", "") == [4, 0, 0, 1.0, 0, 0, 0]
    assert url_trees.lexical("http://a.b-c.de/x/1?p=1&q#r?&", "a.b-c.de", "/x/1")[1:] == [2, 2 / 29, pytest.approx(url_trees.lexical("http://a.b-c.de/x/1?p=1&q#r?&", "", "")[3]), 2, 3, 1]
    assert url_trees.lexical("http://a.de/#?x", "a.de", "/")[4] == 0


def test_trees_learn_what_rules_say_of_other_urls(spark):
    """Rules of one kind of host are hidden from a tenth of the labelled URLs; the trees find them again."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    held = F.pmod(F.xxhash64("url"), F.lit(10)) == 0
    rows = url_trees.marked(pages, url_trees.RULES)
    wanted = {r["page_id"]: r["ruled"] for r in rows.filter(held & F.col("ruled").isNotNull()).select("page_id", "ruled").collect()}
    real = url_trees.marked

    def hidden(pages, rules, key):
        return real(pages, rules, key).withColumns({"ruled": F.when(~held, F.col("ruled")), "label": F.when(~held, F.col("label"))})

    with patch.object(url_trees, "marked", hidden):
        found = {r["page_id"]: r["verdict"] for r in url_trees.judge(pages).collect()}
    right = sum(found[k] == v for k, v in wanted.items())
    print("held-out accuracy", right / len(wanted), len(wanted))
    assert right / len(wanted) > 0.95


def test_statistics_leave_out_a_label(spark):
    rows = url_trees.marked(spark.createDataFrame([(1, "http://a.net/es/1"), (2, "http://a.net/es/2"), (3, "http://b.org/q")], "page_id int, url string"), url_trees.RULES)
    stats = url_trees.statistics(rows)
    assert stats[:, :, 0].sum() == 15 and stats[:, :, 1].sum() == 10 and stats[:, :, 2].sum() == 10
    shares = {r["page_id"]: r["features"][-5:] for r in url_trees.with_features(rows, stats).collect()}
    assert shares[1] == pytest.approx([(1 + 5 * 0.75) / 6] * 5) and shares[3] == pytest.approx([0.75] * 5)
