"""Findings of reviews, each with the case that failed."""

import json
import os
import tempfile
from collections import Counter

import duckdb
import numpy as np

from pyspark.sql import functions as F

from tallyloom.functions import texts
from tallyloom.llm import shingle_sets
from tallyloom.operators import charts, commands, numeric, rules
from tallyloom.plans import registry
from tallyloom.sources import bundles, recognition
from test_queries import rows


def test_template_distances_in_tiles(spark, monkeypatch):
    """F2 to F8: whole matrices a pair of blocks, whatever the tiles; rows of one id are never compared."""
    random = np.random.default_rng(1)
    x, ids, labels = random.normal(size=(70, 5)).astype(np.float32).astype(float), np.r_[np.arange(66), [3, 4, 5, 6]], random.integers(0, 4, 70) * 3
    wanted = {}
    for i, a in zip(ids, x):
        for j, b, label in zip(ids, x, labels):
            if i != j:
                key = int(i), int(label)
                wanted[key] = min(wanted.get(key, np.inf), round(sum(abs(a - b)) / 5, 9))
    monkeypatch.setattr(numeric, "TILE", (7, 11))
    numbers, at = np.unique(labels, return_inverse=True)
    best = numeric.least_errors(x, x, ids, ids, at, len(numbers))
    assert {(int(i), int(n)): min(best[ids == i, k]) for i in ids for k, n in enumerate(numbers)} == wanted
    rows = spark.createDataFrame([(int(i), int(n), [float(v) for v in a]) for i, n, a in zip(ids, labels, x)], "vec_id bigint, label int, embedding array<float>")
    for block in (16, 4096):
        assert {(r.vec_id, r.label): r.error for r in numeric.template_distances(rows, rows, block).collect()} == wanted


def _same(spark, name: str, folder: str) -> None:
    tables = duckdb.connect()
    for table in os.listdir(folder):
        tables.execute(f"create view {table[:-8]} as select * from '{folder}/{table}'")
    assert rows(registry.queries()[name](spark, folder).toPandas()) == rows(tables.execute(registry.oracle_sql()[name]).df())


def test_confirmed_patterns_without_lines(spark):
    """patterns whose lines are all off the catalogue ask for no confirmation; sf0.001 has none."""
    _same(spark, "confirmed_patterns", "/root/testdata/sf0.01")


def test_all_voids_of_a_ledger_move(spark):
    """every void that fits after those before it adds its lines, not one a ledger; a refused one adds nothing."""
    requests = spark.createDataFrame([(1, 1, 10), (2, 2, 11), (3, 3, 10), (4, 4, 12), (5, 5, 13), (6, 6, 14), (7, 7, 99), (8, 8, 15)], "request bigint, seq bigint, make_id bigint")
    makes = spark.createDataFrame([(10, 1, False), (11, 1, False), (12, 1, False), (13, 1, True), (14, 2, False), (15, 1, False)], "make_id bigint, ledger_id bigint, voided boolean")
    lines = spark.createDataFrame([(10, "A1", 6), (10, "A2", 1), (11, "A1", 6), (11, "A2", 5), (12, "A1", 4), (13, "A2", 9), (14, "A2", 2), (15, "A2", 7), (15, "A2", 1)], "make_id bigint, code string, qty bigint")
    stock = spark.createDataFrame([(1, "A1", 999_999_990), (1, "A2", 3)], "ledger_id bigint, code string, qty bigint")
    going = commands.settled_voids(requests, makes, lines, stock)
    assert sorted((r.request, r.goes) for r in going.collect()) == [(1, True), (2, False), (4, True), (6, True), (8, True)]
    moved = commands.void_moves(going, makes, lines, stock).collect()
    assert sorted(map(tuple, moved)) == [(1, "A1", 10, 1_000_000_000), (1, "A2", 9, 12), (2, "A2", 2, 2)]


def test_best_variants_of_equal_value(spark):
    """rows of equal value and id have one winner, whatever their order."""
    tied = [(1, 6, d, 0.5, 1.0, True) for d in ("A2", None, "A1")] + [(2, 1, d, 0.5, 1.0, True) for d in ("A2", "A1")]
    for order in (tied, tied[::-1]):
        found = numeric.best_variants(spark.createDataFrame(order, "field bigint, id bigint, decoded string, score double, coverage double, tiny boolean").coalesce(1)).collect()
        assert {r.field: r.decoded for r in found} == {1: None, 2: "A1"}


def test_frequent_members_are_counted_in_all_texts(spark, monkeypatch):
    """counts come from every text, also where a sample would leave most of them out."""
    monkeypatch.setattr(shingle_sets, "OFTEN", 100)
    monkeypatch.setattr(shingle_sets, "CHUNK", 300)
    monkeypatch.setattr(shingle_sets, "TEXTS", 60)
    texts = [f"all of these have a first part {'and some have this second one' if i % 10 == 0 else i} {'but only few texts have a third' if i < 23 else ''} x{i} y{i} z{i}" for i in range(300)]
    wanted = Counter(int(m) for t in texts for m in shingle_sets.shingle_set(t, 3))
    members, often = shingle_sets.frequent_members(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7), 3)
    assert dict(zip(members.tolist(), often.tolist())) == {m: c for m, c in wanted.items() if c >= 24}
    assert len(shingle_sets.frequent_members(spark.createDataFrame([], "text string"), 3)[0]) == 0


def test_bundles_are_read_once(spark):
    """no plan reads the document again for the checks on its parts."""
    rows = spark.createDataFrame([('{"format_version": 2, "ledger_id": 1}',), ("{",)], "json string")
    read = bundles.migrated(bundles.parsed(rows))
    assert read._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 0
    assert sorted(r.error for r in bundles.parsed(rows).collect()) == ["invalid-backup", "invalid-backup"]


def test_template_distances_by_rounded_entries(spark, monkeypatch):
    """Nearly all pairs are ruled out in whole numbers, and the rest gives the same errors to the last digit; odd blocks are measured whole."""
    random = np.random.default_rng(2)
    measured = []
    monkeypatch.setattr(numeric, "_exact_sums", lambda *a, exact=numeric._exact_sums: measured.append(1) or exact(*a))
    ids, labels = np.arange(300), random.integers(0, 5, 300)
    even, far, equal, one = random.normal(size=(300, 64)), random.normal(size=(300, 64)), np.ones((300, 64)), random.normal(size=(300, 64))
    far[7, 3] = 1e7
    for x, own, whole in ((even, ids, 0), (far, ids, 1), (equal, ids, 1), (one, ids * 0, 0)):
        order = np.argsort(labels, kind="stable")
        wanted = (numeric._exact_sums.__kwdefaults__["exact"](x, x[order], own, own[order], labels[order], 5) / 64).round(9)
        measured.clear()
        assert np.array_equal(numeric.least_errors(x, x, own, own, labels, 5), wanted)
        assert bool(measured) == bool(whole)


def test_few_proposals_for_frequent_members(spark, monkeypatch):
    """pipeline: what tasks propose grows with the texts, and near copies within one task don't stay in the filter."""
    monkeypatch.setattr(shingle_sets, "OFTEN", 100)
    monkeypatch.setattr(shingle_sets, "TEXTS", 100)
    monkeypatch.setattr(shingle_sets, "CHUNK", 300)
    texts = [f"all of these have one first part {i // 6} close copies of six {i // 6} stand side by side {i // 6} {i}" for i in range(1200)]
    wanted = Counter(int(m) for t in texts for m in shingle_sets.shingle_set(t, 3))
    kept = []
    plain = shingle_sets.np.zeros
    monkeypatch.setattr(shingle_sets.np, "zeros", lambda *a, **k: kept.append(plain(*a, **k)) or kept[-1])
    for most in (200_000, 40):  # a task's texts are counted at once or in parts
        monkeypatch.setattr(shingle_sets, "MOST_TEXTS", most)
        kept.clear()
        members, often = shingle_sets.frequent_members(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).repartitionByRange(12, "text"), 3)
        assert dict(zip(members.tolist(), often.tolist())) == {m: c for m, c in wanted.items() if c >= 96}
        bits = sum(int(w).bit_count() for w in kept[0].astype(np.uint64)[kept[0] != 0])
        assert len(members) <= bits < 10 * len(members)


def test_lattices_at_once(spark):
    """groups of places folded together find what pairs of places one by one do, ties and copies included."""
    random = np.random.default_rng(3)
    groups = [random.integers(0, 800, random.integers(1, 30)) * 1000 for _ in range(60)] + [np.r_[np.arange(12) * 20_000 + random.integers(0, 900, 12), 5000] for _ in range(20)] + [np.full(9, 7000), np.arange(8) * 30_000]
    length = np.full(len(groups), 800_000)
    wanted = {}
    for g, p in enumerate(groups):
        apart = np.diff(np.sort(p))
        tenths = {int((2 * d + 100 * k) // (200 * k)) for d in apart[apart > 0] for k in (1, 2, 3, 4)}
        found = []
        for step in (100 * s for s in tenths if 60 <= s < 2000):
            off = abs(p[:, None] - p) % step
            n = (np.minimum(off, step - off) < max(1800, step // 25)).sum(1)
            found += [(-int(m) ** 2 * step, step, int(q)) for q, m in zip(p, n) if m * 10 >= len(p) * 8]
        if found:
            wanted[g] = min(found)[1:]
    sizes = np.array([len(p) for p in groups])
    at, step, p0 = numeric.best_phases(np.concatenate(groups), sizes, length, sizes)
    assert {int(g): (int(s), int(q)) for g, s, q in zip(at, step, p0)} == wanted and len(wanted) > 20
    assert [len(x) for x in numeric.best_phases(np.array([], np.int64), np.array([], np.int64), length[:0], sizes[:0])] == [0, 0, 0]


def test_few_boxes_meet_without_grids(spark, monkeypatch):
    """images of few boxes take one join, crowded ones grids, with the same pairs; boxes without area meet none."""
    random = np.random.default_rng(4)
    boxes = [(int(i), n, int(x), int(y), int(w), int(h)) for i, size in ((1, 5), (2, 90), (3, 64)) for n, (x, y, w, h) in enumerate(random.integers(0, 30, (size, 4)))]
    rows = spark.createDataFrame(boxes, "image_id bigint, id bigint, x bigint, y bigint, w bigint, h bigint")
    wanted = {(a[0], a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and all(min(a[k] + a[k + 2], b[k] + b[k + 2]) > max(a[k], b[k]) and a[k + 2] and b[k + 2] for k in (2, 3))}
    gridded = []
    plain = charts._meeting_on_grids
    monkeypatch.setattr(charts, "_meeting_on_grids", lambda *a: gridded.append(1) or plain(*a))
    for few, grids in ((64, 1), (1000, 0), (0, 1)):
        gridded.clear()
        got = [(r.l.image_id, r.l.id, r.r.id) for r in charts.meeting_boxes(rows, rows, ["image_id"], few).collect()]
        assert set(got) == wanted and len(got) == len(wanted) and len(gridded) == grids


def test_texts_are_parsed_once(spark):
    """F16: the plan holds each extraction of a legend text once."""
    read = spark.sql("select 'A1(007)' as text").select(texts.legend_text(F.col("text")).alias("t")).select("t.code", "t.value", "t.reason")
    assert read._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 2
    rows = spark.createDataFrame([(t,) for t in ("A1(007)", "A1()", "A1(-3)", "A1(1.5)", "A1(2000000000)", "A1(x)", "?", None)], "text string")
    assert [tuple(r.t) for r in rows.select(texts.legend_text(F.col("text")).alias("t")).collect()] == [("A1", 7, None), ("A1", None, "empty"), ("A1", None, "negative"), ("A1", None, "decimal"), ("A1", None, "overflow"), ("A1", None, "invalid"), (None, None, "invalid"), (None, None, "empty")]


def test_usage_rules_in_one_pass(spark):
    """equal rows each count, and lines and versions are grouped once for all their checks."""
    colours = spark.createDataFrame([("A1",), ("A2",)], "code string")
    lines = spark.createDataFrame([(1, "A1", 5), (1, "A1", -1), (1, "Z9", None), (2, "Z9", 1), (2, "Z9", 1), (2, "A2", 3), (3, None, 2)], "pattern_id bigint, code string, qty bigint")
    found = rules.usage(lines, colours, ["pattern_id"])
    assert Counter((r.key, r.detail) for r in found.collect()) == {("1/A1", "quantity out of range"): 1, ("1/A1", "repeated code"): 1, ("1/Z9", "not in the catalogue"): 1, ("1/Z9", "quantity out of range"): 1, ("2/Z9", "not in the catalogue"): 2, ("2/Z9", "repeated code"): 1, ("3", "not in the catalogue"): 1}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 2
    headers = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 0), (3, None)], "pattern_id bigint, version bigint")
    owners = spark.createDataFrame([(1, 1), (2, 7), (3, None)], "pattern_id bigint, confirmed_version bigint")
    assert Counter((r.key, r.detail) for r in rules.versions(headers, owners).collect()) == {("1/1", "version repeated"): 1, ("2", "version number"): 2, ("2/0", "version repeated"): 1, ("3", "version number"): 1, ("2/7", "current version missing"): 1}


def test_recognitions_are_read_once(spark):
    """a document's fields are taken in one pass, and types and regions are evaluated once each; odd types are refused or left out as before."""
    texts = [f'{{"status":"ready","algorithm":"1","source":"legend","candidates":[{{"code":"A1","quantity":{q},"evidenceIds":["e",5]}}],"evidence":[{{"id":"e","rawText":7,"region":{region}}},4],"doubts":[{{"evidenceIds":["x","e"]}},3],"titleTotal":null,"image":{{"width":10,"height":20}}}}' for q, region in (("2.0", "[0,0,5.5,5]"), (2, '["0","0","5","5"]'), (2, "[0,0,12,5]"), ('"2"', "[0,0,5,5]"))]
    got = recognition.accepted_results(spark.createDataFrame(list(enumerate(texts)), "id int, json string").coalesce(1), spark.createDataFrame([("A1",)], "code string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 3 and plan.count("try_variant_get") <= 40  # 45 and 139 before
    rows = got.orderBy("id").collect()
    assert [r.error for r in rows] == [None, None, None, "invalid-candidate"]
    assert [[e.region for e in r.evidence] for r in rows[:3]] == [[[0, 0, 5.5, 5], None], [None, None], [None, None]]
    assert [(e.id, e.raw, e.codes) for e in rows[0].evidence] == [("e", "7", ["A1"]), (None, "", [])]
    assert [(r.id, r.raw, r.region) for r in rows[0].risks] == [("coverage", "", None), ("risk-0", "7", [0, 0, 5.5, 5]), ("risk-1", "", None)]


def test_pieces_are_found_without_joins(spark):
    """what is named is found in one window, so nothing is dealt again that lies by image; equal candidates, empty lists, nulls and pieces of others included."""
    candidates = [(1, "A1", "grid", ["a", "b", "c", "b"], 1), (1, "A1", "grid", ["d", "a"], 2), (1, "A2", "legend", ["c", "e", None], 3), (1, "A3", None, ["f", "g"], 4), (1, "A4", "grid", [], 5), (1, "A5", "grid", None, 6), (1, None, "grid", ["h"], 7), (None, "A1", "grid", ["a", "b"], 8), (2, "A1", "grid", ["x", "a", "y"], 9)]
    evidence = [(1, i, source) for i in ("a", "b", "d", "f", "q", None) for source in ("grid", "legend", None)] + [(None, "a", "grid"), (2, "a", "grid"), (2, "y", "grid"), (2, "y", "grid")]
    doubts = [(1, "b", None), (2, None, ["y", "z", None]), (None, "b", ["a"]), (2, None, None)]
    used = {(1, i) for i in "aebcdfgh"} | {(2, "x"), (2, "y"), (2, "z")}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    short, kept = charts.compact_results(frame(candidates, "image_id bigint, code string, source string, evidence_ids array<string>, n int"), frame(evidence, "image_id bigint, id string, source string"), frame(doubts, "image_id bigint, evidence_id string, evidence_ids array<string>"))
    pieces = lambda image, code: sorted((p, i) for im, co, _, ids, _ in candidates for p, i in enumerate(ids or []) if (im, co) == (image, code) and code and i and (image, i) in used)
    assert sorted((r.n, r.image_id, r.code, r.source, r.evidence_ids) for r in short.collect()) == sorted(((n, image, code, source, [i for _, i in pieces(image, code)]) for image, code, source, _, n in candidates), key=lambda r: r[0])
    assert Counter(map(tuple, kept.collect())) == Counter((image, i, source) for image, i, source in evidence if (source and source != "grid") or (image and i and (image, i) in used))
    for rows in (short, kept):
        assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()


def _written(rows):
    return {(r.ledger_id, r.part): (r.n, r.total) for r in rows.collect()}


def test_bundles_in_pieces(spark, monkeypatch):
    """a ledger is gathered a piece at a time, and none is left out that one document couldn't hold."""
    wanted = duckdb.connect()
    for table in os.listdir("/root/testdata/sf0.001"):
        wanted.execute(f"create view {table[:-8]} as select * from '/root/testdata/sf0.001/{table}'")
    monkeypatch.setattr(bundles.export_bundles, "__defaults__", (20,))
    monkeypatch.setattr(bundles, "PIECE_ROWS", 100, raising=False)
    assert rows(registry.queries()["bundle_round_trip"](spark, "/root/testdata/sf0.001").toPandas()) == rows(wanted.execute(registry.oracle_sql()["bundle_round_trip"]).df())


def _pieces(spark, size: int):
    """Pieces, as dictionaries, of a ledger of 50 stock rows and patterns, each with a version and a make, and of one with nothing but a head."""
    heads = spark.createDataFrame([(1, 0, 7, 10), (2, 0, 7, 10)], "ledger_id bigint, epoch bigint, seq bigint, low_stock_percent bigint")
    each = spark.range(50).selectExpr("1L as ledger_id", "concat('A', id + 1) as code", "cast(id as string) as pattern_id", "id", "array(struct('A1' as code, id as qty)) as lines")
    parts = {
        "stock": each.selectExpr("ledger_id", "code", "id as qty", "true as estimated", "null as baseline", "true as entered"), "patterns": each.selectExpr("ledger_id", "pattern_id", "'n' as name", "'' as source_note", "'' as size_note", "1 as confirmed_version", "null as archived_at", "struct('image/png' as mime, 'QUJD' as base64) as thumbnail"),
        "operations": each.selectExpr("ledger_id", "id as seq", "'count' as op_type", "'t' as at", "'r' as request_id", "null as pattern_id", "null as make_id", "'' as reason"), "movements": each.selectExpr("ledger_id", "1L as seq", "'A1' as code", "0L as qty_before", "1L as qty_after", "1L as delta"),
        "usages": each.selectExpr("ledger_id", "pattern_id", "1 as version", "lines", "'manual' as input_method", "null as title_total", "null as recognition"), "makes": each.selectExpr("ledger_id", "concat('m', id) as make_id", "pattern_id", "1 as version", "lines", "false as voided", "'r' as request_id"),
        "requests": each.selectExpr("ledger_id", "code as request_id", "'p' as payload", "'ok' as result"),
    }
    return parts, [json.loads(r.json) for r in bundles.export_pieces(heads, parts, "now", size).collect()]


def test_pieces_are_judged_together(spark):
    """pieces hold every row once, and what spoils a document spoils a ledger across its pieces."""
    parts, pieces = _pieces(spark, 20)
    palette = spark.range(50).selectExpr("concat('A', id + 1) as code")
    read = lambda docs, known=None: bundles.read_pieces(spark.createDataFrame([(json.dumps(d),) for d in docs], "json string"), known)
    errors = lambda docs, known=None: {r.ledger_id: r.error for r in read(docs, known)[1].collect()}
    assert len(pieces) == 19 and {p["pieces"] for p in pieces if p["ledger_id"] == 1} == {18} and max(len(p["stock"]) + len(p["makes"]) for p in pieces) < 50
    again = bundles.split(bundles.migrated(read(pieces)[0]))
    for name in bundles.PARTS:
        assert sorted(str(r.asDict(True)) for r in again[name].collect()) == sorted(str(r.asDict(True)) for r in parts[name].collect()), name
    own = [p for p in pieces if p["ledger_id"] == 1]
    assert errors(own, palette) == {1: None} and errors(pieces) == {1: None, 2: None} and errors(pieces, palette) == {1: None, 2: "invalid-backup"}
    at = lambda part: next(i for i, p in enumerate(own) if p[part])
    other = lambda i, **fields: [p | fields if j == i else p for j, p in enumerate(own)]
    away = lambda part: (at(part) + 1) % len(own)
    twice = lambda part: other(away(part), **{part: own[away(part)][part] + own[at(part)][part][:1]})
    bad = [own[1:], own + own[:1], own[1:] + own[1:2], other(0, epoch=5), other(0, pieces=17), other(0, format_version=1, requests=None), other(at("patterns"), patterns=[]), other(at("stock"), stock=[]), *[twice(part) for part in bundles.NAMES]]
    faults = [d | {"ledger_id": i} for i, docs in enumerate(bad) for d in docs]
    assert errors(faults, palette) == {i: "invalid-backup" for i in range(len(bad))}
    assert errors(other(0, format_version=99))[1] == "unsupported-backup" and errors([*own, {"ledger_id": None}])[None] == "invalid-backup"
    whole = {k: v for k, v in _pieces(spark, 1000)[1][0].items() if k not in ("piece", "pieces")}
    assert set(errors([whole]).values()) == {None}


def test_charts_of_many_boxes(spark, monkeypatch):
    """charts over 256 boxes are merged and doubted like others; before, they were left out."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for table in os.listdir("/root/testdata/sf0.001"):
        one = f"'/root/testdata/sf0.001/{table}'"
        duckdb.sql(f"copy (from {one}) to '{folder}/{table}' (format parquet)" if table != "orders.parquet" else f"copy (select * replace (o_custkey % 3 as o_custkey) from {one}) to '{folder}/{table}' (format parquet)")
    for gathered in (256, 40):
        monkeypatch.setattr(charts, "GATHERED", gathered, raising=False)
        for name in ("reading_doubts", "merged_repeats"):
            _same(spark, name, folder)


def test_streamed_places(spark, monkeypatch):
    """groups that are streamed keep the same boxes as gathered ones, odd boxes and several batches included."""
    random = np.random.default_rng(3)
    boxes = []
    for group, (n, odd) in enumerate(((900, 0), (400, 1), (400, 2), (300, 3), (30, 3))):
        for i in range(n):
            box = [int(v) for v in (*random.integers(-30, 300, 2), *random.integers(1, random.choice([4, 20, 150]), 2))]
            if odd and random.random() < 0.05:
                box[random.integers(2, 4)] = 0
            if odd > 1 and i > 200 and random.random() < 0.02:
                box[random.integers(2, 4)] *= -1
            if odd > 2 and random.random() < 0.1:
                box = [None if random.random() < 0.5 else v for v in box]
            boxes.append((group if odd != 1 else None, f"A{i % 2}", 1, i - i % 2, *box, i))
    frame = spark.createDataFrame(boxes, "image_id bigint, code string, qty bigint, id bigint, x bigint, y bigint, w bigint, h bigint, other bigint").repartition(3)
    found = []
    for gathered in (100_000, 10):
        monkeypatch.setattr(charts, "GATHERED", gathered)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
        found.append(sorted(map(str, charts.merge_repeats(frame, 2).collect())))
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and 100 < len(found[0]) < len(boxes)
    assert charts.near_identical(frame.filter("image_id = 0")).count() == 0  # O7 holds there


def test_places_of_one_large_chart(spark):
    """40 000 boxes of one chart, code and quantity, first wins; an image's boxes needn't fit one row."""
    boxes = spark.range(40_000).selectExpr("1L as image_id", "id", "'A1' as code", "1L as qty", "(id div 2 % 200) * 12 as x", "(id div 400) * 12 as y", "10L as w", "10L as h")
    assert charts.merge_repeats(boxes, 2).filter("repeated and id % 2 = 0").count() == 20_000
