"""The ordered fold, its stream, bundles, sinks and worked examples."""

import datetime
import json
import random
import statistics
import struct
import tempfile
import zlib

from pyspark.sql import functions as F

from tallyloom.functions.quantities import is_low, parse_quantity
from tallyloom.operators import charts, command_log, ledger, numeric, rules
from tallyloom.sources import bundles, files, images, recognition
from tallyloom.streaming import ledger_stream

LOG = "ledger_id bigint, seq bigint, request_id string, op_type string, lines array<struct<code:string,qty:bigint>>, payload string, make_id string"
BOTH = [("A1", 95), ("b01", 4), ("C1", 0)]
ROWS = [
    (1, 1, "a", "first-entry", [("a01", 100), ("B1", 5)], "p", None), (1, 2, "a", "first-entry", [("a01", 100), ("B1", 5)], "p", None), (1, 3, "a", "first-entry", [("a01", 90), ("B1", 5)], "p", None), (1, 4, "b", "first-entry", [("C1", 1), ("A1", 5)], "p", None),
    (1, 5, "c", "restock", [("B1", 50), ("A1", 80)], "p", None), (1, 6, "c", "restock", [("A1", 120)], "p", None), (1, 7, "d", "make", BOTH, "p", None), (1, 8, "e", "make", BOTH, "p", None),
    (1, 9, "f", "void-make", None, "p", "d"), (1, 10, "g", "void-make", None, "p", "d"), (1, 11, "h", "count", [("A1", 1), ("Z9", 1)], "p", None), (1, 12, "i", "count", [("A1", None)], "p", None),
    (1, 13, "j", "flag", [("A1", 120)], "p", None), (1, 14, "k", "flag", [("A1", 121)], "p", None), (2, 1, "a", "count", [("A1", 7)], "p", None), (2, 2, "b", "void-make", None, "p", "d"),
    (2, 3, "c", "make", [("A1", 7)], "p", None), (2, 4, "d", "count", [("A1", 1_000_000_000)], "p", None), (2, 5, "e", "void-make", None, "p", "c"), (2, 6, "f", "count", [("A1", 1), ("a1", 2)], "p", None),
]
WANTED = ["ok", "replay", "request-conflict", "already-entered", "restock-decrease", "ok", "ok", "insufficient", "ok", "already-voided", "unknown-color", "invalid-number", "noop", "flag-qty-changed", "ok", "missing-make", "ok", "ok", "invalid-number", "duplicate-color"]


def palette(spark):
    return spark.createDataFrame([("A1",), ("B1",), ("C1",)], "code string")


def test_fold(spark):
    got = command_log.fold_log(spark.createDataFrame(ROWS, LOG), palette(spark)).orderBy("ledger_id", "seq").collect()
    assert [r.result for r in got] == WANTED
    moved = {(r.ledger_id, r.seq): [tuple(m) for m in r.moves] for r in got}
    plain = {k: [m[:3] for m in v] for k, v in moved.items()}
    assert plain[1, 7] == [("A1", 120, 25), ("B1", 5, 1)] and plain[1, 9] == [("A1", 25, 120), ("B1", 1, 5)] and moved[1, 2] == moved[1, 1]
    assert [tuple(g) for g in got[7].gaps] == [("A1", 95, 25), ("B1", 4, 1)] and moved[1, 5] == []  # all colours or none
    assert [r.head_seq for r in got if r.ledger_id == 2] == [1, 1, 2, 3, 3, 3]


def _stream(spark, batches, schema):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(rows, name, mode="append", wait=60):
    query = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    query.awaitTermination(wait)
    query.stop()


def test_stream_equals_fold(spark):
    _run(ledger_stream.apply_stream(_stream(spark, (ROWS[:6], ROWS[6:8], ROWS[8:]), LOG), palette(spark)), "applied")
    fold = command_log.fold_log(spark.createDataFrame(ROWS, LOG), palette(spark))
    assert sorted(map(str, spark.table("applied").collect())) == sorted(map(str, fold.collect()))


def test_once_per_request(spark):
    """A repeat in a later batch is dropped as well."""
    kind = "ledger_id bigint, request_id string, at timestamp"
    at = datetime.datetime(2024, 1, 1)
    source = _stream(spark, ([(1, "a", at), (1, "a", at), (2, "a", at)], [(1, "a", at), (1, "b", at)]), kind)
    _run(ledger_stream.once_per_request(source), "once")
    assert sorted((r.ledger_id, r.request_id) for r in spark.table("once").collect()) == [(1, "a"), (1, "b"), (2, "a")]


def test_slow_requests_and_alerts(spark):
    """A result ends a request (T5); movements that leave a colour low are alerts."""
    source = _stream(spark, ([(1, "request"), (2, "request")], [(1, "result")]), "image_id bigint, kind string")
    _run(ledger_stream.slow_requests(source, 600), "slow", wait=20)  # its timeouts keep it going
    assert [tuple(r) for r in spark.table("slow").collect()] == [(1, "done")]
    moves = _stream(spark, ([(1, "A1", 10, 100), (1, "B1", 11, 100), (2, "A1", 20, 100)],), "ledger_id bigint, code string, qty_after bigint, baseline_after bigint")
    _run(ledger_stream.low_alerts(moves, spark.createDataFrame([(2, 20)], "ledger_id bigint, low_stock_percent bigint")), "alerts")
    assert sorted((r.ledger_id, r.code) for r in spark.table("alerts").collect()) == [(1, "A1"), (2, "A1")]


def test_low_stock_and_gaps(spark):
    low = spark.sql("select 100 as q, 1000 as b union all select 101, 1000 union all select 0, null").select(is_low(F.col("q"), F.col("b"), F.lit(10)).alias("low")).collect()
    assert [r.low for r in low] == [True, False, False]
    usage = spark.createDataFrame([(1, 1, "A1", 80), (1, 1, "B1", 15)], "pattern_id bigint, ledger_id bigint, code string, qty bigint")
    stock = spark.createDataFrame([(1, "A1", 100), (1, "B1", 10)], "ledger_id bigint, code string, qty bigint")
    one = ledger.gap_summary(ledger.gap_lines(usage, stock)).first()
    assert (one.total_demand, one.can_make, one.total_gap) == (95, False, 5)


def test_quantities(spark):
    cases = {"": "empty", "-1": "negative", "1.5": "decimal", "01": "invalid", "9999999999": "overflow", "x": "invalid", " 12 ": None, "0": None}
    got = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", parse_quantity(F.col("raw")).alias("p")).collect()
    assert {r.raw: r.p.reason for r in got} == cases


def _bundle(**other):
    row = {"code": "A1", "qty": 5, "estimated": True, "baseline": None, "entered": True}
    pattern = {"pattern_id": "p", "name": "n", "source_note": "", "size_note": None, "confirmed_version": 1, "archived_at": None, "thumbnail": {"mime": "image/png", "base64": "QUJD"}}
    usage = {"pattern_id": "p", "version": 1, "lines": [{"code": "A1", "qty": 1}], "input_method": "manual", "title_total": None, "recognition": None}
    make = {"make_id": "m", "pattern_id": "p", "version": 1, "lines": [{"code": "A1", "qty": 1}], "voided": False, "request_id": "r"}
    operation = {"seq": 1, "op_type": "count", "at": "t", "request_id": "r", "pattern_id": None, "make_id": None, "reason": ""}
    out = {"format_version": 2, "exported_at": "now", "ledger_id": 1, "epoch": 0, "seq": 3, "low_stock_percent": 10, "stock": [row, row | {"code": "B1"}, row | {"code": "C1"}], "operations": [operation], "movements": [], "patterns": [pattern], "usages": [usage], "makes": [make], "requests": []}
    return {k: v(out[k]) if callable(v) else v for k, v in (out | other).items()}


def test_bundles(spark):
    """Each fault of a header or an element refuses the bundle; format 1 is brought up to 2."""
    first = lambda **x: lambda rows: [rows[0] | x, *rows[1:]]
    line = [{"code": "Q9", "qty": 1}]
    bad = [
        {"exported_at": " "}, {"epoch": -1}, {"seq": 2**53}, {"low_stock_percent": 101}, {"makes": None}, {"stock": lambda rows: rows[1:]}, {"stock": first(code="B1")}, {"stock": first(qty=-1)}, {"stock": first(entered=None)}, {"stock": first(baseline=10**10)},
        {"operations": lambda rows: rows * 2}, {"operations": first(reason=None)}, {"operations": first(seq=-1)}, {"makes": lambda rows: rows * 2}, {"makes": first(lines=line)}, {"makes": first(pattern_id="q")}, {"makes": first(voided=None)},
        {"patterns": first(thumbnail=None)}, {"patterns": first(thumbnail={"mime": "image/gif", "base64": "QUJD"})}, {"patterns": first(thumbnail={"mime": "image/png", "base64": "/data/x"})}, {"patterns": first(archived_at=" ")}, {"patterns": lambda rows: rows * 2},
        {"usages": first(lines=None)}, {"usages": first(pattern_id="q")}, {"usages": first(version=None)}, {"usages": first(input_method="legend"), "format_version": 1}, {"operations": first(reason="keystore")}, {"ledger_id": None},
    ]
    old = _bundle(format_version=1, requests=None, ledger_id=2, patterns=first(archived_at="x", size_note=None))
    cases = [(json.dumps(_bundle()), None), (json.dumps(old), None), (json.dumps(_bundle(format_version=99)), "unsupported-backup"), (json.dumps(_bundle())[:60], "invalid-backup"), ("", "invalid-backup")] + [(json.dumps(_bundle(**x)), "invalid-backup") for x in bad]
    got = bundles.parsed(spark.createDataFrame([(text,) for text, _ in cases], "json string").coalesce(1), palette(spark)).select("error").collect()
    assert [r.error for r in got] == [error for _, error in cases]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, (text, _) in enumerate(cases[:4]):
        with open(f"{folder}/{i}.json", "w") as f:
            f.write(text)
    read = bundles.read_bundles(spark, folder, palette=palette(spark))
    assert sorted(str(r.error) for r in read.select("error").collect()) == ["None", "None", "invalid-backup", "unsupported-backup"]
    parts = bundles.split(bundles.migrated(read))
    assert parts["stock"].count() == 6 and parts["make_line"].count() == 2
    assert sorted((r.size_note, r.archived_at) for r in parts["patterns"].collect() if r.ledger_id == 2) == [("", None)]


def test_round_trip(spark):
    """What is exported is read back as it was; a ledger of too many rows is refused."""
    text = json.dumps(_bundle())
    read = bundles.split(bundles.migrated(bundles.parsed(spark.createDataFrame([(text,)], "json string"))))
    parts = {name: spark.createDataFrame(rows.collect(), rows.schema) for name, rows in read.items()}
    out = bundles.export_bundles(parts["head"], parts, "now")
    out = spark.createDataFrame(out.collect(), out.schema)
    again = bundles.split(bundles.migrated(bundles.parsed(out, palette(spark))))
    for name in bundles.PARTS:
        assert sorted(map(str, again[name].collect())) == sorted(map(str, parts[name].collect())), name
    assert [(r.json, r.error) for r in bundles.export_bundles(parts["head"], parts, "now", most_rows=2).collect()] == [(None, "too-large")]


def test_kept_boxes_only(spark):
    """A box close to a dropped one only is kept (J28), and the nearest number counts."""
    boxes = spark.createDataFrame([(1, 0, 0, 0, 9, 9), (1, 1, 3, 0, 9, 9), (1, 2, 6, 0, 9, 9)], "image_id bigint, id bigint, x int, y int, w int, h int")
    assert sorted(r.id for r in charts.near_identical(boxes).collect()) == [0, 2]
    marks = spark.createDataFrame([(1, 9, 0, 0, 10, 10)], boxes.schema)
    words = spark.createDataFrame([(1, 1, 14, 0, 9, 9), (1, 2, 11, 0, 9, 9)], boxes.schema)
    assert [r.number_id for r in charts.adjacent_numbers(marks, words).collect()] == [2]
    many = spark.range(300).selectExpr("1 as image_id", "id", "0 as x", "0 as y", "9 as w", "9 as h")
    assert charts.near_identical(many).count() == 0 and [r.key for r in rules.over_cap(many, ["image_id"], 256).collect()] == ["1"]


def test_lattice(spark):
    """A gap, a repeat, a stray and a jitter don't move the lattice; counts out of bounds and noise are said."""
    points = [("a", x) for x in (10, 30, 50, 51, 90, 110, 117, 130, 150, 170)] + [("b", x) for x in (1, 2)] + [("c", x) for x in (0, 7, 21, 49, 111, 240, 377)] + [("d", x) for x in range(0, 4000, 10)]
    got = {r.key: r for r in numeric.lattice(spark.createDataFrame([(k, x, 20 if k == "c" else 400) for k, x in points], "key string, pos int, length int")).collect()}
    assert {k: r.state for k, r in got.items()} == {"a": "fitted", "b": "too-few", "c": "no-lattice", "d": "too-many"}
    assert abs(got["a"].step - 20) < 0.3 and abs(got["a"].start - 10) < 1.5 and abs(got["a"].end - 170) < 1.5 and got["a"].share == 0.9


def test_lattice_edges(spark):
    """A rule before the first and up to two behind the last may be hidden by the edges of the axis."""
    points = [("a", 20 + 20 * i, 381) for i in range(17)] + [("b", 35.5 + 30 * i, 31 * 30) for i in range(28)]
    got = {r.key: (r.start, r.end, r.step, r.share) for r in numeric.lattice(spark.createDataFrame([(k, float(x), n) for k, x, n in points], "key string, pos double, length int")).collect()}
    assert got == {"a": (0.0, 380.0, 20.0, 1.0), "b": (35.5, 845.5, 30.0, 1.0)}


def test_meeting_boxes(spark):
    """Boxes of all sizes against all pairs; 40 000 boxes of one image meet their neighbours only."""
    rng = random.Random(2)
    rows = [(rng.randrange(2), i, rng.randrange(-300, 300), rng.randrange(-300, 300), rng.choice([0, 1, 3, 16, 17, 200]), rng.choice([1, 2, 8, 33, 500])) for i in range(300)]
    boxes = spark.createDataFrame(rows, "image_id bigint, id bigint, x int, y int, w int, h int")
    got = sorted((r.l.id, r.r.id) for r in charts.meeting_boxes(boxes, boxes, ["image_id"]).collect())
    side = lambda a, b, c, d: min(a[c] + a[d], b[c] + b[d]) > max(a[c], b[c])
    assert got == sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[4] and b[4] and side(a, b, 2, 4) and side(a, b, 3, 5))
    many = spark.range(40_000).selectExpr("1 as image_id", "id", "'A1' as code", "1 as qty", "cast(id % 200 * 10 as int) as x", "cast(id div 200 * 10 as int) as y", "case when id = 0 then 2000 else 12 end as w", "case when id = 0 then 2000 else 12 end as h")
    assert charts.shared_quantities(many).count() == 39_999  # all but the corner that the large one cuts
    assert charts.overlapping_pairs(many, 0).count() == 39_999 + 2 * 200 * 199 + 2 * 199 * 199 - 3


def test_exact_medians(spark):
    """Groups over the limit by counted ranges, without gathering them: ties, few values, far outliers, negative and even numbers of rows; nulls and NaN don't count."""
    rng = random.Random(4)
    groups = {"a": [rng.gauss(0, 1) for _ in range(3001)], "b": [5.0] * 2000, "c": [rng.choice([1.0, 2.0]) for _ in range(1000)], "d": [rng.random() * 10 ** rng.randint(-300, 300) for _ in range(2000)], "e": [1.0, 4.0], "f": [float(i) for i in range(1000)], "g": [-1e308, 1e308] * 500, "h": [7.0]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("a", None), ("a", float("nan")), ("z", None), (None, 1.0), (None, 3.0)]
    data = spark.createDataFrame(rows, "k string, value double").repartition(5)
    for most in (100, 10**6):
        got = {r.k: r.median for r in numeric.exact_medians(data, ["k"], "value", most).collect()}
        assert got == {k: statistics.median(v) for k, v in groups.items()} | {None: 2.0}
    assert numeric.exact_medians(data.limit(0), ["k"], "value").collect() == []


def test_doubts_take_their_evidence(spark):
    """The first piece of evidence that a doubt names, alone or in a list, gives its text and region where the doubt has none."""
    evidence = spark.createDataFrame([(1, "b", "second", [1, 2, 3, 4], 2), (1, "a", "first", [5, 6, 7, 8], 1), (1, "c", "third", None, 3), (2, "a", "else", [9, 9, 9, 9], 1)], "image_id int, id string, raw string, region array<int>, pos int")
    doubts = spark.createDataFrame([(1, "1", None, None, "b", ["a"]), (1, "2", "own", None, "c", None), (1, "3", None, [0, 0, 1, 1], None, ["c", "b"]), (1, "4", None, None, "none", []), (2, "1", None, None, "a", None)], "image_id int, id string, raw string, region array<int>, evidence_id string, evidence_ids array<string>")
    got = {(r.image_id, r.id): (r.raw, r.region) for r in charts.doubt_evidence(doubts, evidence).collect()}
    assert got == {(1, "1"): ("first", [5, 6, 7, 8]), (1, "2"): ("own", None), (1, "3"): ("second", [0, 0, 1, 1]), (1, "4"): ("", None), (2, "1"): ("else", [9, 9, 9, 9])}


def test_backgrounds_of_an_image(spark):
    """A background counts in its own image only."""
    cells = spark.createDataFrame([(1, 10, 10, 10), (2, 10, 10, 10), (3, 10, 10, 10)], "image_id int, r int, g int, b int")
    grounds = spark.createDataFrame([(1, 11, 9, 10), (1, 200, 0, 0), (2, 50, 50, 50)], cells.schema)
    swatches = spark.createDataFrame([("A1", 0, 0, 0)], "code string, r int, g int, b int")
    assert {r.image_id: r.kind for r in charts.exact_colours(cells, swatches, grounds).collect()} == {1: "blank", 2: "unknown", 3: "unknown"}


def test_recognition_boundary(spark):
    """Each fault has its own refusal, by type and by element; doubts inherit, and coverage stands first."""
    good = {"status": "partial", "algorithm": "a", "source": "grid", "candidates": [{"code": "A1", "quantity": 3, "evidenceIds": ["e1", "e2"]}, {"code": "B1", "quantity": 2.0}], "evidence": [{"id": "e1", "rawText": "A1", "region": [0, 0, 4, 4]}, {"id": "e2", "region": [0, 0, 40, 4]}], "doubts": [{"evidenceId": "e2"}, {"rawText": "own", "evidenceIds": ["q", "e1"], "region": [1, 1, 2, 2.5]}, {"reason": "r" * 2000}], "total": 5, "titleTotal": None, "image": {"width": 10, "height": 10}}
    one = lambda **x: [{"code": "A1", "quantity": 1} | x]
    bad = [
        ("invalid-format", {"status": "done"}), ("invalid-format", {"algorithm": 1}), ("invalid-format", {"algorithm": "a" * 101}), ("invalid-content", {"candidates": None}), ("invalid-content", {"evidence": {}}), ("invalid-content", {"doubts": [{}] * 513}), ("invalid-candidate", {"candidates": one(code="a1")}),
        ("invalid-candidate", {"candidates": one(quantity="1")}), ("invalid-candidate", {"candidates": one(quantity=1.5)}), ("invalid-candidate", {"candidates": one(quantity=-1)}), ("invalid-candidate", {"candidates": one(quantity=2**60)}), ("invalid-candidate", {"candidates": one() * 2}), ("invalid-candidate", {"candidates": [None]}),
        ("invalid-total", {"total": 6}), ("invalid-total", {"total": "5"}), ("inconsistent-status", {"source": None}), ("inconsistent-status", {"status": "failed"}), ("inconsistent-status", {"candidates": [], "total": None}), ("invalid-title", {"titleTotal": -1}), ("invalid-title", {"titleTotal": "4"}),
        ("invalid-size", {"image": {"width": -1, "height": 1}}), ("invalid-size", {"image": {"width": 8000, "height": 8000}}), ("missing-size", {"image": None}), ("too-many-doubts", {"doubts": [{}] * 512}), (None, {"status": "failed", "candidates": [], "source": None, "total": None, "image": None}), (None, {"total": None, "titleTotal": 7}),
    ]
    cases = [(None, json.dumps(good)), ("invalid-format", "{"), ("invalid-format", ""), ("invalid-format", None), ("invalid-format", "[1]"), *((error, json.dumps(good | x)) for error, x in bad), ("invalid-title", json.dumps({k: x for k, x in good.items() if k != "titleTotal"}))]
    got = recognition.accepted_results(spark.createDataFrame([(i, text, "clash") for i, (_, text) in enumerate(cases)], "id int, json string, lines string").drop("lines"), palette(spark)).orderBy("id").collect()
    assert [(r.id, r.error) for r in got] == [(i, error) for i, (error, _) in enumerate(cases)]
    first = got[0]
    assert [tuple(x) for x in first.lines] == [("A1", 3), ("B1", 2)] and [(e.id, e.raw, e.region, e.codes) for e in first.evidence] == [("e1", "A1", [0, 0, 4, 4], ["A1"]), ("e2", "", None, ["A1"])]
    assert [(r.id, r.raw, r.region) for r in first.risks] == [("coverage", "", None), ("risk-0", "", None), ("risk-1", "own", [1, 1, 2, 2.5]), ("risk-2", "", None)] and len(first.risks[3].reason) == 1000
    assert got[-2].risks[1].raw == "" and all(r.lines is None for r in got if r.error)


def test_files(spark):
    """Palettes (S6), results (S8) and references (S10) come as they were written; ids that stand twice are refused."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, rows in (("p", [{"code": "A1", "grp": "A", "r": 1, "g": 2, "b": 3}]), ("q", [{"id": "x", "status": "ok", "expected": {"A1": 2}}, {"id": "y"}, {"id": "y"}]), ("r", [{"status": "ready"}]), ("s", [{"status": "ready", "imageId": "i"}, {"status": "ready"}, {"status": "failed"}])):
        with open(f"{folder}/{name}.json", "w") as f:
            f.write("\n".join(map(json.dumps, rows)))
    assert [tuple(r) for r in files.read_palette(spark, f"{folder}/p.json").collect()] == [("A1", "A", 1, 2, 3)]
    good, twice = files.read_references(spark, f"{folder}/q.json")
    assert [tuple(r) for r in good.collect()] == [("x", "ok", "A1", 2)] and [tuple(r) for r in twice.collect()] == [("y", 2)]
    assert [(r.image_id, r.status) for r in files.read_results(spark, f"{folder}/r.json").collect()] == [("r.json", "ready")]
    several = files.read_results(spark, f"{folder}/s.json").collect()
    assert sorted((r.image_id, r.status) for r in several) == [("i", "ready"), ("s.json", "failed"), ("s.json", "ready")] and len({r.document for r in several}) == 3


def _png(*chunks):
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + b"".join(part(*c) for c in chunks)


def _webp(*chunks):
    body = b"WEBP" + b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


EXIF = b"MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0"


def _images():
    """Name, bytes, and what intake says of them: kind, width, height, refusal."""
    size = b"IHDR", struct.pack(">II", 30, 20) + b"\x08\x02\0\0\0"
    end, data = (b"IEND", b""), (b"IDAT", b"x" * 9)
    whole = _png(size, data, end)
    app, frame = b"\xff\xe1" + struct.pack(">H", len(EXIF) + 8) + b"Exif\0\0" + EXIF, b"\xff\xc0\0\x11\x08" + struct.pack(">HH", 40, 50) + b"\x03" + b"\0" * 9
    scan, eoi = b"\xff\xda\0\x03\0" + b"ab\xff\0c\xff\xd0d", b"\xff\xd9"
    jpeg = b"\xff\xd8" + app + frame + scan
    lossy = b"VP8 ", b"\x10\0\0\x9d\x01\x2a" + struct.pack("<HH", 7, 9) + b"z"
    lossless = b"VP8L", b"\x2f" + struct.pack("<I", 6 | 8 << 14)
    clear = b"VP8L", b"\x2f" + struct.pack("<I", 6 | 8 << 14 | 1 << 28)
    canvas = lambda flags, w=6, h=8: (b"VP8X", bytes([flags, 0, 0, 0]) + w.to_bytes(3, "little") + h.to_bytes(3, "little"))
    return [
        ("png", whole, "image/png", 30, 20, None), ("png-more", whole + b"tail", "image/png", 30, 20, None), ("png-cut", whole[:33], "image/png", None, None, "damaged"), ("png-turned", _png(size, (b"eXIf", EXIF), data, end), "image/png", 20, 30, None),
        ("png-moving", _png(size, (b"acTL", b"\0" * 8), data, end), "image/png", None, None, "animated"), ("png-bad", whole[:-20] + b"?" + whole[-19:], "image/png", None, None, "damaged"), ("png-twice", _png(size, size, data, end), "image/png", None, None, "damaged"),
        ("png-flat", _png((b"IHDR", struct.pack(">II", 0, 20) + b"\x08\x02\0\0\0"), end), "image/png", None, None, "damaged"), ("png-huge", _png((b"IHDR", struct.pack(">II", 8000, 5000) + b"\x08\x02\0\0\0"), end), "image/png", 8000, 5000, "too-many-pixels"),
        ("jpeg", jpeg + eoi, "image/jpeg", 40, 50, None), ("jpeg-cut", jpeg, "image/jpeg", None, None, "damaged"), ("jpeg-plain", b"\xff\xd8" + frame + scan + b"\xff" + eoi, "image/jpeg", 50, 40, None), ("jpeg-still", b"\xff\xd8" + frame + eoi, "image/jpeg", None, None, "damaged"),
        ("jpeg-frames", b"\xff\xd8" + frame + frame + scan + eoi, "image/jpeg", None, None, "damaged"), ("webp", _webp(lossy), "image/webp", 7, 9, None), ("webp-lossless", _webp(lossless), "image/webp", 7, 9, None), ("webp-cut", _webp(lossy)[:-2], "image/webp", None, None, "damaged"),
        ("webp-moving", _webp(canvas(2), lossy), "image/webp", None, None, "animated"), ("webp-frames", _webp(canvas(0), (b"ANIM", b"123456"), lossy), "image/webp", None, None, "animated"), ("webp-turned", _webp(canvas(8), lossy, (b"EXIF", EXIF)), "image/webp", 9, 7, None),
        ("webp-alpha", _webp(canvas(16), (b"ALPH", b"12"), lossy), "image/webp", 7, 9, None), ("webp-clear", _webp(canvas(16), clear), "image/webp", 7, 9, None), ("webp-unsaid", _webp(canvas(0), lossy, (b"EXIF", EXIF)), "image/webp", None, None, "damaged"), ("webp-other", _webp(canvas(0, 9, 9), lossy), "image/webp", None, None, "damaged"),
        ("webp-bare", _webp(lossy, (b"EXIF", EXIF)), "image/webp", None, None, "damaged"), ("text", b"no image", None, None, None, "unknown-kind"),
    ]


def test_images(spark):
    """Whole, turned, animated, truncated and damaged files of every kind."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, data, *_ in _images():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    got = {r.path.rsplit("/", 1)[1]: (r.mime, r.width, r.height, r.refused, r.accepted) for r in images.image_manifest(spark, folder).collect()}
    assert got == {name: (mime, width, height, refused, refused is None) for name, _, mime, width, height, refused in _images()}
    assert images.judged(b"")[4] == images.judged(None)[4] == "empty"  # the reader leaves empty files out
    data = {name: x for name, x, *_ in _images()}
    for name in ("png", "jpeg", "webp", "webp-turned"):  # no file that ends early is taken
        assert all(images.judged(data[name][:n])[4] for n in range(len(data[name])))


def test_evidence_csv(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/out"
    files.write_evidence([spark.sql("select 1 as a"), spark.sql("select 2 as b")], folder)
    assert sorted(spark.read.option("header", True).csv(folder).columns) == ["a", "b"]


def test_blocks_are_idempotent(spark):
    rows = spark.createDataFrame([(1, 1, "failed", 1), (1, 1, "read", 2), (1, 2, "failed", 1)], "image_id bigint, block_id bigint, status string, at bigint")
    later = spark.createDataFrame([(1, 2, "read", 3)], rows.schema)
    seen, folded = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(2))
    for batch, part in ((0, rows), (0, rows), (1, later), (0, rows)):  # batches are retried
        ledger_stream.fold_blocks(part, batch, seen)
    assert sorted((r.block_id, r.status) for r in ledger_stream.folded_blocks(spark, seen).collect()) == [(1, "read"), (2, "read")]
    ledger_stream.compact_blocks(spark, seen, folded)
    assert spark.read.parquet(folded).count() == 2 and spark.read.parquet(seen).count() == 3
