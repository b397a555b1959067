"""Logs of all kinds of commands: fold, fold in rounds and stream against a plain model of a ledger."""

import copy
import json
import random
import tempfile
from unittest.mock import patch

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyloom.operators import command_log, settled
from tallyloom.sources import bundles
from tallyloom.streaming import ledger_stream

CODES = ["A1", "B1", "C1", "M2"]
SCHEMA = ", ".join(f"{k} {v}" for k, v in command_log.FIELDS.items())
MOST = 1_000_000_000


def palette(spark):
    return spark.createDataFrame([(c,) for c in CODES], "code string")


def command(**x):
    return {k: x.get(k) for k in command_log.FIELDS}


class Model:
    """One ledger as a document that each good command replaces whole."""

    def __init__(self):
        self.s = {"epoch": 0, "seq": 0, "percent": 10, "stock": {}, "requests": {}, "makes": {}, "patterns": {}, "usages": {}, "drafts": {}}

    def row(self, code):
        return self.s["stock"].setdefault(code, {"qty": 0, "estimated": True, "baseline": None, "entered": False})

    @staticmethod
    def number(text, most=MOST):
        text = "" if text is None else str(text).strip()
        return int(text) if text.isdigit() and (text == "0" or text[0] != "0") and int(text) <= most else None

    def usage_error(self, lines):
        if lines is None:
            return "invalid-usage"
        seen = set()
        for line in lines:
            code = self.plain(line["code"])
            if code not in CODES:
                return "unknown-color"
            if code in seen:
                return "duplicate-color"
            seen.add(code)
            if self.number(line["qty"]) is None:
                return "invalid-number"
        return None

    @staticmethod
    def plain(code):
        code = (code or "").strip().upper()
        return code[:1] + str(int(code[1:])) if code[1:].isdigit() else code

    def payload(self, c):
        return json.dumps({k: v for k, v in c.items() if k not in ("ledger_id", "seq", "request_id", "token", "backup")}, default=str)

    def apply(self, c):
        """Result code, movements as (code, before, after), and gaps."""
        before = copy.deepcopy(self.s)
        try:
            return getattr(self, "do_" + c["op_type"].replace("-", "_"))(c)
        except ValueError as refused:
            self.s = before
            code, gaps = (*refused.args, [])[:2]
            return code, [], gaps

    def known(self, c, payload):
        """What a repeated request gives, or None."""
        if (c["request_id"] or "") not in self.s["requests"]:
            return None
        kept = self.s["requests"][c["request_id"]]
        if kept[0] != payload:
            raise ValueError("request-conflict")
        return "replay", kept[1], []

    def write(self, c, payload, effect):
        if not (c["request_id"] or "").strip():
            raise ValueError("invalid-request")
        if again := self.known(c, payload):
            return again
        if c["token"] and (c["token"]["epoch"], c["token"]["seq"]) != (self.s["epoch"], self.s["seq"]):
            raise ValueError("stale")
        moves = effect()
        self.s["seq"] += moves is not None
        self.s["requests"][c["request_id"]] = (payload, moves or [])
        return ("noop" if moves is None else "ok"), moves or [], []

    def set_qty(self, code, qty):
        row = self.row(code)
        old, row["qty"] = row["qty"], qty
        return (code, old, qty)

    def batch(self, c):
        payload, kind = self.payload(c), c["op_type"]
        if again := self.known(c, payload):
            return again
        if not c["lines"]:
            raise ValueError("empty-batch")
        seen, plan, less = set(), [], False
        for item in c["lines"]:
            code = self.plain(item["code"])
            if code not in CODES:
                raise ValueError("unknown-color")
            if code in seen:
                raise ValueError("duplicate-color")
            seen.add(code)
            qty = self.number(item["qty"])
            if qty is None:
                raise ValueError("invalid-number")
            row = self.row(code)
            if kind == "first-entry" and row["entered"]:
                raise ValueError("already-entered")
            if kind == "flag" and qty != row["qty"]:
                raise ValueError("flag-qty-changed")
            less = less or (kind == "restock" and qty < row["qty"])
            flag = item["estimated"] if item["estimated"] is not None else (True if kind == "first-entry" else row["estimated"])
            base = qty if kind == "first-entry" or (kind == "restock" and qty > row["qty"]) else row["baseline"]
            plan.append((code, qty, flag, base, (qty, flag, base) != (row["qty"], row["estimated"], row["baseline"])))
        if less:
            raise ValueError("restock-decrease")

        def effect():
            if kind != "first-entry" and not any(p[4] for p in plan):
                return None
            moves = []
            for code, qty, flag, base, changed in plan:
                if kind in ("flag", "restock") and not changed:
                    continue
                row, move = self.row(code), self.set_qty(code, qty)
                row["estimated"], row["baseline"] = flag, base
                row["entered"] = row["entered"] or kind == "first-entry" or qty != 0
                moves += [move] if changed else []
            return moves

        return self.write(c, payload, effect)

    do_first_entry = do_count = do_restock = do_flag = batch

    def do_settings(self, c):
        value = self.number(c["percent"], 100)
        if value is None:
            raise ValueError("invalid-number")

        def effect():
            if self.s["percent"] == value:
                return None
            self.s["percent"] = value
            return []

        return self.write(c, self.payload(c), effect)

    def do_palette(self, c):
        if sorted(c["codes"] or []) != CODES:
            raise ValueError("palette-mismatch")
        return self.write(c, self.payload(c), list)

    def do_create_pattern(self, c):
        if not (c["name"] or "").strip():
            raise ValueError("invalid-name")
        if not c["image"]:
            raise ValueError("invalid-image")
        pattern = {"name": c["name"].strip(), "source": (c["source_note"] or "").strip(), "size": (c["size_note"] or "").strip(), "version": None, "archived": False}
        return self.write(c, self.payload(c), lambda: self.s["patterns"].update({c["pattern_id"]: pattern}) or [])

    def pattern(self, c):
        if c["pattern_id"] not in self.s["patterns"]:
            raise ValueError("missing-pattern")
        return self.s["patterns"][c["pattern_id"]]

    def do_pattern_meta(self, c):
        p = self.pattern(c)
        name = p["name"] if c["name"] is None else c["name"].strip()
        if not name:
            raise ValueError("invalid-name")
        new = {"name": name, "source": p["source"] if c["source_note"] is None else c["source_note"], "size": p["size"] if c["size_note"] is None else c["size_note"]}
        payload = json.dumps(["pattern-meta", c["pattern_id"], *new.values()])
        return self.write(c, payload, lambda: p.update(new | {"size": new["size"].strip()}) or [])

    def do_archive_pattern(self, c):
        if again := self.known(c, self.payload(c)):
            return again
        p = self.pattern(c)
        if p["archived"]:
            raise ValueError("already-archived")
        return self.write(c, self.payload(c), lambda: p.update(archived=True) or [])

    def title(self, c):
        if c["title"] is None or not c["title"].strip():
            return None
        if (value := self.number(c["title"], 2**53 - 1)) is None:
            raise ValueError("invalid-number")
        return value

    def lines(self, c):
        if error := self.usage_error(c["lines"]):
            raise ValueError(error)
        return sorted((self.plain(x["code"]), self.number(x["qty"])) for x in c["lines"])

    def do_save_draft(self, c):
        lines, title = self.lines(c), self.title(c)
        self.pattern(c)
        self.s["drafts"][c["pattern_id"]] = (lines, title)
        return "ok", [], []

    def do_confirm_usage(self, c):
        lines = self.lines(c)
        if c["with_meta"]:
            if None in (c["name"], c["source_note"], c["size_note"]):
                raise ValueError("invalid-meta")
            if not c["name"].strip():
                raise ValueError("invalid-name")
        title = self.title(c)
        if title is not None and title != sum(q for _, q in lines) and not c["ack"]:
            raise ValueError("title-diff")
        if any(x["qty"] is not None and x["qty"] < 0 for x in c["rejected"] or []):
            raise ValueError("invalid-rejected-item")
        if r := c["recognition"]:
            named = [x["code"] for x in r["candidates"]]
            if r["source"] not in ("legend", "grid", "assisted") or not set(named) <= set(CODES) or (r["status"] == "failed") == bool(named) or (r["status"] == "failed" and r["source"] != "assisted"):
                raise ValueError("invalid-provenance")
            if (r["status"] != "ready" or any(not x["resolved"] for x in r["risks"])) and not r["acknowledged"]:
                raise ValueError("recognition-risk")
        p = self.pattern(c)
        if c["with_meta"] and c["image"] is False:
            raise ValueError("invalid-image")

        def effect():
            p["version"] = (p["version"] or 0) + 1
            if c["with_meta"]:
                p.update(name=c["name"].strip(), source=c["source_note"].strip(), size=c["size_note"].strip())
            self.s["usages"][c["pattern_id"], p["version"]] = lines
            self.s["drafts"].pop(c["pattern_id"], None)
            return []

        return self.write(c, self.payload(c), effect)

    def do_make(self, c):
        if c["pattern_id"] is None:
            lines, payload = self.lines(c), self.payload(c)
        else:
            p = self.pattern(c)
            if p["version"] is None or (c["pattern_id"], p["version"]) not in self.s["usages"]:
                raise ValueError("unconfirmed")
            lines = self.s["usages"][c["pattern_id"], p["version"]]
            payload = json.dumps([c["pattern_id"], p["version"], lines])

        def effect():
            short = [(code, qty, self.row(code)["qty"]) for code, qty in lines if qty > self.row(code)["qty"]]
            if short:
                raise ValueError("insufficient", short)
            self.s["makes"][c["make_id"] or c["request_id"]] = [lines, False]
            return [self.set_qty(code, self.row(code)["qty"] - qty) for code, qty in lines if qty]

        return self.known(c, payload) or self.write(c, payload, effect)

    def do_void_make(self, c):
        if c["make_id"] not in self.s["makes"]:
            raise ValueError("missing-make")
        made = self.s["makes"][c["make_id"]]
        if made[1]:
            if c["request_id"] in self.s["requests"]:
                return "replay", self.s["requests"][c["request_id"]][1], []
            raise ValueError("already-voided")

        def effect():
            if any(self.row(code)["qty"] + qty > MOST for code, qty in made[0]):
                raise ValueError("invalid-number")
            made[1] = True
            return [self.set_qty(code, self.row(code)["qty"] + qty) for code, qty in made[0] if qty]

        return self.write(c, self.payload(c), effect)

    def do_restore(self, c):
        if c["token"] and (c["token"]["epoch"], c["token"]["seq"]) != (self.s["epoch"], self.s["seq"]):
            raise ValueError("stale")
        try:
            b = json.loads(c["backup"] or "")
        except ValueError:
            raise ValueError("invalid-backup") from None
        if b["format_version"] > 2:
            raise ValueError("unsupported-backup")
        if len(b["stock"]) != len(CODES):
            raise ValueError("invalid-backup")
        epoch, self.s = self.s["epoch"], Model().s
        self.s.update(epoch=epoch + 1, seq=b["seq"], percent=b["low_stock_percent"])
        self.s["stock"] = {x["code"]: {k: x[k] for k in ("qty", "estimated", "baseline", "entered")} for x in b["stock"]}
        self.s["patterns"] = {x["pattern_id"]: {"name": x["name"], "source": x["source_note"], "size": x["size_note"], "version": x["confirmed_version"], "archived": x["archived_at"] is not None} for x in b["patterns"]}
        self.s["usages"] = {(x["pattern_id"], x["version"]): [(y["code"], y["qty"]) for y in x["lines"]] for x in b["usages"]}
        self.s["makes"] = {x["make_id"]: [[(y["code"], y["qty"]) for y in x["lines"]], x["voided"]] for x in b["makes"]}
        self.s["requests"] = {x["request_id"]: (x["payload"], []) for x in b["requests"]} | {c["request_id"] or "": ("own", [])}
        return "ok", [], []


def backup(rng):
    stock = [{"code": c, "qty": rng.randrange(50), "estimated": rng.random() < 0.5, "baseline": rng.choice([None, 40]), "entered": rng.random() < 0.5} for c in CODES]
    usage = {"pattern_id": "p1", "version": 2, "lines": [{"code": "A1", "qty": 3}], "input_method": "manual", "title_total": None, "recognition": None}
    pattern = {"pattern_id": "p1", "name": "old", "source_note": "s", "size_note": "", "confirmed_version": 2, "archived_at": None, "thumbnail": {"mime": "image/png", "base64": "QUJD"}}
    make = {"make_id": "r1", "pattern_id": "p1", "version": 2, "lines": [{"code": "A1", "qty": 3}], "voided": False, "request_id": "r1"}
    return {"format_version": rng.choice([2, 2, 2, 3]), "exported_at": "now", "ledger_id": 1, "epoch": 5, "seq": rng.randrange(9), "low_stock_percent": 20, "stock": stock[: rng.choice([4, 4, 4, 3])], "operations": [], "movements": [], "patterns": [pattern], "usages": [usage], "makes": [make], "requests": [{"request_id": "r2", "payload": "x", "result": ""}]}


def random_log(seed, n, kinds, ledgers=(1,), restores=0.03):
    rng, out = random.Random(seed), []
    heads = {x: Model() for x in ledgers}
    for seq in range(1, n + 1):
        ledger, kind = rng.choice(ledgers), rng.choice(kinds)
        if rng.random() < restores:
            kind = "restore"
        few = kind in ("make", "confirm-usage", "save-draft")
        lines = [{"code": rng.choice(["A1", "a01", "B1", "C1", "m2 ", *(["Z9"] if rng.random() < 0.1 else [])]), "qty": rng.choice([str(rng.randrange(6 if few else 60)), "0", str(rng.randrange(60)), *([" 7", "x", None, str(MOST), str(MOST + 1)] if rng.random() < 0.15 else [])]), "estimated": rng.choice([None, None, True, False])} for _ in range(rng.choice([1, 1, 2, 3]))]
        c = command(ledger_id=ledger, seq=seq, op_type=kind, request_id=rng.choice([f"r{rng.randrange(n)}", f"r{seq}", f"r{seq}", " "] if rng.random() < 0.5 else [f"r{seq}"]))
        model = heads[ledger]
        if rng.random() < 0.3:
            c["token"] = {"epoch": model.s["epoch"], "seq": model.s["seq"] - (rng.random() < 0.3)}
        if kind in (*command_log.BATCHES, "make", "confirm-usage", "save-draft"):
            c["lines"] = rng.choice([lines, lines, lines, lines, lines, [], None]) if kind in command_log.BATCHES else rng.choice([lines, lines, lines, None])
            if kind == "flag" and c["lines"]:
                for x in c["lines"]:
                    x["qty"] = rng.choice([x["qty"], str(model.row(model.plain(x["code"]))["qty"])])
        c["pattern_id"] = rng.choice(["p1", "p2", "p3"]) if kind in ("create-pattern", "pattern-meta", "archive-pattern", "save-draft", "confirm-usage") else rng.choice([None, "p1", "p2"]) if kind == "make" and "confirm-usage" in kinds else None
        if kind == "void-make":
            c["make_id"] = rng.choice([*model.s["makes"], "none", None])
        if kind == "settings":
            c["percent"] = rng.choice(["10", "20", "101", "-1", "", None])
        if kind == "palette":
            c["codes"] = rng.choice([CODES, CODES[::-1], CODES[:3], [*CODES[:3], "A1"], None])
        if kind in ("create-pattern", "pattern-meta", "confirm-usage"):
            c |= {k: rng.choice([None, " x ", "y"]) for k in ("source_note", "size_note")} | {"name": rng.choice([None, " n ", "m", " "]), "image": rng.choice([True, True, None, False]), "with_meta": kind == "confirm-usage" and rng.random() < 0.4}
        if kind in ("confirm-usage", "save-draft"):
            c |= {"title": rng.choice([None, " ", "5", "x"]), "ack": rng.choice([None, True, False]), "rejected": rng.choice([None, None, [{"raw": "q", "qty": None, "note": ""}], [{"raw": "q", "qty": -1, "note": ""}]])}
            risks = [{"id": "a", "reason": "b", "raw": "", "resolved": rng.random() < 0.5}]
            c["recognition"] = rng.choice([None, None, {"source": rng.choice(["legend", "assisted", "other"]), "algorithm_version": "1", "status": rng.choice(["ready", "failed"]), "candidates": rng.choice([[], [{"code": "A1", "qty": 1}]]), "title_total": None, "risks": rng.choice([[], risks]), "acknowledged": rng.random() < 0.5}])
        if kind == "restore":
            c["backup"] = rng.choice([json.dumps(backup(rng)), json.dumps(backup(rng)), json.dumps(backup(rng)), "{", None])
        if out and rng.random() < 0.2:  # a repeated request
            c |= {k: v for k, v in copy.deepcopy(rng.choice(out)).items() if k not in ("seq", "ledger_id", "token")}
        out.append(c)
        model.apply(c)
    return out


def modelled(log):
    models, out = {}, []
    for c in sorted(log, key=lambda c: (c["ledger_id"], c["seq"])):
        model = models.setdefault(c["ledger_id"], Model())
        result, moves, gaps = model.apply(c)
        out.append((c["ledger_id"], c["seq"], result, [m for m in moves], gaps, model.s["epoch"], model.s["seq"]))
    return out


def plain(rows):
    """Movements of flags or baselines alone have equal quantities."""
    return sorted((r.ledger_id, r.seq, r.result, [tuple(m)[:3] for m in r.moves], [tuple(g) for g in r.gaps], r.epoch, r.head_seq) for r in rows)


def frame(spark, log):
    return spark.createDataFrame([Row(**c) for c in log], SCHEMA)


ALL = [*command_log.BATCHES, "make", "void-make", "settings", "palette", "create-pattern", "pattern-meta", "archive-pattern", "save-draft", "confirm-usage", "create-pattern", "confirm-usage", "count", "make"]


@pytest.mark.parametrize("seed", range(3))
def test_fold_of_all_kinds_is_the_model(spark, seed):
    log = random_log(seed, 300, ALL, ledgers=(1, 2, None) if seed == 2 else (1, 2))
    got = command_log.fold_log(frame(spark, log), palette(spark)).collect()
    log = [c | {"ledger_id": -1 if c["ledger_id"] is None else c["ledger_id"]} for c in log]
    got = plain([Row(**r.asDict() | {"ledger_id": -1 if r.ledger_id is None else r.ledger_id}) for r in got])
    wanted = modelled(log)
    for a, b in zip(got, wanted):
        assert a == b, [c for c in log if (c["ledger_id"], c["seq"]) == a[:2]]
    assert len(got) == len(log)
    seen = {r[2] for r in got}
    assert seed == 2 or {"ok", "noop", "replay", "request-conflict", "stale", "invalid-request", "empty-batch", "missing-pattern", "title-diff", "invalid-provenance", "insufficient", "palette-mismatch", "invalid-backup"} <= seen


def test_rounds_are_the_fold(spark):
    """A hot ledger with repeats, tokens, retries and voids; ledgers with other kinds go through the fold; a ledger that doesn't settle, too."""
    kinds = [*command_log.BATCHES, "make", "void-make", "count", "restock", "make"]
    log = random_log(7, 40, kinds, ledgers=(1, 1, 2), restores=0) + [c | {"ledger_id": 3} for c in random_log(8, 20, ALL)]
    rows = frame(spark, log)
    wanted = plain(command_log.fold_log(rows, palette(spark)).collect())
    assert wanted == modelled(log)
    with patch.object(settled, "CHUNK", 16):  # values are carried over chunks
        assert plain(settled.fold_in_rounds(rows, palette(spark), rounds=4).collect()) == wanted
    assert settled.fold_in_rounds(rows.limit(0), palette(spark)).collect() == []


def test_flags_act(spark):
    """A batch that changes flags only is no no-op; an empty one and a blank request are refused."""
    items = lambda *x: [{"code": c, "qty": q, "estimated": e} for c, q, e in x]
    log = [
        command(ledger_id=1, seq=1, op_type="count", request_id="a", lines=items(("A1", "5", None))), command(ledger_id=1, seq=2, op_type="flag", request_id="b", lines=items(("A1", "5", False))), command(ledger_id=1, seq=3, op_type="flag", request_id="c", lines=items(("A1", "5", False))),
        command(ledger_id=1, seq=4, op_type="count", request_id="d", lines=items(("A1", None, None), ("Z1", "1", None))), command(ledger_id=1, seq=5, op_type="count", request_id="e", lines=[]), command(ledger_id=1, seq=6, op_type="count", request_id=" ", lines=items(("A1", "6", None))),
    ]
    got = command_log.fold_log(frame(spark, log), palette(spark)).orderBy("seq").collect()
    assert [r.result for r in got] == ["ok", "ok", "noop", "invalid-number", "empty-batch", "invalid-request"]
    assert [tuple(m) for m in got[1].moves] == [("A1", 5, 5, True, False, None, None)]


def _write(spark, rows, folder):
    rows.coalesce(1).write.mode("append").parquet(folder)


def test_stream_continues_from_its_checkpoint(spark):
    """The stream gives what the fold gives, over batches and over a restart."""
    log = random_log(11, 120, ALL, ledgers=(1, 2))
    source, out, state = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(3))
    schema = frame(spark, log).schema
    for part in (log[:60], log[60:]):
        _write(spark, frame(spark, part), source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = ledger_stream.apply_stream(stream, palette(spark)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert query.awaitTermination(120)  # each part is a query of its own, from the checkpoint
    assert plain(spark.read.parquet(out).collect()) == modelled(log)


class Kept:
    """A keyed state that counts what is asked of it."""

    def __init__(self):
        self.rows, self.reads, self.writes, self.value = {}, 0, 0, None

    def containsKey(self, key):
        self.reads += 1
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.writes += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.writes += 1
        del self.rows[key]

    def clear(self):
        self.rows = {}

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_trigger_touches_only_its_entries(spark):
    """After 200 commands, one more reads and writes a handful of entries."""
    rows = command_log.nullable(command_log.prepared(frame(spark, random_log(5, 200, ALL)), palette(spark))).orderBy("seq").toPandas()
    maps, head = {t: Kept() for t in (*ledger_stream.BODIES, "stock")}, Kept()
    for c in rows.itertuples(index=False):
        state = ledger_stream.KeyedEntries(maps, head)
        before = {t: (m.reads, m.writes) for t, m in maps.items()}
        command_log.applied(state, c)
        state.write()
        touched = sum(m.reads - before[t][0] for t, m in maps.items()), sum(m.writes - before[t][1] for t, m in maps.items())
        assert c.op_type == "restore" or max(touched) <= 12
    assert sum(len(m.rows) for m in maps.values()) > 20


def test_results_are_bundles_again(spark):
    """A backup's checks are those of bundles."""
    good = json.dumps(backup(random.Random(1)) | {"format_version": 2, "stock": [{"code": c, "qty": 1, "estimated": True, "baseline": None, "entered": True} for c in CODES]})
    assert [r.error for r in bundles.parsed(spark.createDataFrame([(good,)], "json string"), palette(spark)).select("error").collect()] == [None]
    log = [command(ledger_id=1, seq=1, op_type="restore", request_id="x", backup=good), command(ledger_id=1, seq=2, op_type="make", request_id="m", pattern_id="p1"), command(ledger_id=1, seq=3, op_type="void-make", request_id="v", make_id="r1")]
    got = command_log.fold_log(frame(spark, log), palette(spark)).orderBy("seq").select("result", "epoch", "ref", F.size("gaps").alias("n")).collect()
    assert [tuple(r) for r in got] == [("ok", 1, None, 0), ("insufficient", 1, None, 1), ("ok", 1, "r1", 0)]


def test_identities_that_change(spark):
    """Results pass while their identity is the latest; it moves between batches, within one, and over a restart; a closed page takes none."""
    fields = "page_id string, request_id string, image_session bigint, pattern_id string, revision bigint, confirmed_version bigint, epoch bigint, at bigint"
    one = lambda page, session, at, version=None: (page, "r", session, "p", 1, version, 0, at)
    closed = lambda page, at: (page, *[None] * 6, at)
    batches = [
        ([one("a", 1, 1), one("b", 1, 1, 5)], [(*one("a", 1, 2), "a1"), (*one("b", 1, 2), "no: version"), (*one("b", 1, 3, 5), "b1"), (*one("c", 1, 1), "no: unknown")]),
        ([one("a", 2, 5), one("b", 1, 0, 4)], [(*one("a", 1, 4), "a2"), (*one("a", 1, 6), "no: late"), (*one("a", 2, 6), "a3"), (*one("b", 1, 9, 5), "b2")]),
        ([closed("b", 12)], [(*one("b", 1, 11, 5), "b3"), (*one("b", 1, 13, 5), "no: closed"), (*one("a", 2, 13), "a4"), (*closed("b", 14), "no: empty")]),
    ]
    names, found, out, state = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(4))
    for identities, results in batches:
        _write(spark, spark.createDataFrame(identities, fields), names)
        _write(spark, spark.createDataFrame(results, fields + ", payload string"), found)
        stream = ledger_stream.current_stream(spark.readStream.schema(fields + ", payload string").parquet(found), spark.readStream.schema(fields).parquet(names))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert sorted(r.payload for r in spark.read.parquet(out).collect()) == ["a1", "a2", "a3", "a4", "b1", "b2", "b3"]
