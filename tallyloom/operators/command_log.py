"""One ordered log of all kinds of commands, and its fold (C1 to C14 over a log).

What needs no state is decided in columns by :func:`prepared`: codes against the catalogue,
quantities, repeats, titles, rejected items, recognition, backups, and the first of these
that fails.  What needs state is left to :func:`applied`, which reads and writes a ledger's
*entries* one by one, so that the same rules serve a batch fold, whose entries are a
dictionary, and a stream, whose entries are keyed state.

Order of checks, kind by kind: batches (first-entry, count, restock, flag) replay first, then
their items in order, decreases of a restock, a blank request id, the token; makes look up
their usage, then replay, then as others; voids look up the make; all others fail by what
their own fields say before the request is looked at; a restore checks its token first and is
never a replay; a draft has neither request nor token.  Good commands and no-ops are kept in
the journal by request; refused ones are not, so they may be tried again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import colour_key, plain_code
from ..functions.quantities import MAX_QTY, MAX_SAFE, parse_percent, parse_quantity, title_blocked
from ..functions.texts import rejected_items_hold
from ..sources.bundles import BUNDLE, checked

FIRST, COUNT, RESTOCK, FLAG, MAKE, VOID = "first-entry", "count", "restock", "flag", "make", "void-make"
BATCHES = (FIRST, COUNT, RESTOCK, FLAG)
PERCENT, PALETTE, CREATE, META, ARCHIVE, DRAFT, CONFIRM, RESTORE = "settings", "palette", "create-pattern", "pattern-meta", "archive-pattern", "save-draft", "confirm-usage", "restore"

#: The fields of a command; all but the first four may be missing.  ``token`` null: not checked.
FIELDS = {
    "ledger_id": "bigint", "seq": "bigint", "request_id": "string", "op_type": "string", "token": "struct<epoch:bigint,seq:bigint>",
    "lines": "array<struct<code:string,qty:string,estimated:boolean>>", "payload": "string", "make_id": "string", "pattern_id": "string", "percent": "string", "codes": "array<string>",
    "name": "string", "source_note": "string", "size_note": "string", "image": "boolean", "with_meta": "boolean", "title": "string", "ack": "boolean",
    "rejected": "array<struct<raw:string,qty:bigint,note:string>>",
    "recognition": "struct<source:string,algorithm_version:string,status:string,candidates:array<struct<code:string,qty:bigint>>,title_total:bigint,risks:array<struct<id:string,reason:string,raw:string,resolved:boolean>>,acknowledged:boolean>",
    "backup": "string",
}
MOVE = "struct<code:string,qty_before:bigint,qty_after:bigint,estimated_before:boolean,estimated_after:boolean,baseline_before:bigint,baseline_after:bigint>"
#: What comes out for each command; ``ref`` is the make or pattern that it made or meant.
RESULT = f"ledger_id bigint, seq bigint, request_id string, op_type string, result string, moves array<{MOVE}>, gaps array<struct<code:string,need:bigint,have:bigint>>, ref string, version bigint, epoch bigint, head_seq bigint"
COLUMNS = ["ledger_id", "seq", "request_id", "op_type", "result", "moves", "gaps", "ref", "version", "epoch", "head_seq"]
MOVE_FIELDS = ("code", "qty_before", "qty_after", "estimated_before", "estimated_after", "baseline_before", "baseline_after")


def _trimmed(name: str) -> Column:
    return F.trim(F.col(name))


def _parsed_lines(known: Column) -> Column:
    """Lines with plain code, quantity, flag and the line's own error; a repeat is found before its quantity is read."""
    codes = F.transform("lines", lambda x: plain_code(x["code"]))

    def line(x: Column, i: Column) -> Column:
        code, qty = plain_code(x["code"]), parse_quantity(x["qty"])["value"]
        missing = code.isNull() | ~F.array_contains(known, code)
        error = F.when(F.coalesce(missing, F.lit(True)), "unknown-color").when(F.array_contains(F.slice(codes, 1, i), code), "duplicate-color").when(qty.isNull(), "invalid-number")
        return F.struct(F.coalesce(code, x["code"]).alias("code"), qty.alias("qty"), x["estimated"].alias("estimated"), error.alias("error"))

    return F.transform("lines", line)


def _provenance_error(known: Column) -> Column:
    """invalid-provenance, or recognition-risk where open risks aren't acknowledged; null without a recognition."""
    r = F.col("recognition")
    codes, ids = F.transform(r["candidates"], lambda c: plain_code(c["code"])), F.transform(r["risks"], lambda x: x["id"])
    failed = r["status"] == "failed"
    holds = (
        r["source"].isin("legend", "grid", "assisted") & (F.trim(r["algorithm_version"]) != "") & (F.length(r["algorithm_version"]) <= 100) & r["status"].isin("ready", "partial", "failed") & r["acknowledged"].isNotNull()
        & (F.size(codes) <= 221) & (F.size(F.array_distinct(codes)) == F.size(codes)) & F.forall(codes, lambda c: F.array_contains(known, c)) & F.forall(r["candidates"], lambda c: c["qty"].between(0, MAX_QTY))
        & F.when(failed, (r["source"] == "assisted") & (F.size(codes) == 0)).otherwise(F.size(codes) > 0) & (r["title_total"].isNull() | r["title_total"].between(0, MAX_SAFE))
        & (F.size(ids) <= 512) & (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(r["risks"], lambda x: F.length(x["id"]).between(1, 100) & F.length(x["reason"]).between(1, 1000) & (F.length(x["raw"]) <= 1000) & x["resolved"].isNotNull())
    )
    review = (r["status"] != "ready") | F.exists(r["risks"], lambda x: ~x["resolved"])
    return F.when(r.isNull(), None).when(~F.coalesce(holds, F.lit(False)), "invalid-provenance").when(review & ~r["acknowledged"], "recognition-risk")


def prepared(commands: DataFrame, palette: DataFrame, bundles: bool = True) -> DataFrame:
    """Commands with parsed ``lines``, ``early`` (the first failure that needs no state), ``number``, ``difference``, ``key`` of the payload and, with ``bundles``, ``bundle_error`` of restores."""
    codes = [r["code"] for r in palette.select("code").limit(1001).collect()]  # the catalogue
    if len(codes) > 1000:
        raise ValueError("more than 1000 colours")
    known = F.array(*[F.lit(c) for c in codes]).cast("array<string>")
    have = commands.schema.names
    rows = commands.select(*[(_cast_lines(commands, kind) if name == "lines" else F.col(name).cast(kind)).alias(name) if name in have else F.lit(None).cast(kind).alias(name) for name, kind in FIELDS.items()])
    rows = rows.withColumn("raw", F.to_json(F.struct("op_type", "lines", "payload", "make_id", "pattern_id", "percent", "codes", "name", "source_note", "size_note", "image", "with_meta", "title", "ack", "rejected", "recognition")))
    kind, title = F.col("op_type"), parse_quantity(F.col("title"), MAX_SAFE)
    rows = rows.withColumns({"lines": _parsed_lines(known), "_title": F.when(F.coalesce(_trimmed("title"), F.lit("")) != "", title), "_provenance": _provenance_error(known)})
    line_error = F.get(F.filter(F.transform("lines", lambda x: x["error"]), lambda e: e.isNotNull()), F.lit(0))
    usage = F.when(F.col("lines").isNull() | F.exists("lines", lambda x: x.isNull()), "invalid-usage").otherwise(line_error)
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["qty"], F.lit(0)))
    bad_title = F.when(F.col("_title.reason").isNotNull(), "invalid-number")
    meta = F.when(F.coalesce("with_meta", F.lit(False)), F.when(F.col("name").isNull() | F.col("source_note").isNull() | F.col("size_note").isNull(), "invalid-meta").when(_trimmed("name") == "", "invalid-name"))
    rejected = F.when(~F.coalesce(F.col("rejected").isNull() | rejected_items_hold(F.col("rejected")), F.lit(False)), "invalid-rejected-item")
    whole = (F.size("codes") == len(codes)) & (F.size(F.array_except(known, F.col("codes"))) == 0)
    difference = F.col("_title.value") - total
    early = (
        F.when(kind == PERCENT, F.when(parse_percent(F.col("percent"))["reason"].isNotNull(), "invalid-number"))
        .when(kind == PALETTE, F.when(~F.coalesce(whole, F.lit(False)), "palette-mismatch"))
        .when(kind == CREATE, F.when(F.coalesce(_trimmed("name"), F.lit("")) == "", "invalid-name").when(~F.coalesce("image", F.lit(False)), "invalid-image"))
        .when(kind == DRAFT, F.coalesce(usage, bad_title))
        .when(kind == CONFIRM, F.coalesce(usage, meta, bad_title, F.when(title_blocked(F.col("_title.value"), total, F.coalesce("ack", F.lit(False))), "title-diff"), rejected, F.col("_provenance")))
        .when((kind == MAKE) & F.col("pattern_id").isNull(), usage)
        .when(~kind.isin(*BATCHES, MAKE, VOID, META, ARCHIVE, RESTORE), "unknown-command")
    )
    ordered = F.transform(F.array_sort(F.transform("lines", lambda x: F.struct(colour_key(x["code"]).alias("k"), x.alias("x")))), lambda y: y["x"])
    rows = rows.select(
        "ledger_id", "seq", "request_id", kind, "token", F.when(kind.isin(DRAFT, CONFIRM, MAKE), ordered).otherwise(F.col("lines")).alias("lines"), "make_id", "pattern_id", F.sha2("raw", 256).alias("key"), early.alias("early"),
        F.coalesce(parse_percent(F.col("percent"))["value"], F.col("_title.value")).alias("number"), difference.alias("difference"), "name", "source_note", "size_note", "image", F.coalesce("with_meta", F.lit(False)).alias("with_meta"), F.col("recognition.source").alias("method"), F.when(kind == RESTORE, F.col("backup")).alias("backup"),
    )
    return _with_bundle_errors(rows, palette) if bundles else rows


def _cast_lines(commands: DataFrame, kind: str) -> Column:
    """Lines of (code, qty) or (code, qty, estimated), quantities as text or numbers."""
    flags = "estimated" in commands.schema["lines"].dataType.elementType.names
    return F.transform("lines", lambda x: F.struct(x["code"].cast("string").alias("code"), x["qty"].cast("string").alias("qty"), (x["estimated"] if flags else F.lit(None)).cast("boolean").alias("estimated"))).cast(kind)


def _with_bundle_errors(rows: DataFrame, palette: DataFrame) -> DataFrame:
    """``bundle_error`` by the checks of backups; only restores have any."""
    read = F.from_json("backup", BUNDLE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    judged = checked(rows.select(F.struct(*rows.columns).alias("_row"), read.alias("_b")).select("_row", "_b.*"), palette)
    return judged.select("_row.*", F.when(F.col("_row.op_type") == RESTORE, F.col("error")).alias("bundle_error"))


class Entries:
    """A ledger's state, entry by entry, in a dictionary; a stream has the same methods over keyed state."""

    def __init__(self):
        self.rows: dict[tuple[str, str], list] = {}

    def get(self, table: str, key: str = "") -> list | None:
        return self.rows.get((table, key))

    def put(self, table: str, key: str, row: list) -> None:
        self.rows[table, key] = row

    def drop(self, table: str, key: str) -> None:
        self.rows.pop((table, key), None)

    def clear(self) -> None:
        self.rows.clear()


class Refused(Exception):
    """Why a command has no effect."""

    def __init__(self, code: str, gaps: list | None = None):
        super().__init__(code)
        self.gaps = gaps or []


NO_HEAD, NO_STOCK = [0, 0, 10], [0, True, None, False]  # epoch, seq, percent; qty, estimated, baseline, entered


def applied(state: Entries, c) -> tuple:
    """The result row of one command (of :func:`prepared`) after its effect on ``state``."""
    moves, gaps, ref, version = [], [], None, None
    try:
        result, moves, ref, version = _act(state, c)
    except Refused as refused:
        result, gaps = str(refused), refused.gaps
    head = state.get("head") or NO_HEAD
    return (None if c.ledger_id is None else int(c.ledger_id), None if c.seq is None else int(c.seq), c.request_id, c.op_type, result, [dict(zip(MOVE_FIELDS, m)) for m in moves], [dict(zip(("code", "need", "have"), g)) for g in gaps], ref, version, head[0], head[1])


def _act(state: Entries, c) -> tuple:
    kind = c.op_type
    if kind == RESTORE:
        return _restored(state, c)
    key = c.key
    if kind in BATCHES:
        if stored := _replayed(state, c.request_id, key):
            return stored
        effect = _batch(state, c)
    elif kind == MAKE:
        usage, key = _make_usage(state, c)
        if stored := _replayed(state, c.request_id, key):
            return stored
        effect = lambda: _make(state, c, *usage)  # noqa: E731  sufficiency comes after the token
    elif kind == VOID:
        made = state.get("make", c.make_id or "")
        if made is None:
            raise Refused("missing-make")
        if made[1]:
            if entry := state.get("request", c.request_id or ""):
                return _stored(entry)
            raise Refused("already-voided")
        effect = lambda: _void(state, c, made)
    else:
        if c.early:
            raise Refused(c.early)
        if kind == ARCHIVE and (stored := _replayed(state, c.request_id, key)):
            return stored
        pattern = state.get("pattern", c.pattern_id or "") if kind in (META, ARCHIVE, DRAFT, CONFIRM) else None
        if kind in (META, ARCHIVE, DRAFT, CONFIRM) and pattern is None:
            raise Refused("missing-pattern")
        if kind == DRAFT:  # neither request nor token
            state.put("draft", c.pattern_id, [_plain(c.lines), c.number])
            return "ok", [], c.pattern_id, None
        if kind == META:
            name = pattern[0] if c.name is None else c.name.strip()
            if not name:
                raise Refused("invalid-name")
            new = [name, *[old if mine is None else mine for mine, old in ((c.source_note, pattern[1]), (c.size_note, pattern[2]))]]
            key = json.dumps([META, c.pattern_id, *new])
            effect = lambda: _put(state, "pattern", c.pattern_id, [new[0], new[1], new[2].strip(), *pattern[3:]])
        elif kind == ARCHIVE:
            if pattern[4]:
                raise Refused("already-archived")
            effect = lambda: _put(state, "pattern", c.pattern_id, [*pattern[:4], True])
        elif kind == CONFIRM:
            if c.with_meta and c.image is False:
                raise Refused("invalid-image")
            effect = lambda: _confirm(state, c, pattern)
        elif kind == CREATE:
            new_id = c.pattern_id or c.request_id
            effect = lambda: _put(state, "pattern", new_id, [c.name.strip(), (c.source_note or "").strip(), (c.size_note or "").strip(), None, False])
        elif kind == PERCENT:
            effect = lambda: _percent(state, c.number)
        else:
            effect = lambda: ("ok", [], None, None)  # noqa: E731  a palette is display only
    return _written(state, c, key, effect)


def _stored(entry: list) -> tuple:
    return "replay", entry[1], entry[2], entry[3]


def _replayed(state: Entries, request: str | None, key: str) -> tuple | None:
    entry = state.get("request", request or "")
    if entry is None:
        return None
    if entry[0] != key:
        raise Refused("request-conflict")
    return _stored(entry)


def _written(state: Entries, c, key: str, effect) -> tuple:
    """Request id, replay, token, effect, head and journal, in this order."""
    if not (c.request_id or "").strip():
        raise Refused("invalid-request")
    if stored := _replayed(state, c.request_id, key):
        return stored
    epoch, seq, percent = state.get("head") or NO_HEAD
    if c.token is not None and (c.token["epoch"], c.token["seq"]) != (epoch, seq):
        raise Refused("stale")
    result, moves, ref, version = effect()
    percent = (state.get("head") or NO_HEAD)[2]
    if result == "ok":
        state.put("head", "", [epoch, seq + 1, percent])
    state.put("request", c.request_id, [key, moves, ref, version])
    return result, moves, ref, version


def _put(state: Entries, table: str, key: str, row: list) -> tuple:
    state.put(table, key, row)
    return "ok", [], key, None


def _plain(lines) -> list:
    return [[x["code"], int(x["qty"])] for x in lines]


def _percent(state: Entries, value) -> tuple:
    epoch, seq, old = state.get("head") or NO_HEAD
    if old == value:
        return "noop", [], None, None
    state.put("head", "", [epoch, seq, int(value)])
    return "ok", [], None, None


def _moved(state: Entries, changes: list[tuple[str, list]]) -> list:
    """Rows written; movements of those that change."""
    moves = []
    for code, new in changes:
        old = state.get("stock", code) or NO_STOCK
        state.put("stock", code, new)
        if old[:3] != new[:3]:
            moves.append([code, old[0], new[0], old[1], new[1], old[2], new[2]])
    return moves


def _batch(state: Entries, c):
    """The effect of a batch: refused by its first bad item in order, then by decreases of a restock."""
    kind, lines, decreases = c.op_type, [], 0
    if c.lines is None or not len(c.lines):
        raise Refused("empty-batch")
    for x in c.lines:
        if x["error"]:
            raise Refused(x["error"])
        code, qty = x["code"], int(x["qty"])
        have, flag, base, entered = old = state.get("stock", code) or NO_STOCK
        if kind == FIRST and entered:
            raise Refused("already-entered")
        if kind == FLAG and qty != have:
            raise Refused("flag-qty-changed")
        decreases += kind == RESTOCK and qty < have
        after = (kind == FIRST or flag) if x["estimated"] is None else bool(x["estimated"])
        lines.append((code, old, [qty, after, qty if kind == FIRST or (kind == RESTOCK and qty > have) else base]))
    if decreases:
        raise Refused("restock-decrease")
    changed = [x for x in lines if x[1][:3] != x[2]]
    if kind in (FLAG, RESTOCK):
        lines = changed

    def effect() -> tuple:
        if kind != FIRST and not changed:
            return "noop", [], None, None
        return "ok", _moved(state, [(code, [*new, kind == FIRST or old[3] or new[0] != 0]) for code, old, new in lines]), None, None

    return effect


def _make_usage(state: Entries, c) -> tuple[tuple, str]:
    """Lines and version that a make means, and the key of its payload: its pattern's confirmed usage, or lines of its own."""
    if c.pattern_id is None:
        if c.early:
            raise Refused(c.early)
        return (_plain(c.lines), None), c.key
    pattern = state.get("pattern", c.pattern_id)
    if pattern is None:
        raise Refused("missing-pattern")
    usage = None if pattern[3] is None else state.get("usage", f"{c.pattern_id}\x1f{pattern[3]}")
    if usage is None:
        raise Refused("unconfirmed")
    return (usage[0], pattern[3]), json.dumps([MAKE, c.pattern_id, pattern[3], usage[0]])


def _make(state: Entries, c, lines: list, version: int | None) -> tuple:
    """All colours of a pattern, or none and what is missing."""
    rows = [(code, qty, state.get("stock", code) or NO_STOCK) for code, qty in lines]
    if gaps := [(code, qty, row[0]) for code, qty, row in rows if qty > row[0]]:
        raise Refused("insufficient", gaps)
    make_id = c.make_id or c.request_id
    state.put("make", make_id, [lines, False, c.pattern_id, version])
    return "ok", _moved(state, [(code, [row[0] - qty, *row[1:]]) for code, qty, row in rows if qty]), make_id, version


def _void(state: Entries, c, made: list) -> tuple:
    """The make's lines added back once, to what is there now."""
    rows = [(code, qty, state.get("stock", code) or NO_STOCK) for code, qty in made[0]]
    if any(row[0] + qty > MAX_QTY for _, qty, row in rows):
        raise Refused("invalid-number")
    state.put("make", c.make_id, [made[0], True, *made[2:]])
    return "ok", _moved(state, [(code, [row[0] + qty, *row[1:]]) for code, qty, row in rows if qty]), c.make_id, made[3]


def _confirm(state: Entries, c, pattern: list) -> tuple:
    """The next version of a pattern's usage, its new texts if any, and no draft any more."""
    version = (pattern[3] or 0) + 1
    texts = [c.name.strip(), c.source_note.strip(), c.size_note.strip()] if c.with_meta else pattern[:3]
    state.put("usage", f"{c.pattern_id}\x1f{version}", [_plain(c.lines), c.method or "manual"])
    state.put("pattern", c.pattern_id, [*texts, version, pattern[4]])
    state.drop("draft", c.pattern_id)
    return "ok", [], c.pattern_id, version


def _restored(state: Entries, c) -> tuple:
    """All entries replaced by the backup's; the epoch goes up and the restore's own request is added."""
    epoch, seq, _ = state.get("head") or NO_HEAD
    if c.token is not None and (c.token["epoch"], c.token["seq"]) != (epoch, seq):
        raise Refused("stale")
    if c.bundle_error:
        raise Refused(c.bundle_error)
    b = json.loads(c.backup)
    old = b["format_version"] == 1  # which had neither requests nor an archive
    state.clear()
    state.put("head", "", [epoch + 1, b["seq"], b["low_stock_percent"]])
    for x in b["stock"]:
        state.put("stock", x["code"], [x["qty"], x["estimated"], x.get("baseline"), x["entered"]])
    for x in b["patterns"]:
        state.put("pattern", x["pattern_id"], [x["name"], x.get("source_note") or "", x.get("size_note") or "", x.get("confirmed_version"), not old and x.get("archived_at") is not None])
    for x in b["usages"]:
        state.put("usage", f"{x['pattern_id']}\x1f{x['version']}", [[[y["code"], y["qty"]] for y in x["lines"]], x.get("input_method")])
    for x in b["makes"]:
        state.put("make", x["make_id"], [[[y["code"], y["qty"]] for y in x["lines"]], x["voided"], x["pattern_id"], x["version"]])
    for x in [] if old else b.get("requests") or []:
        state.put("request", x["request_id"], [x.get("payload"), [], None, None])
    own = json.dumps({"exportedAt": b["exported_at"], "kind": "restore", "seq": b["seq"]}, separators=(",", ":"))
    state.put("request", c.request_id or "", [own, [], None, None])
    return "ok", [], None, None


def fold_log(commands: DataFrame, palette: DataFrame) -> DataFrame:
    """Apply whole logs in order, ledger by ledger: every kind of command, each with its result.

    A ledger is one sequence: its rows stream through a sorted partition, and only its
    entries are held.  :func:`tallyloom.operators.settled.fold_in_rounds` splits one.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, Entries()  # rows without a ledger are one of their own
        for part in parts:
            out = []
            for c in part.itertuples(index=False):
                if c.ledger_id != at:
                    at, state = c.ledger_id, Entries()
                out.append(applied(state, c))
            yield pd.DataFrame(out, columns=COLUMNS)

    return nullable(prepared(commands, palette)).repartition("ledger_id").sortWithinPartitions("ledger_id", "seq").mapInPandas(run, RESULT)


def nullable(rows: DataFrame) -> DataFrame:
    """Numbers that may be null as decimals: pandas would make fractions and NaN of them."""
    return rows.withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("ledger_id", "seq", "number", "difference")})
