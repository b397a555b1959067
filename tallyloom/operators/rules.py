"""Data-quality rules: one table of violations instead of exceptions.

Every rule is a DataFrame (ledger_id, rule, key, detail); ``validate`` unions those
whose tables are given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import CAPS, plain_code
from ..functions.quantities import MAX_QTY, MAX_SAFE
from ..functions.texts import refused_content, rejected_items_hold, thumbnail_holds

OPERATIONS = ("first-entry", "count", "restock", "flag", "make", "void-make", "create-pattern", "update-pattern", "archive-pattern", "confirm-usage", "set-percent", "restore")


def found(rows: DataFrame, rule: str, wrong: Column, key: Column, detail: str, ledger: str = "ledger_id") -> DataFrame:
    """Rows of ``rows`` that break a rule."""
    owner = F.col(ledger).cast("string") if ledger in rows.columns else F.lit(None).cast("string")
    return rows.filter(F.coalesce(wrong, F.lit(True))).select(owner.alias("ledger_id"), F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.lit(detail).alias("detail"))


def failed(rows: DataFrame, rule: str, checks: dict[str, Column], key: Column) -> DataFrame:
    """One row for each named check that a row fails: all checks in one pass over the rows."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(~ok, F.lit(True)), F.lit(name)) for name, ok in checks.items()]))
    return rows.select(F.lit(None).cast("string").alias("ledger_id"), F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.explode(names).alias("detail"))


def repeated(rows: DataFrame, rule: str, keys: list[str], detail: str, ledger: str = "ledger_id") -> DataFrame:
    """Keys that stand more than once."""
    owner = [ledger] if ledger in rows.columns and ledger not in keys else []
    twice = rows.groupBy(*owner, *keys).agg(F.count("*").alias("n")).filter("n > 1")
    return found(twice, rule, F.lit(True), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), detail, ledger)


def dangling(rows: DataFrame, rule: str, keys: list[str], parents: DataFrame, detail: str) -> DataFrame:
    """Rows whose keys no parent has; null keys refer to nothing."""
    has = rows
    for k in keys:
        has = has.filter(F.col(k).isNotNull())
    lost = has.join(parents.select(*keys).distinct(), keys, "left_anti")
    return found(lost, rule, F.lit(True), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), detail)


def heads(rows: DataFrame) -> DataFrame:
    ok = F.col("epoch").between(0, MAX_SAFE) & F.col("seq").between(0, MAX_SAFE) & F.col("low_stock_percent").between(0, 100)
    return found(rows, "V1", ~ok, F.col("ledger_id"), "epoch, seq or percent out of range")


def palette(rows: DataFrame) -> DataFrame:
    """Colours out of range, and catalogue codes that a palette lacks (V2, F23); one palette a ``ledger_id`` where there is that column."""
    ok = F.col("r").between(0, 255) & F.col("g").between(0, 255) & F.col("b").between(0, 255) & (plain_code(F.col("code")) == F.col("code"))
    keys = ["ledger_id"] if "ledger_id" in rows.columns else []
    every = F.flatten(F.transform(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(cap).alias("cap")) for g, cap in CAPS.items()]), lambda s: F.transform(F.sequence(F.lit(1), s["cap"]), lambda n: F.concat(s["g"], n.cast("string")))))
    lacks = rows.groupBy(*keys).agg(F.collect_set("code").alias("_has")).select(*keys, F.explode(F.array_except(every, "_has")).alias("code"))
    return found(rows, "V2", ~ok, F.col("code"), "colour invalid").unionByName(found(lacks, "V2", F.lit(True), F.col("code"), "colour missing"))


def stock(rows: DataFrame, colours: DataFrame) -> DataFrame:
    ok = F.col("qty").between(0, MAX_QTY) & (F.col("baseline").isNull() | F.col("baseline").between(0, MAX_QTY))
    every = rows.select("ledger_id").distinct().crossJoin(F.broadcast(colours.select("code")))
    off = rows.join(F.broadcast(colours.select("code")), "code", "left_anti")
    missing = every.join(rows.select("ledger_id", "code"), ["ledger_id", "code"], "left_anti")
    return found(rows, "V3", ~ok, F.col("code"), "quantity out of range").unionByName(found(off, "V3", F.lit(True), F.col("code"), "not in the catalogue")).unionByName(found(missing, "V3", F.lit(True), F.col("code"), "missing"))


def operations(rows: DataFrame) -> DataFrame:
    return found(rows, "V4", ~(F.col("op_type").isin(*OPERATIONS) & (F.length("request_id") > 0)), F.col("seq"), "operation type or id")


def moves(rows: DataFrame) -> DataFrame:
    ok = (F.col("delta") == F.col("qty_after") - F.col("qty_before")) & F.col("qty_after").between(0, MAX_QTY) & F.col("qty_before").between(0, MAX_QTY)
    return found(rows, "V5", ~ok, F.concat_ws("/", F.col("seq").cast("string"), "code"), "delta or range")


def patterns(rows: DataFrame) -> DataFrame:
    """Names, and thumbnails where there is one."""
    bad = F.coalesce(F.trim("name") == "", F.lit(True))
    if "thumbnail" in rows.columns:
        bad |= F.col("thumbnail").isNotNull() & ~F.coalesce(thumbnail_holds(F.col("thumb_mime"), F.col("thumbnail")), F.lit(False))
    return found(rows, "V6", bad, F.col("pattern_id"), "name or thumbnail")


def usage(rows: DataFrame, colours: DataFrame, keys: list[str], rule: str = "V7") -> DataFrame:
    """Usage lines: catalogue codes, quantities in range, no repeats (V7, V19 on drafts)."""
    label = F.concat_ws("/", *[F.col(k).cast("string") for k in keys], "code")
    owner = ["ledger_id"] if "ledger_id" in rows.columns and "ledger_id" not in keys else []
    bad = F.coalesce(~F.col("qty").between(0, MAX_QTY), F.lit(True))
    each = rows.groupBy(*owner, *keys, "code").agg(F.count("*").alias("_n"), F.count_if(bad).alias("_bad"))  # one pass for all checks
    marked = each.join(F.broadcast(colours.select("code", F.lit(True).alias("_known")).distinct()), "code", "left")
    return _counted(marked, rule, [(label, "not in the catalogue", F.when(F.col("_known").isNull(), F.col("_n"))), (label, "quantity out of range", F.col("_bad")), (label, "repeated code", F.when(F.col("_n") > 1, 1))])


#: Equal rows that are made at once.
EQUAL = 4096


def _counted(rows: DataFrame, rule: str, checks: list[tuple[Column, str, Column]]) -> DataFrame:
    """A row's key and detail of each check as many times as its count says (null: never)."""
    counts = [F.coalesce(n.cast("bigint"), F.lit(0)) for _, _, n in checks]
    each = F.array(*[F.struct(key.cast("string").alias("key"), F.lit(detail).alias("detail"), n.alias("n")) for (key, detail, _), n in zip(checks, counts)])
    owner = F.col("ledger_id").cast("string") if "ledger_id" in rows.columns else F.lit(None).cast("string")
    some = rows.filter(reduce(Column.__or__, [n > 0 for n in counts])).select(owner.alias("ledger_id"), F.inline(each)).filter("n > 0")
    blocks = some.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(EQUAL).cast("bigint"))))
    return blocks.withColumn("_i", F.explode(F.sequence(F.col("_at") + 1, F.least(F.col("_at") + EQUAL, "n")))).select("ledger_id", F.lit(rule).alias("rule"), "key", "detail")


def versions(headers: DataFrame, owners: DataFrame) -> DataFrame:
    """Numbers from 1, unique in a pattern; the current one exists (V8)."""
    current = owners.filter("confirmed_version is not null").select("pattern_id", F.col("confirmed_version").cast("long").alias("version"))
    keys = ["pattern_id", "version"]
    owner = ["ledger_id"] if "ledger_id" in headers.columns else []
    numbers = headers.groupBy(*owner, *keys).agg(F.count("*").alias("_n"))  # one pass for both checks
    wrong = F.when(F.coalesce(~(F.col("version") >= 1), F.lit(True)), F.col("_n"))
    label = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    out = _counted(numbers, "V8", [(F.col("pattern_id"), "version number", wrong), (label, "version repeated", F.when(F.col("_n") > 1, 1))])
    return out.unionByName(dangling(current, "V8", keys, headers, "current version missing"))


def makes(rows: DataFrame, owners: DataFrame, headers: DataFrame) -> DataFrame:
    return repeated(rows, "V9", ["make_id"], "make repeated").unionByName(dangling(rows, "V9", ["pattern_id"], owners, "pattern missing")).unionByName(dangling(rows, "V9", ["pattern_id", "version"], headers, "version missing"))


def references(moved: DataFrame, done: DataFrame, patterns: DataFrame | None = None, makes: DataFrame | None = None) -> DataFrame:
    """What movements and operations refer to and isn't there (V10, J23): the operation; with ``patterns`` and ``makes``, those that an operation names."""
    out = dangling(moved, "V10", ["ledger_id", "seq"], done, "operation missing")
    for parents, key, detail in ((patterns, "pattern_id", "pattern missing"), (makes, "make_id", "make missing")):
        if parents is not None and key in done.columns:
            named = done.select("ledger_id", "seq", F.col(key).alias("_key")).filter("_key is not null")
            lost = named.join(parents.select("ledger_id", F.col(key).alias("_key")).distinct(), ["ledger_id", "_key"], "left_anti")
            out = out.unionByName(found(lost, "V10", F.lit(True), F.concat_ws("/", F.col("ledger_id").cast("string"), F.col("seq").cast("string"), F.col("_key").cast("string")), detail))
    return out


def requests(rows: DataFrame) -> DataFrame:
    """Request records (V11): an id, a payload, and with a column ``result`` (struct of ok, request_id, operation_id, seq) a whole good result."""
    out = found(rows, "V11", F.coalesce(F.length("request_id"), F.lit(0)) == 0, F.col("seq"), "request id").unionByName(found(rows, "V11", F.col("payload").isNull(), F.col("seq"), "payload"))
    if "result" not in rows.columns:
        return out
    r = F.col("result")
    whole = r["ok"] & (F.length(r["request_id"]) > 0) & (F.length(r["operation_id"]) > 0) & r["seq"].between(0, MAX_SAFE)
    return out.unionByName(found(rows, "V11", ~whole, F.col("seq"), "result"))


def provenance(rows: DataFrame, colours: DataFrame) -> DataFrame:
    """Recognition provenance: source, ``status``, candidates, risks, ``modified``.

    ``rows``: pattern_id, source, status, candidates array<struct<code,qty>>, risks
    array<struct<id,reason,raw,resolved>>, acknowledged, modified, final array<struct<code,qty>>.
    """
    codes = F.transform("candidates", lambda c: c.getField("code"))
    ids = F.transform("risks", lambda r: r.getField("id"))
    checks = {
        "enums": F.col("source").isin("legend", "grid", "assisted") & F.col("status").isin("ready", "partial", "failed"),
        "candidates": (F.size("candidates") <= 221) & (F.size(F.array_distinct(codes)) == F.size(codes)) & F.forall("candidates", lambda c: c.getField("qty").between(0, MAX_QTY)),
        "status": (F.col("status") == "failed") == (F.size("candidates") == 0),
        "risks": (F.size("risks") <= 512) & (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall("risks", lambda r: (F.length(r.getField("id")) <= 100) & (F.length(r.getField("reason")) <= 1000) & (F.length(r.getField("raw")) <= 1000)),
        "review": F.forall("risks", lambda r: r.getField("resolved")) | F.col("acknowledged"),
        "modified": F.col("modified") == (F.array_sort("candidates") != F.array_sort("final")),
    }
    out = failed(rows, "V12", checks, F.col("pattern_id"))
    lost = rows.select("pattern_id", F.explode(codes).alias("code")).join(F.broadcast(colours.select("code")), "code", "left_anti")
    return out.unionByName(found(lost, "V12", F.lit(True), F.col("pattern_id"), "unknown code"))


def recognition(rows: DataFrame) -> DataFrame:
    """The contract of a recognition result (V13, S8): sizes, totals, status against content."""
    n, total = F.size("candidates"), F.aggregate("candidates", F.lit(0).cast("bigint"), lambda s, c: s + c.getField("qty"))
    checks = {
        "status": F.col("status").isin("ready", "partial", "failed"),
        "size": (n <= 221) & (F.col("n_evidence") <= 20000) & (F.col("n_doubts") <= 512),
        "total": F.col("total").isNull() | ((F.col("total") == total) & (total <= MAX_SAFE)),
        "content": F.when(F.col("status") == "failed", (n == 0) & F.col("source").isNull()).otherwise((n > 0) & F.col("source").isin("legend", "grid")),
        "title": F.col("title_total").isNull() | (F.col("title_total") >= 0),
        "image": (F.col("width") >= 0) & (F.col("height") >= 0) & (F.col("width") * F.col("height") <= 32_000_000) & ((F.col("status") == "failed") | ((F.col("width") > 0) & (F.col("height") > 0))),
    }
    return failed(rows, "V13", checks, F.col("image_id"))


def forbidden(rows: DataFrame) -> DataFrame:
    return found(rows, "V16", refused_content(F.col("json")), F.col("key"), "forbidden content")


def pointers(rows: DataFrame) -> DataFrame:
    ok = F.col("pointer").isin("live", "pending") & F.col("live").isNotNull() & ((F.col("pointer") == "live") | F.col("pending").isNotNull())
    return found(rows, "V17", ~ok, F.col("pointer"), "snapshot pointer")


def confirmed(rows: DataFrame) -> DataFrame:
    """Confirmed usages (V18): a manual one has no recognition, another one that of its method; and, for the columns that are there, its shape.

    Columns: pattern_id, input_method, recognition_source; version, confirmed_at, title_total,
    title_diff, title_acknowledged, rejected (array of raw, qty, note).
    """
    manual = F.col("input_method") == "manual"
    ok = F.when(manual, F.col("recognition_source").isNull()).otherwise(F.col("input_method").isin("legend", "grid", "assisted") & F.col("recognition_source").eqNullSafe(F.col("input_method")))
    shape = {
        "version": F.col("version") >= 0, "confirmed_at": F.trim("confirmed_at") != "", "title_total": F.col("title_total").isNull() | F.col("title_total").between(0, MAX_SAFE),
        "title_diff": F.col("title_diff").isNull() | F.col("title_diff").between(-MAX_SAFE, MAX_SAFE), "title_acknowledged": F.col("title_acknowledged").isNotNull(), "rejected": rejected_items_hold(F.col("rejected")),
    }
    checks = {"recognition and input method": ok} | {name: check for name, check in shape.items() if name in rows.columns}
    return failed(rows, "V18", checks, F.col("pattern_id"))


def over_cap(rows: DataFrame, keys: list[str], cap: int, rule: str = "O7") -> DataFrame:
    """Keys with more rows than a hard cap: rejections, not truncation."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > cap)
    return found(many, rule, F.lit(True), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), f"more than {cap} rows")


def validate(tables: dict[str, DataFrame]) -> DataFrame:
    """All rules whose tables are there: palette, stock, operation, movement, pattern, version, version_line, make,
    head, draft_line, provenance, recognition, confirmed, document, pointer, box (O7 at 256) and cell (O7 at 40 000)."""
    t, out = tables, []
    single = {"head": heads, "provenance": None, "recognition": recognition, "confirmed": confirmed, "document": forbidden, "pointer": pointers, "movement": moves}
    out += [rule(t[name]) for name, rule in single.items() if rule and name in t]
    if "palette" in t:
        out.append(palette(t["palette"]))
        out += [stock(t["stock"], t["palette"])] if "stock" in t else []
        out += [usage(t["version_line"], t["palette"], ["pattern_id", "version"])] if "version_line" in t else []
        out += [usage(t["draft_line"], t["palette"], ["pattern_id"], "V19")] if "draft_line" in t else []
        out += [provenance(t["provenance"], t["palette"])] if "provenance" in t else []
    if "operation" in t:
        out += [operations(t["operation"]), requests(t["operation"])]
        out += [references(t["movement"], t["operation"], *[t[name] if name in t and {"ledger_id", f"{name}_id"} <= {*t[name].columns} else None for name in ("pattern", "make")])] if "movement" in t else []
    if "pattern" in t:
        out.append(patterns(t["pattern"]))
        out += [versions(t["version"], t["pattern"])] if "version" in t else []
        out += [makes(t["make"], t["pattern"], t["version"])] if {"make", "version"} <= t.keys() else []
    out += [over_cap(t[name], ["image_id"], cap) for name, cap in (("box", 256), ("cell", 40_000)) if name in t]
    whole = out[0]
    for one in out[1:]:
        whole = whole.unionByName(one)
    return whole
