"""Backup bundles: read, check, split, export; effective snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import colour_key
from ..functions.quantities import MAX_QTY, MAX_SAFE
from ..functions.texts import refused_content
from ..operators.ledger import stock_difference
from ..session import cut, stored

LINE = "array<struct<code:string,qty:bigint>>"
THUMBNAIL = "struct<mime:string,base64:string>"
#: The parts of a bundle, each an array of rows.
PARTS = {
    "stock": "struct<code:string,qty:bigint,estimated:boolean,baseline:bigint,entered:boolean>",
    "operations": "struct<seq:bigint,op_type:string,at:string,request_id:string,pattern_id:string,make_id:string,reason:string>",
    "movements": "struct<seq:bigint,code:string,qty_before:bigint,qty_after:bigint,delta:bigint>",
    "patterns": f"struct<pattern_id:string,name:string,source_note:string,size_note:string,confirmed_version:int,archived_at:string,thumbnail:{THUMBNAIL}>",
    "usages": f"struct<pattern_id:string,version:int,lines:{LINE},input_method:string,title_total:bigint,recognition:string>",
    "makes": f"struct<make_id:string,pattern_id:string,version:int,lines:{LINE},voided:boolean,request_id:string>",
    "requests": "struct<request_id:string,payload:string,result:string>",
}
#: One JSON document a ledger, formats 1 and 2.
BUNDLE = "format_version int, exported_at string, ledger_id bigint, epoch bigint, seq bigint, low_stock_percent bigint, " + ", ".join(f"{k} array<{v}>" for k, v in PARTS.items()) + ", _corrupt string"
#: A piece of a bundle: a document with the head and some of the rows, which piece it is and of how many.
PIECE = "piece int, pieces int, " + BUNDLE
#: What names a row of a part; no two rows of a ledger have the same.
NAMES = {"stock": "code", "operations": "seq", "makes": "make_id", "patterns": "pattern_id"}
#: A ledger with more rows in a part than this isn't one document; it goes in pieces.
MOST_ROWS = 1_000_000
#: Rows of all parts in a piece, on average, where a ledger has several.
PIECE_ROWS = 2000


def read_bundles(spark: SparkSession, path: str, whole_files: bool = True, palette: DataFrame | None = None) -> DataFrame:
    """Bundles with ``error``: null, or why one is refused (S1, V14, V15).  Truncated files come as one refused row."""
    rows = spark.read.schema(BUNDLE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", whole_files).json(path)
    return checked(rows, palette)


def parsed(rows: DataFrame, palette: DataFrame | None = None) -> DataFrame:
    """The same for a column ``json``.

    What is read is cut: a filter on ``error`` would move below the columns and read the
    document again for each part that each check looks at.
    """
    read = rows.select(F.from_json("json", BUNDLE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("b")).select("b.*")
    return checked(cut(read), palette)


def _every(part: str, ok) -> Column:
    """Whether all elements of a part hold, nulls failing."""
    return F.coalesce(F.forall(part, lambda x: F.coalesce(ok(x), F.lit(False))), F.lit(True))


def _alone(part: str, field: str) -> Column:
    """Whether no two elements of a part have the same key."""
    keys = F.transform(part, lambda x: x[field])
    return F.coalesce(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(True))


def _catalogue(palette: DataFrame) -> list[str]:
    return [r["code"] for r in palette.select("code").limit(1001).collect()]


def checked(rows: DataFrame, palette: DataFrame | None = None, whole_bundles: bool = True) -> DataFrame:
    """Bundles with the first reason to refuse them; with the catalogue, all its colours must be there and no other.

    Without ``whole_bundles`` rows are pieces, and what depends on other pieces is left to :func:`read_pieces`.
    """
    number = lambda x: x.between(0, MAX_QTY)
    lines = lambda x: x["lines"].isNotNull() & F.forall(x["lines"], lambda y: F.coalesce(number(y["qty"]), F.lit(False)) & y["code"].isNotNull())
    named = F.transform("patterns", lambda x: x["pattern_id"])
    there = lambda part: F.size(F.array_except(F.transform(part, lambda x: x["pattern_id"]), named)) == 0 if whole_bundles else F.lit(True)
    whole = F.lit(True)
    if palette is not None:
        codes = F.array(*[F.lit(c) for c in _catalogue(palette)])
        own = F.transform("stock", lambda x: x["code"])
        whole = (F.size("stock") == F.size(codes)) & (F.size(F.array_except(codes, own)) == 0) if whole_bundles else F.size(F.array_except(own, codes)) == 0
        for part in ("usages", "makes"):
            whole &= F.size(F.array_except(F.flatten(F.transform(part, lambda x: F.transform(x["lines"], lambda y: y["code"]))), codes)) == 0
    filled = lambda x, *names: reduce(Column.__and__, [x[n].isNotNull() for n in names])
    thumbnail = lambda x: x["thumbnail"]["mime"].isin("image/png", "image/jpeg") & (F.length(x["thumbnail"]["base64"]) > 0) & ~x["thumbnail"]["base64"].startswith("/")
    elements = (
        whole & _alone("stock", "code") & _every("stock", lambda x: filled(x, "code", "estimated", "entered") & number(x["qty"]) & (x["baseline"].isNull() | number(x["baseline"])))
        & _alone("operations", "seq") & _every("operations", lambda x: (x["seq"] >= 0) & filled(x, "op_type", "at", "request_id", "reason"))
        & _alone("makes", "make_id") & _every("makes", lambda x: filled(x, "make_id", "pattern_id", "version", "voided", "request_id") & lines(x)) & there("makes")
        & _alone("patterns", "pattern_id") & _every("patterns", lambda x: filled(x, "pattern_id", "name") & thumbnail(x) & (x["archived_at"].isNull() | (F.trim(x["archived_at"]) != "")))
        & _every("usages", lambda x: filled(x, "pattern_id", "version") & lines(x)) & there("usages")
    )
    manual = _every("usages", lambda x: (x["input_method"] == "manual") & x["recognition"].isNull())
    arrays = reduce(Column.__and__, [F.col(k).isNotNull() for k in PARTS if k != "requests"])
    safe = F.col("epoch").between(0, MAX_SAFE) & F.col("seq").between(0, MAX_SAFE) & (F.trim("exported_at") != "") & F.col("low_stock_percent").between(0, 100)
    error = (
        F.when(F.col("_corrupt").isNotNull() | F.col("ledger_id").isNull() | F.col("format_version").isNull(), "invalid-backup")
        .when(~F.col("format_version").isin(1, 2), "unsupported-backup")
        .when(~arrays | ~F.coalesce(safe, F.lit(False)) | ((F.col("format_version") == 1) & ~manual), "invalid-backup")
        .when(~F.coalesce(elements, F.lit(False)) | refused_content(F.to_json(F.struct(*PARTS))), "invalid-backup")
    )
    return rows.withColumn("error", error)


def migrated(rows: DataFrame) -> DataFrame:
    """Accepted bundles in format 2: no requests, nothing archived and no size note where format 1 had none."""
    ok = rows.filter("error is null")
    old = F.col("format_version") == 1
    empty = F.array().cast(f"array<{PARTS['requests']}>")
    return ok.withColumn("requests", F.when(old, empty).otherwise(F.coalesce("requests", empty))).withColumn(
        "patterns", F.transform("patterns", lambda p: p.withField("size_note", F.coalesce(p.getField("size_note"), F.lit(""))).withField("archived_at", F.when(~old, p.getField("archived_at"))))
    ).withColumn("format_version", F.lit(2))


def split(rows: DataFrame) -> dict[str, DataFrame]:
    """One table per part of the bundles, keyed by ledger."""
    out = {name: rows.select("ledger_id", F.inline(name)) for name in PARTS}
    out["version_line"] = out["usages"].select("ledger_id", "pattern_id", "version", F.inline("lines"))
    out["make_line"] = out["makes"].select("ledger_id", "make_id", F.inline("lines"))
    out["head"] = rows.select("ledger_id", "epoch", "seq", "low_stock_percent")
    return out


def export_stock(stock: DataFrame) -> DataFrame:
    """One JSON document a ledger with its stock in catalogue order (S3); a ledger has at most 221 rows."""
    row = F.struct(colour_key(F.col("code")).alias("key"), F.struct("code", "qty", "baseline").alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x.getField("row"))
    return stock.groupBy("ledger_id").agg(rows.alias("stock")).select("ledger_id", F.to_json(F.struct(F.lit(2).alias("format_version"), "ledger_id", "stock"), {"ignoreNullFields": "false"}).alias("json"))


def export_bundles(heads: DataFrame, tables: dict[str, DataFrame], exported_at: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """One JSON document a ledger with all its parts (S3): ``ledger_id``, ``json``, ``error``.

    ``heads``: ledger_id, epoch, seq, low_stock_percent; ``tables``: the parts by name, as
    :func:`split` gives them.  Stock comes in catalogue order, other parts by their fields.  A
    ledger with more than ``most_rows`` rows in a part is refused before anything is gathered.
    """
    rows = heads.select("ledger_id", "epoch", "seq", "low_stock_percent").withColumn("_large", F.lit(False))
    for part, kind in PARTS.items():
        counts = tables[part].groupBy("ledger_id").agg((F.count("*") > most_rows).alias("_over"))
        table = tables[part].join(counts.filter("not _over"), "ledger_id", "left_semi")
        row = F.struct(*[c for c in table.columns if c != "ledger_id"]).cast(kind)
        order = F.struct(colour_key(F.col("code")).alias("key"), row.alias("row")) if part == "stock" else F.struct(row.alias("row"))
        gathered = table.groupBy("ledger_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["row"]).alias(part))
        rows = rows.join(counts, "ledger_id", "left").join(gathered, "ledger_id", "left")
        rows = rows.withColumns({part: F.coalesce(part, F.array().cast(f"array<{kind}>")), "_large": F.col("_large") | F.coalesce("_over", F.lit(False))}).drop("_over")
    whole = F.struct(F.lit(2).alias("format_version"), F.lit(exported_at).alias("exported_at"), "ledger_id", "epoch", "seq", "low_stock_percent", *PARTS)
    return rows.select("ledger_id", F.when(~F.col("_large"), F.to_json(whole, {"ignoreNullFields": "false"})).alias("json"), F.when(F.col("_large"), "too-large").alias("error"))


def export_pieces(heads: DataFrame, tables: dict[str, DataFrame], exported_at: str, rows: int | None = None) -> DataFrame:
    """The same for ledgers of any size (S3): ``ledger_id``, ``json``, one document a piece.

    A ledger with at most ``rows`` rows in all is one piece.  A larger one has as many as its
    rows ask for, and each row's own content decides which piece it is in, so a ledger is dealt
    to all tasks and only a piece is gathered.
    """
    rows = PIECE_ROWS if rows is None else rows
    each = [tables[part].select("ledger_id", F.struct(*[c for c in tables[part].columns if c != "ledger_id"]).cast(kind).alias(part)) for part, kind in PARTS.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
    large = F.broadcast(every.groupBy("ledger_id").agg(F.ceil(F.count("*") / rows).cast("int").alias("pieces")).filter("pieces > 1"))  # fewer than rows / ``rows``
    dealt = every.withColumn("_hash", F.xxhash64(*PARTS)).join(large, "ledger_id", "left").withColumn("piece", F.pmod("_hash", F.coalesce("pieces", F.lit(1))).cast("int")).drop("_hash", "pieces")
    marks = heads.join(large, "ledger_id", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    marks = marks.select("ledger_id", F.struct("pieces", "epoch", "seq", "low_stock_percent").alias("head"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    keyed = F.when(F.col("stock").isNotNull(), F.struct(colour_key(F.col("stock.code")).alias("key"), F.col("stock").alias("row")))
    parts = {part: F.array_sort(F.collect_list(part)) for part in PARTS} | {"stock": F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["row"])}
    gathered = dealt.unionByName(marks, allowMissingColumns=True).repartition("ledger_id", "piece").groupBy("ledger_id", "piece").agg(F.max("head").alias("head"), *[c.alias(part) for part, c in parts.items()])
    whole = F.struct("piece", "head.pieces", F.lit(2).alias("format_version"), F.lit(exported_at).alias("exported_at"), "ledger_id", "head.epoch", "head.seq", "head.low_stock_percent", *PARTS)
    return gathered.filter("head is not null").select("ledger_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def read_pieces(rows: DataFrame, palette: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pieces of a column ``json``, and ``ledger_id``, ``error`` of each ledger: null, or why it is refused.

    A document that says nothing of pieces is its ledger's only one.  What holds for a bundle
    holds for all pieces of a ledger together: each is there once with the same head, names are
    alone, named patterns and the catalogue's colours are there.
    """
    read = rows.select(F.from_json("json", PIECE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("b")).select("b.*")
    pieces = checked(stored(read.withColumns({"piece": F.coalesce("piece", F.lit(0)), "pieces": F.coalesce("pieces", F.lit(1))})), palette, whole_bundles=False)
    names = lambda kind, values, own: F.transform(values, lambda k: F.struct(F.lit(kind).alias("kind"), k.cast("string").alias("name"), F.lit(own).alias("own")))
    every = lambda part, field: F.transform(part, lambda x: x[field])
    used = F.array_except(F.concat(every("usages", "pattern_id"), every("makes", "pattern_id")), every("patterns", "pattern_id"))
    listed = pieces.select("ledger_id", F.inline(F.concat(names("piece", F.array("piece"), 1), names("patterns", used, 0), *[names(part, every(part, field), 1) for part, field in NAMES.items()])))
    faulty = listed.groupBy("ledger_id", "kind", "name").agg(F.sum("own").alias("n")).filter("n <> 1").select("ledger_id", F.lit(True).alias("_faulty")).distinct()
    head = F.struct("pieces", "format_version", "exported_at", "epoch", "seq", "low_stock_percent")
    ledgers = pieces.groupBy("ledger_id").agg(F.max("error").alias("error"), (F.min(head).eqNullSafe(F.max(head)) & (F.count("*") == F.max("pieces")) & (F.min("piece") >= 0) & (F.max("piece") < F.max("pieces"))).alias("_all"), F.sum(F.size("stock")).alias("_colours"))
    right = F.col("_all") & F.col("_faulty").isNull() & (F.lit(True) if palette is None else F.col("_colours") == len(_catalogue(palette)))
    return pieces, ledgers.join(faulty, "ledger_id", "left").select("ledger_id", F.coalesce("error", F.when(~F.coalesce(right, F.lit(False)), "invalid-backup")).alias("error"))


def counters(live: dict[str, DataFrame], backup: dict[str, DataFrame]) -> DataFrame:
    """Per ledger what a restore would change (A5): stock rows that differ, and percents, patterns, makes and movements before and after; whether all thumbnails are there."""
    rows = live["head"].select("ledger_id", F.col("low_stock_percent").alias("percent_before")).join(backup["head"].select("ledger_id", F.col("low_stock_percent").alias("percent_after")), "ledger_id", "full")
    changed = stock_difference(backup["stock"], live["stock"]).groupBy("ledger_id").agg(F.count("*").alias("stock_changed"))
    rows = rows.join(changed, "ledger_id", "left")
    for part in ("patterns", "makes", "movements"):
        for when, tables in (("before", live), ("after", backup)):
            rows = rows.join(tables[part].groupBy("ledger_id").agg(F.count("*").alias(f"{part}_{when}")), "ledger_id", "left")
    whole = backup["patterns"].groupBy("ledger_id").agg(F.bool_and(F.coalesce(F.length("thumbnail.base64") > 0, F.lit(False))).alias("thumbnails"))
    return rows.join(whole, "ledger_id", "left").fillna(0).withColumn("thumbnails", F.coalesce("thumbnails", F.lit(True)))


def write_bundles(bundles: DataFrame, path: str) -> None:
    """One line of JSON a ledger; every task writes its own files."""
    bundles.select("json").write.mode("overwrite").text(path)


def effective(snapshots: DataFrame, valid: Column) -> DataFrame:
    """The pending document where the pointer names it and it is valid, else the live one."""
    use = (F.col("pointer") == "pending") & F.coalesce(valid, F.lit(False))
    return snapshots.select("ledger_id", F.when(use, F.col("pending")).otherwise(F.col("live")).alias("document"), F.when(use, "pending").otherwise("live").alias("slot"))
