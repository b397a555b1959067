"""Data-quality rules over the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules as R
from ..sources.bundles import effective
from ..sources.views import _CODE, CODE, Views
from .registry import query

_ROW = "SELECT CAST({ledger} AS VARCHAR) AS ledger_id, '{rule}' AS rule, CAST({key} AS VARCHAR) AS key, '{detail}' AS detail FROM {source}"


def _row(rule: str, key: str, detail: str, source: str, ledger: str = "ledger_id") -> str:
    return _ROW.format(rule=rule, key=key, detail=detail, source=source, ledger=ledger)


@query(_row("V1", "ledger_id", "epoch, seq or percent out of range", "(SELECT ledger_id, max(qty) AS m FROM v_cmd GROUP BY 1) WHERE m > 100 OR m IS NULL"))
def rule_heads(v: Views) -> DataFrame:
    return R.heads(v.cmd.groupBy("ledger_id").agg(F.max("seq").alias("seq"), F.max("qty").alias("low_stock_percent")).withColumn("epoch", F.lit(0)))


_HAS = f"SELECT DISTINCT l.l_suppkey AS ledger_id, p.* FROM (SELECT l_suppkey, {_CODE.format(p='l_partkey')} AS code FROM lineitem) l JOIN v_palette p ON p.code = l.code"


@query(_row("V2", "code", "colour missing", f"(SELECT s.ledger_id, p.code FROM (SELECT DISTINCT ledger_id FROM ({_HAS})) s, v_palette p EXCEPT SELECT ledger_id, code FROM ({_HAS}))") + " UNION ALL " + _row("V2", "code", "colour invalid", f"({_HAS}) WHERE r + 20 > 255"))
def rule_palette(v: Views) -> DataFrame:
    has = v.table("lineitem").select(F.col("l_suppkey").alias("ledger_id"), F.expr(CODE.format(p="l_partkey")).alias("code")).distinct().join(F.broadcast(v.palette), "code")
    return R.palette(has.withColumn("r", F.col("r") + 20))


@query(_row("V3", "code", "not in the catalogue", "v_stock WHERE code NOT IN (SELECT code FROM v_palette)") + " UNION ALL " + _row("V3", "code", "missing", "(SELECT DISTINCT ledger_id FROM v_stock) l, v_palette p WHERE (l.ledger_id, p.code) NOT IN (SELECT ledger_id, code FROM v_stock)"))
def rule_stock(v: Views) -> DataFrame:
    return R.stock(v.stock, v.palette)


@query(_row("V4", "seq", "operation type or id", "v_cmd WHERE event_id % 90 = 0"))
def rule_operations(v: Views) -> DataFrame:
    return R.operations(v.cmd.withColumn("op_type", F.when(F.col("event_id") % 90 == 0, "other").otherwise(F.col("op_type"))))


@query(_row("V5", "seq || '/' || code", "delta or range", "v_move WHERE seq % 7 = 0 OR qty_after IS NULL OR qty_before IS NULL OR qty_after < 0 OR qty_before < 0"))
def rule_moves(v: Views) -> DataFrame:
    return R.moves(v.move.withColumn("delta", F.col("delta") + (F.col("seq") % 7 == 0).cast("int")))


@query(_row("V6", "pattern_id", "name or thumbnail", "v_pattern WHERE pattern_id % 9 = 0 OR pattern_id % 5 = 1"))
def rule_patterns(v: Views) -> DataFrame:
    rows = v.pattern.withColumns({"name": F.when(F.col("pattern_id") % 9 == 0, "  ").otherwise(F.col("name")), "thumbnail": F.when(F.col("pattern_id") % 5 == 1, "/data/x").when(F.col("pattern_id") % 5 == 2, "QUJD"), "thumb_mime": F.lit("image/png")})
    return R.patterns(rows)


@query(_row("V7", "pattern_id || '/' || version || '/' || code", "not in the catalogue", "v_version WHERE code NOT IN (SELECT code FROM v_palette)", "NULL"))
def rule_usage(v: Views) -> DataFrame:
    return R.usage(v.version, v.palette, ["pattern_id", "version"])


@query(_row("V19", "pattern_id || '/' || code", "repeated code", "(SELECT pattern_id, code FROM v_version WHERE code IN (SELECT code FROM v_palette) GROUP BY 1, 2 HAVING count(*) > 1)", "NULL"))
def rule_drafts(v: Views) -> DataFrame:
    return R.usage(v.version.join(F.broadcast(v.palette.select("code")), "code"), v.palette, ["pattern_id"], "V19")


@query(_row("V8", "pattern_id || '/' || confirmed_version", "current version missing", "v_pattern WHERE confirmed_version IS NOT NULL AND (pattern_id, confirmed_version) NOT IN (SELECT pattern_id, version FROM v_version)", "NULL"))
def rule_versions(v: Views) -> DataFrame:
    return R.versions(v.version.select("pattern_id", "version").distinct(), v.pattern)


@query(_row("V9", "pattern_id || '/' || version", "version missing", "v_make WHERE (pattern_id, version) NOT IN (SELECT pattern_id, version FROM v_version)"))
def rule_makes(v: Views) -> DataFrame:
    return R.makes(v.make, v.pattern.select("pattern_id"), v.version.select("pattern_id", "version").distinct())


_DONE = "(SELECT ledger_id, seq, CASE WHEN event_id % 3 = 0 THEN event_id % 70 END AS pattern_id, CASE WHEN event_id % 5 = 0 THEN event_id % 60 END AS make_id FROM v_cmd WHERE op_type <> 'make')"


@query(
    _row("V10", "ledger_id || '/' || seq", "operation missing", "v_move WHERE (ledger_id, seq) IN (SELECT ledger_id, seq FROM v_cmd WHERE op_type = 'make')")
    + " UNION ALL " + _row("V10", "ledger_id || '/' || seq || '/' || pattern_id", "pattern missing", _DONE + " WHERE pattern_id IS NOT NULL AND (ledger_id, pattern_id) NOT IN (SELECT ledger_id, pattern_id FROM v_pattern)")
    + " UNION ALL " + _row("V10", "ledger_id || '/' || seq || '/' || make_id", "make missing", _DONE + " WHERE make_id IS NOT NULL AND (ledger_id, make_id) NOT IN (SELECT ledger_id, make_id FROM v_make)")
)
def rule_references(v: Views) -> DataFrame:
    done = v.cmd.filter("op_type <> 'make'").selectExpr("ledger_id", "seq", "if(event_id % 3 = 0, event_id % 70, null) as pattern_id", "if(event_id % 5 = 0, event_id % 60, null) as make_id")
    return R.references(v.move, done, v.pattern, v.make)


@query(_row("V11", "seq", "request id", "v_cmd WHERE event_id % 50 = 0") + " UNION ALL " + _row("V11", "seq", "result", "v_cmd WHERE event_id % 50 <> 0 AND (event_id % 30 = 1 OR event_id % 31 = 1 OR event_id % 32 = 1) OR event_id % 50 = 0"))
def rule_requests(v: Views) -> DataFrame:
    """A result is wrong with a request without an id, if it isn't ok, has no operation, or a negative number."""
    rows = v.cmd.withColumn("request_id", F.when(F.col("event_id") % 50 == 0, "").otherwise(F.col("request_id"))).withColumn("payload", F.coalesce("payload", F.lit("")))
    result = F.struct((F.col("event_id") % 30 != 1).alias("ok"), "request_id", F.when(F.col("event_id") % 31 != 1, "op").alias("operation_id"), F.when(F.col("event_id") % 32 == 1, -1).otherwise(F.col("seq")).alias("seq"))
    return R.requests(rows.withColumn("result", result))


def _lists(v: Views) -> DataFrame:
    line = F.struct("code", "qty")
    return v.usage.groupBy("pattern_id").agg(F.array_sort(F.collect_list(line)).alias("candidates"))


@query(" UNION ALL ".join([
    _row("V12", "pattern_id", "enums", "(SELECT DISTINCT pattern_id FROM v_usage) WHERE pattern_id % 13 = 0", "NULL"),
    _row("V12", "pattern_id", "review", "(SELECT DISTINCT pattern_id FROM v_usage) WHERE pattern_id % 2 = 1 AND pattern_id % 3 <> 0", "NULL"),
    _row("V12", "pattern_id", "modified", "(SELECT DISTINCT pattern_id FROM v_usage) WHERE pattern_id % 7 = 0", "NULL"),
    _row("V12", "pattern_id", "unknown code", "v_usage WHERE code NOT IN (SELECT code FROM v_palette)", "NULL"),
]))
def rule_provenance(v: Views) -> DataFrame:
    risk = F.array(F.struct(F.lit("r1").alias("id"), F.lit("why").alias("reason"), F.lit("").alias("raw"), (F.col("pattern_id") % 2 == 0).alias("resolved")))
    rows = _lists(v).select("pattern_id", F.when(F.col("pattern_id") % 13 == 0, "other").otherwise("legend").alias("source"), F.lit("partial").alias("status"), "candidates", risk.alias("risks"), (F.col("pattern_id") % 3 == 0).alias("acknowledged"), (F.col("pattern_id") % 7 == 0).alias("modified"), F.col("candidates").alias("final"))
    return R.provenance(rows, v.palette)


@query(" UNION ALL ".join([
    _row("V13", "pattern_id", "total", "(SELECT DISTINCT pattern_id FROM v_usage) WHERE pattern_id % 5 = 0", "NULL"),
    _row("V13", "pattern_id", "content", "(SELECT DISTINCT pattern_id FROM v_usage) WHERE pattern_id % 4 = 0", "NULL"),
    _row("V13", "pattern_id", "title", "(SELECT DISTINCT pattern_id FROM v_usage) WHERE pattern_id % 9 = 0", "NULL"),
    _row("V13", "pattern_id", "image", "(SELECT DISTINCT pattern_id FROM v_usage) WHERE pattern_id % 11 = 0 AND pattern_id % 4 <> 0", "NULL"),
]))
def rule_recognition(v: Views) -> DataFrame:
    total = F.aggregate("candidates", F.lit(0).cast("bigint"), lambda s, c: s + c.getField("qty"))
    rows = _lists(v).selectExpr("pattern_id as image_id", "candidates", "case when pattern_id % 4 = 0 then 'failed' else 'ready' end as status", "'legend' as source", "10 as n_evidence", "0 as n_doubts", "case when pattern_id % 9 = 0 then -1 end as title_total", "case when pattern_id % 11 = 0 then 0 else 100 end as width", "100 as height")
    return R.recognition(rows.withColumn("total", total + (F.col("image_id") % 5 == 0).cast("int")))


@query(_row("V16", "doc_id", "forbidden content", "v_docs WHERE text IS NOT NULL AND (doc_id % 20 = 0 OR contains(text, 'keystore') OR contains(text, 'privateKey'))", "NULL"))
def rule_forbidden(v: Views) -> DataFrame:
    return R.forbidden(v.docs.filter("text is not null").select(F.col("doc_id").alias("key"), F.to_json(F.struct("text", F.when(F.col("doc_id") % 20 == 0, "").alias("originalImage"))).alias("json")))


@query(_row("V17", "CASE WHEN ledger_id % 3 = 0 THEN 'pending' ELSE 'other' END", "snapshot pointer", "(SELECT DISTINCT ledger_id FROM v_stock) WHERE ledger_id % 3 <> 1"))
def rule_pointers(v: Views) -> DataFrame:
    ids = v.stock.select("ledger_id").distinct()
    return R.pointers(ids.selectExpr("ledger_id", "case ledger_id % 3 when 0 then 'pending' when 1 then 'live' else 'other' end as pointer", "'x' as live", "cast(null as string) as pending"))


@query("SELECT DISTINCT ledger_id, CASE WHEN ledger_id % 3 = 0 THEN 'p' ELSE 'l' END AS document, CASE WHEN ledger_id % 3 = 0 THEN 'pending' ELSE 'live' END AS slot FROM v_stock")
def effective_snapshots(v: Views) -> DataFrame:
    ids = v.stock.select("ledger_id").distinct()
    rows = ids.selectExpr("ledger_id", "case when ledger_id % 3 < 2 then 'pending' else 'live' end as pointer", "'l' as live", "'p' as pending")
    return effective(rows, F.col("ledger_id") % 3 == 0)


_CONFIRMED = "(SELECT DISTINCT pattern_id FROM v_version) WHERE "


@query(" UNION ALL ".join(_row("V18", "pattern_id", detail, _CONFIRMED + wrong, "NULL") for detail, wrong in (
    ("recognition and input method", "pattern_id % 6 = 1 OR (pattern_id % 2 = 0 AND pattern_id % 3 <> 1)"), ("version", "pattern_id % 41 = 0"), ("confirmed_at", "pattern_id % 43 = 0"), ("title_total", "pattern_id % 47 = 0"), ("title_acknowledged", "pattern_id % 53 = 0"), ("rejected", "pattern_id % 59 = 0"),
)))
def rule_confirmed(v: Views) -> DataFrame:
    rows = v.version.select("pattern_id").distinct().selectExpr(
        "pattern_id", "case when pattern_id % 2 = 1 then 'manual' else 'legend' end as input_method", "case when pattern_id % 3 = 1 then 'legend' when pattern_id % 3 = 2 and pattern_id % 2 = 0 then 'grid' end as recognition_source",
        "if(pattern_id % 41 = 0, null, 1) as version", "if(pattern_id % 43 = 0, ' ', 'now') as confirmed_at", "if(pattern_id % 47 = 0, -1, nullif(pattern_id % 4, 0)) as title_total", "nullif(pattern_id % 3, 0) as title_diff", "if(pattern_id % 53 = 0, null, true) as title_acknowledged",
        "array(named_struct('raw', 'r', 'qty', cast(if(pattern_id % 59 = 0, -1, null) as bigint), 'note', '')) as rejected",
    )
    return R.confirmed(rows)


@query(_row("O7", "image_id", "more than 5 rows", "(SELECT image_id FROM v_box GROUP BY 1 HAVING count(*) > 5)", "NULL"))
def rule_caps(v: Views) -> DataFrame:
    return R.over_cap(v.box, ["image_id"], 5)


_STOCK = _row("V3", "code", "not in the catalogue", "v_stock WHERE code NOT IN (SELECT code FROM v_palette)") + " UNION ALL " + _row("V3", "code", "missing", "(SELECT DISTINCT ledger_id FROM v_stock) l, v_palette p WHERE (l.ledger_id, p.code) NOT IN (SELECT ledger_id, code FROM v_stock)")


@query(" UNION ALL ".join([
    _STOCK,
    _row("V5", "seq || '/' || code", "delta or range", "v_move WHERE qty_after IS NULL OR qty_before IS NULL OR qty_after < 0 OR qty_before < 0"),
    _row("V7", "pattern_id || '/' || version || '/' || code", "not in the catalogue", "v_version WHERE code NOT IN (SELECT code FROM v_palette)", "NULL"),
    _row("V19", "pattern_id || '/' || code", "not in the catalogue", "v_usage WHERE code NOT IN (SELECT code FROM v_palette)", "NULL"),
    _row("V8", "pattern_id || '/' || confirmed_version", "current version missing", "v_pattern WHERE confirmed_version IS NOT NULL AND (pattern_id, confirmed_version) NOT IN (SELECT pattern_id, version FROM v_version)", "NULL"),
    _row("V9", "pattern_id || '/' || version", "version missing", "v_make WHERE (pattern_id, version) NOT IN (SELECT pattern_id, version FROM v_version)"),
    _row("V12", "pattern_id", "modified", "(SELECT DISTINCT pattern_id FROM v_usage) WHERE pattern_id % 7 = 0", "NULL"),
    _row("V12", "pattern_id", "unknown code", "v_usage WHERE code NOT IN (SELECT code FROM v_palette)", "NULL"),
    _row("V13", "pattern_id", "title", "(SELECT DISTINCT pattern_id FROM v_usage) WHERE pattern_id % 9 = 0", "NULL"),
    _row("V16", "doc_id", "forbidden content", "v_docs WHERE contains(text, 'keystore') OR contains(text, 'privateKey')", "NULL"),
    _row("V17", "'pending'", "snapshot pointer", "(SELECT DISTINCT ledger_id FROM v_stock) WHERE ledger_id % 3 = 0"),
    _row("V18", "pattern_id", "recognition and input method", "(SELECT DISTINCT pattern_id FROM v_version) WHERE pattern_id % 6 = 1", "NULL"),
    _row("O7", "image_id", "more than 256 rows", "(SELECT image_id FROM v_place GROUP BY 1 HAVING count(*) > 256)", "NULL"),
]))
def violations(v: Views) -> DataFrame:
    """All rules in one job over the derived tables."""
    heads = v.cmd.groupBy("ledger_id").agg(F.max("seq").alias("seq")).selectExpr("ledger_id", "seq", "cast(0 as bigint) as epoch", "10 as low_stock_percent")
    lists, none = _lists(v), "cast(array() as array<struct<id:string,reason:string,raw:string,resolved:boolean>>)"
    provenance = lists.selectExpr("pattern_id", "'legend' as source", "'partial' as status", "candidates", f"{none} as risks", "true as acknowledged", "pattern_id % 7 = 0 as modified", "candidates as final")
    total = F.aggregate("candidates", F.lit(0).cast("bigint"), lambda s, c: s + c.getField("qty"))
    recognition = lists.selectExpr("pattern_id as image_id", "candidates", "'ready' as status", "'legend' as source", "10 as n_evidence", "0 as n_doubts", "case when pattern_id % 9 = 0 then -1 end as title_total", "100 as width", "100 as height").withColumn("total", total)
    ids = v.version.select("pattern_id").distinct()
    return R.validate({
        "palette": v.palette, "stock": v.stock, "operation": v.cmd, "movement": v.move, "pattern": v.pattern, "version": v.version.select("pattern_id", "version").distinct(), "version_line": v.version, "make": v.make, "head": heads,
        "draft_line": v.usage, "provenance": provenance, "recognition": recognition, "confirmed": ids.selectExpr("pattern_id", "case when pattern_id % 2 = 1 then 'manual' else 'legend' end as input_method", "case when pattern_id % 6 = 1 or pattern_id % 2 = 0 then 'legend' end as recognition_source"),
        "document": v.docs.select(F.col("doc_id").alias("key"), F.to_json(F.struct("text")).alias("json")), "pointer": v.stock.select("ledger_id").distinct().selectExpr("ledger_id", "case when ledger_id % 3 = 0 then 'pending' else 'live' end as pointer", "'x' as live", "cast(null as string) as pending"), "box": v.place,
    })
