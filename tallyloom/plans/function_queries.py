"""Scalar functions over the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes, quantities, shapes, texts
from ..operators import commands as C
from ..sources.views import Views
from .registry import query

_REASON = "CASE WHEN {x} IS NULL OR trim({x}) = '' THEN 'empty' WHEN regexp_full_match(trim({x}), '[0-9]+') THEN CASE WHEN regexp_matches(trim({x}), '^0[0-9]') THEN 'invalid' WHEN length(trim({x})) > 10 OR TRY_CAST(trim({x}) AS BIGINT) > 1000000000 THEN 'overflow' END WHEN starts_with(trim({x}), '-') THEN 'negative' WHEN contains(trim({x}), '.') THEN 'decimal' ELSE 'invalid' END"


@query("SELECT event_id, code, CASE WHEN regexp_full_match(upper(trim(lower(code))), '[A-HM][0-9]+') THEN code END AS plain, CASE WHEN regexp_full_match(code, '[A-HM][0-9]+') THEN instr('ABCDEFGHM', substr(code, 1, 1)) ELSE 99 END AS gi FROM v_cmd")
def parsed_codes(v: Views) -> DataFrame:
    raw = F.concat(F.lit(" "), F.lower(F.substring("code", 1, 1)), F.lit("0"), F.substring("code", 2, 9))
    return v.cmd.select("event_id", "code", codes.plain_code(raw).alias("plain"), codes.colour_key(F.col("code")).getField("gi").alias("gi"))


@query("SELECT event_id, code FROM v_cmd WHERE code IN (SELECT code FROM v_palette)")
def accepted_codes(v: Views) -> DataFrame:
    return codes.in_catalogue(v.cmd.select("event_id", F.lower("code").alias("code")), v.palette)


@query("SELECT event_id, code FROM v_cmd WHERE code NOT IN (SELECT code FROM v_palette)")
def rejected_codes(v: Views) -> DataFrame:
    return codes.off_catalogue(v.cmd.select("event_id", "code"), v.palette)


@query("SELECT doc_id, CASE WHEN regexp_full_match(split_part(text, ' ', 1), '[A-Z]+[0-9]+') THEN regexp_replace(split_part(text, ' ', 1), '^([A-Z]+)0*([0-9])', '\\1\\2') END AS code FROM v_docs")
def strict_codes(v: Views) -> DataFrame:
    return v.docs.select("doc_id", codes.strict_code(F.split_part("text", F.lit(" "), F.lit(1))).alias("code"))


_NUMBER = "CASE doc_id % 8 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN '-' || doc_id WHEN 2 THEN doc_id || '.5' WHEN 3 THEN '0' || doc_id WHEN 4 THEN doc_id || '000000000' WHEN 5 THEN ' ' || doc_id || ' ' WHEN 6 THEN '' ELSE text END"


@query(f"WITH n AS (SELECT doc_id, {_NUMBER} AS x FROM v_docs) SELECT doc_id, CASE WHEN ({_REASON.format(x='x')}) IS NULL THEN TRY_CAST(trim(x) AS BIGINT) END AS value, {_REASON.format(x='x')} AS reason FROM n")
def parsed_quantities(v: Views) -> DataFrame:
    raw = F.expr("case doc_id % 8 when 0 then cast(doc_id as string) when 1 then concat('-', doc_id) when 2 then concat(doc_id, '.5') when 3 then concat('0', doc_id) when 4 then concat(doc_id, '000000000') when 5 then concat(' ', doc_id, ' ') when 6 then '' else text end")
    return v.docs.select("doc_id", quantities.parse_quantity(raw).alias("p")).select("doc_id", "p.value", "p.reason")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '数量不能为空' WHEN 1 THEN '数量不能为负数' ELSE '数量不是有效整数' END AS message FROM v_docs")
def quantity_messages(v: Views) -> DataFrame:
    return v.docs.select("doc_id", quantities.quantity_message(F.element_at(F.array(F.lit("empty"), F.lit("negative"), F.lit("other")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("message"))


@query("SELECT event_id, CASE WHEN qty BETWEEN 0 AND 100 THEN qty END AS percent FROM v_cmd")
def parsed_percents(v: Views) -> DataFrame:
    return v.cmd.select("event_id", quantities.parse_percent(F.col("qty").cast("string")).getField("value").alias("percent"))


@query("SELECT t.pattern_id, t.title_total - s.total AS difference, t.title_total <> s.total AND NOT t.ack AS blocked FROM v_title t JOIN (SELECT pattern_id, CAST(sum(qty) AS BIGINT) AS total FROM v_usage GROUP BY 1) s ON s.pattern_id = t.pattern_id")
def title_differences(v: Views) -> DataFrame:
    rows = v.title.join(v.usage.groupBy("pattern_id").agg(F.sum("qty").alias("total")), "pattern_id")
    return rows.select("pattern_id", quantities.title_difference(F.col("title_total"), F.col("total")).alias("difference"), quantities.title_blocked(F.col("title_total"), F.col("total"), F.col("ack")).alias("blocked"))


_FIELD = "CASE doc_id % 4 WHEN 0 THEN '=' || text WHEN 1 THEN text || ', \"x\"' WHEN 2 THEN text ELSE '-' || text || chr(10) END"


@query(f"""WITH a AS (SELECT doc_id, {_FIELD} AS x FROM v_docs), b AS (SELECT doc_id, CASE WHEN regexp_matches(x, '^[=+@-]') THEN '''' || x ELSE x END AS x FROM a)
SELECT doc_id, CASE WHEN contains(x, '"') OR contains(x, ',') OR contains(x, chr(10)) OR contains(x, chr(13)) THEN '"' || replace(x, '"', '""') || '"' ELSE x END AS field FROM b""")
def csv_fields(v: Views) -> DataFrame:
    raw = F.expr("""case doc_id % 4 when 0 then concat('=', text) when 1 then concat(text, ', "x"') when 2 then text else concat('-', text, '\n') end""")
    return v.docs.select("doc_id", texts.csv_field(raw).alias("field"))


@query("""SELECT event_id, sha256('{"code":"' || code || '","kind":"' || op_type || '","qty":' || coalesce(CAST(qty AS VARCHAR), 'null') || '}') AS key FROM v_cmd""")
def payload_keys(v: Views) -> DataFrame:
    return v.cmd.select("event_id", texts.payload_key(texts.canonical_json(kind=F.col("op_type"), code=F.col("code"), qty=F.col("qty"))).alias("key"))


@query("""WITH i AS (SELECT ledger_id, request_id, '[' || string_agg('{"code":"' || code || '","flag":' || (qty % 2) || ',"qty":"' || qty || '"}', ',' ORDER BY code, qty % 2, CAST(qty AS VARCHAR)) || ']' AS snapshot FROM v_cmd WHERE qty IS NOT NULL GROUP BY 1, 2) SELECT ledger_id, request_id, sha256(snapshot) AS snapshot FROM i""")
def batch_snapshots(v: Views) -> DataFrame:
    item = F.struct("code", F.concat(F.lit(" "), F.col("qty").cast("string")).alias("qty"), (F.col("qty") % 2 == 1).alias("estimated"))
    return v.cmd.filter("qty is not null").groupBy("ledger_id", "request_id").agg(F.collect_list(item).alias("items")).select("ledger_id", "request_id", texts.payload_key(texts.canonical_items(F.col("items"))).alias("snapshot"))


@query("SELECT doc_id, nullif(trim(text), '') AS name, coalesce(nullif(trim(CASE WHEN doc_id % 2 = 1 THEN text END), ''), '未注明') AS size_note FROM v_docs")
def cleaned_meta(v: Views) -> DataFrame:
    return v.docs.select("doc_id", texts.clean_name(F.expr("concat(' ', text)")).alias("name"), texts.size_label(F.expr("case when doc_id % 2 = 1 then text end")).alias("size_note"))


@query("SELECT pattern_id, version, CASE version WHEN 1 THEN '手工录入' ELSE '来源未知' END AS label FROM v_version GROUP BY 1, 2")
def source_labels(v: Views) -> DataFrame:
    return v.version.select("pattern_id", "version").distinct().withColumn("label", texts.source_label(F.when(F.col("version") == 1, "manual").otherwise("other")))


@query("SELECT doc_id, substr(text, 1, 100) AS short, length(text) > 100 AS cut FROM v_docs")
def shortened_texts(v: Views) -> DataFrame:
    return v.docs.select("doc_id", texts.shortened(F.col("text"), 100).alias("short"), (F.length("text") > 100).alias("cut"))


@query("SELECT pattern_id, u.code, CASE grp WHEN 'A' THEN '黄橙' WHEN 'B' THEN '绿色' WHEN 'C' THEN '蓝青' WHEN 'D' THEN '蓝紫' WHEN 'E' THEN '粉玫' WHEN 'F' THEN '红色' WHEN 'G' THEN '棕肤' WHEN 'H' THEN '黑白' ELSE '大地' END AS name, row_number() OVER (PARTITION BY pattern_id ORDER BY gi, n) AS place FROM v_usage u JOIN v_palette p ON p.code = u.code")
def palette_order(v: Views) -> DataFrame:
    rows = codes.in_catalogue(v.usage.select("pattern_id", "code"), v.palette)
    place = F.row_number().over(W.partitionBy("pattern_id").orderBy(codes.colour_key(F.col("code"))))
    return rows.select("pattern_id", "code", codes.group_name(F.substring("code", 1, 1)).alias("name"), place.cast("long").alias("place"))


@query("SELECT image_id, id, CASE WHEN x + w <= 181 AND y + h <= 51 THEN x END AS x FROM v_box")
def valid_regions(v: Views) -> DataFrame:
    return v.box.select("image_id", "id", shapes.valid_region(F.array("x", "y", "w", "h"), F.lit(180), F.lit(50)).getItem(0).alias("x"))


@query("SELECT image_id, id, CASE WHEN id % 9 >= 5 THEN h ELSE w END AS width, CASE WHEN id % 9 >= 5 THEN w ELSE h END AS height, CASE WHEN w * 10 > h * 8 AND w * 10 < h * 12 AND x > w * 4 THEN 'beside' WHEN w * 100 > h * 65 AND w * 10 < h * 12 THEN 'below' WHEN w > h * 3 THEN 'inline' ELSE 'right' END AS kind, abs(x - 100) * 5 > w AS off FROM v_box")
def box_kinds(v: Views) -> DataFrame:
    shown = shapes.oriented(F.col("w"), F.col("h"), F.col("id") % 9)
    return v.box.select("image_id", "id", shown.getField("width").alias("width"), shown.getField("height").alias("height"), shapes.layout_kind(F.col("w"), F.col("h"), F.col("x")).alias("kind"), shapes.off_centre(F.col("x"), F.lit(100), F.col("w")).alias("off"))


_LEGEND = "CASE doc_id % 4 WHEN 0 THEN 'C' || doc_id || '(' || doc_id || ')' WHEN 1 THEN 'A1(12x)' WHEN 2 THEN 'B2(99999999999)' ELSE text END"


@query(f"WITH t AS (SELECT doc_id, {_LEGEND} AS t FROM v_docs) SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN regexp_extract(t, '^([A-Z][0-9]+)', 1) END AS code, CASE WHEN doc_id % 4 = 0 THEN doc_id END AS value, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 2 THEN 'overflow' ELSE 'invalid' END AS reason FROM t")
def legend_texts(v: Views) -> DataFrame:
    text = F.expr("case doc_id % 4 when 0 then concat('C', doc_id, '(', doc_id, ')') when 1 then 'A1(12x)' when 2 then 'B2(99999999999)' else text end")
    return v.docs.select("doc_id", texts.legend_text(text).alias("t")).select("doc_id", "t.code", "t.value", "t.reason")


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'MARD' END AS brand, CASE doc_id % 3 WHEN 0 THEN '221' END AS palette FROM v_docs")
def brand_marks(v: Views) -> DataFrame:
    text = F.expr("case doc_id % 3 when 0 then 'Mard-2 21' when 1 then ' mard' else 'Mardi' end")
    return v.docs.select("doc_id", texts.brand_mark(text).alias("m")).select("doc_id", "m.brand", "m.palette")


_STORED = "text || CASE doc_id % 9 WHEN 0 THEN ' /home/x' WHEN 1 THEN ' originalImage' WHEN 2 THEN ' keystore' WHEN 3 THEN ' C:' || chr(92) || 'Users' ELSE '' END"


@query(f"SELECT doc_id, contains(x, 'originalImage') OR contains(x, 'originalFullImage') OR contains(x, '/home/') OR contains(x, '/data/user/') OR contains(x, 'C:' || chr(92) || 'Users') AS forbidden, contains(x, 'keystore') OR contains(x, 'privateKey') AS refused, doc_id % 4 = 0 AS thumbnail, doc_id % 2 = 0 AS keys FROM (SELECT doc_id, {_STORED} AS x FROM v_docs)")
def stored_text_checks(v: Views) -> DataFrame:
    json = F.to_json(F.struct(F.expr("concat(text, case doc_id % 9 when 0 then ' /home/x' when 1 then ' originalImage' when 2 then ' keystore' when 3 then concat(' C:', char(92), 'Users') else '' end)").alias("text")))
    data = F.expr("substr('AAAABBBBCC==', 1, int(4 + doc_id % 4))")
    keys = F.expr("""case when doc_id % 2 = 0 then '{"id":1,"raw":""}' else '{"id":1,"extra":2}' end""")
    known = F.col("text").isNotNull()
    return v.docs.select("doc_id", F.when(known, texts.forbidden_content(json)).alias("forbidden"), F.when(known, texts.refused_content(json)).alias("refused"), texts.thumbnail_holds(F.lit("image/png"), data).alias("thumbnail"), texts.only_keys(keys, ["id", "raw"]).alias("keys"))


@query("SELECT image_id, row, col, x, greatest(abs(r - 128), abs(g - 128), abs(b - 128)) AS channel, (r - 128) * (r - 128) + (g - 128) * (g - 128) + (b - 128) * (b - 128) AS square, greatest(abs(r - g), abs(g - b)) < 5 AS flat FROM v_cell")
def colour_distances(v: Views) -> DataFrame:
    rows = v.cell.select("image_id", "row", "col", "x", *[F.col(k).alias(f"c{k}") for k in "rgb"], *[F.lit(128).alias(f"m{k}") for k in "rgb"])
    flat = shapes.flat([F.least("cr", "cg"), F.least("cg", "cb")], [F.greatest("cr", "cg"), F.greatest("cg", "cb")])
    return rows.select("image_id", "row", "col", "x", shapes.channel_distance("c", "m").alias("channel"), shapes.square_distance("c", "m").alias("square"), flat.alias("flat"))


@query("SELECT ledger_id, seq, code, delta, qty_after - qty_before = delta AS holds FROM v_move")
def movement_deltas(v: Views) -> DataFrame:
    return v.move.select("ledger_id", "seq", "code", "delta", quantities.delta_holds(F.col("qty_before"), F.col("qty_after"), F.col("delta")).alias("holds"))


@query("SELECT ledger_id, code, count(*) AS n FROM v_cmd WHERE code IN (SELECT code FROM v_palette) GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_codes(v: Views) -> DataFrame:
    return codes.in_catalogue(v.cmd, v.palette).groupBy("ledger_id", "code").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT o_orderkey, o_totalprice <= 200000 AS holds FROM orders")
def rejected_items(v: Views) -> DataFrame:
    items = F.expr("array(named_struct('raw', 'x', 'note', '', 'qty', cast(null as bigint)), named_struct('raw', '', 'note', 'n', 'qty', cast(if(o_totalprice <= 200000, 5, -1) as bigint)))")
    return v.table("orders").select("o_orderkey", texts.rejected_items_hold(items).alias("holds"))


@query("SELECT o_orderkey, 'op-' || sha256(CAST(o_orderkey AS VARCHAR)) AS id FROM orders")
def stable_ids(v: Views) -> DataFrame:
    return v.table("orders").select("o_orderkey", texts.new_id("op", F.col("o_orderkey")).alias("id"))


@query("SELECT a.image_id, a.id, a.x <= 2 OR a.y <= 2 OR a.x + a.w >= 42 OR a.y + a.h >= 22 AS clipped FROM v_place a")
def clipped_boxes(v: Views) -> DataFrame:
    named = v.place.select("image_id", "id", *[F.col(c).alias(f"a{c}") for c in "xywh"], F.lit(2).alias("bx"), F.lit(2).alias("by"), F.lit(40).alias("bw"), F.lit(20).alias("bh"))
    return named.select("image_id", "id", shapes.touches_edge("a", "b").alias("clipped"))


@query("SELECT pattern_id, CASE WHEN pattern_id % 7 = 0 THEN 'invalid-image' ELSE 'ok' END AS result FROM v_pattern")
def created_patterns(v: Views) -> DataFrame:
    return C.create_patterns(v.pattern.withColumn("accepted", F.col("pattern_id") % 7 != 0)).select("pattern_id", "result")
