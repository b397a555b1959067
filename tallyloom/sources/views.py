"""Derived views over the given tables: the ledger's, the charts' and the recogniser's tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import CAPS

CODE = "concat(substr('ABCDEFGHM', cast(1 + {p} % 9 as int), 1), 1 + ({p} div 9) % 40)"


class Views:
    """The views of one folder of tables, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def palette(self) -> DataFrame:
        """code, grp, gi, n and a colour by rule; 221 rows."""
        groups = self.spark.createDataFrame([(g, i, c) for i, (g, c) in enumerate(CAPS.items())], "grp string, gi int, cap int")
        numbers = self.table("region").crossJoin(self.table("nation")).selectExpr("cast(r_regionkey * 25 + n_nationkey + 1 as int) as n")  # 125 rows
        rows = groups.join(numbers, F.col("n") <= F.col("cap"))
        return rows.selectExpr("concat(grp, n) as code", "grp", "gi", "n", "(gi * 29 + n * 7) % 256 as r", "(gi * 53 + n * 11) % 256 as g", "(gi * 97 + n * 3) % 256 as b")

    @cached_property
    def cmd(self) -> DataFrame:
        ordered = W.partitionBy("user_id").orderBy("ts", "event_id")
        kinds = "map('signup', 'first-entry', 'view', 'count', 'click', 'restock', 'purchase', 'make', 'error', 'void-make')"
        rows = self.table("events").withColumn("seq", F.row_number().over(ordered).cast("long"))
        return rows.selectExpr(
            "user_id as ledger_id", "seq", f"coalesce({kinds}[event_type], 'flag') as op_type", "event_id",
            "concat(substr('ABCDEFGHMZ', cast(1 + event_id % 10 as int), 1), 1 + cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 34) as code",
            "cast(floor(value) as bigint) as qty", "concat('r', event_id - event_id % 3) as request_id", "props as payload", "ts as at",
        )

    @cached_property
    def move(self) -> DataFrame:
        chain = W.partitionBy("ledger_id", "code").orderBy("seq")
        valid = self.cmd.join(F.broadcast(self.palette.select("code")), "code")  # 221 rows
        return valid.withColumn("qty_before", F.lag("qty", 1, 0).over(chain)).selectExpr("ledger_id", "seq", "code", "qty_before", "qty as qty_after", "qty - qty_before as delta", "op_type", "request_id")

    @cached_property
    def usage(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("pattern_id"), F.expr(CODE.format(p="l_partkey")).alias("code")).agg(F.sum(F.expr("cast(floor(l_quantity) as bigint)")).alias("qty"))

    @cached_property
    def stock(self) -> DataFrame:
        rows = self.table("lineitem").selectExpr("l_suppkey % 10 as ledger_id", f"{CODE.format(p='l_partkey')} as code", "l_returnflag as f", "cast(floor(l_quantity) as bigint) as q")
        return rows.groupBy("ledger_id", "code").agg(
            F.coalesce(F.sum(F.when(F.col("f") == "R", F.col("q"))), F.lit(0)).alias("qty"), F.sum(F.when(F.col("f") == "A", F.col("q"))).alias("baseline"),
            (F.count(F.when(F.col("f") == "R", 1)) > 0).alias("entered"), (F.sum("q") % 2 == 0).alias("estimated"),
        )

    @cached_property
    def pattern(self) -> DataFrame:
        return self.table("orders").selectExpr("o_orderkey as pattern_id", "o_custkey % 10 as ledger_id", "case when o_orderkey % 5 <> 0 then 1 + o_orderkey % 2 end as confirmed_version", "o_orderstatus = 'P' as archived", "concat('chart ', o_orderkey) as name")

    @cached_property
    def version(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("pattern_id"), F.expr("1 + l_linenumber % 2").cast("long").alias("version"), F.expr(CODE.format(p="l_partkey")).alias("code")).agg(F.sum(F.expr("cast(floor(l_quantity) as bigint)")).alias("qty"))

    @cached_property
    def make(self) -> DataFrame:
        return self.table("orders").selectExpr("o_orderkey as make_id", "o_orderkey as pattern_id", "o_custkey % 10 as ledger_id", "o_orderstatus = 'O' as voided", "1 + o_orderkey % 2 as version")

    @cached_property
    def make_line(self) -> DataFrame:
        return self.usage.select(F.col("pattern_id").alias("make_id"), "code", "qty")

    @cached_property
    def title(self) -> DataFrame:
        return self.usage.groupBy("pattern_id").agg(F.sum("qty").alias("line_sum")).selectExpr("pattern_id", "line_sum + pattern_id % 3 - 1 as title_total", "pattern_id % 2 = 0 as ack")

    @cached_property
    def cell(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_orderkey as image_id", "cast(l_linenumber as bigint) as row", "l_suppkey % 40 as col", f"{CODE.format(p='l_partkey')} as text", "l_partkey * 7 % 256 as r", "l_suppkey * 5 % 256 as g", "cast(l_linenumber as bigint) * 31 % 256 as b",
            "cast(l_discount as double) * 10 as score", "l_tax = 0 as blank", "l_partkey % 200 as x", "l_suppkey % 50 as y",
        )

    @cached_property
    def box(self) -> DataFrame:
        order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        rows = self.table("lineitem").withColumn("id", F.row_number().over(order).cast("long"))
        return rows.selectExpr("l_orderkey as image_id", "id", "l_partkey % 200 as x", "l_suppkey % 50 as y", "10 + cast(l_linenumber as bigint) * 3 as w", "8 + cast(l_linenumber as bigint) % 5 as h", f"{CODE.format(p='l_partkey')} as code", "cast(floor(l_quantity) as bigint) as qty", "cast(l_discount as double) * 10 as score")

    @cached_property
    def place(self) -> DataFrame:
        """Boxes of whole charts that stand close to each other: one chart a customer and status, few codes."""
        order = W.partitionBy("o_custkey", "o_orderstatus").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        rows = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("id", F.row_number().over(order).cast("long"))
        return rows.selectExpr(
            "o_custkey * 3 + case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as image_id", "id", "l_partkey % 40 as x", "l_suppkey % 20 as y", "10 + cast(l_linenumber as bigint) * 3 as w", "8 + cast(l_linenumber as bigint) % 5 as h",
            "concat('A', 1 + l_partkey % 7) as code", "cast(floor(l_quantity) as bigint) % 4 as qty", "cast(l_discount as double) * 10 as score",
        )

    @cached_property
    def block(self) -> DataFrame:
        return self.table("conversations").selectExpr("conv_id as image_id", "cast(turn as bigint) as block_id", "role as status", "text as payload")

    @cached_property
    def glyph(self) -> DataFrame:
        return self.table("embeddings").selectExpr("vec_id", "label", "embedding")

    @cached_property
    def event(self) -> DataFrame:
        return self.table("events").selectExpr("user_id as key", "unix_seconds(cast(ts as timestamp)) as pos", "value", "event_type", "event_id")

    @cached_property
    def peak(self) -> DataFrame:
        """Line positions on an axis a part: a lattice of 20 with gaps, a jitter of one and some strays."""
        rows = self.table("lineitem").selectExpr("l_partkey as key", "(l_suppkey % 40) * 20 + cast(l_linenumber as bigint) % 2 + case when l_discount = 0 then 9 else 0 end as pos")
        return rows.distinct().withColumn("length", F.lit(800))

    @cached_property
    def expected(self) -> DataFrame:
        """Reference counts: usage shifted by rule, some rows left out."""
        return self.usage.filter("qty % 13 <> 0").selectExpr("pattern_id", "code", "greatest(qty + pattern_id % 11 - 5, 0) as qty", "pattern_id % 4 <> 0 as complete")

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents").selectExpr("doc_id", "text", "substr(text, 1, 20) as head")


_CODE = "substr('ABCDEFGHM', CAST(1 + {p} % 9 AS INT), 1) || CAST(1 + ({p} // 9) % 40 AS VARCHAR)"
#: The same views for the other engine, as common table expressions.
SQL = {
    "v_palette": "SELECT grp || n AS code, grp, gi, n, (gi * 29 + n * 7) % 256 AS r, (gi * 53 + n * 11) % 256 AS g, (gi * 97 + n * 3) % 256 AS b FROM (VALUES " + ", ".join(f"('{g}', {i}, {c})" for i, (g, c) in enumerate(CAPS.items())) + ") AS t(grp, gi, cap), (SELECT CAST(r_regionkey * 25 + n_nationkey + 1 AS INT) AS n FROM region, nation) WHERE n <= cap",
    "v_cmd": "SELECT user_id AS ledger_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'signup' THEN 'first-entry' WHEN 'view' THEN 'count' WHEN 'click' THEN 'restock' WHEN 'purchase' THEN 'make' WHEN 'error' THEN 'void-make' ELSE 'flag' END AS op_type, event_id, substr('ABCDEFGHMZ', CAST(1 + event_id % 10 AS INT), 1) || (1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 34) AS code, CAST(floor(value) AS BIGINT) AS qty, 'r' || (event_id - event_id % 3) AS request_id, props AS payload, ts AS at FROM events",
    "v_move": "SELECT ledger_id, seq, code, lag(qty, 1, 0) OVER (PARTITION BY ledger_id, code ORDER BY seq) AS qty_before, qty AS qty_after, qty - lag(qty, 1, 0) OVER (PARTITION BY ledger_id, code ORDER BY seq) AS delta, op_type, request_id FROM v_cmd WHERE code IN (SELECT code FROM v_palette)",
    "v_usage": f"SELECT l_orderkey AS pattern_id, {_CODE.format(p='l_partkey')} AS code, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY 1, 2",
    "v_stock": f"SELECT ledger_id, code, CAST(coalesce(sum(q) FILTER (WHERE f = 'R'), 0) AS BIGINT) AS qty, CAST(sum(q) FILTER (WHERE f = 'A') AS BIGINT) AS baseline, count(CASE WHEN f = 'R' THEN 1 END) > 0 AS entered, sum(q) % 2 = 0 AS estimated FROM (SELECT l_suppkey % 10 AS ledger_id, {_CODE.format(p='l_partkey')} AS code, l_returnflag AS f, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem) GROUP BY 1, 2",
    "v_pattern": "SELECT o_orderkey AS pattern_id, o_custkey % 10 AS ledger_id, CASE WHEN o_orderkey % 5 <> 0 THEN 1 + o_orderkey % 2 END AS confirmed_version, o_orderstatus = 'P' AS archived, 'chart ' || o_orderkey AS name FROM orders",
    "v_version": f"SELECT l_orderkey AS pattern_id, CAST(1 + l_linenumber % 2 AS BIGINT) AS version, {_CODE.format(p='l_partkey')} AS code, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY 1, 2, 3",
    "v_make": "SELECT o_orderkey AS make_id, o_orderkey AS pattern_id, o_custkey % 10 AS ledger_id, o_orderstatus = 'O' AS voided, 1 + o_orderkey % 2 AS version FROM orders",
    "v_make_line": "SELECT pattern_id AS make_id, code, qty FROM v_usage",
    "v_title": "SELECT pattern_id, CAST(sum(qty) + pattern_id % 3 - 1 AS BIGINT) AS title_total, pattern_id % 2 = 0 AS ack FROM v_usage GROUP BY pattern_id",
    "v_cell": f"SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS row, l_suppkey % 40 AS col, {_CODE.format(p='l_partkey')} AS text, l_partkey * 7 % 256 AS r, l_suppkey * 5 % 256 AS g, CAST(l_linenumber AS BIGINT) * 31 % 256 AS b, CAST(l_discount AS DOUBLE) * 10 AS score, l_tax = 0 AS blank, l_partkey % 200 AS x, l_suppkey % 50 AS y FROM lineitem",
    "v_box": f"SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_partkey % 200 AS x, l_suppkey % 50 AS y, 10 + CAST(l_linenumber AS BIGINT) * 3 AS w, 8 + CAST(l_linenumber AS BIGINT) % 5 AS h, {_CODE.format(p='l_partkey')} AS code, CAST(floor(l_quantity) AS BIGINT) AS qty, CAST(l_discount AS DOUBLE) * 10 AS score FROM lineitem",
    "v_place": "SELECT o_custkey * 3 + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS image_id, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_partkey % 40 AS x, l_suppkey % 20 AS y, 10 + CAST(l_linenumber AS BIGINT) * 3 AS w, 8 + CAST(l_linenumber AS BIGINT) % 5 AS h, 'A' || (1 + l_partkey % 7) AS code, CAST(floor(l_quantity) AS BIGINT) % 4 AS qty, CAST(l_discount AS DOUBLE) * 10 AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "v_block": "SELECT conv_id AS image_id, CAST(turn AS BIGINT) AS block_id, role AS status, text AS payload FROM conversations",
    "v_glyph": "SELECT vec_id, label, embedding FROM embeddings",
    "v_event": "SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS pos, value, event_type, event_id FROM events",
    "v_expected": "SELECT pattern_id, code, CAST(greatest(qty + pattern_id % 11 - 5, 0) AS BIGINT) AS qty, pattern_id % 4 <> 0 AS complete FROM v_usage WHERE qty % 13 <> 0",
    "v_peak": "SELECT DISTINCT l_partkey AS key, (l_suppkey % 40) * 20 + CAST(l_linenumber AS BIGINT) % 2 + CASE WHEN l_discount = 0 THEN 9 ELSE 0 END AS pos FROM lineitem",
    "v_docs": "SELECT doc_id, text, substr(text, 1, 20) AS head FROM documents",
}


def with_views(sql: str) -> str:
    """``sql`` behind the views that it names, directly or through others."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in SQL:
            if name not in needed and name in text:
                needed.add(name)
                todo.append(SQL[name])
    listed = ", ".join(f"{name} AS ({SQL[name]})" for name in SQL if name in needed)
    if not listed:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {listed}, {body[15:]}"
    return f"WITH {listed}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {listed} {body}"
