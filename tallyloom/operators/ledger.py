"""Reads over ledgers: stock, history, shortages, makes, versions, totals.

All tables carry ``ledger_id`` and are joined and grouped by keys; only the catalogue
(221 colours) is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import CAPS, colour_key, plain_code, with_colour
from ..functions.quantities import gap, is_low
from ..functions.texts import csv_field
from ..session import cut


def list_stock(stock: DataFrame, query: str = "", group: str = "") -> DataFrame:
    """Stock whose code contains the query, or is what it normalises to, within a group."""
    text = query.strip().upper()
    hit = F.upper("code").contains(text) | (F.col("code") == plain_code(F.lit(query)))
    return stock.filter(F.col("code").startswith(group) & (hit if text else F.lit(True)))


def get_stock(stock: DataFrame, code: str) -> DataFrame:
    """The rows of one colour (P2); the filter reaches the scan of a stored table."""
    return stock.filter(F.col("code") == plain_code(F.lit(code)))


def flag_low(stock: DataFrame, settings: DataFrame) -> DataFrame:
    """Stock with ``low`` under each ledger's percentage, 10 where it has none."""
    return stock.join(settings.select("ledger_id", "low_stock_percent"), "ledger_id", "left").withColumn("low", is_low(F.col("qty"), F.col("baseline"), F.coalesce("low_stock_percent", F.lit(10)))).drop("low_stock_percent")


def entered(stock: DataFrame) -> DataFrame:
    """Colours that were entered, zero balances included."""
    return stock.filter("entered")


def sections(stock: DataFrame) -> DataFrame:
    """Per ledger and colour group in display order: colours, entered, available, all entered.

    Lines of a batch form have ``selected`` and ``locked`` besides; then also the lines that can be
    chosen, those that are, and whether all of them are (not where there are none).
    """
    order = F.array(*[F.lit(g) for g in CAPS])
    free = ~F.coalesce("locked", F.lit(False)) if "locked" in stock.columns else F.lit(True)
    chosen = F.coalesce("selected", F.lit(False)) if "selected" in stock.columns else None
    form = [] if chosen is None else [F.count_if(free).alias("n_free"), F.count_if(free & chosen).alias("n_selected"), F.coalesce(F.bool_and(F.when(free, chosen)), F.lit(False)).alias("all_selected")]
    return stock.groupBy("ledger_id", F.substring("code", 1, 1).alias("grp")).agg(
        F.count("*").alias("total"), F.count_if("entered").alias("n_entered"), F.count_if(F.col("qty") > 0).alias("n_available"), F.bool_and("entered").alias("all_entered"), *form
    ).withColumn("gi", F.array_position(order, F.col("grp")))


def dense_stock(ledgers: DataFrame, palette: DataFrame, stock: DataFrame) -> DataFrame:
    """Every colour for every ledger, with empty rows where there is no stock."""
    every = ledgers.select("ledger_id").distinct().crossJoin(F.broadcast(palette.select("code")))  # 221 colours by ledger
    return every.join(stock, ["ledger_id", "code"], "left").select("ledger_id", "code", F.coalesce("qty", F.lit(0)).alias("qty"), "baseline", F.coalesce("entered", F.lit(False)).alias("entered"), F.coalesce("estimated", F.lit(True)).alias("estimated"))


def history(moves: DataFrame, operations: DataFrame, patterns: DataFrame | None = None, code: str | None = None) -> DataFrame:
    """Movements with their operations, newest order left to the reader; pattern names with fallbacks."""
    rows = moves if code is None else moves.filter(F.col("code") == code)
    rows = rows.join(operations, ["ledger_id", "seq"])
    if patterns is None:
        return rows
    named = rows.join(patterns.select("pattern_id", "name"), "pattern_id", "left")
    return named.withColumn("pattern_name", F.coalesce("name", F.col("pattern_id").cast("string"), F.lit("—"))).drop("name")


def gap_lines(usage: DataFrame, stock: DataFrame) -> DataFrame:
    """Demand against stock, line by line (J2, F8); a colour without stock has none."""
    have = stock.select("ledger_id", "code", F.col("qty").alias("stock_qty"))
    joined = usage.join(have, ["ledger_id", "code"], "left").withColumn("have", F.coalesce("stock_qty", F.lit(0)))
    return joined.select("pattern_id", "ledger_id", "code", F.col("qty").alias("demand"), "have", gap(F.col("qty"), F.col("have")).alias("gap"), (F.col("have") - F.col("qty")).alias("remaining"))


def gap_summary(lines: DataFrame) -> DataFrame:
    """Per pattern: demand, colours, whether it can be made, what is missing (A1)."""
    return lines.groupBy("pattern_id").agg(F.sum("demand").alias("total_demand"), F.count_if(F.col("demand") > 0).alias("colour_count"), F.coalesce(F.bool_and(F.col("gap") == 0), F.lit(True)).alias("can_make"), F.sum("gap").alias("total_gap"))


def restock_list(patterns: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of the restock list: positive gaps, or one empty row for a pattern without any."""
    positive = lines.filter("gap > 0").select("pattern_id", "code", "gap")
    return patterns.select("pattern_id", "name").join(positive, "pattern_id", "left").select("pattern_id", "name", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("gap", F.lit(0)).alias("gap"))


def restock_csv(rows: DataFrame, at: str) -> DataFrame:
    """One CSV line a row, guarded against formulas, with its sort key."""
    return rows.select("pattern_id", colour_key(F.col("code")).alias("key"), F.concat_ws(",", csv_field(F.col("name")), csv_field(F.lit(at)), csv_field(F.col("code")), csv_field(F.col("gap").cast("string"))).alias("line"))


def restock_text(rows: DataFrame, at: str) -> DataFrame:
    """The list as one text a pattern; a pattern has at most 221 lines."""
    line = F.when(F.col("gap") > 0, F.struct(colour_key(F.col("code")).alias("key"), F.concat(F.col("code"), F.lit(" 缺 "), F.col("gap").cast("string")).alias("line")))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x.getField("line"))
    body = F.when(F.size("lines") == 0, F.lit("当前足量，没有正缺口。")).otherwise(F.array_join("lines", "\n"))
    return rows.groupBy("pattern_id", "name").agg(lines.alias("lines")).select("pattern_id", F.concat(F.lit("补货清单（不是完整备份，不能用于恢复账本）\n图纸："), F.col("name"), F.lit(f"\n生成时间：{at}\n"), body, F.lit("\n")).alias("text"))


def current_versions(patterns: DataFrame, versions: DataFrame) -> DataFrame:
    """Patterns with the lines of their confirmed version, if they have one."""
    return patterns.join(versions.withColumnRenamed("version", "confirmed_version"), ["pattern_id", "confirmed_version"], "left")


def pattern_cards(patterns: DataFrame, versions: DataFrame, makes: DataFrame, drafts: DataFrame) -> DataFrame:
    """Cards of unarchived patterns: demand (null if unconfirmed), makes, draft."""
    demand = versions.groupBy("pattern_id", F.col("version").alias("confirmed_version")).agg(F.sum("qty").alias("lines_total"))
    made = makes.groupBy("pattern_id").agg(F.count_if(~F.col("voided")).alias("made"))
    return (
        patterns.filter("not archived").join(demand, ["pattern_id", "confirmed_version"], "left").join(made, "pattern_id", "left").join(drafts.select("pattern_id").distinct().withColumn("d", F.lit(True)), "pattern_id", "left")
        .select("pattern_id", "name", F.when(F.col("confirmed_version").isNotNull(), F.coalesce("lines_total", F.lit(0))).alias("demand"), F.coalesce("made", F.lit(0)).alias("made"), F.col("d").isNotNull().alias("has_draft"))
    )


def used_totals(makes: DataFrame, lines: DataFrame) -> DataFrame:
    """Per ledger and colour: what makes that aren't voided have used (A2)."""
    return makes.filter("not voided").select("make_id", "ledger_id").join(lines, "make_id").groupBy("ledger_id", "code").agg(F.sum("qty").alias("used"))


def achievements(makes: DataFrame, lines: DataFrame, palette: DataFrame) -> DataFrame:
    """Used colours of every ledger, zero-filled over the catalogue, with its completed makes (A2)."""
    done = makes.groupBy("ledger_id").agg(F.count_if(~F.col("voided")).alias("completed"))
    every = done.crossJoin(F.broadcast(palette.select("code")))
    return every.join(used_totals(makes, lines), ["ledger_id", "code"], "left").select("ledger_id", "code", "completed", F.coalesce("used", F.lit(0)).alias("used"))


def stock_rows(stock: DataFrame, used: DataFrame, settings: DataFrame, palette: DataFrame) -> DataFrame:
    """The stock page: balance, use, low flag and display colour."""
    return with_colour(flag_low(stock, settings).join(used, ["ledger_id", "code"], "left").withColumn("used", F.coalesce("used", F.lit(0))), palette)


def stock_difference(backup: DataFrame, live: DataFrame) -> DataFrame:
    """Backup rows that differ from live stock or are missing there; ``entered`` isn't compared."""
    other = live.select("ledger_id", "code", *[F.col(c).alias(f"live_{c}") for c in ("qty", "estimated", "baseline")])
    same = F.lit(True)
    for c in ("qty", "estimated", "baseline"):
        same &= F.col(c).eqNullSafe(F.col(f"live_{c}"))
    return backup.join(other, ["ledger_id", "code"], "left").filter(~same)


def make_sources(makes: DataFrame, versions: DataFrame) -> DataFrame:
    """Makes with the version that they were made from: its lines and total."""
    totals = versions.groupBy("pattern_id", "version").agg(F.count("*").alias("version_lines"), F.sum("qty").alias("version_total"))
    return makes.join(totals, ["pattern_id", "version"])


def usage_differences(final: DataFrame, candidate: DataFrame, key: str = "pattern_id") -> DataFrame:
    """Codes whose quantity differs between the edited and the candidate lines, null-safe."""
    both = final.select(key, "code", F.col("qty").alias("final_qty")).join(candidate.select(key, "code", F.col("qty").alias("candidate_qty")), [key, "code"], "full")
    return both.filter(~F.col("final_qty").eqNullSafe(F.col("candidate_qty")))


def continuity(moves: DataFrame) -> DataFrame:
    """Movements with the running sum of their deltas and whether they follow the one before."""
    chain = W.partitionBy("ledger_id", "code").orderBy("seq")
    return moves.withColumns({
        "running": F.sum("delta").over(chain.rowsBetween(W.unboundedPreceding, 0)),
        "continuous": F.coalesce(F.lag("qty_after").over(chain), F.lit(0)) == F.col("qty_before"),
    })


def rebuild_stock(moves: DataFrame) -> DataFrame:
    """Current balance of each colour from the log, without a sort; entered by the rule of first entries and non-zero balances."""
    return moves.groupBy("ledger_id", "code").agg(F.max_by("qty_after", "seq").alias("qty"), F.max("seq").alias("last_seq"), F.bool_or((F.col("op_type") == "first-entry") | (F.col("op_type").isin("count", "restock", "flag") & (F.col("qty_after") != 0))).alias("entered"))


def carried_baseline(moves: DataFrame) -> DataFrame:
    """The baseline after each movement: set by first entries and increasing restocks, carried otherwise."""
    chain = W.partitionBy("ledger_id", "code").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    sets = (F.col("op_type") == "first-entry") | ((F.col("op_type") == "restock") & (F.col("qty_after") > F.col("qty_before")))
    return moves.withColumn("baseline", F.last(F.when(sets, F.col("qty_after")), ignorenulls=True).over(chain))


def version_changes(versions: DataFrame) -> DataFrame:
    """Codes that change between consecutive versions of a pattern, absent as null."""
    nth = versions.select("pattern_id", "version").distinct().withColumn("prior", F.lag("version").over(W.partitionBy("pattern_id").orderBy("version"))).filter("prior is not null")
    new = nth.join(versions, ["pattern_id", "version"]).select("pattern_id", "version", "code", F.col("qty").alias("new_qty"))
    old = nth.join(versions.withColumnRenamed("version", "prior"), ["pattern_id", "prior"]).select("pattern_id", "version", "code", F.col("qty").alias("old_qty"))
    return new.join(old, ["pattern_id", "version", "code"], "full").filter(~F.col("new_qty").eqNullSafe(F.col("old_qty")))


def latest_version(versions: DataFrame) -> DataFrame:
    """Number of versions of each pattern and the current one."""
    return versions.groupBy("pattern_id").agg(F.max("version").alias("current_version"), F.count_distinct("version").alias("n_versions"))


def first_by_request(commands: DataFrame) -> DataFrame:
    """The first command of each request of a ledger, with how many came."""
    return commands.groupBy("ledger_id", "request_id").agg(F.min("seq").alias("first_seq"), F.min_by("op_type", "seq").alias("op_type"), F.count("*").alias("n"), F.count_distinct("payload").alias("payloads"))


def sequenced(rows: DataFrame, key: str, order: list[str], name: str = "seq") -> DataFrame:
    """``rows`` with their place in their key's order, from one (W5), without sorting a key in one task.

    Rows are ranged over tasks by key and order; a place in the sorted task, less where the
    key begins there, plus the key's rows in tasks before gives the number.  The range sort
    is materialised, so that the places are those of one run.
    """
    keys = [F.col(key), *[F.col(c) for c in order]]
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_task": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    pieces = placed.groupBy("_task", F.col(key).alias("_key")).agg(F.min("_in").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_key").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = pieces.select(F.col("_task").alias("_of"), "_key", (before - F.col("_first") + 1).alias("_offset"))
    numbered = placed.join(offsets, (F.col("_task") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    return numbered.select(*rows.columns, (F.col("_in") + F.col("_offset")).alias(name))
