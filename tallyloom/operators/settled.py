"""The fold of a log in rounds: a hot ledger's commands side by side instead of one after another.

A round assumes which commands go through, computes every colour's balance before every
command from running sums and last values, and judges all commands anew; what it finds is
the next round's assumption.  The first command is right after one round, as it depends on
nothing; each round settles at least the first command that was wrong, and in practice all
but chains of refusals that depend on each other.  A round that changes nothing is the
sequential fold, exactly.  Ledgers that aren't settled after ``rounds`` go through
:func:`.command_log.fold_log`, whole and in order.

Running values of a key are taken in chunks of positions: sums and last values of chunks
first, then inside each chunk.  So a ledger, a colour or a make with a third of all rows is
many tasks.  Knows batches, makes with lines of their own, and voids; ``seq`` is unique in a
ledger and null nowhere.  An empty log gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantities import MAX_QTY
from ..session import cut
from .command_log import BATCHES, COLUMNS, COUNT, FIRST, FLAG, MAKE, RESTOCK, VOID, fold_log, prepared

KINDS = (*BATCHES, MAKE, VOID)
#: Positions of a log that are one chunk.
CHUNK = 4096
BEFORE = (W.unboundedPreceding, -1)


def running(rows: DataFrame, keys: list[str], sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """``rows`` with sums of, and last values that aren't null of, all rows before them by ``seq`` within ``keys``."""
    rows = rows.withColumns({f"_in_{c}": v for c, v in (sums | lasts).items()} | {"_chunk": F.floor(F.col("seq") / CHUNK)})
    of_chunk = [F.sum(f"_in_{c}").alias(f"_at_{c}") for c in sums] + [F.max_by(f"_in_{c}", F.when(F.col(f"_in_{c}").isNotNull(), F.col("seq"))).alias(f"_at_{c}") for c in lasts]
    chunks = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(*BEFORE)
    carried = rows.groupBy(*keys, "_chunk").agg(*of_chunk)
    carried = carried.select(*keys, "_chunk", *[F.sum(f"_at_{c}").over(chunks).alias(f"_up_{c}") for c in sums], *[F.last(f"_at_{c}", ignorenulls=True).over(chunks).alias(f"_up_{c}") for c in lasts])
    inside = W.partitionBy(*keys, "_chunk").orderBy("seq").rowsBetween(*BEFORE)
    out = rows.join(carried, [*keys, "_chunk"]).withColumns({f"_lo_{c}": F.sum(f"_in_{c}").over(inside) for c in sums} | {f"_lo_{c}": F.last(f"_in_{c}", ignorenulls=True).over(inside) for c in lasts})
    named = {c: F.coalesce(f"_lo_{c}", F.lit(0)) + F.coalesce(f"_up_{c}", F.lit(0)) for c in sums} | {c: F.coalesce(f"_lo_{c}", f"_up_{c}") for c in lasts}
    return out.withColumns(named).drop("_chunk", *[f"_{p}_{c}" for c in named for p in ("in", "up", "lo")])


def _touched(log: DataFrame, guess: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commands with what their void finds (``open`` lines, or voided), and one row for each command and colour with ``ok`` and the line's marks."""
    rows = log.join(guess, ["ledger_id", "seq"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    made = F.when(F.col("op_type").isin(MAKE, VOID), F.coalesce(F.col("make_id"), F.when(F.col("op_type") == MAKE, F.col("request_id"))))
    makes = running(rows.filter(made.isNotNull()).withColumn("made", made), ["ledger_id", "made"], {}, {
        "open": F.when((F.col("op_type") == MAKE) & F.col("ok"), F.col("lines")), "last": F.when(F.col("ok"), F.col("op_type")),
    }).filter(F.col("op_type") == VOID).select("ledger_id", "seq", "open", F.col("last").alias("state"))
    rows = rows.join(makes, ["ledger_id", "seq"], "left")
    lines = F.when(F.col("op_type") == VOID, F.col("open")).otherwise(F.col("lines"))
    each = rows.select("ledger_id", "seq", "op_type", "ok", "marks", F.posexplode(lines).alias("pos", "x")).select(
        "ledger_id", "seq", "op_type", "ok", "pos", "x.code", "x.qty", "x.estimated", "x.error", F.coalesce(F.get("marks", F.col("pos"))["increases"], F.lit(False)).alias("increases"), F.coalesce(F.get("marks", F.col("pos"))["changes"], F.lit(False)).alias("changes"),
    )
    return rows.drop("marks", "lines"), each


def _balances(each: DataFrame) -> DataFrame:
    """Lines with quantity, flag, baseline and entered as they are before their command, if the assumption holds."""
    kind, good = F.col("op_type"), F.col("error").isNull()
    batch = F.col("ok") & kind.isin(*BATCHES) & (kind.isin(FIRST, COUNT) | F.col("changes"))
    valid, bad = each.filter(good), each.filter(~good)
    delta = F.when(F.col("ok") & (kind == MAKE), -F.col("qty")).when(F.col("ok") & (kind == VOID), F.col("qty")).otherwise(0)
    keys = ["ledger_id", "code"]
    summed = running(valid, keys, {"moved": delta}, {})
    found = running(summed, keys, {}, {
        "level": F.when(batch, F.col("qty") - F.col("moved")), "flag": F.when(batch, F.coalesce("estimated", F.when(kind == FIRST, F.lit(True)))),
        "base": F.when(batch & ((kind == FIRST) | (kind == RESTOCK) & F.col("increases")), F.col("qty")), "entered": F.when(batch & ((kind == FIRST) | (F.col("qty") != 0)), F.lit(True)),
    })
    found = found.select(*each.columns, (F.coalesce("level", F.lit(0)) + F.col("moved")).alias("have"), F.coalesce("flag", F.lit(True)).alias("flag"), "base", F.coalesce("entered", F.lit(False)).alias("entered"))
    return found.unionByName(bad.withColumns({"have": F.lit(0).cast("bigint"), "flag": F.lit(True), "base": F.lit(None).cast("bigint"), "entered": F.lit(False)}))


def _judged(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Commands with their result, movements and gaps by their lines and by what went through before them."""
    kind = F.col("op_type")
    after = F.when(kind == MAKE, F.col("have") - F.col("qty")).when(kind == VOID, F.col("have") + F.col("qty")).otherwise(F.col("qty"))
    increases = F.col("qty") > F.col("have")
    flag = F.when(kind.isin(*BATCHES), F.coalesce("estimated", (kind == FIRST) | F.col("flag"))).otherwise(F.col("flag"))
    base = F.when((kind == FIRST) | (kind == RESTOCK) & increases, F.col("qty")).otherwise(F.col("base"))
    lines = lines.withColumns({"after": after, "flag_after": flag, "base_after": base}).withColumn("changed", ~(F.col("after").eqNullSafe(F.col("have")) & F.col("flag_after").eqNullSafe(F.col("flag")) & F.col("base_after").eqNullSafe(F.col("base"))))
    error = F.coalesce("error", F.when((kind == FIRST) & F.col("entered"), "already-entered").when((kind == FLAG) & (F.col("qty") != F.col("have")), "flag-qty-changed"))
    move = F.struct("code", F.col("have").alias("qty_before"), F.col("after").alias("qty_after"), F.col("flag").alias("estimated_before"), F.col("flag_after").alias("estimated_after"), F.col("base").alias("baseline_before"), F.col("base_after").alias("baseline_after"))
    ordered = lambda value, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", value.alias("v"))))), lambda x: x["v"])  # noqa: E731  a command's lines: at most the catalogue
    short = (kind == MAKE) & (F.col("qty") > F.col("have"))
    per = lines.groupBy("ledger_id", "seq").agg(
        F.min_by(error, F.when(error.isNotNull(), F.col("pos"))).alias("error"), F.coalesce(F.bool_or((kind == RESTOCK) & (F.col("qty") < F.col("have"))), F.lit(False)).alias("decreases"), F.bool_or("changed").alias("changed"),
        F.bool_or((kind == VOID) & (F.col("after") > MAX_QTY)).alias("over"), ordered(move, F.col("changed")).alias("moves"), ordered(F.struct("code", F.col("qty").alias("need"), "have"), short).alias("gaps"),
        ordered(F.struct(increases.alias("increases"), F.col("changed").alias("changes")), F.lit(True)).alias("marks"), F.count("*").alias("n"),
    )
    found = running(rows.join(per, ["ledger_id", "seq"], "left"), ["ledger_id"], {"head": F.col("ok").cast("bigint")}, {})
    firsts = rows.filter(F.col("ok") | F.coalesce("noop", F.lit(False))).groupBy("ledger_id", "request_id").agg(F.min("seq").alias("_first"), F.min_by("key", "seq").alias("_key"))
    found = found.join(firsts, ["ledger_id", "request_id"], "left").withColumn("_again", F.coalesce(F.col("_first") < F.col("seq"), F.lit(False)))
    token = F.col("token").isNotNull() & ~(F.col("token.epoch").eqNullSafe(F.lit(0)) & F.col("token.seq").eqNullSafe(F.col("head")))
    again = F.when(F.col("_again"), F.when(F.col("_key") == F.col("key"), "replay").otherwise("request-conflict"))
    written = F.when(F.trim(F.coalesce("request_id", F.lit(""))) == "", "invalid-request")
    stale = F.when(token, "stale")
    batch = F.coalesce(again, F.when(F.col("n").isNull(), "empty-batch"), "error", F.when(F.col("decreases"), "restock-decrease"), written, stale, F.when(~F.col("changed") & (kind != FIRST), "noop"), F.lit("ok"))
    make = F.coalesce("early", again, written, stale, F.when(F.size("gaps") > 0, "insufficient"), F.lit("ok"))
    void = F.coalesce(F.when(F.col("state").isNull(), "missing-make"), F.when(F.col("state") == VOID, F.when(F.col("_again"), "replay").otherwise("already-voided")), written, again, stale, F.when(F.col("over"), "invalid-number"), F.lit("ok"))
    result = F.when(kind == MAKE, make).when(kind == VOID, void).otherwise(batch)
    ref = F.when(kind == MAKE, F.coalesce("make_id", "request_id")).when(kind == VOID, F.col("make_id"))
    return found.select("ledger_id", "seq", "request_id", kind, result.alias("result"), "moves", "gaps", ref.alias("ref"), "head", "_first", "marks")


def fold_in_rounds(commands: DataFrame, palette: DataFrame, rounds: int = 24) -> DataFrame:
    """What :func:`.command_log.fold_log` gives for logs of batches, makes by lines and voids."""
    own = F.col("op_type").isin(*KINDS) & ~((F.col("op_type") == MAKE) & F.col("pattern_id").isNotNull()) & F.col("ledger_id").isNotNull()
    log = cut(prepared(commands, palette, bundles=False).select("ledger_id", "seq", "request_id", "op_type", "token", "lines", "make_id", "key", "early", F.coalesce(own, F.lit(False)).alias("_own")))
    odd = log.filter(~F.col("_own")).select("ledger_id").distinct()
    open_rows = log.join(odd, "ledger_id", "left_anti").filter("ledger_id is not null").drop("_own")
    may = F.col("early").isNull() & ~F.coalesce(F.exists("lines", lambda x: x["error"].isNotNull()), F.lit(False))
    mark = F.transform("lines", lambda x: F.struct(F.lit(True).alias("increases"), F.lit(True).alias("changes")))
    guess, settled = open_rows.select("ledger_id", "seq", may.alias("ok"), F.lit(False).alias("noop"), mark.alias("marks")), []
    for _ in range(rounds):
        rows, each = _touched(open_rows, guess)
        judged = cut(_judged(rows, _balances(each)))
        fresh = judged.select("ledger_id", "seq", (F.col("result") == "ok").alias("ok"), (F.col("result") == "noop").alias("noop"), F.when(F.col("result") == "ok", F.col("marks")).alias("marks"))
        moved = fresh.join(guess.select("ledger_id", "seq", F.struct("ok", "noop", F.when(F.col("ok"), F.col("marks"))).alias("_old")), ["ledger_id", "seq"]).filter(~F.struct("ok", "noop", "marks").eqNullSafe(F.col("_old")))
        unsettled = cut(moved.select("ledger_id").distinct())
        settled.append(_finished(judged.join(unsettled, "ledger_id", "left_anti")))
        if unsettled.isEmpty():
            open_rows = None
            break
        open_rows, guess = cut(open_rows.join(unsettled, "ledger_id", "left_semi")), fresh.join(unsettled, "ledger_id", "left_semi")
    left = odd if open_rows is None else odd.unionByName(open_rows.select("ledger_id").distinct())
    rest = commands.join(left.select(F.col("ledger_id").alias("_left")).distinct(), F.col("ledger_id").eqNullSafe(F.col("_left")), "left_semi")
    out = fold_log(rest, palette)
    for part in settled:
        out = out.unionByName(part)
    return out


def _finished(judged: DataFrame) -> DataFrame:
    """Result rows; a replay has the movements of its first."""
    result = F.col("result")
    first = judged.filter(result.isin("ok", "noop")).select("ledger_id", F.col("seq").alias("_first"), F.when(result == "ok", F.col("moves")).otherwise(F.array()).alias("_moves"), F.col("ref").alias("_ref"), result.alias("_as"))
    rows = judged.join(first, ["ledger_id", "_first"], "left")
    moves = F.when(result == "ok", F.col("moves")).when(result == "replay", F.col("_moves"))
    ref = F.when(result == "ok", F.col("ref")).when((result == "replay") & (F.col("_as") == "ok"), F.col("_ref"))
    return rows.select(
        "ledger_id", "seq", "request_id", "op_type", "result", F.coalesce(moves, F.array()).alias("moves"), F.when(result == "insufficient", F.col("gaps")).otherwise(F.array()).alias("gaps"), ref.alias("ref"),
        F.lit(None).cast("bigint").alias("version"), F.lit(0).cast("bigint").alias("epoch"), (F.col("head") + (result == "ok").cast("bigint")).alias("head_seq"),
    ).select(*COLUMNS)
