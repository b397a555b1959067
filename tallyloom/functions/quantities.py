"""Quantities: parsing with reasons, shortage, low stock, differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_QTY, MAX_SAFE = 1_000_000_000, 2**53 - 1
FIRST_ENTRY, LOW_PERCENT = 1000, 10
#: What is said for each reason.
MESSAGES = {"empty": "数量不能为空", "negative": "数量不能为负数", "decimal": "数量必须是整数，不能有小数", "overflow": "数量超出可记录范围", "invalid": "数量不是有效整数"}


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_quantity(raw: Column, maximum: int = MAX_QTY) -> Column:
    """struct(value, reason): one of the two is null."""

    def judged(text: Column, digits: Column, number: Column) -> Column:
        return (
            F.when(text.isNull() | (text == ""), "empty")
            .when(digits, F.when(text.rlike("^0[0-9]"), "invalid").when(number.isNull() | (number > maximum), "overflow"))
            .when(text.startswith("-"), "negative")
            .when(text.contains("."), "decimal")
            .otherwise("invalid")
        )

    def numbered(text: Column, digits: Column) -> Column:
        return once(F.when(digits, text.try_cast("decimal(38,0)")), lambda number: once(judged(text, digits, number), lambda reason: F.struct(F.when(reason.isNull(), number.cast("bigint")).alias("value"), reason.alias("reason"))))

    return once(F.trim(raw), lambda text: once(text.rlike("^[0-9]+$"), lambda digits: numbered(text, digits)))


def parse_percent(raw: Column) -> Column:
    return parse_quantity(raw, 100)


def quantity_message(reason: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    return F.when(reason.isNotNull(), F.coalesce(table[reason], F.lit(MESSAGES["invalid"])))


def gap(need: Column, have: Column) -> Column:
    return F.greatest(need - have, F.lit(0))


def is_low(qty: Column, baseline: Column, percent: Column) -> Column:
    """In whole numbers; false without a positive baseline."""
    return F.coalesce((baseline > 0) & (qty * 100 <= percent * baseline), F.lit(False))


def title_difference(title: Column, total: Column) -> Column:
    return title - total


def title_blocked(title: Column, total: Column, acknowledged: Column) -> Column:
    """A difference that nobody has acknowledged."""
    return F.coalesce((title - total) != 0, F.lit(False)) & ~acknowledged


def delta_holds(before: Column, after: Column, delta: Column) -> Column:
    return delta == after - before


def prefill(mode: Column, entered: Column, qty: Column) -> Column:
    return F.when((mode == "first-entry") & ~entered, F.lit(FIRST_ENTRY)).otherwise(qty)
