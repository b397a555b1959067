"""Colour codes: parsing, catalogue membership, order and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of the catalogue in display order, with their number of colours.
CAPS = {"A": 26, "B": 32, "C": 29, "D": 26, "E": 24, "F": 25, "G": 21, "H": 23, "M": 15}
#: Display names of the groups.
GROUP_NAMES = {"A": "黄橙", "B": "绿色", "C": "蓝青", "D": "蓝紫", "E": "粉玫", "F": "红色", "G": "棕肤", "H": "黑白", "M": "大地"}
#: Shown for a code without a colour.
NO_COLOUR = "#ccc"


def parse_code(raw: Column) -> Column:
    """struct(grp, n) of ``c012`` or `` C12 ``, null if it isn't a code."""
    text = F.upper(F.trim(raw))
    digits = F.regexp_extract(text, r"^[A-HM]([0-9]+)$", 1)
    return F.when(digits != "", F.struct(F.substring(text, 1, 1).alias("grp"), digits.try_cast("bigint").alias("n")))


def plain_code(raw: Column) -> Column:
    """``C12`` for ``c012``; null if it isn't a code.  Catalogue membership is a join: see :func:`in_catalogue`."""
    parsed = parse_code(raw)
    return F.concat(parsed.getField("grp"), parsed.getField("n").cast("string"))


def strict_code(raw: Column) -> Column:
    """The recogniser's reading: neither trimmed nor folded, letters then digits, leading zeros dropped."""
    letters, digits = F.regexp_extract(raw, r"^([A-Z]+)[0-9]+$", 1), F.regexp_extract(raw, r"^[A-Z]+([0-9]+)$", 1)
    return F.when(letters != "", F.concat(letters, digits.try_cast("bigint").cast("string")))


def colour_key(code: Column) -> Column:
    """Sort key: group order, then number, so that A2 comes before A10; others last, by text."""
    parsed = parse_code(code)
    order = F.array(*[F.lit(g) for g in CAPS])
    return F.struct(F.coalesce(F.array_position(order, parsed.getField("grp")), F.lit(99).cast("bigint")).alias("gi"), parsed.getField("n").alias("n"), code.alias("code"))


def group_name(grp: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in GROUP_NAMES.items() for x in kv])[grp]


def in_catalogue(rows: DataFrame, palette: DataFrame, code: str = "code") -> DataFrame:
    """Rows whose normalised code is in the catalogue, with the code normalised (F2, J13 accepted)."""
    known = F.broadcast(palette.select(F.col("code").alias("_known")))  # the catalogue is bounded: 221 colours
    return rows.withColumn(code, plain_code(F.col(code))).join(known, F.col(code) == F.col("_known"), "left_semi")


def off_catalogue(rows: DataFrame, palette: DataFrame, code: str = "code") -> DataFrame:
    """Rows kept as rejected items: their code isn't in the catalogue."""
    known = F.broadcast(palette.select(F.col("code").alias("_known")))
    return rows.join(known, plain_code(F.col(code)) == F.col("_known"), "left_anti")


def with_colour(rows: DataFrame, palette: DataFrame, code: str = "code") -> DataFrame:
    """Rows with a display colour ``hex``; ``#ccc`` off the catalogue."""
    colour = palette.select(F.col("code").alias(code), F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("r") * 65536 + F.col("g") * 256 + F.col("b")), 6, "0"))).alias("hex"))
    return rows.join(F.broadcast(colour), code, "left").withColumn("hex", F.coalesce("hex", F.lit(NO_COLOUR)))
