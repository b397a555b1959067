"""Readings of single characters: template scores, field grammar, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def template_score(a: Column, b: Column) -> Column:
    """Mean absolute difference of two masks of equal length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(a)


def shaped_score(a: Column, b: Column, ratio_a: Column, ratio_b: Column, holes_a: Column, holes_b: Column) -> Column:
    """Mask difference with penalties for the aspect ratio and the share of holes."""
    return template_score(a, b) + 0.18 * F.abs(F.log(ratio_a / ratio_b)) + 0.15 * F.abs(holes_a - holes_b)


def decode_field(characters: Column, kind: str, least: float = 0.05) -> Column:
    """struct(text, score, changes) of array<struct<char, score, alternatives: array<struct<char, score>>>>.

    ``kind``: ``number`` (digits), ``code`` (a letter, then digits) or ``item`` (a code and its
    quantity in brackets, as the first readings have them).  At each position the first
    reading of the right kind with enough score counts; null if there is none.
    """
    raw = F.array_join(F.transform(characters, lambda c: c.getField("char")), "")
    left, last = F.instr(raw, "("), F.char_length(raw) - 1  # counted from one and from zero
    framed = (left >= 3) & raw.endswith(")") & (last > left)

    def choose(c: Column, i: Column) -> Column:
        alphabet = F.lit(DIGITS)
        if kind != "number":
            alphabet = F.when(i == 0, F.lit(LETTERS))
            if kind == "item":
                alphabet = alphabet.when(i == left - 1, F.lit("(")).when(i == last, F.lit(")"))
            alphabet = alphabet.otherwise(F.lit(DIGITS))
        ranked = F.concat(F.array(F.struct(c.getField("char").alias("char"), c.getField("score").alias("score"))), c.getField("alternatives"))
        good = F.filter(ranked, lambda a: F.contains(alphabet, a.getField("char")) & (a.getField("score") >= least))
        return F.struct(F.get(good, F.lit(0)).alias("chosen"), c.getField("char").alias("raw"))

    chosen = F.transform(characters, choose)
    text = F.array_join(F.transform(chosen, lambda x: x.getField("chosen").getField("char")), "")
    score = confidence(F.transform(chosen, lambda x: x.getField("chosen").getField("score")))
    changes = F.size(F.filter(chosen, lambda x: x.getField("raw") != x.getField("chosen").getField("char")))
    shaped = framed if kind == "item" else F.lit(True)
    return F.when((F.size(characters) > 0) & shaped & F.forall(chosen, lambda x: x.getField("chosen").isNotNull()), F.struct(text.alias("text"), score.alias("score"), changes.alias("changes")))


def confidence(scores: Column) -> Column:
    """Geometric mean."""
    return F.exp(F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.log(x)) / F.size(scores))
