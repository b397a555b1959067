"""The boundary of recognition (S8, V12, V13): from untyped JSON to accepted rows or a named refusal.

A document is parsed to VARIANT and every path is tested for its own type before it is
converted: a quantity that is text, a fraction or beyond the whole numbers that JSON can
carry is refused, and not cast.  Refusals are rows with a code, in the order of checks.
What is accepted has its lines, its evidence with the codes that it supports, and its risks:
one for each doubt, with the text and region of the evidence that it names where it has
none of its own, and one for coverage unless the result is ready.

Defined results: null, empty and broken texts are ``invalid-format``; equal documents each
count; other columns pass through; arrays are read whole within the contract's bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantities import MAX_QTY, MAX_SAFE, once

#: The contract's bounds.
MOST_LINES, MOST_EVIDENCE, MOST_DOUBTS, MOST_PIXELS, LONG_ID, LONG_TEXT = 221, 20_000, 512, 32_000_000, 100, 1000
#: What is said of a doubt without a reason, and of a result that isn't ready.
CHECK, COVERAGE = "此处需要人工核对", "完整覆盖尚未证明，仍可能漏计。请结合原图补充用量。"
#: What is read of a document in one pass: fields that must have a type of their own stay VARIANT, others become text or null.
FIELDS = (
    "struct<algorithm: variant, status: variant, source: variant, total: variant, titleTotal: variant, image: struct<width: variant, height: variant>, candidates: array<struct<code: variant, quantity: variant, evidenceIds: array<string>>>, "
    "evidence: array<struct<id: string, rawText: string, region: variant>>, doubts: array<struct<reason: string, rawText: string, region: variant, evidenceId: string, evidenceIds: array<string>>>>"
)


def _kind(x: Column) -> Column:
    """The type of a value: null if there is nothing, VOID for a JSON null."""
    return F.schema_of_variant(x)


def _text(x: Column) -> Column:
    """A value that is text; null for anything else."""
    return F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _whole(x: Column) -> Column:
    """A whole number that JSON carries exactly; null for anything else."""
    number = once(_kind(x), lambda kind: F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(x, "$", "double")))
    return once(number, lambda n: F.when((n == F.floor(n)) & (F.abs(n) <= MAX_SAFE), F.try_variant_get(x, "$", "bigint")))


def _given(x: Column) -> Column:
    """Whether there is a value other than null."""
    return x.isNotNull() & ~F.is_variant_null(x)


def _region(region: Column, width: Column, height: Column) -> Column:
    """Four finite numbers inside the image (to a pixel), or null."""
    box = F.when(F.coalesce(_kind(region).rlike("^ARRAY<(BIGINT|DOUBLE|DECIMAL.*)>$"), F.lit(False)), F.try_variant_get(region, "$", "array<double>"))

    def inside(b: Column) -> Column:
        x, y, w, h = (F.get(b, F.lit(i)) for i in range(4))
        return F.when((F.size(b) == 4) & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= width + 1) & (y + h <= height + 1), b)

    return once(box, inside)


def _ids(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def accepted_results(raw: DataFrame, palette: DataFrame, text: str = "json") -> DataFrame:
    """``raw`` without its text but with ``error`` (null if accepted) and what is accepted.

    status, source, algorithm, title_total, width, height, ``lines`` (code, qty), ``evidence``
    (id, raw, region, codes) and ``risks`` (id, reason, raw, region, resolved); all null where refused.
    """
    codes = [r["code"] for r in palette.select("code").limit(1001).collect()]  # the catalogue
    if len(codes) > 1000:
        raise ValueError("more than 1000 colours")
    own = [c for c in raw.columns if c != text]
    rows = raw.select(*own, F.try_variant_get(F.try_parse_json(text), "$", FIELDS).alias("_v"))
    v = lambda name: F.col(f"_v.{name}")
    candidate = lambda c: F.struct(_text(c["code"]).alias("code"), _whole(c["quantity"]).alias("qty"), _ids(c["evidenceIds"]).alias("ids"))
    rows = rows.select(
        *own, _kind(v("algorithm")).alias("_a"), F.try_variant_get(v("algorithm"), "$", "string").alias("_algorithm"), _text(v("status")).alias("_status"), _text(v("source")).alias("_source"), _given(v("source")).alias("_sourced"),
        F.transform(v("candidates"), candidate).alias("_c"), v("evidence").alias("_e"), v("doubts").alias("_d"), _whole(v("total")).alias("_total"), _given(v("total")).alias("_totalled"),
        _whole(v("titleTotal")).alias("_title"), _kind(v("titleTotal")).alias("_title_kind"), *[F.when(_given(v(f"image.{k}")), F.coalesce(_whole(v(f"image.{k}")), F.lit(-1))).otherwise(0).alias(f"_{k}") for k in ("width", "height")],
    )
    named = F.transform("_c", lambda c: c["code"])
    sums = F.aggregate("_c", F.lit(0).cast("bigint"), lambda s, c: s + F.coalesce(c["qty"], F.lit(0)))
    good = F.forall("_c", lambda c: F.coalesce(c["code"].isin(codes) & c["qty"].between(0, MAX_QTY), F.lit(False))) & (F.size(F.array_distinct(named)) == F.size(named))
    failed, n = F.col("_status") == "failed", F.size("_c")
    lead = F.when((F.col("_status") == "ready") & (F.size("_d") == 0), 0).otherwise(1)  # the risk of coverage
    error = (
        F.when(~F.coalesce(F.col("_status").isin("ready", "partial", "failed") & (F.col("_a") == "STRING") & (F.length("_algorithm") <= LONG_ID), F.lit(False)), "invalid-format")
        .when(F.col("_c").isNull() | F.col("_e").isNull() | F.col("_d").isNull() | (n > MOST_LINES) | (F.size("_e") > MOST_EVIDENCE) | (F.size("_d") > MOST_DOUBTS), "invalid-content")
        .when(~good, "invalid-candidate").when(F.col("_totalled") & ~F.coalesce(F.col("_total") == sums, F.lit(False)), "invalid-total")
        .when(F.when(failed, (n > 0) | F.col("_sourced")).otherwise((n == 0) | ~F.coalesce(F.col("_source").isin("legend", "grid"), F.lit(False))), "inconsistent-status")
        .when(~F.coalesce((F.col("_title_kind") == "VOID") | (F.col("_title") >= 0), F.lit(False)), "invalid-title")
        .when((F.col("_width") < 0) | (F.col("_height") < 0) | (F.col("_width").cast("double") * F.col("_height") > MOST_PIXELS), "invalid-size").when(~failed & ((F.col("_width") == 0) | (F.col("_height") == 0)), "missing-size")
        .when(F.size("_d") + lead > MOST_DOUBTS, "too-many-doubts")
    )
    rows = rows.withColumn("error", error).withColumn("_ok", F.col("error").isNull())
    proof = lambda e: F.struct(F.substring(e["id"], 1, LONG_ID).alias("id"), F.substring(F.coalesce(e["rawText"], F.lit("")), 1, LONG_TEXT).alias("raw"), _region(e["region"], F.col("_width"), F.col("_height")).alias("region"))
    rows = rows.withColumn("_e", F.when(F.col("_ok"), F.transform("_e", proof)))
    supported = lambda e: F.transform(F.filter("_c", lambda c: F.array_contains(c["ids"], e["id"])), lambda c: c["code"])
    evidence = F.transform("_e", lambda e: F.struct(e["id"].alias("id"), e["raw"].alias("raw"), e["region"].alias("region"), supported(e).alias("codes")))

    def risk(d: Column, i: Column) -> Column:
        named = lambda ids: F.get(F.filter("_e", lambda e: F.coalesce(e["id"] == d["evidenceId"], F.lit(False)) | F.array_contains(ids, e["id"])), F.lit(0))
        said = lambda first: F.struct(
            F.concat(F.lit("risk-"), i.cast("string")).alias("id"), F.substring(F.coalesce(d["reason"], F.lit(CHECK)), 1, LONG_TEXT).alias("reason"), F.substring(F.coalesce(d["rawText"], first["raw"], F.lit("")), 1, LONG_TEXT).alias("raw"),
            F.coalesce(_region(d["region"], F.col("_width"), F.col("_height")), first["region"]).alias("region"), F.lit(False).alias("resolved"),
        )
        return once(once(_ids(d["evidenceIds"]), named), said)

    status = F.when((F.col("_status") == "ready") & (F.size("_d") > 0), "partial").otherwise(F.col("_status"))
    coverage = F.array(F.struct(F.lit("coverage").alias("id"), F.lit(COVERAGE).alias("reason"), F.lit("").alias("raw"), F.lit(None).cast("array<double>").alias("region"), F.lit(False).alias("resolved")))
    doubts = F.transform("_d", risk)
    kept = {
        "status": status, "source": F.col("_source"), "algorithm": F.col("_algorithm"), "title_total": F.col("_title"), "width": F.col("_width"), "height": F.col("_height"),
        "lines": F.transform("_c", lambda c: F.struct(c["code"].alias("code"), c["qty"].alias("qty"))), "evidence": evidence, "risks": F.concat(F.when(status == "ready", F.slice(coverage, 1, 0)).otherwise(coverage), doubts),
    }
    return rows.select(*own, "error", *[F.when(F.col("_ok"), value).alias(name) for name, value in kept.items()])
