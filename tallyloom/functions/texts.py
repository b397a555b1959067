"""Text rules: CSV fields, canonical JSON, metadata, checks on stored text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quantities import once, parse_quantity

#: Labels of input methods, and what the others are called.
SOURCES = {"manual": "手工录入", "legend": "图例识别", "grid": "本体识别", "assisted": "人工辅助识别"}
UNKNOWN_SOURCE = "来源未知"
#: Brands that a chart can name.
BRANDS = ("MARD", "PERLER", "HAMA", "ARTKAL", "NABBI")
BRAND = f"^({'|'.join(BRANDS)})([0-9]{{2,4}})?$"


def csv_field(raw: Column) -> Column:
    """Quoted where it must be; a quote mark before what a spreadsheet would run."""
    safe = F.when(raw.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), raw)).otherwise(raw)
    return F.when(safe.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def canonical_json(**fields: Column) -> Column:
    """JSON of the given fields in the order of their names."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_items(items: Column) -> Column:
    """JSON of batch items (code, qty as text, estimated) by code, quantities trimmed, flags as 0 or 1."""
    plain = F.transform(items, lambda i: F.struct(i.getField("code").alias("code"), F.coalesce(i.getField("estimated").cast("int"), F.lit(0)).alias("flag"), F.trim(i.getField("qty").cast("string")).alias("qty")))
    return F.to_json(F.array_sort(plain))


def payload_key(text: Column) -> Column:
    """A compact key of a canonical text; equal keys, equal payloads."""
    return F.sha2(text, 256)


def clean_name(name: Column) -> Column:
    """Trimmed; null if blank."""
    return F.nullif(F.trim(name), F.lit(""))


def size_label(note: Column, default: str = "未注明") -> Column:
    return F.coalesce(F.nullif(F.trim(note), F.lit("")), F.lit(default))


def source_label(method: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])[method], F.lit(UNKNOWN_SOURCE))


def shortened(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def thumbnail_holds(mime: Column, data: Column) -> Column:
    """Base64 text of an image, not a path on a device."""
    return mime.startswith("image/") & ~data.startswith("/") & (F.length(data) > 0) & (F.length(data) % 4 == 0) & data.rlike("^[A-Za-z0-9+/]+={0,2}$")


#: What an export must not hold, and what a backup is refused for.
FORBIDDEN = r"originalFullImage|originalImage|/home/|/data/user/|C:\\\\Users"
REFUSED = r'"originalImage"|keystore|privateKey'


def forbidden_content(json: Column) -> Column:
    """Whether exported text holds raw images or device paths."""
    return json.rlike(FORBIDDEN)


def refused_content(json: Column) -> Column:
    """Whether a backup's text holds raw images or key material."""
    return json.rlike(REFUSED)


def only_keys(json: Column, allowed: list[str]) -> Column:
    """Whether a JSON object has no key but the allowed ones."""
    return F.coalesce(F.size(F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in allowed]))) == 0, F.lit(False))


def legend_text(text: Column) -> Column:
    """struct(code, value, reason) of ``C12(340)``; a quantity counts only if it is all digits and in range."""
    code, quantity = F.regexp_extract(text, r"^([A-Z][0-9]+)\(.*\)$", 1), F.regexp_extract(text, r"^[A-Z][0-9]+\((.*)\)$", 1)
    plain = once(quantity, lambda q: F.when(q.rlike("^0+[0-9]+$"), F.regexp_replace(q, "^0+(?=[0-9])", "")).otherwise(q))
    parts = F.struct(code.alias("code"), parse_quantity(plain).alias("parsed"))
    return once(parts, lambda p: F.struct(F.nullif(p["code"], F.lit("")).alias("code"), F.when(p["code"] != "", p["parsed"]["value"]).alias("value"), F.when(p["code"] == "", "invalid").otherwise(p["parsed"]["reason"]).alias("reason")))


def brand_mark(text: Column) -> Column:
    """struct(brand, palette) of ``Mard-221``; null if it names no brand."""
    plain = F.upper(F.translate(text, " -", ""))
    brand, number = F.regexp_extract(plain, BRAND, 1), F.regexp_extract(plain, BRAND, 2)
    return F.when(brand != "", F.struct(brand.alias("brand"), F.nullif(number, F.lit("")).alias("palette")))


def has_risk(status: Column, risks: Column) -> Column:
    """Whether a recognition still needs review: not ready, or a risk unresolved."""
    return (status != "ready") | F.exists(risks, lambda r: ~r.getField("resolved"))


def rejected_items_hold(items: Column) -> Column:
    """At most 512 items; raw and note up to 1000 characters; quantities null or in range."""
    return (F.size(items) <= 512) & F.forall(items, lambda i: (F.length(i.getField("raw")) <= 1000) & (F.length(i.getField("note")) <= 1000) & (i.getField("qty").isNull() | i.getField("qty").between(0, 1_000_000_000)))


def new_id(prefix: str, seed: Column | None = None) -> Column:
    """Random, or the same for the same seed where a job may run twice."""
    return F.concat(F.lit(f"{prefix}-"), F.uuid() if seed is None else F.sha2(seed.cast("string"), 256))
