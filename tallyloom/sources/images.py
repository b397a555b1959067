"""Image intake (S7): containers are walked to their end, part by part, without decoding a pixel.

Each kind of file is cut into named parts first; what makes a file whole is then a statement
about its parts: which there must be, how often and in which order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import oriented

MOST_BYTES, MOST_PIXELS = 20 * 1024 * 1024, 32_000_000
#: Why a file isn't taken.
EMPTY, UNKNOWN, DAMAGED, ANIMATED, TOO_LARGE, TOO_MANY_PIXELS = "empty", "unknown-kind", "damaged", "animated", "too-large", "too-many-pixels"
Part = tuple[str, bytes]


class Refused(ValueError):
    """Why a file isn't taken."""


def _need(holds: object, why: str = DAMAGED) -> None:
    if not holds:
        raise Refused(why)


def orientation(tiff: bytes) -> int:
    """The Exif orientation, 1 to 8; 1 where there is none that can be read."""
    tiff = tiff[6:] if tiff[:2] == b"Ex" else tiff
    mark = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if mark is None or len(tiff) < 8 or struct.unpack_from(f"{mark}H", tiff, 2)[0] != 42:
        return 1
    start = struct.unpack_from(f"{mark}I", tiff, 4)[0]
    if start + 2 > len(tiff):
        return 1
    entries = struct.unpack_from(f"{mark}H", tiff, start)[0]
    fields = (struct.unpack_from(f"{mark}HHIH", tiff, start + 2 + 12 * i) for i in range(min(entries, (len(tiff) - start - 2) // 12)))
    found = next((value for tag, kind, count, value in fields if (tag, kind, count) == (0x112, 3, 1)), 1)
    return found if 1 <= found <= 8 else 1


def png_parts(data: bytes) -> Iterator[Part]:
    """Chunks up to the last one, each with its checksum right."""
    at, name = 8, ""
    while name != "IEND":
        _need(at + 12 <= len(data))
        size = int.from_bytes(data[at : at + 4], "big")
        _need(at + 12 + size <= len(data))
        name, end = data[at + 4 : at + 8].decode("latin-1"), at + 8 + size
        _need(crc32(data[at + 4 : end]) == int.from_bytes(data[end : end + 4], "big"))
        yield name, data[at + 8 : end]
        at = end + 4


def png(data: bytes) -> tuple[int, int, int]:
    parts = list(png_parts(data))
    names = [name for name, _ in parts]
    _need("acTL" not in names, ANIMATED)
    _need(names[0] == "IHDR" and names.count("IHDR") == 1 and len(parts[0][1]) == 13 and not parts[-1][1])
    turned = [orientation(body) for name, body in parts if name == "eXIf"]
    return (*struct.unpack_from(">II", parts[0][1]), turned[-1] if turned else 1)


def jpeg_parts(data: bytes) -> Iterator[Part]:
    """Segments up to the end mark; entropy-coded data after a scan's header is passed over."""
    at, coded = 2, False
    while True:
        if coded:  # a mark that is neither a stuffed byte nor a restart
            while (at := data.find(b"\xff", at)) >= 0 and data[at + 1 : at + 2] and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                at += 2
            _need(at >= 0)
        _need(data[at : at + 1] == b"\xff")
        while data[at + 1 : at + 2] == b"\xff":
            at += 1
        _need(at + 1 < len(data))
        mark = data[at + 1]
        if mark == 0xD9:
            yield "EOI", b""
            return
        _need(mark != 0xD8 and at + 4 <= len(data))
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        _need(size >= 2 and at + 2 + size <= len(data))
        yield f"{mark:02X}", data[at + 4 : at + 2 + size]
        coded = coded or mark == 0xDA
        at += 2 + size


#: Marks of frame headers.
FRAMES = frozenset(f"{m:02X}" for m in range(0xC0, 0xD0)) - {"C4", "C8", "CC"}


def jpeg(data: bytes) -> tuple[int, int, int]:
    parts = list(jpeg_parts(data))
    frames, turned = [body for name, body in parts if name in FRAMES], [orientation(body) for name, body in parts if name == "E1"]
    _need(len(frames) == 1 and len(frames[0]) >= 6 and any(name == "DA" for name, _ in parts))
    height, width = struct.unpack_from(">HH", frames[0], 1)
    return width, height, turned[-1] if turned else 1


def webp_parts(data: bytes) -> Iterator[Part]:
    _need(len(data) >= 20 and data[8:12] == b"WEBP" and int.from_bytes(data[4:8], "little") + 8 == len(data))
    at = 12
    while at < len(data):
        _need(at + 8 <= len(data))
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        _need(end <= len(data) and (not (end - at) % 2 or data[end : end + 1] == b"\0"))
        yield data[at : at + 4].decode("latin-1"), data[at + 8 : end]
        at = end + (end - at) % 2


#: Optional parts of a WebP file and the bit that announces each.
ANNOUNCED = {"ICCP": 0x20, "ALPH": 0x10, "EXIF": 0x08, "XMP ": 0x04}


def webp(data: bytes) -> tuple[int, int, int]:
    parts = list(webp_parts(data))
    names = [name for name, _ in parts]
    _need(not {"ANIM", "ANMF"} & {*names}, ANIMATED)
    pictures = [i for i, name in enumerate(names) if name in ("VP8 ", "VP8L")]
    _need(len(pictures) == 1 and names.count("VP8X") == (names[0] == "VP8X"))
    at, body = pictures[0], parts[pictures[0]][1]
    if names[at] == "VP8 ":
        _need(len(body) >= 10 and not body[0] & 1 and body[3:6] == b"\x9d\x01\x2a")
        width, height, clear = *(v & 0x3FFF for v in struct.unpack_from("<HH", body, 6)), False
    else:
        _need(len(body) >= 5 and body[0] == 0x2F and not body[4] >> 5 and "ALPH" not in names)
        bits = int.from_bytes(body[1:5], "little")
        width, height, clear = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, bool(bits >> 28 & 1)
    _need(width and height)
    optional = {name: names.index(name) for name in ANNOUNCED if name in names}
    if names[0] != "VP8X":
        _need(at == 0 and not optional)
        return width, height, 1
    head = parts[0][1]
    _need(len(head) == 10)
    _need(not head[0] & 2, ANIMATED)
    _need(not head[0] & 0xC1 and not any(head[1:4]) and (int.from_bytes(head[4:7], "little") + 1, int.from_bytes(head[7:10], "little") + 1) == (width, height))
    announced = {name for name, bit in ANNOUNCED.items() if head[0] & bit}
    _need(announced == {*optional} | ({"ALPH"} if clear else set()))
    _need(all(names.count(name) == 1 and parts[i][1] and (i < at) == (name in ("ICCP", "ALPH")) for name, i in optional.items()))
    return width, height, orientation(parts[optional["EXIF"]][1]) if "EXIF" in optional else 1


KINDS = {b"\x89PNG\r\n\x1a\n": ("image/png", png), b"\xff\xd8\xff": ("image/jpeg", jpeg), b"RIFF": ("image/webp", webp)}


def judged(data: bytes | None) -> tuple:
    """Kind, stored width and height, orientation, and why the file isn't taken; null if it is."""
    if not data:
        return None, None, None, 1, EMPTY
    mime, walk = next((kind for mark, kind in KINDS.items() if data.startswith(mark)), (None, None))
    if walk is None:
        return None, None, None, 1, DAMAGED if data[:4] == b"\x89PNG" else UNKNOWN
    try:
        width, height, turned = walk(data)
        _need(width and height)
    except Refused as refused:
        return mime, None, None, 1, str(refused)
    return mime, width, height, turned, TOO_MANY_PIXELS if width * height > MOST_PIXELS else None


HEADER = "mime string, stored_width bigint, stored_height bigint, orientation int, refused string"


def image_header(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judged(x) for x in content], columns=["mime", "stored_width", "stored_height", "orientation", "refused"]).astype({"stored_width": "Int64", "stored_height": "Int64"})


def image_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder: kind, size as shown, whether they can be taken, and why not."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # a filter on the length reaches the reader, so files over the limit aren't read
    small = rows.filter(F.col("length") <= MOST_BYTES).select("path", "length", F.pandas_udf(image_header, HEADER)("content").alias("h")).select("path", "length", "h.*")
    none = {name: F.lit(None).cast(kind) for name, kind in (field.split() for field in HEADER.split(", "))}
    large = rows.filter(F.col("length") > MOST_BYTES).select("path", "length").withColumns(none | {"refused": F.lit(TOO_LARGE)})
    shown = oriented(F.col("stored_width"), F.col("stored_height"), F.col("orientation"))
    return small.unionByName(large).withColumn("shown", shown).select("path", "length", "mime", F.col("shown.width").alias("width"), F.col("shown.height").alias("height"), F.col("refused").isNull().alias("accepted"), "refused")
