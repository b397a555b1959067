"""Operator 1: WARC archives with a two-level capture index.

``write_archives`` writes one gzip member a record and returns a capture line for
each: sort-friendly URL key (host reversed), page, file, offset and length.
``write_index`` sorts the captures by key over range partitions; each partition
writes one shard of compressed blocks of lines, then its sparse block directory
(first key of each block).  Only the shards' first keys, one entry a partition,
reach the driver.  ``lookup`` binary-searches shards and a shard's directory for the
blocks that can hold a key, then searches those blocks, dealt by block: a key of very many
captures is read by many tasks.  It reads nothing but those byte ranges; ``fetch`` reads
the records' ranges in file order.

Payloads join the first page of their digest; the digests of very many pages, and small
payloads, which refer to nothing, are dealt by page instead.

A task writes files under names of its own attempt and returns rows that name them,
so a lost executor's work is written anew and its leftovers are never read.

Defined results: a null html is an empty payload; a null url has the key ``)``; rows of
one page id with equal payloads are all responses if the id is the smallest; repeated rows
give repeated records; an empty table gives no archives and empty results; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, named_by, slices

RESPONSE, REVISIT = "response", "revisit"


def _filesystem(folder: str):
    """The file system of a shared folder, made in the task that uses it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _uri(folder: str) -> str:
    """``file:/x`` as ``file:///x``; other addresses as they are."""
    return f"file://{folder[5:]}" if folder.startswith("file:/") and not folder.startswith("file://") else folder


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query`` of a URL."""
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?"
    host, rest = F.lower(F.regexp_extract(url, pattern, 1)), F.regexp_replace(url, pattern, "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(")"))


def captures(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Payload, digest and record type of every page."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long"), "url_key": url_key(F.col("url"))})
    rows = rows.withColumn("digest", F.when(F.col("payload_bytes") >= least_bytes, F.col("payload_digest")))
    first = rows.filter("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n_rows")).filter("n_rows > 1")
    named = named_by(rows, cut(first), ["digest"], ["page_id", "url"], pages.count(), every=True)
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return named.select(
        "page_id", "url", "url_key", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, REVISIT).otherwise(RESPONSE).alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    """One uncompressed WARC/1.1 record; a revisit has no payload."""
    body = payload if kind == RESPONSE else b""
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target}')}>", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", f"X-Page-Id: {'' if page_id is None else page_id}", "Content-Type: text/html", f"Content-Length: {len(body)}",
    ]
    if kind == REVISIT:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.partition(": ")[::2] for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _packed(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write one archive a task; ``url_key``, ``page_id``, ``file``, ``offset`` and ``length`` of each record."""
    kind, folder = rows.schema["page_id"].dataType.simpleString(), _uri(folder)
    rows = rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        name, out, at = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        for part in slices(batches, 2):
            out = out or system.open_output_stream(name, compression=None)
            places = []
            for values in zip(*(c.to_pylist() for c in part.columns[:7])):
                data = _packed(record(*values))
                out.write(data)
                places.append((at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([part.column(7), part.column(0), pa.array([name] * len(places)), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())], names=["url_key", "page_id", "file", "offset", "length"])
        if out:
            out.close()

    return rows.mapInArrow(run, f"url_key string, page_id {kind}, file string, offset bigint, length bigint")


def write_index(captured: DataFrame, folder: str, lines: int = 256) -> list[tuple]:
    """Write the shards; (first key, file, directory offset, directory length) of each, in key order."""
    folder = _uri(folder)
    order = ["url_key", "page_id", "file", "offset"]
    dealt = captured.select(*order, "length").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        name, out, at, directory, held = f"{root}/{uuid.uuid4().hex}.cdx", None, 0, [], []

        def block() -> None:
            nonlocal at
            data = _packed("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode("utf-8", "surrogatepass"))
            out.write(data)
            directory.append([held[0][0], at, len(data)])
            at += len(data)
            held.clear()

        for batch in batches:
            out = out or system.open_output_stream(name, compression=None)
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(list(row))
                if len(held) == lines:
                    block()
        if out:
            if held:
                block()
            data = _packed(json.dumps(directory, ensure_ascii=False).encode("utf-8", "surrogatepass"))
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (directory[0][0], name, at, len(data))], names=["first", "file", "offset", "length"])

    shards = dealt.mapInArrow(run, "first string, file string, offset bigint, length bigint").collect()  # one row a partition
    return sorted((r["first"], r["file"], r["offset"], r["length"]) for r in shards)


class Index:
    """A reader of the index for sorted keys or blocks: keeps one directory and one block."""

    def __init__(self, folder: str, shards: list[tuple]):
        self.system, _ = _filesystem(_uri(folder))
        self.shards, self.first, self.kept = shards, [s[0] for s in shards], {}

    def _read(self, slot: str, file: str, offset: int, length: int) -> list:
        if self.kept.get(slot, (None,))[0] != (file, offset):
            with self.system.open_input_file(file) as f:
                data = zlib.decompress(f.read_at(length, offset), 31).decode("utf-8", "surrogatepass")
            self.kept[slot] = ((file, offset), json.loads(data) if slot == "directory" else [json.loads(x) for x in data.split("\n")])
        return self.kept[slot][1]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of the blocks that can hold a key: binary search in shards and directory, then onwards while blocks start no later."""
        shard = max(0, bisect.bisect_left(self.first, key) - 1)
        for _, file, offset, length in self.shards[shard:]:
            directory = self._read("directory", file, offset, length)
            if directory[0][0] > key:
                return
            at = max(0, bisect.bisect_left(directory, key, key=lambda e: e[0]) - 1)
            for first, start, size in directory[at:]:
                if first > key:
                    return
                yield file, start, size

    def lines(self, key: str, file: str, start: int, size: int) -> Iterator[list]:
        """The captures of a key in one block, by binary search."""
        block = self._read("block", file, start, size)
        for line in block[bisect.bisect_left(block, key, key=lambda e: e[0]) :]:
            if line[0] != key:
                return
            yield line


def lookup(keys: DataFrame, folder: str, shards: list[tuple], page_id_type: str = "bigint", partitions: int | None = None) -> DataFrame:
    """Captures of the distinct values of ``url_key``, found through the index.

    Places of blocks are small and blocks aren't; say the number of tasks that read blocks
    by ``partitions`` where the captures are many.
    """
    shared = keys.sparkSession.sparkContext.broadcast(shards)  # one entry a partition of the index
    sought = keys.select("url_key").distinct().repartitionByRange("url_key").sortWithinPartitions("url_key")

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, kinds = Index(folder, shared.value), [pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            held = []
            for key in batch.column(0).to_pylist():
                for place in index.blocks(key):
                    held.append((key, *place))
                    if len(held) == 5000:
                        yield _rows(held, kinds, ["url_key", "file", "start", "size"])
                        held = []
            yield _rows(held, kinds, ["url_key", "file", "start", "size"])

    def captured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, kinds = Index(folder, []), [pa.string(), {"bigint": pa.int64(), "int": pa.int32()}.get(page_id_type, pa.string()), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            held = []
            for place in zip(*(c.to_pylist() for c in batch.columns)):
                held += index.lines(*place)
                if len(held) >= 5000:
                    yield _rows(held, kinds, ["url_key", "page_id", "file", "offset", "length"])
                    held = []
            yield _rows(held, kinds, ["url_key", "page_id", "file", "offset", "length"])

    found = sought.mapInArrow(places, "url_key string, file string, start bigint, size bigint")
    dealt = found.repartition(*filter(None, [partitions]), "file", "start").sortWithinPartitions("file", "start", "url_key")  # a block is read once
    return dealt.mapInArrow(captured, f"url_key string, page_id {page_id_type}, file string, offset bigint, length bigint")


def _rows(lines: list, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], kind) for i, kind in enumerate(kinds)], names=names)


def fetch(captured: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """Read the records of captures: ``page_id``, ``url``, ``record_type``, ``refers_to`` and what the payload holds.

    Capture lines are small and records aren't, so the number of tasks follows the bytes
    to read; say it by ``partitions`` where the captures are many.
    """
    kind, folder = captured.schema["page_id"].dataType.simpleString(), _uri(folder)
    slim, by = captured.select("file", "offset", "length", "page_id"), ("file", "offset")
    dealt = (slim.repartitionByRange(partitions, *by) if partitions else slim.repartitionByRange(*by)).sortWithinPartitions(*by)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(folder)
        open_name, source = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, out = batch.slice(i, 256), []
                for name, offset, length in zip(*(part.column(k).to_pylist() for k in range(3))):
                    if name != open_name:
                        if source:
                            source.close()
                        open_name, source = name, system.open_input_file(name)
                    fields, body = parse(zlib.decompress(source.read_at(length, offset), 31))
                    whole = fields["WARC-Type"] == RESPONSE
                    out.append((fields["WARC-Target-URI"], fields["WARC-Type"], fields.get("X-Refers-To-Page-Id"), fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"]), body if whole else None))
                kinds = [pa.string()] * 4 + [pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(3), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], names=["page_id", "url", "record_type", "refers_to", "stated_digest", "stated_bytes", "payload"])
        if source:
            source.close()

    return dealt.mapInArrow(run, f"page_id {kind}, url string, record_type string, refers_to string, stated_digest string, stated_bytes bigint, payload binary")


def digests(records: DataFrame) -> DataFrame:
    """Per record: length and digest of the full payload, computed where the record holds it, as stated for revisits."""
    kind = records.schema["page_id"].dataType
    whole = F.col("payload").isNotNull()
    return records.select(
        "page_id", F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("stated_digest")).alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )


def archive_and_read(spark: SparkSession, pages: DataFrame, folder: str, least_bytes: int = 100, task_bytes: int = 16 << 20, task_captures: int = 20_000) -> DataFrame:
    """Archive all pages, index them, look every key up in the index and read the records back."""
    written = cut(write_archives(captures(pages, least_bytes), f"{folder}/archives"))
    shards = write_index(written, f"{folder}/index")
    n, total = written.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    found = lookup(written, f"{folder}/index", shards, written.schema["page_id"].dataType.simpleString(), -(-n // task_captures) or 1)
    return fetch(found, f"{folder}/archives", -(-total // task_bytes) or 1)
