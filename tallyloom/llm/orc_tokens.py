"""Operator 9: token ids in ORC files.

Texts are range-partitioned and sorted by document id, encoded in that order and
written as ORC: integers are run-length encoded, each stripe has row indexes
(minimum and maximum per ``row_index_stride`` rows) and a Bloom filter on the
document id.  Readers split the files by stripes and skip by that metadata.
Each row says its partition and how many ids stand before it there, so its place in
the stream of all ids is that number and the totals of the partitions before it,
which are one row a partition: ids are decoded once and no row is shuffled to read.

Encoding takes each distinct pre-token of a slice of texts once: class arrays over the
bytes find where pre-tokens start, Arrow numbers the distinct ones and puts their ids
back in place.  Words with characters that the class arrays don't know stay whole.

Defined results: a null text encodes as an empty one (only the end id); rows with
equal document ids keep the order of their texts' hashes (equal texts: of their place
in the input) in the files, and their positions are those of the files; null document
ids come first, dealt by the same order, so none is one task's burden; a very long text
is a slice of its own; strings of special tokens in a text are what the library makes
of them; an empty table gives an empty table; other columns are neither read nor returned.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_folder, slices, taken


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


BLANK, LETTER, DIGIT, REST, ODD = range(5)
#: Line ends to blanks, A-Z to a-z: the vocabulary's own normaliser does both.
_LOWER = bytes.maketrans(b"\nABCDEFGHIJKLMNOPQRSTUVWXYZ", b" abcdefghijklmnopqrstuvwxyz")
_CLASS = np.full(256, ODD, np.uint8)
_CLASS[0x21:0x7F] = REST
_CLASS[0x20], _CLASS[0x27] = BLANK, ODD  # an apostrophe can start a contraction
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("0") : ord("9") + 1] = LETTER, DIGIT
#: Second bytes of the Latin-1 letters from U+00C0 on.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: What is one pre-token of known characters.
_SIMPLE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: Fixed value: the pattern of the vocabulary's pre-tokens, which the classes follow.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def pieces(texts: list[bytes]) -> tuple[bytearray, np.ndarray, np.ndarray]:
    """Lower-cased texts end to end, where their pieces start (blanks belong to the piece before), and each text's first piece, and the end."""
    data = bytearray(b"".join([t.translate(_LOWER) + b" " for t in texts]))
    x = np.frombuffer(data, np.uint8)
    kind = _CLASS[x]
    lead = np.flatnonzero(x == 0xC3)
    lead = lead[_LATIN[x[lead + 1]]]
    kind[lead] = kind[lead + 1] = LETTER
    capital = lead[x[lead + 1] < 0x9F] + 1
    x[capital] += 0x20
    odd = np.flatnonzero(kind == ODD)
    if len(odd):  # their words are pieces as a whole
        word = np.cumsum(kind == BLANK)
        whole = np.zeros(word[-1] + 1, bool)
        whole[word[odd]] = True
        kind[whole[word] & (kind != BLANK)] = ODD
    start = kind != BLANK
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    starts = np.flatnonzero(start)
    return data, starts, np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]]))


class Words:
    """Ids of pieces by the tokenizers library, each new piece encoded once.

    For vocabularies that ignore case and drop white space: a text has the ids of its pieces in turn.
    The cache is emptied at ``capacity`` pieces; longer ones are not kept.
    """

    def __init__(self, path: str, capacity: int = 400_000, longest: int = 48):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.capacity, self.longest, self.seen = _tokenizer(path), capacity, longest, {}
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.levels = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        with open(path, "rb") as lines:
            self.simple = json.dumps(_PATTERN, ensure_ascii=False).encode() in lines.read()

    def __call__(self, texts: list[bytes], end_id: int) -> pa.ListArray:
        """The ids of each text, and the end id."""
        special = [i for i, t in enumerate(texts) if b"<|" in t]
        data, starts, edges = pieces([b"" if b"<|" in t else t for t in texts])
        offsets = np.append(starts, len(data)).astype(np.int32)
        numbered = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        ids = taken(self.lists([x.rstrip(b" ") for x in numbered.dictionary.to_pylist()]), numbered.indices)
        ends = ids.offsets.to_numpy()[edges].astype(np.int64)
        flat = np.insert(ids.values.to_numpy(), ends[1:], end_id)
        out = pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), pa.array(flat))
        if special:  # whole texts by the library, which knows its special tokens' strings
            parts = {i: [*self.tokenizer.encode(texts[i].decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, end_id] for i in special}
            out = pa.array([parts.get(i, x) for i, x in enumerate(out.to_pylist())], pa.list_(pa.int32()))
        return out

    def lists(self, some: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        found = list(map(self.seen.get, some))
        if missing := {x for x, ids in zip(some, found) if ids is None}:
            new = self.encoded(missing)
            found = [new[x] if ids is None else ids for x, ids in zip(some, found)]
            if len(self.seen) + len(new) > self.capacity:
                self.seen.clear()
            self.seen.update((x, ids) for x, ids in new.items() if len(x) <= self.longest)
        return found

    def encoded(self, some: set[bytes]) -> dict[bytes, bytes]:
        """Ids of each piece: one pre-token through the library's model, other words many as one text, told apart by their offsets."""
        out, other, tokenize, levels = {}, [], self.model.tokenize, self.levels
        for x in some:
            if self.simple and _SIMPLE.fullmatch(x):
                ids = [t.id for t in tokenize(x.decode() if x.isascii() else x.decode().translate(levels))]
                out[x] = struct.pack(f"<{len(ids)}i", *ids)
            else:
                other.append(x)
        for i in range(0, len(other), 2000):
            words = other[i : i + 2000]
            texts = [w.decode("utf-8", "surrogatepass") for w in words]
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(got.ids, "<i4").tobytes()
            starts = np.array(got.offsets, np.int64).reshape(-1, 2)[:, 0]
            edges = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(w) + 1 for w in texts])])).tolist()
            for w, a, b in zip(words, edges, edges[1:]):
                out[w] = ids[4 * a : 4 * b]
        return out


@cache
def _words(path: str) -> Words:
    return Words(path)


def encode(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of int, with the end id), ``n_ids``, ``part`` (the partition) and ``before``
    (ids of the partition's rows before it), partition by partition in the order of the rows."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, done = _words(path), TaskContext.get().partitionId(), 0
        for rows in slices(batches, 1, chars=1_000_000, rows=4096):
            ids = words(rows.column(1).to_pylist(), end_id)
            sizes = pc.list_value_length(ids).to_numpy().astype(np.int64)
            ends = np.cumsum(sizes) + done
            done = int(ends[-1])
            yield pa.RecordBatch.from_arrays([rows.column(0), ids, pa.array(sizes), pa.array(np.full(len(sizes), part, np.int32)), pa.array(ends - sizes)], names=["doc_id", "ids", "n_ids", "part", "before"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_ids bigint, part int, before bigint")


def write(docs: DataFrame, folder: str, path: str, end_id: int, partitions: int | None = None, row_index_stride: int = 1000, stripe_bytes: int = 16 << 20) -> None:
    """Write the ids of ``docs`` as ORC files whose names and rows follow the document ids."""
    order = ("doc_id", "_hash", "_place")  # the last two deal rows of one id to many tasks
    slim = docs.select("doc_id", "text").withColumns({"_hash": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    dealt = slim.repartitionByRange(partitions, *order) if partitions else slim.repartitionByRange(*order)
    encoded = encode(dealt.sortWithinPartitions(*order), path, end_id)
    (
        encoded.write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", row_index_stride)
        .option("orc.stripe.size", stripe_bytes)
        .orc(folder)
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of :func:`encode`; filters on ``doc_id`` reach the stripes' indexes and Bloom filters."""
    return spark.read.orc(folder)


def positions(stored: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``."""
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends, data = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64()), batch.column(2), batch.column(3)], names=["doc_id", "n_tokens", "ids_crc32", "part", "before"])

    # only the numbers are read for the totals: one row a partition of the writer
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    rows = stored.select("doc_id", "ids", "part", "before").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, part int, before bigint")
    return rows.join(F.broadcast(totals), "part").select("doc_id", (F.col("base") + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, folder: str, ids: list) -> DataFrame:
    """Stored rows of a few document ids: ORC skips stripes and row groups without them."""
    return read(spark, folder).filter(F.col("doc_id").isin(ids))
