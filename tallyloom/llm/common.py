"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts on whole texts: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a local session without ``spark.checkpoint.dir`` (tests) gets one of its own: on a
    cluster no executor would see another's files there.
    """
    sc = spark.sparkContext
    if not (root := sc.getCheckpointDir()):
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
        root = sc.getCheckpointDir()
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for files that one job writes and another reads."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that losing executors loses no work."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers that are worth a task of their own.
TASK_ROWS = 200_000


def tasks(rows: int) -> int:
    """How many tasks so many small rows ask for.

    For ``coalesce``: a shuffle writes files for each task before it, so results of a few
    thousand rows in as many tasks as large tables have would fill disks with empty files.
    """
    return max(1, -(-rows // TASK_ROWS))


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder: for wide rows that are read several times."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def named_by(facts: DataFrame, names: DataFrame, keys: list[str], salt: list[str], total: int, share: int = 4096, every: bool = False) -> DataFrame:
    """``facts`` with the other columns of ``names``: one row a key, with ``n_rows``, the number of the ``total`` facts that have it.

    Fewer than ``share`` keys can hold more than one in ``share`` of the facts each.  Their
    names are broadcast, and their facts are dealt by ``salt`` and not to one task, as are
    facts without a key.  Facts without a name come back with ``every`` only.
    """
    values = F.struct(*[c for c in names.columns if c not in (*keys, "n_rows")])
    often = names.filter(F.col("n_rows") * share > total).select(*keys, values.alias("_often"))
    alone = F.col("_often").isNotNull() | F.col(keys[0]).isNull()
    marked = facts.join(F.broadcast(often), keys, "left").withColumn("_at", F.when(alone, F.xxhash64(*salt).cast(facts.schema[keys[0]].dataType)).otherwise(F.col(keys[0])))
    others = names.select(F.col(keys[0]).alias("_at"), *[F.col(k).alias(f"_{k}") for k in keys[1:]], values.alias("_other"))
    met = F.lit(True)
    for k in keys[1:]:
        met &= marked[k] == others[f"_{k}"]
    named = marked.join(others, (marked["_at"] == others["_at"]) & met, "left").withColumn("_name", F.when(alone, F.col("_often")).otherwise(F.col("_other")))
    return (named if every else named.filter(F.col("_name").isNotNull())).select(*facts.columns, "_name.*")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once even if ``body`` has lambdas that use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def taken(lists: list[bytes], indices: pa.Array) -> pa.ListArray:
    """For each index, the 32-bit integers that are packed at it in ``lists``."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64) >> 2
    values = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(lists), "<i4")))
    return values.take(indices)


def slices(batches: Iterable[pa.RecordBatch], column: int, chars: int = 2_000_000, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that no slice has many more than ``chars`` bytes of text.

    A single longer text stays whole, in a slice of its own.
    """
    for batch in batches:
        start, total = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, size in enumerate(sizes):
            if i > start and (total + size > chars or i - start >= rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)
