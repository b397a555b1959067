"""Command logs and chart results as structured streams."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.quantities import is_low
from ..operators.command_log import COLUMNS, RESULT, Entries, applied, nullable, prepared

#: Of what a state row holds; a row of an older version is brought up when it is read.
STATE_VERSION = 3
#: Tables of a ledger's state whose rows are JSON; stock and head have typed columns.
BODIES = ("request", "make", "pattern", "usage", "draft")


class KeyedEntries(Entries):
    """A ledger's entries in keyed state: read on first use, written back only if a command changed them.

    ``maps``: a map state for each table, ``head``: a value state.  A trigger's cost grows with
    the entries that its commands touch, not with what the ledger has ever had.
    """

    def __init__(self, maps: dict, head):
        super().__init__()
        self.maps, self.head, self.changed, self.emptied = maps, head, {}, False

    def get(self, table: str, key: str = "") -> list | None:
        if (table, key) not in self.rows:
            self.rows[table, key] = None if self.emptied else self._read(table, key)
        return self.rows[table, key]

    def _read(self, table: str, key: str) -> list | None:
        if table == "head":
            return list(self.head.get()[1:]) if self.head.exists() else None
        if not self.maps[table].containsKey((key,)):
            return None
        row = self.maps[table].getValue((key,))
        return list(row[1:]) if table == "stock" else json.loads(row[1])

    def put(self, table: str, key: str, row: list) -> None:
        self.rows[table, key] = self.changed[table, key] = row

    def drop(self, table: str, key: str) -> None:
        self.rows[table, key] = self.changed[table, key] = None

    def clear(self) -> None:
        self.rows.clear()
        self.changed.clear()
        self.emptied = True

    def write(self) -> None:
        """Bring the state up to what was changed."""
        if self.emptied:
            for rows in self.maps.values():
                rows.clear()
        for (table, key), row in self.changed.items():
            if table == "head":
                self.head.update((STATE_VERSION, *row))
            elif row is not None:
                self.maps[table].updateValue((key,), (STATE_VERSION, *row) if table == "stock" else (STATE_VERSION, json.dumps(row)))
            elif not self.emptied and self.maps[table].containsKey((key,)):
                self.maps[table].removeKey((key,))
        self.changed.clear()
        self.emptied = False


class CommandProcessor(StatefulProcessor):
    """Commands of a ledger against its keyed state.  ``journal_ms``: how long a request can be repeated; null for ever."""

    def __init__(self, journal_ms: int | None = None):
        self.journal_ms = journal_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        body, kept = "version int, body string", {"request": self.journal_ms} if self.journal_ms else {}
        self.maps = {t: handle.getMapState(t, "key string", body, **({"ttlDurationMs": kept[t]} if t in kept else {})) for t in BODIES}
        self.maps["stock"] = handle.getMapState("stock", "key string", "version int, qty bigint, estimated boolean, baseline bigint, entered boolean")
        self.head = handle.getValueState("head", "version int, epoch bigint, seq bigint, percent bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = KeyedEntries(self.maps, self.head)
        commands = pd.concat(list(rows)).sort_values("seq")  # of one trigger
        yield pd.DataFrame([applied(state, c) for c in commands.itertuples(index=False)], columns=COLUMNS)
        state.write()

    def close(self) -> None:
        pass


def apply_stream(commands: DataFrame, palette: DataFrame, journal_ms: int | None = None) -> DataFrame:
    """Results of a stream of commands of every kind, ledger by ledger in order of ``seq`` inside a trigger.

    State is kept by entry: a row for each colour, request, make, pattern, usage and draft.
    Retries replay from the journal, so effects happen once; with ``journal_ms`` a request is
    forgotten after so long.  Needs the RocksDB state store (``session()`` sets it).
    """
    rows = nullable(prepared(commands, palette))
    return rows.groupBy("ledger_id").transformWithStateInPandas(CommandProcessor(journal_ms), RESULT, "append", "ProcessingTime" if journal_ms else "None")


def once_per_request(commands: DataFrame, at: str = "at", late: str = "1 day") -> DataFrame:
    """Commands without repeats of a request within the watermark, for sinks that need no conflict report."""
    return commands.withWatermark(at, late).dropDuplicatesWithinWatermark(["ledger_id", "request_id"])


#: What makes a recognition session the same: all of these, null equal to null.
IDENTITY = {"request_id": "string", "image_session": "bigint", "pattern_id": "string", "revision": "bigint", "confirmed_version": "bigint", "epoch": "bigint"}


def current_results(results: DataFrame, identities: DataFrame, keys: list[str]) -> DataFrame:
    """Results whose identity is a current one in every field, null equal to null; late ones drop (T3).  For tables; :func:`current_stream` follows identities that change."""
    known = identities.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return results.join(known, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_semi")


class CurrentIdentity(StatefulProcessor):
    """The latest identity of a page is its state; a result passes if it has all fields of that."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = "version int, at bigint, " + ", ".join(f"{k} {v}" for k, v in IDENTITY.items())
        self.latest = handle.getValueState("identity", kind, **({"ttlDurationMs": self.forget_ms} if self.forget_ms else {}))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.latest.get())[1:] if self.latest.exists() else None
        seen, out = now, []
        for r in pd.concat(list(rows)).sort_values(["at", "is_result"], kind="stable").itertuples(index=False):  # an identity comes before results of its time
            own = (int(r.at), *(None if getattr(r, k) is None else int(getattr(r, k)) if v == "bigint" else getattr(r, k) for k, v in IDENTITY.items()))
            if not r.is_result:
                now = own if now is None or own[0] >= now[0] else now  # one that comes late changes nothing
            elif now is not None and own[1:] == now[1:]:
                out.append((r.page_id, own[0], r.payload))
        if now != seen:
            self.latest.update((1, *now))
        yield pd.DataFrame(out, columns=["page_id", "at", "payload"])

    def close(self) -> None:
        pass


def current_stream(results: DataFrame, identities: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """Results (page_id, ``IDENTITY``, at, payload) of a stream that belong to the latest identity (page_id, ``IDENTITY``, at) of their page in another stream.

    The identity of a page may change at any time; results of an earlier one are dropped, as
    are those of a page that was closed: a row of identities with null in all fields.  State
    is one row a page, forgotten after ``forget_ms`` without change.
    """
    empty = reduce(Column.__and__, [F.col(k).isNull() for k in IDENTITY])
    fields = [F.col("page_id").cast("string"), F.col("at").cast("bigint"), *[F.col(k).cast("decimal(20,0)" if v == "bigint" else v) for k, v in IDENTITY.items()]]
    found = results.filter(~empty).select(*fields, F.col("payload").cast("string").alias("payload"), F.lit(True).alias("is_result"))
    named = identities.select(*fields, F.lit(None).cast("string").alias("payload"), F.lit(False).alias("is_result"))
    return found.unionByName(named).groupBy("page_id").transformWithStateInPandas(CurrentIdentity(forget_ms), "page_id string, at bigint, payload string", "append", "ProcessingTime" if forget_ms else "None")


def fold_blocks(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Keep a micro-batch of block checkpoints as its own partition of a shared folder (T4): for ``foreachBatch``.

    A retried batch replaces its own partition and nothing else; :func:`folded_blocks` reads the fold.
    """
    _last(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def _last(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("image_id", "block_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("at"))


def folded_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The last checkpoint of each block over all batches (T4)."""
    return _last(spark.read.parquet(folder))


def compact_blocks(spark: SparkSession, folder: str, into: str) -> None:
    """Write the fold as one batch of another folder, so that its readers have few files."""
    folded_blocks(spark, folder).write.mode("overwrite").parquet(f"{into}/batch=0")


def slow_requests(events: DataFrame, seconds: int = 30) -> DataFrame:
    """Requests without a result after so many seconds, flagged once; a later result still counts (T5).

    ``events``: image_id, kind (``request`` or ``result``), at.
    """
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"image_id": [key[0]], "state": ["slow"]})
            return
        kinds = {k for part in parts for k in part["kind"]}
        if "result" in kinds:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"image_id": [key[0]], "state": ["done"]})
        elif "request" in kinds:
            state.update((1,))
            state.setTimeoutDuration(seconds * 1000)

    return events.groupBy("image_id").applyInPandasWithState(run, "image_id bigint, state string", "version int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def low_alerts(moves: DataFrame, settings: DataFrame) -> DataFrame:
    """Movements that leave a colour low under its ledger's percentage (T6); a stream joined with a static table."""
    joined = moves.join(settings.select("ledger_id", "low_stock_percent"), "ledger_id", "left")
    return joined.filter(is_low(F.col("qty_after"), F.col("baseline_after"), F.coalesce("low_stock_percent", F.lit(10)))).select("ledger_id", "code", "qty_after", "baseline_after")
