"""Operator 4: tool-call linking for chat data.

Calls, results and schemas are hash-joined by conversation and call identifier, and by
tool name; calls are put into topological order of their dependencies, checked against
their tools' schemas and serialised with their results as canonical JSON (sorted keys,
no blanks).

Order: a call's place is a pair (latest position among itself and what it depends on,
steps behind the call at that position).  A call on a cycle has no place, nor has one
that depends on a cycle with nothing later: both are ``cyclic``, have ``steps`` 0 and
come last.  Ties go by position, identifier, name and arguments.

Scale: conversations of up to ``most_calls`` calls are streamed through partitions sorted
by conversation, one at a time in memory, so the plan has the same exchanges however
long chains are.  Longer ones are never gathered in one task: rounds of joins relax
their places (as many as the longest chain of forward references has calls, or twice those of
the longest cycle), and ranks
come from range partitions and the counts of the partitions before.

Defined results: calls with null ids link to nothing, and those of a null conversation
have no rank; of calls with the same id in a conversation the earliest count (all at its
position), others are ``duplicate`` and share its place; the earliest result of a call
counts (ties by text), ``n_results`` counts all; results without a call are returned by
:func:`orphans`; arguments that aren't a JSON object are faulty, among them numbers that
JSON can't hold and nesting that is too deep to read, and are serialised as the text they
are; half a surrogate pair stays an escape; of equal keys in an object the last counts;
of schemas with one name the smallest text counts; very long texts pass whole; an empty
table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
_HALF = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys and no blanks."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _finite(text: str) -> float:
    if not math.isfinite(value := float(text)):
        raise ValueError("no number of JSON")
    return value


def parsed(text: str | None):
    """The value of a JSON text; ValueError where there is none that can be read and written again."""
    try:
        value = json.loads(text or "", parse_constant=_finite, parse_float=_finite)
        json.dumps(value)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    return value


def _of(rules: dict, key: str, kind, default):
    """A schema's rule, if it is of the kind that it should be."""
    return rules[key] if isinstance(rules.get(key), kind) else default


def _is(value, kind: str) -> bool:
    return kind not in KINDS or isinstance(value, KINDS[kind]) and (not isinstance(value, bool) or kind == "boolean")


def faults(arguments: str | None, schema: dict | None) -> list[str]:
    """What is wrong with a call's arguments, sorted; an unknown tool has no schema."""
    if schema is None:
        return ["unknown tool"]
    try:
        value = parsed(arguments)
    except ValueError:
        return ["not JSON"]
    if not isinstance(value, dict):
        return ["not an object"]
    known = _of(schema, "properties", dict, {})
    out = [f"missing {k}" for k in _of(schema, "required", list, []) if isinstance(k, str) and k not in value]
    for k, v in value.items():
        if k not in known:
            if schema.get("additionalProperties", True) is False:
                out.append(f"unexpected {k}")
            continue
        rule = known[k] if isinstance(known[k], dict) else {}
        kinds = rule.get("type", [])
        kinds = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        if kinds and not any(_is(v, kind) for kind in kinds):
            out.append(f"{k} is not {' or '.join(kinds)}")
        elif v not in _of(rule, "enum", list, [v]):
            out.append(f"{k} not in enum")
        elif number and (v > _of(rule, "maximum", (int, float), v) or v < _of(rule, "minimum", (int, float), v)):
            out.append(f"{k} out of range")
        elif isinstance(v, str) and len(v) > _of(rule, "maxLength", int, len(v)):
            out.append(f"{k} too long")
    return sorted(_HALF.sub("\ufffd", x) for x in out)


@lru_cache(maxsize=2000)
def _schema(text: str | None) -> dict | None:
    """A schema's JSON; one that isn't an object allows everything."""
    if text is None:
        return None
    try:
        value = parsed(text)
    except ValueError:
        value = {}
    return value if isinstance(value, dict) else {}


def order(nodes: dict[str, tuple[int, set[str]]]) -> dict[str, tuple[int, int, bool]]:
    """Latest position, steps and whether cyclic, of each call (position and what it depends on) of one conversation.

    Strongly connected groups come after all that they depend on, by an explicit stack.
    """
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    out: dict[str, tuple[int, int, bool]] = {}
    held: list[str] = []
    for start in nodes:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        held.append(start)
        stack = [(start, iter(nodes[start][1]))]
        while stack:
            call, rest = stack[-1]
            for on in rest:
                if on not in nodes:
                    continue
                if on not in number:
                    number[on] = low[on] = len(number)
                    held.append(on)
                    stack.append((on, iter(nodes[on][1])))
                    break
                if on not in out:
                    low[call] = min(low[call], number[on])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[call])
                if low[call] == number[call]:
                    group = []
                    while not group or group[-1] != call:
                        group.append(held.pop())
                    _place(group, nodes, out)
    return out


def _place(group: list[str], nodes: dict[str, tuple[int, set[str]]], out: dict[str, tuple[int, int, bool]]) -> None:
    """Places of a group of calls that depend on each other, or of one call."""
    own = set(group)
    best = max((nodes[x][0], 0, 0) for x in group)
    for x in group:
        for on in nodes[x][1]:
            if on in out and on not in own:
                latest, steps, cyclic = out[on]
                best = max(best, (latest, int(cyclic), steps + 1))
    round_ = len(group) > 1 or group[0] in nodes[group[0]][1]
    latest, behind, steps = best
    cyclic = round_ or bool(behind)
    out.update((x, (latest, 0 if cyclic else steps, cyclic)) for x in group)


def first_calls(calls: DataFrame) -> DataFrame:
    """``calls`` with ``duplicate``: whether the identifier stands earlier in the conversation."""
    least = calls.filter(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min("position").alias("_first"))
    return calls.join(least, ["conv_id", "call_id"], "left").withColumn("duplicate", F.coalesce(F.col("position") > F.col("_first"), F.lit(False))).drop("_first")


def places(calls: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id``, ``latest``, ``steps`` and ``cyclic`` of the first call of each identifier.

    Needs ``conv_id``, ``call_id``, ``position`` and ``depends_on`` (array of identifiers).
    """
    nodes = cut(calls.filter("not duplicate and call_id is not null and conv_id is not null").groupBy("conv_id", "call_id", "position").agg(F.flatten(F.collect_set(F.coalesce("depends_on", F.array().cast("array<string>")))).alias("depends_on")))
    known = nodes.select("conv_id", F.col("call_id").alias("on"), F.col("position").alias("on_position"))
    edges = cut(nodes.select("conv_id", "call_id", "position", F.explode(F.array_distinct("depends_on")).alias("on")).join(known, ["conv_id", "on"]))
    state = cut(nodes.select("conv_id", "call_id", F.col("position").cast("long").alias("latest"), F.lit(0).cast("long").alias("steps")))
    while True:
        offered = edges.join(state.select("conv_id", F.col("call_id").alias("on"), "latest", "steps"), ["conv_id", "on"])
        best = offered.groupBy("conv_id", "call_id").agg(F.max(F.struct("latest", (F.col("steps") + 1).alias("steps"))).alias("best"))
        moves = F.col("best").isNotNull() & ((F.col("best.latest") > F.col("latest")) | ((F.col("best.latest") == F.col("latest")) & (F.col("best.steps") > F.col("steps"))))
        joined = state.select("conv_id", "call_id", "latest", "steps").join(best, ["conv_id", "call_id"], "left").withColumn("moves", moves)
        new = joined.select("conv_id", "call_id", F.when(F.col("moves"), F.col("best.latest")).otherwise(F.col("latest")).alias("latest"), F.when(F.col("moves"), F.col("best.steps")).otherwise(F.col("steps")).alias("steps"), "moves")
        alike = new.groupBy("conv_id", "latest").agg(F.count("*").alias("alike"))
        state = cut(new.join(alike, ["conv_id", "latest"]))
        # as many steps behind a position as calls share it: only a cycle makes that, and at
        # twice as many every call of the cycle has gone round
        if not state.filter("moves and steps < 2 * alike").limit(1).count():
            break
    cyclic = F.col("steps") >= F.col("alike")
    return state.select("conv_id", "call_id", "latest", F.when(cyclic, 0).otherwise(F.col("steps")).alias("steps"), cyclic.alias("cyclic"))


FIELDS = ["conv_id", "position", "call_id", "name", "arguments", "depends_on", "n_results", "content", "schema"]
_TIES = ("position", "call_id", "name", "arguments")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, most_calls: int = 10_000) -> DataFrame:
    """One row a call: ``conv_id``, ``position``, ``call_id``, ``name``, ``duplicate``, ``n_results``,
    ``latest``, ``steps``, ``cyclic``, ``rank`` (place in topological order), ``valid``, ``faults`` and ``json``.

    ``calls``: conv_id, position, call_id, name, arguments, depends_on; ``results``: conv_id,
    position, call_id, content; ``schemas``: name, schema (JSON text).
    """
    rows = calls.select("conv_id", F.col("position").cast("long").alias("position"), "call_id", "name", "arguments", "depends_on")
    answered = results.filter(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min(F.struct("position", "content")).alias("answer"), F.count("*").alias("n_results"))
    tools = schemas.filter("name is not null").groupBy("name").agg(F.coalesce(F.min("schema"), F.lit("{}")).alias("schema"))
    joined = rows.join(answered, ["conv_id", "call_id"], "left").join(tools, "name", "left").withColumns({"n_results": F.coalesce("n_results", F.lit(0)).cast("long"), "content": F.col("answer.content")}).select(*FIELDS)
    kind = rows.schema["conv_id"].dataType.simpleString()
    far = rows.groupBy("conv_id").agg(F.count("*").alias("n")).filter((F.col("n") > most_calls) & F.col("conv_id").isNotNull()).select("conv_id")
    far = cut(far)  # used twice
    near = joined if far.isEmpty() else joined.join(far, "conv_id", "left_anti")
    alone = F.xxhash64("position", "call_id", "arguments")  # rows without a conversation stand for themselves
    dealt = near.repartition(F.when(F.col("conv_id").isNull(), alone).otherwise(F.xxhash64("conv_id"))).sortWithinPartitions("conv_id", *_TIES)
    columns = {"conv_id": kind, "position": "bigint", "call_id": "string", "name": "string", "duplicate": "boolean", "n_results": "bigint", "latest": "bigint", "steps": "bigint", "cyclic": "boolean", "rank": "bigint", "valid": "boolean", "faults": "array<string>", "json": "string"}
    schema = ", ".join(f"{k} {v}" for k, v in columns.items())

    def rows_of(some: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names=list(columns))

    def kinds_of(batch: pa.RecordBatch) -> list[pa.DataType]:
        return [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.string()]

    def by_conversation(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, out, kinds = [], [], None
        for batch in batches:
            kinds = kinds_of(batch)
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if conversation and (row[0] is None or row[0] != conversation[0][0]):
                    out += ranked(conversation)
                    conversation = []
                    if len(out) >= 1000:
                        yield rows_of(out, kinds)
                        out = []
                conversation.append(row)
        if conversation:
            yield rows_of(out + ranked(conversation), kinds)

    def one_by_one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [finished(row[: len(FIELDS)], *row[len(FIELDS) :]) for row in zip(*(c.to_pylist() for c in batch.columns))]
            if some:
                yield rows_of(some, kinds_of(batch))

    done = dealt.mapInArrow(by_conversation, schema)
    return done if far.isEmpty() else done.unionByName(_far(joined.join(far, "conv_id", "left_semi")).mapInArrow(one_by_one, schema))


def finished(row: tuple, duplicate: bool, latest: int, steps: int, cyclic: bool, rank: int | None) -> tuple:
    """The result row of a call."""
    conv, position, call, name, arguments, _, n_results, content, schema = row
    wrong = faults(arguments, _schema(schema))
    try:
        value = parsed(arguments)
    except ValueError:
        value = arguments
    return conv, position, call, name, duplicate, n_results, latest, steps, cyclic, rank, not wrong, wrong, canonical({"id": call, "name": name, "arguments": value, "result": content})


def ranked(conversation: list[tuple]) -> list[tuple]:
    """Result rows of the calls of one conversation, in the order given."""
    nodes: dict[str, tuple[int, set[str]]] = {}
    for _, position, call, _, _, on, *_ in conversation if conversation[0][0] is not None else []:
        if call is not None and (call not in nodes or nodes[call][0] == position):
            nodes.setdefault(call, (position, set()))[1].update(x for x in on or [] if x is not None)
    places = order(nodes)
    found = [places.get(row[2]) or (row[1], 0, False) for row in conversation]
    text = lambda x: (x is not None, x or "")
    by = sorted(range(len(conversation)), key=lambda i: (found[i][2], found[i][0], found[i][1], conversation[i][1], *map(text, conversation[i][2:5])))
    rank = {i: k + 1 for k, i in enumerate(by)} if conversation[0][0] is not None else {}
    return [finished(row, row[2] in nodes and row[1] > nodes[row[2]][0], *found[i], rank.get(i)) for i, row in enumerate(conversation)]


def _far(joined: DataFrame) -> DataFrame:
    """Rows of conversations that are too long for one task, with what ``finished`` wants after them."""
    marked = cut(first_calls(joined))
    placed = marked.join(places(marked), ["conv_id", "call_id"], "left").withColumns({"latest": F.coalesce("latest", "position").cast("long"), "steps": F.coalesce("steps", F.lit(0)).cast("long"), "cyclic": F.coalesce("cyclic", F.lit(False))})
    keys = ("conv_id", "cyclic", "latest", "steps", *_TIES)
    dealt = cut(placed.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))  # the partition numbers must not change between the two uses
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*keys[1:]))
    return dealt.withColumn("place", place).join(base, ["conv_id", "part"]).select(*FIELDS, "duplicate", "latest", "steps", "cyclic", (F.col("base") + F.col("place")).cast("long").alias("rank"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose identifier no call of the conversation has."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")


#: The tools that turns of ``conversations`` are read as calls of.
TOOLS = [
    ("search", {"properties": {"query": {"type": "string", "maxLength": 400}, "limit": {"type": "integer", "minimum": 1, "maximum": 60}}, "required": ["query", "limit"], "additionalProperties": False}),
    ("fetch", {"properties": {"query": {"type": "string"}, "limit": {"type": "integer", "maximum": 200}}, "required": ["query"], "additionalProperties": True}),
    ("notes", {"properties": {"query": {"type": "string"}}, "required": ["query"], "additionalProperties": False}),
]


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read chat turns as calls, results and schemas: assistant turns call, the turn after them answers.

    The call's identifier is its text's checksum in the conversation (repeated texts
    repeat identifiers); its tool, its arguments and what it depends on follow from the text.
    """
    turns = turns.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).withColumn("text", F.coalesce("text", F.lit("")))
    code = F.crc32(F.col("text").cast("binary"))
    named = F.concat(F.lit("call_"), F.lower(F.hex(code)))
    limit = F.size(F.split("text", " "))
    arguments = F.when(code % 23 == 0, F.col("text")).otherwise(F.to_json(F.struct(F.when(code % 17 != 0, F.substring_index("text", ".", 1)).alias("query"), F.when(code % 3 != 2, limit).alias("limit"))))
    tool = F.element_at(F.array(*[F.lit(n) for n in ("search", "fetch", "notes", "erase")]), F.when(code % 29 == 0, 4).otherwise(code % 3 + 1).cast("int"))
    acts = cut(turns.filter("role = 'assistant'").select("conv_id", F.col("turn").cast("long").alias("position"), named.alias("call_id"), tool.alias("name"), arguments.alias("arguments"), code.alias("code")))
    at = acts.select("conv_id", F.col("position").alias("to"), F.col("call_id").alias("target")).distinct()
    # most calls build on the one before; one in seven refers forward to the next
    refer = acts.select("conv_id", "position", (F.col("position") + F.when(F.col("code") % 7 == 0, 2).otherwise(-2)).alias("to")).distinct()
    on = refer.join(at, ["conv_id", "to"]).groupBy("conv_id", "position").agg(F.array_sort(F.collect_set("target")).alias("depends_on"))
    calls = acts.join(on, ["conv_id", "position"], "left").select("conv_id", "position", "call_id", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    answers = turns.filter("role <> 'assistant'").select("conv_id", F.col("turn").cast("long").alias("position"), F.col("text").alias("content"))
    results = answers.join(acts.select("conv_id", (F.col("position") + 1).alias("position"), "call_id").distinct(), ["conv_id", "position"])
    schemas = turns.sparkSession.createDataFrame([(n, json.dumps(s)) for n, s in TOOLS], "name string, schema string")
    return calls, results, schemas
