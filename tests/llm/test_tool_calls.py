"""Tool-call linking against brute force, in one task a conversation and by rounds, with odd JSON and empty tables."""

import json
import random

import pytest

from tallyloom.llm import tool_calls

CALLS = "conv_id bigint, position bigint, call_id string, name string, arguments string, depends_on array<string>, rank string"
RESULTS = "conv_id bigint, position bigint, call_id string, content string, extra int"
SCHEMA = '{"properties":{"query":{"type":"string"},"limit":{"type":"integer"}},"required":["query","limit"]}'


def _brute(nodes):
    """Places by repeated relaxation from the definition; cycles by reachability."""
    reach = {x: {y for y in nodes[x][1] if y in nodes} for x in nodes}
    for _ in nodes:
        for x in nodes:
            reach[x] = reach[x].union(*(reach[y] for y in reach[x]))
    out = {}
    for x in nodes:
        latest = max([nodes[x][0], *(nodes[y][0] for y in reach[x])])
        # on a cycle, or behind one whose latest position nothing between exceeds
        cyclic = x in reach[x] or any(y in reach[y] and max([nodes[y][0], *(nodes[z][0] for z in reach[y])]) == latest and nodes[x][0] < latest for y in reach[x])
        out[x] = (latest, cyclic)

    def steps(x):
        if nodes[x][0] == out[x][0]:
            return 0
        return 1 + max(steps(y) for y in nodes[x][1] if y in nodes and out[y][0] == out[x][0])

    return {x: (latest, 0 if cyclic else steps(x), cyclic) for x, (latest, cyclic) in out.items()}


@pytest.mark.parametrize("most", [10_000, 2])
def test_order(spark, most):
    """Random graphs with cycles, duplicates and null keys; conversations of up to ten calls and of one."""
    rng, rows = random.Random(8), []
    for conv in range(25):
        ids = [f"c{k}" for k in range(rng.randint(1, 8))]
        for k, call in enumerate(ids):
            rows.append((conv, 2 * k, call, "search", "{}", rng.sample(ids + ["lost"], rng.choice([0, 1, 1, 2])) if len(ids) > 1 else None, "clash"))
        if rng.random() < 0.3:
            rows.append((conv, 99, ids[0], "search", "{}", [], "clash"))
    rows += [(None, 1, "a", "search", "{}", ["a"], ""), (None, 1, "a", "search", "{}", ["a"], ""), (3, 50, None, None, None, [None], "")]
    got = tool_calls.link(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), spark.createDataFrame([("search", None)], "name string, schema string"), most_calls=most).collect()
    assert len(got) == len(rows)
    for conv in range(25):
        own = [r for r in rows if r[0] == conv]
        first = {}
        for r in own:
            if r[2] is not None:
                first.setdefault(r[2], (r[1], set(r[5] or [])))
        places = _brute(first)
        found = [r for r in got if r.conv_id == conv]
        for r in found:
            assert (r.latest, r.steps, r.cyclic) == (places[r.call_id] if r.call_id is not None else (r.position, 0, False)), (conv, r.call_id)
            assert r.duplicate == (r.call_id is not None and r.position > first[r.call_id][0])
        assert sorted(r.rank for r in found) == list(range(1, len(own) + 1))
        rank = {r.call_id: r for r in found if not r.duplicate}
        for call, (_, on) in first.items():  # a topological order
            for y in on & first.keys():
                assert rank[call].cyclic or rank[y].rank < rank[call].rank or rank[y].cyclic
    assert all(r.rank is None and not r.cyclic and not r.duplicate for r in got if r.conv_id is None)


def test_links_and_faults(spark):
    calls = spark.createDataFrame(
        [(1, 1, "a", "search", '{"limit": 2, "query": "x"}', ["b"], ""), (1, 3, "b", "search", '{"query": 1}', [], ""), (1, 5, "c", "none", "{}", ["a"], ""), (1, 7, "d", "search", "[]", ["e"], ""), (1, 9, "e", "search", "?", ["d"], ""), (1, 11, "a", "search", "{}", None, ""), (2, 1, "a", "search", None, ["zz"], "")], CALLS
    )
    results = spark.createDataFrame([(1, 2, "a", "r2", 1), (1, 2, "a", "r1", 2), (2, 2, "q", "lost", 3)], RESULTS)
    schemas = spark.createDataFrame([("search", SCHEMA), ("search", "{}x")], "name string, schema string")
    got = {(r.conv_id, r.position): r for r in tool_calls.link(calls, results, schemas).collect()}
    assert got[1, 1].json == '{"arguments":{"limit":2,"query":"x"},"id":"a","name":"search","result":"r1"}' and got[1, 1].valid and got[1, 1].n_results == 2
    assert got[1, 3].faults == ["missing limit", "query is not string"] and got[1, 5].faults == ["unknown tool"] and got[1, 7].faults == ["not an object"] and got[1, 9].faults == ["not JSON"]
    assert (got[1, 1].latest, got[1, 1].steps) == (3, 1) and got[1, 3].rank < got[1, 1].rank < got[1, 5].rank
    assert [got[1, k].cyclic for k in (1, 3, 5, 7, 9)] == [False, False, False, True, True] and got[1, 11].duplicate
    assert [r.call_id for r in tool_calls.orphans(calls, results).collect()] == ["q"]
    assert tool_calls.link(calls.limit(0), results.limit(0), schemas).count() == 0


def test_odd_json(spark):
    """Nothing that a text can hold ends the job, and what comes out is JSON."""
    deep, odd = "[" * 100_000 + "]" * 100_000, ['{"m":NaN}', '{"m":1e999}', '{"m":"x"}', '{"m":5}', '{"m":true}', '{"m":"\\ud800"}', '{"\\udc00":1}', '{"m":null,"m":2}', '{"m":' + "9" * 5000 + "}", "", "null", '"' + "x" * 3_000_000 + '"']
    schema = json.dumps({"properties": {"m": {"maximum": 3, "maxLength": 2, "enum": 7, "minimum": "x"}}, "required": "m"})
    rows = [(1, i, f"c{i}", "t", x, None, "") for i, x in enumerate([deep, *odd])]
    got = {r.position: r for r in tool_calls.link(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), spark.createDataFrame([("t", schema)], "name string, schema string")).collect()}
    assert [got[i].faults for i in range(7)] == [["not JSON"], ["not JSON"], ["not JSON"], [], ["m out of range"], [], []]
    assert got[7].faults == [] and got[8].faults == [] and got[9].faults == ["not JSON"] and got[10].faults == ["not JSON"] and got[11].faults == got[12].faults == ["not an object"]
    for i in got:
        value = json.loads(got[i].json, parse_constant=lambda x: 1 / 0)
        assert value["id"] == f"c{i}" and got[i].json == tool_calls.canonical(value)
    assert tool_calls.faults('{"a":1}', {"properties": [], "required": [3], "additionalProperties": False}) == ["unexpected a"]
