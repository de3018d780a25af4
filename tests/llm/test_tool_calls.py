import json
import random

import pytest

from quoteloom.llm import tool_calls
from quoteloom.llm.tool_calls import ASK, canonical, faults, parse

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, parent string, depth string"
RESULTS = "conv_id long, call_id string, turn long, content string, status int"
SCHEMAS = {"add": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"type": "string"}, "maxItems": 2}}, "required": ["x"], "additionalProperties": False}}


def brute(calls, results, schemas):
    first, copies, answers = {}, {}, {}
    low = lambda t: tuple((x is not None, x or (0 if isinstance(x, int) else "")) for x in t)
    for conv, cid, turn, name, args, parent, _ in calls:
        if cid is not None:
            copies[cid] = copies.get(cid, 0) + 1
            new = (turn, name, args, parent, conv)
            first[cid] = min(first.get(cid, new), new, key=low)
    for conv, cid, turn, content, _ in results:
        if cid is not None:
            answers[cid] = min(answers.get(cid, (turn, content, conv)), (turn, content, conv), key=low)
    out = []

    def depth(cid):
        n, seen = 0, set()
        while first[cid][3] in first:
            if cid in seen:
                return None
            seen.add(cid)
            cid, n = first[cid][3], n + 1
        return n

    for cid in first.keys() | answers.keys():
        turn, name, args, _, conv = first.get(cid, (None,) * 5)
        r_turn, content, r_conv = answers.get(cid, (None,) * 3)
        status = "orphan" if cid not in first else "pending" if cid not in answers else "early" if r_turn <= turn else "linked"
        value, good = parse(args)
        good = good and name in schemas and not faults(value, schemas[name])
        d = depth(cid) if cid in first else None
        turn = r_turn if turn is None else turn
        line = canonical({"call_id": cid, "content": content, "depth": d, "name": name, "status": status, "turn": turn, "arguments": value, "valid": good})
        out.append((r_conv if conv is None else conv, cid, turn, name, d, status, copies.get(cid, 0), good, line))
    return out


def made(seed):
    rng = random.Random(seed)
    args = ['{"x":1}', '{"x":-1}', '{"x": 2.0, "tags":["b","a"]}', '{"tags":["a","b","c"],"x":3}', "{}", "not json", None, '{"x":1,"y":2}', '{"x":1,"x":2}', '{"x":NaN}', "[1]", '{"tags":[1],"x":"é"}']
    ids = [f"c{i}" for i in range(60)]
    calls = [(rng.randrange(3), rng.choice(ids), rng.randrange(20), rng.choice(["add", "sub", None]), rng.choice(args), rng.choice([None, None, "gone", *ids]), "d") for _ in range(80)]
    results = [(rng.randrange(3), rng.choice([*ids, "lost"]), rng.randrange(30), rng.choice(["r1", "r2\n", "", None]), 1) for _ in range(50)]
    return calls, results


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    calls, results = made(seed)
    rows = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(brute(calls, results, SCHEMAS), key=repr)


def test_unnamed_and_empty(spark):
    c, r = spark.createDataFrame([(1, None, 0, "add", '{"x":1}', None, "")], CALLS), spark.createDataFrame([(1, None, 1, "x", 0)], RESULTS)
    assert [(x["status"], x["copies"], x["valid"]) for x in tool_calls.link(c, r, SCHEMAS).orderBy("turn").collect()] == [("unnamed", 1, True), ("unnamed", 0, False)]
    assert tool_calls.link(c.limit(0), r.limit(0), SCHEMAS).collect() == []


def test_long_chain_and_cycle(spark):
    rows = [(1, f"k{i}", i, "add", "{}", f"k{i - 1}", "") for i in range(300)] + [(2, "a", 0, "add", "{}", "b", ""), (2, "b", 1, "add", "{}", "a", ""), (2, "c", 2, "add", "{}", "a", ""), (2, "s", 2, "add", "{}", "s", "")]
    got = dict(map(tuple, tool_calls.depths(spark.createDataFrame(rows, CALLS).select("call_id", "parent")).collect()))
    assert got == {f"k{i}": i for i in range(300)} | dict.fromkeys("abcs")


def test_conversations(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", None), (1, 4, "user", ""), (2, 0, "user", "é\n\"q"), (2, 0, "user", "a"), (2, 1, "assistant", None), (None, 1, "user", "x"), (3, 1, "assistant", "late")]
    rows = tool_calls.link(*tool_calls.from_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")), ASK).collect()
    got = {r["call_id"]: (r["depth"], r["status"], r["copies"], r["valid"]) for r in rows}
    assert got == {"1:1": (0, "linked", 1, True), "1:3": (1, "pending", 1, False), "1:4": (0, "pending", 1, False), "2:0": (0, "linked", 2, True), "3:0": (None, "orphan", 0, False)}
    assert json.loads(next(r["json"] for r in rows if r["call_id"] == "2:0"))["arguments"] == {"n_chars": 1, "text": "a"}


def test_schema_and_canonical_form():
    schema = {"type": ["object", "null"], "properties": {"n": {"type": "number", "maximum": 3}, "s": {"type": "string", "pattern": "^a", "maxLength": 2}, "e": {"enum": [1, "x"]}, "b": {"type": "boolean"}}}
    assert faults({"n": 3, "s": "ab", "e": "x", "b": True, "more": 0}, schema) == faults(None, schema) == []
    assert faults({"n": 4, "s": "bcd", "e": 2, "b": 1}, schema) == ["$.b: not boolean", "$.e: not in enum", "$.n: maximum", "$.s: maxLength", "$.s: pattern"]
    assert faults(True, {"type": "integer"}) and not faults(2.0, {"type": "integer"})
    assert canonical({"b": [1.0, 2.5, None], "a": {"é": "\n"}}) == '{"a":{"é":"\\n"},"b":[1,2.5,null]}'
    assert parse('{"a":1e400}') == (None, False) == parse("[" * 100000)


def test_ids_of_one_conversation(spark):
    """Conversations that number their calls alike keep all their calls, in the order of their dependence."""
    calls = [(c, f"call_{i}", 5 - i, "add", '{"x":%d}' % (10 * c + i), f"call_{i - 1}" if i else None, "") for c in (1, 2) for i in range(3)] + [(None, "call_0", 0, "add", "{}", None, "")]
    results = [(c, "call_0", 9, f"r{c}", 0) for c in (1, 2)]
    rows = tool_calls.ordered(tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS, scope="conversation")).collect()
    assert [(r["conv_id"], r["call_id"], r["depth"], r["copies"]) for r in rows] == [(None, "call_0", 0, 1)] + [(c, f"call_{i}", i, 1) for c in (1, 2) for i in range(3)]
    assert [json.loads(r["json"])["content"] for r in rows if r["status"] == "linked"] == ["r1", "r2"]
    assert [json.loads(r["json"])["call_id"] for r in rows][:2] == ["call_0", "call_0"]
