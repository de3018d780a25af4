"""Operator 1, chat formatting: tool calls linked with their results, ordered, validated and written as JSON.

Calls and results are hash-joined by identifier. A call may name one earlier call as its parent, whose result it
needs; the depth below the parents is a topological order (parents first), found by pointer doubling, so a chain of
n calls takes log2(n) joins. Arguments are checked against a JSON schema per tool. Each call becomes one line of
canonical JSON: sorted keys, no blanks, shortest numbers, UTF-8.

No step gathers a conversation, so one of any length is as good as many short ones; the order of a conversation's
calls is (depth, turn, call_id).

Defined results: of calls with equal ids the first by (turn, name, arguments) stands, ``copies`` counts them; of
results the first by (turn, content); status is ``linked``, ``pending`` (no result), ``early`` (a result not after
its call), ``orphan`` (a result without a call) or ``unnamed`` (no id, never linked); a call whose parent is missing
is a root; calls in or below a cycle have a null depth; arguments that are null or not JSON are invalid and written
as null. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

#: The schema of the one tool that ``from_conversations`` makes calls of.
ASK = {
    "ask": {
        "type": "object",
        "properties": {"text": {"type": "string", "minLength": 1}, "n_chars": {"type": "integer", "minimum": 1, "maximum": 1_000_000}},
        "required": ["n_chars", "text"],
        "additionalProperties": False,
    }
}


def is_type(value, name: str) -> bool:
    if name == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if name == "integer":
        return is_type(value, "number") and float(value).is_integer()
    return isinstance(value, TYPES[name])


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """Where and how a value breaks a schema (type, enum, bounds, lengths, pattern, properties, items)."""
    import re

    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(is_type(value, k) for k in kinds):
        return [f"{at}: not {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if is_type(value, "number"):
        out += [f"{at}: {word}" for word, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    if isinstance(value, (str, list)):
        least, most = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        out += [f"{at}: {word}" for word, bad in ((least, len(value) < schema.get(least, 0)), (most, len(value) > schema.get(most, len(value)))) if bad]
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: pattern")
    if isinstance(value, list) and "items" in schema:
        out += [f for i, x in enumerate(value) for f in faults(x, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    return out


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; whole floats are written as integers."""

    def plain(x):
        if isinstance(x, float) and x.is_integer() and abs(x) < 1 << 53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parse(text: str | None):
    """(value, whether the text is JSON without repeated keys or non-numbers)."""

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise ValueError("a repeated key")
        return dict(items)

    def refuse(x):
        raise ValueError(x)

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)
        canonical(value)
    except (TypeError, ValueError, RecursionError):
        return None, False
    return value, True


def depths(calls: DataFrame) -> DataFrame:
    """call_id, depth of calls (call_id, parent) with distinct ids; null in or below a cycle."""
    known = calls.select(F.col("call_id").alias("parent"), F.lit(True).alias("there"))
    state = calls.join(known, "parent", "left").select("call_id", F.when(F.col("there"), F.col("parent")).alias("up"))
    state = store.keep(state.withColumn("depth", F.col("up").isNotNull().cast("int")), "call-depths")
    rounds = math.ceil(math.log2(state.count() + 2)) + 1
    for _ in range(rounds):
        if not state.where("up is not null").limit(1).count():
            break
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moving = state.where("up is not null").join(above, "up").select("call_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        following = store.keep(state.where("up is null").unionByName(moving), "call-depths")
        store.discard(state)
        state = following
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def scoped(id_column: str) -> Column:
    """An id that is one of its conversation only, with the conversation's number before it."""
    return F.when(F.col(id_column).isNotNull(), F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.col(id_column)))


def ordered(rows: DataFrame) -> DataFrame:
    """The rows of ``link`` by conversation, each call after those it depends on; calls in or below a cycle come last."""
    return rows.orderBy("conv_id", F.col("depth").asc_nulls_last(), "turn", "call_id")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], scope: str = "corpus") -> DataFrame:
    """conv_id, call_id, turn, name, depth, status, copies, valid, json.

    scope: ``corpus`` if an id names one call wherever it occurs, ``conversation`` if conversations number their calls
    alike; then only calls and results of one conversation meet, those without a conversation being one.

    calls: conv_id, call_id, turn, name, arguments (JSON), parent; results: conv_id, call_id, turn, content.
    """
    if scope not in ("corpus", "conversation"):
        raise ValueError(f"scope is corpus or conversation, not {scope}")
    if scope == "conversation":
        calls = calls.withColumn("parent", scoped("parent")).withColumn("call_id", scoped("call_id"))
        results = results.withColumn("call_id", scoped("call_id"))
    call = F.struct("turn", "name", "arguments", "parent", "conv_id")
    named = calls.where("call_id is not null").groupBy("call_id").agg(F.min(call).alias("c"), F.count("*").alias("copies"))
    named = store.keep(named.select("call_id", "c.*", "copies"), "calls")
    found = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "content", "conv_id")).alias("r"))
    found = found.select("call_id", F.col("r.turn").alias("r_turn"), F.col("r.content").alias("content"), F.col("r.conv_id").alias("r_conv"), F.lit(True).alias("answered"))
    status = (
        F.when(F.col("copies").isNull(), "orphan").when(F.col("answered").isNull(), "pending").when(F.coalesce(F.col("r_turn") <= F.col("turn"), F.lit(False)), "early").otherwise("linked")
    )
    both = named.join(found, "call_id", "full").join(depths(named.select("call_id", "parent")), "call_id", "left")
    rows = both.select(F.coalesce("conv_id", "r_conv").alias("conv_id"), "call_id", F.coalesce("turn", "r_turn").alias("turn"), "name", "arguments", "depth", status.alias("status"), F.coalesce("copies", F.lit(0)).alias("copies"), "content")
    nameless = lambda df, *more: df.where("call_id is null").select("conv_id", "call_id", "turn", *more)
    none = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    rest = nameless(calls, "name", "arguments", none("depth", "int"), F.lit("unnamed").alias("status"), F.lit(1).cast("long").alias("copies"), none("content"))
    rest = rest.unionByName(nameless(results, none("name"), none("arguments"), none("depth", "int"), F.lit("unnamed").alias("status"), F.lit(0).cast("long").alias("copies"), "content"))

    def run(batches):
        for batch in batches:
            valid, lines = [], []
            for r in batch.to_pylist():
                value, good = parse(r["arguments"])
                good = good and r["name"] in schemas and not faults(value, schemas[r["name"]])
                valid.append(good)
                lines.append(canonical({k: r[k] for k in ("call_id", "content", "depth", "name", "status", "turn")} | {"arguments": value, "valid": good}))
            keep = [batch[c] for c in ("conv_id", "call_id", "turn", "name", "depth", "status", "copies")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(valid, pa.bool_()), pa.array(lines, pa.string())], ["conv_id", "call_id", "turn", "name", "depth", "status", "copies", "valid", "json"])

    rows = rows.unionByName(rest)
    if scope == "conversation":
        rows = rows.withColumn("call_id", F.expr("substring(call_id, instr(call_id, ':') + 1)"))
    return rows.mapInArrow(run, "conv_id long, call_id string, turn long, name string, depth int, status string, copies long, valid boolean, json string")


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain conversations: a user turn calls the tool ``ask``, the next turn, if the assistant's, answers.

    A call's parent is the call two turns before. Turns of other roles, and those without a conversation or number, take no part.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text")).where("conv_id is not null and turn is not null")
    name = lambda back: F.concat_ws(":", "conv_id", F.col("turn") - back)
    arguments = F.to_json(F.struct("text", F.length("text").alias("n_chars")))
    calls = turns.where("role = 'user'").select("conv_id", name(0).alias("call_id"), "turn", F.lit("ask").alias("name"), arguments.alias("arguments"), name(2).alias("parent"))
    results = turns.where("role = 'assistant'").select("conv_id", name(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
