import hashlib
import itertools
import random
import re
import zlib

import pytest

from quoteloom.llm import turn_repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.append((conv_id, turn, "user" if kind == 4 else role, text, {0: 0, 3: 2}.get(kind, 1)))
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Every edit of every row with up to two inserts before it and at the end, checked against the grammar at the end."""
    edits = [[("D", 2, None)] + ([] if f in ("blank", "duplicate") else [("K", 5 * (f == "truncated"), role), ("R", 1 + 5 * (f == "truncated"), "user"), ("R", 1 + 5 * (f == "truncated"), "assistant")]) for (role, _), f in zip(rows, found)]
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    best = None
    for some in itertools.product(*edits):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(c for _, c, _ in some) + 5 * sum(map(len, gaps))
            if best is not None and cost > best[0]:
                continue
            audit, result = "", []
            for gap, edit, row in itertools.zip_longest(gaps, some, rows):
                audit += "I" * len(gap) + (edit[0] if edit else "")
                result += [(r, "") for r in gap] + ([(edit[2], row[1])] if edit and edit[2] is not None else [])
            if all(r for r, _ in result) and GRAMMAR.fullmatch("".join(r[0] for r, _ in result)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, result
    return best


def brute(rows):
    conversations = {}
    for conv_id, turn, role, text, copies in rows:
        conversations.setdefault(conv_id, []).extend([(turn, role, text)] * copies)
    out = []
    for conv_id, all_rows in conversations.items():
        all_rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, *_ in all_rows if t is not None}
        rows = [r[1:] for r in all_rows]
        found = faults(rows)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, result = cheapest(rows, found)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in result).encode()).hexdigest()
        out.append((conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def made(seed, conversations, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "u", "", None, "user", "assistant"]
    texts = ["Hi.", "No", "  \t\n", "", None, "Why?", "ok!\n ", "long " * 50 + ".", "é。", "a", "b."]
    rows = []
    for c in range(conversations):
        for _ in range(rng.randrange(1, most + 1)):
            rows.append((rng.choice([c, c, c, None]) if c == 0 else c, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(roles), rng.choice(texts)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(spark, rows, schema=SCHEMA):
    df = turn_repair.repair(turn_repair.damage(spark.createDataFrame([(*r, 0) for r in rows], schema + ", fault int").selectExpr("*", "fault as kind", "fault as copies", "fault as part")))
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_edits(spark, seed):
    rows = made(seed, 40, 3)
    assert got(spark, rows) == brute(damaged(rows))


def test_segments_equal_one_pass(spark, monkeypatch):
    """One long conversation among short ones, split over many tasks and chunks, against one pass over its rows."""
    rng = random.Random(7)
    rows = [(5, rng.randrange(4000), rng.choice(["user", "assistant", "system", "x"]), rng.choice(["Hi.", "No", " ", f"text {i}."])) for i in range(6000)]
    rows += made(8, 30, 4)
    expected = {}
    for row in damaged(rows):
        expected.setdefault(row[0], []).extend([row[1:4]] * row[4])
    want = {}
    for conv_id, mine in expected.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        found = faults([r[1:] for r in mine])
        paths = turn_repair.Paths(turn_repair.START)
        for (_, role, _), fault in zip(mine, found):
            paths.row(role[:1], fault)
        cost, audit = turn_repair.last_of(paths.ends())
        letters, result, state = iter(mine), [], 0
        for letter in audit:
            row = next(letters) if letter != "I" else (None, "", "")
            if letter == "D":
                continue
            state = turn_repair.KEEPS[row[1][0]][state] if letter == "K" else turn_repair.FOLLOWS[state]
            result.append((row[1] if letter == "K" else turn_repair.NAMES[state]) + ":" + row[2])
        want[conv_id] = (cost, audit, hashlib.sha256("\n".join(result).encode()).hexdigest())
    monkeypatch.setattr(turn_repair, "HELD", 3000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        result = got(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r[0]: r[6:] for r in result} == want


def test_least_audit_of_long_runs():
    """Shared beginnings are cut off; the result is that of plain strings."""
    rng = random.Random(3)
    rows = [(rng.choice("suaax"), rng.choice(["", "", "blank", "truncated"])) for _ in range(3000)]
    paths = turn_repair.Paths(0)
    plain = {0: (0, ""), 2: (5, "I"), 3: (10, "II")}
    for initial, fault in rows:
        paths.row(initial, fault)
        after = {}
        for state, (cost, audit) in plain.items():
            options = [(state, 2, "D")]
            if fault != "blank":
                more = 5 * (fault == "truncated")
                options += [(2 if state != 2 else 3, 1 + more, "R")]
                legal = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(initial, {})
                options += [(legal[state], more, "K")] if state in legal else []
            for target, price, letter in options:
                for end, extra in ((target, ""), *((2, "I") for _ in range(target != 2)), *((3, "II") for _ in range(target in (0, 1))), *((3, "I") for _ in range(target == 2))):
                    mine = (cost + price + 5 * len(extra), audit + letter + extra)
                    after[end] = min(after.get(end, mine), mine)
        plain = after
    assert paths.ends() == plain


def test_no_rows_left_and_empty(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert got(spark, [(1, gone, "user", "Hi.")]) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair(turn_repair.damage(empty)).collect() == []
    rows = [("x", 1, "user", "Hi " * 400_000), ("x", 1, "user", "Hi " * 400_000), (None, None, None, None)]
    assert got(spark, rows, "conv_id string, turn int, role string, text string") == brute(damaged(rows))
