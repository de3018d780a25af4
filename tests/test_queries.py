"""Every named query against its SQL in DuckDB at the smallest scale; those without SQL against plain Python."""

import os
import random

import duckdb
import numpy as np
import pytest

from quoteloom.operators import coverage
from quoteloom.plans import catalogue
from quoteloom.sources import binding

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{f}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(([None if r[i] is None else plain(r[i]) for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF_DIR), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_all_but_folds_have_sql():
    assert set(QUERIES) - set(SQL) == {"best_price_diversified", "maximin_three_leg", "token_bucket"}


def test_diversified_fold(spark):
    groups = {}
    for r in binding.quotes(spark, SF_DIR).collect():
        groups.setdefault(r["event"], {}).setdefault(r["slot"], []).append((r["odds"], r["book"]))
    want = set()
    for event, slots in groups.items():
        used = set()
        for slot in sorted(slots):
            top = max(o for o, _ in slots[slot])
            books = sorted(b for o, b in slots[slot] if o == top)
            book = next((b for b in books if b not in used), books[0])
            used.add(book)
            want.add((event, slot, top, book))
    assert {tuple(r) for r in QUERIES["best_price_diversified"](spark, SF_DIR).collect()} == want


def test_token_bucket_fold(spark):
    by_source = {}
    for r in binding.runs(spark, SF_DIR).orderBy("started_ms", "run_id").collect():
        by_source.setdefault(r["source"], []).append(r["started_ms"])
    want = {}
    for source, times in by_source.items():
        tokens, last = 10_000, times[0]
        for t in times:
            tokens, last = min(10_000, tokens + (t - last) * 5), t
            ok = tokens >= 1000
            tokens -= 1000 * ok
            want[source, ok] = want.get((source, ok), 0) + 1
    assert {(r["source"], r["allowed"]): r["requests"] for r in QUERIES["token_bucket"](spark, SF_DIR).collect()} == want


def test_maximin_of_three_legs_one_by_one(spark):
    """The stacked solves of the query's rows against a search of their own, on the thirds of a simplex grid."""
    rng = np.random.default_rng(5)
    stack = rng.choice([0.0, 0.5, 1.0, 1.7, 2.4], size=(50, 5, 3))
    values, shares = coverage.maximin_stack(stack)
    grid = np.array([(i, j, 60 - i - j) for i in range(61) for j in range(61 - i)]) / 60
    for matrix, value, share in zip(stack, values, shares, strict=True):
        assert abs(share.sum() - 1) < 1e-9 and abs((matrix @ share).min() - value) < 1e-9
        assert -1e-9 <= value - (grid @ matrix.T).min(axis=1).max() <= 0.1
        assert abs(coverage.maximin(matrix)[0] - value) < 1e-9


def test_maximin_against_search():
    rng = np.random.default_rng(3)
    for _ in range(60):
        matrix = rng.choice([0.0, 0.5, 1.0, 1.7, 2.4, 3.1], size=(rng.integers(1, 7), 3))
        value, shares = coverage.maximin(matrix)
        assert abs(shares.sum() - 1) < 1e-9 and abs((matrix @ shares).min() - value) < 1e-9
        steps = np.linspace(0, 1, 41)
        a, b = np.meshgrid(steps, steps)
        grid = np.stack([a.ravel(), b.ravel(), 1 - a.ravel() - b.ravel()], axis=1)
        grid = grid[grid[:, 2] >= -1e-12]
        assert value >= (grid @ matrix.T).min(axis=1).max() - 1e-9


def test_three_legs_are_not_worse_than_two(spark):
    three = QUERIES["maximin_three_leg"](spark, SF_DIR).collect()
    two = {(r["event"], r["slot_a"], r["slot_b"]): r["best_return"] for r in QUERIES["maximin_two_leg"](spark, SF_DIR).collect()}
    both = [(r["best_return"], two[r["event"], r["slot_a"], r["slot_b"]]) for r in three if (r["event"], r["slot_a"], r["slot_b"]) in two]
    assert three and both and all(a >= b - 1e-5 for a, b in both)


def test_flagship(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark).collect()
    assert found and all(r["roi"] > 0 for r in found) and [r["roi"] for r in found] == sorted((r["roi"] for r in found), reverse=True)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_random_series_changes(spark):
    """The streaming rule and the batch rule agree on a stream that arrives in several batches."""
    from quoteloom.operators import history
    from quoteloom.streaming import prices

    rng = random.Random(8)
    data = [(rng.randrange(3), rng.choice("ab"), t, t, float(rng.randrange(3))) for t in range(120)]
    schema = "user_id long, event_type string, at_ms long, seq long, price double"
    frame = spark.createDataFrame(data, schema)
    import tempfile

    folder = tempfile.mkdtemp()
    for i in range(4):
        frame.where(f"at_ms >= {30 * i} and at_ms < {30 * i + 30}").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = prices.changes(stream).writeStream.format("memory").queryName("changed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("changed").collect()}
    assert got == {tuple(r) for r in history.changes(frame).drop("before").collect()}


def test_three_legs_without_linear_solves(monkeypatch):
    """Up to three legs are solved in closed form, and equal the vertices of linear solves."""
    rng = np.random.default_rng(11)
    stacks = [rng.choice([0.0, 0.5, 1.0, 1.4, 1.9, 2.6], size=(300, states, legs)) for states, legs in ((1, 1), (1, 3), (3, 2), (4, 3), (9, 3))]
    want = [coverage._vertices(m)[0] for m in stacks] if hasattr(coverage, "_vertices") else None

    def solve(*_):
        raise AssertionError("a linear solve")

    monkeypatch.setattr(np.linalg, "solve", solve)
    for i, m in enumerate(stacks):
        values, shares = coverage.maximin_stack(m)
        assert np.allclose(values, want[i], atol=1e-9) and np.allclose((m * shares[:, None]).sum(axis=2).min(axis=1), values, atol=1e-8)


def test_solver_of_candidates_with_nulls(spark):
    rows = spark.createDataFrame(
        [(1, [[2, -2], [-2, 2]], [2.0, 2.0]), (2, None, [2.0, 2.0]), (3, [[2, -2, -2], [-2, 2, -2], [-2, -2, 2]], [3.0, 3.0, 3.0]), (4, [[-1, 2]], [5.0, 1.5]), (5, [[1, 0]], None)],
        "id int, vectors array<array<int>>, odds array<double>",
    )
    got = {r["id"]: (r["s"]["best_return"], r["s"]["shares"]) for r in rows.select("id", coverage.solved("vectors", "odds").alias("s")).collect()}
    assert got[2] == got[5] == (None, None)
    assert got[1] == (1.0, [0.5, 0.5]) and got[4] == (1.5, [0.0, 1.0])
    assert abs(got[3][0] - 1) < 1e-12 and np.allclose(got[3][1], 1 / 3)


def test_structures_are_counted_by_sets_of_selections(spark):
    """One shuffle by event of narrow rows that are combined in place: nothing is sorted, no candidate is made. Rows without an event or a slot count nowhere."""
    from pyspark.sql import functions as F

    from quoteloom.operators import quotes

    plan = QUERIES["structure_class"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and "max_by" not in plan
    plan = quotes.held(binding.offered(spark, SF_DIR))._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(event") == 1 and "collect_list" not in plan and "Sort" not in plan
    sets = {(5, 0), (5, 1), (5, 1), (7, 2), (None, 3), (None, 4)}
    held = quotes.held(spark.createDataFrame(list(sets) * 2, "event long, slot int"))
    assert {tuple(r) for r in held.collect()} == {(3, 1), (4, 1)}
    pairs = quotes.structures_of(binding.slots(spark), "ab").where(F.col("bits") == 3).collect()
    assert [(r["legs"], r["structure"]) for r in pairs] == [(2, "SAME_MARKET_COMPLEMENT")]
