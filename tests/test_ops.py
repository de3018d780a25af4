"""Folds over long histories against plain Python."""

import random

import pytest

from quoteloom.operators import ops

SCHEMA = "source long, run_id long, started_ms long, status string"


def history(seed, rows=3000):
    """One hot source with few healthy runs and few gaps, and others."""
    rng, at, out = random.Random(seed), 0, []
    for i in range(rows):
        at += rng.choice([0, 0, 50, 100, 150, 150, 300, 2500 if rng.random() < 0.02 else 200])
        status = rng.choices(["DOWN", "DEGRADED", "HEALTHY", None], [5, 5, 2, 0.2])[0]
        out.append((rng.choice([7, 7, 7, 8, None]), 2**60 + i, at, status))
    return out


def alerts(runs, hysteresis, renotify_ms, least):
    """The state machine, one source after the other, by its rules."""
    want = []
    for source in {r[0] for r in runs}:
        streak, active, told, severity, told_at = 0, False, False, 0, 0
        for _, run_id, at, status in sorted((r for r in runs if r[0] == source), key=lambda r: (r[2], r[1])):
            level = {"DOWN": 2, "DEGRADED": 1}.get(status, 0)
            streak = streak + 1 if level else 0
            if level and streak >= max(1, hysteresis):
                due = not told or (renotify_ms > 0 and at - told_at >= renotify_ms) or level > severity
                if level >= least and (not active or due):
                    want.append((source, run_id, "FIRING", level))
                    told, severity, told_at = True, level, at
                active = True
            else:
                if active and told:
                    want.append((source, run_id, "RESOLVED", level))
                active, told, severity, told_at = False, False, 0, 0
    return want


@pytest.mark.parametrize("rules", [(1, 0, 1), (3, 1000, 1), (2, 700, 2)])
def test_alerts(spark, rules):
    runs = history(1)
    got = [tuple(r) for r in ops.alert_events(spark.createDataFrame(runs, SCHEMA), *rules).collect()]
    assert sorted(got, key=repr) == sorted(alerts(runs, *rules), key=repr)


def test_tokens(spark):
    runs, want = history(2), []
    for source in {r[0] for r in runs}:
        tokens, last = 10_000, 0
        for _, run_id, at, _ in sorted((r for r in runs if r[0] == source), key=lambda r: (r[2], r[1])):
            tokens, last = min(10_000, tokens + (at - last) * 5), at
            want.append((source, run_id, tokens >= 1000))
            tokens -= 1000 * (tokens >= 1000)
    got = [tuple(r) for r in ops.token_bucket(spark.createDataFrame(runs, SCHEMA), 10, 5).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("fold", [lambda d: ops.token_bucket(d, 10, 5), lambda d: ops.alert_events(d)])
def test_no_row_holds_a_history(spark, fold):
    df = fold(spark.createDataFrame(history(3, 10), SCHEMA))
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
