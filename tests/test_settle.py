"""Settlement of known scores, and the value of text, alert and paging helpers."""

import pytest
from pyspark.sql import functions as F

from quoteloom.functions import settle as s
from quoteloom.operators import ops, resolve
from quoteloom.sources import wire

# family, participant, line in cents, outcome, home, away, result, odds, return of 100
GOLDEN = [
    ("MATCH_TOTAL", None, 250, "OVER", 3, 0, 2, 2.1, 210), ("MATCH_TOTAL", None, 250, "UNDER", 2, 0, 2, 2.0, 200), ("MATCH_TOTAL", None, 250, "OVER", 1, 1, -2, 2.0, 0),
    ("ASIAN_TOTAL", None, 200, "OVER", 1, 1, 0, 1.9, 100), ("ASIAN_TOTAL", None, 225, "OVER", 1, 1, -1, 1.9, 50), ("ASIAN_TOTAL", None, 225, "UNDER", 1, 1, 1, 1.9, 145),
    ("ASIAN_TOTAL", None, 275, "OVER", 2, 1, 1, 1.8, 140), ("TEAM_TOTAL", "AWAY", 150, "OVER", 0, 2, 2, 1.7, 170), ("TEAM_TOTAL", "HOME", 150, "OVER", 1, 4, -2, 1.7, 0),
    ("ASIAN_HANDICAP", "HOME", -100, "HOME", 2, 1, 0, 1.9, 100), ("ASIAN_HANDICAP", "HOME", -75, "HOME", 2, 1, 1, 1.9, 145), ("ASIAN_HANDICAP", "AWAY", 25, "AWAY", 1, 1, 1, 2.0, 150),
    ("ASIAN_HANDICAP", "HOME", -25, "HOME", 0, 0, -1, 1.9, 50), ("MATCH_RESULT", None, None, "DRAW", 1, 1, 2, 3.3, 330), ("MATCH_RESULT", None, None, "HOME", 0, 1, -2, 3.0, 0),
    ("DOUBLE_CHANCE", None, None, "HOME_OR_AWAY", 1, 1, -2, 1.4, 0), ("DOUBLE_CHANCE", None, None, "DRAW_OR_AWAY", 0, 1, 2, 1.4, 140), ("BTTS", None, None, "BTTS_YES", 1, 0, -2, 1.8, 0),
    ("BTTS", None, None, "BTTS_NO", 1, 0, 2, 2.0, 200), ("EXACT_SCORE", None, None, "2-1", 2, 1, 2, 9.0, 900), ("EXACT_SCORE", None, None, "2-1", 1, 2, -2, 9.0, 0),
]


def test_golden_settlements(spark):
    df = spark.createDataFrame(GOLDEN, "family string, participant string, line_c int, outcome string, home int, away int, want int, odds double, pays int")
    result = s.settle(F.col("family"), F.col("outcome"), F.col("participant"), F.col("line_c"), F.col("home"), F.col("away"))
    for r in df.withColumn("got", result).withColumn("back", F.round(s.multiplier(F.col("got"), F.col("odds")) * 100, 6)).collect():
        assert (r["got"], r["back"]) == (r["want"], r["pays"]), r


def test_text_helpers(spark):
    df = spark.createDataFrame([("  São–Paulo FC ",), ("Goals O/U 2,5 (1st) 3.25",), ("none",), (None,)], "t string")
    got = df.select(resolve.normalize_ascii(F.col("t")).alias("a"), resolve.normalize_text("t").alias("b"), resolve.last_number(F.col("t")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("são paulo fc", "sao paulo fc", None), ("goals o u 2 5 1st 3 25", "goals o u 2 5 1st 3 25", "3.25"), ("none", "none", None), (None, None, None)]


@pytest.mark.parametrize("levels,renotify,hysteresis,want", [
    ("HDDH", 0, 1, ["F1", "R3"]), ("DXX", 0, 1, ["F0", "F1"]), ("DDD", 2, 1, ["F0", "F2"]), ("DHDDH", 0, 2, ["F3", "R4"]), ("HHH", 0, 1, []), ("XDX", 0, 1, ["F0"]),
])
def test_alert_machine(spark, levels, renotify, hysteresis, want):
    names = {"H": "HEALTHY", "D": "DEGRADED", "X": "DOWN"}
    runs = spark.createDataFrame([(1, i, i, names[x]) for i, x in enumerate(levels)], "source long, run_id long, started_ms long, status string")
    got = ops.alert_events(runs, hysteresis, renotify).orderBy("run_id").collect()
    assert [r["kind"][0] + str(r["run_id"]) for r in got] == want


def test_pages_and_cursors(spark):
    df = spark.createDataFrame([(float(i // 2), i) for i in range(10)], "v double, id long")
    first = [r["id"] for r in ops.page(df, "v", "id", 3).collect()]
    assert first == [9, 8, 7, 6]
    assert [r["id"] for r in ops.page(df, "v", "id", 3, after=(3.0, 7)).collect()] == [6, 5, 4, 3]
    assert df.where("id = 7").select(ops.cursor(F.col("v"), F.col("id"))).first()[0].isascii()
    with pytest.raises(ValueError):
        ops.page(df, "v", "id", 0)


def test_merge_writes_changes_only(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, odds double")
    new = spark.createDataFrame([("b", 2.0), ("c", 3.0), ("a", 1.5)], "k string, odds double")
    snapshot, moved = wire.merge(old, new, "k", "odds")
    assert sorted(map(tuple, snapshot.collect())) == [("a", 1.5), ("b", 2.0), ("c", 3.0)]
    assert sorted(map(tuple, moved.collect())) == [("a", 1.5), ("c", 3.0)]
