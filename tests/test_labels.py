"""Market labels and keys against known identities; settlement of periods, counts and components."""

from pyspark.sql import functions as F

from quoteloom.functions import settle
from quoteloom.operators import labels

TOTAL = [("Over 2.5", None), ("Under 2.5", None)]
SPREAD = [("Home Team -0.75", "-0.75"), ("Away Team +0.75", "0.75")]
# key, label, outcomes; family, period, market type, participant, line, via, or a part of the reason
GOLDEN = [
    ("totals", "Goals Over/Under 2.5", None, ("MATCH_TOTAL", "FULL_MATCH", "STANDARD", None, "2.5", "label")),
    ("goals", "Total Goals O/U", TOTAL, ("MATCH_TOTAL", "FULL_MATCH", "STANDARD", None, "2.5", "label")),
    ("team_totals_home", "Home Team Goals O/U 1.5", None, ("TEAM_TOTAL", "FULL_MATCH", "STANDARD", "HOME", "1.5", "label")),
    ("spreads", "Home Asian Handicap -0.75", SPREAD, ("ASIAN_HANDICAP", "FULL_MATCH", "HANDICAP", "HOME", "-0.75", "label")),
    ("h2h", "1X2", None, ("MATCH_RESULT", "FULL_MATCH", "1X2", None, None, "label")),
    ("h2h", "Match Result", None, ("MATCH_RESULT", "FULL_MATCH", "1X2", None, None, "label")),
    ("btts", "Both Teams to Score", None, ("BTTS", "FULL_MATCH", "BTTS", None, None, "label")),
    ("corners", "Total Corners 9.5", None, ("CORNERS", "FULL_MATCH", "STANDARD", None, "9.5", "label")),
    ("cards", "Yellow Cards 4.5", None, ("CARDS", "FULL_MATCH", "STANDARD", None, "4.5", "label")),
    ("shots", "Shots O/U 2.5", None, "shots"),
    ("dnb", "Draw No Bet", None, "intentionally unmapped"),
    ("provider_specific_unknown", None, None, "no label"),
    ("known", "Total Goals", TOTAL, ("MATCH_TOTAL", "FULL_MATCH", "STANDARD", None, "2.5", "key")),
    ("x", "First Half - Goals 1,5", None, ("MATCH_TOTAL", "FIRST_HALF", "STANDARD", None, "1.5", "label")),
    ("x", "Asian Team Total (Visitors) 1.25", None, ("TEAM_ASIAN_TOTAL", "FULL_MATCH", "ASIAN", "AWAY", "1.25", "label")),
    ("x", "", None, "no rule"),
]


def test_golden_labels(spark):
    schema = "provider string, key string, label string, outcomes array<struct<name string, point string>>, i int"
    rows = spark.createDataFrame([("p", k, label, o, i) for i, (k, label, o, _) in enumerate(GOLDEN)], schema)
    keys = spark.createDataFrame([("p", "known", "MATCH_TOTAL", "FULL_MATCH", None, None)], labels.KEY_SCHEMA)
    found = labels.normalize_markets(rows, keys).orderBy("i").collect()
    assert len(found) == len(GOLDEN)
    for r, (_, _, _, want) in zip(found, GOLDEN, strict=True):
        if isinstance(want, str):
            assert not r["matched"] and want in r["reason"] and r["family"] is None, r
        else:
            assert r["matched"] and r["reason"] is None and r["problems"] == []
            assert (r["family"], r["period"], r["market_type"], r["participant"], r["line"], r["via"]) == want, r


def test_missing_parts_are_named(spark):
    rows = spark.createDataFrame([("p", "x", "Asian Handicap", None)], "provider string, key string, label string, outcomes array<struct<name string, point string>>")
    found = labels.normalize_markets(rows, spark.createDataFrame([], labels.KEY_SCHEMA)).first()
    assert found["matched"] and found["problems"] == ["line", "participant"]
    assert labels.normalize_markets(rows.limit(0), spark.createDataFrame([], labels.KEY_SCHEMA)).count() == 0


def test_components(spark):
    cases = {"WIN": "FULL_WIN", "WIN WIN": "FULL_WIN", "WIN PUSH": "HALF_WIN", "LOSS PUSH": "HALF_LOSS", "LOSS LOSS": "FULL_LOSS", "PUSH PUSH": "PUSH", "VOID": "VOID", "VOID VOID": "VOID", "VOID WIN": None, "WIN LOSS": None, "": None}
    df = spark.createDataFrame([(k.split(), v) for k, v in cases.items()], "c array<string>, want string")
    assert [r["got"] for r in df.select(settle.combined(F.col("c")).alias("got")).collect()] == list(cases.values())
