"""States over halves, corners and cards, coverage over their product, and stakes of any number of legs.

A set of selections is met by states of three parts that don't depend on each other: goals (full time and, where a half is
spoken of, the first half within it), corners and cards. Only the vector of results matters, so each part is reduced to its
distinct vectors where its grid is made; what a set keeps is at most 5 to the power of its legs, whatever the lines. The
product is then made in place, a row a set. Sets are combinations of a market's selections, a dimension, whatever the number of prices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import settle as s
from . import coverage

#: The largest count of a side, and by how much corners are looked at beyond the largest line.
GOALS, CORNERS, CARDS, CORNERS_MORE = 40, 60, 40, 10
#: Periods without a model of states.
OUTSIDE = ["EXTRA_TIME", "PENALTIES"]
PARTS = ["goals", "corners", "cards"]


def part(family: Column) -> Column:
    return F.when(family == "CORNERS", "corners").when(family == "CARDS", "cards").otherwise("goals")


def bound(leg: Column) -> Column:
    """The largest count a selection speaks of; an exact score speaks of its own."""
    score = F.transform(F.split(leg["outcome"], "-"), lambda x: x.try_cast("int"))
    exact = F.when((leg["family"] == "EXACT_SCORE") & leg["outcome"].rlike("^[0-9]+-[0-9]+$"), F.array_max(score))
    return F.greatest(s.boundary(leg["family"], leg["line_c"]), F.coalesce(exact, F.lit(0)))


def unknown(leg: Column) -> Column:
    """Whether a selection has no state model or no rule of settlement."""
    probe = s.settle(leg["family"], leg["outcome"], leg["participant"], leg["line_c"], F.lit(0), F.lit(0))
    return leg["period"].isNull() | leg["period"].isin(OUTSIDE) | probe.isNull()


def _results(legs: Column) -> Column:
    """Results of the legs that the row's part settles, null for the others; from columns part, home, away, first_home, first_away."""

    def count(leg, side):
        full, first = F.col(side), F.col(f"first_{side}")
        goals = F.col("part") == "goals"
        return F.when(goals & (leg["period"] == "FIRST_HALF"), first).when(goals & (leg["period"] == "SECOND_HALF"), full - first).otherwise(full)

    return F.transform(legs, lambda x: F.when(part(x["family"]) == F.col("part"), s.settle(x["family"], x["outcome"], x["participant"], x["line_c"], count(x, "home"), count(x, "away"))))


def classes(sets: DataFrame) -> DataFrame:
    """set, part, vector, at: the distinct vectors of each part of every set, and the first counts that give it.

    sets: set (its key), legs (array of structs with family, period, participant, line_c, outcome), all of which can be
    settled. A part that no leg speaks of has one class without counts.
    """
    legs = F.col("legs")
    parts = F.transform(legs, lambda x: part(x["family"]))
    half = F.exists(legs, lambda x: (part(x["family"]) == "goals") & x["period"].isin("FIRST_HALF", "SECOND_HALF"))
    more = F.array_max(F.transform(legs, bound)) + 1
    top = lambda extra, cap: F.least(F.greatest(more + extra, F.lit(2)), F.lit(cap))
    tops = F.array(*(F.struct(F.lit(name).alias("part"), top(extra, cap).alias("top")) for name, extra, cap in zip(PARTS, (0, CORNERS_MORE, 0), (GOALS, CORNERS, CARDS), strict=True)))
    # dealt before the grids are made, so both aggregations by set need no shuffle of their own
    dealt = sets.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "set")
    named = dealt.select("set", "legs", parts.alias("parts"), half.alias("half"), F.explode(tops).alias("limit"))
    spoken = F.array_contains("parts", F.col("limit.part"))
    grid = named.select("set", "legs", "limit.part", "limit.top", spoken.alias("spoken"), (F.col("half") & (F.col("limit.part") == "goals")).alias("half"))
    none = F.array(F.lit(None).cast("int"))
    for side in ("home", "away"):
        grid = grid.withColumn(side, F.explode(F.when(F.col("spoken"), F.sequence(F.lit(0), "top")).otherwise(none)))
    for side in ("home", "away"):
        grid = grid.withColumn(f"first_{side}", F.explode(F.when(F.col("half"), F.sequence(F.lit(0), side)).otherwise(none)))
    rows = grid.select("set", "part", _results(legs).alias("vector"), F.struct("home", "away", "first_home", "first_away").alias("at"))
    return rows.groupBy("set", "part", "vector").agg(F.min("at").alias("at"))


def states(sets: DataFrame) -> DataFrame:
    """set and states: an array of (goals, corners, cards, vector), one a distinct vector, in the order of the counts."""
    found = classes(sets).groupBy("set").agg(F.array_sort(F.collect_list(F.struct("at", "vector", "part"))).alias("found"))

    def of(name):
        return F.filter("found", lambda x: x["part"] == name)

    def joined(g, c, k):
        vector = F.transform(g["vector"], lambda r, i: F.coalesce(r, F.get(c["vector"], i), F.get(k["vector"], i)))
        return F.struct(g["at"].alias("goals"), c["at"].alias("corners"), k["at"].alias("cards"), vector.alias("vector"))

    goals, corners, cards = map(of, PARTS)
    product = F.flatten(F.transform(goals, lambda g: F.flatten(F.transform(corners, lambda c: F.transform(cards, lambda k: joined(g, c, k))))))
    return found.select("set", product.alias("states"))


def name(state: Column) -> Column:
    """A state's counts as text: goals, the first half's goals after a slash, corners, cards; a dash where nothing is counted."""
    pair = lambda x, pre="": F.concat_ws("-", x[f"{pre}home"], x[f"{pre}away"])
    plain = lambda x: F.when(x["home"].isNull(), "-").otherwise(pair(x))
    goals = state["goals"]
    halves = F.when(goals["first_home"].isNull(), plain(goals)).otherwise(F.concat_ws("/", pair(goals), pair(goals, "first_")))
    return F.concat_ws("|", halves, plain(state["corners"]), plain(state["cards"]))


def judged(sets: DataFrame) -> DataFrame:
    """set, legs, states, n_states, n_overlap, n_cross, n_lost, n_gap, verdict and evidence of every set; rows with an equal key (null too) have equal legs.

    verdict: COVERED, or the reasons against it. A set without legs or with a leg twice is INVALID_MARKET, one with a leg
    that can't be settled UNKNOWN_SETTLEMENT; both have no states. evidence: the first state that refutes the set.
    Counts are of distinct vectors: with two winners of one family, period and participant (overlap), of several (cross),
    with all legs lost (lost), without a winner otherwise (gap).
    """
    legs = F.col("legs")
    invalid = legs.isNull() | (F.size("legs") == 0) | (F.size(F.array_distinct("legs")) < F.size("legs"))
    fault = F.when(F.coalesce(invalid, F.lit(True)), "INVALID_MARKET").when(F.exists(legs, unknown), "UNKNOWN_SETTLEMENT")
    rows = sets.select("set", "legs", fault.alias("fault"))
    met = states(rows.where("fault IS NULL").select("set", "legs").dropDuplicates(["set"])).withColumnRenamed("set", "_set")
    found = rows.join(met, F.col("set").eqNullSafe(F.col("_set")), "left").drop("_set")
    metric = F.transform(legs, lambda x: F.concat_ws("|", x["family"], x["period"], F.coalesce(x["participant"], F.lit("-"))))

    def flags(state):
        vector = state["vector"]
        won = F.filter(F.transform(vector, lambda r, i: F.when(r > 0, F.get("metric", i))), lambda m: m.isNotNull())
        kinds = F.array_distinct(won)
        lost = (F.size(won) == 0) & (F.size(vector) >= 2) & F.forall(vector, lambda r: r == -2)
        overlap = F.size(F.filter(kinds, lambda m: F.size(F.filter(won, lambda w: w == m)) >= 2))
        return F.struct(overlap.alias("overlap"), (F.size(kinds) > 1).alias("cross"), lost.alias("lost"), ((F.size(won) == 0) & ~lost).alias("gap"), name(state).alias("name"))

    flagged = found.withColumn("metric", metric).withColumn("flags", F.coalesce(F.transform("states", flags), F.expr("array()")))
    many = lambda f: F.size(F.filter("flags", f)).cast("long")
    counted = flagged.select(
        "set", "legs", "states", "fault", F.size("flags").cast("long").alias("n_states"),
        F.aggregate("flags", F.lit(0).cast("long"), lambda a, x: a + x["overlap"]).alias("n_overlap"), many(lambda x: x["cross"]).alias("n_cross"),
        many(lambda x: x["lost"]).alias("n_lost"), many(lambda x: x["gap"]).alias("n_gap"),
        F.get(F.filter("flags", lambda x: (x["overlap"] > 0) | x["lost"] | x["gap"]), F.lit(0))["name"].alias("evidence"),
    )
    return counted.withColumn("verdict", F.coalesce("fault", coverage.verdict())).drop("fault")


def simplex_stack(matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, shares) of the largest guaranteed returns of many matrices of one shape (rows x states x legs, all >= 0).

    With one added to every entry the value is positive, and the shares are the prices of the legs in: as much weight on states as no leg
    pays more than one for. Its tableau has a row a leg and starts feasible; all tableaux are pivoted together, by the smallest
    index, which can't cycle, until none can gain. Work grows with states times legs a pivot, not with their combinations.
    """
    count, states, legs = matrices.shape
    table = np.zeros((count, legs + 1, states + legs + 1))
    table[:, :legs, :states] = matrices.transpose(0, 2, 1) + 1.0
    table[:, :legs, states : states + legs] = np.eye(legs)
    table[:, :legs, -1], table[:, legs, :states] = 1.0, -1.0
    basis = np.tile(np.arange(states, states + legs), (count, 1))
    open_ = np.arange(count)
    while len(open_):
        gains = table[open_, legs, :-1] < -1e-10
        open_ = open_[gains.any(axis=1)]
        if not len(open_):
            break
        enter = (table[open_, legs, :-1] < -1e-10).argmax(axis=1)
        column = table[open_, :legs, enter]
        ratio = np.where(column > 1e-10, table[open_, :legs, -1] / np.where(column > 1e-10, column, 1.0), np.inf)
        tied = ratio <= ratio.min(axis=1, keepdims=True) + 1e-12
        leave = np.where(tied, basis[open_], states + legs).argmin(axis=1)
        row = table[open_, leave] / column[np.arange(len(open_)), leave][:, None]
        factors = table[open_, :, enter]
        factors[np.arange(len(open_)), leave] = 0.0
        table[open_] -= factors[:, :, None] * row[:, None, :]
        table[open_, leave], basis[open_, leave] = row, enter
    shares = np.clip(table[:, legs, states : states + legs], 0, None)
    shares /= shares.sum(axis=1, keepdims=True)
    return np.einsum("nsl,nl->ns", matrices, shares).min(axis=1), shares


def staked(df: DataFrame, total: float = 100.0) -> DataFrame:
    """Adds stakes, min_return, profit, roi and is_arb of candidates of any number of legs.

    df: vectors (array of arrays of results, a state each) and odds (array, a leg each), and any other columns. Matrices of one shape of
    an Arrow batch are solved together. The least return is worked out anew from the stakes, so a rounded solution never says too much.
    A candidate without states or legs, or with a price that is missing or not positive, has no stakes and is no arbitrage.
    """
    kept, names = df.columns, [*df.columns, "_matrix"]
    ready = (F.size("odds") > 0) & (F.size("vectors") > 0) & F.forall("odds", lambda o: o > 0) & F.forall("vectors", lambda v: (F.size(v) == F.size("odds")) & F.forall(v, lambda r: r.isNotNull()))
    matrix = F.transform("vectors", lambda v: F.transform(v, lambda r, i: s.multiplier(r, F.get("odds", i))))
    rows = df.withColumn("_matrix", F.when(ready, matrix))

    def run(batches):
        for batch in batches:
            matrices, shapes = batch["_matrix"].to_pylist(), {}
            shares = [None] * len(matrices)
            for i, m in enumerate(matrices):
                if m:
                    shapes.setdefault((len(m), len(m[0])), []).append(i)
            for at in shapes.values():
                for i, share in zip(at, simplex_stack(np.array([matrices[i] for i in at], float))[1].tolist(), strict=True):
                    shares[i] = share
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(shares, pa.list_(pa.float64()))], [*names, "_shares"])

    schema = rows.withColumn("_shares", F.lit(None).cast("array<double>")).schema
    solved = rows.mapInArrow(run, schema)
    worth = lambda v: F.aggregate(F.zip_with(v, "stakes", lambda m, x: m * x), F.lit(0.0), lambda a, x: a + x)
    found = solved.withColumn("stakes", F.transform("_shares", lambda x: x * total)).withColumn("min_return", F.when(F.col("stakes").isNotNull(), F.array_min(F.transform("_matrix", worth))))
    profit = F.col("min_return") - total
    return found.select(*kept, "stakes", "min_return", profit.alias("profit"), (profit / total).alias("roi"), F.coalesce(profit > total * 1e-9, F.lit(False)).alias("is_arb"))
