"""Outcome states, coverage verdicts, maximin stakes and the scan and validation ladders."""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions import settle as s

METRIC = ["family", "participant"]


def states(slots: DataFrame) -> DataFrame:
    """slot, home, away, result for every score up to the largest limit of the slots."""
    top = slots.select(s.goal_limit(F.max(s.boundary(F.col("family"), F.col("line_c")))).alias("top"))
    grid = top.select(F.explode(F.sequence(F.lit(0), "top")).alias("home"), "top").select("home", F.explode(F.sequence(F.lit(0), "top")).alias("away"))
    result = s.settle(F.col("family"), F.col("outcome"), F.col("participant"), F.col("line_c"), F.col("home"), F.col("away"))
    columns = ["slot", "family", "participant", "line_c", "outcome"]
    # A dimension of a few dozen selections times a few dozen scores.
    return slots.select(*columns).join(F.broadcast(grid), F.lit(True)).select("slot", "home", "away", result.alias("result"))


def structures(slots: DataFrame, legs: int) -> DataFrame:
    """Per combination of slots: distinct result vectors (one array per state class) and the verdict of coverage.

    Vectors depend on the selections only, never on prices, so they are found once per combination and broadcast
    to the candidates: there are as many as combinations of the market dimension, whatever the number of events.
    """
    names = "abc"[:legs]
    own = slots.select("slot", s.boundary(F.col("family"), F.col("line_c")).alias("bound"), F.concat_ws("|", "family", F.coalesce("participant", F.lit("-"))).alias("metric"))
    per = states(slots).join(F.broadcast(own), "slot")
    out = None
    for x in names:
        mine = per.select("home", "away", *(F.col(c).alias(f"{c}_{x}") for c in ("slot", "bound", "metric", "result")))
        out = mine if out is None else out.join(F.broadcast(mine), ["home", "away"]).where(F.col(f"slot_{prev}") < F.col(f"slot_{x}"))
        prev = x
    limit = s.goal_limit(F.greatest(*(F.col(f"bound_{x}") for x in names)))
    out = out.where((F.col("home") <= limit) & (F.col("away") <= limit))
    wins = {x: F.col(f"result_{x}") > 0 for x in names}
    overlap = F.lit(False)
    for x, y in combinations(names, 2):
        overlap = overlap | (wins[x] & wins[y] & (F.col(f"metric_{x}") == F.col(f"metric_{y}")))
    none = F.lit(True)
    for x in names:
        none = none & ~wins[x]
    lost = F.lit(True)
    for x in names:
        lost = lost & (F.col(f"result_{x}") == -2)
    rows = out.select(*(f"slot_{x}" for x in names), F.array(*(f"result_{x}" for x in names)).alias("vector"), overlap.alias("overlap"), (none & lost).alias("lost"), (none & ~lost).alias("gap"), "home", "away")
    return rows.groupBy(*(f"slot_{x}" for x in names)).agg(
        F.array_sort(F.collect_set("vector")).alias("vectors"), F.count_if("overlap").alias("n_overlap"), F.count_if("lost").alias("n_lost"), F.count_if("gap").alias("n_gap"), F.count("*").alias("n_states")
    )


def verdict() -> Column:
    """COVERED, or the reasons against it, joined in the order of their names."""
    reasons = F.array_compact(F.array(F.when(F.col("n_lost") > 0, "BOTH_LOSS_STATE"), F.when(F.col("n_overlap") > 0, "NON_EXCLUSIVE"), F.when(F.col("n_gap") > 0, "NON_EXHAUSTIVE")))
    return F.when(F.size(reasons) == 0, "COVERED").otherwise(F.array_join(reasons, "+"))


def payoffs(legs: int) -> Column:
    """Multiplier of every leg in every state class."""
    return F.transform("vectors", lambda v: F.array(*(s.multiplier(v[i], F.col(f"odds_{x}")) for i, x in enumerate("abc"[:legs]))))


def worst(rows: Column, share: Column) -> Column:
    """The smallest return over states for a share of the first of two legs."""
    return F.array_min(F.transform(rows, lambda r: r[0] * share + r[1] * (1 - share)))


def maximin_two(df: DataFrame) -> DataFrame:
    """Adds best_return, the largest guaranteed return of a stake of 1 split over two legs.

    The optimum is at an end or where two states' lines cross; all these shares are evaluated in one expression.
    """
    m = df.withColumn("matrix", payoffs(2))
    slope = lambda r: r[0] - r[1]
    crossing = F.flatten(F.transform("matrix", lambda x: F.transform("matrix", lambda y: F.try_divide(y[1] - x[1], slope(x) - slope(y)))))
    shares = F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(crossing, lambda t: t.isNotNull() & (t > 0) & (t < 1)))
    return m.withColumn("best_return", F.array_max(F.transform(shares, lambda t: worst(F.col("matrix"), t)))).drop("matrix")


#: Systems of equations that one stacked call solves at most, and matrices of up to three legs that are taken at once.
SYSTEMS, BLOCK = 200_000, 8192


def maximin_stack(matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, shares) of the largest guaranteed returns of many matrices of one shape (rows x states x legs, all >= 0).

    Up to three legs by closed forms over the states that matter, more by linear solves.
    """
    count, states, legs = matrices.shape
    if legs > 3:
        return _vertices(matrices)
    values, shares = np.zeros(count), np.zeros((count, legs))
    for i in range(0, count, BLOCK):
        some = matrices[i : i + BLOCK]
        kept = _least_states(some)
        sizes = kept.sum(axis=1)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            values[i + at], shares[i + at] = _closed(some[at][kept[at]].reshape(len(at), size, legs))
    return values, shares


def _least_states(matrices: np.ndarray) -> np.ndarray:
    """rows x states: whether a state can decide the least return, as no other pays at most as much with every leg (of equal ones the first)."""
    count, states, legs = matrices.shape
    m = np.ascontiguousarray(matrices.transpose(1, 2, 0))
    kept = np.ones((states, count), bool)
    for x, y in permutations(range(states), 2):
        under, less = m[x, 0] <= m[y, 0], m[x, 0] < m[y, 0]
        for leg in range(1, legs):
            under &= m[x, leg] <= m[y, leg]
            less |= m[x, leg] < m[y, leg]
        kept[y] &= ~(under & less if y < x else under)
    return kept.T


def _closed(matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``maximin_stack`` of at most three legs: all on one leg, two legs where two states pay the same, three where three do."""
    count, states, legs = matrices.shape
    m = np.ascontiguousarray(matrices.transpose(1, 2, 0))
    values, best = np.full(count, -np.inf), np.zeros((legs, count))

    def offer(share: dict) -> None:
        worth = good = None
        for x in range(states):
            paid = sum(v * m[x, i] for i, v in share.items())
            worth = paid if worth is None else np.minimum(worth, paid)
        good = worth > values  # not if it is nan
        for v in share.values():
            good = good & (v >= -1e-9)
        if good.any():
            values[good] = worth[good]
            for i in range(legs):
                best[i, good] = np.broadcast_to(share.get(i, 0.0), (count,))[good]

    def parted(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.where(np.abs(whole) > 1e-12, part / whole, np.nan)

    with np.errstate(all="ignore"):
        for i in range(legs):
            offer({i: np.float64(1.0)})
        for i, j in combinations(range(legs), 2):
            for x, y in combinations(range(states), 2):
                share = parted(m[y, j] - m[x, j], m[x, i] - m[x, j] - m[y, i] + m[y, j])
                offer({i: share, j: 1 - share})
        if legs == 3:
            for x, y, z in combinations(range(states), 3):
                a, b = m[x] - m[y], m[x] - m[z]
                across = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
                whole = across[0] + across[1] + across[2]
                first, second = parted(across[0], whole), parted(across[1], whole)
                offer({0: first, 1: second, 2: 1 - first - second})
    return values, best.T


def _vertices(matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``maximin_stack`` for any number of legs.

    Every vertex of the polytope of (shares, value) has as many tight rows as legs: states that attain the value or
    shares of zero. The vertices of all matrices are solved in stacked calls and the best feasible one of each is taken.
    """
    count, states, legs = matrices.shape
    zero = np.broadcast_to(np.hstack([np.eye(legs), np.zeros((legs, 1))]), (count, legs, legs + 1))
    rows = np.concatenate([np.concatenate([matrices, -np.ones((count, states, 1))], axis=2), zero], axis=1)
    chosen = np.array(list(combinations(range(states + legs), legs)))
    values, shares = np.zeros(count), np.zeros((count, legs))
    step = max(1, SYSTEMS // len(chosen))
    right = np.append(np.zeros(legs), 1.0)[:, None]
    for i in range(0, count, step):
        some = matrices[i : i + step]
        total = np.broadcast_to(np.append(np.ones(legs), 0), (len(some), len(chosen), 1, legs + 1))
        systems = np.concatenate([rows[i : i + step][:, chosen], total], axis=2)
        good = np.abs(np.linalg.det(systems)) > 1e-12
        systems[~good] = np.eye(legs + 1)
        points = np.linalg.solve(systems, np.broadcast_to(right, (*systems.shape[:2], legs + 1, 1)))[..., 0][..., :legs]
        good &= (points >= -1e-9).all(axis=2)
        worth = np.where(good, (points @ some.transpose(0, 2, 1)).min(axis=2), -np.inf)
        best, at = worth.argmax(axis=1), np.arange(len(some))
        values[i : i + step], shares[i : i + step] = worth[at, best], points[at, best]
    return values, shares


def maximin(matrix: np.ndarray) -> tuple[float, np.ndarray]:
    """(value, shares) of one matrix (states x legs)."""
    values, shares = maximin_stack(np.unique(matrix, axis=0)[None])
    return float(values[0]), shares[0]


SOLVED = StructType().add("best_return", DoubleType()).add("shares", ArrayType(DoubleType()))


@F.arrow_udf(SOLVED)
def solved(vectors: pa.Array, odds: pa.Array) -> pa.Array:
    """The best guaranteed return and its shares, from the distinct result vectors of a candidate's states and the odds of its legs; null where odds are null.

    Candidates with as many states and legs are solved in stacked calls.
    """
    rows = np.flatnonzero(pc.fill_null(pc.and_(pc.is_valid(vectors), pc.is_valid(odds)), False).to_numpy(zero_copy_only=False))
    best, shares = np.full(len(odds), np.nan), {}
    vectors, odds = vectors.take(pa.array(rows)), odds.take(pa.array(rows))
    states, legs = pc.list_value_length(vectors).to_numpy(), pc.list_value_length(odds).to_numpy()
    results, prices = vectors.flatten().flatten().to_numpy(zero_copy_only=False), odds.flatten().to_numpy(zero_copy_only=False)
    of_results, of_prices = np.cumsum(states * legs) - states * legs, np.cumsum(legs) - legs
    for shape in set(zip(states.tolist(), legs.tolist(), strict=True)):
        at = np.flatnonzero((states == shape[0]) & (legs == shape[1]))
        result = results[of_results[at][:, None] + np.arange(shape[0] * shape[1])].reshape(len(at), *shape).astype(int)
        price = prices[of_prices[at][:, None] + np.arange(shape[1])][:, None, :]
        best[rows[at]], found = maximin_stack(s.SHARE_OF_ODDS[result + 2] * price + s.SHARE_OF_STAKE[result + 2])
        shares[shape] = (rows[at], np.clip(found, 0, None))
    sizes = np.zeros(len(best), np.int32)
    for at, found in shares.values():
        sizes[at] = found.shape[1]
    ends = np.cumsum(sizes)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0)
    for at, found in shares.values():
        flat[(ends - sizes)[at][:, None] + np.arange(found.shape[1])] = found
    none = sizes == 0
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat), mask=pa.array(none))
    return pa.StructArray.from_arrays([pa.array(best, mask=none), lists], ["best_return", "shares"])


#: Said to be random, so that a filter on what it returns is never pushed below it, where it would solve all once more.
solved = solved.asNondeterministic()


def maximin_many(df: DataFrame, legs: int) -> DataFrame:
    """event, slots and best_return of candidates of three legs and more."""
    keys = ["event", *(f"slot_{x}" for x in "abc"[:legs])]
    found = solved("vectors", F.array(*(F.col(f"odds_{x}") for x in "abc"[:legs])))
    return df.select(*keys, found["best_return"].alias("best_return"))


def scan_status(pruned: Column, verdict: Column, best_return: Column) -> Column:
    return F.when(pruned, "PRUNED").when(verdict != "COVERED", "REJECTED").when(best_return > 1 + 1e-9, "ARB").otherwise("NO_ARB")


def freshness(age_ms: Column) -> Column:
    """FRESH below 5 s, AGING below 15 s, else STALE; null without an age."""
    return F.when(age_ms < 5000, "FRESH").when(age_ms < 15000, "AGING").when(age_ms.isNotNull(), "STALE")


def price_age(now_ms: Column, source_ms: Column, observed_ms: Column) -> Column:
    return F.greatest(F.lit(0), now_ms - F.coalesce(source_ms, observed_ms))


def validation(scan: Column, changed: Column, covering: Column, attested: Column, stale: Column, failed: Column, rechecked: Column) -> Column:
    """The ladder of validation: the first that holds."""
    return (
        F.when(scan != "ARB", "REJECTED").when(changed, "INVALIDATED").when(rechecked & ~covering, "INVALIDATED").when(~attested, "THEORETICAL_ARB")
        .when(stale, "STALE").when(failed, "REJECTED").when(rechecked, "VERIFIED_ARB").otherwise("FRESH_ARB")
    )
