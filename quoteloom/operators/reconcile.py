"""Folding of stored events that providers name twice, and what follows from it for their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut
from ..sources.versions import Versions
from . import ops

#: Providers from the most trusted one; others come after them.
PRIORITY = ["odds-api", "parlay-api"]
NEAR_MS = 7_200_000


def provider_rank(provider: Column) -> Column:
    """A provider's place in the order of trust."""
    at = F.array_position(F.array(*map(F.lit, PRIORITY)), provider)
    return F.when(at > 0, at - 1).otherwise(len(PRIORITY)).cast("int")


def _islands(events: DataFrame, near_ms: int) -> DataFrame:
    """Adds ``island``: events of equal teams that are near each other are of one island.

    Only the distinct buckets of a pair of teams are sorted in one task, never its events.
    """
    bucket = F.floor(F.col("start_ms") / near_ms)
    keyed = events.withColumn("bucket", bucket)
    found = keyed.select("home", "away", "bucket").distinct()
    number = F.row_number().over(Window.partitionBy("home", "away").orderBy("bucket"))
    k, f = keyed.alias("k"), found.withColumn("island", F.col("bucket") - number).hint("merge").alias("f")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("home", "away", "bucket")]
    return k.join(f, same).select(*(F.col(f"k.{c}") for c in events.columns), "f.island")


class Roots:
    """The roots of an island by their time: of equal providers, competition and start only the first can ever be the best."""

    def __init__(self, near_ms: int) -> None:
        self.near_ms, self.buckets, self.count = near_ms, {}, 0

    def add(self, event, providers: frozenset, competition, start: int) -> None:
        self.count += 1
        self.buckets.setdefault(start // self.near_ms, {}).setdefault((providers, competition, start), (self.count, event))

    def held_against(self, providers: frozenset, competition, start: int) -> tuple[tuple | None, tuple | None]:
        """(id, score) of the best root that an event surely is, and of the first near one that it may be."""
        best = near = None
        for bucket in range(start // self.near_ms - 1, start // self.near_ms + 2):
            for (other, theirs, at), (number, event) in self.buckets.get(bucket, {}).items():
                if abs(at - start) > self.near_ms or not other.isdisjoint(providers):
                    continue
                score = 0.8 if competition is None or theirs is None else 1.0 if competition == theirs else 0.6
                mine = (-score, number, event)
                if score >= 0.8:
                    best = mine if best is None else min(best, mine)
                else:
                    near = mine if near is None else min(near, mine)
        return best and (best[2], -best[0]), near and (near[2], -near[0])


def fold_events(events: DataFrame, near_ms: int = NEAR_MS) -> DataFrame:
    """The merge plan of stored events: id, winner_id, score, uncertain_id, uncertain_score, members.

    events: id, provider or providers (an array: an event that several name), home, away, competition, start_ms, created_ms, teams by
    their canonical names. In the order of trust (that of the best provider), creation and id each event is held against the roots before it that
    no provider of its names: of those it is sure
    about (equal teams, near start, competitions not different: 0.8 or 1.0) it joins the best, the first of equal
    ones; else it is a root itself, and the best root it is not sure about is named.

    Sure pairs are near, so the fold runs over islands of near events with the island's roots as its state, found by their time: an
    event meets the distinct starts near its own, not all roots. Roots that
    are far can only be uncertain, and of those of a competition and a set of providers only the first can be the best: for two
    teams an array of a few rows, found by aggregation. Events without a team, or a start, are roots of their own and
    held against none. The fold runs once; its result is cut off from the plan.
    """
    order = ["rank", "created_ms", "id"]
    providers = F.array_sort("providers") if "providers" in events.columns else F.array("provider")
    named = events.select("id", providers.alias("providers"), "home", "away", "competition", "start_ms", "created_ms")
    rank = F.coalesce(F.array_min(F.transform("providers", provider_rank)), F.lit(len(PRIORITY)))
    ranked = _islands(named.withColumn("rank", rank), near_ms)

    def step(roots, row):
        home, away, _, rank, created, event, providers, competition, start = row
        best = near = None
        if home is not None and away is not None and start is not None:
            roots = Roots(near_ms) if roots is None else roots
            own = frozenset(providers or ())
            best, near = roots.held_against(own, competition, start)
            if best is None:
                roots.add(event, own, competition, start)
        winner, score = best or (event, None)
        known = (home, away, rank, created, event, providers, competition)
        return roots, (*known, winner, score, *((near or (None, None)) if best is None else (None, None)), start is not None)

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    columns = ["home", "away", "rank", "created_ms", "id", "providers", "competition"]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in columns), f"winner_id {kinds['id']}, score double, near_id {kinds['id']}, near_score double, dated boolean"])
    folded = cut(ops.folded(ranked, ["home", "away", "island"], [*order, "providers", "competition", "start_ms"], step, schema))

    own = F.struct(*order)
    first = folded.where("id = winner_id and dated").groupBy("home", "away", "competition", "providers").agg(F.min(own).alias("first"))
    heads = first.groupBy("home", "away").agg(F.collect_list(F.struct("competition", "providers", "first")).alias("heads"))
    both = folded.join(heads, ["home", "away"], "left")
    apart = lambda h: ~F.coalesce(F.arrays_overlap(F.coalesce(h["providers"], F.array()), F.coalesce("providers", F.array())), F.lit(False))
    before = F.filter("heads", lambda h: apart(h) & (h["first"] < own))
    mine = F.col("competition")
    score = lambda c: F.when(c == mine, 0.7).when(c.isNull() | mine.isNull(), 0.5).otherwise(0.3)
    far = F.transform(before, lambda h: F.struct((-score(h["competition"])).alias("less"), h["first"]["rank"].alias("rank"), h["first"]["created_ms"].cast("long").alias("created_ms"), h["first"]["id"].alias("other")))
    near = F.when(F.col("near_id").isNotNull(), F.array(F.struct((-F.col("near_score")).alias("less"), F.lit(-1).alias("rank"), F.lit(None).cast("long").alias("created_ms"), F.col("near_id").alias("other"))))
    none = F.array().cast(f"array<struct<less:double,rank:int,created_ms:bigint,other:{kinds['id']}>>")
    best = F.when((F.col("id") == F.col("winner_id")) & F.col("dated"), F.array_min(F.concat(F.coalesce(near, none), F.coalesce(far, none))))
    sizes = folded.groupBy("winner_id").agg(F.count("*").alias("members"))
    found = both.withColumn("best", best).join(sizes, "winner_id")
    return found.select("id", "winner_id", "score", F.col("best.other").alias("uncertain_id"), (-F.col("best.less")).alias("uncertain_score"), "members")


def merge_rows(rows: DataFrame, plan: DataFrame, event: str, key: list[str]) -> DataFrame:
    """Per surviving event what its merge does to the rows of ``rows``: kept, moved here, dropped as conflicts.

    Of rows with equal ``key`` within a surviving event its own stays, or else that of the smallest merged id. The rows
    are dealt by the survivor once; both aggregations use that.
    """
    pointed = rows.join(plan.select(F.col("id").alias(event), "winner_id"), event).select("winner_id", event, *key).repartition("winner_id")
    first = F.min(F.struct((F.col(event) != F.col("winner_id")).alias("moved"), F.col(event)))
    per_key = pointed.groupBy("winner_id", *key).agg(first.alias("first"), F.count("*").alias("n"))
    return per_key.groupBy("winner_id").agg(F.count("*").alias("kept"), F.count_if(F.col("first.moved")).alias("moved"), F.sum(F.col("n") - 1).alias("dropped"))


def merged_rows(rows: DataFrame, plan: DataFrame, event: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows after the merge, conflicts): what ``merge_rows`` counts, row by row.

    A row that stays has its survivor as ``event``, its own event as ``from_event`` and whether it ``moved``. A conflict
    is a row whose key the survivor has already: its own columns, ``winner_id`` and the event of the row that stays, ``kept_from``. Of rows of one event and key
    the least by its other columns stays.
    """
    rest = [c for c in rows.columns if c not in (event, *key)]
    pointed = rows.join(plan.select(F.col("id").alias(event), "winner_id"), event)
    row = F.struct((F.col(event) != F.col("winner_id")).alias("moved"), F.col(event).alias("from_event"), *rest)
    kept = pointed.groupBy("winner_id", *key).agg(F.min(row).alias("row"), F.count("*").alias("n"))
    stay = kept.select(F.col("winner_id").alias(event), *key, "row.from_event", "row.moved", *(f"row.{c}" for c in rest))
    p, k = pointed.withColumn("row", row).alias("p"), kept.where("n > 1").alias("k")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("winner_id", *key)]
    own = F.struct(*(f"p.{c}" for c in rows.columns)).alias("own")
    both = p.join(k, same).select(own, "p.winner_id", F.col("p.row").alias("row"), F.col("k.row").alias("kept"))
    # copies of the row that stays are conflicts too, but one
    again = both.where("row = kept").groupBy("own", "winner_id", "kept").agg(F.count("*").alias("n")).where("n > 1").select("own", "winner_id", "kept", F.explode(F.sequence(F.lit(2), "n")).alias("copy")).drop("copy")
    lost = both.where("row <> kept").select("own", "winner_id", "kept").unionByName(again)
    return stay, lost.select("own.*", "winner_id", F.col("kept.from_event").alias("kept_from"))


def apply_merge(versions: Versions, number: int, plan: DataFrame, tables: dict[str, tuple[DataFrame, str, list[str]]]) -> bool:
    """Writes the merge of several tables (name to rows, event column and key) as one version: each table, its conflicts
    (``<name>_conflicts``) and the ``plan``. False if that version is committed already, so a retry changes nothing."""
    if number in versions.committed():
        return False
    plan = versions.write("plan", number, plan)
    for name, (rows, event, key) in tables.items():
        stay, lost = merged_rows(rows, plan, event, key)
        versions.write(name, number, stay)
        versions.write(f"{name}_conflicts", number, lost)
    versions.commit(number)
    return True


def promote(rows: DataFrame, keys: list[str], row_id: str, at: str) -> DataFrame:
    """keys, primary, promoted: the most trusted provider's row takes the identity; whether it wasn't the first stored."""
    found = rows.groupBy(*keys).agg(F.min(F.struct(provider_rank(F.col("provider")).alias("rank"), F.col(row_id).alias("row"))).alias("best"), F.min(F.struct(F.col(at).alias("at"), F.col(row_id).alias("row"))).alias("first"))
    return found.select(*keys, F.col("best.row").alias("primary"), (F.col("best.row") != F.col("first.row")).alias("promoted"))
