"""Operator 11, exact top-k search: dual-tree search with cover trees over queries and data.

A vector's components are floor(1024 x); a score is the inner product of two such integer vectors of one length.

1. Equal vectors are one point with its ``k + 1`` smallest ids: more can't be among ``k`` results and the query's own
   row. They are cut down in two turns, by (vector, salt) and by vector, so a vector of a third of all rows is no hot key.
2. One upper tree for both sides: pivots, farthest first, of a sample of at most ``SAMPLE`` vectors a length; each vector goes to the
   nearest pivot. The points of a cell are dealt to blocks of about ``BLOCK``; those of queries, cells near each other being
   put together, to blocks of about ``QUERIES``.
3. Each block becomes a cover tree: children are at least half the parent's radius apart and cover its points within
   that; each node has its centre, the radius of what it covers, and a range of points.
4. Query blocks are first searched in one data block of each of their cells. That gives every query a worst kth score. Then
   they meet all data blocks whose bound, <a, b> + |a| s + |b| r + r s for centres a, b and radii r, s, reaches the worst
   score of the query block. The table of block pairs has a row for each pair of blocks, not of vectors.
5. In a task the two trees are descended together: a pair of nodes is pruned by the same bound against the worst kth
   score of the query node's queries; the best bounds are opened first. Leaves are scored exactly.

Integer products below 2**53 are taken as doubles, which is exact; larger ones with Python's integers, and a score or
component beyond 64 bits is cut to the nearest long. Bounds are widened by 1e-9 of their size for rounding.

Defined results: each row is a candidate of its own, also if it repeats a vec_id; rows of one query id each get results; a
null vec_id is no query and comes after all others of its score; vectors that are null or hold null or non-finite
components take no part; empty vectors have scores of 0 with each other; vectors of different lengths don't meet; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

SCALE = 1024
SAMPLE, PIVOTS, NEAR = 2048, 64, 8
BLOCK, QUERIES, LEAF = 2048, 256, 16
SALTS, TILES = 32, 64
EXACT = 2**53
_LONG = (-(1 << 63), (1 << 63) - 1)


def scaled(embedding: Column) -> Column:
    """floor(1024 x) of each component; null if the vector takes no part."""
    # an infinite x less itself is not a number
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double") - x.cast("double")))
    return F.when(embedding.isNotNull() & finite, F.transform(embedding, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long")))


# ---- cover trees


class Tree:
    """A cover tree over the rows of ``points``, level by level: children of a node are consecutive nodes."""

    def __init__(self, points: np.ndarray, order: np.ndarray, centre: np.ndarray, radius: np.ndarray, rows: np.ndarray, children: np.ndarray) -> None:
        self.order, self.centre, self.radius, self.rows, self.children = order, centre, radius, rows, children
        self.points = points  # in the order of the tree
        self.middles = points[centre].astype(float)
        self.norms = np.sqrt((self.middles * self.middles).sum(1))

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        flat = points.astype(float)
        distance = lambda some, at: np.sqrt(((flat[some] - flat[at]) ** 2).sum(1))
        everything = np.arange(len(points))
        root = int(distance(everything, [0]).argmax()) if len(points) == 2 else int(((flat - flat.mean(0)) ** 2).sum(1).argmin())
        waiting, nodes, order, children = [(root, everything)], [], [], []
        at = 0
        while at < len(waiting):
            centre, members = waiting[at]
            at += 1
            away = distance(members, centre)
            radius = float(away.max())
            first = len(waiting)
            if len(members) > LEAF and radius > 0:
                # the centre is a child of itself; then always the one farthest from all children so far
                nearest, child, centres = away, np.zeros(len(members), np.int64), [centre]
                while nearest.max() > radius / 2:
                    centres.append(int(members[nearest.argmax()]))
                    other = distance(members, centres[-1])
                    child[other < nearest] = len(centres) - 1
                    nearest = np.minimum(nearest, other)
                waiting += [(c, members[child == i]) for i, c in enumerate(centres)]
            nodes.append((centre, radius))
            children.append((first, len(waiting)))
            order.append(members)
        # depth first, so that a node's rows are a range
        rows, place, out = np.zeros((len(nodes), 2), np.int64), 0, []
        stack = [(0, False)]
        while stack:
            node, done = stack.pop()
            if done:
                rows[node, 1] = place
                continue
            rows[node, 0] = place
            stack.append((node, True))
            a, b = children[node]
            if a == b:
                out.append(order[node])
                place += len(order[node])
            stack += [(child, False) for child in range(b - 1, a - 1, -1)]
        order = np.concatenate(out)
        position = np.empty(len(order), np.int64)
        position[order] = np.arange(len(order))
        return cls(points[order], order, position[[c for c, _ in nodes]], np.array([r for _, r in nodes]), rows, np.array(children))

    FIELDS = (("centre", np.int64, 1), ("radius", np.float64, 1), ("rows", np.int64, 2), ("children", np.int64, 2))

    def packed(self) -> dict[str, bytes]:
        return {"points": self.points.tobytes()} | {name: getattr(self, name).astype(kind).tobytes() for name, kind, _ in self.FIELDS}

    @classmethod
    def unpacked(cls, row: dict, size: int) -> Tree:
        """From the bytes of ``packed``; the points are in the order of the tree already."""
        n = len(row["rows_ids"])
        parts = {name: np.frombuffer(row[name], kind).reshape(-1, width) if width > 1 else np.frombuffer(row[name], kind) for name, kind, width in cls.FIELDS}
        return cls(np.frombuffer(row["points"], np.int64).reshape(n, size), np.arange(n), **parts)

    def bounds(self, nodes: np.ndarray, middle: np.ndarray, norm: float, radius: float) -> np.ndarray:
        """The largest inner products that points of these nodes and points within ``radius`` of ``middle`` can have."""
        both = self.radius[nodes]
        size = self.norms[nodes] * (norm + radius) + both * (norm + radius)
        return self.middles[nodes] @ middle + self.norms[nodes] * radius + both * (norm + radius) + 1e-9 * size + 1e-6


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, as longs."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = lambda x: max(int(x.max()), -int(x.min()))
    if a.shape[1] * most(a) * most(b) < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.vectorize(lambda x: min(max(x, _LONG[0]), _LONG[1]), otypes=[np.int64])(exact)


class Search:
    """The ``k`` best rows of each query of one tree among the points of others."""

    def __init__(self, queries: Tree, k: int, floors: np.ndarray) -> None:
        self.queries, self.k, self.floors = queries, k, floors.copy()
        self.best: list[list[tuple]] = [[] for _ in queries.points]  # (-score, no id, id), best first

    def against(self, data: Tree, ids: list[list]) -> None:
        self._visit(0, data, ids, np.array([0]))

    def _bounds(self, node: int, data: Tree, nodes: np.ndarray) -> np.ndarray:
        q = self.queries
        return data.bounds(nodes, q.middles[node], q.norms[node], q.radius[node])

    def _worst(self, node: int) -> float:
        a, b = self.queries.rows[node]
        return self.floors[a:b].min()

    def _visit(self, node: int, data: Tree, ids: list[list], nodes: np.ndarray) -> None:
        bounds = self._bounds(node, data, nodes)
        nodes = nodes[bounds >= self._worst(node)]
        if not len(nodes):
            return
        first, past = self.queries.children[node]
        if first < past:
            # the side with the larger radius is opened; data nodes that are leaves stay
            wide = (data.children[nodes, 0] < data.children[nodes, 1]) & (data.radius[nodes] >= self.queries.radius[node])
            if wide.any():
                self._visit(node, data, ids, np.concatenate([nodes[~wide], *(np.arange(*data.children[x]) for x in nodes[wide])]))
                return
            for child in range(first, past):
                self._visit(child, data, ids, nodes)
            return
        bounds, many = self._bounds(node, data, nodes), 1
        while len(nodes):
            # the best bounds first; their children and what is left are held against the worst score again
            order = np.argsort(-bounds, kind="stable")
            now, nodes, bounds = nodes[order[:many]], nodes[order[many:]], bounds[order[many:]]
            many = min(16, 2 * many)
            leaf = data.children[now, 0] == data.children[now, 1]
            if leaf.any():
                self._score(node, data, ids, np.concatenate([np.arange(*data.rows[x]) for x in now[leaf]]))
            opened = [np.arange(*data.children[x]) for x in now[~leaf]]
            if opened:
                opened = np.concatenate(opened)
                nodes, bounds = np.append(nodes, opened), np.append(bounds, self._bounds(node, data, opened))
            good = bounds >= self._worst(node)
            nodes, bounds = nodes[good], bounds[good]

    def _score(self, node: int, data: Tree, ids: list[list], points: np.ndarray) -> None:
        a, b = self.queries.rows[node]
        scores = products(self.queries.points[a:b], data.points[points])
        for i, row in enumerate(scores, a):
            good = np.flatnonzero(row >= self.floors[i])
            if len(good) > self.k:
                good = good[row[good] >= np.partition(row[good], len(good) - self.k)[len(good) - self.k]]
            if not len(good):
                continue
            found = self.best[i] + [(-int(row[j]), x is None, x) for j in good for x in ids[points[j]]]
            found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
            self.best[i] = found[: self.k]
            if len(found) >= self.k:
                self.floors[i] = max(self.floors[i], -found[self.k - 1][0])


# ---- blocks


def _pivots(rows: list[list[int]], count: int) -> np.ndarray:
    """Of a sample, ``count`` vectors that are farthest from each other, each from those before it."""
    sample = np.array(rows, float).reshape(len(rows), -1)
    chosen, nearest = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def with_cells(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with the number of the nearest pivot of their length; pivots: at most PIVOTS of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["vector"]
            length = np.diff(lists.offsets.to_numpy())
            cell = np.zeros(batch.num_rows, np.int32)
            for size, some in pivots.items():
                mine = np.flatnonzero(length == size)
                if size and len(mine):
                    values = lists.take(pa.array(mine)).flatten().to_numpy().astype(float).reshape(-1, size)
                    cell[mine] = ((values * values).sum(1)[:, None] - 2 * values @ some.T + (some * some).sum(1)).argmin(1)
            yield batch.append_column("cell", pa.array(cell))

    return vectors.mapInArrow(run, vectors.withColumn("cell", F.lit(0)).schema)


BLOCK_ROW = "block string, size int, first_cell int, sub int, middle array<double>, radius double, points binary, centre binary, radii binary, rows binary, children binary, ids array<array<long>>, self array<long>"


def blocks(rows: DataFrame) -> DataFrame:
    """A row (``BLOCK_ROW``) for each block of ``rows`` (block, size, cell, sub, vector, ids)."""
    names = [x.split()[0] for x in BLOCK_ROW.split(", ")]

    def build(table: pa.Table) -> pa.Table:
        size = table["size"][0].as_py()
        lists = table["vector"].combine_chunks()
        points = lists.flatten().to_numpy().reshape(len(lists), size)
        tree = Tree.build(points)
        packed = tree.packed()
        own = [int(products(x[None], x[None])[0, 0]) for x in tree.points]
        values = [table["block"][0].as_py(), size, table["cell"][0].as_py(), table["sub"][0].as_py(), tree.middles[0].tolist(), float(tree.radius[0])]
        values += [packed["points"], packed["centre"], packed["radius"], packed["rows"], packed["children"]]
        ids = table["ids"].combine_chunks().take(pa.array(tree.order))
        columns = [pa.array([x]) for x in values]
        columns[1:4] = [pa.array([x], pa.int32()) for x in values[1:4]]
        columns[4] = pa.array([values[4]], pa.list_(pa.float64()))
        columns += [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([own], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, names)

    return rows.groupBy("block").applyInArrow(build, BLOCK_ROW)


def _tree(row: dict, of: str) -> Tree:
    packed = {name: row[f"{of}_{'radii' if name == 'radius' else name}"] for name in ("points", "centre", "radius", "rows", "children")}
    return Tree.unpacked(packed | {"rows_ids": row[f"{of}_self"]}, row["size"])


def searched(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """block, place, score, vec_id: the ``k`` best rows at most of each query in each pair (query, data, floors) of blocks."""
    payload = ["points", "centre", "radii", "rows", "children", "self"]
    q = queries.select(F.col("block").alias("query"), "size", *(F.col(c).alias(f"q_{c}") for c in payload))
    d = data.select(F.col("block").alias("data"), "ids", *(F.col(c).alias(f"d_{c}") for c in payload))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                tree = _tree(row, "q")
                floors = np.full(len(tree.points), -np.inf) if row["floors"] is None else np.array([-np.inf if x is None else x for x in row["floors"]], float)
                search = Search(tree, k, floors)
                search.against(_tree(row, "d"), row["ids"])
                out = [(place, -score, vec_id) for place, best in enumerate(search.best) for score, _, vec_id in best]
                place, score, vec_id = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["query"]] * len(out), pa.string()), pa.array(place, pa.int32()), pa.array(score, pa.int64()), pa.array(vec_id, pa.int64())], ["block", "place", "score", "vec_id"]
                )

    return pairs.join(q, "query").join(d, "data").mapInArrow(run, "block string, place int, score long, vec_id long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """vector, ids: its ``k`` smallest ids, in order."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for keys in (["vector", "salt"], ["vector"]):
        order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("vec_id"))
        salted = salted.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    few = F.array_sort(F.collect_list(F.struct("n", "vec_id")))
    return salted.groupBy("vector").agg(F.transform(few, lambda x: x["vec_id"]).alias("ids"))


def top_k(rows: DataFrame, k: int = 10, every: int = 100, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best other rows of each row of ``rows`` (vec_id, embedding) whose id is divisible by ``every``."""
    scratch = store.Scratch()
    spark = rows.sparkSession
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("vector")).where("vector is not null")
    own = scratch.keep(own, "vectors")
    asked = own.where(F.col("vec_id") % every == 0)
    points = scratch.keep(distinct_vectors(own, k + 1), "vector-points")

    sizes = [r["size"] for r in points.select(F.size("vector").alias("size")).distinct().collect()]  # the lengths that there are
    if not sizes:
        scratch.clear()
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = {}
    for size in sizes:
        sample = points.where(F.size("vector") == size).select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE)
        pivots[size] = _pivots([r["vector"] for r in sample.collect()], PIVOTS)
    data = scratch.keep(with_cells(points, pivots), "vector-cells")
    wanted = scratch.keep(with_cells(asked.select("vector").distinct().withColumn("ids", F.array().cast("array<long>")), pivots), "query-cells")

    # of each cell, its size and group: a query block takes cells near the same early pivot until it is full
    counts = lambda x: {(r["size"], r["cell"]): r["count"] for r in x.groupBy(F.size("vector").alias("size"), "cell").count().collect()}  # noqa: E731 at most PIVOTS a length
    n_data, n_wanted = counts(data), counts(wanted)
    upper = lambda size, cell: int(((pivots[size][:NEAR] - pivots[size][cell]) ** 2).sum(1).argmin())
    groups, full = {}, {}
    for size, _, cell in sorted((size, upper(size, cell), cell) for size, cell in n_wanted):
        number = len(full) - 1
        if not groups or next(reversed(groups))[0] != size or full[number] >= queries:
            number += 1
            full[number] = 0
        groups[size, cell] = number
        full[number] += n_wanted[size, cell]
    split = lambda count, most: max(1, -(-count // most))
    plan = spark.createDataFrame(
        [(s, c, groups.get((s, c)), split(full[groups[s, c]], queries) if (s, c) in groups else 1, split(n, block)) for (s, c), n in n_data.items()],
        "size int, cell int, group int, query_blocks int, data_blocks int",
    )
    planned = lambda x: x.withColumn("size", F.size("vector")).join(F.broadcast(plan), ["size", "cell"])
    sub = lambda many: F.pmod(F.xxhash64("vector", F.lit(1)), F.col(many)).cast("int")
    columns = ["block", "size", "cell", "sub", "vector", "ids"]
    data = scratch.keep(blocks(planned(data).withColumn("sub", sub("data_blocks")).withColumn("block", F.concat_ws(":", "size", "cell", "sub")).select(columns)), "data-blocks")
    wanted = planned(wanted).withColumn("sub", sub("query_blocks")).withColumn("block", F.concat_ws(":", "size", "group", "sub")).withColumn("cell", F.col("group"))
    wanted = scratch.keep(blocks(wanted.select(columns)), "query-blocks")

    # first turn: one data block of each cell of the block
    cells = plan.where(F.col("group").isNotNull()).select("size", F.col("group").alias("first_cell"), "cell")
    q = wanted.select(F.col("block").alias("query"), "size", "first_cell").join(F.broadcast(cells), ["size", "first_cell"])
    d = data.where("sub = 0").select(F.col("block").alias("data"), "size", F.col("first_cell").alias("cell"))
    seeds = scratch.keep(q.join(F.broadcast(d), ["size", "cell"]).select("query", "data"), "block-seeds")
    none = F.lit(None).cast("array<long>").alias("floors")
    found = scratch.keep(_best(searched(seeds.select("*", none), wanted, data, k + 1), k + 1).drop("rank"), "seed-found")
    floors = found.groupBy("block", "place").agg(F.when(F.count("*") > k, F.min("score")).alias("floor"))
    # a null floor is a query without enough results yet
    places = wanted.select("block", F.posexplode("self").alias("place", "own")).join(floors, ["block", "place"], "left")
    floors = places.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "floor"))).alias("each"))
    floors = floors.select(F.col("block").alias("query"), F.transform("each", lambda x: x["floor"]).alias("floors"))
    worst = F.when(F.exists("floors", lambda x: x.isNull()), float("-inf")).otherwise(F.array_min("floors").cast("double"))
    floors = scratch.keep(floors.withColumn("worst", worst), "block-floors")

    # second turn: all pairs of blocks whose bound reaches the worst score, by tiles of data blocks
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    summary = lambda x, name: x.select(F.col("block").alias(name), "size", F.col("middle").alias(f"{name}_middle"), F.col("radius").alias(f"{name}_radius"), norm(F.col("middle")).alias(f"{name}_norm"))
    q = summary(wanted, "query").join(floors.select("query", "worst"), "query").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(TILES - 1))))
    d = summary(data, "data").withColumn("tile", F.pmod(F.xxhash64("data"), F.lit(TILES)).cast("int"))
    inner = F.aggregate(F.zip_with("query_middle", "data_middle", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    reach, away = F.col("query_norm") + F.col("query_radius"), F.col("data_radius")
    slack = F.lit(1e-9) * (F.col("data_norm") + away) * reach + F.lit(1e-6)
    bound = inner + F.col("data_norm") * F.col("query_radius") + away * reach + slack
    pairs = q.join(d, ["size", "tile"]).where(bound >= F.col("worst")).select("query", "data").join(seeds, ["query", "data"], "left_anti")
    pairs = scratch.keep(pairs.join(floors.select("query", "floors"), "query"), "block-pairs")
    best = _best(found.union(searched(pairs, wanted, data, k + 1)), k + 1)
    lists = best.groupBy("block", "place").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("best"))

    # each query row again, without its own row
    unpacked = _unpacked(wanted)
    each = asked.withColumnRenamed("vec_id", "query_id").join(unpacked, "vector").join(lists, ["block", "place"])
    found_list = F.transform("best", lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id")))
    each = each.select("query_id", "own", found_list.alias("best")).withColumn("at", F.array_position("best", F.struct(F.col("own").alias("score"), F.col("query_id").alias("vec_id"))) - 1)
    others = F.slice(F.filter("best", lambda x, i: i != F.col("at")), 1, k)
    result = each.select("query_id", F.posexplode(others).alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
    result = store.keep(result, "vector-result")
    scratch.clear()
    return result


def _unpacked(queries: DataFrame) -> DataFrame:
    """vector, block, place, own (its product with itself) of all queries in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                points = np.frombuffer(batch["points"][i].as_buffer(), np.int64)
                own, size = batch["self"][i].values, batch["size"][i].as_py()
                edges = pa.array((np.arange(len(own) + 1) * size).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(edges, pa.array(points)), pa.array([batch["block"][i].as_py()] * len(own), pa.string()), pa.array(np.arange(len(own), dtype=np.int32)), own], ["vector", "block", "place", "own"]
                )

    return queries.select("block", "size", "points", "self").mapInArrow(run, "vector array<long>, block string, place int, own long")


#: The search in DuckDB, over all pairs.
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 10
"""
