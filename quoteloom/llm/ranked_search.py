"""Operator 12, ranked lexical search: the best documents of each item, by branch and bound over max trees.

Terms are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. A term weighs
``floor(1000 ln((2N + 2) / (2df + 1)))``; its part of a document of n terms is ``(10**9 tf) div (1000 tf + 8m)`` with
``m = 25 + (75 n N) div L``, for N documents with terms and L terms in all of them.

1. *Counts.* One pass over the whole texts counts the items' terms in each document (by hash, then the bytes are
   compared). N, L and df are aggregates over all documents.
2. *Index.* Documents in the order of their ids are cut into shards of ``SHARD``. For every term a shard has a max tree: the
   parts of its documents, above them the largest part of each range of ``FAN`` documents, of ``FAN``**2, and so on. An entry
   knows where its children begin, and ranges without the term have no entry.
3. *Search.* The bound of a range is the sum of weight times largest part. An item is first searched in the shard of
   its highest bound, then in all others whose bound reaches its tenth score. In a shard a heap opens the range of the
   highest bound, until no bound reaches the tenth score; ranges with just that bound are opened as far as they
   may hold a smaller id. Results of shards are merged, at most ``k`` rows each.

The items are the query set; they are searched in blocks whose terms take at most ``BLOCK_BYTES`` on the driver and in a task,
so neither grows with them. Scores are 64-bit integers: 75 n N must stay below 2**63.

Defined results: rows of one item_id (null is one too) are one item, with the terms of all of them; each row of ``docs`` is
a document, whatever its id; a null doc_id comes after all others of its score; null and empty texts have no terms; items
without terms and empty tables give no rows. Very long texts are read whole, by one task. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store, textscan
from .decontaminate import LOWER, RAW_WORD, UPPER

SHARD, FAN = 4096, 32
BLOCK_BYTES = 16 << 20
#: Past all ids, for documents without one.
_NO_ID = (1 << 63) - 1

#: Bytes between terms, after lower-casing.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"{RAW_WORD}+"), F.lit(0))


class Vocabulary:
    """Finds known terms among scanned words. Built on the driver from a bounded list and sent to the tasks."""

    #: So many bytes are compared for all words at once, those of longer words one by one.
    short = 24

    def __init__(self, terms: list[str]) -> None:
        self.terms = [t.encode() for t in terms]
        found = np.array([textscan.hash_spans(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0] for t in self.terms], np.uint64)
        self.order = np.argsort(found)
        self.lengths = np.array([len(t) for t in self.terms], np.int64)
        self.heads = np.array([list(t[: self.short].ljust(self.short, b"\0")) for t in self.terms], np.uint8)
        self.hashes = found[self.order]
        if len(np.unique(found)) < len(found):
            raise ValueError("two terms share a 64-bit hash")

    def find(self, words: textscan.Words) -> tuple[np.ndarray, np.ndarray]:
        """(places among the words, numbers of their terms) of the words that are terms."""
        if not len(self.terms) or not len(words.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        place = np.flatnonzero(self.hashes[at] == words.hash)
        term = self.order[at[place]]
        length, wanted = words.end[place] - words.start[place], self.lengths[term]
        same = length == wanted
        for j in range(int(min(self.short, wanted.max(initial=0)))):
            some = np.flatnonzero(same & (length > j))
            same[some] = words.data[words.start[place[some]] + j] == self.heads[term[some], j]
        for i in np.flatnonzero(same & (length > self.short)):
            a, b = words.start[place[i]], words.end[place[i]]
            same[i] = words.data[a:b].tobytes() == self.terms[term[i]]
        return place[same], term[same]


def counted(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n (all its terms), terms (numbers, ascending), tf of each row of ``docs``."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textscan.pieces(batch, "text"):
                words = textscan.scan(piece["text"], BETWEEN, lower=True)
                place, term = vocabulary.find(words)
                key, tf = np.unique(words.row[place] * max(1, len(vocabulary.terms)) + term, return_counts=True)
                row, term = np.divmod(key, max(1, len(vocabulary.terms)))
                edge = pa.array(np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32))
                n = np.bincount(words.row, minlength=piece.num_rows)
                lists = [pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int64))).cast(kind) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<long>, tf array<long>")


def levels(term: np.ndarray, place: np.ndarray, part: np.ndarray, size: int) -> list[tuple[np.ndarray, ...]]:
    """The max trees of all terms of a shard, documents first: (term, place, largest part, first child) of each entry.

    ``term``, ``place``: ascending. The last level has one entry a term.
    """
    out, below = [(term, place, part, np.arange(len(term)))], size
    while True:
        term, place, part, _ = out[-1]
        below = -(-below // FAN)
        upper = place // FAN
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (upper[1:] != upper[:-1]))) if len(term) else np.zeros(0, np.int64)
        out.append((term[first], upper[first], np.maximum.reduceat(part, first) if len(first) else part, first))
        if below <= 1:
            return out


SHARD_ROW = "shard long, least long, doc_ids array<long>, terms array<array<long>>, places array<array<long>>, parts array<array<long>>, firsts array<array<long>>"


def _nested(arrays: list[np.ndarray]) -> pa.Array:
    """One row: a list of lists of longs."""
    edges = np.append(0, np.cumsum([len(x) for x in arrays])).astype(np.int32)
    inner = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(arrays).astype(np.int64)))
    return pa.ListArray.from_arrays(pa.array([0, len(arrays)], pa.int32()), inner)


def shards(rows: DataFrame, n_docs: int, n_terms: int, size: int) -> DataFrame:
    """The shards (``SHARD_ROW``) of ``counted`` rows with terms: ranges of ids, each cut into runs of ``size`` documents."""

    def shard(number: int, batch: pa.Table) -> pa.RecordBatch:
        ids = batch["doc_id"].combine_chunks()
        # NumPy's integer division rounds down, as all of these are positive
        m = 25 + 75 * batch["n"].to_numpy() * n_docs // n_terms
        column = lambda name: batch[name].combine_chunks()
        place = np.repeat(np.arange(len(ids)), np.diff(column("terms").offsets.to_numpy()))
        term, tf = column("terms").flatten().to_numpy(), column("tf").flatten().to_numpy()
        part = 10**9 * tf // (1000 * tf + 8 * m[place])
        order = np.lexsort((place, term))
        tree = levels(term[order], place[order], part[order], len(ids))
        lists = [_nested([x[i] for x in tree]) for i in range(4)]
        all_ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), ids.slice(0, 1).fill_null(_NO_ID), all_ids, *lists],
            ["shard", "least", "doc_ids", "terms", "places", "parts", "firsts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, waiting, rows_waiting = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            waiting.append(batch)
            rows_waiting += batch.num_rows
            while rows_waiting >= size:
                table = pa.Table.from_batches(waiting)
                yield shard(number, table.slice(0, size).combine_chunks())
                waiting, rows_waiting, number = table.slice(size).to_batches(), rows_waiting - size, number + 1
        if rows_waiting:
            yield shard(number, pa.Table.from_batches(waiting).combine_chunks())

    some = rows.where(F.size("terms") > 0).withColumn("no_id", F.col("doc_id").isNull())
    # equal ids are spread too: by their terms
    spread = some.repartitionByRange("no_id", "doc_id", F.hash("terms", "tf", "n")).sortWithinPartitions("no_id", "doc_id")
    return spread.drop("no_id").mapInArrow(run, SHARD_ROW)


class Shard:
    """One shard's max trees, as arrays; ids: its documents', levels: as ``levels`` gives them."""

    def __init__(self, ids: pa.Array, levels: list[tuple[np.ndarray, ...]]) -> None:
        self.ids, self.levels = ids, levels
        self.order = ids.fill_null(_NO_ID).to_numpy()

    @classmethod
    def of(cls, row: pa.RecordBatch) -> Shard:
        """From a ``SHARD_ROW``, without copies."""
        trees = [[x.values.to_numpy(zero_copy_only=False) for x in row[c][0].values] for c in ("terms", "places", "parts", "firsts")]
        return cls(row["doc_ids"][0].values, list(zip(*trees, strict=True)))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, place) of the at most ``k`` best documents with a score of at least ``floor``; best first."""
        top = len(self.levels) - 1
        known = self.levels[top][0]
        entry = np.minimum(np.searchsorted(known, terms), max(len(known) - 1, 0))
        have = known[entry] == terms if len(known) else np.zeros(len(terms), bool)
        entry, weight = entry[have], weights[have]
        # the last level has one range, the whole shard
        heap = [(-int((weight * self.levels[top][2][entry]).sum()), 0, top, 0, entry, weight)] if len(entry) else []
        found: list[tuple[int, int, int]] = []  # (score, -id, -place), a heap whose first is the worst
        opened = 0
        while heap:
            bound, least, level, _, entry, weight = heapq.heappop(heap)
            bound = -bound
            if bound < max(floor, 1):
                break
            if len(found) == k:
                if bound < found[0][0]:
                    break
                if bound == found[0][0] and least > -found[0][1]:
                    continue
            # the children of all terms' entries, put together by range
            first = self.levels[level][3]
            count = np.append(first, len(self.levels[level - 1][0]))[entry + 1] - first[entry]
            child = np.repeat(first[entry] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            weight = np.repeat(weight, count)
            place, part = self.levels[level - 1][1][child], self.levels[level - 1][2][child]
            order = np.argsort(place, kind="stable")
            place, child, weight = place[order], child[order], weight[order]
            edge = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            bounds = np.add.reduceat(weight * part[order], edge)
            edges = np.append(edge, len(place)).tolist()
            for i, (where, score) in enumerate(zip(place[edge].tolist(), bounds.tolist(), strict=True)):
                if score < max(floor, 1) or (len(found) == k and score < found[0][0]):
                    continue
                if level == 1:
                    mine = (score, -int(self.order[where]), -where)
                    if len(found) < k:
                        heapq.heappush(found, mine)
                    elif mine > found[0]:
                        heapq.heapreplace(found, mine)
                else:
                    opened += 1
                    a, b = edges[i], edges[i + 1]
                    heapq.heappush(heap, (-score, int(self.order[where * FAN ** (level - 1)]), level - 1, opened, child[a:b], weight[a:b]))
        return [(score, -place) for score, _, place in sorted(found, reverse=True)]


def searched(index: DataFrame, wanted: DataFrame, items: dict, k: int, few: bool = False) -> DataFrame:
    """item, doc_id, score: the results of the wanted (shard, item, floor); items: item to (terms, weights), bounded.

    few: ``wanted`` has no more rows than there are items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                shard, out = Shard.of(row), []
                for want in row["wanted"][0].as_py():
                    out += [(want["item"], place, score) for score, place in shard.best(*items[want["item"]], k, want["floor"])]
                item, place, score = list(zip(*out, strict=True)) or [(), (), ()]
                ids = shard.ids.take(pa.array(place, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids, pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    asked = wanted.groupBy("shard").agg(F.collect_list(F.struct("item", "floor")).alias("wanted"))  # no more than a block has items
    return index.join(F.broadcast(asked) if few else asked, "shard").mapInArrow(run, "item long, doc_id long, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, own: DataFrame, k: int, size: int, scratch: store.Scratch) -> DataFrame:
    """item_id, rank, doc_id, score for one block of items; own: item_id, item (number), term, repeats."""
    spark = docs.sparkSession
    queries = [(r["item"], r["term"], r["repeats"]) for r in own.select("item", "term", "repeats").collect()]
    names = sorted({term for _, term, _ in queries})
    number = {term: i for i, term in enumerate(names)}
    rows = scratch.keep(counted(docs, Vocabulary(names)), "search-counts")
    total = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    weight = F.floor(F.lit(1000) * F.log(F.lit(2 * total["docs"] + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = {r["term"]: r["w"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")).collect()}  # one row a term of the block
    asked: dict[int, list[tuple[int, int]]] = {}
    for item, term, repeats in queries:
        if weights.get(number[term]):
            asked.setdefault(item, []).append((number[term], weights[number[term]] * repeats))
    items = {item: tuple(np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True)) for item, pairs in asked.items()}

    index = scratch.keep(shards(rows, total["docs"], max(1, total["terms"]), size), "search-index")
    tops = index.select("shard", "least", F.explode(F.arrays_zip(F.element_at("terms", -1).alias("term"), F.element_at("parts", -1).alias("part"))).alias("top")).select("shard", "least", "top.*")
    weighed = spark.createDataFrame([(item, t, w) for item, pairs in asked.items() for t, w in pairs], "item long, term long, weight long")
    bounds = tops.join(F.broadcast(weighed), "term").groupBy("item", "shard", "least").agg(F.sum(F.col("weight") * F.col("part")).alias("bound"))
    bounds = scratch.keep(bounds.where("bound > 0"), "search-bounds")
    first = bounds.groupBy("item").agg(F.max_by(F.struct("shard", "bound"), F.struct("bound", -F.col("least"))).alias("top")).select("item", "top.shard")
    first = scratch.keep(first.withColumn("floor", F.lit(1).cast("long")), "search-first")
    found = scratch.keep(searched(index, first, items, k, few=True), "search-found")
    tenth = _ranked(found, k).where(F.col("rank") == k).select("item", F.col("score").alias("floor"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("last"))
    rest = bounds.join(F.broadcast(first.select("item", "shard")), ["item", "shard"], "left_anti").join(F.broadcast(tenth), "item", "left")
    rest = rest.where(F.col("floor").isNull() | (F.col("bound") > F.col("floor")) | ((F.col("bound") == F.col("floor")) & (F.col("least") <= F.col("last"))))
    more = searched(index, rest.select("shard", "item", F.coalesce("floor", F.lit(1)).alias("floor")), items, k)
    ranked = _ranked(found.union(more), k)
    ids = own.select("item", "item_id").distinct()
    return ranked.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame, k: int = 10, shard: int = SHARD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``k`` best documents (doc_id, text) of each item (item_id, text)."""
    scratch = store.Scratch()
    own = benchmark.select("item_id", F.explode(terms_of(F.col("text").cast("string"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("repeats"))
    # an item is in one block, by its hash
    own = scratch.keep(own, "search-items")
    size = own.agg(F.coalesce(F.sum(F.octet_length("term") + 200), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    out = []
    for block in range(blocks):
        mine = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        order = Window.orderBy(F.asc_nulls_last("item_id"))  # the ids of one block, which is bounded
        numbered = mine.select("item_id").distinct().withColumn("item", F.row_number().over(order).cast("long"))
        mine = mine.alias("m").join(F.broadcast(numbered).alias("i"), F.col("m.item_id").eqNullSafe(F.col("i.item_id"))).select("m.*", "i.item")
        part = store.Scratch()
        out.append(store.keep(_search_block(docs, part.keep(mine, "search-block"), k, shard, part), "search-result"))
        part.clear()
    scratch.clear()
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


#: The ranking in DuckDB, over all pairs of items and documents that share a term.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
s AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY r, doc_id, n, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term),
scores AS (
  SELECT item_id, r, doc_id, CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nd) // l))))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN f USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
