"""Operator 4, n-gram Jaccard join: an exact set-similarity join by universe partition and pigeonhole.

A document's set has the hashes of its distinct word shingles. Two sets link if ``100 * |A & B| >= percent * |A | B|``.

*Size bands.* Band k has the sizes 2**k to 2**(k+1) - 1. A set works in its own band and, if a partner may be in the
next one, in that as well. Each band hashes the universe of shingles into segments of its own number.

*Pigeonhole.* A set of size s can differ from any partner that is not smaller, and from any smaller one, in at most
H = s * (100 - percent) / percent shingles. It walks the segments in a fixed order and allocates to each non-empty
one v = 1 (its subset is indexed) or v = 2 (its subset and all subsets with one shingle less, its one-deletion
neighbourhood) until the v add up to H + 1. Of two linked sets, take the one that stops first: its v exceed the
difference, so in some segment the sets are equal (v = 1), or differ by one shingle at most (v = 2); v depends only
on the segment's content and the other set walks at least as far, so both index a common key.

*Allocation by cost.* v = 2 is given from a segment size on. Number of segments and that size are chosen per band to
minimise the expected number of keys (those of single shingles, which are the least selective, count more), so
that the share COLD of a set's shingles is enough for H + 1. A set whose segments fall too unevenly for that is joined by its shingles instead.

*Hot shingles.* Shingles counted often by the tasks that read the corpus are put into segments of their own, walked
last; which ones these are decides the order only, never the result. They come as a bitmap of fixed size.

*Verification.* The sets of a key are compared with its centre first; after components are formed, only sets of one
key in different components are compared, those of keys with many sets by their differences from the centre. So a
group of near copies costs rows, not pairs. A pair is dropped if sketches of bucket counts prove too large a difference, else compared exactly from the texts.

Defined results: texts without words are linked with nothing; equal sets are one node; documents with equal ids and
different texts are different nodes with the same id; a null ``doc_id`` links but is never a component's name unless
it is alone (then the name is null); an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store, textscan
from .components import components_by_keys

_U = np.uint64
BITMAP_BITS = 1 << 24
#: A shingle is hot if tasks that each saw it at least LOCAL times saw it HOT times in all, or a power of two of that
#: many times, so that at most a sixteenth of the bitmap's bits are set.
LOCAL, HOT, FLUSH = 2, 16, 6_000_000
SKETCH = 192
#: Longs of a parity bitmap.
PARITY = 8
#: Tasks a core that count shingles.
COUNTERS = 2
#: Pairs of texts that are compared at once.
COMPARED = 256
#: The keys are shuffled in so many turns, each written before the next, so the shuffle takes that much less disk.
TURNS = 2
#: A task gives the keys of a set once while the set is among the last so many it met; later copies are merged after the shuffle.
SEEN = 100_000
#: Sets with this share of shingles that are not hot should never walk to the hot segments.
COLD = 0.45


def shingle_sets(words: textscan.Words, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted by row and hash."""
    rolled = textscan.roll(words.hash, size)
    whole = words.row[: len(rolled)] == words.row[size - 1 :][: len(rolled)] if len(rolled) else np.zeros(0, bool)
    edge = np.append(words.first[:-1], len(words.start)) if rows else np.zeros(1, np.int64)
    count = np.diff(edge)
    short = np.flatnonzero((count > 0) & (count < size))
    extra = [textscan.roll(words.hash[edge[i] : edge[i + 1]], int(count[i]))[0] for i in short]
    row = np.concatenate([words.row[: len(rolled)][whole], short])
    h = np.concatenate([rolled[whole], np.array(extra, np.uint64)])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def set_id(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever the order of its members; sets are h[edge[i]:edge[i + 1]]."""
    total = np.concatenate([[_U(0)], np.cumsum(textscan.mix(h ^ _U(0x51AB7E)))])
    return textscan.signed(textscan.mix(total[edge[1:]] - total[edge[:-1]] + np.diff(edge).astype(np.uint64)))


def first_met(nodes: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are the first of their node and not ``seen``, the nodes seen then)."""
    new = np.zeros(len(nodes), bool)
    new[np.unique(nodes, return_index=True)[1]] = True
    new &= ~np.isin(nodes, seen)
    return new, np.concatenate([seen, nodes[new]])[-SEEN:]


def sketches(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Counts of members by hash bucket, at most 255: their L1 distance is never above the sets' difference."""
    bucket = ((textscan.mix(h ^ _U(0x77C1)) >> _U(32)) * _U(SKETCH)) >> _U(32)
    return np.minimum(np.bincount(row * SKETCH + bucket.astype(np.int64), minlength=rows * SKETCH), 255).astype(np.uint8).reshape(rows, SKETCH)


def parities(h: np.ndarray) -> np.ndarray:
    """PARITY longs: whether an odd number of members fall into each bit. Of two sets they differ in no more bits than the sets in members."""
    bit = (textscan.mix(h ^ _U(0x0DD5)) % _U(64 * PARITY)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=64 * PARITY) & 1).astype(np.uint8)).view(np.int64)


@lru_cache
def allocate(band: int, percent: int) -> tuple[int, int]:
    """(segments, size from which v = 2) of a band: the cheapest choice that leaves the v well beyond H + 1."""
    top = (2 << band) - 1
    need = top * (100 - percent) / percent + 1
    best = (math.inf, max(64, 4 * top), 3)
    for mean in (0.25, 0.5, 0.75, 1, 1.25, 1.5, 1.75, 2, 2.25, 2.5, 2.75):
        segments = max(64, math.ceil(top / mean))
        load = top / segments
        p = [math.exp(-load) * load**i / math.factorial(i) for i in range(24)]
        for deep in (3, 4, 5, 6):
            units, keys = 1 - p[0] + sum(p[deep:]), 1 - p[0] + sum(i * x for i, x in enumerate(p) if i >= deep)
            cold = [math.exp(-load * COLD) * (load * COLD) ** i / math.factorial(i) for i in range(24)]
            double = sum(cold[deep:])
            spread = math.sqrt(segments * (cold[0] * (1 - (1 + load * COLD) * cold[0]) + double * (1 - double)))
            if (1 - cold[0] + double) * segments - 4 * spread < need:
                continue
            best = min(best, (need / units * (keys + p[1]), segments, deep))
    return best[1:]


def signatures(row: np.ndarray, h: np.ndarray, sizes: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, rows of the keys, rows that need the join by shingles)."""
    band = np.zeros(len(sizes), np.int64)
    band[sizes > 0] = np.floor(np.log2(sizes[sizes > 0])).astype(np.int64)
    hot_class = (hot[(h >> _U(3)).astype(np.int64) & (BITMAP_BITS // 8 - 1)] >> (h & _U(7)).astype(np.uint8)) & 1
    need = sizes * (100 - percent) // percent + 1
    keys, owners, failed = [], [], []
    for step in (0, 1):
        work = band + step
        chosen = (sizes > 0) & ((step == 0) | (100 * sizes >= percent * (1 << work)))
        if not chosen.any():
            continue
        plan = {int(b): allocate(int(b), percent) for b in np.unique(work[chosen])}
        segments, deep = np.ones(len(sizes), np.uint64), np.ones(len(sizes), np.int64)
        for b, (m, d) in plan.items():
            segments[chosen & (work == b)], deep[chosen & (work == b)] = m, d
        use = chosen[row]
        r, x, m = row[use], h[use], segments[row[use]]
        seed = textscan.mix(work[r].astype(np.uint64) + _U(0xB4D))
        place = ((textscan.mix(x ^ seed) >> _U(32)) * m) >> _U(32)
        place = (place + hot_class[use] * m).astype(np.int64)
        order = np.lexsort((place, r))
        r, x, place, seed = r[order], textscan.mix(x[order]), place[order], seed[order]
        start = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (place[1:] != place[:-1])]))
        owner, size = r[start], np.diff(np.append(start, len(r)))
        total = np.concatenate([[_U(0)], np.cumsum(x)])
        content = total[start + size] - total[start]
        v = 1 + (size >= deep[owner])
        walked = np.concatenate([[0], np.cumsum(v)])
        first = np.searchsorted(owner, np.arange(len(sizes)))
        taken = walked[:-1] - walked[first[owner]] < need[owner]
        after = np.searchsorted(owner, np.arange(len(sizes)), "right")
        failed.append(np.flatnonzero(chosen & (walked[after] - walked[first] < need)))

        def key(content, size, at):
            return textscan.mix(textscan.mix(content ^ seed[at]) + place[at].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + size.astype(np.uint64))

        keys.append(key(content[taken], size[taken], start[taken]))
        owners.append(owner[taken])
        near = np.flatnonzero(taken & (v == 2))
        if len(near):
            member = np.concatenate([np.arange(start[i], start[i] + size[i]) for i in near])
            whole = np.repeat(near, size[near])
            keys.append(key(content[whole] - x[member], size[whole] - 1, member))
            owners.append(owner[whole])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners), np.unique(np.concatenate(failed))


def sets_of(batches, size: int):
    """(piece, row, hash, borders of the rows) of pieces of batches with a column ``text``."""
    for batch in batches:
        for piece in textscan.pieces(batch, "text", textscan.PIECE_BYTES):
            words = textscan.scan(piece.column(piece.schema.get_field_index("text")), lower=True)
            row, h = shingle_sets(words, piece.num_rows, size)
            yield piece, row, h, np.searchsorted(row, np.arange(piece.num_rows + 1))


class NgramJoin:
    """One join: word shingles of ``size`` words, linked from ``percent`` per cent Jaccard similarity."""

    def __init__(self, docs: DataFrame, size: int = 5, percent: int = 75):
        if size < 1 or not 50 <= percent <= 100:
            raise ValueError("shingles have one word at least; the similarity is 50 to 100 per cent")
        doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
        #: key: by it a text is found again; documents may share one, so set ids are compared as well.
        self.docs = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("key"), F.xxhash64(text).alias("text_key"), text.alias("text"))
        self.size, self.percent = size, percent

    def profile(self) -> DataFrame:
        """doc_id, key, text_key, n_shingles, node (null without shingles), sketch."""
        size = self.size

        def run(batches):
            for piece, row, h, edge in sets_of(batches, size):
                n = np.diff(edge)
                counts = sketches(h, row, piece.num_rows)
                yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["key"], piece["text_key"], pa.array(n), pa.array(set_id(h, edge), mask=n == 0), pa.array([x.tobytes() for x in counts], pa.binary())], ["doc_id", "key", "text_key", "n_shingles", "node", "sketch"])

        return self.docs.mapInArrow(run, "doc_id long, key long, text_key long, n_shingles long, node long, sketch binary")

    def hot_bitmap(self) -> np.ndarray:
        """The bitmap of hot shingles: fixed in size, whatever the corpus."""
        size = self.size

        def run(batches):
            held, count = [], 0

            def flush():
                h, n = np.unique(np.concatenate(held), return_counts=True)
                some = n >= LOCAL
                return pa.RecordBatch.from_arrays([pa.array(textscan.signed(h[some])), pa.array(n[some])], ["h", "n"])

            for _, _, h, _ in sets_of(batches, size):
                held.append(h)
                count += len(h)
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
            if held:
                yield flush()

        # few tasks that see much each: a small task would see a common shingle once and not count it
        docs = self.docs.coalesce(COUNTERS * self.docs.sparkSession.sparkContext.defaultParallelism)
        counted = docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
        counted = store.keep(counted, "ngram-counts")
        steps = counted.groupBy(F.floor(F.log2(F.col("n") / HOT)).alias("step")).count().toPandas()  # at most 60 rows
        least = min([x for x in range(61) if steps["count"][steps["step"] >= x].sum() <= BITMAP_BITS // 16], default=60)
        counted = counted.where(F.col("n") >= HOT << least)
        low = counted.select((F.col("h").bitwiseAND(BITMAP_BITS - 1)).cast("int").alias("low"))
        bits = low.groupBy(F.expr("shiftright(low, 5)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, low & 31))").alias("bits"))
        out = np.zeros(BITMAP_BITS // 32, np.uint32)
        found = bits.toPandas()  # at most BITMAP_BITS / 32 rows
        out[found["at"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
        return out.view(np.uint8)

    def index(self) -> tuple[DataFrame, DataFrame]:
        """(k, node, n: nodes of the key) of the keys that several nodes have; (node) of the sets that need the join by shingles.

        A key belongs to one turn by its value, so the turns cost reading the texts again, never a key. Copies of a set
        within a task give its keys once, so a text with many copies sends each key as often as there are tasks, not copies.
        """
        size, percent = self.size, self.percent
        shared = self.docs.sparkSession.sparkContext.broadcast(self.hot_bitmap())

        def keys_of(turn: int):
            def run(batches):
                seen = np.zeros(0, np.int64)
                for _, row, h, edge in sets_of(batches, size):
                    nodes = set_id(h, edge)
                    new, seen = first_met(nodes, seen)
                    keys, owner, failed = signatures(row[new[row]], h[new[row]], np.where(new, np.diff(edge), 0), shared.value, percent)
                    mine = keys % np.uint64(TURNS) == turn
                    keys, owner, failed = keys[mine], owner[mine], failed if turn == 0 else failed[:0]
                    yield pa.RecordBatch.from_arrays([pa.array(textscan.signed(np.concatenate([keys, np.zeros(len(failed), np.uint64)]))), pa.array(nodes[np.concatenate([owner, failed])]), pa.array(np.arange(len(keys) + len(failed)) >= len(keys))], ["k", "node", "failed"])

            return run

        tables = []
        for turn in range(TURNS):
            rows = self.docs.select("text").mapInArrow(keys_of(turn), "k long, node long, failed boolean")
            same = Window.partitionBy("k")
            live = rows.select("*", (F.min("node").over(same) != F.max("node").over(same)).alias("live")).where("live or failed")
            kept = live.groupBy("k", "node", "failed").agg(F.lit(1).alias("one")).select("k", "node", "failed", F.count("*").over(same).alias("n"))
            tables.append(store.keep(kept, "ngram-keys"))
        kept = reduce(DataFrame.union, tables)
        return kept.where("not failed").select("k", "node", "n"), kept.where("failed").select("node").distinct()

    def shingle_pairs(self, nodes: DataFrame) -> DataFrame:
        """a, b: pairs of one of ``nodes`` with any set that shares a shingle; for the few sets that fail to allocate."""
        size = self.size

        def run(batches):
            for _, row, h, edge in sets_of(batches, size):
                yield pa.RecordBatch.from_arrays([pa.array(textscan.signed(h)), pa.array(set_id(h, edge)[row])], ["h", "node"])

        rows = self.docs.select("text").mapInArrow(run, "h long, node long")
        wanted = rows.join(nodes, "node", "left_semi").distinct().withColumnRenamed("node", "a")
        return rows.withColumnRenamed("node", "b").join(wanted, "h").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def texts(self, nodes: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(node, text of ``nodes``; a table to discard later)."""
        found = store.keep(sets.join(nodes, "node", "left_semi").select("node", "key", "text_key"), "ngram-nodes")
        own = store.only(self.docs.select("key", "text_key", "text"), found.select("key", "text_key"), "key", "text_key")
        return own.join(found, ["key", "text_key"]).dropDuplicates(["key", "text_key"]).select("node", "text"), found

    def members(self, nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """node, members (the sorted hashes of its set, as bytes) of ``nodes``, from the texts."""
        size = self.size
        texts, found = self.texts(nodes, sets)

        def run(batches):
            for piece, _, h, edge in sets_of(batches, size):
                parts = [h[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([piece["node"], pa.array(parts, pa.binary())], ["node", "members"])

        out = store.keep(texts.mapInArrow(run, "node long, members binary"), "ngram-members")
        store.discard(found)
        return out

    def wide_pairs(self, open_nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """a, b: candidates among nodes of different labels that share a centre (node, label, centre).

        The differences of two sets from their centre differ as the sets do. Sets that link and differ from the centre
        by more than H in all have a difference in common; those that don't are both linked to the centre. So the
        differences are joined by prefixes, what a set has beyond the centre before what it lacks: H / 2 + 1 of the
        smaller difference, H + 1 of the larger. Differences from one centre have the parities of the pair's own difference
        between them, so a pair whose parities prove it too large is never put out.
        """
        percent = self.percent
        members = self.members(open_nodes.select("node").union(open_nodes.select("centre")).distinct(), sets)

        def run(batches):
            for batch in batches:
                keys, rows, place, sizes, odd = [], [], [], [], []
                for i, (own, centre, name) in enumerate(zip(batch["x"], batch["y"], batch["centre"].to_pylist(), strict=True)):
                    own, centre = (np.frombuffer(s.as_buffer(), np.uint64) for s in (own, centre))
                    more, less = np.setdiff1d(own, centre, assume_unique=True), np.setdiff1d(centre, own, assume_unique=True)
                    change = np.concatenate([more, less])
                    most = len(own) * (100 - percent) // percent
                    keys.append(textscan.mix(change[: most + 1] ^ textscan.mix(np.array([name], np.int64).view(np.uint64))))
                    rows.append(np.full(len(keys[-1]), i))
                    place.append(np.arange(len(keys[-1])))
                    sizes.append((len(more), len(less), len(own), most))
                    odd.append(parities(change))
                if not rows:
                    continue
                at, place = np.concatenate(rows), np.concatenate(place)
                more, less, n, most = np.array(sizes, np.int64)[at].T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(textscan.signed(np.concatenate(keys))), batch["node"].take(pa.array(at)), batch["label"].take(pa.array(at)), pa.array(more), pa.array(less), pa.array(n), pa.array(more + less - place), pa.array(place <= most // 2), *map(pa.array, np.array(odd)[at].T)],
                    ["k", "node", "label", "more", "less", "n", "left", "short", *(f"p{i}" for i in range(PARITY))],
                )

        side = lambda node, column: members.select(F.col("node").alias(node), F.col("members").alias(column))
        rows = open_nodes.join(side("node", "x"), "node").join(side("centre", "y"), "centre").select("node", "label", "centre", "x", "y")
        rows = store.keep(rows.mapInArrow(run, "k long, node long, label long, more long, less long, n long, left long, short boolean" + "".join(f", p{i} long" for i in range(PARITY))), "ngram-changes")
        d = "({0}.more + {0}.less)".format
        most = f"{100 - percent} * (x.n + y.n) div {100 + percent}"
        holds = [
            "x.k = y.k",
            "x.label <> y.label",
            f"x.short and ({d('x')} < {d('y')} or {d('x')} = {d('y')} and x.node < y.node)",
            f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)",
            f"abs(x.more - y.more) + abs(x.less - y.less) <= {most}",
            " + ".join(f"bit_count(x.p{i} ^ y.p{i})" for i in range(PARITY)) + f" <= {most}",
            # of their first common change on, the pair must have as many as it needs in all
            f"2 * least(x.left, y.left) >= {d('x')} + {d('y')} - {most}",
        ]
        pairs = rows.alias("x").join(rows.alias("y"), F.expr(" and ".join(f"({h})" for h in holds)))
        return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """a, b: the pairs (a, b) of nodes whose sets link. sets: node, key, text_key, n_shingles, sketch."""
        percent = self.percent

        def near(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in ("sketch_a", "sketch_b"))
                n = batch["n_a"].to_numpy() + batch["n_b"].to_numpy()
                # 100 (n - d) / 2 >= percent (n + d) / 2 bounds the difference d
                good = (100 + percent) * np.abs(x - y).sum(axis=1, dtype=np.int64) <= (100 - percent) * n
                yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(good)), batch["b"].filter(pa.array(good))], ["a", "b"])

        size = lambda x: sets.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"))
        side = lambda x: sets.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"))
        fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
        fit = pairs.join(size("a"), "a").join(size("b"), "b").where(fits)
        close = store.keep(fit.join(side("a"), "a").join(side("b"), "b").mapInArrow(near, "a long, b long"), "ngram-close")
        # texts, not sets, are kept and sent: as hashes a set takes some three times its compressed text
        texts, found = self.texts(close.select(F.col("a").alias("node")).union(close.select("b")).distinct(), sets)
        texts, shingles = store.keep(texts, "ngram-texts"), self.size

        def exact(batches):
            for whole in batches:
                for batch in (whole.slice(i, COMPARED) for i in range(0, whole.num_rows, COMPARED)):
                    both = [pa.RecordBatch.from_arrays([batch[c]], ["text"]) for c in ("x", "y")]
                    own, other = ([h[i:j] for _, _, h, edge in sets_of([side], shingles) for i, j in itertools.pairwise(edge)] for side in both)
                    good = []
                    for x, y in zip(own, other, strict=True):
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        good.append(100 * common >= percent * (len(x) + len(y) - common))
                    yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(good, pa.bool_())), batch["b"].filter(pa.array(good, pa.bool_()))], ["a", "b"])

        sides = close.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        out = store.keep(sides.mapInArrow(exact, "a long, b long"), "ngram-links")
        store.discard(close, found, texts)
        return out

    def components(self, profile: DataFrame) -> DataFrame:
        """node, label: the components of linked nodes; nodes without links are left out."""
        nodes = profile.where(F.col("node").isNotNull()).groupBy("node").agg(F.min_by(F.struct("key", "text_key", "n_shingles", "sketch"), F.struct("key", "text_key")).alias("own"))
        sets = store.keep(nodes.select("node", "own.*"), "ngram-sets")
        keys, failed = self.index()
        also = self.shingle_pairs(failed) if failed.limit(1).count() else None
        return components_by_keys(keys, lambda pairs: self.verify(pairs, sets), also, lambda nodes: self.wide_pairs(nodes, sets))


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    job = NgramJoin(docs, size, percent)
    profile = store.keep(job.profile(), "ngram-profile")
    labels = job.components(profile)
    whole = F.coalesce("label", "node")
    named = profile.select("doc_id", "n_shingles", "node").join(labels, "node", "left").withColumn("part", whole)
    # Only parts of several rows need a name; all others are named by their own row.
    several = named.where(F.col("part").isNotNull()).groupBy("part").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    names = store.keep(several, "ngram-names")
    return named.join(names, "part", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id (and text hash); all columns stay.

    Rows without words stay. A document without an id stands for its component only if no other has one; of rows equal
    in id and text one stays.
    """
    job = NgramJoin(docs, size, percent)
    profile = store.keep(job.profile(), "ngram-profile")
    labels = job.components(profile)
    named = profile.where("node is not null").select("doc_id", "key", "text_key", "node").join(labels, "node", "left").withColumn("part", F.coalesce("label", "node"))
    own = F.min(F.struct(F.col("doc_id").isNull(), F.col("key").alias("own_key"), F.col("text_key").alias("own_text"))).alias("own")
    groups = store.keep(named.groupBy("part").agg(own, F.count("*").alias("rows")).where("rows > 1").select("part", "own.own_key", "own.own_text"), "ngram-groups")
    ids = [F.col("key").alias("own_key"), F.col("text_key").alias("own_text")]
    dropped = store.keep(named.join(groups, "part").where("key <> own_key or text_key <> own_text").select("key", "text_key").distinct().select(*ids), "ngram-dropped")
    twice = store.keep(named.groupBy("key", "text_key").agg(F.count("*").alias("rows")).where("rows > 1").select(*ids), "ngram-twice")
    # the caller's columns are packed, so that no name of theirs meets one of these
    text = F.xxhash64(F.col("row.text").cast("string"))
    left = docs.select(F.struct(*docs.columns).alias("row")).withColumn("own_key", F.coalesce(F.col("row.doc_id").cast("long"), text)).withColumn("own_text", text)
    left = store.without(left, dropped, "own_key", "own_text")
    if twice.limit(1).count():
        left = store.without(left, twice, "own_key", "own_text").unionByName(store.only(left, twice, "own_key", "own_text").dropDuplicates(["own_key", "own_text"]))
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


#: The rows of ``ngram_components(documents, 5, 75)``: distinct sets are nodes, shingles in common are counted by a join, links are followed.
ORACLE = r"""
WITH RECURSIVE dw AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS gram FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
ds AS (SELECT rid, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS own FROM sh GROUP BY rid),
nd AS (SELECT own, min(rid) AS node, max(n) AS n FROM ds GROUP BY own),
ns AS (SELECT node, n, gram FROM nd JOIN sh ON rid = node),
lk AS (SELECT x.node AS a, y.node AS b FROM ns x JOIN ns y ON x.gram = y.gram AND x.node < y.node AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)
  GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT node, node FROM nd UNION SELECT r.a, e.b FROM reach r JOIN (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk) e ON e.a = r.b),
part AS (SELECT a AS node, min(b) AS part FROM reach GROUP BY a),
named AS (SELECT rid, part FROM ds JOIN nd USING (own) JOIN part USING (node)),
least_id AS (SELECT part, min(doc_id) AS component_id FROM named JOIN dw USING (rid) GROUP BY part)
SELECT doc_id, CAST(coalesce(ds.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM dw LEFT JOIN ds USING (rid) LEFT JOIN named USING (rid) LEFT JOIN least_id USING (part)
"""
