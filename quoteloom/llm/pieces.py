"""Operator 5, SentencePiece encoding and decoding: N-best segmentations and exact decoding.

A text is a space (the model's dummy prefix) and its characters; the piece lattice has an edge for every piece of
the model at every place, and for a character without a piece its bytes, at a score below every piece's. The score of
a segmentation is the sum of its pieces' scores.

No piece holds two neighbouring characters that are neighbours in no piece, so the lattice falls apart there, into
runs. For each distinct run, a forward Viterbi pass gives the best score of every prefix; it is the exact estimate of
what remains for an A* search from the end backwards, which takes complete segmentations from its queue best first.
Runs are independent, so a text's N best are its best one with the cheapest combinations of changes in the N - 1 runs
whose second best costs least. Runs are looked up by a 64-bit hash in a memo of each worker, bounded in size.

Decoding joins the pieces' bytes and drops the prefix. It gives back every text, but for U+2581, the model's own sign
for a space, which becomes one.

Defined results: null and empty texts have no pieces, one segmentation of score 0, and decode to an empty text; among
equal scores the search's order decides, the same in every run; a text with fewer segmentations than N has those. Rows
with equal ids stay apart; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan
from .token_files import spread, vocabulary_path

SPACE = "▁"
BELOW = 10.0


class Lattice:
    """A model's pieces, with spaces for its own sign."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i).replace(SPACE, " "): (i, model.get_score(i)) for i in own}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in self.byte_ids):
            self.byte_ids = [model.unk_id()] * 256
        ordinary = [s for _, s in self.pieces.values() if s > -1e8]  # some models give placeholders such a score
        self.unknown = min(ordinary) - BELOW
        self.longest = max(map(len, self.pieces))
        self.bytes_of = [b""] * model.get_piece_size()
        for piece, (i, _) in self.pieces.items():
            self.bytes_of[i] = piece.encode()
        for b, i in enumerate(self.byte_ids):
            if model.is_byte(i):
                self.bytes_of[i] = bytes([b])
        chars = sorted({c for p in self.pieces for c in p})
        self.class_of = np.zeros(0x110000, np.uint16)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.pieces:
            for a, b in itertools.pairwise(p):
                self.joined[self.class_of[ord(a)], self.class_of[ord(b)]] = True

    def edges(self, run: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For every end of an edge: (start, ids, score) of the edges there."""
        out, get, longest = [[]], self.pieces.get, self.longest
        for end in range(1, len(run) + 1):
            here = []
            for start in range(max(0, end - longest), end):
                if (found := get(run[start:end])) is not None:
                    here.append((start, (found[0],), found[1]))
            if not here or here[-1][0] != end - 1:
                here.append((end - 1, tuple(self.byte_ids[b] for b in run[end - 1].encode("utf-8", "surrogatepass")), self.unknown))
            out.append(here)
        return out

    def best(self, run: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """(score, ids) of the n best segmentations of a run, best first."""
        edges = self.edges(run)
        forward = [0.0]
        for here in edges[1:]:
            forward.append(max([forward[start] + score for start, _, score in here]))
        # cost so far plus the exact rest; then the place, so that among equal costs the search goes on towards the start
        queue, order, out = [(-forward[-1], len(run), 0, 0.0, None)], itertools.count(1), []
        while queue and len(out) < n:
            _, at, _, behind, path = heapq.heappop(queue)
            if at == 0:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((behind, tuple(ids)))
                continue
            for start, ids, score in edges[at]:
                heapq.heappush(queue, (-(forward[start] + score + behind), start, next(order), behind + score, (ids, path)))
        return out


def least_sums(options: list[list[tuple]], n: int) -> list[tuple]:
    """The ``n`` choices of one of each list with the least sums of first fields, best first; each list is ascending.

    A heap holds the choices next to those taken: one list is moved on by one, so at most n times as many as lists are ever made.
    """
    cost = lambda at: sum(x[i][0] for x, i in zip(options, at, strict=True))
    start = (0,) * len(options)
    heap, met, out = [(cost(start), start)], {start}, []
    while heap and len(out) < n:
        _, at = heapq.heappop(heap)
        out.append(tuple(x[i] for x, i in zip(options, at, strict=True)))
        for j in range(len(at)):
            after = (*at[:j], at[j] + 1, *at[j + 1 :])
            if after[j] < len(options[j]) and after not in met:
                met.add(after)
                heapq.heappush(heap, (cost(after), after))
    return out


class PieceEncoder:
    """Encodes batches; best segmentations of runs are kept in a memo of bounded size."""

    MEMO_RUNS = 1_000_000

    def __init__(self, path: str, n: int):
        self.lattice, self.n = Lattice(path), n
        self.changes = lru_cache(100_000)(lambda run: self.lattice.best(run, n))
        lengths = np.array([len(b) for b in self.lattice.bytes_of])
        self.piece_bytes = np.frombuffer(b"".join(self.lattice.bytes_of), np.uint8)
        self.piece_at, self.piece_len = np.cumsum(lengths) - lengths, lengths
        self._forget()

    def _forget(self) -> None:
        self.keys, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.scores, self.ids = np.zeros((0, self.n)), np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, runs: list[str]) -> None:
        scores, counts, ids = np.full((len(runs), self.n), -np.inf), np.zeros(len(runs), np.int64), []
        for i, run in enumerate(runs):
            found = self.lattice.best(run, self.n)
            scores[i, : len(found)] = [s for s, _ in found]
            counts[i] = len(found[0][1])
            ids.append(found[0][1])
        start = len(self.ids) + np.cumsum(counts) - counts
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.start, self.count, self.scores = (np.concatenate(x)[order] for x in ((self.keys, keys), (self.start, start), (self.count, counts), (self.scores, scores)))
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), np.int32)])

    def encode(self, column: pa.Array) -> list[tuple[np.ndarray, list[tuple[float, np.ndarray]]]]:
        """For every text (best ids, [(score, ids) of the n best])."""
        texts = [" " + t.replace(SPACE, " ") if t else "" for t in column.to_pylist()]
        whole = "".join(texts)
        if not whole:
            return [(np.zeros(0, np.int32), [(0.0, np.zeros(0, np.int32))]) for _ in texts]
        data = np.frombuffer(whole.encode("utf-8"), np.uint8)
        chars = self.lattice.class_of[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        row_at = np.cumsum([0] + [len(t) for t in texts])
        cut = np.ones(len(chars) + 1, bool)
        cut[1:-1] = ~self.lattice.joined[chars[:-1], chars[1:]]
        cut[row_at] = True
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        at = np.flatnonzero(cut)
        row = np.searchsorted(row_at, at[:-1], "right") - 1
        edge = place[at]
        start, end = edge[:-1], edge[1:]
        keys = textscan.hash_spans(data, start, end)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        text_of = lambda i: data[start[i] : end[i]].tobytes().decode("utf-8")
        slot = np.searchsorted(self.keys, distinct)
        known = slot < len(self.keys)
        known[known] = self.keys[slot[known]] == distinct[known]
        if not known.all():
            if len(self.keys) + (~known).sum() > self.MEMO_RUNS:
                known[:] = False  # a full memo starts anew
                self._forget()
            self._learn(distinct[~known], [text_of(i) for i in first[~known]])
            slot = np.searchsorted(self.keys, distinct)
        slot = slot[inverse]
        counts, scores = self.count[slot], self.scores[slot]
        ids = self.ids[spread(self.start[slot], counts)]
        ids_at = np.concatenate([[0], np.cumsum(counts)])
        run_at = np.searchsorted(row, np.arange(len(texts) + 1))
        best = np.concatenate([[0], np.cumsum(scores[:, 0])])
        gap = scores[:, 0] - scores[:, 1] if self.n > 1 else np.full(len(slot), np.inf)
        by_gap = np.lexsort((gap, row))
        out = []
        for a, b in itertools.pairwise(run_at.tolist()):
            own = ids[ids_at[a] : ids_at[b]]
            top = float(scores[a:b, 0].sum()) if b - a < 1 << 16 else float(best[b] - best[a])
            some = [int(r) for r in by_gap[a : min(b, a + self.n - 1)] if np.isfinite(gap[r])]
            options = [[(float(scores[r, 0] - scores[r, k]), r, k) for k in range(self.n) if np.isfinite(scores[r, k])] for r in some]
            combined = least_sums(options, self.n)
            found = []
            for change in combined:
                parts, done = [], a
                for _, r, k in sorted((x for x in change if x[2]), key=lambda x: x[1]):
                    parts += [ids[ids_at[done] : ids_at[r]], np.array(self.changes(text_of(r))[k][1], np.int32)]
                    done = r + 1
                parts.append(ids[ids_at[done] : ids_at[b]])
                found.append((top - sum(x[0] for x in change), np.concatenate(parts)))
            out.append((own, found))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of a text from its ids."""
        if not len(ids):
            return b""
        return self.piece_bytes[spread(self.piece_at[ids], self.piece_len[ids])].tobytes()[1:]


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, n: int) -> PieceEncoder:
    """The encoder of this worker process."""
    if (path, n) not in _encoders:
        _encoders[path, n] = PieceEncoder(path, n)
    return _encoders[path, n]


def model_path(path: str | None = None) -> str:
    return vocabulary_path(path, "piece_bpe_32k.model")


def encode_texts(docs: DataFrame, model: str, n: int = 1) -> DataFrame:
    """doc_id, ids (of the best segmentation), scores and alternatives (arrays of ids) of the n best."""

    def run(batches):
        for batch in batches:
            for piece in textscan.pieces(batch, "text"):
                found = encoder(model, n).encode(piece["text"])
                yield pa.RecordBatch.from_arrays(
                    [piece["doc_id"], pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([[s for s, _ in y] for _, y in found], pa.list_(pa.float64())), pa.array([[i.tolist() for _, i in y] for _, y in found], pa.list_(pa.list_(pa.int32())))],
                    ["doc_id", "ids", "scores", "alternatives"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>, scores array<double>, alternatives array<array<int>>")


def decode_texts(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def run(batches):
        for batch in batches:
            e = encoder(model, 1)
            texts = [None if x is None else e.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, model: str, n: int = 3) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), scores and crcs of the n best, round_trip."""
    crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())

    def run(batches):
        for batch in batches:
            for piece in textscan.pieces(batch, "text"):
                e = encoder(model, n)
                found = e.encode(piece["text"])
                data, at = textscan.raw(piece["text"])
                same = [e.decode(ids).decode("utf-8", "replace") == data[a:b].tobytes().decode("utf-8").replace(SPACE, " ") for (ids, _), a, b in zip(found, at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece["doc_id"], pa.array([len(x) for x, _ in found], pa.int64()), pa.array([crc(x) for x, _ in found], pa.int64()),
                        pa.array([[s for s, _ in y] for _, y in found], pa.list_(pa.float64())), pa.array([[crc(i) for _, i in y] for _, y in found], pa.list_(pa.int64())), pa.array(same),
                    ],
                    ["doc_id", "n_pieces", "ids_crc32", "nbest_scores", "nbest_crc32", "round_trip"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, nbest_scores array<double>, nbest_crc32 array<long>, round_trip boolean")
