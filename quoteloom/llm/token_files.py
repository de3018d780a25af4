"""Operator 8, token-ID output: flat unsigned-integer files with 64-bit document offsets.

Documents are range-partitioned by ``doc_id``; each partition encodes its texts and writes

* ``part-NNNNN.bin``: the ids of its documents, little-endian, 16 bits each if the vocabulary allows, else 32;
* ``part-NNNNN.idx``: the magic ``QLTOKID2``, bytes per id, document count, how many of the first documents have no
  id (all 64-bit), then count + 1 offsets in ids, then the document ids, all 64-bit.

A manifest has one row per partition; the prefix sum of its token counts is the base of each file, so a
global position needs no pass over the ids. Files are read back memory-mapped.

Defined results: a null or empty text has only the end id; documents with equal ``doc_id`` are kept, in the
order of their texts; a null ``doc_id`` sorts first; no documents, no files and an empty result; very long texts are encoded whole, by one task. Other columns of the input are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store, textscan

MAGIC = b"QLTOKID2"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_ASCII_OTHER = np.zeros(256, bool)
_ASCII_OTHER[:128] = ~_LETTER[:128] & ~textscan.WHITE[:128]
_APOSTROPHE = 0x27


class RunEncoder:
    """Encodes batches of texts with a word-end BPE vocabulary of the tokenizers library.

    The vocabulary drops white space and never joins an ASCII letter with another ASCII character (but for an
    apostrophe before letters), so a text's ids are those of its runs between such borders, in order. Each
    distinct run of a batch is encoded once by the library and its ids are gathered for every occurrence. Texts
    that could hold a special token are encoded whole.
    """

    MEMO_RUNS = 1_500_000

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(names.values()) + 1
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self._forget()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of the runs; letters are joined by spaces and split again where a word ends."""
        counts, found = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)] * len(texts)
        is_word = [x.isalpha() for x in texts]
        letters = [i for i, x in enumerate(is_word) if x]
        rest = [i for i, x in enumerate(is_word) if not x]
        for k in range(0, len(letters), 2000):
            some = letters[k : k + 2000]
            ids = self.whole([" ".join(texts[i] for i in some)])[0]
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some) or (len(ids) and ends[-1] != len(ids)):
                rest += some
                continue
            last = ends.tolist()
            for i, a, b in zip(some, [0, *last[:-1]], last, strict=True):
                found[i] = ids[a:b]
        for k in range(0, len(rest), 2000):
            for i, ids in zip(rest[k : k + 2000], self.whole([texts[i] for i in rest[k : k + 2000]]), strict=True):
                found[i] = ids
        counts[:] = [len(x) for x in found]
        return counts, np.concatenate(found) if found else np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Adds runs to the memo."""
        counts, ids = self._runs(texts)
        start = len(self.ids) + np.cumsum(counts) - counts
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.start, self.count = (np.concatenate(x)[order] for x in ((self.keys, keys), (self.start, start), (self.count, counts)))
        self.ids = np.concatenate([self.ids, ids])

    def _forget(self) -> None:
        self.keys, self.start, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts of ``column``."""
        data, offsets = textscan.raw(column)
        inside = ~textscan.WHITE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[0] = cut[-1] = True
        letter, other = _LETTER[data], _ASCII_OTHER[data]
        if len(data):
            cut[1:-1] = (inside[1:] != inside[:-1]) | (letter[:-1] & other[1:]) | (other[:-1] & letter[1:] & (data[:-1] != _APOSTROPHE))
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        start, end = edges[:-1], edges[1:]
        real = inside[start] if len(data) else np.zeros(0, bool)
        start, end = start[real], end[real]
        keys = textscan.hash_spans(textscan.LOWER[data], start, end)
        if (high := np.flatnonzero(data >= 128)).size:  # only in pure ASCII runs capitals don't matter
            exact = np.unique(np.searchsorted(start, high, "right") - 1)
            keys[exact] = textscan.hash_spans(data, start[exact], end[exact])
        row = np.searchsorted(offsets, start, "right") - 1
        whole = np.array([b"<|" in data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], bool) if b"<|" in data.tobytes() else np.zeros(len(column), bool)
        if whole.any():
            use = ~whole[row]
            start, end, keys, row = start[use], end[use], keys[use], row[use]
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, distinct)
        known = slot < len(self.keys)
        known[known] = self.keys[slot[known]] == distinct[known]
        if not known.all():
            if len(self.keys) + (~known).sum() > self.MEMO_RUNS:
                known[:] = False  # a full memo starts anew
                self._forget()
            new = first[~known]
            self._learn(distinct[~known], [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[new], end[new], strict=True)])
            slot = np.searchsorted(self.keys, distinct)
        counts = self.count[slot][inverse] if len(keys) else np.zeros(0, np.int64)
        ids = self.ids[spread(self.start[slot][inverse], counts)] if len(keys) else np.zeros(0, np.uint32)
        per_row = np.bincount(row, counts, len(column)).astype(np.int64)
        if not whole.any():
            return ids, np.concatenate([[0], np.cumsum(per_row)])
        parts = np.split(ids, np.cumsum(per_row)[:-1])
        texts = column.to_pylist()
        for k in np.flatnonzero(whole):
            parts[k] = self.whole([texts[k]])[0]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + count, count)


_encoders: dict[str, RunEncoder] = {}


def encoder(vocabulary: str) -> RunEncoder:
    """The encoder of this worker process."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = RunEncoder(vocabulary)
    return _encoders[vocabulary]


def index_bytes(width: int, offsets: np.ndarray, doc_ids: np.ndarray, nulls: int = 0) -> bytes:
    return MAGIC + struct.pack("<QQQ", width, len(doc_ids), nulls) + offsets.astype("<u8").tobytes() + doc_ids.astype("<i8").tobytes()


def read_index(buffer) -> tuple[int, np.ndarray, np.ndarray, int]:
    """(bytes per id, offsets, document ids, how many of the first documents have none) of an index file; raises ``ValueError`` on a damaged one."""
    view = memoryview(buffer)
    if len(view) < 32 or bytes(view[:8]) != MAGIC:
        raise ValueError("not a token index")
    width, n, nulls = struct.unpack("<QQQ", view[8:32])
    if width not in (2, 4) or nulls > n or len(view) != 32 + 8 * (2 * n + 1):
        raise ValueError("a token index of the wrong length")
    numbers = np.frombuffer(view[32:], "<u8")
    offsets = numbers[: n + 1].astype(np.int64)
    if offsets[0] != 0 or (np.diff(offsets) < 0).any():
        raise ValueError("offsets that go back")
    return width, offsets, numbers[n + 1 :].view("<i8"), nulls


def _writer(folder: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        bpe = encoder(vocabulary)
        width = 2 if max(bpe.size, end_id + 1) <= 1 << 16 else 4
        docs, lengths, nulls = [], [], []

        def chunks():
            for batch in batches:
                for piece in textscan.pieces(batch, "text", 8 * textscan.PIECE_BYTES):
                    ids, at = bpe.encode(piece.column(1))
                    n = np.diff(at)
                    out = np.full(len(ids) + len(n), end_id, f"<u{width}")
                    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                    docs.append(piece.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                    nulls.append(piece.column(0).null_count)  # these come first in a partition
                    lengths.append(n + 1)
                    yield out.tobytes()

        path = f"{folder}/part-{part:05d}"
        store.write_bytes(path + ".bin", chunks())
        if not docs:
            return
        n = np.concatenate(lengths)
        store.write_bytes(path + ".idx", [index_bytes(width, np.concatenate([[0], np.cumsum(n)]), np.concatenate(docs), sum(nulls))])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Encodes ``docs`` (doc_id, text), writes the files and returns their manifest with each file's base."""
    folder = store.fresh_path(docs.sparkSession, "tokens")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = store.keep(ordered.mapInArrow(_writer(folder, vocabulary, end_id), "part int, path string, n_docs long, n_tokens long"), "token-manifest")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    return manifest.withColumn("base", F.coalesce(before, F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc of each document's ids, from the files of a manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                width, offsets, doc_ids, nulls = read_index(store.read_bytes(path + ".idx"))
                ids = np.frombuffer(store.read_bytes(path + ".bin"), f"<u{width}")
                if len(ids) != offsets[-1]:
                    raise ValueError(f"{path}: {len(ids)} ids, the index says {offsets[-1]}")
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=np.arange(len(doc_ids)) < nulls), pa.array(base + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # a given number of partitions is not coalesced, however small the manifest is
    spread_out = manifest.select("path", "base").repartition(max(1, manifest.count()), "path")
    return spread_out.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_path(path: str | None = None, name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file: ``path`` if given, else the public one of that name."""
    if path:
        return str(Path(path))
    import public_tokenizers

    return public_tokenizers.path(name)
