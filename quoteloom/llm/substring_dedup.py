"""Operator 10, substring dedup: repeated word sequences found by fixed-block anchors and cut out.

A window is ``n`` consecutive words of one document; it is repeated if the same words start anywhere else.

1. *Profile.* Every document's word count and the hash of its whole word sequence. Equal sequences are one text
   from here on; a text with copies and at least ``n`` words is repeated as a whole.
2. *Anchors.* The index has the non-overlapping blocks of ``block`` words that start at multiples of ``block``; the
   probes are the rolling windows of ``block`` words at every start. Whatever the offset, a repeated window holds a
   whole group of consecutive blocks of each copy, and at the other copy the same blocks at the same distances. So
   of each group, on both sides, only the block with the smallest hash is sent. An anchor hits if the index has it
   and it occurs at two places.
3. *Extension.* Windows that hold a hit are candidates; those whose whole word sequence occurs twice among the
   candidates are repeated. Both copies of a repeated window hold the same anchor, so both are candidates and
   nothing is lost. The union of repeated windows is the union of the maximal repeats of ``n`` words or more. Sequences
   are compared by 128-bit BLAKE2 digests of the words themselves, so a chance hit of anchors removes nothing.

No pairs are ever formed: each step counts rows of a hash, so a passage of N copies costs N rows. A hash that a batch
has often enough to prove itself (two places, one of them indexed) sends its proof only; its other rows are known to be
hits and are shuffled under keys of their own, so a frequent passage is no hot key. Hashes of anchors and of whole
texts have 64 bits; anchors are verified, equal texts are not.

Defined results: null and empty texts have no words; rows that repeat a document are copies of it; documents may
share a ``doc_id``; an empty table gives an empty result. Very long texts are read whole, by one task. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store, textscan

BLOCK = 5


def text_hash(words: np.ndarray) -> int:
    """Hash of a whole word sequence, as a signed 64-bit integer."""
    up, _ = textscan.powers(textscan._WORD_BASE, len(words))
    total = np.array([(words * up[: len(words)]).sum() + np.uint64(len(words))], np.uint64)
    return int(textscan.signed(textscan.mix(total))[0])


def kept_sha256(words: textscan.Words, first: int, past: int, keep: np.ndarray | None) -> str:
    """SHA-256 of the kept words of one row, joined by single spaces."""
    spans = zip(words.start[first:past].tolist(), words.end[first:past].tolist(), strict=True)
    data = words.data.tobytes() if past > first else b""
    parts = [data[a:b] for (a, b), k in zip(spans, [True] * (past - first) if keep is None else keep.tolist(), strict=True) if k]
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _per_row(batches: Iterator[pa.RecordBatch], limit: int = textscan.PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, textscan.Words, np.ndarray]]:
    """Pieces of batches (text in column ``text``), their words, and the borders of rows among the words."""
    for batch in batches:
        for piece in textscan.pieces(batch, "text", limit):
            words = textscan.scan(piece.column(piece.schema.get_field_index("text")))
            yield piece, words, np.append(words.first[:-1], len(words.start)) if len(words.first) else words.first


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, key, text_hash, n_words, all_sha256 (of all words)."""

    def run(batches):
        for piece, words, edge in _per_row(batches):
            spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [piece["doc_id"], piece["key"], pa.array([text_hash(words.hash[a:b]) for a, b in spans], pa.int64()), pa.array(np.diff(edge)), pa.array([kept_sha256(words, a, b, None) for a, b in spans])],
                ["doc_id", "key", "text_hash", "n_words", "all_sha256"],
            )

    return docs.mapInArrow(run, "doc_id long, key long, text_hash long, n_words long, all_sha256 string")


def selected_blocks(words: np.ndarray, row: np.ndarray, n: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the blocks that are smallest in a group of consecutive blocks of their row."""
    group = (n - block + 1) // block
    rolled = textscan.roll(words, block)
    count = len(words) - group * block + 1
    if count < 1:
        return np.zeros(0, np.int64), rolled[:0]
    least = rolled[:count].copy()
    for j in range(1, group):
        np.minimum(least, rolled[j * block : j * block + count], out=least)
    whole = row[:count] == row[group * block - 1 :][:count]
    chosen = np.zeros(len(rolled), bool)
    for j in range(group):
        chosen[j * block : j * block + count] |= (least == rolled[j * block : j * block + count]) & whole
    at = np.flatnonzero(chosen)
    return at, rolled[at]


def proofs(keys: np.ndarray, text: np.ndarray, place: np.ndarray, block: int) -> np.ndarray:
    """Which rows of a batch are known to hit without any others: those of keys (rows of 64-bit numbers) that have two places
    and one at a multiple of ``block`` here, but for three rows a key that prove it elsewhere."""
    sure = np.zeros(len(text), bool)
    if not len(text):
        return sure
    order = np.lexsort((place, text, *keys.T))
    keys, text, place = keys[order], text[order], place[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    past = np.append(first[1:], len(text))
    for a, b in zip(first[past - first > 3].tolist(), past[past - first > 3].tolist(), strict=True):
        on = np.flatnonzero(place[a:b] % block == 0)
        if len(on) and (text[a] != text[b - 1] or place[a] != place[b - 1]):
            sure[order[a:b]] = True
            sure[order[[a, a + on[0], b - 1]]] = False
    return sure


def own_keys(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A key for each row by its text and place, so that rows of one hash spread."""
    return textscan.mix(text.view(np.uint64) ^ textscan.mix(place.astype(np.uint64)))


def anchors(docs: DataFrame, n: int, block: int) -> DataFrame:
    """text_hash, places: the starts of the blocks of each text that hit."""

    def run(batches):
        for _, words, edge in _per_row(batches):
            at, hashes = selected_blocks(words.hash, words.row, n, block)
            row = words.row[at]
            texts = np.array([text_hash(words.hash[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], np.int64)[row]
            place = at - edge[row]
            sure = proofs(hashes[:, None], texts, place, block)
            hashes[sure] = own_keys(texts[sure], place[sure])
            yield pa.RecordBatch.from_arrays([pa.array(textscan.signed(hashes)), pa.array(texts), pa.array(place.astype(np.int32)), pa.array(sure)], ["h", "text_hash", "place", "sure"])

    rows = docs.select("text").mapInArrow(run, "h long, text_hash long, place int, sure boolean")
    same = Window.partitionBy("h")
    twice = (F.min("text_hash").over(same) != F.max("text_hash").over(same)) | (F.min("place").over(same) != F.max("place").over(same))
    indexed = F.min(F.col("place") % block).over(same) == 0
    return rows.select("*", twice.alias("twice"), indexed.alias("indexed")).where("sure or (twice and indexed)").groupBy("text_hash").agg(F.array_sort(F.collect_set("place")).alias("places"))


def repeated_windows(docs: DataFrame, hits: DataFrame, n: int, block: int) -> DataFrame:
    """text_hash, starts: the repeated windows. docs: key, text; hits: key, text_hash, places."""

    def run(batches):
        for piece, words, edge in _per_row(batches):
            count = max(0, len(words.start) - n + 1)
            hit = np.zeros(len(words.start) + 1, np.int64)
            wanted, places = piece["text_hash"].to_numpy(), piece["places"].to_pylist()
            for a, b, text, some in zip(edge[:-1], edge[1:], wanted, places, strict=True):
                if text_hash(words.hash[a:b]) == text:
                    hit[a + np.array(some)] = 1
            before = np.concatenate([[0], np.cumsum(hit)])
            start = np.arange(count)
            good = (words.row[:count] == words.row[n - 1 :][:count]) & (before[start + n - block + 1] > before[start])
            at = np.flatnonzero(good)
            row = words.row[at]
            digests, data = np.zeros((len(at), 2), np.int64), words.data.tobytes()
            for i in np.unique(row).tolist():
                a, b = int(edge[i]), int(edge[i + 1])
                spans = list(zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True))
                joined = memoryview(b" ".join(data[x:y] for x, y in spans))
                starts = np.concatenate([[0], np.cumsum(np.array([y - x + 1 for x, y in spans]))]).tolist()
                mine = slice(*np.searchsorted(row, [i, i + 1]).tolist())
                found = b"".join(hashlib.blake2b(joined[starts[k] : starts[k + n] - 1], digest_size=16).digest() for k in (at[mine] - a).tolist())
                digests[mine] = np.frombuffer(found, np.int64).reshape(-1, 2)
            texts, place = wanted[row], at - edge[row]
            sure = proofs(digests, texts, place, 1)
            digests[sure, 0] = textscan.signed(own_keys(texts[sure], place[sure]))
            yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(texts), pa.array(place.astype(np.int32)), pa.array(sure)], ["h", "g", "text_hash", "place", "sure"])

    texts = store.only(docs, hits.select("key"), "key").join(hits, "key")
    rows = texts.select("text", "text_hash", "places").mapInArrow(run, "h long, g long, text_hash long, place int, sure boolean")
    twice = F.count("*").over(Window.partitionBy("h", "g")) > 1
    return rows.select("*", twice.alias("twice")).where("sure or twice").groupBy("text_hash").agg(F.array_sort(F.collect_set("place")).alias("starts"))


def cut_words(docs: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """key, text_hash, n_removed, kept_sha256: texts without the words in windows at ``starts``."""

    def run(batches):
        for piece, words, edge in _per_row(batches):
            out = []
            for a, b, text, starts in zip(edge[:-1].tolist(), edge[1:].tolist(), piece["text_hash"].to_pylist(), piece["starts"].to_pylist(), strict=True):
                if text_hash(words.hash[a:b]) != text:
                    out.append((None, None))
                    continue
                border = np.zeros(b - a + 1, np.int64)
                border[starts] += 1
                border[np.array(starts) + n] -= 1
                keep = np.cumsum(border)[:-1] == 0
                out.append((int((~keep).sum()), kept_sha256(words, a, b, keep)))
            yield pa.RecordBatch.from_arrays([piece["key"], piece["text_hash"], pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["key", "text_hash", "n_removed", "kept_sha256"])

    texts = store.only(docs, found.select("key"), "key").join(found, "key")
    return texts.mapInArrow(run, "key long, text_hash long, n_removed long, kept_sha256 string").where(F.col("n_removed").isNotNull())


def substring_dedup(docs: DataFrame, n: int = 35, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs`` (doc_id, text)."""
    block = max(1, min(block, (n + 1) // 2))  # every window must hold a block at a multiple of its length
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    # By its key a document is found again for the extension; its text hash tells documents with equal keys apart.
    docs = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("key"), text.alias("text"))
    found = store.keep(profile(docs), "substring-profile")
    groups = found.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("key").alias("key"))
    copied = store.keep(groups.where("copies > 1").select("text_hash", "copies"), "substring-copies")
    hits = store.keep(anchors(docs, n, block).join(groups, "text_hash"), "substring-hits")
    windows = repeated_windows(docs, hits.drop("copies"), n, block)
    single = hits.where("copies = 1").select("key", "text_hash")
    partly = store.keep(windows.join(single, "text_hash").select("key", "text_hash", "starts"), "substring-windows")
    cut = cut_words(docs, partly, n).dropDuplicates(["key", "text_hash"])
    nothing = hashlib.sha256(b"").hexdigest()
    whole = F.col("copies").isNotNull() & (F.col("n_words") >= n)
    return (
        found.join(copied, "text_hash", "left")
        .join(cut, ["key", "text_hash"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        )
    )
