"""Operator 7, media columns: Netpbm and BMP as numpy arrays, area-resized, tiled and hashed.

``decode`` reads Netpbm (P1 to P6, 8 and 16 bits) and BMP (1, 4, 8, 24 and 32 bits, uncompressed) into arrays of
shape height x width x channels. ``area_resize`` averages each target cell exactly by an integral image, for
cells of any fractional size. A tile is an NPY file of the resized grey image; its difference hash has one bit
per pair of horizontal neighbours.

``text_media`` stores texts as images without loss: a text's UTF-8 bytes, padded by 255 to a positive multiple
of ``ROW`` bytes, are the samples of rows of ``ROW`` bytes; a grey PGM, a colour PPM or a 24-bit BMP, by the
number of rows modulo 3. Equal texts give equal media. Null and empty texts are one row of padding.

Defined results: every input row gives a row with its tile as the bytes of an NPY file; very long texts are one tall
image, which a task holds whole; repeated rows have equal media; equal or null ``doc_id`` are kept; other columns are ignored;
bytes that are not an image raise ``BadImage``.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textscan

ROW = 576
TILE = (8, 9)
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


class BadImage(ValueError):
    """Bytes that are no image of a known kind."""


def decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise BadImage("not Netpbm")
    at, numbers = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        found = _TOKEN.match(data, at)
        if not found or not found[1].isdigit():
            raise BadImage("a bad Netpbm header")
        numbers.append(int(found[1]))
        at = found.end()
    width, height, top = (*numbers, 1)[:3]
    channels = 3 if kind in (b"P3", b"P6") else 1
    if width < 1 or height < 1 or not 1 <= top < 1 << 16:
        raise BadImage("a bad Netpbm size")
    count = width * height * channels
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = list(re.sub(rb"\s", b"", body)) if kind == b"P1" else body.split()
        if len(values) < count:
            raise BadImage("too few samples")
        out = np.array([v - 48 for v in values[:count]] if kind == b"P1" else [int(v) for v in values[:count]])
        if (out < 0).any() or (out > top).any():
            raise BadImage("a sample beyond the largest")
        out = 1 - out if kind == b"P1" else out
    else:
        at += 1  # one white byte ends the header
        if kind == b"P4":
            line = (width + 7) // 8
            if len(data) < at + line * height:
                raise BadImage("too few samples")
            bits = np.unpackbits(np.frombuffer(data, np.uint8, line * height, at).reshape(height, line), axis=1)[:, :width]
            out = 1 - bits.reshape(-1).astype(np.int64)
        else:
            sample = np.dtype(np.uint8 if top < 256 else ">u2")
            if len(data) < at + count * sample.itemsize:
                raise BadImage("too few samples")
            out = np.frombuffer(data, sample, count, at)
            if top not in (255, 65535) and (out > top).any():
                raise BadImage("a sample beyond the largest")
    return out.reshape(height, width, channels).astype(np.uint8 if top < 256 else np.uint16, copy=False)


def decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54 or data[:2] != b"BM":
        raise BadImage("not BMP")
    start, header = struct.unpack_from("<II", data, 10)
    width, height, planes, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if header < 40 or planes != 1 or packing != 0 or bits not in (1, 4, 8, 24, 32) or width < 1 or height == 0:
        raise BadImage("a BMP of another kind")
    rows, line = abs(height), (width * bits + 31) // 32 * 4
    if len(data) < start + line * rows:
        raise BadImage("too few samples")
    lines = np.frombuffer(data, np.uint8, line * rows, start).reshape(rows, line)
    if bits >= 24:
        out = lines[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        index = lines if bits == 8 else np.unpackbits(lines, axis=1) if bits == 1 else np.stack([lines >> 4, lines & 15], 2).reshape(rows, -1)
        index = index[:, :width]
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, min(4 * colours, start - 14 - header), 14 + header).reshape(-1, 4)[:, 2::-1]
        if index.max() >= len(palette):
            raise BadImage("a colour beyond the palette")
        out = palette[index]
    return out if height < 0 else out[::-1]


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode(samples: np.ndarray, kind: str) -> bytes:
    """PGM, PPM or a 24-bit bottom-up BMP of 8-bit samples (height x width x channels)."""
    height, width, channels = samples.shape
    if kind in ("pgm", "ppm"):
        if channels != (1 if kind == "pgm" else 3):
            raise BadImage("another number of channels")
        return b"P%d\n%d %d\n255\n" % (5 if kind == "pgm" else 6, width, height) + samples.tobytes()
    gap = -width * 3 % 4
    body = np.pad(samples[::-1, :, ::-1].reshape(height, -1), ((0, 0), (0, gap))).tobytes()
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def grey(image: np.ndarray) -> np.ndarray:
    """The mean of the channels."""
    return image[:, :, 0].astype(np.float64) if image.shape[2] == 1 else image.mean(axis=2)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact means of the cells of a height x width grid, by the integral image; cells may be fractional."""
    integral = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(image, axis=0, out=integral[1:, 1:])
    np.cumsum(integral[1:, 1:], axis=1, out=integral[1:, 1:])

    def at(table: np.ndarray, cells: int) -> np.ndarray:
        """Sums of the cells along the first axis; the integral is linear between its samples."""
        edge = np.arange(cells + 1) * ((len(table) - 1) / cells)
        low = np.minimum(edge.astype(np.int64), len(table) - 2)
        part = (edge - low)[:, None]
        return np.diff(table[low] * (1 - part) + table[low + 1] * part, axis=0)

    sums = at(at(integral, height).T, width).T
    return sums * (height * width / (image.shape[0] * image.shape[1]))


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def difference_hash(tile: np.ndarray) -> str:
    """One bit per pair of horizontal neighbours, 1 if the right one is brighter; as hex."""
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def features(data: bytes, tile: tuple[int, int] = TILE) -> tuple[np.ndarray, bytes, str]:
    """(image, NPY tile, difference hash) of an encoded image."""
    image = decode(data)
    small = np.floor(area_resize(grey(image), *tile) + 0.5).astype(np.uint16 if image.dtype == np.uint16 else np.uint8)
    return image, npy(small), difference_hash(small)


def text_media(text: bytes) -> bytes:
    """The lossless image of a text's bytes."""
    rows = max(1, -(-len(text) // ROW))
    samples = np.full(rows * ROW, 255, np.uint8)
    samples[: len(text)] = np.frombuffer(text, np.uint8)
    kind = ("pgm", "ppm", "bmp")[rows % 3]
    return encode(samples.reshape(rows, -1, 1 if kind == "pgm" else 3), kind)


def store_media(docs: DataFrame) -> DataFrame:
    """Writes the images of ``docs`` (doc_id, text) as a table and returns its reader: doc_id, n_bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textscan.pieces(batch, "text"):
                data, at = textscan.raw(piece.column(1))
                media = [text_media(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(at)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return store.keep(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the payload's and the stored form's digests, feature, tile (NPY)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch["media"]:
                data = data.as_py()
                image, tile, hashed = features(data)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"{image.shape[1]}x{image.shape[0]}x{image.shape[2]}:{hashed}", tile))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")
