"""Operator 9, WARC: Zstandard archives with a dictionary frame, one frame per record, written and read back.

An archive starts with a skippable frame (magic ``5D 2A 4D 18``, 32-bit length) that holds the dictionary, raw
or itself compressed; every record is one Zstandard frame under that dictionary. The reader decodes frame by
frame and checks the version line, the needed headers, the block length, the record's end and, where the payload
is there, its digest.

Of pages whose payloads are equal and of at least ``min_bytes``, the one with the largest ``page_id`` is the
response; the others are revisit records, which keep the HTTP headers (with the payload's length) and refer to
it. Smaller payloads are responses.

Defined results: a null html is an empty payload; a null url leaves out the target header; rows that repeat the
response's ``page_id`` are responses too; a null ``page_id`` never wins and comes back null. No pages, no archives.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
END = b"\r\n\r\n"
SAMPLE_PAGES, DICTIONARY_BYTES = 200, 16 << 10
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest")


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


class BadArchive(ValueError):
    """An archive or record that breaks the format."""


def fields(block: bytes) -> dict[str, str]:
    """Header lines after the first, names in lower case."""
    out = {}
    for line in block.decode("utf-8").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"not a header: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def parse_record(data: bytes) -> Record:
    head, found, rest = data.partition(END)
    if not found or not head.startswith(b"WARC/1."):
        raise BadArchive("no record header")
    headers = fields(head)
    if missing := [x for x in NEEDED if x not in headers]:
        raise BadArchive(f"a record without {missing[0]}")
    if not headers["content-length"].isdecimal() or len(rest) != int(headers["content-length"]) + len(END) or not rest.endswith(END):
        raise BadArchive("a block of another length")
    block = rest[: -len(END)]
    http, found, payload = block.partition(END)
    if not found or not http.startswith(b"HTTP/"):
        raise BadArchive("no HTTP header")
    web, digest = fields(http), headers["warc-payload-digest"]
    if not re.fullmatch(r"sha1:[0-9a-f]{40}", digest):
        raise BadArchive("no SHA-1")
    if headers["warc-type"] == "response":
        if hashlib.sha1(payload).hexdigest() != digest[5:] or str(len(payload)) != web.get("content-length"):
            raise BadArchive("a payload of another digest or length")
    elif headers["warc-type"] != "revisit" or payload or "warc-refers-to" not in headers or not web.get("content-length", "").isdecimal():
        raise BadArchive("neither a response nor a revisit")
    return Record(headers, web, payload)


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, object | None]:
    """(leading skippable frame, dictionary); an empty frame where there is too little to train on."""
    import zstandard

    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except (zstandard.ZstdError, ValueError):
        return DICTIONARY_MAGIC + struct.pack("<I", 0), None
    body = zstandard.ZstdCompressor().compress(trained.as_bytes())
    return DICTIONARY_MAGIC + struct.pack("<I", len(body)) + body, trained


def read_archive(buffer) -> Iterator[Record]:
    """The records of an archive, one Zstandard frame each."""
    import zstandard

    view = memoryview(buffer)
    if len(view) < 8 or bytes(view[:4]) != DICTIONARY_MAGIC:
        raise BadArchive("no dictionary frame")
    at = 8 + struct.unpack("<I", view[4:8])[0]
    if at > len(view):
        raise BadArchive("a dictionary frame of another length")
    body = bytes(view[8:at])
    if body.startswith(FRAME_MAGIC):
        body = zstandard.ZstdDecompressor().decompress(body)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) if body else zstandard.ZstdDecompressor()
    while at < len(view):
        one, parts = reader.decompressobj(), []
        try:
            while not one.eof:
                if at >= len(view):
                    raise BadArchive("a frame that is cut off")
                chunk = view[at : at + (1 << 14)]
                parts.append(one.decompress(chunk))
                at += len(chunk)
        except zstandard.ZstdError as e:
            raise BadArchive(str(e)) from e
        at -= len(one.unused_data)
        yield parse_record(b"".join(parts))


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        def records():
            for batch in batches:
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield record_bytes(page_id, url, html or b"", digest, refers_to, date)

        made, path = 0, f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.zst"
        stream = records()
        first = [x for _, x in zip(range(SAMPLE_PAGES), stream, strict=False)]
        if not first:
            return
        frame, dictionary = dictionary_frame([x[: DICTIONARY_BYTES] for x in first])
        packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary) if dictionary else zstandard.ZstdCompressor(level=3)

        def frames():
            nonlocal made
            yield frame
            for some in (first, stream):
                for x in some:
                    made += 1
                    yield packer.compress(x)

        store.write_bytes(path, frames())
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([made], pa.int64())], ["path", "n_records"])

    return run


def plan_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, html as bytes, digest and refers_to (null for responses)."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html")).withColumn("digest", F.sha1("html"))
    large = F.octet_length("html") >= min_bytes
    groups = own.where(large).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies"))
    repeated = store.keep(groups.where((F.col("copies") > 1) & F.col("response").isNotNull()).select(F.col("digest").alias("key"), "response"), "warc-copies")
    # Small payloads match nothing; a key of their own spreads them over the partitions.
    own = own.withColumn("key", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id"), F.lit(0)))))
    refers = F.when(F.col("page_id").isNull() | (F.col("response") != F.col("page_id")), F.col("response"))
    return own.join(repeated, "key", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes one archive per partition and returns the manifest (path, n_records)."""
    folder = store.fresh_path(pages.sparkSession, "warc")
    return store.keep(plan_records(pages, min_bytes).mapInArrow(_writer(folder, date), "path string, n_records long"), "warc-manifest")


def _page(uri: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", uri)
    if not found:
        raise BadArchive(f"not a page: {uri[:80]}")
    return int(found[1]) if found[1] else None


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path, expected in zip(batch["path"].to_pylist(), batch["n_records"].to_pylist(), strict=True):
                seen, rows, held = 0, [], 0
                for r in read_archive(store.read_bytes(path)):
                    revisit = r.headers["warc-type"] == "revisit"
                    rows.append((_page(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), None if revisit else r.payload, int(r.http["content-length"]), r.headers["warc-payload-digest"][5:], r.headers["warc-type"], _page(r.headers["warc-refers-to"]) if revisit else None))
                    held += len(r.payload)
                    seen += 1
                    if held > 4 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)
                if seen != expected:
                    raise BadArchive(f"{path}: {seen} records, {expected} were written")

    # a given number of partitions is not coalesced, however small the manifest is
    return manifest.repartition(max(1, manifest.count()), "path").mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
