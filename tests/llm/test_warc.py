import hashlib

import pytest

from quoteloom.llm import store, warc


def brute(pages, least):
    groups = {}
    for page_id, _, html in pages:
        body = (html or "").encode()
        if len(body) >= least and page_id is not None:
            groups[body] = max(groups.get(body, page_id), page_id)
    out = []
    for page_id, _, html in pages:
        body = (html or "").encode()
        alone = sum((h or "").encode() == body for _, _, h in pages) == 1
        top = groups.get(body)
        to = top if top is not None and not alone and top != page_id else None
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


PAGES = [(1, "http://a/1", "x" * 1000), (5, "http://a/ü\r\n b", "x" * 1000), (3, None, "x" * 1000), (9, "u", "é" * 500), (8, "u", "é" * 500), (7, "u", "x" * 999), (6, "u", "x" * 999), (2, "u", None), (4, "u", ""), (10, "u", "y" * 200_000), (None, "u", "x" * 1000), (5, "again", "x" * 1000), (-3, "u", "z")]


def test_equals_brute_force(spark):
    pages = spark.createDataFrame([(*p, "k") for p in PAGES], "page_id long, url string, html string, key string")
    rows = warc.read_archives(warc.write_archives(pages)).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=repr)
    assert got == brute(PAGES, 1000)
    assert {bytes(r["payload"]) for r in rows if r["record_type"] == "response"} == {(h or "").encode() for _, _, h in PAGES}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).collect() == []


def test_dictionary_is_loaded():
    import zstandard

    bodies = [f"<html><body><p>page number {i} of the same site, with a common footer and header</p></body></html>".encode() * 3 for i in range(300)]
    records = [warc.record_bytes(i, f"http://h/{i}", b, hashlib.sha1(b).hexdigest(), None, "2024-01-01T00:00:00Z") for i, b in enumerate(bodies)]
    frame, dictionary = warc.dictionary_frame(records)
    assert dictionary is not None and frame[:4] == warc.DICTIONARY_MAGIC
    packer = zstandard.ZstdCompressor(dict_data=dictionary)
    archive = frame + b"".join(map(packer.compress, records))
    assert [r.payload for r in warc.read_archive(archive)] == bodies
    for bad in (archive[:-3], archive[4:], frame[:6], b"", frame + packer.compress(b"WARC/1.1\r\n\r\n")):
        with pytest.raises(warc.BadArchive):
            list(warc.read_archive(bad))


@pytest.mark.parametrize("change", [(b"Content-Length: 4", b"Content-Length: 5"), (b"WARC/1.1", b"WURC/1.1"), (b"sha1:", b"sha9:"), (b"WARC-Date", b"WARC-Dat"), (b"body", b"bodi"), (b"WARC-Type: response", b"WARC-Type: request")])
def test_bad_records(change):
    good = warc.record_bytes(1, "u", b"body", hashlib.sha1(b"body").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(good).payload == b"body"
    with pytest.raises(warc.BadArchive):
        warc.parse_record(good.replace(*change))
