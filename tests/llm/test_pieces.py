import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quoteloom.llm import pieces

MODEL = pieces.model_path()


def every(lattice, text):
    """(score, ids) of all segmentations of a short text."""
    text = " " + text.replace(pieces.SPACE, " ") if text else ""
    edges = lattice.edges(text)

    def paths(end):
        if end == 0:
            yield 0.0, ()
        for start, ids, score in edges[end]:
            for s, before in paths(start):
                yield s + score, before + ids

    return sorted(paths(len(text)), key=lambda x: -x[0])


def compare(texts, n):
    e = pieces.encoder(MODEL, n)
    for text, (best, found) in zip(texts, e.encode(pa.array(texts, pa.string())), strict=True):
        want = every(e.lattice, text or "")
        assert np.allclose([s for s, _ in found], [s for s, _ in want[:n]])
        scores = {ids: s for s, ids in want}
        assert len({tuple(i.tolist()) for _, i in found}) == len(found)
        assert all(np.isclose(scores[tuple(i.tolist())], s) for s, i in found)
        assert best.tolist() == found[0][1].tolist()
        assert e.decode(best).decode() == (text or "").replace(pieces.SPACE, " ")


def test_equals_all_segmentations():
    rng = random.Random(4)
    texts = ["", None, "a", "the", "  a ", "a\nb", "é①", "▁x", "ß,", "zzzzz"] + ["".join(rng.choice("then, \n①é") for _ in range(rng.randrange(1, 10))) for _ in range(60)]
    for n in (1, 2, 5):
        compare(texts, n)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=7).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)), max_size=3))
def test_any_text(texts):
    compare(texts, 4)


def test_decode_equals_library():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["Hello wörld  foo", " lead", "trail ", "a\tb\x00c ①日本", "x" * 3000]
    e = pieces.encoder(MODEL, 2)
    for text, (ids, _) in zip(texts, e.encode(pa.array(texts))):
        assert model.decode(ids.tolist()) == text == e.decode(ids).decode()
        assert e.decode(np.array(model.encode(text))).decode() == text


def test_memo_overflow(monkeypatch):
    e = pieces.PieceEncoder(MODEL, 2)
    monkeypatch.setattr(e, "MEMO_RUNS", 5)
    texts = ["one two three four", "five six seven one", "one"]
    for t in itertools.chain(texts, texts):
        assert [i.tolist() for _, i in e.encode(pa.array([t]))[0][1]] == [i.tolist() for _, i in pieces.encoder(MODEL, 2).encode(pa.array([t]))[0][1]]


def test_frames(spark):
    rows = [(1, "a b"), (1, "the cat"), (None, None), (2, ""), (3, "word " * 9000), (3, "word " * 9000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids int")
    encoded = pieces.encode_texts(docs, MODEL, 3)
    assert sorted(map(tuple, pieces.decode_texts(encoded, MODEL).collect()), key=repr) == sorted([(i, t or "") for i, t in rows], key=repr)
    got = pieces.report(docs, MODEL).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    empty = [r for r in got if r["n_pieces"] == 0]
    assert len(empty) == 2 and all(list(r["nbest_scores"]) == [0.0] and r["ids_crc32"] == zlib.crc32(b"") for r in empty)
    assert all(len(r["nbest_crc32"]) == 3 and r["nbest_crc32"][0] == r["ids_crc32"] for r in got if r["n_pieces"])
    assert pieces.report(docs.limit(0), MODEL).collect() == []


def test_least_sums():
    rng = random.Random(2)
    for _ in range(200):
        options = [[(c, i, k) for k, c in enumerate(sorted([0.0, *(rng.randrange(5) for _ in range(rng.randrange(4)))]))] for i in range(rng.randrange(5))]
        for n in (1, 3, 10):
            want = sorted(sum(x[0] for x in c) for c in itertools.product(*options))[:n]
            got = pieces.least_sums(options, n)
            assert [sum(x[0] for x in c) for c in got] == want and len(set(got)) == len(got)
    many = [[(0.0, i, 0), (1.0, i, 1)] for i in range(60)]
    assert len(pieces.least_sums(many, 50)) == 50
