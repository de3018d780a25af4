import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from hypothesis import given, settings
from hypothesis import strategies as st

from quoteloom.llm import store, token_files
from quoteloom.llm.token_files import vocabulary_path

LIBRARY = Tokenizer.from_file(vocabulary_path())


def plain(texts):
    return [LIBRARY.encode(x or "", add_special_tokens=False).ids for x in texts]


SAMPLES = ["", None, "It's the DON'T !'t 'tis x's", "a,b;c 12ab3", "<|endoftext|> a<|b", "Éa é É, ≠x ≮", "İstanbul ß—,— d…d", "日本語 text　x", "J̌ Ḱ àb", "x" * 5000, "wörter,wörter WÖRTER"]


def check(texts):
    ids, at = token_files.encoder(vocabulary_path()).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == plain(texts)


def test_runs_equal_whole_texts():
    check(SAMPLES)
    check([])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aAbs'tT ,.!3\n\t<|>éÉ̸́=—ßİñ  日")), max_size=30), max_size=4))
def test_any_text(texts):
    check(texts)


def test_files_and_edges(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(1000), rng.choice(SAMPLES), "x") for _ in range(60)] + [(None, "null id", "x"), (None, "another", "x"), (-(1 << 63), "the smallest id", "x"), (5, "long text " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_files.read_token_files(token_files.write_token_files(docs, vocabulary_path(), 2)).collect()
    want, start = [], 0
    for doc_id, text in sorted(((a, b) for a, b, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, b"" if r[1] is None else b"\x00" + r[1].encode())):
        ids = plain([text])[0] + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), vocabulary_path(), 2)).collect() == []


def test_damaged_index():
    good = token_files.index_bytes(2, np.array([0, 3]), np.array([7]))
    assert token_files.read_index(good)[1].tolist() == [0, 3]
    for bad in (b"", good[:-1], b"X" + good[1:], token_files.index_bytes(2, np.array([1, 0]), np.array([7]))):
        with pytest.raises(ValueError):
            token_files.read_index(bad)


def test_retry_keeps_whole_file(tmp_path):
    path = f"file://{tmp_path}/a/b.bin"
    store.write_bytes(path, [b"one"])
    store.write_bytes(path, [b"two"])
    assert bytes(store.read_bytes(path)) == b"two"
