import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quoteloom.llm import textscan
from quoteloom.llm.substring_dedup import own_keys, proofs, substring_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(docs, n):
    cut = [WORD.findall((t or "").encode()) for _, t in docs]
    seen = Counter(tuple(w[i : i + n]) for w in cut for i in range(len(w) - n + 1))
    out = []
    for (doc_id, _), w in zip(docs, cut, strict=True):
        gone = {k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdefgh") + rng.choice(["x", "é", ""]) + rng.choice([" ", "\n", "  ", "\t "]) for _ in range(k))
    shared = [text(rng.randrange(n - 2, 3 * n)) for _ in range(4)]
    docs = [(i, text(rng.randrange(2 * n)) + rng.choice([*shared, ""]) + text(rng.randrange(n)) + rng.choice([*shared, ""])) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "  \n"), (53, "a " * (n - 1)), (54, "a " * (4 * n)), (55, docs[0][1]), (None, shared[0]), (None, shared[1]), docs[1], (3, shared[2]), (56, docs[2][1].replace(" ", "\n"))]
    return docs


@pytest.mark.parametrize("seed,n", [(1, 35), (2, 12), (3, 3)])
def test_equals_brute_force(spark, seed, n):
    docs = corpus(seed, n)
    got = substring_dedup(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_removed int"), n)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, n)


def test_frequent_passage_and_long_text(spark):
    """A passage of hundreds of copies at all offsets, one of them in a text of 200,000 words."""
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(10**9)
    passage = " ".join(word() for _ in range(50))
    docs = [(i, " ".join([*(word() for _ in range(rng.randrange(40))), passage, *(word() for _ in range(rng.randrange(9)))])) for i in range(300)]
    docs.append((900, " ".join(word() for _ in range(100_000)) + " " + passage + " " + " ".join(word() for _ in range(100_000))))
    got = substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 35)
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == brute(docs, 35) and {r[2] for r in rows} == {50}


def test_proofs():
    """Of a key that proves itself all rows but three are sure; of others none."""
    keys = np.array([7] * 6 + [8] * 5 + [9] * 5 + [6] * 3)[:, None]
    text = np.array([1, 1, 2, 2, 3, 3] + [1] * 5 + [4] * 5 + [1, 2, 3])
    place = np.array([3, 9, 10, 11, 12, 13] + [1, 2, 3, 4, 6] + [5] * 5 + [0, 5, 10])
    sure = proofs(keys, text, place, 5)
    assert sure[:6].sum() == 3 and not sure[[0, 2, 5]].any() and not sure[6:].any()
    assert len(np.unique(own_keys(text[:6], place[:6]))) == 6


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tabé　 ", max_size=40)), max_size=6))
def test_words(texts):
    w = textscan.scan(pa.array(texts, pa.string()))
    want = [(i, x) for i, t in enumerate(texts) for x in WORD.findall((t or "").encode())]
    assert [(int(r), w.data[a:b].tobytes()) for r, a, b in zip(w.row, w.start, w.end)] == want
    by_word = {}
    for h, (_, x) in zip(w.hash.tolist(), want):
        assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert w.first.tolist()[:-1] == [sum(i < k for i, _ in want) for k in range(len(texts))]


def test_long_words():
    texts = ["ab " + "x" * 300 + " c", "y" * (3 << 20) + " ab " + "x" * 300, "z" * (5 << 20)]
    w = textscan.scan(pa.array(texts))
    assert (w.hash[0], w.hash[1]) == (w.hash[4], w.hash[5]) and len(np.unique(w.hash)) == 5
    assert [textscan.roll(w.hash, 2)[i] for i in (0,)] == [textscan.roll(w.hash, 2)[4]]
