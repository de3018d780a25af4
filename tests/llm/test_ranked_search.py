import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quoteloom.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    asked, out = {}, []
    for item, text in items:
        asked.setdefault(item, []).extend(terms(text))
    for item, words in asked.items():
        scores = []
        for doc_id, bag, n in bags:
            score = 0
            for t in words:
                if t in bag:
                    m = 100 - 75 + ((75 * n * n_docs) // n_terms)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, rank + 1, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(40)] + ["É", "é", "Straße", "A", "B", "x" * 30, "x" * 29 + "y"]
    text = lambda k: "".join(rng.choice(vocabulary[: rng.choice([5, 47])]) + rng.choice([" ", ", ", "\n", "-", "_"]) for _ in range(k))
    docs = [(rng.randrange(-500, 500), text(rng.choice([1, 4, 40]))) for _ in range(150)]
    docs += [(i, docs[0][1]) for i in range(1000, 1030)] + [docs[1]] * 3  # ties and repeated rows
    docs += [(2000, None), (2001, ""), (2002, " ,;"), (None, docs[0][1]), (None, docs[2][1]), (3000, "t1 " * 30_000 + docs[3][1])]
    items = [(i, text(rng.choice([1, 5, 30]))) for i in range(12)] + [(20, None), (21, ""), (22, "unknown words"), (None, "T1 t2"), (3, "t7 t7"), (23, docs[0][1])]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int").selectExpr("*", "item_id as shard", "item_id as n", "item_id as terms")
    return d, spark.createDataFrame([(*x, "doc") for x in items], "item_id long, text string, doc_id string")


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("seed,shard,block", [(1, 16_384, 1 << 24), (2, 40, 1 << 24), (3, 7, 4000)])
def test_equals_brute_force(spark, seed, shard, block):
    docs, items = made(seed)
    assert rows(ranked_search.search(*frames(spark, docs, items), shard=shard, block_bytes=block)) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = made(4)
    d, b = frames(spark, docs, items)
    assert rows(ranked_search.search(d.limit(0), b)) == rows(ranked_search.search(d, b.limit(0))) == []


def test_tree_and_branch_and_bound():
    rng = np.random.default_rng(5)
    for size in (1, 31, 33, 5000):
        dense = rng.integers(0, 4, (9, size)) * (rng.random((9, size)) < 0.3)
        term, place = np.nonzero(dense)
        tree = ranked_search.levels(term, place, dense[term, place], size)
        assert set(tree[-1][1].tolist()) <= {0} and tree[-1][2].tolist() == [x.max() for x in dense if x.any()]
        shard, terms, weights = ranked_search.Shard(pa.array(range(size)), tree), np.array([0, 3, 4, 8]), np.array([5, 1, 0, 2])
        scores = weights @ dense[terms]
        want = [(s, p) for s, p in sorted(zip((-scores).tolist(), range(size)))[:10] if s < 0]
        assert [(-s, p) for s, p in shard.best(terms, weights, 10, 1)] == want
        assert [(-s, p) for s, p in shard.best(terms, weights, 10, 9)] == [x for x in want if x[0] <= -9]
