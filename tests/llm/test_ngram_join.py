import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quoteloom.llm import components, ngram_join, textscan
from quoteloom.llm.components import connected_components
from quoteloom.llm.ngram_join import NgramJoin, ngram_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    w = [x.lower() for x in WORD.findall((text or "").encode())]  # bytes: A-Z only
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(docs, percent=75):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        ids = [d for k, (d, _) in enumerate(docs) if root(k) == root(i) and d is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [a + b for a in "abcdefghij" for b in ["", "x", "é", "Y"]]
    docs, hot = [], " ".join(rng.choices(vocabulary, k=30))
    while len(docs) < n:
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 5, 6, 7, 9, 15, 40, 90, 300]))
        if rng.random() < 0.3:
            base += hot.split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            near = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                k = rng.randrange(len(near))
                near[k : k + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(2))
            docs.append((rng.randrange(10**6), rng.choice([" ", "\n", " \t"]).join(near)))
    return [*docs, (1, None), (2, ""), (3, " \n"), docs[5], (None, docs[7][1]), (None, "only null id here"), (docs[9][0], "another text of the same id")]


@pytest.mark.parametrize("seed,percent,hot,wide", [(1, 75, 16, 16), (2, 75, 2, 2), (3, 60, 4, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, percent, hot, wide):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(components, "WIDE", wide)
    docs = corpus(seed)
    frame = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, node long")
    assert sorted(map(tuple, ngram_components(frame, 5, percent).collect()), key=repr) == brute(docs, percent)


def test_group_of_near_copies(spark, monkeypatch):
    """Variants of one text with more and more changes: some link to it, some only to each other, some to none."""
    monkeypatch.setattr(ngram_join, "HOT", 4)
    monkeypatch.setattr(components, "WIDE", 4)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        near = list(base)
        for _ in range(rng.randrange(12)):
            near[rng.randrange(len(near))] = f"v{rng.randrange(40)}"
        docs.append((i, " ".join(near)))
        if i % 10 == 0:
            near[3] = "again"
            docs.append((1000 + i, " ".join(near)))
    assert sorted(map(tuple, ngram_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr) == brute(docs)


def test_sets_that_fail_to_allocate(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "allocate", lambda band, percent: (2, 6))
    docs = corpus(7, 60)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, ngram_components(frame).collect()), key=repr) == brute(docs)


def test_keep_one(spark):
    docs = [d for d in corpus(9, 60) if d[0] is not None][:-1]
    frame = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, key long")
    kept = sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_one(frame.where("text is not null")).collect())
    names = {(r[0], r[1]): r[2] for r in brute(docs)}
    want = {d for d in docs if d[1] is not None and (not shingles(d[1]) or names[d[0], len(shingles(d[1]))] == d[0])}
    assert kept == sorted(want)
    odd = [(None, "a b"), (None, "A B"), (None, "c d"), (7, "a b"), (7, "x y"), (8, None), (8, None)]
    rows = ngram_join.keep_one(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(None, "c d"), (7, "a b"), (7, "x y"), (8, None), (8, None)], key=repr)
    assert ngram_join.keep_one(frame.limit(0)).collect() == []


def test_empty(spark):
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_linked_sets_share_a_key():
    """Pigeonhole, without Spark: many random pairs around the threshold."""
    rng = np.random.default_rng(5)
    none = np.zeros(ngram_join.BITMAP_BITS // 8, np.uint8)
    some = rng.integers(0, 256, ngram_join.BITMAP_BITS // 8).astype(np.uint8)
    for _ in range(300):
        size = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        drop, add = int(rng.integers(0, size // 6 + 1)), int(rng.integers(0, size // 6 + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 75 * (len(a) + len(b) - both):
            continue
        row, h = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b])
        for hot in (none, some):
            keys, owner, failed = ngram_join.signatures(row, h, np.array([len(a), len(b)]), hot, 75)
            assert len(failed) or np.intersect1d(keys[owner == 0], keys[owner == 1]).size


def test_allocations():
    for band in range(20):
        segments, deep = ngram_join.allocate(band, 75)
        assert segments >= 64 and deep >= 3
    with pytest.raises(ValueError):
        NgramJoin(None, 0, 75)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 11), (11, 12), (None, 3), (3, 1), (1, 2)]
    edges += [(100 + i, 101 + i) for i in range(60)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 8, 9: 8, 10: 8, 11: 8, 12: 8} | {100 + i: 100 for i in range(61)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shingles_match_words():
    texts = ["a b c d e F", "a B", None, "x", "a b c d e f g a b c d e"]
    w = textscan.scan(pa.array(texts), lower=True)
    row, h = ngram_join.shingle_sets(w, len(texts), 5)
    assert np.bincount(row, minlength=5).tolist() == [len(shingles(t)) for t in texts]
    assert set(h[row == 0]) <= set(h[row == 4])


def test_first_met(monkeypatch):
    """A node is new once, in and over pieces; beyond the last SEEN it may be new again, which costs rows only."""
    monkeypatch.setattr(ngram_join, "SEEN", 3)
    new, seen = ngram_join.first_met(np.array([5, 7, 5, 7, 9]), np.zeros(0, np.int64))
    assert new.tolist() == [True, True, False, False, True] and seen.tolist() == [5, 7, 9]
    new, seen = ngram_join.first_met(np.array([9, 5, 2]), seen)
    assert new.tolist() == [False, False, True] and seen.tolist() == [7, 9, 2]
    assert ngram_join.first_met(np.array([5]), seen)[0].tolist() == [True]
    assert ngram_join.first_met(np.zeros(0, np.int64), seen)[0].tolist() == []


@pytest.mark.parametrize("seen", [1, 100_000])
def test_copies_give_their_keys_once_a_task(spark, monkeypatch, seen):
    monkeypatch.setattr(ngram_join, "SEEN", seen)
    monkeypatch.setattr(ngram_join, "HOT", 4)
    docs = corpus(21, 40)
    docs += [(2_000_000 + i, docs[i % 7][1]) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_components(frame).collect()), key=repr) == brute(docs)


def test_sql_equals_brute_force():
    import duckdb

    docs = corpus(31)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert sorted(con.sql(ngram_join.ORACLE).fetchall(), key=repr) == brute(docs)


def test_common_shingles_are_hot_whatever_the_tasks(spark):
    """A passage that each of many small tasks sees once is as hot as if one task saw it all."""
    docs = spark.createDataFrame([(i, f"one common passage of six words {i} own words {i * 7} here") for i in range(64)], "doc_id long, text string")
    assert ngram_join.NgramJoin(docs.repartition(64)).hot_bitmap().any() and ngram_join.NgramJoin(docs.coalesce(1)).hot_bitmap().any()


def test_verified_from_texts(spark, monkeypatch):
    """Pairs are compared from their texts, in slices of a batch and pieces of a slice; no table of sets is written."""
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words[:-2]), " ".join(words[:20]), "short", ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels, keep = [], ngram_join.store.keep
    monkeypatch.setattr(ngram_join.store, "keep", lambda df, label, *more: labels.append(label) or keep(df, label, *more))
    job = ngram_join.NgramJoin(docs)
    nodes = {r["doc_id"]: r["node"] for r in job.profile().collect()}
    sets = job.profile().where("node is not null")
    pairs = [(nodes[a], nodes[b]) for a in range(4) for b in range(a)] * 200
    found = job.verify(spark.createDataFrame(pairs, "a long, b long").coalesce(1), sets).distinct().collect()
    assert {frozenset(r) for r in found} == {frozenset((nodes[0], nodes[1]))}
    assert "ngram-texts" in labels and "ngram-members" not in labels


def test_wide_pairs_of_near_misses(spark):
    """Variants with one change in common and four of their own differ too much to link: next to no pair is put out."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, 80):
        near = [*base[:60], "again", *base[61:]]
        for j, at in enumerate(rng.sample([x for x in range(120) if x != 60], 4)):
            near[at] = f"v{i}-{j}"
        docs.append((i, " ".join(near)))
    near = docs[1][1].split()
    docs.append((80, " ".join([*near[:-1], "last"])))
    job = NgramJoin(spark.createDataFrame(docs, "doc_id long, text string"))
    sets = job.profile().cache()
    centre = sets.where("doc_id = 0").first()["node"]
    nodes = sets.where("doc_id > 0").selectExpr("node", "node as label", f"{centre}L as centre")
    pairs = {tuple(r) for r in job.wide_pairs(nodes, sets).collect()}
    print(f"pairs {len(pairs)}")
    linked = tuple(sorted(r["node"] for r in sets.where("doc_id in (1, 80)").collect()))
    assert linked in pairs and len(pairs) <= 80


def test_parities_bound_the_difference():
    rng = np.random.default_rng(6)
    for size in (10, 300, 3000):
        a = rng.integers(0, 2**64, size, np.uint64)
        b = np.concatenate([a[size // 5 :], rng.integers(0, 2**64, size // 7, np.uint64)])
        odd = (ngram_join.parities(a) ^ ngram_join.parities(b)).view(np.uint64)
        assert 0 < np.bitwise_count(odd).sum() <= size // 5 + size // 7
