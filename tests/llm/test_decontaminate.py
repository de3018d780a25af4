import hashlib
import random
import re

import pytest

from quoteloom.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = (text or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER))
    return WORD.findall(low.encode())


def brute(docs, items, n=10):
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            found = grams.setdefault(tuple(w[i : i + n]), set())
            if item is not None:
                found.add(item)
    out = set()
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if (g := grams.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= g
        names = sorted(map(str, found))
        out.add((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "É", "é", "x1", "the", "Straße", "of", "İ", "ς", "9"]

    def text(k):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "_"]) for _ in range(k))

    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(None, "a b"), (50, None), (50, "Straße of x1 9 9"), (3, text(12))]
    docs = [(i, rng.choice(["", "--", "¿"]) + text(rng.randrange(40)) + (rng.choice(items)[1] or "") + text(rng.randrange(5))) for i in range(60)]
    return [*docs, (100, None), (101, ""), (102, " ,;"), docs[0], (None, items[5][1])], items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "gram") for d in docs], "doc_id long, text string, gram string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed,limit", [(1, 10**6), (2, 10**6), (3, 0)])
def test_report_equals_brute_force(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    docs, items = made(seed)
    assert {tuple(r) for r in decontaminate.report(*frames(spark, docs, items)).collect()} == brute(docs, items)


def test_empty_tables(spark):
    docs, items = made(4)
    d, b = frames(spark, docs, items)
    assert decontaminate.report(d.limit(0), b).collect() == []
    assert not any(r["contaminated"] for r in decontaminate.report(d, b.limit(0)).collect())


def test_remove(spark):
    docs, items = made(5)
    d, b = frames(spark, docs, items)
    bad = {r[0] for r in brute(docs, items) if r[5]}
    assert sorted(r["doc_id"] for r in decontaminate.remove(d, b).collect()) == sorted(i for i, _ in docs if i not in bad)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove(d, b, spans=True).collect()}
    hits = {r[0]: r[2] for r in brute(docs, items)}
    for doc_id, text in docs:
        assert len(words(cut[doc_id])) == len(words(text)) - hits[doc_id]
        assert hits[doc_id] or cut[doc_id] == text


@pytest.mark.parametrize("limit", [10**6, 0])
def test_repeated_rows_long_texts_and_clashing_names(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    item = " ".join(f"w{i}" for i in range(12))
    long = "filler " * 60_000 + item + " end" * 500
    docs = [(1, item, 1), (1, item, 1), (1, item, 2), (2, "none", 3), (2, "none", 3), (None, None, 4), (None, None, 4), (3, long, 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, _id long").selectExpr("*", "_id as _key", "_id as spans", "_id as copies", "_id as n_chars", "_id as row")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"]) for r in decontaminate.report(d, b).collect()), key=str)
    assert got == sorted([(1, 12, 12)] * 3 + [(2, 1, 0)] * 2 + [(None, 0, 0)] * 2 + [(3, 60_512, 12)], key=str)
    kept = decontaminate.remove(d, b)
    assert kept.columns == d.columns and sorted(r["_key"] for r in kept.collect()) == [3, 3, 4, 4]
    cut = decontaminate.remove(d, b, spans=True)
    assert cut.columns == d.columns and sorted((r["spans"], len(r["text"])) for r in cut.collect() if r["spans"] != 4) == [(1, 0), (1, 0), (2, 0), (3, 4), (3, 4), (5, 7 * 60_000 + 4 * 500 - 1)]
