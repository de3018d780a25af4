import random
import zlib

import numpy as np
import pyarrow as pa

from quoteloom.llm import quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs, labels))
    assert scored.count() == docs.count()
    held = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert (held["predicted"] == held["quality"]).mean() >= 0.9
    assert held["score"].between(0, 1).all()
    for r in scored.limit(20).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3)


def slow_score(t, x):
    total = t.base
    for root in t.roots:
        at = root
        while t.left[at] != at:
            at = t.left[at] if x[t.feature[at]] <= t.threshold[at] else t.right[at]
        total += t.value[at]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_equal_walks():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    model = quality.fit(x, y, trees=30)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    assert np.allclose(model.score(x[:50]), [slow_score(model, r) for r in x[:50]])
    assert (model.score(x) == quality.fit(x, y, trees=30).score(x)).all()


def test_statistics_do_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = ["", None, "a", "ABC!! DEF!!", "x | y | z | w\nx | y | z | w", "é" * 50 + "\n\n" + "q. " * 9] + ["".join(rng.choice("aB .\n|$é1") for _ in range(rng.randrange(300))) for _ in range(40)]
    together = quality.statistics(pa.array(texts, pa.string()))
    assert together.shape == (len(texts), len(quality.STATISTICS)) and np.isfinite(together).all()
    for i, t in enumerate(texts):
        assert np.allclose(together[i], quality.statistics(pa.array([t], pa.string()))[0])
    row = dict(zip(quality.STATISTICS, together[3]))
    assert row["shouted_words"] == 1 and row["bang"] == 4 / 11 and row["marked_words"] == 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "word", 0.5), (1, "x", 0.5), (1, "x", 0.5)], "doc_id long, text string, score double")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, empty)).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 77, None)] + [(2, None, 0)], empty.schema)
    assert all(r["score"] > 0.5 for r in quality.score(docs, quality.train(docs, one)).collect())
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), one)).collect() == []
    assert quality.keep(docs, quality.train(docs, one)).count() == 5


def test_repeated_and_long_documents(spark):
    """Rows of one id are one document of the fit, however many there are, so repeats change no score; long texts are read whole."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    again = quality.train(docs.union(docs).union(docs.where("doc_id < 20")), labels.union(labels))
    long = spark.createDataFrame([(1, "word " * 300_000), (2, ""), (3, None)], "doc_id long, text string")
    rows = lambda m: sorted(map(tuple, quality.score(docs.select("doc_id", "text").union(long), m).collect()))
    assert rows(model) == rows(again)
