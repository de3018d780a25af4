"""Operator 6, benchmark decontamination: test n-grams found in documents, with DataFrame functions only.

Texts are lower-cased in A-Z and cut into words. The windows of a benchmark item are its runs of ``n`` words; an
item of fewer words, but not none, is one window. The windows' hashes are a broadcast hash set (after a check of
its size; beyond it, the same join is shuffled); every word position of a document probes it, and a hit counts
only if the words themselves are equal. The words inside any hit window are hit words.

One pass over the documents: an extra probe at the end of each document always matches, so documents without hits
come out of the same join, and one small aggregation by document follows.

Defined results: null and empty texts have no words and no hits; rows equal in doc_id and text are found once (``scan``),
but each has its row in the report; very long texts are cut into words whole, in one row; items with equal ids are one item; windows of an item without an id hit words
and contaminate, but the item is not counted or named; items without words hit nothing; with an empty benchmark
nothing is hit. Other columns are ignored (``scan``) or kept (``remove``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The same borders before lower-casing.
RAW_SEPARATOR, RAW_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More windows than this are not broadcast: at about 200 bytes each, 100 MB.
BROADCAST_WINDOWS = 500_000
#: The hash of the probe that ends each document.
_LAST = 0


def words_of(text: Column) -> Column:
    """The normalised words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR + "+"), "")


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, gram (array of words): each distinct window of each item."""
    words = F.col("words")
    count = F.size(words)
    grams = F.when(count >= n, F.transform(F.sequence(F.lit(1), F.greatest(count - n + 1, F.lit(1))), lambda i: F.slice(words, i, n))).when(count > 0, F.array(words))
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words"))
    return items.select("item_id", F.explode(grams).alias("gram")).distinct()


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, text_key, n_words, spans (array of first and past-the-end word), items (array of ids as sorted strings), copies (equal rows)."""
    grams = benchmark_windows(benchmark, n).withColumn("width", F.size("gram")).withColumn("h", F.xxhash64("gram"))
    sizes = {r["width"]: r["windows"] for r in grams.groupBy("width").agg(F.count("*").alias("windows")).collect()}  # at most n rows
    last = docs.sparkSession.range(1).select(F.lit(None).cast(grams.schema["item_id"].dataType).alias("item_id"), F.array().cast("array<string>").alias("gram"), F.lit(0).alias("width"), F.lit(_LAST).cast("long").alias("h"))
    grams = grams.unionByName(last)
    small = sum(sizes.values()) <= BROADCAST_WINDOWS

    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    probes = own.select("*", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))

    def probe(width: int) -> Column:
        # The hash of an array is that of its elements in order, so these equal the hashes of the grams.
        return F.xxhash64("word", *(F.get("words", F.col("pos") + k) for k in range(1, width)))

    at_end = F.when(F.col("pos") == F.col("n_words"), F.lit(_LAST).cast("long"))
    widths = sorted(sizes)
    keyed = [at_end.when(F.col("pos") <= F.col("n_words") - w, probe(w)) if i == 0 else F.when(F.col("pos") <= F.col("n_words") - w, probe(w)) for i, w in enumerate(widths)] or [at_end]
    probes = probes.withColumn("h", keyed[0] if len(keyed) == 1 else F.explode(F.array(*keyed))).where(F.col("h").isNotNull())
    found = F.slice("words", F.col("pos") + 1, F.col("width"))
    if small:
        hits = probes.join(F.broadcast(grams), "h").where(found == F.col("gram"))
    else:
        # The ends of all documents would be one hot key of a shuffled join, so they are added to its hits.
        wide = probes.where(F.col("pos") < F.col("n_words")).select("doc_id", "text_key", "n_words", "pos", "h", F.slice("words", F.col("pos") + 1, max(widths)).alias("ahead"))
        columns = ["doc_id", "text_key", "n_words", "pos", "width", "item_id"]
        hits = wide.join(grams.where("width > 0"), "h").where(F.slice("ahead", F.lit(1), F.col("width")) == F.col("gram")).select(columns)
        ends = own.select("doc_id", "text_key", "n_words", F.col("n_words").alias("pos"), F.lit(0).alias("width"), F.lit(None).cast(grams.schema["item_id"].dataType).alias("item_id"))
        hits = hits.unionByName(ends)
    real = F.col("width") > 0
    return hits.groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(real, F.struct(F.col("pos").alias("first"), (F.col("pos") + F.col("width")).alias("past"))))).alias("spans"),
        F.array_sort(F.collect_set(F.when(real, F.col("item_id").cast("string")))).alias("items"),
        F.count_if(~real).cast("int").alias("copies"),
    )


def covered(spans: Column) -> Column:
    """How many words lie in any of the sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    return F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["past"] - F.greatest(s["first"], a["reach"]))).cast("long").alias("n"),
            F.greatest(a["reach"], s["past"]).cast("long").alias("reach"),
        ),
        lambda a: a["n"],
    )


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for every row of ``docs``."""
    n_hit = F.col("n_hit")
    found = scan(docs, benchmark, n).withColumn("n_hit", covered(F.col("spans")))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 10, spans: bool = False) -> DataFrame:
    """``docs`` without the contaminated documents, or with their hit words cut out of the text (``spans``).

    All columns and repeated rows stay; a word is cut with the separators that follow it, and ``n_chars``, if there,
    is counted anew.
    """
    found = scan(docs, benchmark, n).where(F.size("spans") > 0).select(F.col("doc_id").alias("id"), "text_key", F.col("spans").alias("spans"))
    d, f = docs.select(F.struct(*docs.columns).alias("row")).alias("d"), found.alias("f")  # callers' columns may have any names
    doc_id, text = F.col("d.row.doc_id"), F.col("d.row.text")
    same = doc_id.eqNullSafe(F.col("f.id")) & (F.xxhash64(text) == F.col("f.text_key"))
    if not spans:
        return d.join(f, same, "left_anti").select("d.row.*")
    words = F.regexp_extract_all(text, F.lit(f"{RAW_WORD}+{RAW_SEPARATOR}*"), F.lit(0))
    left = F.filter(words, lambda _, i: ~F.exists("f.spans", lambda s: (s["first"] <= i) & (i < s["past"])))
    cut = F.concat(F.regexp_extract(text, f"^{RAW_SEPARATOR}*", 0), F.array_join(left, ""))
    hit = F.col("f.spans").isNotNull()
    new = {"text": F.when(hit, cut).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.char_length(cut).cast("long")).otherwise(F.col("d.row.n_chars"))
    return d.join(f, same, "left").select(*(new.get(c, F.col("d.row").getField(c)).alias(c) for c in docs.columns))


#: The report in DuckDB.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS gram, least(10, len(w)) AS width
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM g),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
h AS (
  SELECT p.doc_id, p.i, g.item_id, g.width FROM p JOIN widths ON p.i + widths.width - 1 <= len(p.w)
  JOIN g ON g.width = widths.width AND g.gram = list_slice(p.w, p.i, p.i + widths.width - 1)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
