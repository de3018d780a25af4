"""Connected components of a distributed edge table (union-find by labels), with DataFrame functions only.

Every node starts with the smallest id among itself and its neighbours; each round takes the smallest label of the
neighbours and then the label of the label, so long chains shrink by doubling. Joins read tables in the shared
folder on both sides, so a node with very many edges is split by adaptive execution; minima are combined before
they are shuffled. The driver sees one number a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, keep

WIDE = 16


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (smallest id of its component) of all nodes of ``edges`` (a, b).

    Loops, repeated edges and edges with a null end are allowed; the latter link nothing. No edges, no nodes.
    """
    own = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = keep(own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = keep(labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label")), "labels")
        target = spread.select(F.col("node").alias("label"), F.col("label").alias("after"))
        jumped = keep(spread.join(target, "label").select("node", "before", F.col("after").alias("label")), "labels")
        changed = jumped.where("label <> before").limit(1).count()
        discard(labels, spread)
        labels = jumped.select("node", "label")
        labels._quoteloom_path = jumped._quoteloom_path
        if not changed:
            discard(both)
            return labels


def components_by_keys(keys: DataFrame, verify, also: DataFrame | None = None, wide_pairs=None) -> DataFrame:
    """node, label: components of the pairs of nodes that share a key and pass ``verify``; no pair is missed.

    keys: k, node, n (how many nodes the key has), without repeated rows. verify: DataFrame (a, b) of pairs to a DataFrame (a, b) of those that link.
    also: further pairs (a, b), a < b, to verify. wide_pairs: how keys of more than WIDE nodes are searched, from a
    DataFrame (node, label, centre) to pairs (a, b), a < b; without it they are searched as the others are.

    First every node is held against one centre: of the nodes that it shares a key with and that are the heaviest of that
    key, the one whose keys have the most nodes in all, so of copies with different changes the original. These are no
    more pairs than nodes. Then it is held against the centres of its other keys that are in other components, and at last,
    in keys whose nodes are still in different components, all pairs of nodes of different components are. So the pairs
    within a component that its keys share are never written out.
    """
    weights = keep(keys.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    weighted = keep(keys.join(weights, "node"), "weighted")
    centres = weighted.groupBy("k").agg(F.max(F.struct("weight", "node")).alias("top"))
    centred = keep(weighted.join(centres, "k").select("k", "node", "n", F.col("top.node").alias("centre"), F.col("top.weight").alias("of")), "centres")
    discard(weights, weighted)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    best = centred.where("node <> centre").groupBy("node").agg(F.max(F.struct("of", "centre"))["centre"].alias("centre"))
    star = keep(best.select(*pair("node", "centre")).distinct(), "star")
    links = verify(star)
    labels = connected_components(links)

    def labelled(rows: DataFrame, *names: str) -> DataFrame:
        for name in names:
            found = labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
            rows = rows.join(found, name, "left").withColumn(f"{name}_label", F.coalesce(f"{name}_label", name))
        return rows

    others = centred.where("node <> centre").select("node", "centre").distinct()
    others = labelled(others, "node", "centre").where("node_label <> centre_label").select(*pair("node", "centre")).distinct()
    second = keep(others.join(star, ["a", "b"], "left_anti"), "star")
    links = links.union(verify(second))
    discard(labels)
    labels = connected_components(links)
    tried = star.union(second)
    named = keep(labelled(centred, "node").withColumnRenamed("node_label", "label"), "labelled")
    mixed = named.groupBy("k").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first <> last").select("k")
    rest = keep(named.join(mixed, "k"), "open-keys")
    narrow = rest.where(F.col("n") <= WIDE) if wide_pairs else rest
    pairs = narrow.alias("x").join(narrow.alias("y"), F.expr("x.k = y.k and x.node < y.node and x.label <> y.label"))
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    if wide_pairs:
        pairs = pairs.union(wide_pairs(rest.where(F.col("n") > WIDE).select("node", "label", "centre").distinct())).distinct()
    if also is not None:
        pairs = pairs.union(also).distinct()
    more = verify(pairs.join(tried, ["a", "b"], "left_anti"))
    out = connected_components(links.union(more))
    discard(labels, rest, named, star, second, centred)
    return out
