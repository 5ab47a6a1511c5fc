"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the
    edges ``a``, ``b`` except the roots themselves.

    Alternates large and small stars: each node's larger neighbours, then its
    smaller ones, are tied to the least of them, until nothing changes; the
    number of rounds grows with the logarithm of the longest path.  Minima
    are combined before the shuffle, so a node with very many edges is no
    large group; each round is stored in the shared folder.
    """
    e = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct()
    e, seen = written(e, "edges"), None
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = written(small.union(low.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if now == seen:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = now


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` as ``components`` gives them, once more links (``a``, ``b``)
    tie components, or nodes that had none: only those are gone through."""
    for side in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
    over = components(links.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    moved = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return written(moved.select("node", F.coalesce("top", "root").alias("root")).union(over), "roots")
