"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrilith.operators.tables import Scratch


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternates the large-star and small-star steps: each edge moves to the smallest
    neighbour of its ends, so that a component becomes a star in a few rounds whatever its
    diameter. Both steps are an aggregation and an equi-join; no neighbour list is gathered.
    Loops and repeated edges are allowed; edges with a null end are left out. A round's
    tables go when the next one is written.
    """
    kept = Scratch(edges.sparkSession, "components")
    e = edges.filter(F.col(u).isNotNull() & F.col(v).isNotNull()).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    first = kept.write(e.distinct(), "edges")
    loops = first.select("u").union(first.select("v")).distinct().withColumnRenamed("u", "node")
    e, last = first.filter("u != v"), None
    before = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while True:
        # large star: all larger neighbours of a node join its smallest one
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = kept.write(both.filter("v > u").join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: a node and its smaller neighbours join the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = kept.write(small.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        kept.drop(large, last)
        e = last = after
        now = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return loops.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
