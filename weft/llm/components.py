"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is the smallest node.

    Each step is a grouping with map-side combination and a join, written to the shared folder;
    nothing but a count and a checksum reaches the driver. Loops, repeated edges and an empty
    table are fine; edges with a null end are ignored.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    now = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = durable(now.select(hi.alias("hi"), lo.alias("lo")).distinct(), "edges")
    before = None
    while True:  # ends: each step lowers some node's parent, in the order of the squared logarithm of the nodes
        sign = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if sign[0] == 0 or sign == before:
            break
        before = sign
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(lowest, "hi")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .where("hi <> lo")
            .unionByName(lowest.select("hi", F.col("m").alias("lo")))
        )
        now, old = durable(small.distinct(), "edges"), now
        release(old)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
