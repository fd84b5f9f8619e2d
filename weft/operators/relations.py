"""Relations and meta-path chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build(edges: DataFrame, src: str, dst: str, weight: Column | None = None, by_dimension: bool = False) -> DataFrame:
    """Sum duplicate edges into (i, j, w); without a weight each edge counts 1. ``by_dimension`` deals edges out by
    their end, so that lists of a dimension's members need no further shuffle."""
    w = (weight if weight is not None else F.lit(1)).cast("double")
    ends = edges.select(F.col(src).alias("i"), F.col(dst).alias("j"), w.alias("_w"))
    return (ends.repartition("j") if by_dimension else ends).groupBy("i", "j").agg(F.sum("_w").alias("w"))


def transpose(rel: DataFrame) -> DataFrame:
    return rel.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")


def row_normalize(rel: DataFrame) -> DataFrame:
    """Divide by the row sum; rows that sum to zero stay zero."""
    sums = rel.groupBy("i").agg(F.sum("w").alias("_s"))
    return rel.join(sums, "i").select("i", "j", F.coalesce(F.try_divide("w", "_s"), F.lit(0.0)).alias("w"))


def chain(hops: list[DataFrame], normalize: bool = False) -> DataFrame:
    """Left-deep product of relations, summed after each hop; explicit zeros are dropped at the end.

    ``normalize`` makes every hop row-stochastic first, which differs from normalising the product.
    """
    if not hops:
        raise ValueError("a path needs a relation")
    hops = [row_normalize(h) for h in hops] if normalize else hops

    def step(cur: DataFrame, hop: DataFrame) -> DataFrame:
        a = cur.select("i", F.col("j").alias("_m"), F.col("w").alias("_a"))
        b = hop.select(F.col("i").alias("_m"), "j", F.col("w").alias("_b"))
        return a.join(b, "_m").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("w"))

    return reduce(step, hops).where("w <> 0")


def edge_objects(rel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a binary relation in two halves that meet in one artificial object for each edge."""
    edge = rel.select("i", "j", F.xxhash64("i", "j").alias("_h"), F.struct("i", "j").alias("e"))
    return (
        edge.select("i", F.col("e").alias("j"), F.lit(1.0).alias("w")),
        edge.select(F.col("j").alias("i"), F.col("e").alias("j"), F.lit(1.0).alias("w")),
    )


def reverse_differences(rel: DataFrame, other: DataFrame) -> DataFrame:
    """One row: how many coordinates of ``rel`` and the transpose of ``other`` differ."""
    a = rel.select("i", "j", F.col("w").alias("_a"))
    b = transpose(other).select("i", "j", F.col("w").alias("_b"))
    differs = F.coalesce("_a", F.lit(0.0)) != F.coalesce("_b", F.lit(0.0))
    return a.join(b, ["i", "j"], "full_outer").agg(
        F.coalesce(F.sum(differs.cast("long")), F.lit(0)).alias("n_differences"), F.count(F.lit(1)).alias("n_coordinates")
    )


def violations(profile: DataFrame) -> DataFrame:
    """One row: stored values, and how many are negative or not finite."""
    bad = F.isnan("w") | (F.abs("w") == float("inf")) | (F.col("w") < 0) | F.col("w").isNull()
    return profile.agg(F.count(F.lit(1)).alias("n_values"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("n_bad"))


def require_same_dimensions(left: DataFrame, right: DataFrame, left_dims: int, right_dims: int) -> None:
    """Two profiles can only be compared over the same dimensions: as many on both sides, and no id beyond them."""
    if left_dims != right_dims:
        raise ValueError(f"profiles have {left_dims} and {right_dims} dimensions")
    for side in (left, right):
        most = side.agg(F.max("j")).first()[0]
        if most is not None and most >= left_dims:
            raise ValueError(f"a profile has dimension {most} of {left_dims}")


def split_exactly(rel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edge_objects`` of a binary relation; other weights, whose halves would not multiply to it, are an error."""
    if not rel.where("w <> 1").isEmpty():
        raise ValueError("only a binary relation can be split by its edges")
    return edge_objects(rel)


def require_nonnegative(profile: DataFrame) -> DataFrame:
    """The profile; a negative or non-finite value stops the query when it is read."""
    bad = F.isnan("w") | (F.abs("w") == float("inf")) | (F.col("w") < 0)
    w = F.when(bad, F.raise_error(F.lit("profile values must be finite and non-negative")).cast("double")).otherwise(F.col("w"))
    return profile.withColumn("w", w)
