"""Relations kept up to date from a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relation_updates(edges: DataFrame) -> DataFrame:
    """A streaming frame of edges (src, dst, rel, weight) as running sums (rel, i, j, w).

    Write it in update mode; state is one sum for each coordinate.
    """
    return edges.groupBy("rel", F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum("weight").alias("w"))
