"""Exact dedup by a heavy-hitter split, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_rows, durable, row_key

#: Counters of the Misra-Gries summary, and how many of its items become candidates. Both
#: are fixed, so what is broadcast (at most HOT_ITEMS digests) does not grow with the data.
SUMMARY_ITEMS = 4096
HOT_ITEMS = 256


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    summary_items: int = SUMMARY_ITEMS,
    hot_items: int = HOT_ITEMS,
) -> DataFrame:
    """Group rows by equal text and name the row that stays: the one with the largest id.

    One row per input row: id, keep_id, group_size, kept, text_sha256.

    1. Every text becomes its SHA-256; only (id, digest) is stored and shuffled.
    2. Spark's ``approx_top_k`` (a frequent-items sketch of the Misra-Gries family, merged
       map-side) proposes frequent digests. Each is verified by an exact count and maximum.
    3. The verified winners (at most ``hot_items`` rows) are broadcast, so copies of frequent
       texts are settled where they lie. All other digests take an ordinary shuffle, in which
       no group is larger than the sketch's error bound, about 1/``summary_items`` of the rows.

    Defined cases: a null text counts as empty; extra columns are ignored; an empty table gives
    an empty result; a null id never wins over another id, and where all ids of a group are
    null keep_id is null and every row of it is kept; rows that repeat both id and text are the
    same document and share one flag.
    """
    return _settle(docs, id_col, text_col, summary_items, hot_items).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _settle(docs: DataFrame, id_col: str, text_col: str, summary_items: int, hot_items: int) -> DataFrame:
    """digest, id, key (of id and text), keep_id and group_size of every row."""
    rows = durable(
        docs.select(
            F.col(id_col).alias("id"),
            row_key(id_col, text_col).alias("key"),
            F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("digest"),
        ),
        "dedup-digests",
    )
    sketch = rows.agg(F.expr(f"approx_top_k(digest, {int(hot_items)}, {int(summary_items)})").alias("top"))
    candidates = sketch.select(F.explode("top").alias("c")).select(F.col("c.item").alias("digest"))
    winners = (
        rows.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > 1)
    )
    winners = durable(winners.coalesce(1), "dedup-winners")
    hot = rows.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest",
        "id",
        "key",
        F.max("id").over(same).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
    )
    return hot.select("digest", "id", "key", "keep_id", "group_size").unionByName(rest)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; all columns stay.

    A row is dropped by its id and its text: where an id repeats, its other texts are left alone,
    and a copy without an id goes like any other.
    """
    rows = _settle(docs, id_col, text_col, SUMMARY_ITEMS, HOT_ITEMS)
    return drop_rows(docs, rows.where(~F.col("id").eqNullSafe(F.col("keep_id"))).select("key"), id_col, text_col)
