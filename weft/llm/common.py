"""Shared helpers: durable intermediate tables, bounded samples of labelled rows, fold rule."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that every executor shares, from ``spark.checkpoint.dir``.

    Only a local master may run without that setting; it then gets a folder under the
    machine's temporary directory. A cluster without the setting is an error, because a
    machine-local folder would not be seen by the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + os.path.join(tempfile.gettempdir(), "weft-scratch")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the application's own folder, which can go when the application has ended."""
    return f"{scratch_root(spark)}/weft-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    A lost executor costs only the tasks that ran on it: what was written stays readable, until
    ``release`` deletes it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` that nothing will read again; other DataFrames are left alone."""
    for table in tables:
        path = vars(table).get("scratch")
        if path:
            sc = table.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


#: Keys of rows to leave out that are sent to every executor, 8 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def row_key(id_col: str, text_col: str) -> Column:
    """One number for an id with its text; a null text counts as empty, a null id as an id of its own."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose ``row_key`` is in the only column of ``gone``; all columns stay.

    Rows are told apart by id and text, so a repeated id loses only the text that was meant. The
    keys are written and counted first: up to BROADCAST_ROWS are broadcast and no text is shuffled.
    """
    name = "_gone"
    while name in docs.columns:
        name += "_"
    gone = durable(gone.toDF(name).distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, row_key(id_col, text_col) == F.col(name), "left_anti")


#: Rows in a batch that goes to Python, and bytes of text that are worked on at once.
ARROW_ROWS = 1000
TEXT_BYTES = 1 << 19


def small_batches(spark: SparkSession) -> None:
    """Keep batches to Python small, so that memory is bounded by a few long texts, not by many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``most`` bytes of text in ``column``, a row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, giving freed memory back at its end: workers stay alive between tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id written as text, modulo 5; 0 marks a held-out row."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, max_rows: int) -> list[tuple[str, int]]:
    """At most ``max_rows`` labelled training rows (text, 0/1), never a held-out row.

    The rows are those with the smallest hash of their id, so the choice depends on neither
    partitioning nor order. ``max_rows`` is the documented bound on what reaches the driver.
    The ids are chosen from the small label table first; only their texts are then read.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(target).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(max_rows)
        .select("text", "y")
        .collect()
    )
    return [(r["text"] or "", int(r["y"])) for r in rows]
