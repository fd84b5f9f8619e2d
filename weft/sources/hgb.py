"""Text sources of heterogeneous graphs: node, link and label files, the catalog, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LINKS = "map<string, struct<start: string, end: string, meaning: string>>"
_NAMES = "map<string, map<string, string>>"

# Relation ids of the published meta-paths, half and full.
META_PATHS = {
    "ACM": {"PAP": ([2], [2, 3]), "PSP": ([4], [4, 5]), "PTP": ([6], [6, 7])},
    "DBLP": {"APA": ([0], [0, 3]), "APTPA": ([0, 1], [0, 1, 4, 3]), "APVPA": ([0, 2], [0, 2, 5, 3])},
    "IMDB": {"MDM": ([0], [0, 1]), "MAM": ([2], [2, 3]), "MKM": ([4], [4, 5])},
}


def _fields(spark: SparkSession, path: str, least: int, most: int | None = None) -> DataFrame:
    """Lines as arrays of tab-separated fields; a line with too few or too many stops the query."""
    parts = F.split("value", "\t")
    wrong = (F.size(parts) < least) | ((F.size(parts) > most) if most else F.lit(False))
    bad = F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("array<string>")
    return spark.read.text(path).where("value <> ''").select(F.when(wrong, bad).otherwise(parts).alias("f"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row: `link.dat`, relation id to start, end and meaning; `label.dat`, node type to class names.

    The maps stand under "link type" and "node type" in published catalogs, or directly under the file's name."""
    text = spark.read.text(path, wholetext=True)
    nested = F.from_json("value", f"`link.dat` struct<`link type`: {_LINKS}>, `label.dat` struct<`node type`: {_NAMES}>")
    flat = F.from_json("value", f"`link.dat` {_LINKS}, `label.dat` {_NAMES}")
    both = text.select(nested.alias("n"), flat.alias("f"))
    links = F.coalesce(F.col("n.`link.dat`.`link type`"), F.col("f.`link.dat`")).alias("link.dat")
    return both.select(links, F.coalesce(F.col("n.`label.dat`.`node type`"), F.col("f.`label.dat`")).alias("label.dat"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, name, node_type) of a node file with at least three fields a line."""
    f = _fields(spark, path, 3)
    return f.select(f.f[0].cast("long").alias("node_id"), f.f[1].alias("name"), f.f[2].cast("int").alias("node_type"))


def type_shifts(nodes: DataFrame) -> DataFrame:
    """Per type: n, shift (its first id) and whether its ids fill the block from there."""
    per = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi"))
    shift = F.sum("n").over(Window.partitionBy().orderBy("node_type")) - F.col("n")
    return per.withColumn("shift", shift).select(
        "node_type", "n", "shift", ((F.col("lo") == F.col("shift")) & (F.col("hi") == F.col("shift") + F.col("n") - 1)).alias("contiguous")
    )


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, rel, w) of a link file with exactly four fields a line, global ids."""
    f = _fields(spark, path, 4, 4)
    return f.select(
        f.f[0].cast("long").alias("src"), f.f[1].cast("long").alias("dst"), f.f[2].cast("int").alias("rel"), f.f[3].cast("double").alias("w")
    )


def local_edges(edges: DataFrame, catalog: DataFrame, shifts: DataFrame) -> DataFrame:
    """Edges with ids local to their types: (rel, i, j, w), duplicates summed."""
    kinds = catalog.select(F.explode("`link.dat`").alias("rel", "d")).select(
        F.col("rel").cast("int").alias("rel"), F.col("d.start").cast("int").alias("s"), F.col("d.end").cast("int").alias("e")
    )
    start = shifts.select(F.col("node_type").alias("s"), F.col("shift").alias("ss"))
    end = shifts.select(F.col("node_type").alias("e"), F.col("shift").alias("es"))
    dims = F.broadcast(kinds.join(start, "s").join(end, "e").select("rel", "ss", "es"))
    joined = edges.join(dims, "rel")
    return joined.groupBy("rel", (F.col("src") - F.col("ss")).alias("i"), (F.col("dst") - F.col("es")).alias("j")).agg(F.sum("w").alias("w"))


def read_labels(spark: SparkSession, path: str, shift: int, classes: int, multilabel: bool) -> DataFrame:
    """(node, label), or (node, class, bit) for several labels, of a label file with at least four
    fields a line. A class out of range, several classes where one is meant, or a repeated id stops
    the query."""
    f = _fields(spark, path, 4)
    ids = f.select((f.f[0].cast("long") - shift).alias("node"), F.transform(F.split(f.f[3], ","), lambda x: x.cast("int")).alias("c"))
    wrong = (F.array_min("c") < 0) | (F.array_max("c") >= classes) | ((F.size("c") != 1) if not multilabel else F.lit(False))
    n = F.count(F.lit(1)).over(Window.partitionBy("node"))
    bad = F.raise_error(F.concat(F.lit("bad label row of node "), F.col("node").cast("string"))).cast("array<int>")
    ids = ids.withColumn("n", n).withColumn("c", F.when(wrong | (F.col("n") > 1), bad).otherwise(F.col("c")))
    if not multilabel:
        return ids.select("node", F.col("c")[0].alias("label"))
    every = F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("class")
    return ids.select("node", "c", every).select("node", "class", F.array_contains("c", F.col("class")).cast("int").alias("bit"))


def read_legacy_labels(spark: SparkSession, path: str) -> DataFrame:
    """(node, label) from the first and fourth field of a label file, ids as they stand there."""
    f = _fields(spark, path, 4)
    return f.select(f.f[0].cast("long").alias("node"), f.f[3].cast("int").alias("label"))


def write_labels(train: DataFrame, test: DataFrame, path: str) -> None:
    """Both label tables, partitioned by split; a node in both is an error."""
    if not train.select("node").intersect(test.select("node")).isEmpty():
        raise ValueError("train and test labels share nodes")
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    both.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Training and test labels."""
    whole = spark.read.parquet(path)
    return tuple(whole.where(F.col("split") == s).drop("split") for s in ("train", "test"))


def load_training_labels(spark: SparkSession, path: str) -> DataFrame:
    """Training labels alone; the other partition is not read."""
    return spark.read.parquet(path).where(F.col("split") == "train").drop("split")


def load_test_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the test nodes without their labels, for predictions before any truth is read."""
    return spark.read.parquet(path).where(F.col("split") == "test").select("node").distinct()


def meta_path(spark: SparkSession, path: str, dataset: str, name: str, full: bool = False) -> list[DataFrame]:
    """The relations of a published meta-path, its half or the whole; an unknown one is an error."""
    if name not in META_PATHS.get(dataset, {}):
        raise ValueError(f"{dataset} has no meta-path {name}")
    return [read_relation(spark, path, rel) for rel in META_PATHS[dataset][name][full]]


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, by a binary scan."""
    return spark.read.format("binaryFile").load(path.split(",")).select("path", F.sha2("content", 256).alias("sha256"))


def fingerprint(ids: DataFrame) -> DataFrame:
    """16 hex digits over the ids in order of pos; the order matters. ``ids``: pos, id."""
    joined = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"].cast("string")))
    return ids.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


def write_relations(relations: DataFrame, path: str) -> None:
    """Parquet partitioned by relation, so that a relation is read alone."""
    relations.write.partitionBy("rel").parquet(path)


def read_relation(spark: SparkSession, path: str, rel: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("rel") == rel).select("i", "j", "w")


def write_report(rows: DataFrame, path: str) -> None:
    """Append rank, id and value as lines of text."""
    rows.select(F.format_string("%d\t%s\t%.6f", F.col("rank"), F.col("r").cast("string"), F.col("score")).alias("value")).write.mode("append").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
