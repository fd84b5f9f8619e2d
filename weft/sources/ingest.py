"""The ingest run: raw text files of a graph to relations, labels and a manifest."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.relations import reverse_differences
from . import hgb

FILES = ("node.dat", "link.dat", "label.dat", "label.dat.test", "info.dat")


def ingest(spark: SparkSession, raw: str, out: str, multilabel: bool = False, expected: dict[int, int] | None = None) -> dict:
    """Read the five files of ``raw``, check them, and write ``relations``, ``labels`` and ``manifest`` under ``out``.

    Stops on malformed lines, node types that don't fill a block of ids, counts other than
    ``expected``, labels out of range, and nodes in both label files. The manifest, which is also
    returned, has a row's worth for each type, relation and pair of opposite relations; edges and
    labels stay distributed.
    """
    catalog = hgb.read_catalog(spark, f"{raw}/info.dat")
    shifts = hgb.type_shifts(hgb.read_nodes(spark, f"{raw}/node.dat"))
    types = {r["node_type"]: r for r in shifts.orderBy("node_type").collect()}
    if not all(r["contiguous"] for r in types.values()):
        raise ValueError("the ids of a node type must fill a block")
    counts = {t: r["n"] for t, r in types.items()}
    if expected is not None and counts != expected:
        raise ValueError(f"node counts {counts} are not {expected}")
    known = catalog.first()
    links = {int(k): (int(v["start"]), int(v["end"]), v["meaning"]) for k, v in known["link.dat"].items()}
    names = known["label.dat"]["0"]

    edges = hgb.read_edges(spark, f"{raw}/link.dat")
    hgb.write_relations(hgb.local_edges(edges, catalog, shifts).select("rel", "i", "j", F.col("w").cast("float").cast("double").alias("w")), f"{out}/relations")
    records = {r["rel"]: r["n"] for r in edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n")).collect()}
    stored = spark.read.parquet(f"{out}/relations").groupBy("rel").agg(F.count(F.lit(1)).alias("n"))
    stored = {r["rel"]: r["n"] for r in stored.collect()}

    train, test = (hgb.read_labels(spark, f"{raw}/{f}", types[0]["shift"], len(names), multilabel) for f in ("label.dat", "label.dat.test"))
    hgb.write_labels(train, test, f"{out}/labels")
    labels = {"class_count": len(names), "class_names": dict(names), "multilabel": multilabel}
    one = F.sum("bit") if multilabel else F.count(F.lit(1))
    for name, part in zip(("train", "test"), hgb.load_split(spark, f"{out}/labels"), strict=True):
        r = part.agg(F.countDistinct("node").alias("n"), one.alias("assigned")).first()
        labels |= {name: r["n"], f"{name}_assignments": r["assigned"], f"{name}_mean_cardinality": r["assigned"] / r["n"] if r["n"] else 0.0}

    checks = []
    for a, (start, end, _) in sorted(links.items()):
        for b, (other_start, other_end, _) in sorted(links.items()):
            if a < b and (start, end) == (other_end, other_start):
                left, right = (hgb.read_relation(spark, f"{out}/relations", rel) for rel in (a, b))
                n = reverse_differences(left, right).first()["n_differences"]
                checks.append({"relations": [a, b], "exact_transposes": n == 0, "difference_nonzero": n})

    hashes = hgb.file_hashes(spark, ",".join(f"{raw}/{f}" for f in FILES)).collect()
    manifest = {
        "node_counts": {str(t): n for t, n in counts.items()},
        "node_shifts": {str(t): r["shift"] for t, r in types.items()},
        "relations": {
            str(rel): {"source_type": s, "target_type": e, "meaning": m, "shape": [counts[s], counts[e]], "records": records.get(rel, 0), "nonzero": stored.get(rel, 0)}
            for rel, (s, e, m) in sorted(links.items())
        },
        "labels": labels,
        "reverse_relation_checks": checks,
        "raw_sha256": {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in hashes},
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    return manifest
