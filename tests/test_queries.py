"""Each similarity query against its SQL at the smallest scale."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.plans import protocols
from weft.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(protocols.SQL))
def test_matches_sql(spark, con, name):
    got, want = protocols.QUERIES[name](spark, DATA).toPandas(), con.sql(protocols.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    keys = [c for c in cols if got[c].dtype.kind in "iuO"]
    keys += [c for c in cols if c not in keys]
    got, want = (f[cols].sort_values(keys).reset_index(drop=True) for f in (got, want))
    for c in cols:
        if got[c].dtype.kind == "f":
            a, b = got[c].to_numpy(float), want[c].to_numpy(float)
            assert np.array_equal(a, b, equal_nan=True), c
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


@pytest.mark.parametrize("name", sorted(set(protocols.QUERIES) - set(protocols.SQL)))
def test_rows(spark, name):
    assert protocols.QUERIES[name](spark, DATA).count() > 0


def test_multilabel_pipeline_takes_the_whole_grid_from_training(spark, monkeypatch):
    grid = Q.multilabel_pipeline_grid(spark, DATA).select("g", "k", "gamma", "prior", "threshold").distinct()
    assert grid.count() == 480
    own, want = Q.label_bits, Q.multilabel_pipeline_select(spark, DATA).collect()
    hidden = F.when(Q.is_test("node"), 1 - F.col("bit")).otherwise(F.col("bit"))
    monkeypatch.setattr(Q, "label_bits", lambda s, d: own(s, d).withColumn("bit", hidden))
    assert Q.multilabel_pipeline_select(spark, DATA).collect() == want
