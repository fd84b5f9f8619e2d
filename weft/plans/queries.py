"""The queries of the similarity engine on the driver's tables, each with its SQL.

Suppliers are the entities. Two meta-paths link them: supplier-part-supplier (weights count line
items) and supplier-customer-supplier. Labels are regions; the test side is every fifth supplier.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import blocks as B
from ..operators import evaluation as E
from ..operators import pairs as P
from ..operators import ranking as R
from ..operators import relations as L
from ..sources.cache import written

K = 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- inputs

SP = "sp AS (SELECT l_suppkey AS i, l_partkey AS j, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2)"
SC = "sc AS (SELECT l_suppkey AS i, o_custkey AS j, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
LAB = "lab AS (SELECT s_suppkey AS node, n_regionkey::BIGINT AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sp(spark: SparkSession, d: str, by_dimension: bool = False) -> DataFrame:
    return L.build(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", by_dimension=by_dimension)


def sc(spark: SparkSession, d: str, by_dimension: bool = False) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return L.build(items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), "l_suppkey", "o_custkey", by_dimension=by_dimension)


def so(spark: SparkSession, d: str, by_dimension: bool = False) -> DataFrame:
    return L.build(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", by_dimension=by_dimension)


def stored(rel: DataFrame) -> DataFrame:
    """A relation that statistics and pairs read again and again, written once."""
    return written(rel, "relation")


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("long").alias("label"))
    return table(spark, d, "supplier").join(F.broadcast(n), "s_nationkey").select(F.col("s_suppkey").alias("node"), "label")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers with label, -1 without one, and fold, -1 of the test side."""
    fold = F.when(is_test("node"), -1).otherwise(own_fold("node")).cast("long")
    lab = regions(spark, d).withColumnRenamed("label", "_l")
    return suppliers(spark, d).join(lab, "node", "left").select("node", F.coalesce("_l", F.lit(-1)).alias("label"), fold.alias("fold"))


def training_blocks(spark: SparkSession, d: str, *paths: Callable) -> B.Blocks:
    """Blocks of all suppliers with the links of the training side."""
    return B.Blocks(labelled(spark, d), [rel(spark, d, by_dimension=True).where(~is_test("i")) for rel in paths])


def is_test(c: str) -> Column:
    return F.col(c) % 5 == 0


def sp_pairs(spark: SparkSession, d: str, normalized: bool = False) -> DataFrame:
    rel, nodes = sp(spark, d), suppliers(spark, d)
    return P.all_pairs(nodes, rel, nodes, rel, normalized)


def stats_sql(rel: str, out: str) -> str:
    return (
        f"{out}_d AS (SELECT count(DISTINCT j) AS dims FROM {rel}), "
        f"{out}_o AS (SELECT i, count(*) AS sup, sum(w) AS act, sum(w * w) AS sq, max(w) AS mx, min(w) AS mi FROM {rel} GROUP BY i), "
        f"{out} AS (SELECT s_suppkey AS node, coalesce(sup, 0)::BIGINT AS sup, coalesce(act, 0)::DOUBLE AS act, coalesce(sq, 0)::DOUBLE AS sq, "
        f"CASE WHEN coalesce(sup, 0) = dims THEN mx ELSE greatest(coalesce(mx, 0.0::DOUBLE), 0.0::DOUBLE) END AS mx, "
        f"CASE WHEN coalesce(sup, 0) = dims THEN mi ELSE least(coalesce(mi, 0.0::DOUBLE), 0.0::DOUBLE) END AS mi "
        f"FROM supplier LEFT JOIN {out}_o ON s_suppkey = i CROSS JOIN {out}_d)"
    )


def pairs_sql(rel: str = "sp", out: str = "p", bh: bool = False) -> str:
    """CTEs of all pair rows of a relation of suppliers."""
    src = f"(SELECT *, w / sum(w) OVER (PARTITION BY i) AS pw FROM {rel})" if bh else rel
    more = ", sum(sqrt(a.pw) * sqrt(b.pw)) AS bh" if bh else ""
    return (
        f"{stats_sql(rel, out + 's')}, {out}g AS (SELECT a.i AS q, b.i AS r, count(*) AS inter, sum((a.w = b.w)::INT)::BIGINT AS eq, "
        f"sum(a.w * b.w) AS dot, sum(least(a.w, b.w)) AS mn{more} FROM {src} a JOIN {src} b ON a.j = b.j GROUP BY 1, 2), "
        f"{out} AS (SELECT x.node AS q, y.node AS r, x.sup AS sup_q, y.sup AS sup_r, x.act AS act_q, y.act AS act_r, x.sq AS sq_q, y.sq AS sq_r, "
        f"x.mx AS mx_q, y.mx AS mx_r, x.mi AS mi_q, y.mi AS mi_r, coalesce(inter, 0)::BIGINT AS inter, coalesce(eq, 0)::BIGINT AS eq, "
        f"coalesce(dot, 0)::DOUBLE AS dot, coalesce(mn, 0)::DOUBLE AS mn{', coalesce(bh, 0)::DOUBLE AS bh' if bh else ''} "
        f"FROM {out}s x CROSS JOIN {out}s y LEFT JOIN {out}g g ON g.q = x.node AND g.r = y.node)"
    )


def clip(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0.0::DOUBLE)"


PATHSIM = clip(ratio("2.0::DOUBLE * dot", "sq_q + sq_r"))
COSINE = clip(ratio("dot", "sqrt(sq_q) * sqrt(sq_r)"))
JACCARD = ratio("(sup_q + sup_r - inter - inter)::DOUBLE", "(sup_q + sup_r - inter)::DOUBLE")
L1 = "(act_q + act_r - 2.0::DOUBLE * mn)"
BRAY = ratio(L1, "act_q + act_r")
VHAM = "(sup_q + sup_r - inter - eq)"
SHAM = "(sup_q + sup_r - 2 * inter)"


def relative(beta: str, j: str = "j", bc: str = "bc") -> str:
    return clip(f"1.0::DOUBLE - ({beta} * {j} + (1.0::DOUBLE - {beta}) * {bc})")


def adaptive(beta: str, j: str = "j", bc: str = "bc") -> str:
    return clip(f"1.0::DOUBLE - ({bc} + {beta} * greatest({j} - {bc}, 0.0::DOUBLE))")


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


# --- relations, chains, statistics


@query(with_(SP) + "SELECT * FROM sp")
def relation_build(spark, d):
    return sp(spark, d)


@query(
    with_(SP, "ps AS (SELECT l_partkey AS i, l_suppkey AS j, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2)")
    + "SELECT sum((coalesce(a.w, 0) <> coalesce(b.w, 0))::INT)::BIGINT AS n_differences, count(*) AS n_coordinates FROM sp a FULL JOIN ps b ON a.i = b.j AND a.j = b.i"
)
def relation_transpose_check(spark, d):
    return L.reverse_differences(sp(spark, d), L.build(table(spark, d, "lineitem"), "l_partkey", "l_suppkey"))


@query("SELECT count(*) AS n_overlap FROM (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 0 INTERSECT SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0)")
def label_overlap(spark, d):
    s = suppliers(spark, d)
    return s.where(is_test("node")).intersect(s.where(~is_test("node"))).agg(F.count(F.lit(1)).alias("n_overlap"))


@query(with_(SP, stats_sql("sp", "st")) + "SELECT * FROM st")
def node_stats(spark, d):
    return P.node_stats(suppliers(spark, d), sp(spark, d))


@query("SELECT count(*) AS n_values, sum((v < 0 OR isnan(v) OR isinf(v))::INT)::BIGINT AS n_bad FROM (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings)")
def nonnegative_guard(spark, d):
    return L.violations(table(spark, d, "embeddings").select(F.explode(F.col("embedding").cast("array<double>")).alias("w")))


@query(with_(SP) + "SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM sp")
def row_normalize(spark, d):
    return L.row_normalize(sp(spark, d))


CHAIN = "SELECT a.i AS i, b.j AS j, sum(a.w * b.w) AS w FROM {a} a JOIN {b} b ON a.j = b.i GROUP BY 1, 2"
PC = "pc AS (SELECT l_partkey AS i, o_custkey AS j, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@query(with_(SP, PC) + CHAIN.format(a="sp", b="pc"))
def chain_two_hop(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    pc = L.build(items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), "l_partkey", "o_custkey")
    return L.chain([sp(spark, d), pc])


@query(with_(SP, "ps AS (SELECT j AS i, i AS j, w FROM sp)") + CHAIN.format(a="sp", b="ps"))
def chain_full_path(spark, d):
    return L.chain([sp(spark, d), L.transpose(sp(spark, d))])


NORM = "(SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM {})"


@query(
    with_(SP, "ps AS (SELECT j AS i, i AS j, w FROM sp)", f"a AS {NORM.format('sp')}", f"b AS {NORM.format('ps')}")
    + "SELECT a.i AS i, b.j AS j, round(sum(a.w * b.w), 9) AS w FROM a JOIN b ON a.j = b.i GROUP BY 1, 2"
)
def chain_transition(spark, d):
    rel = sp(spark, d)
    return L.chain([rel, L.transpose(rel)], normalize=True).withColumn("w", F.round("w", 9))


@query(
    with_(SP)
    + "SELECT i AS q, j AS r, round(1.0::DOUBLE / (sqrt(count(*) OVER (PARTITION BY i)::DOUBLE) * sqrt(count(*) OVER (PARTITION BY j)::DOUBLE)), 9) AS hetesim FROM sp"
)
def edge_object_hetesim(spark, d):
    left, right = (L.row_normalize(h) for h in L.edge_objects(sp(spark, d).withColumn("w", F.lit(1.0))))
    norm = lambda h: h.groupBy("i").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    dots = P.gram(left, right).select("q", "r", "dot")
    both = dots.join(norm(left).withColumnRenamed("i", "q"), "q").withColumnRenamed("n", "nq").join(norm(right).withColumnRenamed("i", "r"), "r")
    return both.select("q", "r", F.round(M.ratio(F.col("dot"), F.col("nq") * F.col("n")), 9).alias("hetesim"))


@query(
    with_(SP, stats_sql("sp", "st"))
    + "SELECT 'supplier' AS node_type, count(*) AS n_nodes, min(node) AS first_id, max(node) AS last_id, sum(sup)::BIGINT AS n_links, sum((sup = 0)::INT)::BIGINT AS n_unlinked FROM st"
)
def manifest_profile(spark, d):
    return P.node_stats(suppliers(spark, d), sp(spark, d)).agg(
        F.lit("supplier").alias("node_type"),
        F.count(F.lit(1)).alias("n_nodes"),
        F.min("node").alias("first_id"),
        F.max("node").alias("last_id"),
        F.sum("sup").alias("n_links"),
        F.sum((F.col("sup") == 0).cast("long")).alias("n_unlinked"),
    )


# --- measures


def measure(name: str, column: Callable[[], Column], sql: str, digits: int | None = None) -> None:
    wrap = (lambda x: F.round(x, digits)) if digits else (lambda x: x)
    value = f"round({sql}, {digits})" if digits else sql

    def f(spark, d):
        return sp_pairs(spark, d).select("q", "r", wrap(column()).alias(name))

    f.__name__ = name
    query(with_(SP, pairs_sql()) + f"SELECT q, r, {value} AS {name} FROM p")(f)


def pairs_in_blocks(spark, d, **values: tuple) -> DataFrame:
    """(q, r, ...) of all pairs of suppliers, by name of a value: the sums that it takes, and it, of (statistics, query, references,
    *sums)."""
    names = tuple(dict.fromkeys(name for sums, _ in values.values() for name in sums))

    def work(block: B.Block, q: int) -> tuple[np.ndarray, ...]:
        hit, *sums = block.sums(0, q, names)
        whole = dict.fromkeys(names)
        for name, own in zip(names, sums, strict=True):
            whole[name] = np.zeros(block.n)
            whole[name][hit] = own
        return tuple(value(block.stats[0], q, slice(None), *(whole[x] for x in own)) for own, value in values.values())

    return B.Blocks(suppliers(spark, d), [sp(spark, d, by_dimension=True)], B.PAIR_BLOCK).pairs(tuple(values), work)


def block_measure(name: str, sums: tuple[str, ...], value: Callable, sql: str, digits: int | None = None) -> None:
    """As ``measure``, by blocks of queries."""
    whole = (lambda *x: B.rounded(value(*x), digits)) if digits else value

    def f(spark, d):
        return pairs_in_blocks(spark, d, **{name: (sums, whole)})

    f.__name__ = name
    query(with_(SP, pairs_sql(bh="root" in sums)) + f"SELECT q, r, {f'round({sql}, {digits})' if digits else sql} AS {name} FROM p")(f)


measure("pathsim", M.pathsim, PATHSIM)
measure("pathsim_forced_diag", M.pathsim_forced, f"CASE WHEN q = r THEN 1.0::DOUBLE ELSE {PATHSIM} END")
measure("jaccard", M.jaccard, JACCARD)
block_measure("bray_curtis", ("mn",), B.bray_curtis, BRAY)
measure("l1", M.l1, L1)
measure("value_hamming", M.value_hamming, VHAM)
measure("support_hamming", M.support_hamming, SHAM)
block_measure("cosine", ("dot",), B.cosine, COSINE)
block_measure("bhattacharyya", ("root",), B.bhattacharyya, clip("bh"), 9)
measure("relative_affinity", lambda: M.relative_affinity(M.jaccard(), M.bray_curtis(), F.lit(0.4)), relative("0.4::DOUBLE", JACCARD, BRAY))
block_measure("adaptive_affinity", ("inter", "mn"), lambda *x: B.adaptive(*B.discrepancies(*x), 0.5), adaptive("0.5::DOUBLE", JACCARD, BRAY))
measure(
    "tri_component",
    lambda: M.tri_component(M.jaccard(), M.bray_curtis(), M.cosine(), F.lit(0.25), F.lit(0.5), F.lit(0.25)),
    f"0.25::DOUBLE * (1.0::DOUBLE - {JACCARD}) + 0.5::DOUBLE * (1.0::DOUBLE - {BRAY}) + 0.25::DOUBLE * {COSINE}",
    9,
)

SPN = f"spn AS {NORM.format('sp')}"


@query(with_(SP, SPN, pairs_sql("spn")) + f"SELECT q, r, round({COSINE}, 9) AS hetesim FROM p")
def hetesim(spark, d):
    rel, nodes = L.row_normalize(sp(spark, d)), suppliers(spark, d)
    return P.all_pairs(nodes, rel, nodes, rel).select("q", "r", F.round(M.cosine(), 9).alias("hetesim"))


CP = "cp AS (SELECT o_custkey AS i, l_partkey AS j, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@query(
    with_(SP, CP, SPN, f"cpn AS {NORM.format('cp')}", "x AS (SELECT i, sqrt(sum(w * w)) AS n FROM spn GROUP BY i)", "y AS (SELECT i, sqrt(sum(w * w)) AS n FROM cpn GROUP BY i)",
          f"sh AS (SELECT a.i AS q, b.i AS r, {clip('sum(a.w * b.w) / (any_value(x.n) * any_value(y.n))')} AS v FROM spn a JOIN cpn b ON a.j = b.j JOIN x ON x.i = a.i JOIN y ON y.i = b.i GROUP BY 1, 2)")
    + "SELECT s_suppkey AS q, c_custkey AS r, round(coalesce(v, 0.0::DOUBLE), 9) AS hetesim FROM supplier CROSS JOIN customer LEFT JOIN sh ON q = s_suppkey AND r = c_custkey WHERE s_suppkey % 5 = 0"
)
def hetesim_rectangular(spark, d):
    """Test suppliers against customers over parts: two different halves, all pairs."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    cp = L.build(items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey", "l_partkey", by_dimension=True)
    test, customers = suppliers(spark, d).where(is_test("node")), table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    # suppliers below all customers, whatever their keys
    below = (customers.agg(F.min("node")).first()[0] or 0) - (test.agg(F.max("node")).first()[0] or 0) - 1
    nodes = test.select((F.col("node") + below).alias("node"), F.col("node").alias("id"), F.lit(True).alias("query"))
    nodes = nodes.unionByName(customers.select("node", F.col("node").alias("id"), F.lit(False).alias("query")))
    links = sp(spark, d, by_dimension=True).where(is_test("i")).withColumn("i", F.col("i") + below)

    def work(block: B.Block, q: int) -> tuple[np.ndarray]:
        hit, dot = block.sums(0, q, ("dot",))
        out, first = np.zeros(block.n), int(block.columns["query"].sum())
        # rows that are scaled by their sum have the same cosine
        out[hit] = B.rounded(B.cosine(block.stats[0], q, hit, dot), 9)
        return (out[first:],)

    return B.Blocks(nodes, [links.unionByName(cp)], max(1, B.PAIR_BLOCK // 5)).pairs(("hetesim",), work)


BOUNDS = f"b AS (SELECT greatest(max({VHAM}), 1)::DOUBLE AS b0 FROM p), rg AS (SELECT max(mx_q) - min(mi_q) AS rg FROM p), bb AS (SELECT b0, greatest(b0 * rg, 1.0::DOUBLE) AS b1 FROM b CROSS JOIN rg)"


def exact_bounds(pairs: DataFrame) -> DataFrame:
    """One row: b0, the largest value-Hamming of all pairs, and b1 = b0 times the value range, 1 at least."""
    b0 = F.greatest(F.max(M.value_hamming()), F.lit(1)).cast("double")
    return pairs.agg(b0.alias("b0"), (F.max("mx_q") - F.min("mi_q")).alias("rg")).select("b0", F.greatest(F.col("b0") * F.col("rg"), F.lit(1.0)).alias("b1"))


def exact_bounds_of(nodes: DataFrame, rel: DataFrame) -> DataFrame:
    """As ``exact_bounds`` of all pairs of ``nodes``, from statistics and the pairs that share a dimension."""
    stats = P.node_stats(nodes, rel)
    top = F.greatest(F.max("far"), F.lit(1)).cast("double").alias("b0")
    span = stats.agg((F.max("mx") - F.min("mi")).alias("rg"))
    return P.farthest(nodes, rel).agg(top).join(F.broadcast(span)).select("b0", F.greatest(F.col("b0") * F.col("rg"), F.lit(1.0)).alias("b1"))


def global_sql(alpha: str) -> str:
    return clip(f"1.0::DOUBLE - ({alpha} * {VHAM} / b0 + (1.0::DOUBLE - {alpha}) * {L1} / b1)")


@query(with_(SP, pairs_sql(), BOUNDS) + f"SELECT q, r, {global_sql('0.3::DOUBLE')} AS affinity FROM p CROSS JOIN bb")
def global_affinity_exact_bound(spark, d):
    p = written(sp_pairs(spark, d), "pairs")
    a = M.global_affinity(M.value_hamming(), M.l1(), F.col("b0"), F.col("b1"), F.lit(0.3))
    return p.join(F.broadcast(exact_bounds(p))).select("q", "r", a.alias("affinity"))


DIM_BOUNDS = "bb AS (SELECT dims::DOUBLE AS b0, greatest(dims * greatest((SELECT max(mx) FROM ps), 1.0::DOUBLE), 1.0::DOUBLE) AS b1 FROM ps_d)"


@query(
    with_(SP, pairs_sql(), DIM_BOUNDS)
    + f"SELECT q, r, {clip(f'1.0::DOUBLE - (0.3::DOUBLE * {SHAM} / b0 + (1.0::DOUBLE - 0.3::DOUBLE) * {L1} / b1)')} AS affinity FROM p CROSS JOIN bb"
)
def global_affinity_dim_bound(spark, d):
    """The variant with support-Hamming, the number of dimensions, and the largest value, 1 at least."""
    rel = sp(spark, d)
    dims = rel.agg(F.countDistinct("j").cast("double").alias("b0"), F.max("w").alias("m"))
    dims = dims.select("b0", F.greatest(F.col("b0") * F.greatest("m", F.lit(1.0)), F.lit(1.0)).alias("b1"))
    a = M.global_affinity(M.support_hamming(), M.l1(), F.col("b0"), F.col("b1"), F.lit(0.3))
    return sp_pairs(spark, d).join(F.broadcast(dims)).select("q", "r", a.alias("affinity"))


RANGE = (
    "rng AS (SELECT p.*, greatest(mx_q, max(mx_r) OVER w) - least(mi_q, min(mi_r) OVER w) AS rng FROM p "
    "WINDOW w AS (PARTITION BY q, r >= q ORDER BY abs(r - q)))"
)
TOP = f"(SELECT max({VHAM}) FROM p)"


@query(
    with_(SP, pairs_sql(), RANGE)
    + f"SELECT q, r, coalesce((0.5::DOUBLE * {VHAM} + (1 - 0.5::DOUBLE) * {L1}) / nullif(0.5::DOUBLE * {TOP} + (1 - 0.5::DOUBLE) * {TOP} * rng, 0), 'inf'::DOUBLE) AS distance FROM rng"
)
def interval_range_distance(spark, d):
    return P.range_distance(written(sp_pairs(spark, d), "pairs"), 0.5).select("q", "r", "distance")


@query(
    with_(SP, pairs_sql(), RANGE)
    + f"SELECT q, r, 1.0::DOUBLE - x / nullif(max(x) OVER (), 0) AS similarity FROM (SELECT q, r, (0.5::DOUBLE * {VHAM} + (1 - 0.5::DOUBLE) * {L1}) / nullif(0.5::DOUBLE * {TOP} + (1 - 0.5::DOUBLE) * {TOP} * rng, 0) AS x FROM rng)"
)
def legacy_range_similarity(spark, d):
    """1 less the distance over its largest value; undefined (null) where a denominator is zero."""
    x = P.range_distance(written(sp_pairs(spark, d), "pairs"), 0.5).select("q", "r", F.when(F.col("distance") != float("inf"), F.col("distance")).alias("x"))
    x = written(x, "distances")
    return x.join(F.broadcast(x.agg(F.max("x").alias("m")))).select("q", "r", (1.0 - F.try_divide("x", "m")).alias("similarity"))


@query(
    with_(SP, pairs_sql(), BOUNDS, "g AS (SELECT unnest(range(0, 11)) AS k)", "a AS (SELECT k / 10.0::DOUBLE AS alpha, b0, b1 FROM g CROSS JOIN bb)")
    + "SELECT alpha, b0, b1, CASE WHEN alpha <= 0 THEN 0.0::DOUBLE WHEN alpha >= 1 THEN 1.0::DOUBLE ELSE alpha * b1 / (b0 * (1.0::DOUBLE - alpha) + alpha * b1) END AS lambda FROM a"
)
def alpha_lambda(spark, d):
    grid = spark.range(11).select((F.col("id") / F.lit(10.0)).alias("alpha"))
    both = grid.join(F.broadcast(exact_bounds_of(suppliers(spark, d), stored(sp(spark, d)))))
    return both.withColumn("lambda", M.lambda_of_alpha(F.col("alpha"), F.col("b0"), F.col("b1")))


# --- calibration, fusion, ranking

REL = relative("0.4::DOUBLE", JACCARD, BRAY)


def relative_score(beta: float = 0.4) -> Column:
    return M.relative_affinity(M.jaccard(), M.bray_curtis(), F.lit(beta)).alias("score")


def affinity(spark, d, beta: float = 0.4) -> DataFrame:
    return sp_pairs(spark, d).select("q", "r", M.relative_affinity(M.jaccard(), M.bray_curtis(), F.lit(beta)).alias("score"))


AFF = f"s AS (SELECT q, r, {REL} AS score FROM p)"


@query(
    with_(SP, pairs_sql(), AFF)
    + "SELECT q, r, coalesce((rank() OVER (PARTITION BY q ORDER BY score) + (count(*) OVER (PARTITION BY q, score) - 1) / 2.0::DOUBLE - 1) / nullif(count(*) OVER (PARTITION BY q) - 1.0::DOUBLE, 0), 0.0::DOUBLE) AS calibrated FROM s"
)
def rank_calibrate(spark, d):
    return R.rank_calibrate(affinity(spark, d)).select("q", "r", "calibrated")


@query(
    with_(SP, pairs_sql(), AFF)
    + "SELECT q, r, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0.0::DOUBLE) AS calibrated FROM s WINDOW w AS (PARTITION BY q)"
)
def minmax_calibrate(spark, d):
    return R.minmax_calibrate(affinity(spark, d)).select("q", "r", "calibrated")


def two_paths(spark, d) -> DataFrame:
    nodes, out = suppliers(spark, d), None
    for name, rel in (("spart", sp(spark, d)), ("scust", sc(spark, d))):
        one = P.all_pairs(nodes, rel, nodes, rel)
        one = one.select(F.lit(name).alias("path"), "q", "r", M.relative_affinity(M.jaccard(), M.bray_curtis(), F.lit(0.4)).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


PATHS = (SP, SC, pairs_sql(), pairs_sql("sc", "c"), f"paths AS (SELECT 'spart' AS path, q, r, {REL} AS score FROM p UNION ALL SELECT 'scust', q, r, {REL} FROM c)")
FUSED = "SELECT a.q, a.r, round({x} * a.score + {y} * b.score, 12) AS score FROM paths a JOIN paths b ON a.q = b.q AND a.r = b.r AND a.path = 'spart' AND b.path = 'scust'"


def fused(spark, d, x: float, y: float) -> DataFrame:
    weights = spark.createDataFrame([("spart", x), ("scust", y)], "path string, weight double")
    return R.fuse(two_paths(spark, d), weights).withColumn("score", F.round("score", 12))


@query(with_(*PATHS) + FUSED.format(x="0.7::DOUBLE", y="0.3::DOUBLE"))
def linear_fusion(spark, d):
    return fused(spark, d, 0.7, 0.3)


@query(with_(*PATHS) + FUSED.format(x="0.5::DOUBLE", y="0.5::DOUBLE"))
def uniform_fusion(spark, d):
    return fused(spark, d, 0.5, 0.5)


ENTROPY = (
    "e1 AS (SELECT path, r, score / nullif(sum(score) OVER (PARTITION BY path, r), 0) AS p FROM paths), "
    "e2 AS (SELECT path, r, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS h, count(*) AS n FROM e1 GROUP BY 1, 2), "
    "e3 AS (SELECT path, 1 - avg(coalesce(h / nullif(ln(n), 0), 1)) AS raw FROM e2 GROUP BY 1)"
)


@query(with_(*PATHS, ENTROPY) + "SELECT path, round(raw / sum(raw) OVER (), 9) AS weight FROM e3")
def entropy_weights(spark, d):
    rels = [rel(spark, d, by_dimension=True) for rel in (sp, sc)]
    sums = B.Blocks(suppliers(spark, d), rels).run(relative_entropies, "path long, h double, n long")
    name = F.get(F.array(F.lit("spart"), F.lit("scust")), F.col("path").cast("int")).alias("path")
    raw = sums.groupBy("path").agg((1.0 - F.sum("h") / F.sum("n")).alias("raw"))
    return R.scaled(raw).select(name, F.round("weight", 9).alias("weight"))


def relative_entropies(block: B.Block) -> dict:
    """Per path the sum of the normalised entropies of the block's columns. Scores are the same both ways, so a
    column is its supplier's row."""
    sums, allowed = [], np.ones(block.n, bool)
    for path in range(len(block.stats)):
        empty = int((block.stats[path].sup == 0).sum())
        sums.append(sum(relative_entropy(block, path, q, allowed, empty, block.n, None) for q in range(block.lo, block.hi)))
    n = len(sums)
    return {"path": np.arange(n), "h": np.array(sums, float), "n": np.full(n, block.hi - block.lo)}


def relative_entropy(block: B.Block, path: int, q: int, allowed: np.ndarray, empty: int, total: int, digits: int | None) -> float:
    """The entropy of a query's shares over ``total`` references, of which ``empty`` have no links, over its largest value."""
    _, scores = allowed_relative(block, path, q, allowed)
    scores = scores if block.stats[path].sup[q] else np.ones(empty)
    return entropy(B.rounded(scores, digits) if digits else scores, total)


def entropy(scores: np.ndarray, total: int) -> float:
    """The entropy of the shares of ``total`` scores, of which those that are not given are 0, over its largest value."""
    if total < 2:
        return 1.0
    share = scores[scores > 0] / scores.sum() if scores.sum() else scores[:0]
    return float(-(share * np.log(share)).sum() / np.log(total))


def allowed_relative(block: B.Block, path: int, q: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The allowed places that share a dimension, and their relative affinity."""
    hit, inter, mn = block.sums(path, q, ("inter", "mn"))
    keep = allowed[hit]
    return hit[keep], relative_of(block, path, q, hit[keep], inter[keep], mn[keep])


def calibrated_views(block: B.Block, q: int, refs, *calibrations: Callable) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """The references that can be among the nearest by any weights of the paths, and by calibration and path their scores."""
    own = [allowed_relative(block, path, q, refs.allowed) for path in range(len(block.stats))]
    places = np.unique(np.concatenate([refs.first, *(hit for hit, _ in own)]))
    return places, [[B.calibrated(block, p, q, places, *x, refs.empty[p], refs.total, calibrate) for p, x in enumerate(own)] for calibrate in calibrations]


def weighted_sum(weights: np.ndarray, views: list[np.ndarray]) -> np.ndarray:
    """(setting, place): sums by each row of ``weights``, rounded, so that equal sums tie."""
    return B.rounded(sum(weights[:, i : i + 1] * view for i, view in enumerate(views)), 12)


def simplex_weights(spark: SparkSession) -> np.ndarray:
    return np.array([[r["w0"], r["w1"], r["w2"]] for r in E.simplex(spark, 3, 4).orderBy("g").collect()])


def relative_of(block: B.Block, path: int, q: int, hit: np.ndarray, inter: np.ndarray, mn: np.ndarray) -> np.ndarray:
    return B.relative(*B.discrepancies(block.stats[path], q, hit, inter, mn), 0.4)


@query(
    "SELECT (row_number() OVER (ORDER BY a, b) - 1)::BIGINT AS g, a / 4.0::DOUBLE AS w0, b / 4.0::DOUBLE AS w1, (4 - a - b) / 4.0::DOUBLE AS w2 "
    "FROM (SELECT unnest(range(0, 5)) AS a) CROSS JOIN (SELECT unnest(range(0, 5)) AS b) WHERE a + b <= 4"
)
def simplex_grid(spark, d):
    return E.simplex(spark, 3, 4).withColumn("g", F.col("g").cast("long"))


RANKED = "SELECT q, r, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, r) AS rank FROM s"


def neighbours(spark, d) -> DataFrame:
    """The K nearest of each supplier, from the pairs that can be among them."""
    rel, nodes = sp(spark, d), suppliers(spark, d)
    return R.top_k(P.candidate_pairs(nodes, rel, nodes, rel, K).select("q", "r", relative_score()), K)


@query(with_(SP, pairs_sql(), AFF) + f"SELECT q, r, score, rank::BIGINT AS rank FROM ({RANKED}) WHERE rank <= {K}")
def topk(spark, d):
    return neighbours(spark, d).select("q", "r", "score", F.col("rank").cast("long").alias("rank"))


@query(with_(SP, pairs_sql(), AFF) + f"SELECT r, score FROM s WHERE q = 0 ORDER BY score DESC, r LIMIT {K}")
def topk_single_node(spark, d):
    """The search report of one entity, which is restricted before any pair is built."""
    rel, nodes = sp(spark, d), suppliers(spark, d)
    p = P.all_pairs(nodes.where("node = 0"), rel.where("i = 0"), nodes, rel)
    s = p.select("r", M.relative_affinity(M.jaccard(), M.bray_curtis(), F.lit(0.4)).alias("score"))
    return s.orderBy(F.desc("score"), "r").limit(K)


# --- votes and metrics

HELD = f"h AS (SELECT q, r, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, r) AS rank FROM s WHERE q % 5 = 0 AND r % 5 <> 0 QUALIFY rank <= {K})"
VOTE = (
    "v AS (SELECT q, label, count(*) AS n, min(rank) AS first FROM h JOIN lab ON node = r GROUP BY 1, 2), "
    "pred AS (SELECT q, label AS pred FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY n DESC, first) = 1), "
    "pt AS (SELECT q, pred, label AS truth FROM pred JOIN lab ON node = q)"
)
HELD_OUT = (SP, LAB, pairs_sql(), AFF, HELD, VOTE)


def held_out(spark, d, beta: float = 0.4) -> DataFrame:
    """Neighbours of test suppliers among training suppliers."""
    return R.top_k(held_out_pairs(spark, d).select("q", "r", relative_score(beta)), K)


def held_out_pairs(spark, d) -> DataFrame:
    """Pairs of test suppliers with the training suppliers that can be among their K nearest."""
    rel, nodes = sp(spark, d), suppliers(spark, d)
    test, train = is_test("i"), is_test("node")
    return P.candidate_pairs(nodes.where(train), rel.where(test), nodes.where(~train), rel.where(~test), K)


def predictions(spark, d) -> DataFrame:
    lab = regions(spark, d)
    pred = R.majority_vote(held_out(spark, d), lab)
    return pred.join(lab.select(F.col("node").alias("q"), F.col("label").alias("truth")), "q")


@query(
    with_(SP, LAB, pairs_sql(), AFF, f"h AS (SELECT * FROM ({RANKED}) WHERE rank <= {K})", "vis AS (SELECT * FROM lab WHERE node % 5 <> 0)",
          "v AS (SELECT q, label, count(*) AS n, min(rank) AS first FROM h JOIN vis ON node = r GROUP BY 1, 2)",
          "b AS (SELECT q, label FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY n DESC, first) = 1)")
    + "SELECT s_suppkey AS q, coalesce(label, -1)::BIGINT AS pred FROM supplier LEFT JOIN b ON q = s_suppkey"
)
def historical_vote(spark, d):
    """All entities are candidates, the query too; unlabelled neighbours are dropped after the top-k."""
    return R.majority_vote(neighbours(spark, d), regions(spark, d).where(~is_test("node")))


@query(with_(*HELD_OUT) + "SELECT q, pred, truth FROM pt")
def majority_vote(spark, d):
    return predictions(spark, d).select("q", "pred", "truth")


@query(
    with_(*HELD_OUT, "pr AS (SELECT label, count(*) / sum(count(*)) OVER ()::DOUBLE AS prior FROM lab WHERE node % 5 <> 0 GROUP BY 1)",
          "w AS (SELECT q, label, sum(greatest(score, 0.0::DOUBLE)) AS s, min(rank) AS first FROM h JOIN lab ON node = r GROUP BY 1, 2)",
          f"f AS (SELECT t.q, pr.label, coalesce(s, 0) / prior AS s, coalesce(first, {K + 1}) AS first FROM (SELECT DISTINCT q FROM h) t CROSS JOIN pr LEFT JOIN w ON w.q = t.q AND w.label = pr.label)",
          "m AS (SELECT *, max(s) OVER (PARTITION BY q) AS m FROM f)")
    + "SELECT q, label AS pred FROM m WHERE abs(s - m) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(m) QUALIFY row_number() OVER (PARTITION BY q ORDER BY first, label) = 1"
)
def weighted_vote(spark, d):
    lab = regions(spark, d)
    train = lab.where(~is_test("node"))
    total = F.broadcast(train.agg(F.count(F.lit(1)).cast("double").alias("t")))
    classes = train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(total).select("label", (F.col("n") / F.col("t")).alias("prior"))
    return R.weighted_vote(held_out(spark, d), lab, classes, K, 1.0, 1.0)


F1 = (
    "cls AS (SELECT truth AS label FROM pt UNION SELECT pred FROM pt), "
    "f1 AS (SELECT label, (SELECT count(*) FROM pt WHERE truth = label AND pred = label) AS tp, (SELECT count(*) FROM pt WHERE truth <> label AND pred = label) AS fp, "
    "(SELECT count(*) FROM pt WHERE truth = label AND pred <> label) AS fn FROM cls)"
)


@query(
    with_(*HELD_OUT, F1)
    + "SELECT round((SELECT avg(2.0::DOUBLE * tp / (2.0::DOUBLE * tp + fp + fn)) FROM f1), 9) AS macro_f1, round((SELECT avg((truth = pred)::INT::DOUBLE) FROM pt), 9) AS accuracy"
)
def classification_metrics(spark, d):
    return E.classification_metrics(predictions(spark, d)).select(F.round("macro_f1", 9).alias("macro_f1"), F.round("accuracy", 9).alias("accuracy"))


@query(with_(*HELD_OUT, F1) + "SELECT label, tp, fp, fn, 2.0::DOUBLE * tp / (2.0::DOUBLE * tp + fp + fn) AS f1 FROM f1 WHERE tp + fn > 0")
def per_class_f1(spark, d):
    return E.class_counts(predictions(spark, d), universe="truth").select("label", "tp", "fp", "fn", "f1")


@query(with_(*HELD_OUT) + "SELECT truth, pred, count(*) AS n FROM pt GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return E.confusion(predictions(spark, d))


NDCG = (
    "lsize AS (SELECT label, least(count(*), {k}) AS m FROM lab WHERE node % 5 <> 0 GROUP BY 1), "
    "ideal AS (SELECT label, sum(1 / log2(i + 1)) AS ideal FROM lsize CROSS JOIN (SELECT unnest(range(1, {k1})) AS i) WHERE i <= m GROUP BY 1), "
).format(k=K, k1=K + 1)


def ndcg_sql(h: str, out: str) -> str:
    return (
        f"{out} AS (SELECT {h}.q, coalesce(sum(CASE WHEN a.label = b.label THEN 1 / log2(rank + 1) ELSE 0 END) / any_value(ideal), 0) AS ndcg "
        f"FROM {h} JOIN lab a ON a.node = {h}.q JOIN lab b ON b.node = {h}.r LEFT JOIN ideal ON ideal.label = a.label GROUP BY 1)"
    )


@query(with_(*HELD_OUT, NDCG + ndcg_sql("h", "nd")) + "SELECT q, round(ndcg, 9) AS ndcg FROM nd")
def ndcg(spark, d):
    lab = regions(spark, d)
    return E.ndcg(held_out(spark, d), lab, lab.where(~is_test("node")).select("node"), K).withColumn("ndcg", F.round("ndcg", 9))


def held_sql(beta: str, out: str) -> str:
    return (
        f"{out} AS (SELECT q, r, j, bc, row_number() OVER (PARTITION BY q ORDER BY {adaptive(beta)} DESC, r) AS rank "
        f"FROM jb WHERE q % 5 = 0 AND r % 5 <> 0 QUALIFY rank <= {K})"
    )


JB = f"jb AS (SELECT q, r, {JACCARD} AS j, {BRAY} AS bc FROM p)"


TWO_JB = (
    f"jb2 AS (SELECT q, r, j, bc, {JACCARD} AS j2, {BRAY} AS bc2 FROM jb JOIN c USING (q, r)), "
    "f0 AS (SELECT q, r, 0.7::DOUBLE * (1.0::DOUBLE - bc) + 0.3::DOUBLE * (1.0::DOUBLE - bc2) AS a0, "
    + f"0.7::DOUBLE * {adaptive('0.5::DOUBLE')} + 0.3::DOUBLE * {adaptive('0.5::DOUBLE', 'j2', 'bc2')} AS a1, "
    "0.7::DOUBLE * greatest(j - bc, 0.0::DOUBLE) + 0.3::DOUBLE * greatest(j2 - bc2, 0.0::DOUBLE) AS gap FROM jb2 WHERE q % 5 = 0 AND r % 5 <> 0), "
    f"h0 AS (SELECT q, r, gap, row_number() OVER (PARTITION BY q ORDER BY round(a0, 12) DESC, r) AS rank FROM f0 QUALIFY rank <= {K}), "
    f"h1 AS (SELECT q, r, row_number() OVER (PARTITION BY q ORDER BY round(a1, 12) DESC, r) AS rank FROM f0 QUALIFY rank <= {K})"
)


@query(
    with_(SP, SC, LAB, pairs_sql(), pairs_sql("sc", "c"), JB, TWO_JB, NDCG + ndcg_sql("h0", "n0"), ndcg_sql("h1", "n1"),
          "gp AS (SELECT q, avg(gap) AS gap FROM h0 GROUP BY 1)",
          "e AS (SELECT quantile_cont(gap, 0.25) AS a, quantile_cont(gap, 0.5) AS b, quantile_cont(gap, 0.75) AS c FROM gp)")
    + "SELECT ((gap > a)::INT + (gap > b)::INT + (gap > c)::INT)::BIGINT AS quartile, count(*) AS n, round(avg(gap), 9) AS mean_gap, round(avg(n1.ndcg - n0.ndcg), 9) AS delta "
    "FROM gp CROSS JOIN e JOIN n0 USING (q) JOIN n1 USING (q) GROUP BY 1"
)
def conflict_strata(spark, d):
    """Two paths with weights 0.7 and 0.3: gaps and adaptive affinities add up by weight."""
    lab, nodes = regions(spark, d), suppliers(spark, d)
    train, paths = lab.where(~is_test("node")).select("node"), {"spart": 0.7, "scust": 0.3}
    frames = None
    for (name, weight), rel in zip(paths.items(), (sp(spark, d), sc(spark, d)), strict=True):
        own = P.all_pairs(nodes.where(is_test("node")), rel.where(is_test("i")), nodes.where(~is_test("node")), rel.where(~is_test("i")))
        own = own.select(F.lit(name).alias("path"), "q", "r", M.jaccard().alias("j"), M.bray_curtis().alias("bc"), F.lit(weight).alias("weight"))
        frames = own if frames is None else frames.unionByName(own)
    frames = written(frames, "path-components")
    score = lambda beta: F.round(F.sum(F.col("weight") * M.adaptive_affinity(F.col("j"), F.col("bc"), F.lit(beta))), 12).alias("score")
    near = [R.top_k(frames.groupBy("q", "r").agg(score(beta)), K) for beta in (0.0, 0.5)]
    base, other = (E.ndcg(h, lab, train, K) for h in near)
    out = E.conflict_strata(frames.join(near[0].select("q", "r"), ["q", "r"], "left_semi"), base, other)
    return out.select(F.col("quartile").cast("long").alias("quartile"), "n", F.round("mean_gap", 9).alias("mean_gap"), F.round("delta", 9).alias("delta"))


# --- selection: training suppliers only, four folds by id

GRID_PRED = (
    f"gh AS (SELECT g, fold, q, r, row_number() OVER (PARTITION BY g, fold, q ORDER BY score DESC, r) AS rank FROM gs QUALIFY rank <= {K}), "
    "gv AS (SELECT g, fold, q, label, count(*) AS n, min(rank) AS first FROM gh JOIN lab ON node = r GROUP BY ALL), "
    "gp AS (SELECT g, fold, q, v.label AS pred, t.label AS truth FROM gv v JOIN lab t ON t.node = q QUALIFY row_number() OVER (PARTITION BY g, fold, q ORDER BY n DESC, first) = 1)"
)


def grid_f1(by: str, pred: str = "gp", truth_only: bool = False) -> str:
    """CTEs gf (macro_f1) and ga (accuracy) by the columns ``by`` of predictions."""
    return (
        f"gc AS (SELECT {by}, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT {by}, truth AS label, (truth = pred)::INT AS tp, 0 AS fp, (truth <> pred)::INT AS fn FROM {pred} "
        f"UNION ALL SELECT {by}, pred, 0, 1, 0 FROM {pred} WHERE truth <> pred) GROUP BY ALL{' HAVING sum(tp) + sum(fn) > 0' if truth_only else ''}), "
        f"gf AS (SELECT {by}, avg(2.0::DOUBLE * tp / (2.0::DOUBLE * tp + fp + fn)) AS macro_f1 FROM gc GROUP BY ALL), "
        f"ga AS (SELECT {by}, avg((truth = pred)::INT::DOUBLE) AS accuracy FROM {pred} GROUP BY ALL)"
    )


GRID_NDCG = (
    f"gsz AS (SELECT fold, label, least(count(*), {K}) AS m FROM lab CROSS JOIN fold WHERE node % 5 <> 0 AND (node // 5) % 4 <> fold GROUP BY 1, 2), "
    f"gid AS (SELECT fold, label, sum(1 / log2(i + 1)) AS ideal FROM gsz CROSS JOIN (SELECT unnest(range(1, {K + 1})) AS i) WHERE i <= m GROUP BY 1, 2), "
    "gn AS (SELECT g, gh.fold AS fold, q, coalesce(sum(CASE WHEN a.label = b.label THEN 1 / log2(rank + 1) ELSE 0 END) / any_value(ideal), 0) AS ndcg "
    "FROM gh JOIN lab a ON a.node = q JOIN lab b ON b.node = r LEFT JOIN gid ON gid.fold = gh.fold AND gid.label = a.label GROUP BY 1, 2, 3), "
    "gnf AS (SELECT g, fold, avg(ndcg) AS ndcg FROM gn GROUP BY ALL)"
)
GRID_EVAL = (
    f"{GRID_PRED}, {grid_f1('g, fold')}, {GRID_NDCG}, "
    "gm AS (SELECT g, round(avg(macro_f1), 12) AS macro_f1, round(avg(accuracy), 12) AS accuracy, round(avg(ndcg), 12) AS ndcg, stddev_samp(macro_f1) / sqrt(count(*)) AS macro_f1_se, "
    "stddev_samp(macro_f1) AS macro_f1_std FROM gf JOIN ga USING (g, fold) JOIN gnf USING (g, fold) GROUP BY 1)"
)
FOLDED = "fold AS (SELECT unnest(range(0, 4)) AS fold)"
INNER = "q % 5 <> 0 AND r % 5 <> 0 AND (q // 5) % 4 = fold AND (r // 5) % 4 <> fold"


def own_fold(c: str) -> Column:
    return F.floor(F.col(c) / 5) % 4


def folded(pairs: DataFrame) -> DataFrame:
    """Pairs of training suppliers as (fold of the query, q, r, ...), references from the other folds."""
    inner = pairs.where(~is_test("q") & ~is_test("r"))
    return inner.where(own_fold("q") != own_fold("r")).withColumn("fold", own_fold("q"))


def folded_candidates(spark, d) -> DataFrame:
    """As ``folded``, only the pairs that can be among the K nearest of their query."""
    rel = stored(sp(spark, d).where(~is_test("i")))
    nodes = suppliers(spark, d).where(~is_test("node")).withColumn("fold", own_fold("node"))
    return P.candidate_pairs(nodes, rel, nodes, rel, K)


def training_folds(spark, d) -> DataFrame:
    """(fold, node, label): the references of each fold."""
    return E.fold_references(regions(spark, d).where(~is_test("node")).withColumn("fold", own_fold("node")))


def graded(spark, d, near: DataFrame, grid: DataFrame) -> DataFrame:
    """The grid with the means over folds of its neighbours, rounded, so that sums in another order don't decide."""
    near = written(near.select("g", "fold", "q", "r", "rank"), "grid-neighbours")
    out = E.evaluate_neighbours(near, regions(spark, d), training_folds(spark, d), K)
    return out.select("g", *(F.round(c, 12).alias(c) for c in ("macro_f1", "accuracy", "ndcg")), "macro_f1_se", "macro_f1_std").join(F.broadcast(grid), "g")


def graded_counts(counts: DataFrame, grid: DataFrame) -> DataFrame:
    """As ``graded``, from the votes that blocks have counted."""
    counts = counts.groupBy("g", "fold", "truth", "pred").agg(F.sum("n").alias("n"), F.sum("gain").alias("gain"))
    out = E.evaluate_counts(written(counts, "counts"))
    return out.select("g", *(F.round(c, 12).alias(c) for c in ("macro_f1", "accuracy", "ndcg")), "macro_f1_se", "macro_f1_std").join(F.broadcast(grid), "g")


def best_of(rows: DataFrame, prefer: list[Column], second: str = "accuracy") -> DataFrame:
    return R.arg_max(rows, [F.desc("macro_f1"), F.desc(second), *prefer, F.col("g")])


def select_best(spark, d, near: DataFrame, grid: DataFrame, prefer: list[Column], second: str = "accuracy") -> DataFrame:
    return best_of(graded(spark, d, near, grid), prefer, second)


def line(spark, n: int, name: str) -> DataFrame:
    return spark.range(n + 1).select(F.col("id").alias("g"), (F.col("id") / F.lit(float(n))).alias(name))


@query(
    with_(SP, LAB, pairs_sql(), BOUNDS, FOLDED, "grid AS (SELECT g, g / 10.0::DOUBLE AS alpha FROM (SELECT unnest(range(0, 11)) AS g))",
          f"gs AS (SELECT g, fold, q, r, {global_sql('alpha')} AS score FROM p CROSS JOIN bb CROSS JOIN fold CROSS JOIN grid WHERE {INNER})", GRID_EVAL)
    + "SELECT g, alpha, round(macro_f1, 9) AS macro_f1, round(accuracy, 9) AS accuracy FROM gm JOIN grid USING (g) ORDER BY gm.macro_f1 DESC, gm.accuracy DESC, abs(alpha - 0.5), g LIMIT 1"
)
def alpha_grid_select(spark, d):
    blocks = B.Blocks(labelled(spark, d), [sp(spark, d, by_dimension=True)])
    b0 = max(blocks.run(farthest, "far double").agg(F.max("far").alias("far")).first()["far"] or 0.0, 1.0)
    s = blocks.stats[0]
    b1 = max(b0 * (s.mx.max() - s.mi.min()), 1.0) if blocks.n else 1.0
    alphas = np.arange(11)[:, None] / 10.0
    score = lambda hamming, l1: B.clip(1.0 - (alphas * hamming / b0 + (1.0 - alphas) * l1 / b1))
    grid = line(spark, 10, "alpha")
    best = best_of(graded_counts(blocks.run(distance_votes(score, "fold"), B.COUNTS), grid), [F.abs(F.col("alpha") - 0.5)])
    return best.select("g", "alpha", F.round("macro_f1", 9).alias("macro_f1"), F.round("accuracy", 9).alias("accuracy"))


def farthest(block: B.Block) -> dict:
    """The largest value-Hamming of the block's nodes to any node: of those that share nothing, to the one of the largest support."""
    sup, far = block.stats[0].sup, 0.0
    order = np.argsort(-sup, kind="stable")
    for q in range(block.lo, block.hi):
        hit, inter, eq = block.sums(0, q, ("inter", "eq"))
        far = max(far, (sup[q] + sup[hit] - inter - eq).max(initial=0.0))
        block.mask[hit] = True
        rest = order[: len(hit) + 1]
        far = max(far, (sup[q] + sup[rest[~block.mask[rest]]]).max(initial=0.0))
        block.mask[hit] = False
    return {"far": np.array([far])}


def distance_votes(score: Callable, *splits: str) -> Callable:
    """Votes by a score of value-Hamming and L1 that falls with both. The column ``fold``, or each of several ``splits`` (1: query,
    0: reference, -1: neither), says whom a query may have as reference."""

    def work(block: B.Block) -> dict:
        s, (labels, code) = block.stats[0], B.classes(block.columns["label"])
        parts, sums = [], {}
        for at, split in enumerate(splits):
            side = block.columns[split]
            groups = np.unique(side[side >= 0]) if split == "fold" else [1]
            for f in groups:
                allowed = (side >= 0) & (side != f)
                own = block.lo + np.flatnonzero((side[block.lo : block.hi] == f) & (code[block.lo : block.hi] >= 0))
                if not len(own):
                    continue
                profiles, near = B.Profiles(s, allowed), []
                for q in own.tolist():
                    if q not in sums:
                        sums[q] = block.sums(0, q, ("inter", "eq", "mn"))
                    hit, inter, eq, mn = sums[q] if len(splits) > 1 else sums.pop(q)
                    keep = allowed[hit]
                    hit, inter, eq, mn = hit[keep], inter[keep], eq[keep], mn[keep]
                    more = profiles.free(block, hit, lambda sup, act: score(s.sup[q] + sup, s.act[q] + act), K)
                    places = np.sort(np.concatenate([hit, more]))
                    inter, eq, mn = (B.spread(places, hit, x) for x in (inter, eq, mn))
                    hamming = s.sup[q] + s.sup[places] - inter - eq
                    near.append(B.nearest(places, score(hamming, s.act[q] + s.act[places] - 2.0 * mn), K))
                near = np.stack(near)
                ideal = np.bincount(code[allowed & (code >= 0)], minlength=len(labels))[code[own]]
                fold = np.full(len(own), f if split == "fold" else at)
                parts.append(B.counted(labels, fold, code[own], B.majority(near, code, len(labels)), B.gains(near, code[own], code, ideal)))
        return B.joined(parts, B.COUNTS)

    return work


#: The grid of component weights of a path.
BETAS = (0.0, 0.01, 0.025, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0)
BETA_GRID = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({g}::BIGINT, {b}::DOUBLE)" for g, b in enumerate(BETAS)) + ") AS t(g, beta))"
BEST_BETA = (
    "SELECT g, beta, round(macro_f1, 9) AS macro_f1, round(macro_f1_se, 9) AS macro_f1_se, round(ndcg, 9) AS ndcg FROM gm JOIN grid USING (g) "
    "ORDER BY gm.macro_f1 DESC, gm.ndcg DESC, beta LIMIT 1"
)


def select_path_beta(spark, d, formulation: Callable) -> DataFrame:
    grid = spark.createDataFrame(list(enumerate(BETAS)), "g long, beta double")
    counts = training_blocks(spark, d, sp).run(component_votes(formulation), B.COUNTS)
    best = best_of(graded_counts(counts, grid), [F.col("beta")], "ndcg")
    return best.select("g", "beta", *(F.round(c, 9).alias(c) for c in ("macro_f1", "macro_f1_se", "ndcg")))


def component_votes(formulation: Callable) -> Callable:
    """Votes for each weight of the grid, of training suppliers by those of the other folds."""

    def work(block: B.Block) -> dict:
        folds, near, betas = B.Folds(block, K), [], np.array(BETAS)[:, None]
        for q in block.queries():
            refs = folds.of(folds.fold[q])
            places, j, bc = components(block, q, refs)
            near.append(B.nearest(places, formulation(j, bc, betas), K))
        return B.graded(block, folds, block.queries(), near)

    return work


def components(block: B.Block, q: int, refs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The references that can be among the nearest, and their Jaccard and Bray-Curtis discrepancies."""
    hit, inter, mn = block.sums(0, q, ("inter", "mn"))
    keep = refs.allowed[hit]
    places = np.union1d(hit[keep], refs.first)
    return places, *B.discrepancies(block.stats[0], q, places, *(B.spread(places, hit[keep], x[keep]) for x in (inter, mn)))


@query(
    with_(SP, LAB, pairs_sql(), JB, FOLDED, BETA_GRID, f"gs AS (SELECT g, fold, q, r, {relative('beta')} AS score FROM jb CROSS JOIN fold CROSS JOIN grid WHERE {INNER})", GRID_EVAL)
    + BEST_BETA
)
def beta_grid_select(spark, d):
    return select_path_beta(spark, d, B.relative)


@query(
    with_(SP, LAB, pairs_sql(), JB, FOLDED, BETA_GRID, f"gs AS (SELECT g, fold, q, r, {adaptive('beta')} AS score FROM jb CROSS JOIN fold CROSS JOIN grid WHERE {INNER})", GRID_EVAL)
    + BEST_BETA
)
def beta_grid_select_adaptive(spark, d):
    return select_path_beta(spark, d, B.adaptive)


@query(
    with_(*PATHS, LAB, FOLDED, "grid AS (SELECT g, g / 10.0::DOUBLE AS weight FROM (SELECT unnest(range(0, 11)) AS g))",
          f"gs AS (SELECT g, fold, a.q AS q, a.r AS r, round(weight * a.score + (1.0::DOUBLE - weight) * b.score, 12) AS score FROM paths a JOIN paths b ON a.q = b.q AND a.r = b.r AND a.path = 'spart' AND b.path = 'scust' CROSS JOIN fold CROSS JOIN grid WHERE {INNER.replace('q ', 'a.q ').replace('r ', 'a.r ').replace('(q', '(a.q').replace('(r', '(a.r')})", GRID_EVAL)
    + "SELECT g, weight, round(macro_f1, 9) AS macro_f1, round(accuracy, 9) AS accuracy FROM gm JOIN grid USING (g) ORDER BY gm.macro_f1 DESC, gm.accuracy DESC, abs(weight - 0.5), g LIMIT 1"
)
def fusion_grid_select(spark, d):
    grid, steps = line(spark, 10, "weight"), np.arange(11)[:, None] / 10.0
    counts = training_blocks(spark, d, sp, sc).run(path_votes(np.hstack([steps, 1.0 - steps])), B.COUNTS)
    best = best_of(graded_counts(counts, grid), [F.abs(F.col("weight") - 0.5)])
    return best.select("g", "weight", F.round("macro_f1", 9).alias("macro_f1"), F.round("accuracy", 9).alias("accuracy"))


def path_votes(weights: np.ndarray) -> Callable:
    """Votes by weighted sums of the paths' relative affinities, for each row of ``weights``, of training suppliers by those of the other folds."""

    def work(block: B.Block) -> dict:
        folds, near = B.Folds(block, K), []
        for q in block.queries():
            places, views = relative_views(block, q, folds.of(folds.fold[q]))
            near.append(B.nearest(places, weighted_sum(weights, views), K))
        return B.graded(block, folds, block.queries(), near)

    return work


def relative_views(block: B.Block, q: int, refs) -> tuple[np.ndarray, list[np.ndarray]]:
    """The references that can be among the nearest by any weights of the paths, and by path their relative affinity."""
    own = [allowed_relative(block, path, q, refs.allowed) for path in range(len(block.stats))]
    places = np.unique(np.concatenate([refs.first, *(hit for hit, _ in own)]))
    views = []
    for s, (hit, score) in zip(block.stats, own, strict=True):
        view = np.where((s.sup[q] == 0) & (s.sup[places] == 0), 1.0, 0.0)
        view[np.searchsorted(places, hit)] = score
        views.append(view)
    return places, views


ACTIVE = "((w0 > 0)::INT + (w1 > 0)::INT + (w2 > 0)::INT)"


@query(
    with_(SP, LAB, pairs_sql(), f"jbc AS (SELECT q, r, {JACCARD} AS j, {BRAY} AS bc, {COSINE} AS cs FROM p)", FOLDED, f"grid AS ({SQL['simplex_grid']})",
          f"gs AS (SELECT g, fold, q, r, round(w0 * (1.0::DOUBLE - j) + w1 * (1.0::DOUBLE - bc) + w2 * cs, 12) AS score FROM jbc CROSS JOIN fold CROSS JOIN grid WHERE {INNER})", GRID_EVAL)
    + f"SELECT g, w0, w1, w2, round(macro_f1, 9) AS macro_f1, round(ndcg, 9) AS ndcg FROM gm JOIN grid USING (g) ORDER BY gm.macro_f1 DESC, gm.ndcg DESC, {ACTIVE}, w1 DESC, g LIMIT 1"
)
def mixture_grid_select(spark, d):
    grid = E.simplex(spark, 3, 4).withColumn("g", F.col("g").cast("long"))
    counts = training_blocks(spark, d, sp).run(mixture_votes(simplex_weights(spark)), B.COUNTS)
    active = sum((F.col(f"w{i}") > 0).cast("int") for i in range(3))
    best = best_of(graded_counts(counts, grid), [active, F.desc("w1")], "ndcg")
    return best.select("g", "w0", "w1", "w2", F.round("macro_f1", 9).alias("macro_f1"), F.round("ndcg", 9).alias("ndcg"))


def mixture_votes(weights: np.ndarray) -> Callable:
    """Votes by each row of weights of the two affinities and cosine, of training suppliers by those of the other folds."""

    def work(block: B.Block) -> dict:
        folds, near, s = B.Folds(block, K), [], block.stats[0]
        for q in block.queries():
            refs = folds.of(folds.fold[q])
            hit, *sums = block.sums(0, q, ("inter", "mn", "dot"))
            keep = refs.allowed[hit]
            places = np.union1d(hit[keep], refs.first)
            inter, mn, dot = (B.spread(places, hit[keep], x[keep]) for x in sums)
            j, bc = B.discrepancies(s, q, places, inter, mn)
            near.append(B.nearest(places, weighted_sum(weights, [1.0 - j, 1.0 - bc, B.cosine(s, q, places, dot)]), K))
        return B.graded(block, folds, block.queries(), near)

    return work


# --- several labels: five bits for each supplier, its region and its nation key modulo 5

BITS = (
    "byr AS (SELECT s_suppkey AS node, c.class AS class, CASE WHEN n_regionkey = c.class OR s_nationkey % 5 = c.class THEN 1 ELSE 0 END::INT AS bit "
    "FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN (SELECT unnest(range(0, 5)) AS class) c)"
)


def label_bits(spark, d) -> DataFrame:
    """Five bits per supplier: its region's, and its nation key's modulo 5; no row is empty."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(n), "s_nationkey")
    each = s.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(4))))
    bit = (F.col("n_regionkey") == F.col("class")) | (F.col("s_nationkey") % 5 == F.col("class"))
    return each.select(F.col("s_suppkey").alias("node"), F.col("class").cast("long").alias("class"), bit.cast("int").alias("bit"))


MULTI = (
    "prev AS (SELECT class, avg(bit::DOUBLE) AS share FROM byr WHERE node % 5 <> 0 GROUP BY 1), "
    "mw AS (SELECT h.*, greatest(score, 0.0::DOUBLE) AS w, sum(greatest(score, 0.0::DOUBLE)) OVER (PARTITION BY q) AS tw FROM h), "
    "mm AS (SELECT q, class, sum((CASE WHEN tw <= 1e-8 THEN 1.0::DOUBLE ELSE w END) * bit) / sum(CASE WHEN tw <= 1e-8 THEN 1.0::DOUBLE ELSE w END) AS s FROM mw JOIN byr ON node = r GROUP BY 1, 2), "
    "ms AS (SELECT q, class, s / sqrt(greatest(share, 1e-12)) AS s FROM mm JOIN prev USING (class)), "
    "mt AS (SELECT q, class, CASE WHEN max(s) OVER w > 0 THEN s / max(s) OVER w ELSE 0 END AS s FROM ms WINDOW w AS (PARTITION BY q)), "
    "mh AS (SELECT q, class, (round(s, 12) >= {t})::INT AS hit, row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, class) AS best, sum((round(s, 12) >= {t})::INT) OVER (PARTITION BY q) AS n FROM mt), "
    "mp AS (SELECT q, class, (CASE WHEN n = 0 AND best = 1 THEN 1 ELSE hit END)::INT AS pred FROM mh), "
    "mq AS (SELECT mp.*, bit FROM mp JOIN byr ON node = q AND byr.class = mp.class)"
)


def multilabel(spark, d, threshold: float = 0.6) -> DataFrame:
    bits = label_bits(spark, d)
    prev = bits.where(~is_test("node")).groupBy("class").agg(F.avg(F.col("bit").cast("double")).alias("share"))
    return R.multilabel_predict(held_out(spark, d), bits, prev, 1.0, 0.5, threshold)


MULTI_SQL = (SP, BITS, pairs_sql(), AFF, HELD)


@query(with_(*MULTI_SQL, MULTI.format(t="0.6::DOUBLE")) + "SELECT q, class, pred FROM mp")
def multilabel_predict(spark, d):
    return multilabel(spark, d)


COUNTS = "mc AS (SELECT class, sum(bit * pred) AS tp, sum((1 - bit) * pred) AS fp, sum(bit * (1 - pred)) AS fn FROM mq GROUP BY 1), mr AS (SELECT q, bool_and(bit = pred) AS same, avg((bit <> pred)::INT::DOUBLE) AS loss, sum(bit) AS tn, sum(pred) AS pn FROM mq GROUP BY 1)"


@query(
    with_(*MULTI_SQL, MULTI.format(t="0.6::DOUBLE"), COUNTS)
    + "SELECT round((SELECT avg(coalesce(2.0::DOUBLE * tp / nullif(2.0::DOUBLE * tp + fp + fn, 0), 0)) FROM mc), 9) AS macro_f1, round((SELECT 2.0::DOUBLE * sum(tp) / (2.0::DOUBLE * sum(tp) + sum(fp) + sum(fn)) FROM mc), 9) AS micro_f1, "
    "round(avg(same::INT::DOUBLE), 9) AS subset_accuracy, round(avg(loss), 9) AS hamming_loss, round(avg(tn), 9) AS mean_true, round(avg(pn), 9) AS mean_pred FROM mr"
)
def multilabel_metrics(spark, d):
    both = multilabel(spark, d).join(label_bits(spark, d).withColumnRenamed("node", "q"), ["q", "class"])
    m = E.multilabel_metrics(both)
    return m.select(*(F.round(c, 9).alias(c) for c in ("macro_f1", "micro_f1", "subset_accuracy", "hamming_loss", "mean_true", "mean_pred")))


def multilabel_pipeline_grid(spark, d) -> DataFrame:
    """All 480 settings: path weights in quarters over three paths, k, gamma,
    prior power and threshold, each scored on four folds of the training suppliers only."""
    bits = label_bits(spark, d).where(~is_test("node"))
    folds = E.multilabel_folds(bits, 4, 20260805).withColumn("fold", F.col("fold").cast("long"))
    wide = bits.groupBy("node").pivot("class", list(range(5))).agg(F.first("bit").cast("long"))
    nodes = suppliers(spark, d).join(folds, "node", "left").join(wide, "node", "left").fillna(-1, ["fold"]).fillna(0)
    rels = [rel(spark, d, by_dimension=True).where(~is_test("i")) for rel in (sp, sc, so)]
    counts = B.Blocks(nodes.withColumn("label", F.lit(0).cast("long")), rels).run(multilabel_votes(simplex_weights(spark)), B.MULTILABEL)
    values = [(*x,) for x in itertools.product(range(15), *MULTILABEL_SETTINGS)]
    settings = spark.createDataFrame([(at, *x) for at, x in enumerate(values)], "at long, g int, k int, gamma double, prior double, threshold double")
    out = E.evaluate_multilabel_counts(written(counts, "counts")).withColumnRenamed("g", "at").join(F.broadcast(settings), "at").drop("at")
    return out.join(F.broadcast(E.simplex(spark, 3, 4)), "g")


MULTILABEL_SETTINGS = ((10, 15), (1.0, 2.0), (0.0, 1.0), (0.3, 0.4, 0.5, 0.6))


def multilabel_votes(weights: np.ndarray) -> Callable:
    """Counts of the predictions of every setting, of training suppliers by those of the other folds."""

    def work(block: B.Block) -> dict:
        folds, queries, near, scores = B.Folds(block, 15), block.queries(), [], []
        for q in queries:
            places, (views,) = calibrated_views(block, q, folds.of(folds.fold[q]), B.rank_levels)
            score = weighted_sum(weights, views)
            at = B.best(score, 15)
            near.append(np.where(at >= 0, places[at], -1))
            scores.append(np.take_along_axis(score, at, 1))
        # without references there is no prediction
        queries, near, scores = ([x[i] for i, n in enumerate(near) if n[0, 0] >= 0] for x in (queries, near, scores))
        if not queries:
            return B.joined([], B.MULTILABEL)
        bits = np.stack([block.columns[str(c)] for c in range(5)], 1)
        fold = folds.fold[queries]
        share = {f: bits[folds.of(f).allowed].mean(0) for f in np.unique(fold)}
        return B.multilabel_settings(np.stack(near), np.stack(scores), bits, np.stack([share[f] for f in fold]), bits[queries], fold, *MULTILABEL_SETTINGS)

    return work


@query()
def multilabel_pipeline_select(spark, d):
    active = sum((F.col(f"w{i}") > 0).cast("int") for i in range(3))
    means = [F.round(c, 12).desc() for c in ("macro_f1", "micro_f1", "subset_accuracy")]
    near = [F.abs(F.col("k") - 10), F.abs(F.col("gamma") - 1.0), F.col("prior"), F.abs(F.col("threshold") - 0.5)]
    best = R.arg_max(multilabel_pipeline_grid(spark, d), [*means, active, *near, F.col("g"), F.col("k"), F.col("gamma"), F.col("threshold")])
    scores = (F.round(c, 9).alias(c) for c in ("macro_f1", "macro_f1_std", "micro_f1", "subset_accuracy"))
    return best.select("w0", "w1", "w2", "k", "gamma", "prior", "threshold", *scores)


@query(
    with_(BITS, "fa AS (SELECT node % 4 AS fold, class, count(*) AS n, avg(bit::DOUBLE) AS own FROM byr GROUP BY 1, 2)", "wh AS (SELECT class, avg(bit::DOUBLE) AS al FROM byr GROUP BY 1)")
    + "SELECT fold, (SELECT count(DISTINCT node) FROM byr) - max(n) AS reference_nodes, max(n) AS validation_nodes, round(max(abs(own - al)), 9) AS max_deviation FROM fa JOIN wh USING (class) GROUP BY 1"
)
def fold_audit(spark, d):
    out = E.fold_audit(label_bits(spark, d).withColumn("fold", F.col("node") % 4))
    return out.withColumn("max_deviation", F.round("max_deviation", 9))


@query(
    "SELECT substr(sha256(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey)), 1, 16) AS fingerprint FROM supplier"
)
def index_fingerprint(spark, d):
    from ..sources.hgb import fingerprint

    return fingerprint(suppliers(spark, d).select(F.col("node").alias("pos"), F.col("node").alias("id")))


# --- splits and resampling


def drawn_sql(seed: int) -> str:
    return f"md5(node::VARCHAR || '-{seed}')"


@query(with_(LAB) + f"SELECT node, label, ((row_number() OVER (PARTITION BY label ORDER BY {drawn_sql(7)}, node) - 1) % 5)::INT AS fold FROM lab")
def stratified_folds(spark, d):
    return E.stratified_folds(regions(spark, d), 5, 7)


@query(
    with_(LAB)
    + f"SELECT node, label, row_number() OVER (PARTITION BY label ORDER BY {drawn_sql(11)}, node) <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) AS validation FROM lab"
)
def stratified_split(spark, d):
    return E.stratified_split(regions(spark, d), 0.2, 11)


@query()
def bootstrap_ci(spark, d):
    lab = regions(spark, d)
    train = lab.where(~is_test("node")).select("node")
    out = lab.where(is_test("node")).select(F.col("node").alias("q"), F.col("label").alias("truth"))
    for beta, name in ((0.0, "base"), (0.4, "other")):
        near = written(held_out(spark, d, beta), "neighbours")
        out = out.join(R.majority_vote(near, lab).withColumnRenamed("pred", name), "q")
        out = out.join(E.ndcg(near, lab, train, K).withColumnRenamed("ndcg", f"{name}_ndcg"), "q")
    return E.bootstrap(out, 2000, 17)


@query()
def node_bootstrap_ci(spark, d):
    """Thresholds 0.4 and 0.6 of the multi-label prediction against each other, by whole suppliers."""
    base, other = (multilabel(spark, d, t).withColumnRenamed("pred", name) for t, name in ((0.4, "base"), (0.6, "other")))
    bits = label_bits(spark, d).withColumnRenamed("node", "q")
    return E.node_bootstrap(base.join(other, ["q", "class"]).join(bits, ["q", "class"]), 2000, 17)


@query()
def seeded_sample(spark, d):
    ids = suppliers(spark, d)
    return E.sample_ids(ids, ids.count() // 2, 3434)


@query()
def seed_search(spark, d):
    right = predictions(spark, d).orderBy("q").select((F.col("truth") == F.col("pred")).cast("int").alias("x"))
    right = right.toArrow().column(0).to_pylist()  # a bit for each labelled node, which every seed's sample is taken from
    return E.seed_search(spark, [right], [round(0.6 * len(right) * 0.5)], max(1, len(right) // 2), 100_000, 20)


@query()
def multilabel_folds(spark, d):
    return E.multilabel_folds(label_bits(spark, d), 4, 20260805)
