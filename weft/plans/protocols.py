"""Whole protocols: several methods, paths or selections in one frame, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import blocks as B
from ..operators import evaluation as E
from ..operators import pairs as P
from ..operators import ranking as R
from ..operators import relations as L
from ..sources.cache import written
from .queries import (
    BITS, COSINE, FOLDED, GRID_EVAL, GRID_PRED, HELD_OUT, INNER, K, L1, LAB, NDCG, PATHSIM, QUERIES, RANGE, REL, SC, SP, SPN, SQL, VHAM,
    clip, folded, graded, grid_f1, held_out, is_test, label_bits, line, ndcg_sql, own_fold, pairs_sql, query,
    regions, relative, relative_score, sc, select_best, sp, sp_pairs, stored, suppliers, table, with_, BETA_GRID, BETAS, JB,
    drawn_sql, calibrated_views, components, distance_votes, entropy, graded_counts, labelled, simplex_weights, so, pairs_in_blocks, path_votes, best_of, training_blocks, weighted_sum,
)

__all__ = ["QUERIES", "SQL"]

# --- measures beside those of the first module


@query(with_(SP, pairs_sql()) + f"SELECT q, r, 0.5::DOUBLE * {VHAM} + (1.0::DOUBLE - 0.5::DOUBLE) * {L1} AS distance FROM p")
def current_distance(spark, d):
    value = lambda s, q, r, inter, eq, mn: 0.5 * (s.sup[q] + s.sup[r] - inter - eq) + (1.0 - 0.5) * (s.act[q] + s.act[r] - 2.0 * mn)
    return pairs_in_blocks(spark, d, distance=(("inter", "eq", "mn"), value))


@query(with_(SP, SPN, pairs_sql("spn")) + f"SELECT q, r, round(CASE WHEN q = r THEN 1.0::DOUBLE ELSE {COSINE} END, 9) AS hetesim FROM p")
def hetesim_forced_diag(spark, d):
    rel, nodes = L.row_normalize(sp(spark, d)), suppliers(spark, d)
    return P.all_pairs(nodes, rel, nodes, rel).select("q", "r", F.round(M.hetesim_forced(), 9).alias("hetesim"))


def baselines(spark, d) -> DataFrame:
    """Both baselines (q, r, pathsim, hetesim) from one sum: the second divides each side by its activity."""
    # rows that are scaled by their sum have the same cosine
    hetesim = lambda *x: B.rounded(B.cosine(*x), 9)
    return pairs_in_blocks(spark, d, pathsim=(("dot",), B.pathsim), hetesim=(("dot",), hetesim))


@query(
    with_(SP, SPN, pairs_sql(), pairs_sql("spn", "n"))
    + f"SELECT p.q, p.r, {PATHSIM.replace('dot', 'p.dot').replace('sq_q', 'p.sq_q').replace('sq_r', 'p.sq_r')} AS pathsim, "
    f"round({COSINE.replace('dot', 'n.dot').replace('sq_q', 'n.sq_q').replace('sq_r', 'n.sq_r')}, 9) AS hetesim FROM p JOIN n ON p.q = n.q AND p.r = n.r"
)
def both_baselines(spark, d):
    return baselines(spark, d)


@query(
    with_(SP, "tr AS (SELECT * FROM sp WHERE i % 5 <> 0)", pairs_sql("tr"), "sd AS (SELECT count(DISTINCT j)::DOUBLE AS dims, count(*) AS stored, max(w) AS hi, min(w) AS lo FROM sp)",
          "bb AS (SELECT dims, greatest(hi - CASE WHEN stored < dims * (SELECT count(*) FROM supplier) THEN 0.0::DOUBLE ELSE lo END, 1.0::DOUBLE) AS span FROM sd)")
    + f"SELECT q, r, {clip(f'1.0::DOUBLE - (0.3::DOUBLE * {VHAM} / dims + (1.0::DOUBLE - 0.3::DOUBLE) * {L1} / (dims * span))')} AS affinity FROM p CROSS JOIN bb WHERE q % 5 <> 0 AND r % 5 <> 0"
)
def nested_bound_affinity(spark, d):
    """Among training suppliers: value-Hamming over the number of dimensions, and a value span whose minimum is
    0 unless every cell of the relation is stored."""
    rel, nodes = sp(spark, d), suppliers(spark, d)
    stored = rel.agg(F.countDistinct("j").cast("double").alias("dims"), F.count(F.lit(1)).alias("n"), F.max("w").alias("hi"), F.min("w").alias("lo"))
    whole = stored.join(nodes.agg(F.count(F.lit(1)).alias("nodes")))
    lo = F.when(F.col("n") < F.col("dims") * F.col("nodes"), 0.0).otherwise(F.col("lo"))
    bound = whole.select("dims", F.greatest(F.col("hi") - lo, F.lit(1.0)).alias("span"))
    train, own = nodes.where(~is_test("node")), rel.where(~is_test("i"))
    p = P.all_pairs(train, own, train, own).join(F.broadcast(bound))
    return p.select("q", "r", M.dimension_affinity(F.col("dims"), F.col("span"), F.lit(0.3)).alias("affinity"))


# --- evaluation of one affinity


@query(
    with_(*HELD_OUT, "one AS (SELECT q, pred, truth FROM pt)", grid_f1("1 AS x", "one").replace("SELECT 1 AS x, label", "SELECT 1 AS x, label"), NDCG + ndcg_sql("h", "nd"))
    + "SELECT round((SELECT macro_f1 FROM gf), 9) AS macro_f1, round((SELECT accuracy FROM ga), 9) AS accuracy, round(avg(ndcg), 9) AS ndcg, round(stddev_samp(ndcg) / sqrt(count(*)), 9) AS ndcg_se FROM nd"
)
def evaluate_affinity(spark, d):
    lab = regions(spark, d)
    near = written(held_out(spark, d), "neighbours")
    out = E.evaluate_affinity(near, lab, lab.where(~is_test("node")).select("node"), K)
    return out.select(*(F.round(c, 9).alias(c) for c in ("macro_f1", "accuracy", "ndcg", "ndcg_se")))


# --- the held-out run: four methods in one frame

METHODS = (
    f"gs AS (SELECT 'PathSim' AS g, 0 AS fold, q, r, {PATHSIM} AS score FROM p WHERE q % 5 = 0 AND r % 5 <> 0 "
    f"UNION ALL SELECT 'HeteSim', 0, q, r, round({COSINE}, 12) FROM n WHERE q % 5 = 0 AND r % 5 <> 0 "
    f"UNION ALL SELECT 'current', 0, q, r, -(0.5::DOUBLE * {VHAM} + (1.0::DOUBLE - 0.5::DOUBLE) * {L1}) FROM p WHERE q % 5 = 0 AND r % 5 <> 0 "
    f"UNION ALL SELECT 'historical', 0, q, r, -coalesce((0.5::DOUBLE * {VHAM} + (1.0::DOUBLE - 0.5::DOUBLE) * {L1}) / nullif(0.5::DOUBLE + (1.0::DOUBLE - 0.5::DOUBLE) * rng, 0), 'inf'::DOUBLE) FROM rng WHERE q % 5 = 0 AND r % 5 <> 0)"
)


def method_scores(spark, d) -> DataFrame:
    """(method, q, r, score) of test suppliers and training suppliers; distances are negated."""
    nodes, rel = suppliers(spark, d), sp(spark, d)
    test, own = nodes.where(is_test("node")), rel.where(is_test("i"))
    pairs = written(P.interval_ranges(P.all_pairs(test, own, nodes, rel)), "test-pairs").where(~is_test("r"))
    scores = {
        "PathSim": M.pathsim(),
        "HeteSim": F.round(M.cosine(), 12),
        "current": -M.current_distance(F.lit(0.5)),
        "historical": -M.historical_distance(F.lit(0.5)),
    }
    each = F.array(*(F.struct(F.lit(name).alias("method"), score.alias("score")) for name, score in scores.items()))
    return pairs.select("q", "r", F.explode(each).alias("s")).select("s.method", "q", "r", "s.score")


def voted(spark, d, scores: DataFrame, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """(method, q, pred, truth) by the majority of the K best."""
    return predicted(spark, d, R.top_k(scores, K, by=(*by, "q")), by)


def predicted(spark, d, near: DataFrame, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """As ``voted``, from ranked neighbours."""
    lab = regions(spark, d)
    pred = R.majority_vote(near, lab, (*by, "q"))
    return written(pred.join(lab.select(F.col("node").alias("q"), F.col("label").alias("truth")), "q"), "predictions")


@query(
    with_(SP, SPN, LAB, pairs_sql(), pairs_sql("spn", "n"), RANGE, METHODS, GRID_PRED, grid_f1("g", "gp", True))
    + "SELECT g AS method, (SELECT count(*) FROM supplier WHERE s_suppkey % 5 <> 0) AS reference_nodes, (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0) AS held_out_queries, "
    "round(macro_f1, 9) AS macro_f1, round(accuracy, 9) AS accuracy FROM gf JOIN ga USING (g)"
)
def held_out_run(spark, d):
    """PathSim, HeteSim, the current and the historical distance on held-out suppliers."""
    out = E.classification_metrics(voted(spark, d, method_scores(spark, d)), ("method",), "truth")
    sizes = suppliers(spark, d).agg(F.sum((~is_test("node")).cast("long")).alias("reference_nodes"), F.sum(is_test("node").cast("long")).alias("held_out_queries"))
    return out.join(F.broadcast(sizes)).select("method", "reference_nodes", "held_out_queries", *(F.round(c, 9).alias(c) for c in ("macro_f1", "accuracy")))


# --- the historical run: every entity is a candidate, the query too

HISTORICAL = (
    f"hs AS (SELECT 'PathSim' AS method, q, r, {PATHSIM} AS score FROM p UNION ALL SELECT 'HeteSim', q, r, round({COSINE}, 12) FROM n "
    f"UNION ALL SELECT 'range', q, r, -coalesce((0.5::DOUBLE * {VHAM} + (1.0::DOUBLE - 0.5::DOUBLE) * {L1}) / nullif(0.5::DOUBLE + (1.0::DOUBLE - 0.5::DOUBLE) * rng, 0), 'inf'::DOUBLE) FROM rng), "
    f"hh AS (SELECT method, q, r, row_number() OVER (PARTITION BY method, q ORDER BY score DESC, r) AS rank FROM hs WHERE q % 5 <> 0 QUALIFY rank <= {K}), "
    "hv AS (SELECT method, q, label, count(*) AS n, min(rank) AS first FROM hh JOIN lab ON node = r WHERE r % 5 <> 0 GROUP BY ALL), "
    "hp AS (SELECT method, q, label AS pred FROM hv QUALIFY row_number() OVER (PARTITION BY method, q ORDER BY n DESC, first) = 1), "
    "ha AS (SELECT DISTINCT method, q FROM hh)"
)


@query(
    with_(SP, SPN, LAB, pairs_sql(), pairs_sql("spn", "n"), RANGE, HISTORICAL)
    + "SELECT method, round(avg((coalesce(pred, -1) = label)::INT::DOUBLE), 9) AS accuracy, count(*) AS n FROM ha LEFT JOIN hp USING (method, q) JOIN lab ON node = q GROUP BY 1"
)
def historical_run(spark, d):
    """Votes of visible labels among the K best of all suppliers, the query included, for each labelled supplier."""
    names = ("PathSim", "HeteSim", "range")
    counts = B.Blocks(labelled(spark, d), [sp(spark, d, by_dimension=True)]).run(historical_votes, "method long, hits long, n long")
    name = F.get(F.array(*(F.lit(x) for x in names)), F.col("method").cast("int")).alias("method")
    out = counts.groupBy("method").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).where("n > 0")
    return out.select(name, F.round(F.col("hits") / F.col("n"), 9).alias("accuracy"), "n")


def historical_votes(block: B.Block) -> dict:
    """Right votes of each method. PathSim and HeteSim are 0 without a shared dimension; the distance over the range of values
    between two suppliers is taken to all suppliers, one query after the other."""
    s, (labels, code) = block.stats[0], B.classes(block.columns["label"])
    visible = np.where(block.columns["fold"] >= 0, code, -1)
    first, queries, near = np.arange(min(K, block.n)), block.queries(), []
    for q in queries:
        hit, inter, eq, dot, mn = block.sums(0, q, ("inter", "eq", "dot", "mn"))
        places = np.union1d(hit, first)
        own = B.spread(places, hit, dot)
        scores = np.stack([B.pathsim(s, q, places, own), B.rounded(B.cosine(s, q, places, own), 12)])
        found = B.nearest(places, scores, K)
        hamming, l1 = s.sup[q] + s.sup, s.act[q] + s.act
        hamming[hit] -= inter + eq
        l1[hit] -= 2.0 * mn
        span = np.empty(block.n)
        for side in (slice(q, None), slice(q, None, -1)):
            span[side] = np.maximum.accumulate(s.mx[side]) - np.minimum.accumulate(s.mi[side])
        distance = (0.5 * hamming + (1.0 - 0.5) * l1) / (0.5 + (1.0 - 0.5) * span)
        near.append(np.concatenate([found, B.best(-distance[None], K)]))
    if not queries:
        return B.joined([], "method long, hits long, n long")
    hits = (B.majority(np.stack(near), visible, len(labels)) == code[queries][:, None]).sum(0)
    return {"method": np.arange(3), "hits": hits, "n": np.full(3, len(queries))}


# --- two paths: each alone, uniform, selected and entropy weights

TWO = (
    f"tw AS (SELECT 'PathSim' AS method, a.q, a.r, round({PATHSIM}, 12) AS x, y FROM p a JOIN (SELECT q, r, round({PATHSIM}, 12) AS y FROM c) b ON a.q = b.q AND a.r = b.r "
    f"UNION ALL SELECT 'HeteSim', a.q, a.r, round({COSINE}, 12), y FROM p a JOIN (SELECT q, r, round({COSINE}, 12) AS y FROM c) b ON a.q = b.q AND a.r = b.r "
    f"UNION ALL SELECT 'relative', a.q, a.r, round({REL}, 12), y FROM p a JOIN (SELECT q, r, round({REL}, 12) AS y FROM c) b ON a.q = b.q AND a.r = b.r), "
    "grid AS (SELECT g AS step, g / 10.0::DOUBLE AS weight FROM (SELECT unnest(range(0, 11)) AS g)), "
    f"gs AS (SELECT method || step AS g, fold, q, r, round(weight * x + (1.0::DOUBLE - weight) * y, 12) AS score FROM tw CROSS JOIN fold CROSS JOIN grid WHERE {INNER})"
)
TWO_BEST = (
    "bw AS (SELECT m.method, weight FROM gm JOIN (SELECT DISTINCT method, step, method || step AS g, weight FROM tw CROSS JOIN grid) m USING (g) "
    "QUALIFY row_number() OVER (PARTITION BY m.method ORDER BY gm.macro_f1 DESC, gm.accuracy DESC, abs(weight - 0.5), step) = 1), "
    "tr2 AS (SELECT * FROM tw WHERE method = 'relative' AND q % 5 <> 0 AND r % 5 <> 0), "
    "en AS (SELECT 0 AS path, r, x / nullif(sum(x) OVER (PARTITION BY r), 0) AS s FROM tr2 UNION ALL SELECT 1, r, y / nullif(sum(y) OVER (PARTITION BY r), 0) FROM tr2), "
    "eh AS (SELECT path, r, sum(CASE WHEN s > 0 THEN -s * ln(s) ELSE 0 END) / nullif(ln(count(*)), 0) AS h FROM en GROUP BY 1, 2), "
    "ew AS (SELECT path, 1 - avg(coalesce(h, 1)) AS raw FROM eh GROUP BY 1), "
    "e0 AS (SELECT round((SELECT raw FROM ew WHERE path = 0) / (SELECT sum(raw) FROM ew), 9) AS w), "
    "te AS (SELECT * FROM tw WHERE q % 5 = 0 AND r % 5 <> 0), "
    "vs AS (SELECT method, 'path_1' AS variant, q, r, x AS score FROM te UNION ALL SELECT method, 'path_2', q, r, y FROM te "
    "UNION ALL SELECT method, 'uniform_fusion', q, r, round(0.5::DOUBLE * x + 0.5::DOUBLE * y, 12) FROM te "
    "UNION ALL SELECT method, 'selected_fusion', q, r, round(weight * x + (1.0::DOUBLE - weight) * y, 12) FROM te JOIN bw USING (method) "
    "UNION ALL SELECT method, 'entropy_fusion', q, r, round(w * x + (1.0::DOUBLE - w) * y, 12) FROM te CROSS JOIN e0 WHERE method = 'relative'), "
    f"vh AS (SELECT method, variant, q, r, row_number() OVER (PARTITION BY method, variant, q ORDER BY score DESC, r) AS rank FROM vs QUALIFY rank <= {K}), "
    "vv AS (SELECT method, variant, q, label, count(*) AS n, min(rank) AS first FROM vh JOIN lab ON node = r GROUP BY ALL), "
    "vp AS (SELECT method, variant, q, v.label AS pred, t.label AS truth FROM vv v JOIN lab t ON t.node = q QUALIFY row_number() OVER (PARTITION BY method, variant, q ORDER BY n DESC, first) = 1)"
)


TWO_METHODS = ("PathSim", "HeteSim", "relative")
VARIANTS = ("path_1", "path_2", "uniform_fusion", "selected_fusion", "entropy_fusion")


def two_path_scores(block: B.Block, sums: list[tuple], q: int, refs) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """The references that can be among the nearest, and by method and path their scores; ``sums`` by path: places, inter, dot, mn."""
    places = np.unique(np.concatenate([refs.first, *(x[0][refs.allowed[x[0]]] for x in sums)]))
    by_path = []
    for s, (hit, *own) in zip(block.stats, sums, strict=True):
        keep = refs.allowed[hit]
        inter, dot, mn = (B.spread(places, hit[keep], x[keep]) for x in own)
        scores = B.pathsim(s, q, places, dot), B.cosine(s, q, places, dot), B.relative(*B.discrepancies(s, q, places, inter, mn), 0.4)
        by_path.append([B.rounded(x, 12) for x in scores])
    return places, list(zip(*by_path, strict=True))


def mixed(weight, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return B.rounded(weight * x + (1.0 - weight) * y, 12)


def two_path_votes(block: B.Block) -> dict:
    """Votes of training suppliers, g is the method times 11 plus the step of the weight; and with g -1 and -2 the columns of
    each path's relative scores among all training suppliers, their number n and the sum of their entropies, gain."""
    folds, steps = B.Folds(block, K), np.arange(11)[:, None] / 10.0
    train, queries, near = folds.of(), set(block.queries()), []
    own = block.lo + np.flatnonzero(folds.fold[block.lo : block.hi] >= 0)
    total = np.zeros(2)
    for q in own.tolist():
        sums = [block.sums(path, q, ("inter", "dot", "mn")) for path in range(2)]
        for path, (hit, inter, _, mn) in enumerate(sums):
            keep, s = train.allowed[hit], block.stats[path]
            scores = B.relative(*B.discrepancies(s, q, hit[keep], inter[keep], mn[keep]), 0.4) if s.sup[q] else np.ones(train.empty[path])
            total[path] += entropy(B.rounded(scores, 12), train.total)
        if q in queries:
            places, scores = two_path_scores(block, sums, q, folds.of(folds.fold[q]))
            near.append(B.nearest(places, np.concatenate([mixed(steps, x, y) for x, y in scores]), K))
    zero = np.zeros(2)
    entropies = {"g": np.array([-1, -2]), "fold": zero, "truth": zero, "pred": zero, "n": np.full(2, len(own)), "gain": total}
    return B.joined([B.graded(block, folds, block.queries(), near), entropies], B.COUNTS)


def variant_votes(weights: dict[int, float], entropy_weight: float) -> Callable:
    """Votes of test suppliers by training suppliers, g is the method times 5 plus the variant."""

    def work(block: B.Block) -> dict:
        labels, code = B.classes(block.columns["label"])
        folds, near = B.Folds(block, K), []
        own = block.lo + np.flatnonzero((folds.fold[block.lo : block.hi] < 0) & (code[block.lo : block.hi] >= 0))
        for q in own.tolist():
            sums = [block.sums(path, q, ("inter", "dot", "mn")) for path in range(2)]
            places, scores = two_path_scores(block, sums, q, folds.of())
            tried = [np.stack([x, y, mixed(0.5, x, y), mixed(weights.get(m, 0.5), x, y), mixed(entropy_weight, x, y)]) for m, (x, y) in enumerate(scores)]
            near.append(B.nearest(places, np.concatenate(tried), K))
        if not near:
            return B.joined([], B.COUNTS)
        return B.counted(labels, np.zeros(len(own), int), code[own], B.majority(np.stack(near), code, len(labels)))

    return work


def evaluate_variants(spark, d) -> DataFrame:
    """Metrics of each method's variants on the test suppliers; the weight is chosen on the training folds."""
    blocks = B.Blocks(labelled(spark, d), [rel(spark, d, by_dimension=True) for rel in (sp, sc)])
    counts = blocks.run(two_path_votes, B.COUNTS).groupBy("g", "fold", "truth", "pred").agg(F.sum("n").alias("n"), F.sum("gain").alias("gain"))
    counts = written(counts, "counts")
    settings = spark.createDataFrame([(m * 11 + step, m, step, step / 10.0) for m in range(3) for step in range(11)], "g long, method int, step long, weight double")
    rows = graded_counts(counts.where("g >= 0"), settings)
    best = R.arg_max(rows, [F.desc("macro_f1"), F.desc("accuracy"), F.abs(F.col("weight") - 0.5), F.col("step")], ("method",)).select("method", "weight")
    weights = {r["method"]: r["weight"] for r in best.collect()}
    raw = {r["g"]: 1.0 - r["gain"] / r["n"] for r in counts.where("g < 0 AND n > 0").collect()}
    total = sum(raw.values())
    share = float(B.rounded(np.float64(raw[-1] / total), 9)) if total else 0.0
    names = [(m * 5 + v, method, variant) for m, method in enumerate(TWO_METHODS) for v, variant in enumerate(VARIANTS)]
    # without a choice there is no selected fusion; entropy weights are those of one method
    names = [x for x in names if (x[2] != "selected_fusion" or x[0] // 5 in weights) and (x[2] != "entropy_fusion" or x[1] == "relative")]
    out = blocks.run(variant_votes(weights, share), B.COUNTS).join(F.broadcast(spark.createDataFrame(names, "g long, method string, variant string")), "g")
    out = out.groupBy("method", "variant", "truth", "pred").agg(F.sum("n").alias("n"))
    return E.classification_metrics(written(out, "counts"), ("method", "variant"), "truth")


@query(
    with_(SP, SC, LAB, pairs_sql(), pairs_sql("sc", "c"), FOLDED, TWO, GRID_EVAL, TWO_BEST, grid_f1("method, variant", "vp", True).replace("gc ", "gc2 ").replace("gc G", "gc2 G").replace("gf ", "gf2 ").replace("ga ", "ga2 "))
    + "SELECT method, variant, round(gf2.macro_f1, 9) AS macro_f1, round(ga2.accuracy, 9) AS accuracy FROM gf2 JOIN ga2 USING (method, variant)"
)
def two_path_table(spark, d):
    return evaluate_variants(spark, d).select("method", "variant", *(F.round(c, 9).alias(c) for c in ("macro_f1", "accuracy")))


# --- three paths: selection of path weights, and of the whole configuration

SO = "so AS (SELECT l_suppkey AS i, l_orderkey AS j, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2)"
THREE = (SP, SC, SO, LAB, pairs_sql(), pairs_sql("sc", "c"), pairs_sql("so", "o"), FOLDED)
GRID3 = f"grid AS ({SQL['simplex_grid']})"
VIEWS = (
    f"v0 AS (SELECT a.q, a.r, a.s AS s0, b.s AS s1, e.s AS s2 FROM (SELECT q, r, {REL} AS s FROM p) a JOIN (SELECT q, r, {REL} AS s FROM c) b ON a.q = b.q AND a.r = b.r "
    f"JOIN (SELECT q, r, {REL} AS s FROM o) e ON a.q = e.q AND a.r = e.r)"
)
ACTIVE = "((w0 > 0)::INT + (w1 > 0)::INT + (w2 > 0)::INT)"


def simplex(spark) -> DataFrame:
    return E.simplex(spark, 3, 4).withColumn("g", F.col("g").cast("long"))


@query(
    with_(*THREE, VIEWS, GRID3, f"gs AS (SELECT g, fold, q, r, round(w0 * s0 + w1 * s1 + w2 * s2, 12) AS score FROM v0 CROSS JOIN fold CROSS JOIN grid WHERE {INNER})", GRID_EVAL)
    + f"SELECT g, w0, w1, w2, round(macro_f1, 9) AS macro_f1, round(macro_f1_se, 9) AS macro_f1_se, round(ndcg, 9) AS ndcg FROM gm JOIN grid USING (g) ORDER BY gm.macro_f1 DESC, gm.ndcg DESC, {ACTIVE}, g LIMIT 1"
)
def path_fusion_select(spark, d):
    """Weights of three paths in quarters: macro F1, then NDCG, then fewer paths, then the first."""
    grid = simplex(spark)
    counts = training_blocks(spark, d, sp, sc, so).run(path_votes(simplex_weights(spark)), B.COUNTS)
    active = sum((F.col(f"w{i}") > 0).cast("int") for i in range(3))
    best = best_of(graded_counts(counts, grid), [active], "ndcg")
    return best.select("g", "w0", "w1", "w2", *(F.round(c, 9).alias(c) for c in ("macro_f1", "macro_f1_se", "ndcg")))


KS, GAMMAS, PRIORS = (5, 10, 15, 20), (0.0, 1.0, 2.0), (0.0, 0.5, 1.0)
CALIBRATED = (
    f"lo AS (SELECT fold, q, r, unnest([0, 1, 2]) AS path, unnest([s0, s1, s2]) AS s FROM v0 CROSS JOIN fold WHERE {INNER}), "
    "ca AS (SELECT 0 AS cal, fold, q, r, path, coalesce((rank() OVER (PARTITION BY path, fold, q ORDER BY s) + (count(*) OVER (PARTITION BY path, fold, q, s) - 1) / 2.0::DOUBLE - 1) "
    "/ nullif(count(*) OVER (PARTITION BY path, fold, q) - 1.0::DOUBLE, 0), 0.0::DOUBLE) AS s FROM lo "
    "UNION ALL SELECT 1, fold, q, r, path, coalesce((s - min(s) OVER (PARTITION BY path, fold, q)) / nullif(max(s) OVER (PARTITION BY path, fold, q) - min(s) OVER (PARTITION BY path, fold, q), 0), 0.0::DOUBLE) FROM lo), "
    "cw AS (SELECT cal, fold, q, r, max(CASE WHEN path = 0 THEN s END) AS s0, max(CASE WHEN path = 1 THEN s END) AS s1, max(CASE WHEN path = 2 THEN s END) AS s2 FROM ca GROUP BY ALL)"
)
SETTINGS = (
    f"sh AS (SELECT g, fold, q, r, score, row_number() OVER (PARTITION BY g, fold, q ORDER BY score DESC, r) AS rank FROM gs QUALIFY rank <= {max(KS)}), "
    f"sk AS (SELECT sh.*, label, k, gamma FROM sh JOIN lab ON node = r CROSS JOIN (SELECT unnest({list(KS)}) AS k) CROSS JOIN (SELECT unnest({list(GAMMAS)})::DOUBLE AS gamma) WHERE rank <= k), "
    "sv AS (SELECT g, fold, k, gamma, q, label, sum(CASE WHEN gamma = 0 THEN 1.0::DOUBLE ELSE pow(greatest(score, 0.0::DOUBLE), gamma) END) AS s, min(rank) AS first FROM sk GROUP BY ALL), "
    "spr AS (SELECT fold, label, count(*) / sum(count(*)) OVER (PARTITION BY fold)::DOUBLE AS share FROM lab CROSS JOIN fold WHERE node % 5 <> 0 AND (node // 5) % 4 <> fold GROUP BY 1, 2), "
    "se AS (SELECT t.*, spr.label, prior, coalesce(s, 0) / CASE WHEN prior = 0 THEN 1.0::DOUBLE ELSE pow(share, prior) END AS s, coalesce(first, t.k + 1) AS first "
    "FROM (SELECT DISTINCT g, fold, k, gamma, q FROM sk) t JOIN spr ON spr.fold = t.fold LEFT JOIN sv ON sv.g = t.g AND sv.fold = t.fold AND sv.k = t.k AND sv.gamma = t.gamma AND sv.q = t.q AND sv.label = spr.label "
    f"CROSS JOIN (SELECT unnest({list(PRIORS)})::DOUBLE AS prior)), "
    "sm AS (SELECT *, max(s) OVER (PARTITION BY g, fold, k, gamma, prior, q) AS m FROM se), "
    "sq AS (SELECT g, fold, k, gamma, prior, q, label AS pred FROM sm WHERE abs(s - m) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(m) QUALIFY row_number() OVER (PARTITION BY g, fold, k, gamma, prior, q ORDER BY first, label) = 1), "
    "sx AS (SELECT sq.*, label AS truth FROM sq JOIN lab ON node = q)"
)


def calibrated_votes(weights: np.ndarray) -> Callable:
    """Votes of training suppliers for every setting: path weights in quarters under rank and min-max calibration, k, gamma
    and prior power, in this order."""

    def work(block: B.Block) -> dict:
        labels, code = B.classes(block.columns["label"])
        folds, queries, near, scores = B.Folds(block, max(KS)), block.queries(), [], []
        for q in queries:
            places, views = calibrated_views(block, q, folds.of(folds.fold[q]), B.rank_levels, B.minmax_levels)
            score = np.concatenate([weighted_sum(weights, x) for x in views])
            at = B.best(score, max(KS))
            near.append(np.where(at >= 0, places[at], -1))
            scores.append(np.take_along_axis(score, at, 1))
        if not queries:
            return B.joined([], B.COUNTS)
        fold = folds.fold[queries]
        sizes = {f: np.bincount(code[folds.of(f).allowed & (code >= 0)], minlength=len(labels)) for f in np.unique(fold)}
        share = np.stack([sizes[f] / sizes[f].sum() for f in fold])
        pred = B.weighted_settings(np.stack(near), np.stack(scores), code, share, KS, GAMMAS, PRIORS)
        return B.counted(labels, fold, code[queries], pred.reshape(len(queries), -1))

    return work


@query(
    with_(*THREE, VIEWS, GRID3, CALIBRATED, "gs AS (SELECT g + 15 * cal AS g, fold, q, r, round(w0 * s0 + w1 * s1 + w2 * s2, 12) AS score FROM cw CROSS JOIN grid)", SETTINGS, grid_f1("g, k, gamma, prior, fold", "sx"))
    + "SELECT CASE WHEN t.g < 15 THEN 'rank' ELSE 'minmax' END AS calibration, w0, w1, w2, k, gamma, prior, round(macro_f1, 9) AS macro_f1, round(macro_f1_std, 9) AS macro_f1_std, round(accuracy, 9) AS accuracy, n AS configurations "
    "FROM (SELECT g, k, gamma, prior, round(avg(macro_f1), 12) AS macro_f1, stddev_samp(macro_f1) AS macro_f1_std, round(avg(accuracy), 12) AS accuracy, count(*) OVER () AS n FROM gf JOIN ga USING (g, k, gamma, prior, fold) GROUP BY 1, 2, 3, 4) t "
    f"JOIN grid ON grid.g = t.g % 15 ORDER BY t.macro_f1 DESC, t.accuracy DESC, {ACTIVE}, abs(k - 10), abs(gamma - 1), prior, t.g >= 15, t.g, k, gamma LIMIT 1"
)
def enhanced_config_select(spark, d):
    """All 1,080 settings: two calibrations, 15 path weights, k, gamma and prior power, on the training folds."""
    counts = training_blocks(spark, d, sp, sc, so).run(calibrated_votes(simplex_weights(spark)), B.COUNTS)
    counts = written(counts.groupBy("g", "fold", "truth", "pred").agg(F.sum("n").alias("n")), "counts")
    values = product(range(30), KS, GAMMAS, PRIORS)
    settings = spark.createDataFrame([(at, *x) for at, x in enumerate(values)], "at long, g long, k int, gamma double, prior double")
    means = E.summarise_folds(E.classification_metrics(counts, ("g", "fold")), ("g",), ("accuracy",))
    out = means.withColumnRenamed("g", "at").join(F.broadcast(settings), "at")
    out = out.select("g", "k", "gamma", "prior", "macro_f1_std", *(F.round(c, 12).alias(c) for c in ("macro_f1", "accuracy")))
    grid = simplex(spark).withColumnRenamed("g", "_g")
    out = out.join(F.broadcast(grid), F.col("g") % 15 == F.col("_g"))
    active = sum((F.col(f"w{i}") > 0).cast("int") for i in range(3))
    keys = [F.desc("macro_f1"), F.desc("accuracy"), active, F.abs(F.col("k") - 10), F.abs(F.col("gamma") - 1), F.col("prior"), F.col("g") >= 15, F.col("g"), F.col("k"), F.col("gamma")]
    best = R.arg_max(out, keys).withColumn("calibration", F.when(F.col("g") < 15, "rank").otherwise("minmax"))
    n = 2 * 15 * len(KS) * len(GAMMAS) * len(PRIORS)
    return best.select("calibration", "w0", "w1", "w2", "k", "gamma", "prior", *(F.round(c, 9).alias(c) for c in ("macro_f1", "macro_f1_std", "accuracy")), F.lit(n).cast("long").alias("configurations"))


# --- nested cross-validation: the weight is chosen within each outer fold, then predicts that fold

OUTER = (
    "oi AS (SELECT a.fold AS outer_fold, b.fold AS fold FROM fold a CROSS JOIN fold b WHERE a.fold <> b.fold), "
    f"gs AS (SELECT outer_fold * 100 + g AS g, fold, q, r, {relative('beta')} AS score FROM jb CROSS JOIN oi CROSS JOIN grid "
    "WHERE q % 5 <> 0 AND r % 5 <> 0 AND (q // 5) % 4 = fold AND (r // 5) % 4 <> fold AND (r // 5) % 4 <> outer_fold)"
)
OUTER_EVAL = f"{GRID_PRED}, {grid_f1('g, fold')}, gm AS (SELECT g, round(avg(macro_f1), 12) AS macro_f1, round(avg(accuracy), 12) AS accuracy FROM gf JOIN ga USING (g, fold) GROUP BY 1)"
CHOSEN = (
    "ch AS (SELECT gm.g // 100 AS outer_fold, beta, gm.macro_f1, gm.accuracy FROM gm JOIN grid ON grid.g = gm.g % 100 "
    "QUALIFY row_number() OVER (PARTITION BY gm.g // 100 ORDER BY gm.macro_f1 DESC, gm.accuracy DESC, beta) = 1)"
)


#: Weights that every training supplier is predicted with out of its fold.
FIXED_BETAS = (*BETAS, 0.5)
OUT = 1000


def nested_votes(out_of_fold: bool) -> Callable:
    """Votes by inner fold: g is the outer fold times 100 plus the weight's place. With ``out_of_fold`` also those with the
    references of all other folds, g from OUT, for each of FIXED_BETAS."""

    def work(block: B.Block) -> dict:
        folds, (labels, code) = B.Folds(block, K), B.classes(block.columns["label"])
        betas, near = np.array(FIXED_BETAS)[:, None], {}
        for q in block.queries():
            own = folds.fold[q]
            hit, inter, mn = block.sums(0, q, ("inter", "mn"))
            keep = folds.of(own).allowed[hit]
            hit, inter, mn = hit[keep], inter[keep], mn[keep]
            keep = B.contenders(*B.discrepancies(block.stats[0], q, hit, inter, mn), [folds.fold[hit] != o for o in range(4) if o != own], K)
            # with the smallest ids, whichever fold is left out
            places = np.union1d(hit[keep], np.concatenate([folds.of(own).first, *(folds.of(own, o).first for o in range(4) if o != own)]))
            j, bc = B.discrepancies(block.stats[0], q, places, *(B.looked_up(places, hit, x) for x in (inter, mn)))
            scores = B.relative(j, bc, betas)
            if out_of_fold:
                near.setdefault(OUT, []).append((q, B.nearest(places, scores, K)))
            for o in range(4):
                if o != own:
                    keep = folds.fold[places] != o
                    near.setdefault(o * 100, []).append((q, B.nearest(places[keep], scores[: len(BETAS), keep], K)))
        parts = []
        for first, rows in near.items():
            at, found = np.array([q for q, _ in rows]), np.stack([x for _, x in rows])
            votes = B.counted(labels, folds.fold[at], code[at], B.majority(found, code, len(labels)))
            parts.append(votes | {"g": votes["g"] + first})
        return B.joined(parts, B.COUNTS)

    return work


def nested_counts(spark, d, out_of_fold: bool = False) -> DataFrame:
    counts = training_blocks(spark, d, sp).run(nested_votes(out_of_fold), B.COUNTS)
    return written(counts.groupBy("g", "fold", "truth", "pred").agg(F.sum("n").alias("n")), "counts")


def nested_choices(spark, counts: DataFrame) -> DataFrame:
    """(outer_fold, beta, macro_f1, accuracy): per outer fold the weight that is best on its inner folds."""
    grid = spark.createDataFrame(list(enumerate(BETAS)), "step long, beta double")
    means = E.summarise_folds(E.classification_metrics(counts.where(F.col("g") < OUT), ("g", "fold")), ("g",), ("accuracy",))
    rows = means.select(F.floor(F.col("g") / 100).alias("outer_fold"), (F.col("g") % 100).alias("step"), F.round("macro_f1", 12).alias("macro_f1"), F.round("accuracy", 12).alias("accuracy"))
    return written(R.arg_max(rows.join(F.broadcast(grid), "step"), [F.desc("macro_f1"), F.desc("accuracy"), F.col("beta")], ("outer_fold",)), "choices")


@query(
    with_(SP, LAB, pairs_sql(), JB, FOLDED, BETA_GRID, OUTER, OUTER_EVAL, CHOSEN)
    + "SELECT outer_fold, beta, round(macro_f1, 9) AS macro_f1, round(accuracy, 9) AS accuracy FROM ch"
)
def nested_selection(spark, d):
    return nested_choices(spark, nested_counts(spark, d)).select("outer_fold", "beta", *(F.round(c, 9).alias(c) for c in ("macro_f1", "accuracy")))


@query(with_(SP, LAB, pairs_sql(), JB, FOLDED, BETA_GRID, OUTER, OUTER_EVAL, CHOSEN) + "SELECT beta, count(*) AS n FROM ch GROUP BY 1")
def fold_stability(spark, d):
    """How often each weight was chosen over the outer folds."""
    return E.frequency(nested_choices(spark, nested_counts(spark, d)), "beta")


@query(
    with_(SP, LAB, pairs_sql(), JB, FOLDED, BETA_GRID, OUTER, OUTER_EVAL, CHOSEN,
          f"os AS (SELECT 'selected' AS g, fold, q, r, {relative('beta')} AS score FROM jb JOIN ch ON (q // 5) % 4 = outer_fold JOIN fold ON fold = outer_fold WHERE {INNER} "
          f"UNION ALL SELECT 'current', fold, q, r, {relative('0.5::DOUBLE')} FROM jb CROSS JOIN fold WHERE {INNER} UNION ALL SELECT 'magnitude', fold, q, r, {relative('0.0::DOUBLE')} FROM jb CROSS JOIN fold WHERE {INNER})",
          GRID_PRED.replace("gh AS", "oh AS").replace("FROM gs", "FROM os").replace("gv AS", "ov AS").replace("FROM gh", "FROM oh").replace("gp AS", "op AS").replace("FROM gv", "FROM ov"),
          grid_f1("g", "op", True).replace("gc ", "oc ").replace("gc G", "oc G").replace("gf ", "of_ ").replace("ga ", "oa "))
    + "SELECT g AS method, round(macro_f1, 9) AS macro_f1, round(accuracy, 9) AS accuracy, round(macro_f1 - (SELECT macro_f1 FROM of_ WHERE g = 'current'), 9) AS macro_f1_gain, "
    "round(accuracy - (SELECT accuracy FROM oa WHERE g = 'current'), 9) AS accuracy_gain FROM of_ JOIN oa USING (g)"
)
def nested_out_of_fold(spark, d):
    """Each training supplier is predicted once, with the weight chosen without its fold; fixed weights beside it."""
    counts = nested_counts(spark, d, out_of_fold=True)
    tried = spark.createDataFrame([(b, OUT + at) for at, b in enumerate(FIXED_BETAS)], "beta double, g long")
    chosen = nested_choices(spark, counts).select(F.lit("selected").alias("method"), F.col("outer_fold").alias("fold"), "beta")
    fixed = spark.createDataFrame([(m, f, b) for m, b in (("current", 0.5), ("magnitude", 0.0)) for f in range(4)], "method string, fold long, beta double")
    settings = fixed.unionByName(chosen).join(F.broadcast(tried), "beta")
    out = E.out_of_fold(counts.join(F.broadcast(settings), ["g", "fold"]), "current")
    return out.select("method", *(F.round(c, 9).alias(c) for c in ("macro_f1", "accuracy", "macro_f1_gain", "accuracy_gain")))


# --- effective weight over repeated splits

SEEDS = tuple(range(20260801, 20260806))


def _splits_sql() -> str:
    one = " UNION ALL ".join(
        f"SELECT {at} AS fold, node, label, row_number() OVER (PARTITION BY label ORDER BY {drawn_sql(seed)}, node) <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) AS validation FROM lab WHERE node % 5 <> 0"
        for at, seed in enumerate(SEEDS)
    )
    return f"split AS ({one})"


TUNE = (
    _splits_sql(), "db AS (SELECT dims::DOUBLE AS b0, greatest(dims * ((SELECT max(mx) FROM ps) - (SELECT min(mi) FROM ps)), 1.0::DOUBLE) AS b1 FROM ps_d)",
    "grid AS (SELECT g, g / 10.0::DOUBLE AS alpha FROM (SELECT unnest(range(0, 11)) AS g))",
    f"gs AS (SELECT g, a.fold, q, r, round(-(alpha * {VHAM} / b0 + (1.0::DOUBLE - alpha) * {L1} / b1), 15) AS score FROM p JOIN split a ON a.node = q AND a.validation JOIN split b ON b.node = r AND NOT b.validation AND b.fold = a.fold CROSS JOIN db CROSS JOIN grid)",
)


@query(
    with_(SP, LAB, pairs_sql(), *TUNE, GRID_PRED, grid_f1("g, fold"))
    + "SELECT alpha, CASE WHEN alpha <= 0 THEN 0.0::DOUBLE WHEN alpha >= 1 THEN 1.0::DOUBLE ELSE alpha * b1 / (b0 * (1.0::DOUBLE - alpha) + alpha * b1) END AS lambda, round(avg(macro_f1), 9) AS macro_f1, round(stddev_samp(macro_f1), 9) AS macro_f1_std, "
    "round(avg(accuracy), 9) AS accuracy, round(stddev_samp(accuracy), 9) AS accuracy_std, row_number() OVER (ORDER BY round(avg(macro_f1), 12) DESC, round(avg(accuracy), 12) DESC, abs(alpha - 0.5), alpha) = 1 AS selected "
    "FROM gf JOIN ga USING (g, fold) JOIN grid USING (g) CROSS JOIN db GROUP BY alpha, b0, b1"
)
def tune_effective_weight(spark, d):
    """The weight of the global distance over repeated stratified splits of the training suppliers."""
    train, grid, nodes = regions(spark, d).where(~is_test("node")), line(spark, 10, "alpha"), labelled(spark, d).select("node", "label")
    names = [f"split{at}" for at in range(len(SEEDS))]
    for name, seed in zip(names, SEEDS, strict=True):
        side = E.stratified_split(train, 0.2, seed).select("node", F.col("validation").cast("long").alias(name))
        nodes = nodes.join(side, "node", "left").fillna(-1, [name])
    blocks = B.Blocks(nodes, [sp(spark, d, by_dimension=True)])
    s = blocks.stats[0]
    b0 = float(s.dims)
    b1 = float(max(b0 * (s.mx.max(initial=-np.inf) - s.mi.min(initial=np.inf)), 1.0)) if blocks.n else 1.0
    alphas = np.arange(11)[:, None] / 10.0
    score = lambda hamming, l1: B.rounded(-(alphas * hamming / b0 + (1.0 - alphas) * l1 / b1), 15)
    counts = blocks.run(distance_votes(score, *names), B.COUNTS).groupBy("g", "fold", "truth", "pred").agg(F.sum("n").alias("n"))
    bounds = spark.createDataFrame([(b0, b1)], "b0 double, b1 double")
    means = E.classification_metrics(written(counts, "counts"), ("g", "fold")).groupBy("g").agg(
        F.avg("macro_f1").alias("macro_f1"), F.stddev_samp("macro_f1").alias("macro_f1_std"), F.avg("accuracy").alias("accuracy"), F.stddev_samp("accuracy").alias("accuracy_std")
    )
    rows = means.join(F.broadcast(grid), "g").join(F.broadcast(bounds))
    best = R.arg_max(rows, [F.round("macro_f1", 12).desc(), F.round("accuracy", 12).desc(), F.abs(F.col("alpha") - 0.5), F.col("alpha")]).select(F.col("g").alias("_best"))
    lam = M.lambda_of_alpha(F.col("alpha"), F.col("b0"), F.col("b1")).alias("lambda")
    return rows.join(F.broadcast(best)).select(
        "alpha", lam, *(F.round(c, 9).alias(c) for c in ("macro_f1", "macro_f1_std", "accuracy", "accuracy_std")), (F.col("g") == F.col("_best")).alias("selected")
    )


# --- several labels: component weight, and a fixed configuration on held-out suppliers


def _multi_sql(source: str, by: str, gamma: str, power: str, threshold: str, prevalence: str) -> str:
    """CTEs from neighbours ``source`` ({by}, q, r, score) to predictions mq ({by}, q, class, bit, pred)."""
    w = "1.0::DOUBLE" if gamma == "0" else f"pow(greatest(score, 0.0::DOUBLE), {gamma})"
    power_of = "1.0::DOUBLE" if power == "0" else f"pow(greatest(share, 1e-12), {power})"
    one = f"{by}, " if by else ""
    on = "USING (fold, class)" if "fold" in by else "USING (class)"
    return (
        f"prev AS ({prevalence}), mw AS (SELECT h.*, {w} AS w, sum({w}) OVER (PARTITION BY {one}q) AS tw FROM {source} h), "
        f"mm AS (SELECT {one}q, class, sum((CASE WHEN tw <= 1e-8 THEN 1.0::DOUBLE ELSE w END) * bit) / sum(CASE WHEN tw <= 1e-8 THEN 1.0::DOUBLE ELSE w END) AS s FROM mw JOIN byr ON node = r GROUP BY ALL), "
        f"ms AS (SELECT {one}q, class, s / {power_of} AS s FROM mm JOIN prev {on}), "
        f"mt AS (SELECT {one}q, class, CASE WHEN max(s) OVER w > 0 THEN s / max(s) OVER w ELSE 0 END AS s FROM ms WINDOW w AS (PARTITION BY {one}q)), "
        f"mh AS (SELECT {one}q, class, (round(s, 12) >= {threshold})::INT AS hit, row_number() OVER (PARTITION BY {one}q ORDER BY round(s, 12) DESC, class) AS best, sum((round(s, 12) >= {threshold})::INT) OVER (PARTITION BY {one}q) AS n FROM mt), "
        f"mq AS (SELECT {one}q, mh.class, (CASE WHEN n = 0 AND best = 1 THEN 1 ELSE hit END)::INT AS pred, bit FROM mh JOIN byr ON node = q AND byr.class = mh.class)"
    )


COMPONENTS = (0.0, 0.25, 0.5, 0.75, 1.0)
COMPONENT_GRID = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({g}::BIGINT, {b}::DOUBLE)" for g, b in enumerate(COMPONENTS)) + ") AS t(g, weight))"
MULTI_F1 = (
    "mc AS (SELECT g, fold, class, sum(bit * pred) AS tp, sum((1 - bit) * pred) AS fp, sum(bit * (1 - pred)) AS fn FROM mq GROUP BY ALL), "
    "mf AS (SELECT g, fold, avg(coalesce(2.0::DOUBLE * tp / nullif(2.0::DOUBLE * tp + fp + fn, 0), 0)) AS macro_f1, coalesce(2.0::DOUBLE * sum(tp) / nullif(2.0::DOUBLE * sum(tp) + sum(fp) + sum(fn), 0), 0) AS micro_f1 FROM mc GROUP BY ALL)"
)


@query(
    with_(SP, BITS, pairs_sql(), JB, FOLDED, COMPONENT_GRID, f"gs AS (SELECT g, fold, q, r, {relative('weight')} AS score FROM jb CROSS JOIN fold CROSS JOIN grid WHERE {INNER})",
          f"gt AS (SELECT g, fold, q, r, score FROM gs QUALIFY row_number() OVER (PARTITION BY g, fold, q ORDER BY score DESC, r) <= {K})",
          _multi_sql("gt", "g, fold", "1.0", "0", "0.5", "SELECT fold, class, avg(bit::DOUBLE) AS share FROM byr CROSS JOIN fold WHERE node % 5 <> 0 AND (node // 5) % 4 <> fold GROUP BY 1, 2"), MULTI_F1)
    + "SELECT weight, round(avg(macro_f1), 9) AS macro_f1, round(stddev_samp(macro_f1), 9) AS macro_f1_std, round(avg(micro_f1), 9) AS micro_f1 FROM mf JOIN grid USING (g) "
    "GROUP BY weight ORDER BY round(avg(mf.macro_f1), 12) DESC, round(avg(mf.micro_f1), 12) DESC, abs(weight - 0.5), weight LIMIT 1"
)
def multilabel_component_select(spark, d):
    """The component weight of one path for several labels, on the training folds only."""
    grid = spark.createDataFrame(list(enumerate(COMPONENTS)), "g long, weight double")
    rel = sp(spark, d).where(~is_test("i"))
    nodes = suppliers(spark, d).where(~is_test("node")).withColumn("fold", own_fold("node"))
    pairs = P.candidate_pairs(nodes, rel, nodes, rel, K).join(F.broadcast(grid))
    scored = pairs.select("g", "fold", "q", "r", M.relative_affinity(M.jaccard(), M.bray_curtis(), F.col("weight")).alias("score"))
    bits = label_bits(spark, d).where(~is_test("node")).withColumn("fold", own_fold("node"))
    out = E.evaluate_multilabel_grid(scored, bits, (K,), (1.0,), (0.0,), (0.5,)).join(F.broadcast(grid), "g")
    best = R.arg_max(out, [F.round("macro_f1", 12).desc(), F.round("micro_f1", 12).desc(), F.abs(F.col("weight") - 0.5), F.col("weight")])
    return best.select("weight", *(F.round(c, 9).alias(c) for c in ("macro_f1", "macro_f1_std", "micro_f1")))


FIXED = (
    "fr AS (SELECT q, r, s0, s1, coalesce((rank() OVER (PARTITION BY q ORDER BY s0) + (count(*) OVER (PARTITION BY q, s0) - 1) / 2.0::DOUBLE - 1) / nullif(count(*) OVER (PARTITION BY q) - 1.0::DOUBLE, 0), 0.0::DOUBLE) AS c0, "
    "coalesce((rank() OVER (PARTITION BY q ORDER BY s1) + (count(*) OVER (PARTITION BY q, s1) - 1) / 2.0::DOUBLE - 1) / nullif(count(*) OVER (PARTITION BY q) - 1.0::DOUBLE, 0), 0.0::DOUBLE) AS c1 FROM fp), "
    f"gt AS (SELECT q, r, round(0.75::DOUBLE * c0 + 0.25::DOUBLE * c1, 12) AS score FROM fr QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(0.75::DOUBLE * c0 + 0.25::DOUBLE * c1, 12) DESC, r) <= 15)"
)


@query(
    with_(SP, SC, BITS, pairs_sql(), pairs_sql("sc", "c"),
          f"fp AS (SELECT a.q, a.r, a.s AS s0, b.s AS s1 FROM (SELECT q, r, {REL} AS s FROM p) a JOIN (SELECT q, r, {REL} AS s FROM c) b ON a.q = b.q AND a.r = b.r WHERE a.q % 5 = 0 AND a.r % 5 <> 0)", FIXED,
          _multi_sql("gt", "", "2.0", "1.0", "0.6", "SELECT class, avg(bit::DOUBLE) AS share FROM byr WHERE node % 5 <> 0 GROUP BY 1"))
    + "SELECT q, class, pred FROM mq"
)
def fixed_external_prediction(spark, d):
    """A fixed configuration on held-out suppliers: two rank-calibrated paths, k 15, gamma 2, prior power 1, threshold 0.6."""
    blocks = B.Blocks(labelled(spark, d), [rel(spark, d, by_dimension=True) for rel in (sp, sc)])
    near = blocks.run(fixed_neighbours, "q long, r long, score double")
    bits = label_bits(spark, d)
    share = bits.where(~is_test("node")).groupBy("class").agg(F.avg(F.col("bit").cast("double")).alias("share"))
    return R.multilabel_predict(written(near, "neighbours"), bits, share, 2.0, 1.0, 0.6)


def fixed_neighbours(block: B.Block) -> dict:
    """The 15 nearest training suppliers of each test supplier."""
    folds, ids, parts = B.Folds(block, 15), block.columns["node"], []
    for q in (block.lo + np.flatnonzero(folds.fold[block.lo : block.hi] < 0)).tolist():
        places, (views,) = calibrated_views(block, q, folds.of(), B.rank_levels)
        score = weighted_sum(np.array([[0.75, 0.25]]), views)
        at = B.best(score, 15)[0]
        at = at[at >= 0]
        parts.append({"q": np.full(len(at), ids[q]), "r": ids[places[at]], "score": score[0, at]})
    return B.joined(parts, "q long, r long, score double")
