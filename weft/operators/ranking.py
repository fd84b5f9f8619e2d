"""Calibration, deterministic top-k, voting and fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_calibrate(scores: DataFrame, value: str = "score", by: tuple[str, ...] = ("q",)) -> DataFrame:
    """(average rank - 1) / (n - 1) per query, ties share a rank; 0 for a single value."""
    w = Window.partitionBy(*by)
    rank = F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0
    return scores.withColumn("calibrated", F.coalesce(F.try_divide(rank - 1.0, F.count(F.lit(1)).over(w) - 1.0), F.lit(0.0)))


def minmax_calibrate(scores: DataFrame, value: str = "score", by: tuple[str, ...] = ("q",)) -> DataFrame:
    """(value - min) / (max - min) per query; 0 without a span."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return scores.withColumn("calibrated", F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(0.0)))


def top_k(scores: DataFrame, k: int, value: str = "score", largest: bool = True, by: tuple[str, ...] = ("q",)) -> DataFrame:
    """The first k references per query by score, then ascending id, with their rank from 1."""
    if k < 1:
        raise ValueError("k must be at least 1")
    order = F.col(value).desc() if largest else F.col(value).asc()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, "r"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def grid_top_k(
    pairs: DataFrame, grid: DataFrame, score: Callable[[Column], Column], k: int, by: tuple[str, ...] = ("fold", "q"), allowed: Callable[[Column], Column] | None = None,
    digits: int | None = None,
) -> DataFrame:
    """(columns of the grid, by, q, r, score, rank): ``top_k`` for each row of a small ``grid``.

    ``score`` makes a pair's score from its struct and from columns of the grid and ``by``; ``allowed`` says which
    pairs count in a setting; with ``digits`` scores are rounded, but only those that can be among the best. The pairs of a query are gathered once and ranked for one setting after the
    other, so that the grid multiplies queries, not pairs.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    lists = pairs.groupBy(*by).agg(F.collect_list(F.struct(*(c for c in pairs.columns if c not in by))).alias("_near"))
    near = F.filter("_near", allowed) if allowed else F.col("_near")
    placed = F.transform(near, lambda x: F.struct((-score(x)).alias("o"), x["r"].alias("r")))
    if digits is None:
        best = F.slice(F.sort_array(placed), 1, k)
    else:
        worst = lambda a: F.coalesce(F.get(a, F.lit(k - 1))["o"], F.lit(float("inf"))) + 2 * 10.0**-digits
        lists = lists.join(F.broadcast(grid)).select(*grid.columns, *by, F.sort_array(placed).alias("_all")).withColumn("_worst", worst("_all"))
        close = F.transform(F.filter("_all", lambda x: x["o"] <= F.col("_worst")), lambda x: F.struct((-F.round(-x["o"], digits)).alias("o"), x["r"].alias("r")))
        best = F.slice(F.sort_array(close), 1, k)
        out = lists.select(*grid.columns, *by, F.posexplode(best).alias("_at", "_x"))
        return out.select(*grid.columns, *by, F.col("_x.r").alias("r"), (-F.col("_x.o")).alias("score"), (F.col("_at") + 1).alias("rank"))
    out = lists.join(F.broadcast(grid)).select(*grid.columns, *by, F.posexplode(best).alias("_at", "_x"))
    return out.select(*grid.columns, *by, F.col("_x.r").alias("r"), (-F.col("_x.o")).alias("score"), (F.col("_at") + 1).alias("rank"))


def require_k(k: int, candidates: DataFrame) -> None:
    """k beyond the number of candidates is an error."""
    if k < 1 or candidates.limit(k).count() < k:
        raise ValueError(f"k={k} is not from 1 to the number of candidates")


def majority_vote(neighbours: DataFrame, labels: DataFrame, by: tuple[str, ...] = ("q",)) -> DataFrame:
    """Most frequent label among neighbours (r, rank); ties go to the nearest. Unlabelled neighbours
    don't count; queries all of whose neighbours are unlabelled get -1."""
    own = neighbours.join(labels.select(F.col("node").alias("r"), "label"), "r", "left")
    votes = own.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    place = F.when(F.col("label").isNotNull(), F.struct("n", -F.col("first")))
    return votes.groupBy(*by).agg(F.coalesce(F.max_by("label", place), F.lit(-1)).alias("pred"))


def weighted_vote(
    neighbours: DataFrame, labels: DataFrame, classes: DataFrame, k: int, gamma: float, prior_power: float
) -> DataFrame:
    """Sum of max(score, 0)^gamma per class over prior^prior_power; among classes close to the best the
    one with the nearest neighbour wins, then the smaller class. ``classes``: label, prior."""
    weight = F.lit(1.0) if gamma == 0 else F.pow(F.greatest("score", F.lit(0.0)), F.lit(gamma))
    own = neighbours.join(labels.select(F.col("node").alias("r"), "label"), "r")
    votes = own.groupBy("q", "label").agg(F.sum(weight).alias("s"), F.min("rank").alias("first"))
    every = neighbours.select("q").distinct().join(F.broadcast(classes))
    s = F.coalesce("s", F.lit(0.0)) / (F.lit(1.0) if prior_power == 0 else F.pow("prior", F.lit(prior_power)))
    full = every.join(votes, ["q", "label"], "left").select("q", "label", s.alias("s"), F.coalesce("first", F.lit(k + 1)).alias("first"))
    top = F.max("s").over(Window.partitionBy("q"))
    near = full.withColumn("_m", top).where(F.abs(F.col("s") - F.col("_m")) <= 1e-8 + 1e-5 * F.abs("_m"))
    return near.groupBy("q").agg(F.min_by("label", F.struct("first", "label")).alias("pred"))


def multilabel_predict(
    neighbours: DataFrame, bits: DataFrame, prevalence: DataFrame, gamma: float, prior_power: float, threshold: float
) -> DataFrame:
    """Weighted mean of neighbours' bits per class over prevalence^power, scaled by the row's maximum;
    classes at the threshold or the best one. ``bits``: node, class, bit; ``prevalence``: class, share."""
    w = F.lit(1.0) if gamma == 0 else F.pow(F.greatest("score", F.lit(0.0)), F.lit(gamma))
    weighted = neighbours.withColumn("_w", w)
    total = F.sum("_w").over(Window.partitionBy("q"))
    weighted = weighted.withColumn("_w", F.when(F.abs(total) <= 1e-8, 1.0).otherwise(F.col("_w")))
    own = weighted.join(bits.select(F.col("node").alias("r"), "class", "bit"), "r")
    mean = own.groupBy("q", "class").agg((F.sum(F.col("_w") * F.col("bit")) / F.sum("_w")).alias("s"))
    s = F.col("s") / (F.lit(1.0) if prior_power == 0 else F.pow(F.greatest("share", F.lit(1e-12)), F.lit(prior_power)))
    scored = mean.join(F.broadcast(prevalence), "class").select("q", "class", s.alias("s"))
    q = Window.partitionBy("q")
    top = F.max("s").over(q)
    scaled = scored.withColumn("s", F.when(top > 0, F.col("s") / top).otherwise(0.0))
    hit = (F.round("s", 12) >= threshold).cast("int")
    best = F.row_number().over(q.orderBy(F.round("s", 12).desc(), "class")) == 1
    out = scaled.withColumn("hit", hit).withColumn("best", best).withColumn("n", F.sum("hit").over(q))
    return out.select("q", "class", F.when((F.col("n") == 0) & F.col("best"), 1).otherwise(F.col("hit")).alias("pred"))


def fuse(paths: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum over paths: ``paths`` has path, q, r, score; ``weights`` has path, weight (a row for each path)."""
    return (
        paths.join(F.broadcast(weights), "path").groupBy("q", "r").agg(F.sum(F.col("weight") * F.col("score")).alias("score"))
    )


def entropy_weights(paths: DataFrame) -> DataFrame:
    """Per path: 1 less the mean normalised entropy of the columns' shares, scaled to sum 1.

    With one row the entropy is taken as 1, as nothing can be told apart."""
    share = F.coalesce(F.try_divide("score", F.sum("score").over(Window.partitionBy("path", "r"))), F.lit(0.0))
    part = paths.withColumn("p", share).groupBy("path", "r").agg(
        F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0)).alias("h"), F.count(F.lit(1)).alias("n")
    )
    mean = part.groupBy("path").agg((1 - F.avg(F.coalesce(F.try_divide("h", F.ln("n")), F.lit(1.0)))).alias("raw"))
    return scaled(mean)


def scaled(raw: DataFrame) -> DataFrame:
    """(path, weight) from (path, raw): scaled to sum 1."""
    total = F.sum("raw").over(Window.partitionBy())
    return raw.select("path", F.coalesce(F.try_divide("raw", total), F.lit(0.0)).alias("weight"))


def arg_max(grid: DataFrame, keys: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """The first row by ``keys``; put the grid's index last among them to settle full ties."""
    return grid.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where("_n = 1").drop("_n")
