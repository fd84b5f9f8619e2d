"""Classification, multi-label and ranking metrics; strata; grids; splits and resampling."""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import majority_vote, top_k


def class_counts(pred: DataFrame, by: tuple[str, ...] = (), universe: str = "union") -> DataFrame:
    """tp, fp, fn and f1 per class; ``pred`` has truth and pred, and may have the number n of such rows.
    ``universe``: 'union' of truth and prediction, or classes in 'truth' only."""
    same = F.col("truth") == F.col("pred")
    n = F.col("n") if "n" in pred.columns else F.lit(1).cast("long")
    none = F.lit(0).cast("long")
    hit, miss = F.when(same, n).otherwise(none), F.when(same, none).otherwise(n)
    ends = F.array(
        F.struct(F.col("truth").alias("label"), hit.alias("tp"), none.alias("fp"), miss.alias("fn")),
        F.struct(F.col("pred").alias("label"), none.alias("tp"), miss.alias("fp"), none.alias("fn")),
    )
    each = pred.select(*by, F.explode(ends).alias("e")).select(*by, "e.*")
    out = each.groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    if universe == "truth":
        out = out.where("tp + fn > 0")
    return out.withColumn("f1", 2.0 * F.col("tp") / (2.0 * F.col("tp") + F.col("fp") + F.col("fn")))


def classification_metrics(pred: DataFrame, by: tuple[str, ...] = (), universe: str = "union") -> DataFrame:
    """macro_f1 and accuracy per group, from the counts by class alone."""
    right, all_ = F.sum("tp").cast("double"), F.sum(F.col("tp") + F.col("fn"))
    return class_counts(pred, by, universe).groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.try_divide(right, all_).alias("accuracy"))


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def multilabel_metrics(pred: DataFrame) -> DataFrame:
    """One row from (q, class, bit, pred): macro and micro F1, subset accuracy, Hamming loss, cardinalities."""
    both = lambda a, b: F.sum(((F.col("bit") == a) & (F.col("pred") == b)).cast("long"))
    per = pred.groupBy("class").agg(both(1, 1).alias("tp"), both(0, 1).alias("fp"), both(1, 0).alias("fn"))
    f1 = lambda tp, fp, fn: F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))
    total = per.agg(
        F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"),
        f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"),
    )
    row = pred.groupBy("q").agg(
        F.bool_and(F.col("bit") == F.col("pred")).alias("same"),
        F.sum("bit").alias("true_n"),
        F.sum("pred").alias("pred_n"),
        F.avg((F.col("bit") != F.col("pred")).cast("double")).alias("loss"),
    )
    rest = row.agg(
        F.avg(F.col("same").cast("double")).alias("subset_accuracy"),
        F.avg("loss").alias("hamming_loss"),
        F.avg("true_n").alias("mean_true"),
        F.avg("pred_n").alias("mean_pred"),
    )
    return total.join(F.broadcast(rest))


def ndcg(neighbours: DataFrame, labels: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """NDCG at k per query; a neighbour is relevant if it has the query's label.

    ``labels`` has node and label for queries and references; the ideal holds as many relevant
    references as there are, at most k; 0 where there is none."""
    of = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"l{s}"))
    gain = F.when(F.col("lq") == F.col("lr"), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    dcg = neighbours.join(of("q"), "q").join(of("r"), "r").groupBy("q", "lq").agg(F.sum(gain).alias("dcg"))
    size = references.join(labels, "node").groupBy(F.col("label").alias("lq")).agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("m"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("m")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return dcg.join(F.broadcast(size), "lq", "left").select(
        "q", F.coalesce(F.when(F.col("m") > 0, F.col("dcg") / ideal), F.lit(0.0)).alias("ndcg")
    )


def conflict_strata(neighbours: DataFrame, base: DataFrame, other: DataFrame) -> DataFrame:
    """Queries by quartile of their conflict, and per quartile the mean change of NDCG from ``base`` to ``other``.

    A query's conflict is the mean over ``neighbours`` (q, r, j, bc[, weight]) of the positive gap j - bc;
    with several paths the neighbours carry a row for each path and its weight, and gaps add up by weight."""
    weight = F.col("weight") if "weight" in neighbours.columns else F.lit(1.0)
    per = neighbours.groupBy("q", "r").agg(F.sum(weight * F.greatest(F.col("j") - F.col("bc"), F.lit(0.0))).alias("gap"))
    gap = per.groupBy("q").agg(F.avg("gap").alias("gap"))
    edges = gap.agg(F.expr("percentile(gap, array(0.25, 0.5, 0.75))").alias("e"))
    group = sum((F.col("gap") > F.col("e")[i]).cast("int") for i in range(3))
    both = base.withColumnRenamed("ndcg", "n0").join(other.withColumnRenamed("ndcg", "n1"), "q")
    return (
        gap.join(F.broadcast(edges)).select("q", "gap", group.alias("quartile")).join(both, "q").groupBy("quartile")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.avg(F.col("n1") - F.col("n0")).alias("delta"))
    )


def simplex(spark: SparkSession, parts: int, units: int) -> DataFrame:
    """All weights in steps of 1/units that sum to 1, in lexicographic order: g, w0, w1, ..."""
    if parts < 1 or units < 1:
        raise ValueError("parts and units must be at least 1")
    out = spark.range(1).select(F.lit(units).alias("_left"))
    for i in range(parts - 1):
        out = out.withColumn(f"u{i}", F.explode(F.sequence(F.lit(0), F.col("_left")))).withColumn("_left", F.col("_left") - F.col(f"u{i}"))
    out = out.withColumnRenamed("_left", f"u{parts - 1}")
    names = [f"u{i}" for i in range(parts)]
    g = F.row_number().over(Window.partitionBy().orderBy(*names)) - 1
    return out.select(g.alias("g"), *(((F.col(u) / float(units)).alias(f"w{i}")) for i, u in enumerate(names)))


def fold_references(labels: DataFrame) -> DataFrame:
    """(fold, node, label): the references of each validation fold, which are the rows of the others."""
    folds = labels.select("fold").distinct()
    return labels.withColumnRenamed("fold", "_own").join(F.broadcast(folds)).where("_own <> fold").select("fold", "node", "label")


def evaluate_grid(scored: DataFrame, labels: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """Scores (g, fold, q, r, score) to top-k and vote; per g the means over folds of macro F1, accuracy and
    NDCG, and macro F1's sample deviation and standard error. ``references`` is (fold, node, label)."""
    return evaluate_neighbours(top_k(scored, k, by=("g", "fold", "q")), labels, references, k)


def evaluate_neighbours(near: DataFrame, labels: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """As ``evaluate_grid``, for ranked neighbours (g, fold, q, r, rank), which are read twice."""
    by = ("g", "fold", "q")
    truth = labels.select(F.col("node").alias("q"), F.col("label").alias("truth"))
    per = classification_metrics(majority_vote(near, labels, by).join(truth, "q"), ("g", "fold"))
    gains = grouped_ndcg(near, labels, references, k, ("g", "fold"))
    return summarise_folds(per.join(gains, ["g", "fold"]), ("g",), ("accuracy", "ndcg"))


def summarise_folds(per: DataFrame, by: tuple[str, ...], means: tuple[str, ...]) -> DataFrame:
    """Per setting, from one row for each fold: macro_f1, its macro_f1_std and macro_f1_se, and other means."""
    std = F.stddev_samp("macro_f1")
    return per.groupBy(*by).agg(
        F.avg("macro_f1").alias("macro_f1"),
        std.alias("macro_f1_std"),
        (std / F.sqrt(F.count(F.lit(1)))).alias("macro_f1_se"),
        *(F.avg(c).alias(c) for c in means),
    )


def grouped_ndcg(near: DataFrame, labels: DataFrame, references: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    """Mean NDCG at k of each group ``by`` (fold among it); the ideal is taken over the fold's references."""
    of = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"l{s}"))
    gain = F.when(F.col("lq") == F.col("lr"), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    dcg = near.join(of("q"), "q").join(of("r"), "r").groupBy(*by, "q", "lq").agg(F.sum(gain).alias("dcg"))
    size = references.groupBy("fold", F.col("label").alias("lq")).agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("m"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("m")), F.lit(0.0), lambda x, i: x + 1.0 / F.log2(i + 1.0))
    each = dcg.join(size, ["fold", "lq"], "left").withColumn("x", F.coalesce(F.when(F.col("m") > 0, F.col("dcg") / ideal), F.lit(0.0)))
    return each.groupBy(*by).agg(F.avg("x").alias("ndcg"))


def evaluate_counts(counts: DataFrame) -> DataFrame:
    """As ``evaluate_neighbours``, from the numbers n and summed NDCG, gain, of (g, fold, truth, pred)."""
    by = ("g", "fold")
    gains = counts.groupBy(*by).agg((F.sum("gain") / F.sum("n")).alias("ndcg"))
    return summarise_folds(classification_metrics(counts, by).join(gains, list(by)), ("g",), ("accuracy", "ndcg"))


def evaluate_affinity(near: DataFrame, labels: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """One row for neighbours (q, r, score, rank): macro F1, accuracy, mean NDCG at k and its standard error."""
    truth = labels.select(F.col("node").alias("q"), F.col("label").alias("truth"))
    metrics = classification_metrics(majority_vote(near, labels).join(truth, "q"))
    gains = ndcg(near, labels, references, k)
    error = F.stddev_samp("ndcg") / F.sqrt(F.count(F.lit(1)))
    return metrics.join(F.broadcast(gains.agg(F.avg("ndcg").alias("ndcg"), error.alias("ndcg_se"))))


def evaluate_settings(
    scored: DataFrame, labels: DataFrame, references: DataFrame, ks: tuple[int, ...], gammas: tuple[float, ...], priors: tuple[float, ...]
) -> DataFrame:
    """Every k, gamma and prior power of the weighted vote on scores (g, fold, q, r, score), means over folds.

    The neighbours are ranked once for the largest k. A vote is that of ``ranking.weighted_vote``, with
    class shares over the fold's references (fold, node, label)."""
    each = lambda name, values: F.explode(F.array(*(F.lit(v) for v in values))).alias(name)
    near = top_k(scored, max(ks), by=("g", "fold", "q")).join(labels.select(F.col("node").alias("r"), "label"), "r")
    near = near.select("*", each("k", ks)).where("rank <= k").select("*", each("gamma", gammas))
    by = ("g", "fold", "k", "gamma", "q")
    weight = F.when(F.col("gamma") == 0, 1.0).otherwise(F.pow(F.greatest("score", F.lit(0.0)), "gamma"))
    votes = near.groupBy(*by, "label").agg(F.sum(weight).alias("s"), F.min("rank").alias("first"))
    n = references.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))
    share = n.select("fold", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("fold"))).alias("share"))
    every = near.select(*by).distinct().join(share, "fold").join(votes, [*by, "label"], "left").select("*", each("prior", priors))
    power = F.when(F.col("prior") == 0, 1.0).otherwise(F.pow("share", "prior"))
    every = every.withColumn("s", F.coalesce("s", F.lit(0.0)) / power).withColumn("first", F.coalesce("first", F.col("k") + 1))
    top = F.max("s").over(Window.partitionBy(*by, "prior"))
    close = every.withColumn("_m", top).where(F.abs(F.col("s") - F.col("_m")) <= 1e-8 + 1e-5 * F.abs("_m"))
    pred = close.groupBy(*by, "prior").agg(F.min_by("label", F.struct("first", "label")).alias("pred"))
    truth = labels.select(F.col("node").alias("q"), F.col("label").alias("truth"))
    setting = ("g", "k", "gamma", "prior")
    per = classification_metrics(pred.join(truth, "q"), (*setting, "fold"))
    return summarise_folds(per, setting, ("accuracy",))


def evaluate_multilabel_grid(
    scored: DataFrame, bits: DataFrame, ks: tuple[int, ...], gammas: tuple[float, ...], priors: tuple[float, ...], thresholds: tuple[float, ...]
) -> DataFrame:
    """Every setting of k, gamma, prior power and threshold on scores (g, fold, q, r, score): macro and micro F1
    and subset accuracy averaged over folds, and macro F1's deviation over folds, per setting.

    ``bits`` (node, class, bit, fold) has the suppliers that may be references, each with its own fold; a
    fold's prevalence is taken over the other folds. A prediction is that of ``multilabel_predict``."""
    each = lambda name, values: F.explode(F.array(*(F.lit(v) for v in values))).alias(name)
    by = ("g", "fold", "k", "gamma")
    near = top_k(scored, max(ks), by=("g", "fold", "q")).select("*", each("k", ks)).where("rank <= k").select("*", each("gamma", gammas))
    w = F.when(F.col("gamma") == 0, 1.0).otherwise(F.pow(F.greatest("score", F.lit(0.0)), "gamma"))
    total = F.sum("_w").over(Window.partitionBy(*by, "q"))
    near = near.withColumn("_w", w).withColumn("_w", F.when(F.abs(total) <= 1e-8, 1.0).otherwise(F.col("_w")))
    own = near.join(bits.select(F.col("node").alias("r"), "class", "bit"), "r")
    mean = own.groupBy(*by, "q", "class").agg((F.sum(F.col("_w") * F.col("bit")) / F.sum("_w")).alias("s"))
    folds = bits.select("fold").distinct()
    rest = bits.withColumnRenamed("fold", "_own").join(F.broadcast(folds)).where("_own <> fold")
    share = rest.groupBy("fold", "class").agg(F.avg(F.col("bit").cast("double")).alias("share"))
    every = mean.join(F.broadcast(share), ["fold", "class"]).select("*", each("prior", priors))
    power = F.when(F.col("prior") == 0, 1.0).otherwise(F.pow(F.greatest("share", F.lit(1e-12)), "prior"))
    by = (*by, "prior")
    q = Window.partitionBy(*by, "q")
    every = every.withColumn("s", F.col("s") / power).withColumn("_m", F.max("s").over(q))
    every = every.withColumn("s", F.round(F.when(F.col("_m") > 0, F.col("s") / F.col("_m")).otherwise(0.0), 12))
    every = every.withColumn("best", F.row_number().over(q.orderBy(F.desc("s"), "class")) == 1).select("*", each("threshold", thresholds))
    by = (*by, "threshold")
    hit = (F.col("s") >= F.col("threshold")).cast("int")
    none = F.max(hit).over(Window.partitionBy(*by, "q")) == 0
    pred = every.withColumn("pred", F.when(none & F.col("best"), 1).otherwise(hit))
    pred = pred.join(bits.select(F.col("node").alias("q"), "class", "bit"), ["q", "class"])
    both = lambda a, b: F.sum(((F.col("bit") == a) & (F.col("pred") == b)).cast("long"))
    per = pred.groupBy(*by, "class").agg(both(1, 1).alias("tp"), both(0, 1).alias("fp"), both(1, 0).alias("fn"))
    f1 = lambda tp, fp, fn: F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))
    score = per.groupBy(*by).agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"), f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"))
    row = pred.groupBy(*by, "q").agg(F.bool_and(F.col("bit") == F.col("pred")).alias("same"))
    same = row.groupBy(*by).agg(F.avg(F.col("same").cast("double")).alias("subset_accuracy"))
    mean = lambda c: F.avg(c).alias(c)
    return score.join(same, list(by)).groupBy("g", "k", "gamma", "prior", "threshold").agg(
        mean("macro_f1"), F.stddev_samp("macro_f1").alias("macro_f1_std"), mean("micro_f1"), mean("subset_accuracy")
    )


def evaluate_multilabel_counts(counts: DataFrame) -> DataFrame:
    """As ``evaluate_multilabel_grid``, by g, from (g, fold, class, tp, fp, fn, same, n), the last two the same for every class."""
    f1 = lambda tp, fp, fn: F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))
    per = counts.groupBy("g", "fold", "class").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "same", "n")))
    per = per.groupBy("g", "fold").agg(
        F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"), f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"),
        (F.max("same") / F.max("n")).alias("subset_accuracy"),
    )
    mean = lambda c: F.avg(c).alias(c)
    return per.groupBy("g").agg(mean("macro_f1"), F.stddev_samp("macro_f1").alias("macro_f1_std"), mean("micro_f1"), mean("subset_accuracy"))


def _drawn(seed: int):
    """A seeded order of nodes that SQL can repeat: the MD5 of id and seed."""
    return F.md5(F.concat(F.col("node").cast("string"), F.lit(f"-{seed}")))


def stratified_folds(labels: DataFrame, folds: int, seed: int) -> DataFrame:
    """``labels`` with fold: rows of a class in a seeded order, dealt out in turn."""
    order = Window.partitionBy("label").orderBy(_drawn(seed), "node")
    return labels.withColumn("fold", ((F.row_number().over(order) - 1) % folds).cast("int"))


def stratified_split(labels: DataFrame, share: float, seed: int) -> DataFrame:
    """``labels`` with validation: the first round(share * n) rows of each class in a seeded order."""
    order = Window.partitionBy("label").orderBy(_drawn(seed), "node")
    n = F.count(F.lit(1)).over(Window.partitionBy("label"))
    return labels.withColumn("validation", F.row_number().over(order) <= F.round(n * share))


def sample_positions(size: int, count: int, seed: int) -> list[int]:
    """Unique positions below ``size`` drawn one by one with the standard library's generator; repeatable by seed."""
    if count > size:
        raise ValueError("more draws than ids")
    rng, taken = random.Random(seed), set()
    while len(taken) < count:
        taken.add(rng.randint(0, size - 1))
    return sorted(taken)


def sample_ids(ids: DataFrame, count: int, seed: int) -> DataFrame:
    """The rows of ``ids`` (node) at drawn positions of the ascending order; the driver holds ``count`` positions."""
    spark = ids.sparkSession
    drawn = spark.createDataFrame([(p,) for p in sample_positions(ids.count(), count, seed)], "pos long")
    placed = ids.select("node", (F.row_number().over(Window.orderBy("node")) - 1).cast("long").alias("pos"))
    return placed.join(F.broadcast(drawn), "pos").select("node")


def seed_search(spark: SparkSession, correct: list[list[int]], targets: list[int], sample: int, seeds: int, keep: int) -> DataFrame:
    """The ``keep`` seeds whose samples come nearest to the target counts. ``correct``: per method a 0/1
    list over the labelled nodes, which every task needs whole: a byte for each node and method."""
    table = np.array(correct, np.int8)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            gaps = []
            for seed in frame["seed"]:
                ids = sample_positions(table.shape[1], sample, int(seed))
                gaps.append(int(np.abs(table[:, ids].sum(1, dtype=np.int64) - np.array(targets)).sum()))
            yield pd.DataFrame({"seed": frame["seed"], "gap": gaps})

    tried = spark.range(seeds).select(F.col("id").alias("seed")).mapInPandas(run, "seed long, gap long")
    return tried.orderBy("gap", "seed").limit(keep)


def _resample(spark: SparkSession, iterations: int, metrics: dict, draw) -> DataFrame:
    """Per metric: its difference on all rows, and over ``iterations`` draws the 2.5 and 97.5 % points and
    the share of positive differences. ``draw(i)`` gives weights of the cells, None those of all rows."""
    whole = {name: float(f(draw(None))) for name, f in metrics.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame["it"]:
                weights = draw(int(i))
                yield pd.DataFrame({"metric": list(metrics), "delta": [float(f(weights)) for f in metrics.values()]})

    runs = spark.range(iterations).select(F.col("id").alias("it")).mapInPandas(run, "metric string, delta double")
    points = spark.createDataFrame(list(whole.items()), "metric string, difference double")
    return runs.groupBy("metric").agg(
        F.expr("percentile(delta, 0.025)").alias("low"),
        F.expr("percentile(delta, 0.975)").alias("high"),
        F.avg((F.col("delta") > 0).cast("double")).alias("positive"),
    ).join(F.broadcast(points), "metric").select("metric", "difference", "low", "high", "positive")


def bootstrap(pred: DataFrame, iterations: int, seed: int) -> DataFrame:
    """Paired bootstrap within true classes of (truth, base, other[, base_ndcg, other_ndcg]): changes of macro F1
    over truth classes, of accuracy and, where given, of mean NDCG.

    Rows alike are drawn alike, so the driver gets counts of distinct rows: at most the third power of
    the classes, times the values that NDCG at k takes. Iterations are spread over tasks, and each
    draws multinomials within the true classes.
    """
    gains = [c for c in ("base_ndcg", "other_ndcg") if c in pred.columns]
    key = ["truth", "base", "other", *gains]
    rounded = pred.select("truth", "base", "other", *(F.round(c, 12).alias(c) for c in gains))
    cells = rounded.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).orderBy(*key).collect()
    truth, base, other, n = (np.array([r[c] for r in cells], dtype=np.int64) for c in ("truth", "base", "other", "n"))
    classes = np.unique(truth)

    def macro(of: np.ndarray, w: np.ndarray) -> float:
        scores = []
        for c in classes:
            both = w[truth == c].sum() + w[of == c].sum()
            scores.append(2 * w[(truth == c) & (of == c)].sum() / both if both else 0.0)
        return float(np.mean(scores))

    def draw(i: int | None) -> np.ndarray:
        if i is None:
            return n
        rng, w = np.random.default_rng([seed, i]), np.zeros(len(n), np.int64)
        for c in classes:
            at = truth == c
            w[at] = rng.multinomial(n[at].sum(), n[at] / n[at].sum())
        return w

    metrics = {
        "macro_f1": lambda w: macro(other, w) - macro(base, w),
        "accuracy": lambda w: (w * ((other == truth) * 1.0 - (base == truth))).sum() / w.sum(),
    }
    if gains:
        change = np.array([r["other_ndcg"] - r["base_ndcg"] for r in cells])
        metrics["ndcg"] = lambda w: (w * change).sum() / w.sum()
    return _resample(pred.sparkSession, iterations, metrics, draw)


def node_bootstrap(pred: DataFrame, iterations: int, seed: int) -> DataFrame:
    """Paired bootstrap of whole nodes, not by class, of (q, class, bit, base, other): changes of macro and micro
    F1 and of subset accuracy. The driver gets counts of distinct label patterns."""
    row = F.array_sort(F.collect_list(F.struct("class", "bit", "base", "other")))
    cells = pred.groupBy("q").agg(row.alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n")).orderBy("row").collect()
    truth, base, other = (np.array([[x[c] for x in r["row"]] for r in cells], np.int64) for c in ("bit", "base", "other"))
    n = np.array([r["n"] for r in cells], np.int64)

    def counts(of: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (w[:, None] * truth * of).sum(0), (w[:, None] * (truth + of)).sum(0)

    def f1(of: np.ndarray, w: np.ndarray, average: str) -> float:
        hit, both = counts(of, w)
        if average == "micro":
            hit, both = hit.sum(keepdims=True), both.sum(keepdims=True)
        return float(np.mean(np.divide(2.0 * hit, both, out=np.zeros(len(hit)), where=both > 0)))

    same = lambda of, w: (w * (truth == of).all(1)).sum() / w.sum()
    metrics = {
        "macro_f1": lambda w: f1(other, w, "macro") - f1(base, w, "macro"),
        "micro_f1": lambda w: f1(other, w, "micro") - f1(base, w, "micro"),
        "subset_accuracy": lambda w: same(other, w) - same(base, w),
    }
    draw = lambda i: n if i is None else np.random.default_rng([seed, i]).multinomial(n.sum(), n / n.sum())
    return _resample(pred.sparkSession, iterations, metrics, draw)


def multilabel_folds(bits: DataFrame, folds: int, seed: int) -> DataFrame:
    """(node, fold): the rarest class first, each of its rows to a fold with room that most lacks the class,
    then the row's labels together, then rows.

    The state is sequential, but rows with one set of bits are interchangeable: they are put in a
    seeded order and dealt out by counts, so the sequential part runs over distinct bit sets, and
    where folds lack a class alike, whole rounds are dealt at once. ``bits``: node, class, bit. Every
    node needs a label; folds must be from 2 to the number of nodes.
    """
    rows = bits.groupBy("node").agg(F.sort_array(F.collect_list(F.when(F.col("bit") == 1, F.col("class")))).alias("set"))
    groups = {tuple(r["set"]): r["n"] for r in rows.groupBy("set").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = deal_label_sets(groups, folds)
    table = [(list(s), f, sum(n[:f]), sum(n[: f + 1])) for s, n in share.items() for f in range(folds)]
    ends = bits.sparkSession.createDataFrame(table, "set array<int>, fold int, lo long, hi long")
    place = F.row_number().over(Window.partitionBy("set").orderBy(F.xxhash64("node", F.lit(seed)), "node")) - 1
    rows = rows.withColumn("set", F.col("set").cast("array<int>")).withColumn("place", place)
    on = [rows["set"] == ends["set"], rows["place"] >= ends["lo"], rows["place"] < ends["hi"]]
    return rows.join(ends, on).select("node", "fold")


def deal_label_sets(groups: dict[tuple, int], folds: int) -> dict[tuple, list[int]]:
    """How many rows of each label set go to each fold."""
    total = sum(groups.values())
    if () in groups:
        raise ValueError("every row needs a label")
    if not 2 <= folds <= total:
        raise ValueError("folds must be from 2 to the number of rows")
    left = dict(groups)
    need = {c: [sum(n for s, n in groups.items() if c in s) / folds] * folds for c in set(itertools.chain(*groups))}
    room = [total // folds + (f < total % folds) for f in range(folds)]
    share: dict[tuple, list[int]] = {s: [0] * folds for s in groups}

    def give(s: tuple, f: int, n: int) -> None:
        share[s][f] += n
        left[s] -= n
        room[f] -= n
        for c in s:
            need[c][f] -= n

    while any(left.values()):
        size = {c: sum(n for s, n in left.items() if c in s) for c in need}
        rare = min((c for c in need if size[c]), key=lambda c: (size[c], c))
        for s in sorted(s for s in left if rare in s):
            while left[s]:
                free = [f for f in range(folds) if room[f]]
                lacks = need[rare]
                rounds = min([left[s] // len(free), *(room[f] for f in free)])
                if rounds and max(lacks[f] for f in free) - min(lacks[f] for f in free) < 1:
                    for f in free:
                        give(s, f, rounds)
                    continue
                near = lambda x, y: abs(x - y) <= 1e-8 + 1e-5 * abs(y)
                for value in (lambda f: lacks[f], lambda f: sum(need[c][f] for c in s), lambda f: room[f]):
                    best = max(map(value, free))
                    free = [f for f in free if near(value(f), best)]
                give(s, free[0], 1)
    return share


def fold_audit(bits: DataFrame) -> DataFrame:
    """Per fold of (node, class, bit, fold): reference and validation nodes and the largest deviation of a class's
    prevalence in the fold from that of all rows."""
    whole = bits.groupBy("class").agg(F.avg(F.col("bit").cast("double")).alias("all"))
    nodes = bits.agg(F.countDistinct("node").alias("_nodes"))
    per = bits.groupBy("fold", "class").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("bit").cast("double")).alias("own"))
    out = per.join(whole, "class").groupBy("fold").agg(
        F.max("n").alias("validation_nodes"), F.max(F.abs(F.col("own") - F.col("all"))).alias("max_deviation")
    )
    return out.join(F.broadcast(nodes)).select(
        "fold", (F.col("_nodes") - F.col("validation_nodes")).alias("reference_nodes"), "validation_nodes", "max_deviation"
    )


def frequency(choices: DataFrame, *columns: str) -> DataFrame:
    """How often each choice was made over folds."""
    return choices.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def out_of_fold(pred: DataFrame, current: str) -> DataFrame:
    """Per method of (method, q, truth, pred), each q predicted once out of its fold: macro F1 over truth classes and
    accuracy, and their differences from the method ``current``."""
    rows = classification_metrics(pred, ("method",), "truth")
    base = rows.where(F.col("method") == current).select(F.col("macro_f1").alias("_f"), F.col("accuracy").alias("_a"))
    return rows.join(F.broadcast(base)).select(
        "method", "macro_f1", "accuracy", (F.col("macro_f1") - F.col("_f")).alias("macro_f1_gain"), (F.col("accuracy") - F.col("_a")).alias("accuracy_gain")
    )


def subset_accuracy(pred: DataFrame, queries: DataFrame) -> DataFrame:
    """Per method of (method, q, truth, pred): the share of right predictions among the sampled ``queries`` (node)."""
    own = pred.join(queries.select(F.col("node").alias("q")), "q", "left_semi")
    return own.groupBy("method").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
