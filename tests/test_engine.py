"""Example tests of the similarity operators: hand-computed values and brute force."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import measures as M
from weft.operators import evaluation as E
from weft.operators import pairs as P
from weft.operators import ranking as R
from weft.operators import relations as L


def profile(spark, rows):
    cells = [(i, j, float(w)) for i, row in enumerate(rows) for j, w in enumerate(row) if w]
    return spark.createDataFrame(cells, "i long, j long, w double"), spark.createDataFrame([(i,) for i in range(len(rows))], "node long")


def pairs(spark, left, right=None):
    a, an = profile(spark, left)
    b, bn = profile(spark, right) if right else (a, an)
    return P.all_pairs(an, a, bn, b, normalized=True)


def value(df, column):
    return {(r["q"], r["r"]): r["v"] for r in df.select("q", "r", column.alias("v")).collect()}


def test_pathsim_and_hetesim_differ(spark):
    p = pairs(spark, [[1, 1, 0], [1, 0, 0], [0, 1, 1]]).cache()
    ps, hs = value(p, M.pathsim()), value(p, M.cosine())
    assert ps[0, 1] == pytest.approx(2 / 3) and hs[0, 1] == pytest.approx(1 / math.sqrt(2))
    assert all(ps[a, b] == ps[b, a] and hs[a, b] == pytest.approx(hs[b, a]) for a, b in ps)


def test_equal_norms_agree(spark):
    p = pairs(spark, [[1, 0], [0, 1], [1, 0]])
    assert value(p, M.pathsim()) == value(p, M.cosine())


def test_rectangular(spark):
    h = value(pairs(spark, [[1, 0], [1, 1]], [[1, 0], [0, 1], [1, 1]]), M.cosine())
    assert len(h) == 6 and h[0, 0] == pytest.approx(1) and h[0, 1] == 0 and h[1, 2] == pytest.approx(1)


def test_empty_profiles_and_two_hammings(spark):
    p = pairs(spark, [[0, 0], [0, 0], [2, 0], [5, 0]]).cache()
    assert value(p, M.jaccard())[0, 1] == 0 and value(p, M.bray_curtis())[0, 1] == 0  # affinity 1
    assert value(p, M.pathsim())[0, 1] == 0 and value(p, M.pathsim())[0, 0] == 0
    assert value(p, M.pathsim_forced())[0, 0] == 1
    assert value(p, M.value_hamming())[2, 3] == 1 and value(p, M.support_hamming())[2, 3] == 0
    assert value(p, M.jaccard())[0, 2] == 1


def test_identities_against_brute_force(spark):
    rows = [[0, 3, 1, 0], [2, 3, 0, 0], [0, 0, 0, 0], [1, 1, 1, 1], [0, 3, 1, 5]]
    p = pairs(spark, rows).cache()
    l1, ham, bh = value(p, M.l1()), value(p, M.value_hamming()), value(p, F.col("bh"))
    for a, x in enumerate(rows):
        for b, y in enumerate(rows):
            assert l1[a, b] == sum(abs(u - v) for u, v in zip(x, y))
            assert ham[a, b] == sum(u != v for u, v in zip(x, y))
            want = sum(math.sqrt(u / sum(x) * v / sum(y)) for u, v in zip(x, y)) if sum(x) and sum(y) else 0
            assert bh[a, b] == pytest.approx(want)


def test_adaptive_and_relative(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 0.8, 0.3)], "q long, r long, j double, bc double")
    a0, a5 = (value(df, M.adaptive_affinity(F.col("j"), F.col("bc"), F.lit(b))) for b in (0.0, 0.5))
    assert a0[0, 1] == pytest.approx(0.7) and 0 <= a5[0, 1] < a0[0, 1] and a5[0, 0] == 1
    assert value(df, M.relative_affinity(F.col("j"), F.col("bc"), F.lit(0.4)))[0, 0] == 1


def test_lambda_and_alpha(spark):
    one = spark.range(1).select(F.lit(0.5).alias("a"), F.lit(100.0).alias("b0"), F.lit(900.0).alias("b1"))
    lam = one.select(M.lambda_of_alpha(F.col("a"), F.col("b0"), F.col("b1")).alias("x")).first()["x"]
    assert lam == pytest.approx(0.9)
    back = one.select(M.alpha_of_lambda(F.lit(lam), F.col("b0"), F.col("b1")).alias("x")).first()["x"]
    assert back == pytest.approx(0.5)


def test_interval_ranges(spark):
    rows = [[1, 0], [4, 0], [2, 9], [0, 0], [3, 3]]
    p = P.interval_ranges(pairs(spark, rows))
    got = value(p, F.col("rng"))
    for q in range(5):
        for r in range(5):
            inside = [v for row in rows[min(q, r) : max(q, r) + 1] for v in row]
            assert got[q, r] == max(inside) - min(inside)
    with pytest.raises(ValueError):
        P.range_distance(p, 1.5)


def test_chain_normalises_each_hop(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0)], "i long, j long, w double")
    b = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 1, 5.0)], "i long, j long, w double")
    raw = {(r["i"], r["j"]): r["w"] for r in L.chain([a, b]).collect()}
    hop = {(r["i"], r["j"]): r["w"] for r in L.chain([a, b], normalize=True).collect()}
    assert raw == {(0, 0): 1, (0, 1): 16} and hop == {(0, 0): 0.125, (0, 1): 0.875}
    assert L.chain([spark.createDataFrame([(0, 0, 0.0)], "i long, j long, w double"), b]).count() == 0
    with pytest.raises(ValueError):
        L.chain([])


def test_guards(spark):
    bad = spark.createDataFrame([(0, 0, -1.0), (0, 1, float("nan")), (1, 1, 2.0)], "i long, j long, w double")
    assert L.violations(bad).first()["n_bad"] == 2
    with pytest.raises(Exception, match="non-negative"):
        L.require_nonnegative(bad).collect()
    assert L.reverse_differences(bad.where("i = 1"), L.transpose(bad.where("i = 1"))).first()["n_differences"] == 0


def test_top_k_ties_and_bounds(spark):
    s = spark.createDataFrame([(0, 30, 0.5), (0, 10, 0.5), (0, 20, 0.7), (0, 40, 0.5)], "q long, r long, score double")
    assert [r["r"] for r in R.top_k(s, 3).orderBy("rank").collect()] == [20, 10, 30]
    with pytest.raises(ValueError):
        R.top_k(s, 0)
    with pytest.raises(ValueError):
        R.require_k(5, s)


def test_calibration(spark):
    s = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.2, 0.8, 0.2, 0.5])], "q long, r long, score double")
    rank = {r["r"]: r["calibrated"] for r in R.rank_calibrate(s).collect()}
    assert rank[0] == rank[2] == pytest.approx(0.5 / 3) and rank[1] == 1 and rank[3] == pytest.approx(2 / 3)
    span = [r["calibrated"] for r in R.minmax_calibrate(s).collect()]
    assert min(span) == 0 and max(span) == 1
    assert R.rank_calibrate(s.limit(1)).first()["calibrated"] == 0


def test_votes(spark):
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 0)], "node long, label long")
    near = spark.createDataFrame([(9, 2, 1), (9, 0, 2), (9, 1, 3), (9, 3, 4), (8, 77, 1)], "q long, r long, rank int")
    got = {r["q"]: r["pred"] for r in R.majority_vote(near, labels).collect()}
    assert got == {9: 1, 8: -1}


def test_prior_correction_flips(spark):
    labels = spark.createDataFrame([(i, 0) for i in range(9)] + [(9, 1)], "node long, label long")
    near = spark.createDataFrame([(0, 0, 1, 0.9), (0, 1, 2, 0.8), (0, 2, 3, 0.7), (0, 9, 4, 0.6)], "q long, r long, rank int, score double")
    classes = spark.createDataFrame([(0, 0.9), (1, 0.1)], "label long, prior double")
    assert R.weighted_vote(near, labels, classes, 4, 0.0, 0.0).first()["pred"] == 0
    assert R.weighted_vote(near, labels, classes, 4, 0.0, 1.0).first()["pred"] == 1


def test_multilabel_is_never_empty(spark):
    bits = spark.createDataFrame([(n, c, int(n == c)) for n in range(3) for c in range(3)], "node long, class long, bit int")
    prev = bits.groupBy("class").agg(F.avg("bit").alias("share"))
    near = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.0), (1, 1, 0.0)], "q long, r long, score double")
    out = R.multilabel_predict(near, bits, prev, 1.0, 0.0, 0.6)
    assert out.count() == 6 and out.groupBy("q").agg(F.sum("pred").alias("n")).where("n = 0").count() == 0


def test_metrics_universe(spark):
    pred = spark.createDataFrame([(0, 0), (0, 0), (1, 2)], "truth long, pred long")
    union = E.classification_metrics(pred).first()
    truth = E.classification_metrics(pred, universe="truth").first()
    assert union["macro_f1"] == pytest.approx(1 / 3) and truth["macro_f1"] == pytest.approx(0.5)
    assert union["accuracy"] == pytest.approx(2 / 3)


def test_ndcg_by_hand(spark):
    near = spark.createDataFrame([(9, 0, 2), (9, 1, 1)], "q long, r long, rank int")
    labels = spark.createDataFrame([(9, 1), (0, 1), (1, 0), (2, 1)], "node long, label long")
    refs = spark.createDataFrame([(0,), (1,), (2,)], "node long")
    got = E.ndcg(near, labels, refs, 2).first()["ndcg"]
    assert got == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_simplex_entropy_and_folds(spark):
    grid = E.simplex(spark, 3, 4).collect()
    assert len({(r["w0"], r["w1"], r["w2"]) for r in grid}) == 15 and all(r["w0"] + r["w1"] + r["w2"] == 1 for r in grid)
    cells = [("a", q, r, v) for q, row in enumerate([[0.8, 0.1], [0.2, 0.7], [0.4, 0.3]]) for r, v in enumerate(row)]
    cells += [("b", q, r, v) for q, row in enumerate([[0.3, 0.5], [0.6, 0.2], [0.1, 0.9]]) for r, v in enumerate(row)]
    w = [r["weight"] for r in R.entropy_weights(spark.createDataFrame(cells, "path string, q long, r long, score double")).collect()]
    assert min(w) >= 0 and sum(w) == pytest.approx(1)
    rows = "100 110 010 011 001 101 100 010 001 110 011 101".split()
    bits = spark.createDataFrame([(i, c, int(b)) for i, s in enumerate(rows) for c, b in enumerate(s)], "node long, class long, bit int")
    one, two = (sorted((r["node"], r["fold"]) for r in E.multilabel_folds(bits, 3, 20260805).collect()) for _ in range(2))
    assert one == two and [n for n, _ in one] == list(range(12)) and {f for _, f in one} == {0, 1, 2}
    with pytest.raises(ValueError):
        E.multilabel_folds(bits, 13, 1)


def test_sampling(spark):
    ids = spark.range(100).select((F.col("id") * 3).alias("node"))
    a, b = ([r["node"] for r in E.sample_ids(ids, 50, 3434).collect()] for _ in range(2))
    assert sorted(a) == sorted(b) and len(set(a)) == 50 and all(x % 3 == 0 for x in a)
    assert E.sample_positions(100, 50, 3434) == E.sample_positions(100, 50, 3434)
    with pytest.raises(ValueError):
        E.sample_positions(3, 4, 1)


def test_candidates_hold_the_nearest(spark):
    """Top-k from the pairs that share a dimension, filled up, is that of all pairs; empty profiles too."""
    rng = np.random.default_rng(7)
    rows = rng.integers(0, 3, (30, 8)) * (rng.random((30, 8)) < 0.25)
    rows[[3, 11, 12, 20, 29]] = 0
    rel, nodes = profile(spark, rows.tolist())
    score = M.relative_affinity(M.jaccard(), M.bray_curtis(), F.lit(0.4)).alias("score")
    ranked = lambda p: {(r["q"], r["rank"]): r["r"] for r in R.top_k(p.select("q", "r", score), 5).collect()}
    whole = P.all_pairs(nodes, rel, nodes, rel)
    assert ranked(P.candidate_pairs(nodes, rel, nodes, rel, 5)) == ranked(whole)
    own, rest = nodes.where("node % 3 = 0"), nodes.where("node % 3 <> 0")
    some = P.candidate_pairs(own, rel.where("i % 3 = 0"), rest, rel.where("i % 3 <> 0"), 5)
    assert ranked(some) == ranked(whole.where("q % 3 = 0 AND r % 3 <> 0"))
    folds = nodes.withColumn("fold", F.col("node") % 4)
    assert ranked(P.candidate_pairs(folds, rel, folds, rel, 5)) == ranked(whole.where("q % 4 <> r % 4"))


def test_distances_and_bounds(spark):
    rows = [[0, 3], [2, 3], [0, 0]]
    p = P.interval_ranges(pairs(spark, rows))
    now, old = value(p, M.current_distance(F.lit(0.5))), value(p, M.historical_distance(F.lit(0.5)))
    assert now[0, 1] == 0.5 * 1 + 0.5 * 2 and old[0, 1] == pytest.approx(now[0, 1] / (0.5 + 0.5 * 3))
    flat = P.interval_ranges(pairs(spark, [[0], [0]]))
    assert value(flat, M.historical_distance(F.lit(0.0)))[0, 1] == math.inf
    bound = value(p, M.dimension_affinity(F.lit(2.0), F.lit(3.0), F.lit(0.3)))
    assert bound[0, 1] == pytest.approx(1 - (0.3 * 1 / 2 + 0.7 * 2 / 6)) and bound[0, 0] == 1
    assert value(p, M.hetesim_forced())[2, 2] == 1


def test_settings_by_hand(spark):
    rng = np.random.default_rng(5)
    n, folds, label = 24, np.arange(24) % 3, rng.integers(0, 3, 24)
    score = rng.integers(0, 9, (n, n)) / 8
    rows = [(0, int(folds[q]), q, r, float(score[q, r])) for q in range(n) for r in range(n) if folds[q] != folds[r]]
    scored = spark.createDataFrame(rows, "g long, fold int, q long, r long, score double")
    labels = spark.createDataFrame([(i, int(label[i]), int(folds[i])) for i in range(n)], "node long, label long, fold int")
    refs, ks = E.fold_references(labels), (3, 7)
    got = {(r["k"], r["gamma"], r["prior"]): r for r in E.evaluate_settings(scored, labels, refs, ks, (0.0, 2.0), (0.0, 1.0)).collect()}
    assert len(got) == 8

    def f1(truth, pred):
        classes = sorted(set(truth) | set(pred))
        return np.mean([2 * ((pred == c) & (truth == c)).sum() / ((pred == c).sum() + (truth == c).sum()) for c in classes])

    plain = E.evaluate_grid(scored, labels, refs, 3).first()
    for (k, gamma, prior), row in got.items():
        macro, right, gain = [], [], []
        for f in range(3):
            tests, others = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
            share = np.array([(label[others] == c).mean() for c in range(3)])
            pred = []
            for q in tests:
                near = sorted(others, key=lambda r: (-score[q, r], r))[:k]
                s = np.zeros(3)
                for r in near:
                    s[label[r]] += max(score[q, r], 0) ** gamma
                s /= share**prior
                tied = np.flatnonzero(np.isclose(s, s.max()))
                pred.append(min(tied, key=lambda c: (next((i for i, r in enumerate(near) if label[r] == c), k), c)))
                ideal = sum(1 / math.log2(i + 2) for i in range(min(3, (label[others] == label[q]).sum())))
                gain.append((f, sum(1 / math.log2(i + 2) for i, r in enumerate(near[:3]) if label[r] == label[q]) / ideal))
            macro.append(f1(label[tests], np.array(pred)))
            right.append((label[tests] == pred).mean())
        assert row["macro_f1"] == pytest.approx(np.mean(macro)) and row["accuracy"] == pytest.approx(np.mean(right))
        assert row["macro_f1_se"] == pytest.approx(np.std(macro, ddof=1) / math.sqrt(3))
        assert plain["ndcg"] == pytest.approx(np.mean([np.mean([x for g, x in gain if g == f]) for f in range(3)]))


def test_bootstraps(spark):
    rows = [(t, b, o, 0.5, 0.5 + 0.1 * (o == t)) for t, b, o in [(0, 0, 0), (0, 1, 0), (1, 1, 1), (1, 0, 1), (1, 1, 1)] for _ in range(20)]
    got = {r["metric"]: r for r in E.bootstrap(spark.createDataFrame(rows, "truth long, base long, other long, base_ndcg double, other_ndcg double"), 200, 3).collect()}
    assert set(got) == {"macro_f1", "accuracy", "ndcg"} and got["accuracy"]["difference"] == pytest.approx(0.4)
    assert all(r["low"] <= r["difference"] <= r["high"] and r["positive"] == 1 for r in got.values() if r["metric"] != "ndcg")
    assert got["ndcg"]["low"] == pytest.approx(0.1)
    cells = [(q, c, (q + c) % 2, 1, (q + c) % 2) for q in range(40) for c in range(3)]
    got = {r["metric"]: r for r in E.node_bootstrap(spark.createDataFrame(cells, "q long, class long, bit int, base int, other int"), 100, 3).collect()}
    assert got["subset_accuracy"]["difference"] == 1 and got["macro_f1"]["difference"] > 0 and got["micro_f1"]["positive"] == 1


def test_label_sets_are_dealt_as_one_by_one():
    """Rounds at once give the counts that picking a fold for each row gives."""
    groups = {(0,): 1000, (1,): 503, (0, 1): 77, (2,): 31, (0, 2): 9}
    share = E.deal_label_sets(groups, 4)
    assert {s: sum(n) for s, n in share.items()} == groups
    assert sorted(sum(n[f] for n in share.values()) for f in range(4)) == [405] * 4
    for c in range(3):
        per = [sum(n[f] for s, n in share.items() if c in s) for f in range(4)]
        assert max(per) - min(per) <= 2
    with pytest.raises(ValueError):
        E.deal_label_sets({(): 3, (1,): 2}, 2)


def test_ingest_run(spark, tmp_path):
    from weft.sources import cache, hgb, ingest

    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    (raw / "node.dat").write_text("0\ta\t0\n1\tb\t0\n2\tc\t1\tmore\n3\td\t1\n")
    (raw / "link.dat").write_text("0\t2\t0\t1.0\n0\t2\t0\t2.0\n1\t3\t0\t1.0\n2\t0\t1\t3.0\n3\t1\t1\t5.0\n")
    (raw / "info.dat").write_text(
        '{"link.dat": {"link type": {"0": {"start": 0, "end": 1, "meaning": "x"}, "1": {"start": 1, "end": 0, "meaning": "y"}}},'
        ' "label.dat": {"node type": {"0": {"0": "p", "1": "q"}}}}'
    )
    (raw / "label.dat").write_text("0\ta\t0\t0\n")
    (raw / "label.dat.test").write_text("1\tb\t0\t0,1\n")
    with pytest.raises(Exception, match="bad label"):
        ingest.ingest(spark, str(raw), out + "-bad")
    m = ingest.ingest(spark, str(raw), out, multilabel=True, expected={0: 2, 1: 2})
    assert m["node_shifts"] == {"0": 0, "1": 2} and m["relations"]["0"] == {
        "source_type": 0, "target_type": 1, "meaning": "x", "shape": [2, 2], "records": 3, "nonzero": 2
    }
    assert m["reverse_relation_checks"] == [{"relations": [0, 1], "exact_transposes": False, "difference_nonzero": 1}]
    assert m["labels"]["train"] == 1 and m["labels"]["test_assignments"] == 2 and m["labels"]["test_mean_cardinality"] == 2
    assert set(m["raw_sha256"]) == set(ingest.FILES)
    assert hgb.load_training_labels(spark, f"{out}/labels").where("bit = 1").collect()[0]["class"] == 0
    ids = hgb.load_test_ids(spark, f"{out}/labels")
    assert ids.columns == ["node"] and [r["node"] for r in ids.collect()] == [1]
    assert [r["label"] for r in hgb.read_legacy_labels(spark, str(raw / "label.dat")).collect()] == [0]
    with pytest.raises(ValueError):
        ingest.ingest(spark, str(raw), out + "-2", expected={0: 3, 1: 1})
    with pytest.raises(ValueError):
        hgb.write_labels(ids.withColumn("label", F.lit(0)), ids.withColumn("label", F.lit(1)), out + "-3")
    with pytest.raises(ValueError):
        hgb.meta_path(spark, f"{out}/relations", "ACM", "XYZ")
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [cache.cached(spark, out, "t", "k1", make).count() for _ in range(2)] == [3, 3] and made == [1]


def test_more_guards(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "i long, j long, w double")
    L.require_same_dimensions(a, a, 2, 2)
    for left, right in ((2, 3), (1, 1)):
        with pytest.raises(ValueError):
            L.require_same_dimensions(a, a, left, right)
    with pytest.raises(ValueError):
        L.split_exactly(a)
    one, two = L.split_exactly(a.withColumn("w", F.lit(1.0)))
    assert one.count() == two.count() == 2


def test_out_of_fold_and_subsets(spark):
    pred = spark.createDataFrame([("a", 1, 0, 0), ("a", 2, 1, 1), ("b", 1, 0, 0), ("b", 2, 1, 0)], "method string, q long, truth long, pred long")
    got = {r["method"]: r for r in E.out_of_fold(pred, "b").collect()}
    assert got["a"]["accuracy_gain"] == 0.5 and got["b"]["macro_f1_gain"] == 0 and got["b"]["macro_f1"] == pytest.approx((2 / 3 + 0) / 2)
    one = E.subset_accuracy(pred, spark.createDataFrame([(2,)], "node long"))
    assert {r["method"]: r["accuracy"] for r in one.collect()} == {"a": 1.0, "b": 0.0}


def test_text_sources(spark, tmp_path):
    from weft.sources import hgb

    (tmp_path / "node.dat").write_text("0\ta\t0\n1\tb\t0\n2\tc\t1\tmore\n")
    (tmp_path / "link.dat").write_text("0\t2\t0\t1.0\n0\t2\t0\t2.0\n1\t2\t0\t1.0\n")
    (tmp_path / "info.dat").write_text('{"link.dat": {"0": {"start": "0", "end": "1", "meaning": "x"}}, "label.dat": {"0": {"0": "p"}}}')
    (tmp_path / "label.dat").write_text("0\ta\t0\t0\n1\tb\t0\t1\n")
    nodes = hgb.read_nodes(spark, str(tmp_path / "node.dat"))
    shifts = hgb.type_shifts(nodes)
    assert [(r["n"], r["shift"], r["contiguous"]) for r in shifts.orderBy("node_type").collect()] == [(2, 0, True), (1, 2, True)]
    rel = hgb.local_edges(hgb.read_edges(spark, str(tmp_path / "link.dat")), hgb.read_catalog(spark, str(tmp_path / "info.dat")), shifts)
    assert sorted((r["i"], r["j"], r["w"]) for r in rel.collect()) == [(0, 0, 3.0), (1, 0, 1.0)]
    hgb.write_relations(rel, str(tmp_path / "rel"))
    assert hgb.read_relation(spark, str(tmp_path / "rel"), 0).count() == 2
    assert hgb.read_labels(spark, str(tmp_path / "label.dat"), 0, 2, False).count() == 2
    with pytest.raises(Exception, match="bad label"):
        hgb.read_labels(spark, str(tmp_path / "label.dat"), 0, 1, False).collect()
    ids = lambda v: spark.createDataFrame(list(enumerate(v)), "pos long, id long")
    prints = [hgb.fingerprint(ids(v)).first()["fingerprint"] for v in ([1, 2, 3], [3, 2, 1], [4, 5, 6], [1, 2, 3])]
    assert prints[0] == prints[3] and len(set(prints)) == 3


def test_multilabel_grid_by_hand(spark):
    rng = np.random.default_rng(4)
    n, folds = 24, np.arange(24) % 4
    bits = (rng.random((n, 3)) < 0.4).astype(int)
    views = rng.integers(-2, 9, (2, n, n)) / 8
    rows = [(g, int(folds[q]), q, r, float(views[g, q, r])) for g in range(2) for q in range(n) for r in range(n) if folds[q] != folds[r]]
    scored = spark.createDataFrame(rows, "g long, fold int, q long, r long, score double")
    known = spark.createDataFrame([(i, c, int(bits[i, c]), int(folds[i])) for i in range(n) for c in range(3)], "node long, class long, bit int, fold int")
    grid = ((2, 5), (0.0, 1.0, 2.0), (0.0, 1.0), (0.3, 0.6))
    got = E.evaluate_multilabel_grid(scored, known, *grid).collect()
    assert len(got) == 48
    for row in got:
        found = []
        for f in range(4):
            tests, refs = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
            pred = []
            for q in tests:
                near = sorted(refs, key=lambda r: (-views[row["g"], q, r], r))[: row["k"]]
                w = np.maximum(views[row["g"], q, near], 0) ** row["gamma"]
                w = w if w.sum() > 1e-8 else np.ones(len(near))
                s = (w[:, None] * bits[near]).sum(0) / w.sum() / np.maximum(bits[refs].mean(0), 1e-12) ** row["prior"]
                s = np.round(s / s.max() if s.max() > 0 else s * 0, 12)
                pred.append(s >= row["threshold"] if (s >= row["threshold"]).any() else np.arange(3) == s.argmax())
            pred, truth = np.array(pred).astype(int), bits[tests]
            tp, both = (pred * truth).sum(0), pred.sum(0) + truth.sum(0)
            macro = np.mean([2 * t / b if b else 0 for t, b in zip(tp, both, strict=True)])
            found.append((macro, 2 * tp.sum() / both.sum(), (pred == truth).all(1).mean()))
        want = [*np.mean(found, 0), np.std([m for m, _, _ in found], ddof=1)]
        assert [row[c] for c in ("macro_f1", "micro_f1", "subset_accuracy", "macro_f1_std")] == pytest.approx(want)


def test_grid_is_ranked_from_lists(spark):
    """the grid multiplies queries, not pairs: its join stands above the aggregate that gathers a query's pairs."""
    rng = np.random.default_rng(5)
    rows = [(int(q) % 2, int(q), int(r), float(rng.integers(4)) / 4, float(rng.integers(4)) / 4) for q in range(6) for r in range(30)]
    pairs = spark.createDataFrame(rows, "fold long, q long, r long, j double, bc double")
    grid = spark.createDataFrame([(0, 0.0), (1, 0.3), (2, 1.0)], "g long, beta double")
    got = R.grid_top_k(pairs, grid, lambda x: M.relative_affinity(x["j"], x["bc"], F.col("beta")), 7)
    want = R.top_k(pairs.join(grid).withColumn("score", M.relative_affinity(F.col("j"), F.col("bc"), F.col("beta"))), 7, by=("g", "fold", "q"))
    cols = ["g", "fold", "q", "r", "score", "rank"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join") < plan.index("collect_list")
    assert R.grid_top_k(pairs, grid, lambda x: x["j"], 7, allowed=lambda x: F.lit(False)).count() == 0


def test_hot_dimensions_are_cut_into_pieces(spark, monkeypatch):
    """the sums of pairs are the same whole and in pieces, on one relation and on two."""
    rng = np.random.default_rng(6)
    a, _ = profile(spark, rng.integers(0, 3, (11, 9)).tolist())
    b, _ = profile(spark, rng.integers(0, 3, (7, 9)).tolist())
    rows = lambda: [sorted(map(tuple, P.gram(x, y).select("q", "r", "inter", "eq", "dot", "mn").collect())) for x, y in ((a, a), (a, b))]
    whole = rows()
    monkeypatch.setattr(P, "HOT_MEMBERS", 2)
    assert rows() == whole and len(whole[0]) > 50


def test_candidates_hold_the_nearest_whichever_fold_is_left_out(spark):
    """one set of pairs serves every outer fold."""
    rng = np.random.default_rng(8)
    rel, nodes = profile(spark, rng.integers(0, 2, (24, 6)).tolist())
    nodes = nodes.withColumn("fold", F.col("node") % 4)
    score = M.relative_affinity(M.jaccard(), M.bray_curtis(), F.lit(0.4)).alias("score")
    cand = P.candidate_pairs(nodes, rel, nodes, rel, 3, folds=True).select("q", "r", "fold", "fold_r", score).cache()
    whole = P.all_pairs(nodes, rel, nodes, rel).select("q", "r", score).where("q % 4 <> r % 4").cache()
    for out in range(4):
        near = [sorted(map(tuple, R.top_k(df, 3).select("q", "r", "rank").collect())) for df in (cand.where(f"fold <> {out} AND fold_r <> {out}").select("q", "r", "score"), whole.where(f"q % 4 <> {out} AND r % 4 <> {out}"))]
        assert near[0] == near[1]


def test_farthest_of_shared_and_unshared(spark):
    """the largest value-Hamming without all pairs, also for empty profiles."""
    rng = np.random.default_rng(9)
    for rows in ([[1, 0, 0], [0, 2, 3], [0, 0, 0], [0, 2, 0]], rng.integers(0, 2, (15, 8)).tolist(), [[0, 0], [0, 0]], [[1, 1], [1, 2]]):
        rel, nodes = profile(spark, rows) if np.any(rows) else (spark.createDataFrame([], "i long, j long, w double"), spark.range(2).toDF("node"))
        want = P.all_pairs(nodes, rel, nodes, rel).groupBy("q").agg(F.max(M.value_hamming()).alias("far"))
        assert sorted(map(tuple, P.farthest(nodes, rel).collect())) == sorted(map(tuple, want.collect()))


def test_product_is_not_joined_by_both_ends(spark):
    """no join of all pairs by q and r, which shuffles the product; hits at both ends, side by side and none."""
    rows = [[1, 0, 0, 0], [0, 0, 0, 0], [0, 2, 0, 0], [0, 1, 3, 0], [1, 0, 3, 0], [0, 0, 0, 2]]
    (a, an), (b, bn) = profile(spark, rows), profile(spark, rows[::-1] + [[0, 0, 0, 0]])
    p = P.all_pairs(an, a, bn, b)
    assert not re.search(r"Join \w+, \(\(\(?q#\d+L? = q#\d+L?\)? AND", p._jdf.queryExecution().optimizedPlan().toString())
    got = {(x.q, x.r): (x.inter, x.dot, x.sup_q, x.sup_r) for x in p.collect()}
    x, y = np.array(rows), np.array(rows[::-1] + [[0] * 4])
    assert p.count() == len(got) == 42
    for q, r in got:
        assert got[q, r] == (((x[q] > 0) & (y[r] > 0)).sum(), x[q] @ y[r], (x[q] > 0).sum(), (y[r] > 0).sum())


def test_paths_hold_the_nearest(spark):
    """candidates by two relations rank as all pairs do, with profiles that are empty in one or in both."""
    rng = np.random.default_rng(10)
    rows = [rng.integers(0, 2, (20, 7)) * (rng.random((20, 1)) > 0.4) for _ in range(2)]
    (a, nodes), (b, _) = (profile(spark, x.tolist()) for x in rows)
    nodes = nodes.withColumn("fold", F.col("node") % 2)
    score = M.relative_affinity(M.jaccard(), M.bray_curtis(), F.lit(0.4))
    one = [P.all_pairs(nodes, rel, nodes, rel).select("q", "r", score.alias(f"s{i}")) for i, rel in enumerate((a, b))]
    whole = one[0].join(one[1], ["q", "r"]).where("q % 2 <> r % 2").withColumn("fold", F.col("q") % 2)
    grid = spark.createDataFrame([(0, 0.0), (1, 0.3), (2, 1.0)], "g long, weight double")
    mixed = lambda c: F.col("weight") * c("s0") + (1.0 - F.col("weight")) * c("s1")
    got = R.grid_top_k(P.path_candidates(nodes, [a, b], score, 4), grid, lambda x: mixed(lambda n: x[n]), 4, digits=2)
    want = R.top_k(whole.join(grid).withColumn("score", F.round(mixed(F.col), 2)), 4, by=("g", "fold", "q"))
    cols = ["g", "fold", "q", "r", "score", "rank"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
