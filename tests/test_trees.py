import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import trees as T
from chronopanel.operators.forecast import BoostedTrees, Forest


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for fold, n in ((1, 700), (2, 400)):
        a, b, c = rng.normal(size=n), rng.integers(0, 6, n), rng.normal(size=n)
        y = np.where(a > 0.3, 3.0, 0.0) + b + 0.1 * rng.normal(size=n) + fold
        out += [(fold, *map(float, r)) for r in zip(a, b, c, y)]
    return spark.createDataFrame(out, "fold int, a double, b double, c double, y double").repartition(5).cache()


FEATURES = ["a", "b", "c"]


def table(ensemble):
    return [(r["fold"], r["tree"], r["node"], r["left"], r["feature"], r["bin"], round(r["value"], 9), round(r["gain"], 6), r["weight"])
            for r in ensemble.nodes.orderBy("fold", "tree", "node").collect()]


@pytest.mark.parametrize("how", [T.Growth(5, 4, 32, True, False, 0.3, 0.8, 0.7), T.Growth(4, 5, 64, False, True, 1.0, 1.0, 1.0, 0.0, 5)])
def test_both_ways_grow_the_same_trees(rows, how, monkeypatch):
    monkeypatch.setattr(T, "STORE_EVERY", 2)
    whole, levels = T.grow_folds(rows, "y", FEATURES, how), T.grow_folds(rows, "y", FEATURES, how, fold_rows=10)
    assert table(whole) == table(levels)
    assert len({t[:2] for t in table(whole)}) == 2 * how.trees


def test_first_cut_against_all_cuts(rows):
    fit = T.grow_folds(rows, "y", FEATURES, T.Growth(1, 1, 256, True, False, 1.0, 1.0, 1.0, 2.0))
    for k in (1, 2):
        data = np.array([[r[c] for c in (*FEATURES, "y")] for r in rows.filter(F.col("fold") == k).collect()])
        g = data[:, 3].mean() - data[:, 3]
        best = max(((g[left].sum() ** 2 / (left.sum() + 2) + g[~left].sum() ** 2 / ((~left).sum() + 2), i, cut) for i in range(3)
                    for cut in fit.edges[k][i][:-1] for left in [data[:, i] <= cut]), key=lambda t: t[0])
        root = [t for t in table(fit) if t[0] == k][0]
        assert root[4] == best[1] and fit.edges[k][root[4]][root[5]] == best[2]
        assert root[7] == pytest.approx(best[0] - g.sum() ** 2 / (len(g) + 2), abs=1e-5)
        left = data[:, root[4]] <= best[2]
        values = [t[6] for t in table(fit) if t[0] == k]
        assert values[1] == pytest.approx(-g[left].sum() / (left.sum() + 2)) and values[2] == pytest.approx(-g[~left].sum() / ((~left).sum() + 2))


def test_fit_and_predict(rows):
    for model, most in ((BoostedTrees(trees=60, depth=3, step=0.2), 0.25), (Forest(trees=20, depth=8), 0.45)):
        fit = model.fit_folds(rows, "y", FEATURES)
        out = fit.predict(rows)
        assert out.columns == [*rows.columns, "y_pred"] and out.count() == 1100
        assert out.agg(F.sqrt(F.avg((F.col("y") - F.col("y_pred")) ** 2))).first()[0] < most
        gains = {(r["fold"], r["feature"]): r["importance"] for r in fit.importances().collect()}
        assert len(gains) == 6 and all(gains[k, "c"] < min(gains[k, "a"], gains[k, "b"]) for k in (1, 2))
        assert sum(gains.values()) == pytest.approx(2)
        again = model.fit_folds(rows.repartition(3), "y", FEATURES)
        assert table(again.ensemble) == table(fit.ensemble)


def test_a_fold_without_rows_and_missing_values(spark, rows):
    fit = BoostedTrees(trees=2, depth=2).fit(rows.filter("fold = 1"), "y", FEATURES)
    odd = spark.createDataFrame([(9, None, 1.0, float("nan"), None), (8, 1e9, -1e9, 0.0, 1.0)], rows.schema)
    got = fit.predict(odd).collect()
    assert [r["fold"] for r in got] == [9, 8] and all(r["y_pred"] is not None for r in got)
    both = BoostedTrees(trees=2, depth=2).fit_folds(rows.filter("fold = 1").unionByName(odd.filter("y is null")), "y", FEATURES)
    assert {r["fold"]: r["y_pred"] for r in both.predict(odd).collect()} == {9: None, 8: None}
    empty = BoostedTrees(trees=2, depth=2).fit(rows.limit(0), "y", FEATURES)
    assert empty.predict(odd).filter("y_pred is null").count() == 2
    with pytest.raises(ValueError):
        BoostedTrees(bins=300).fit(rows, "y", FEATURES)


def test_rows_drawn_with_replacement():
    h = np.arange(200_000, dtype=np.int64)
    w = T.row_weights(h, 3, T.Growth(1, 1, 2, False))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert np.array_equal(w, T.row_weights(h, 3, T.Growth(1, 1, 2, False))) and not np.array_equal(w, T.row_weights(h, 4, T.Growth(1, 1, 2, False)))
    assert abs(T.row_weights(h, 3, T.Growth(1, 1, 2, True, row_share=0.8)).mean() - 0.8) < 0.005
