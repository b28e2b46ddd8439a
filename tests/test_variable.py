"""Variable features by a local fit against numpy."""

import numpy as np

from strandline.operators import variable


def plain_fit(x, y, span):
    q = max(1, int(span * len(x) + 1e-5))
    out = []
    for at in x:
        d = np.abs(x - at)
        h = np.sort(d)[q - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        out.append(np.polyval(np.polyfit(x - at, y, 2, w=np.sqrt(w)), 0))
    return np.array(out)


def test_loess_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=130)
    y = np.sin(x) + rng.normal(0, 0.1, 130)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(500, None, 1.0)], "feature_id long, x double, y double")
    want = plain_fit(x, y, 0.3)
    for block in (1024, 20):
        got = {r.feature_id: r.fit for r in variable.loess(points, 0.3, block).collect()}
        assert len(got) == 130 and np.abs(np.array([got[i] for i in range(130)]) - want).max() < 1e-8
    alone = spark.createDataFrame([(1, 2.0, 3.0)], "feature_id long, x double, y double")
    assert [r.fit for r in variable.loess(alone).collect()] == [3.0] and variable.loess(alone.where("false")).count() == 0


def test_variable_features_equal_numpy(spark):
    rng = np.random.default_rng(6)
    n, genes = 60, 80
    counts = rng.negative_binomial(2, 2 / (2 + np.exp(rng.normal(1, 1, genes))), (n, genes))
    counts[0, 3] += 400
    counts[:, 7] = 5
    entries = spark.createDataFrame([(c, g, float(counts[c, g])) for c in range(n) for g in range(genes) if counts[c, g]], "cell_id long, feature_id long, value double")
    got = {r.feature_id: r for r in variable.variable_by_loess(entries, n, 10).collect()}
    mean, var = counts.mean(axis=0), counts.var(axis=0, ddof=1)
    fit = np.zeros(genes)
    fit[var > 0] = plain_fit(np.log10(mean[var > 0]), np.log10(var[var > 0]), 0.3)
    sd = 10 ** (fit / 2)
    clipped = np.minimum(counts, mean + sd * np.sqrt(n))
    want = (n * mean**2 + (clipped**2).sum(axis=0) - 2 * mean * clipped.sum(axis=0)) / ((n - 1) * sd**2)
    assert sorted(got) == list(range(genes))
    assert np.abs(np.array([got[g].standardised for g in range(genes)]) - want).max() < 1e-6 and got[7].fitted == 0
    top = sorted(range(genes), key=lambda g: (-round(want[g], 9), g))[:10]
    assert sorted((g for g in got if got[g].highly_variable), key=lambda g: got[g].rank) == top
    left = variable.variable_by_loess(entries, n, 10, rescued=spark.createDataFrame([(3,)], "feature_id long"))
    assert 3 not in {r.feature_id for r in left.collect()}


def test_sums_of_blocks_are_as_good_as_points(spark, monkeypatch):
    """Blocks inside all windows are not read point by point; gaps, far points and many equal x included."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=900), rng.normal(6, 0.01, 500), np.round(rng.normal(3, 1, 600), 1), [40.0, 41.0, -30.0]])
    y = np.cos(x / 3) + rng.normal(0, 0.1, len(x))
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "feature_id long, x double, y double")
    read = []
    real = variable.Blocks.needs
    monkeypatch.setattr(variable.Blocks, "needs", lambda self, b: (read.append((len(self.low), len(real(self, b)[2]))), real(self, b))[1])
    got = {r.feature_id: r.fit for r in variable.loess(points, 0.3, 16).collect()}
    assert np.abs(np.array([got[i] for i in range(len(x))]) - plain_fit(x, y, 0.3)).max() < 1e-7
    # before, a block's task had its window to both sides: all points six tenths of the number of blocks times
    assert sum(k for _, k in read) < 0.15 * read[0][0] ** 2
    # more points at one x than a window holds
    same = spark.createDataFrame([(i, 1.0, float(i % 5)) for i in range(50)] + [(50 + i, 2.0 + i, 1.0) for i in range(50)], "feature_id long, x double, y double")
    got = {r.feature_id: r.fit for r in variable.loess(same, 0.3, 8).collect()}
    assert len(got) == 100 and got[3] == 2.0 and abs(got[90] - 1) < 1e-9
