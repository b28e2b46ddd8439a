"""Planned aggregates against plain loops: valid and reliable bins, invalid ones, and membership."""

import numpy as np
import pytest

from strandline.operators import planned


@pytest.fixture(scope="module")
def plan(spark):
    rng = np.random.default_rng(2)
    w = np.where(rng.random((6, 40)) < 0.3, rng.random((6, 40)), 0.0)
    w[2] = 0.0
    w[4, 3:] = 0.0
    w[:, 9] = 0.0
    # cell 11 lies in the bin of little support only
    w[:, 11] = 0.0
    w[4, 11] = 0.5
    values = rng.poisson(1.0, size=(40, 5)).astype(float)
    values[:, 4] = 0.0
    values[9, 4] = 3.0
    bins = spark.createDataFrame([(i // 3, i % 3) for i in range(6)], "branch int, bin int")
    weights = spark.createDataFrame([(i // 3, i % 3, j, float(w[i, j])) for i in range(6) for j in range(40)] + [(0, 0, 39, None)], "branch int, bin int, cell_id int, w double")
    entries = spark.createDataFrame([(j, f, float(values[j, f])) for j in range(40) for f in range(5) if values[j, f]], "cell_id int, feature_id int, value double")
    return w, values, bins, weights, entries


@pytest.mark.parametrize(("separate", "ess"), [(True, None), (False, None), (True, 7.0)])
def test_means_and_validity_equal_a_loop(plan, separate, ess):
    w, values, bins, weights, entries = plan
    table = planned.planned_bins(weights, bins, 5, separate, ess)
    got = {(r["branch"], r["bin"]): r for r in table.collect()}
    means = {(r["branch"], r["bin"], r["feature_id"]): r["value"] for r in planned.planned_means(entries, weights, table, separate).collect()}
    assert len(got) == 6 and len(means) == 30
    states = set()
    for i in range(6):
        r, support, total = got[i // 3, i % 3], int((w[i] > 0).sum()), w[i].sum()
        size = total**2 / (w[i] ** 2).sum() if total else 0.0
        valid = total > 0 and (support >= 5 or not separate)
        reliable = valid and support >= 5 and (ess is None or size >= ess)
        assert (r["support"], r["valid"], r["reliable"]) == (support, valid, reliable) and r["ess"] == pytest.approx(size)
        states.add((valid, reliable))
        for f in range(5):
            want = w[i] @ values[:, f] / (total + 1e-10) if valid or not separate else None
            assert means[i // 3, i % 3, f] == (None if want is None else pytest.approx(want))
    assert len(states) >= 2


def test_membership_uses_valid_bins_only(plan):
    w, _, bins, weights, _ = plan
    table = planned.planned_bins(weights, bins, 5)
    got = {(r["branch"], r["bin"], r["cell_id"]): r["w"] for r in planned.valid_membership(weights, table).collect()}
    good = np.array([(row > 0).sum() >= 5 for row in w])
    k = w * good[:, None]
    want = {(i // 3, i % 3, j): k[i, j] / (k[i // 3 * 3 : i // 3 * 3 + 3, j].sum() + 1e-10) for i, j in zip(*np.nonzero(k), strict=True)}
    assert got == pytest.approx(want) and not {9, 11} & {key[2] for key in got}
    empty = planned.planned_bins(weights.where("false"), bins)
    assert {(r["valid"], r["support"]) for r in empty.collect()} == {(False, 0)} and planned.valid_membership(weights, empty).count() == 0
