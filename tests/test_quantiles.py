"""Quantiles by refined histograms against those of sorted values."""

import numpy as np
import pytest

from candlewick.operators.quantiles import quantiles


@pytest.mark.parametrize("bins", [3, 4096])
def test_quantiles_are_exact(spark, bins):
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.normal(0, 1, 501), "ties": rng.integers(0, 4, 700).astype(float), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "same": np.full(50, -7.25),
        "wide": np.concatenate([10.0 ** rng.integers(-200, 200, 90), [-1e300, 1e300]]), None: rng.normal(5, 2, 40),
    }
    if bins < 10:
        del groups["wide"]  # takes a pass for each power of the bins
    rows = [(g, float(v), float(v) * 2 if k % 3 else None) for g, own in groups.items() for k, v in enumerate(own)] + [("none", None, None)]
    frame = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    shares = {"p0": ("x", 0.0), "p1": ("x", 0.01), "p25": ("x", 0.25), "p50": ("x", 0.5), "p99": ("x", 0.99), "top": ("x", 1.0), "y50": ("y", 0.5)}
    got = {r.g: r for r in quantiles(frame, ["g"], shares, bins).collect()}
    assert set(got) == set(groups)  # a group without values has no row
    for g, own in groups.items():
        for name, (column, share) in shares.items():
            values = own if column == "x" else np.array([v * 2 for k, v in enumerate(own) if k % 3])
            if len(values):
                assert got[g][name] == pytest.approx(np.quantile(values, share), rel=1e-12), (g, name)
            else:
                assert got[g][name] is None


def test_quantiles_without_groups_and_without_rows(spark):
    frame = spark.createDataFrame([(float(v),) for v in range(10)], "x double")
    assert quantiles(frame, [], {"m": ("x", 0.5)}).first().m == 4.5
    assert quantiles(frame.limit(0), [], {"m": ("x", 0.5)}).count() == 0
