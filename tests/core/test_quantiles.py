"""Exact quantiles against numpy."""

import math

import numpy as np
import pytest

from orrery.operators import quantiles as Q

AT = {"least": 0.0, "lower": 0.25, "mid": 0.5, "odd": 0.613, "most": 1.0}


@pytest.mark.parametrize("ranges", [64, 2])
def test_quantiles_match_numpy(spark, monkeypatch, ranges):
    monkeypatch.setattr(Q, "RANGES", ranges)
    rng = np.random.default_rng(4)
    groups = {"many": rng.normal(size=5000), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.array([7.5]), "two": np.array([1.0, 2.0]), "same": np.full(500, 3.0), None: rng.integers(0, 1000, 700) / 8}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("many", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: [r[n] for n in AT] for r in Q.exact(df, ["k"], "v", AT).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(got[k], np.quantile(vs, list(AT.values()))))
    every = np.concatenate(list(groups.values()))
    [r] = Q.exact(df, [], "v", AT).collect()
    assert all(math.isclose(r[n], np.quantile(every, p), rel_tol=1e-9, abs_tol=1e-12) for n, p in AT.items())
    assert Q.exact(df.limit(0), ["k"], "v", AT).count() == Q.exact(df.limit(0), [], "v", AT).count() == 0
