"""Coordinate descent with a duality gap, and Huber regression by Newton steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeworks.plans.coordinate import Centred, descend, duality_gap, elastic_net_path
from slopeworks.plans.passes import fit_by_passes, fit_huber_newton


def sample(seed=0, n=400, p=8):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, p)) * r.uniform(0.2, 3, p) + r.normal(size=p)
    x[:, 1] = x[:, 0] + 0.05 * r.normal(size=n)  # nearly a copy
    return x, x @ np.where(np.arange(p) % 3 == 0, 1.5, 0.0) + 4 + 0.3 * r.normal(size=n)


def statistic(x, y):
    z = np.column_stack([x, np.ones(len(x)), y])
    return z.T @ z


def frame(spark, x, y, extra=()):
    names = [f"x{j}" for j in range(x.shape[1])]
    rows = [(*map(float, a), float(b), *[e[i] for e in extra]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, [*names, "y", *[f"e{k}" for k in range(len(extra))]]), names


@pytest.mark.parametrize("l1, l2", [(0.5, 0.0), (0.05, 0.05), (1e-3, 0.0), (100.0, 0.0)])
def test_conditions_of_optimality_hold(l1, l2):
    x, y = sample()
    s = Centred(statistic(x, y))
    w, gap, _, converged = descend(s, np.zeros(8), l1, l2, 1e-12)
    assert converged and 0 <= gap <= 1e-12 * s.q
    pull = (x - x.mean(0)).T @ (y - x @ w - s.bias(w)) / len(y) - l2 * w
    assert np.allclose(pull[w != 0], l1 * np.sign(w[w != 0]), atol=1e-5)
    assert (np.abs(pull[w == 0]) <= l1 + 1e-6).all()
    assert duality_gap(s, w + 0.1, l1, l2) > gap  # any other point has a gap


def test_constant_and_unknown_columns():
    x, y = sample(p=4)
    x[:, 2] = 1e6
    w, _, _, converged = descend(Centred(statistic(x, y)), np.zeros(4), 0.01, 0.0, 1e-9)
    assert converged and w[2] == 0
    x[3, 0] = np.nan
    assert not descend(Centred(statistic(x, y)), np.zeros(4), 0.01, 0.0, 1e-9)[3]


def test_paths_by_group_and_held_out_rows(spark):
    x, y = sample(n=600)
    group, fold = ["a" if k % 2 else None for k in range(600)], [None if k % 4 == 3 else k % 4 == 0 for k in range(600)]
    df, names = frame(spark, x, y, (group, fold))
    penalties = [1.0, 0.1, 0.01, 0.001]
    out = elastic_net_path(df, names, "y", penalties, 0.9, F.col("e1"), ["e0"]).collect()
    assert len(out) == 8 and all(r["converged"] for r in out)
    for g in ("a", None):
        rows = sorted((r for r in out if r["e0"] == g), key=lambda r: -r["regularization"])
        test = np.array([(e == g) and f is True for e, f in zip(group, fold)])
        if not test.any():
            assert all(r["held_out_loss"] is None for r in rows) and rows[-1]["chosen"]
            continue
        losses = [np.mean((y[test] - x[test] @ r["weights"][:-1] - r["weights"][-1]) ** 2) / 2 for r in rows]
        assert [r["held_out_loss"] for r in rows] == pytest.approx(losses, rel=1e-6)
        assert [r["chosen"] for r in rows] == [k == int(np.argmin(losses)) for k in range(4)]
        # A weight may leave as the penalty falls, but the fit of the training rows only gets closer.
        assert [r["n_active"] for r in rows] == [int(np.count_nonzero(r["weights"][:-1])) for r in rows]
        assert [r["train_loss"] for r in rows] == sorted((r["train_loss"] for r in rows), reverse=True)
    ended = elastic_net_path(df.withColumn("y", F.rand(1)), names, "y", [10.0 ** -k for k in range(9)], held_out=F.col("e1"), patience=1)
    assert 1 < ended.count() < 9
    assert elastic_net_path(df.limit(0), names, "y", penalties).count() == 0
    with pytest.raises(ValueError, match="l1_ratio"):
        elastic_net_path(df, names, "y", penalties, 0.0)


@pytest.mark.parametrize("delta, ridge", [(1.0, 0.0), (0.05, 0.0), (0.3, 0.1)])
def test_huber_newton_finds_the_minimum_in_few_passes(spark, delta, ridge):
    x, y = sample(seed=4, n=500, p=3)
    y[:40] += 500.0
    df, names = frame(spark, x, y)
    model, history = fit_huber_newton(df, names, "y", delta, ridge)
    m = model.first()
    w = np.array(m["weights"])
    z = np.column_stack([x, np.ones(500)])
    gradient = np.clip(z @ w - y, -delta, delta) @ z / 500 + ridge * np.append(w[:-1], 0)
    assert m["converged"] and np.abs(gradient).max() < 1e-9 and m["data_passes"] == m["final_iteration"] + 1
    losses = [r["loss"] for r in history.orderBy("iteration").collect()]
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:]))
    if not ridge:
        slow = fit_by_passes(df, names, "y", loss="huber", delta=delta, max_iter=200, tolerance=1e-7)[0].first()
        assert m["final_loss"] <= slow["final_loss"] + 1e-9 and m["data_passes"] < slow["data_passes"]


def test_huber_newton_on_unusable_tables(spark):
    df, names = frame(spark, *sample(n=20, p=2))
    with pytest.raises(ValueError, match="no rows"):
        fit_huber_newton(df.limit(0), names, "y")
    unknown = fit_huber_newton(df.withColumn("x0", F.lit(None).cast("double")), names, "y")[0].first()
    assert not unknown["converged"] and unknown["reason"].startswith("NaN")
    copies = fit_huber_newton(df.withColumn("x1", F.col("x0")), names, "y", delta=0.1)[0].first()  # singular curvature
    assert copies["converged"]
