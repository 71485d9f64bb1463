"""Trainers against closed forms, brute force, and each other."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slopeworks.operators import gram as G
from slopeworks.operators import losses as L
from slopeworks.plans import config as C
from slopeworks.plans import sgd as S
from slopeworks.plans import stored_sgd as B
from slopeworks.plans.passes import evaluate_points, fit_by_passes
from slopeworks.plans.steps import minimise, schedule, stop_reason
from slopeworks.plans.train import fit, history_of, library_baseline


def line_frame(n=50, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    return pd.DataFrame({"id": range(n), "x1": x[:, 0], "x2": x[:, 1], "y": 3 + 2 * x[:, 0] - x[:, 1]})


@pytest.fixture(scope="module")
def lin2(spark):
    return spark.createDataFrame(line_frame()).persist()


def zz_of(frame, features=("x1", "x2"), label="y"):
    z = np.column_stack([frame[list(features)].to_numpy(), np.ones(len(frame)), frame[label]])
    return z.T @ z


def run(frame, **options):
    s = {f: getattr(C.Setup(), f) for f in C.Setup.__dataclass_fields__} | {"check_every": 1, "tolerance": 1e-9, "max_iter": 3000} | options
    return minimise(zz_of(frame), s)


@pytest.mark.parametrize("options", [
    {"method": "gd", "learning_rate": 0.5}, {"method": "gd", "step": "backtracking", "learning_rate": 2.0}, {"method": "gd", "step": "wolfe", "learning_rate": 2.0},
    {"method": "momentum", "learning_rate": 0.1}, {"method": "nesterov", "learning_rate": 0.1}, {"method": "newton"},
    {"method": "damped_newton", "learning_rate": 0.7}, {"method": "damped_newton", "step": "backtracking", "learning_rate": 1.0}, {"method": "bfgs"},
    {"method": "lbfgs"}, {"method": "lbfgs", "memory": 2}, {"method": "sr1"}, {"method": "cg"}, {"method": "newton_cg"}, {"method": "prox", "learning_rate": 0.5},
    {"method": "adam", "learning_rate": 0.05, "max_iter": 5000}])
def test_every_method_recovers_the_line(options):
    r = run(line_frame(), **options)
    assert np.allclose(r["weights"], [2, -1, 3], atol=1e-4) and r["converged"], r["reason"]


@pytest.mark.parametrize("step", ["constant_step", "constant_length", "square_summable", "diminishing"])
def test_subgradient_keeps_the_lowest_loss(step):
    r = run(line_frame(), method="subgradient", loss="l1", regularization=0.1, step=step, max_iter=750, tolerance=0.0, check_every=10)
    assert r["best_loss"] <= min(h[1] for h in r["history"]) + 1e-15 and r["final_iteration"] == 750


def test_newton_needs_one_step_on_ols_and_ridge():
    for loss, lam in (("ols", 0.0), ("ridge", 0.3)):
        r = run(line_frame(), method="newton", loss=loss, regularization=lam)
        assert r["converged"] and r["final_iteration"] <= 3


def test_lasso_newton_and_proximal_agree():
    frame = line_frame()
    frame["y"] += np.random.default_rng(1).normal(size=len(frame))
    smooth = run(frame, method="damped_newton", step="backtracking", learning_rate=1.0, loss="lasso", regularization=0.2)
    exact = run(frame, method="prox", learning_rate=0.3, regularization=0.2)
    assert np.allclose(smooth["weights"], exact["weights"], atol=1e-3)


def test_line_search_never_increases_the_loss():
    r = run(line_frame(), method="gd", step="backtracking", learning_rate=50.0, max_iter=30)
    assert (np.diff([h[1] for h in r["history"]]) <= 1e-12).all()


def test_diverging_run_stops_with_a_reason():
    r = run(line_frame(10), method="gd", learning_rate=1e10)
    assert r["stopped"] and not r["converged"] and "Inf" in r["reason"]
    assert np.isfinite(r["best_loss"])


def test_null_features_are_reported_not_hidden(spark, lin2):
    broken = lin2.withColumn("x1", F.when(F.col("id") != 3, F.col("x1")))
    for wide in (0, 12):
        stats = G.gram_stats(broken, ["x1", "x2"], "y", wide_features=wide)
        assert not np.isfinite(stats.first()["zz"]).all()
    r = fit(broken, ["x1", "x2"], "y", [C.Setup(check_every=1)]).first()
    assert not r["converged"] and "NaN" in r["reason"]


def test_collinear_features_are_solved_and_flagged(spark):
    frame = line_frame()
    frame["x2"] = 2 * frame["x1"]
    stats = G.gram_stats(spark.createDataFrame(frame), ["x1", "x2"], "y")
    r = G.normal_equations(stats).first()
    assert r["singular"] and np.isfinite(r["weights"]).all()
    c = G.conditioning(stats).first()
    assert not c["positive_definite"]


def test_statistics_are_additive_and_independent_of_partitions(spark, lin2):
    whole = np.array(G.gram_stats(lin2, ["x1", "x2"], "y").first()["zz"])
    for wide in (0, 12):
        parts = [np.array(G.gram_stats(d, ["x1", "x2"], "y", wide_features=wide).first()["zz"]) for d in (lin2.filter("id < 20"), lin2.filter("id >= 20"))]
        assert np.allclose(parts[0] + parts[1], whole)
        assert np.allclose(G.gram_stats(lin2.repartition(7), ["x1", "x2"], "y", wide_features=wide).first()["zz"], whole)


def test_grouped_block_statistics_with_null_and_text_keys(spark, monkeypatch):
    monkeypatch.setattr(G, "FLUSH_CELLS", 1)  # every piece is flushed, as when a task meets very many groups
    frame = line_frame(60)
    frame["g"] = ["a", "b", None] * 20
    frame["h"] = [1, 2] * 30
    df = spark.createDataFrame(frame, "id long, x1 double, x2 double, y double, g string, h int").repartition(3)
    got = {(r["g"], r["h"]): np.array(r["zz"]) for r in G.gram_stats(df, ["x1", "x2"], "y", ["g", "h"], wide_features=0).collect()}
    want = {(r["g"], r["h"]): np.array(r["zz"]) for r in G.gram_stats(df, ["x1", "x2"], "y", ["g", "h"]).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    assert all(np.allclose(got[k], want[k]) for k in got)


def test_small_groups_share_one_matrix_product(spark, monkeypatch):
    monkeypatch.setattr(G, "FLUSH_CELLS", 4 * 9 * 4)  # groups are cut every four rows
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": rng.integers(0, 12, 90).astype(float), "x": rng.normal(size=90), "y": rng.normal(size=90)})
    frame.loc[frame["g"] == 11, "g"] = None
    df = spark.createDataFrame(frame).withColumn("g", F.when(~F.isnan("g"), F.col("g").cast("int"))).repartition(3)

    def refused(block):
        raise AssertionError("a call for one small group")

    def products(block):
        z = np.column_stack([block[:, 0], np.ones(len(block)), block[:, 1]])
        return z[:, :, None] * z[:, None, :]

    rows = G.sum_blocks(df, ["g"], ["x", "y"], refused, 3, products).collect()
    got = {(r["g"], r["i"]): r["v"] for r in rows}
    assert len(rows) == len(got) == 12 * 3
    for g, part in frame.fillna({"g": -1}).groupby("g"):
        z = np.column_stack([part["x"], np.ones(len(part)), part["y"]])
        assert np.allclose([got[None if g < 0 else int(g), i] for i in range(3)], z.T @ z)


@pytest.mark.parametrize("keep_weights", [False, True])
def test_size_of_held_results_is_that_of_their_objects(keep_weights):
    import sys
    from dataclasses import asdict

    from slopeworks.plans.steps import minimise
    from slopeworks.plans.train import held_bytes

    def deep(x):
        inner = [*x, *x.values()] if isinstance(x, dict) else x if isinstance(x, (list, tuple)) else []
        return sys.getsizeof(x) + sum(deep(v) for v in inner)

    rng = np.random.default_rng(5)
    z = np.column_stack([rng.normal(size=(50, 3)), np.ones(50), rng.normal(size=50)])
    setup = asdict(C.Setup(method="gd", learning_rate=1e-3, max_iter=300, check_every=1, tolerance=0.0, keep_weights=keep_weights))
    made = {**setup, **minimise(z.T @ z, setup)}
    assert len(made["history"]) > 100
    assert deep(made) / 2 < held_bytes(made) < deep(made) * 2


def test_weighted_statistics(spark, lin2):
    df = lin2.withColumn("w", F.lit(2.0))
    plain = np.array(G.gram_stats(lin2, ["x1", "x2"], "y").first()["zz"])
    for wide in (0, 12):
        assert np.allclose(G.gram_stats(df, ["x1", "x2"], "y", weight="w", wide_features=wide).first()["zz"], 2 * plain)


def test_polynomial_fit_matches_numpy(spark):
    x = np.linspace(0, 20, 60)
    y = 5 - 0.3 * x + 0.02 * x**2 - 0.001 * x**3 + np.sin(x)
    r = G.poly_fit(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y", 3).first()
    want = np.polyfit(x / r["scale"], y, 3)
    assert np.allclose(r["weights"], [*want[::-1][1:], want[-1]], rtol=1e-6)
    residual = y - np.polyval(want, x / r["scale"])
    assert r["r2"] == pytest.approx(1 - residual.var() / y.var()) and r["rmse"] == pytest.approx(residual.std())


def test_quadratic_change_equals_difference_of_values():
    q = L.Quadratic(zz_of(line_frame()), "elastic_net", 0.3, 0.4)
    w, d = np.array([0.5, -2.0, 1.0]), np.array([1.0, 0.3, -0.7])
    for loss in ("ols", "ridge", "lasso", "l1", "elastic_net"):
        q.loss = loss
        assert q.change(w, d, 0.4) == pytest.approx(q.value(w + 0.4 * d) - q.value(w))
        numeric = [(q.value(w + 1e-6 * e) - q.value(w - 1e-6 * e)) / 2e-6 for e in np.eye(3)]
        assert np.allclose(q.gradient(w), numeric, atol=1e-5)


def test_passes_equal_the_statistic(spark, lin2):
    points = [np.zeros(3), np.array([1.0, -0.5, 2.0])]
    losses, grads = evaluate_points(lin2, ["x1", "x2"], "y", points)
    q = L.Quadratic(zz_of(line_frame()))
    for i, w in enumerate(points):
        assert losses[i] == pytest.approx(q.value(w)) and np.allclose(grads[i], q.gradient(w))
    model, history = fit_by_passes(lin2, ["x1", "x2"], "y", loss="ols", tolerance=1e-8)
    assert np.allclose(model.first()["weights"], [2, -1, 3], atol=1e-5) and history.count() > 1


def test_huber_resists_gross_errors(spark):
    frame = pd.concat([line_frame(), pd.DataFrame({"id": [90, 91, 92], "x1": [0.1, 0.2, 0.3], "x2": [0.0, 0.1, 0.2], "y": [500.0, -400.0, 900.0]})])
    df = spark.createDataFrame(frame)
    robust = fit_by_passes(df, ["x1", "x2"], "y", loss="huber", delta=1.0, max_iter=60)[0].first()["weights"]
    plain = G.normal_equations(G.gram_stats(df, ["x1", "x2"], "y")).first()["weights"]
    assert np.allclose(robust, [2, -1, 3], atol=0.3) and not np.allclose(plain, [2, -1, 3], atol=0.3)


def brute_sgd(frame, s, order):
    x, y = np.column_stack([frame[["x1", "x2"]], np.ones(len(frame))])[order], frame["y"].to_numpy()[order]
    w, v = np.zeros(3), np.zeros(3)
    for e in range(s.epochs):
        for i in range(0, len(y), s.batch_size):
            xs, ys = x[i:i + s.batch_size], y[i:i + s.batch_size]
            g = xs.T @ (xs @ w - ys) / len(ys)
            g[:2] += s.regularization * (w[:2] if s.loss == "ridge" else np.sign(w[:2]) if s.loss == "l1" else 0)
            v = s.momentum * v + g
            w = w - (s.step_length * v / np.linalg.norm(v) if s.step_length else S.epoch_rate(s, e) * v)
    return w


@pytest.mark.parametrize("options, mode", [
    ({}, "exact"), ({"momentum": 0.6, "loss": "ridge", "regularization": 0.2, "schedule": "sqrt"}, "exact"), ({}, "averaged"),
    ({"step_length": 0.05, "momentum": 0.3}, "averaged"), ({"loss": "l1", "regularization": 0.1}, "averaged")])
def test_sgd_equals_the_plain_loop(spark, lin2, options, mode):
    s = S.SgdSetup(**{"batch_size": 8, "epochs": 4, "learning_rate": 0.05, "order": "once", "tolerance": 0.0, **options})
    model, history = S.fit_sgd(lin2, ["x1", "x2"], "y", "id", s, mode=mode, hashed=F.col("id") * 7 % 50, chunk_rows=16, blocks=1)  # one block is the plain loop
    order = sorted(range(50), key=lambda i: (i * 7 % 50, i))
    assert np.allclose(model.first()["last_weights"], brute_sgd(line_frame(), s, order)) and history.count() == 4


def test_epoch_maps_compose_over_levels(spark, lin2):
    s = S.SgdSetup(batch_size=2, learning_rate=0.05)
    args = (lin2, ["x1", "x2"], "y", "id", s, 0, [0.05], 50, F.col("id") * 7 % 50)
    one = S.epoch_maps(*args).first()["m"]
    many = S.epoch_maps(*args, chunk_rows=4, fan_in=2).first()["m"]
    assert np.allclose(one, many)


@pytest.mark.parametrize("order", ["each_epoch", "bootstrap"])
def test_sgd_orders_converge(spark, lin2, order):
    s = S.SgdSetup(batch_size=8, epochs=12, learning_rate=0.2, order=order, tolerance=0.0)
    model, _ = S.fit_sgd(lin2, ["x1", "x2"], "y", "id", s)
    assert np.allclose(model.first()["weights"], [2, -1, 3], atol=0.05)


def test_averaged_sgd_converges(spark, lin2):
    s = S.SgdSetup(batch_size=4, epochs=15, learning_rate=0.1, tolerance=0.0)
    model, _ = S.fit_sgd(lin2.repartition(3), ["x1", "x2"], "y", "id", s, mode="averaged")
    assert np.allclose(model.first()["weights"], [2, -1, 3], atol=0.05)


def test_sgd_guards(spark, lin2):
    with pytest.raises(ValueError, match="averaged"):
        S.fit_sgd(lin2, ["x1"], "y", "id", S.SgdSetup(step_length=0.1))
    with pytest.raises(ValueError, match="unknown mode"):
        S.fit_sgd(lin2, ["x1"], "y", "id", S.SgdSetup(step_length=0.1), mode="sequential")


@pytest.mark.parametrize("order", ["each_epoch", "bootstrap"])
def test_averaged_sgd_does_not_depend_on_partitions(spark, lin2, order):
    s = S.SgdSetup(batch_size=4, epochs=3, learning_rate=0.1, order=order, tolerance=0.0, loss="l1", regularization=0.01)
    results = [S.fit_sgd(lin2.repartition(k), ["x1", "x2"], "y", "id", s, mode="averaged", blocks=4)[0].first()["last_weights"] for k in (1, 8)]
    assert np.allclose(*results, atol=1e-12)


@pytest.mark.parametrize("options", [{"step_length": 0.05, "momentum": 0.3}, {"loss": "l1", "regularization": 0.1}])
def test_blocks_of_averaged_sgd_are_plain_loops(spark, lin2, options):
    s = S.SgdSetup(batch_size=8, epochs=1, learning_rate=0.05, order="once", tolerance=0.0, **options)
    fit = lambda df: S.fit_sgd(df, ["x1", "x2"], "y", "id", s, mode="averaged", hashed=F.col("id") * 7 % 50, blocks=8)[0].first()["last_weights"]
    block = dict(lin2.select("id", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(8)).alias("b")).collect())
    means = np.zeros(3)
    for b in sorted(set(block.values())):
        ids = [i for i in sorted(range(50), key=lambda i: (i * 7 % 50, i)) if block[i] == b]
        means += len(ids) * brute_sgd(line_frame(), s, ids)
    assert len(set(block.values())) > 1 and np.allclose(fit(lin2), means / 50)


def test_blocks_of_averaged_sgd_do_not_follow_the_size(spark):
    s = S.SgdSetup(batch_size=5000, epochs=1, step_length=0.05, order="once", tolerance=0.0)
    df = spark.range(60_000).select("id", (F.col("id") % 7 / 3.0 - 1).alias("x"), (F.col("id") % 11 / 5.0).alias("y"))
    fit = lambda **more: S.fit_sgd(df, ["x"], "y", "id", s, mode="averaged", **more)[0].first()["last_weights"]
    assert np.allclose(fit(), fit(blocks=1), atol=1e-12)


def test_averaged_queries_have_blocks_at_test_size(spark):
    from workload import learn

    sf = "/root/testdata/sf0.001"
    for run, setup in ((learn.sgd_fixed_length_averaged, {"order": "once", "step_length": 0.01}), (learn.sgd_averaged, {"loss": "l1", "regularization": 0.001})):
        row = run(spark, sf).first()
        assert row["mode"] == "averaged"
        assert np.allclose(row["weights"], learn._sgd_model(spark, sf, "averaged", blocks=8, **setup).first()["weights"], atol=1e-9)
        assert not np.allclose(row["weights"], learn._sgd_model(spark, sf, "averaged", blocks=1, **setup).first()["weights"], atol=1e-9)


def test_a_block_of_averaged_sgd_comes_in_many_pieces(spark, lin2):
    s = S.SgdSetup(batch_size=8, epochs=2, learning_rate=0.05, tolerance=0.0, loss="l1", regularization=0.01)
    fit = lambda: S.fit_sgd(lin2, ["x1", "x2"], "y", "id", s, mode="averaged", blocks=3)[0].first()["last_weights"]
    whole = fit()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert np.allclose(fit(), whole, atol=1e-12)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_large_batches_are_summed_before_they_become_maps(spark, lin2):
    s = S.SgdSetup(batch_size=20, learning_rate=0.05)
    args = (lin2, ["x1", "x2"], "y", "id", s, 0, [0.05], 50, F.col("id") * 7 % 50)
    assert np.allclose(S.epoch_maps(*args).first()["m"], S.epoch_maps(*args, chunk_rows=10).first()["m"])


def test_order_may_be_a_function_of_the_epoch(spark, lin2):
    s = S.SgdSetup(batch_size=8, epochs=3, learning_rate=0.05, tolerance=0.0)
    fit = lambda hashed: S.fit_sgd(lin2, ["x1", "x2"], "y", "id", s, hashed=hashed)[0].first()["last_weights"]
    assert not np.allclose(fit(lambda e: F.col("id") * (7 + 2 * e) % 50), fit(F.col("id") * 7 % 50), atol=1e-9)


def test_poisson_weights_have_mean_and_variance_one(spark):
    u = F.pmod(F.xxhash64("id"), F.lit(2**31)) / float(2**31)
    r = spark.range(20000).select(S.poisson_weight(u).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert r[0] == pytest.approx(1, abs=0.05) and r[1] == pytest.approx(1, abs=0.08)


def test_sgd_schedules():
    s = dict(learning_rate=1.0, epochs=100)
    assert S.epoch_rate(S.SgdSetup(schedule="linear", **s), 100) == 0.01
    assert S.epoch_rate(S.SgdSetup(schedule="sqrt", **s), 3) == 0.5
    assert S.epoch_rate(S.SgdSetup(schedule="step_down", **s), 25) == pytest.approx(0.81)
    with pytest.raises(ValueError):
        S.epoch_rate(S.SgdSetup(schedule="magic"), 0)


def test_step_schedules():
    assert schedule("linear", 1.0, 10_000, total=100) == pytest.approx(0.01)
    assert schedule("staircase", 1.0, 250, 0.5, 100.0) == 0.25
    with pytest.raises(ValueError):
        schedule("magic", 1.0, 0)


@pytest.mark.parametrize("g, loss, w, word", [
    (float("nan"), 1.0, [0.1], "NaN in gradient"), (float("inf"), 1.0, [0.1], "Inf in gradient"), (0.1, float("nan"), [0.1], "NaN in loss"),
    (0.1, float("inf"), [0.1], "Inf in loss"), (0.1, 1.0, [float("nan")], "weights"), (0.1, 1.0, [float("inf")], "weights")])
def test_stop_on_numerical_trouble(g, loss, w, word):
    stopped, converged, reason = stop_reason(g, loss, 0.1, 5, 1e-5, 100, np.array(w))
    assert stopped and not converged and word in reason


def test_stop_rules():
    assert stop_reason(1e-9, 1.0, 1e-9, 5, 1e-5, 100)[:2] == (True, True)
    assert stop_reason(1e-9, 1.0, 1e-9, 0, 1e-5, 100)[0] is False
    assert stop_reason(1e-9, 1.0, 1.0, 5, 1e-5, 100)[0] is False
    assert stop_reason(1.0, 1.0, 1.0, 100, 1e-5, 100)[:2] == (True, False)


def test_sweep_of_groups_and_setups(spark, lin2):
    df = lin2.withColumn("g", F.col("id") % 3)
    setups = C.grid(spark, method=["gd", "newton"], learning_rate=[0.3], check_every=[1], tolerance=[1e-9])
    runs = fit(df, ["x1", "x2"], "y", setups, ["g"]).persist()
    assert runs.count() == 6 and runs.filter("converged").count() == 6 and runs.select("run_id").distinct().count() == 6
    h = history_of(runs, ["g"])
    assert h.groupBy("run_id").agg(F.max("iteration").alias("m")).join(runs, "run_id").filter("m <> final_iteration").count() == 0
    runs.unpersist()


def test_random_search_is_seeded_and_in_range(spark):
    a = C.random_search(spark, 30, learning_rate=(0.01, 0.1)).toPandas()
    assert a["learning_rate"].between(0.01, 0.1).all() and a["learning_rate"].nunique() == 30
    assert a.equals(C.random_search(spark, 30, learning_rate=(0.01, 0.1)).toPandas())


def test_library_baseline_agrees(spark, lin2):
    got = {r["feature"]: r["weight"] for r in library_baseline(lin2, ["x1", "x2"], "y").collect()}
    assert np.allclose([got["x1"], got["x2"], got["bias"]], [2, -1, 3], atol=1e-6)


def _stored_order(n, block_rows, s, epoch, batch):
    """(rows, weights) of each batch of an epoch, from the definition of the order."""
    hashes = {b: int(B.order_hash_numbers(np.array([b]), s.seed + epoch)[0]) if s.order != "once" else b for b in range(-(-n // block_rows))}
    for block in sorted(hashes, key=hashes.get):
        places = list(range(min(block_rows, n - block * block_rows)))
        if s.order != "once":
            places.sort(key=lambda i: B.order_hash_numbers(np.array([i]), hashes[block])[0])
        rows = [block * block_rows + i for i in places]
        u = [B.order_hash_numbers(np.array([r]), hashes[block] + 1)[0] / 2**32 for r in rows]
        weight = S.poisson_numbers(np.array(u)) if s.order == "bootstrap" else np.ones(len(rows))
        yield from ((rows[i:i + batch], weight[i:i + batch]) for i in range(0, len(rows), batch))


def _stored_loop(frame, s, block_rows, key_order):
    x, y = np.column_stack([frame[["x1", "x2"]], np.ones(len(frame))])[key_order], frame["y"].to_numpy()[key_order]
    w, v = np.zeros(3), np.zeros(3)
    for e in range(s.epochs):
        for rows, weight in _stored_order(len(y), block_rows, s, e, s.batch_size):
            if weight.sum() > 0:
                w, v = S.update(w, v, S.batch_gradient(x[rows], y[rows], weight, w, s), s, S.epoch_rate(s, e))
    return w


@pytest.mark.parametrize("options, mode", [
    ({"order": "once"}, "exact"), ({"momentum": 0.6, "loss": "ridge", "regularization": 0.2, "schedule": "sqrt"}, "exact"),
    ({"order": "bootstrap"}, "exact"), ({"order": "once", "schedule": "linear"}, "exact"), ({}, "sequential"),
    ({"step_length": 0.05, "momentum": 0.3, "order": "once"}, "sequential"), ({"step_length": 0.05}, "sequential"),
    ({"loss": "l1", "regularization": 0.1}, "sequential"), ({"loss": "l1", "regularization": 0.1, "order": "bootstrap"}, "sequential")])
def test_stored_sgd_equals_the_plain_loop(spark, lin2, tmp_path, monkeypatch, options, mode):
    monkeypatch.setattr(B, "FAN_IN", 2)
    s = S.SgdSetup(**{"batch_size": 4, "epochs": 4, "learning_rate": 0.05, "tolerance": 0.0, **options})
    stored = B.store_blocks(lin2, ["x1", "x2"], "y", "id", str(tmp_path / "b"), hashed=F.col("id") * 7 % 50, block_rows=8)
    want = _stored_loop(line_frame(), s, 8, sorted(range(50), key=lambda i: (i * 7 % 50, i)))
    got = [B.fit_stored(spark, stored, s, mode, chunks=c) for c in ((1, 3, 8) if mode == "sequential" else (1,))]
    for model, history in got:
        assert np.allclose(model.first()["last_weights"], want, atol=1e-9) and history.count() == 4
    if mode == "sequential":
        rounds = [[r["rounds"] for r in h.orderBy("epoch").collect()] for _, h in got]
        assert rounds[0] == [1] * 4 and max(rounds[1]) <= 3 and max(rounds[2]) <= 8


def test_order_hash_is_one_function_in_spark_and_tasks(spark):
    numbers = [0, 1, 2, 4095, 2**31 - 1]
    rows = spark.createDataFrame([(n,) for n in numbers], "v long").select(*[B.order_hash(F.col("v"), seed) for seed in (0, 42, 2**32 - 1)]).collect()
    for j, seed in enumerate((0, 42, 2**32 - 1)):
        assert [r[j] for r in rows] == B.order_hash_numbers(np.array(numbers), seed).tolist()
    assert len(set(B.order_hash_numbers(np.arange(100_000), 7).tolist())) == 100_000


def test_stored_epochs_shuffle_no_rows_and_guard(spark, lin2, tmp_path):
    stored = B.store_blocks(lin2, ["x1", "x2"], "y", "id", str(tmp_path / "b"), block_rows=8)
    assert "Exchange" not in B._placed(spark, stored, S.SgdSetup(), 3, 4)._jdf.queryExecution().toString()
    assert stored.read(spark).count() == 7 and stored.n_blocks == 7
    with pytest.raises(ValueError, match="multiple"):
        B.fit_stored(spark, stored, S.SgdSetup(batch_size=3))
    with pytest.raises(ValueError, match="sequential"):
        B.fit_stored(spark, stored, S.SgdSetup(batch_size=4, step_length=0.1))
    with pytest.raises(ValueError, match="no rows"):
        B.store_blocks(lin2.limit(0), ["x1", "x2"], "y", "id", str(tmp_path / "e"))


def test_sequential_sgd_that_diverges_stops_with_a_reason(spark, lin2, tmp_path):
    stored = B.store_blocks(lin2, ["x1", "x2"], "y", "id", str(tmp_path / "b"), block_rows=8)
    model, _ = B.fit_stored(spark, stored, S.SgdSetup(batch_size=4, learning_rate=1e60, loss="l1", regularization=0.1), "sequential", chunks=3)
    row = model.first()
    assert not row["converged"] and row["reason"] != "epoch limit"


def test_exact_stored_sgd_that_diverges_stops_with_a_reason(spark, lin2, tmp_path):
    stored = B.store_blocks(lin2, ["x1", "x2"], "y", "id", str(tmp_path / "b"), block_rows=8)
    model, _ = B.fit_stored(spark, stored, S.SgdSetup(batch_size=4, learning_rate=1e60))
    assert not model.first()["converged"] and model.first()["reason"] != "epoch limit"
