"""Trainers over whole tables (K), each against the same iteration in recursive SQL or the closed form."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from slopeworks.operators.losses import gradient_at
from slopeworks.operators.ranking import multiplicative_hash
from slopeworks.plans import config as C
from slopeworks.plans.coordinate import elastic_net_path
from slopeworks.plans.passes import fit_by_passes, fit_huber_newton
from slopeworks.plans.sgd import SgdSetup, fit_sgd
from slopeworks.plans.stored_sgd import fit_stored, store_blocks
from slopeworks.plans.train import fit, history_of, library_baseline
from slopeworks.session import shared_folder
from workload.registry import query, rounded, table

# One feature from the part number, log price as the label.
_PARTS = "SELECT p_partkey, (p_partkey % 1000) / 500.0::DOUBLE - 1 AS x, ln(1 + p_retailprice) AS y FROM part"
_SUMS = f"s AS (SELECT avg(x * x) AS a, avg(x) AS m, avg(x * y) AS c, avg(y) AS k, avg(y * y) AS q FROM ({_PARTS}))"


def parts(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", ((F.col("p_partkey") % 1000) / 500.0 - 1).alias("x"), F.log1p("p_retailprice").alias("y"))


def _iteration_sql(update: str, steps: int, every: int, state: str = "", penalty: str = "0", slope: str = "0") -> str:
    """History of (w, b) under a recursive update. `g1`, `g2` are the gradient parts; `state` lists further columns at 0."""
    extra = [n for n in state.split() if n]
    cols = "".join(f", {n}" for n in extra)
    return f"""
WITH RECURSIVE {_SUMS},
r(t, w, b{cols}) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE{"".join(", 0.0::DOUBLE" for _ in extra)}
  UNION ALL
  SELECT t + 1, {update} FROM (SELECT r.*, s.*, a * w + m * b - c + {slope} AS g1, m * w + b - k AS g2 FROM r, s) WHERE t < {steps}),
h AS (SELECT t, w, b, 0.5 * (a * w * w + 2 * m * w * b + b * b - 2 * (c * w + k * b) + q) + {penalty} AS loss, a * w + m * b - c + {slope} AS g1, m * w + b - k AS g2 FROM r, s)
SELECT t::INTEGER AS iteration, round(loss, 7) + 0.0 AS loss, round(sqrt(g1 * g1 + g2 * g2), 7) AS gradient_norm, round(w, 7) + 0.0 AS w, round(b, 7) + 0.0 AS b
FROM h WHERE t % {every} = 0 OR t = {steps}"""


def _history(spark, sf, every=5, steps=40, **setup):
    s = C.Setup(max_iter=steps, check_every=every, tolerance=0.0, keep_weights=True, **setup)
    h = history_of(fit(parts(spark, sf), ["x"], "y", [s]))
    out = h.select("iteration", "loss", "gradient_norm", F.col("weights")[0].alias("w"), F.col("weights")[1].alias("b"))
    return rounded(out, 7, "loss", "gradient_norm", "w", "b")


_RATES = {
    "constant": "0.3", "inverse": "0.3 / (t + 1)", "inverse_sqrt": "0.3 / sqrt(t + 1)", "exponential": "0.3 * 0.95 ** t",
    "linear": "0.3 * (1 - least(t / 40.0::DOUBLE, 0.99))", "staircase": "0.3 * 0.95 ** floor(t / 10)", "smooth_exponential": "0.3 * 0.95 ** (t / 10.0::DOUBLE)"}

for _rule, _rate in _RATES.items():
    @query(f"train_gd_{_rule}", _iteration_sql(f"w - {_rate} * g1, b - {_rate} * g2", 40, 5))
    def gd(spark, sf, rule=_rule):
        return _history(spark, sf, method="gd", step=rule, learning_rate=0.3, decay_steps=10.0)

_PENALTIES = {"ridge": ("0.05 * w * w", "0.1 * w"), "lasso": ("0.1 * sqrt(w * w + 1e-8)", "0.1 * w / sqrt(w * w + 1e-8)"),
              "elastic_net": ("0.1 * (0.5 * abs(w) + 0.25 * w * w)", "0.1 * (0.5 * sign(w) + 0.5 * w)")}
for _loss, (_pen, _slope) in _PENALTIES.items():
    @query(f"train_gd_{_loss}", _iteration_sql("w - 0.001 * g1, b - 0.001 * g2", 40, 5, penalty=_pen, slope=_slope))
    def penalised(spark, sf, loss=_loss):
        return _history(spark, sf, method="gd", loss=loss, regularization=0.1, learning_rate=0.001)

# On a quadratic, a trial step s along -g meets Armijo when s * g'Hg <= 2 (1 - c1) g'g.
_GHG = "(a * g1 * g1 + 2 * m * g1 * g2 + g2 * g2)"
_GG = "(g1 * g1 + g2 * g2)"
_ARMIJO = f"4.0::DOUBLE * 0.5 ** greatest(0, ceil(ln(1.98 * {_GG} / {_GHG} / 4) / ln(0.5::DOUBLE)))"
# The strong curvature condition adds s * g'Hg <= 1.9 g'g; its lower bound 0.1 holds for the first halving that fits.
_WOLFE = _ARMIJO.replace("1.98", "1.9")
for _rule, _step in (("backtracking", _ARMIJO), ("wolfe", _WOLFE)):
    @query(f"train_gd_{_rule}", _iteration_sql(f"w - {_step} * g1, b - {_step} * g2", 12, 3))
    def searched(spark, sf, rule=_rule):
        return _history(spark, sf, every=3, steps=12, method="gd", step=rule, learning_rate=4.0, c1=0.01, rho=0.5)


@query("train_momentum", _iteration_sql(
    "w - 0.05 * (0.9 * v1 + g1), b - 0.05 * (0.9 * v2 + g2), 0.9 * v1 + g1, 0.9 * v2 + g2", 40, 5, state="v1 v2"))
def momentum(spark, sf):
    return _history(spark, sf, method="momentum", learning_rate=0.05, momentum=0.9)


_N1, _N2 = ("(a * (w - 0.045 * v1) + m * (b - 0.045 * v2) - c)", "(m * (w - 0.045 * v1) + (b - 0.045 * v2) - k)")
_CUT = f"greatest(1.0, sqrt({_N1} * {_N1} + {_N2} * {_N2}) / 10)"


@query("train_nesterov", _iteration_sql(
    f"w - 0.05 * (0.9 * v1 + {_N1} / {_CUT}), b - 0.05 * (0.9 * v2 + {_N2} / {_CUT}), 0.9 * v1 + {_N1} / {_CUT}, 0.9 * v2 + {_N2} / {_CUT}", 40, 5, state="v1 v2"))
def nesterov(spark, sf):
    return _history(spark, sf, method="nesterov", learning_rate=0.05, momentum=0.9)


_AW, _AB = ("(0.9 * m1 + 0.1 * g1) / (1 - 0.9::DOUBLE ** (t + 1)) / (sqrt((0.999 * u1 + 0.001 * g1 * g1) / (1 - 0.999::DOUBLE ** (t + 1))) + 1e-8)",
            "(0.9 * m2 + 0.1 * g2) / (1 - 0.9::DOUBLE ** (t + 1)) / (sqrt((0.999 * u2 + 0.001 * g2 * g2) / (1 - 0.999::DOUBLE ** (t + 1))) + 1e-8)")


@query("train_adam", _iteration_sql(
    f"w - 0.2 * {_AW}, b - 0.2 * {_AB}, 0.9 * m1 + 0.1 * g1, 0.9 * m2 + 0.1 * g2, 0.999 * u1 + 0.001 * g1 * g1, 0.999 * u2 + 0.001 * g2 * g2",
    40, 5, state="m1 m2 u1 u2"))
def adam(spark, sf):
    return _history(spark, sf, method="adam", learning_rate=0.2)


_SUB = {"constant_step": "0.02", "constant_length": f"0.04 / sqrt({_GG})", "square_summable": "1.0::DOUBLE / (t + 1)", "diminishing": "1.0::DOUBLE / sqrt(t + 1)"}
for _rule, _step in _SUB.items():
    @query(f"train_subgradient_{_rule}", _iteration_sql(
        f"w - {_step} * g1, b - {_step} * g2", 40, 5, penalty="0.01 * abs(w)", slope="0.01 * sign(w)"))
    def subgradient(spark, sf, rule=_rule):
        return _history(spark, sf, method="subgradient", loss="l1", regularization=0.01, step=rule)


_BEST = "regr_slope(y, x) AS w, regr_intercept(y, x) AS b"
_CLOSED = {
    "ols": f"SELECT {_BEST} FROM ({_PARTS})",
    "ridge": f"SELECT w, k - w * m AS b FROM (SELECT (c - m * k) / (a - m * m + 0.1) AS w, k, m FROM s)",
    "l1": f"SELECT w, k - w * m AS b FROM (SELECT sign(c - m * k) * greatest(abs(c - m * k) - 0.01, 0) / (a - m * m) AS w, k, m FROM s)",
}


def _closed_sql(loss: str, converged: str = "true") -> str:
    return f"WITH {_SUMS} SELECT round(w, 5) + 0.0 AS w, round(b, 5) + 0.0 AS b, {converged} AS converged FROM ({_CLOSED[loss]})"


def _final(spark, sf, **setup):
    s = C.Setup(**{"check_every": 1, "max_iter": 500, "tolerance": 1e-9, **setup})
    runs = fit(parts(spark, sf), ["x"], "y", [s])
    return rounded(runs.select(F.col("weights")[0].alias("w"), F.col("weights")[1].alias("b"), "converged"), 5, "w", "b")


_CONVERGENT = {
    "newton": {"method": "newton"}, "newton_ridge": {"method": "newton", "loss": "ridge", "regularization": 0.1},
    "damped_newton": {"method": "damped_newton", "learning_rate": 0.5}, "damped_newton_search": {"method": "damped_newton", "step": "backtracking", "learning_rate": 1.0},
    "bfgs": {"method": "bfgs"}, "bfgs_ridge": {"method": "bfgs", "loss": "ridge", "regularization": 0.1}, "lbfgs": {"method": "lbfgs", "memory": 5},
    "lbfgs_ridge": {"method": "lbfgs", "loss": "ridge", "regularization": 0.1}, "sr1": {"method": "sr1"}, "conjugate_gradient": {"method": "cg"},
    "newton_cg": {"method": "newton_cg"}, "newton_cg_ridge": {"method": "newton_cg", "loss": "ridge", "regularization": 0.1},
    "proximal_l1": {"method": "prox", "learning_rate": 0.5, "regularization": 0.01},
}
for _name, _setup in _CONVERGENT.items():
    @query(f"train_{_name}", _closed_sql("l1" if _setup["method"] == "prox" else _setup.get("loss", "ols")))
    def convergent(spark, sf, setup=_setup):
        return _final(spark, sf, **setup)


@query("train_by_group", """
SELECT l_suppkey, setup, round(regr_slope(y, x), 5) + 0.0 AS w, round(regr_intercept(y, x), 5) + 0.0 AS b, true AS converged
FROM (SELECT l_suppkey, l_quantity / 25.0::DOUBLE - 1 AS x, ln(1 + l_extendedprice) AS y FROM lineitem), (VALUES ('newton'), ('lbfgs'), ('momentum')) AS v(setup)
GROUP BY 1, 2""")
def by_group(spark, sf):
    """One model per supplier and setup, all trained in parallel from one statistics pass."""
    df = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_quantity") / 25.0 - 1).alias("x"), F.log1p("l_extendedprice").alias("y"))
    setups = [C.Setup(setup="newton", method="newton", check_every=1, tolerance=1e-9), C.Setup(setup="lbfgs", method="lbfgs", check_every=1, tolerance=1e-9),
              C.Setup(setup="momentum", method="momentum", learning_rate=0.1, check_every=10, tolerance=1e-9)]
    runs = fit(df, ["x"], "y", setups, ["l_suppkey"])
    return rounded(runs.select("l_suppkey", "setup", F.col("weights")[0].alias("w"), F.col("weights")[1].alias("b"), "converged"), 5, "w", "b")


@query("train_diverging", """SELECT count(*) > 0 AS stopped, false AS converged, true AS overflow FROM part""")
def diverging(spark, sf):
    """A hopeless learning rate must end as a stopped, unconverged run, not as an error."""
    runs = fit(parts(spark, sf), ["x"], "y", [C.Setup(method="gd", learning_rate=1e10, check_every=1, tolerance=1e-9)])
    return runs.select("stopped", "converged", F.col("reason").startswith("Inf").alias("overflow"))


_H = "((p_partkey + 42) % 2147483648 * 2654435761) % 4294967296"


def _sgd_sql(lr: str, momentum: float, epochs: int, lam: float = 0.0) -> str:
    return f"""
WITH RECURSIVE z AS (SELECT x, y, floor((row_number() OVER (ORDER BY {_H}, p_partkey) - 1) / 64)::BIGINT AS k FROM ({_PARTS})),
bt AS MATERIALIZED (SELECT k, avg(x * x) AS a, avg(x) AS m, avg(x * y) AS c, avg(y) AS d FROM z GROUP BY k),
nb AS (SELECT count(*) AS n FROM bt),
r(t, w, b, v1, v2) AS (
  SELECT 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT t + 1, w - {lr} * ({momentum} * v1 + g1), b - {lr} * ({momentum} * v2 + g2), {momentum} * v1 + g1, {momentum} * v2 + g2
  FROM (SELECT r.*, floor(t / n)::BIGINT AS e, a * w + m * b - c + {lam} * w AS g1, m * w + b - d AS g2 FROM r, nb, bt WHERE bt.k = r.t % nb.n AND r.t < nb.n * {epochs}))
SELECT e::INTEGER AS epoch, round(w, 7) + 0.0 AS w, round(b, 7) + 0.0 AS b FROM (SELECT t / n AS e, w, b FROM r, nb WHERE t = nb.n * {epochs})"""


def _sgd(spark, sf, **setup):
    s = SgdSetup(batch_size=64, order="once", tolerance=0.0, **setup)
    model, _ = fit_sgd(parts(spark, sf), ["x"], "y", "p_partkey", s, mode="exact", hashed=multiplicative_hash("p_partkey", 42), chunk_rows=256)
    out = model.select(F.col("final_epoch").alias("epoch"), F.col("last_weights")[0].alias("w"), F.col("last_weights")[1].alias("b"))
    return rounded(out, 7, "w", "b")


@query("train_sgd_constant", _sgd_sql("0.05", 0.0, 3))
def sgd_constant(spark, sf):
    """Three epochs by composed maps equal the batch-by-batch recursion."""
    return _sgd(spark, sf, learning_rate=0.05, epochs=3)


@query("train_sgd_momentum_ridge", _sgd_sql("0.02", 0.5, 2, 0.1))
def sgd_momentum(spark, sf):
    return _sgd(spark, sf, learning_rate=0.02, momentum=0.5, epochs=2, loss="ridge", regularization=0.1)


_SGD_RATES = {"linear": "0.05 * greatest(1 - e / 3.0::DOUBLE, 0.01)", "exponential": "0.05 * 0.95 ** (e / 10.0::DOUBLE)", "sqrt": "0.05 / sqrt(e + 1)",
              "step_down": "0.05 * 0.9 ** floor(e / 10)"}
for _rule, _rate in _SGD_RATES.items():
    @query(f"train_sgd_{_rule}", _sgd_sql(_rate, 0.0, 3))
    def sgd_schedule(spark, sf, rule=_rule):
        return _sgd(spark, sf, learning_rate=0.05, epochs=3, schedule=rule)


def _sgd_model(spark, sf, mode, blocks=1, **setup):
    s = SgdSetup(batch_size=64, learning_rate=0.05, epochs=3, **setup)
    model, _ = fit_sgd(parts(spark, sf), ["x"], "y", "p_partkey", s, mode=mode, blocks=blocks)
    return model.select("setup", "mode", "final_epoch", "final_loss", "weights")


@query("train_sgd_reshuffled")
def sgd_reshuffled(spark, sf):
    return _sgd_model(spark, sf, "exact", order="each_epoch")


@query("train_sgd_bootstrap")
def sgd_bootstrap(spark, sf):
    return _sgd_model(spark, sf, "exact", order="bootstrap")


@query("train_sgd_fixed_length_averaged")
def sgd_fixed_length_averaged(spark, sf):
    """The weights of eight blocks, averaged after each epoch: not those of one sequential run."""
    return _sgd_model(spark, sf, "averaged", blocks=8, order="once", step_length=0.01)


@query("train_sgd_averaged")
def sgd_averaged(spark, sf):
    return _sgd_model(spark, sf, "averaged", blocks=8, loss="l1", regularization=0.001)


def _poisson_sql(u: str) -> str:
    """Poisson(1) count of a uniform number."""
    edges, total, term = [], 0.0, math.exp(-1.0)
    for k in range(20):
        total += term
        edges.append(f"WHEN {u} < {total!r} THEN {k}")
        term /= k + 1
    return f"CASE {' '.join(edges)} ELSE 20 END"


def _stored_sql(g: str, update: str, epochs: int = 3, rows: int = 1024, batch: int = 64, order: str = "each_epoch") -> str:
    """Batch by batch over blocks of rows: `g` is the penalty's part of the gradient, `update` gives (w, b) from the gradient g1, g2."""
    def mixed(value: str, seed: str, name: str, source: str) -> str:
        return (f"{name}1 AS (SELECT *, (({value}) % 2147483648 * 2654435761 + ({seed}) * 1000003 % 4294967296) % 4294967296 AS h1 FROM {source}),"
                f" {name}2 AS (SELECT * EXCLUDE (h1), xor(h1, h1 >> 15) * 739982445 % 4294967296 AS h2 FROM {name}1),"
                f" {name} AS (SELECT * EXCLUDE (h2), xor(h2, h2 >> 12) AS {name}_hash FROM {name}2)")

    fixed = order == "once"
    weight = _poisson_sql("draw_hash / 4294967296.0::DOUBLE") if order == "bootstrap" else "1"
    return f"""
WITH RECURSIVE ranked AS (SELECT x, y, row_number() OVER (ORDER BY {_H}, p_partkey) - 1 AS place FROM ({_PARTS})),
base AS (SELECT x, y, e, place, place // {rows} AS block, place % {rows} AS slot FROM ranked, range({epochs}) AS t(e)),
{mixed("block", "42 + e", "outer_", "base")},
{mixed("slot", "outer__hash", "inner_", "outer_")},
{mixed("place", "outer__hash + 1", "draw", "inner_")},
z AS (SELECT x, y, e, {"block" if fixed else "outer__hash"} AS first, (row_number() OVER (PARTITION BY e, block ORDER BY {"slot" if fixed else "inner__hash"}) - 1) // {batch} AS second,
  ({weight})::DOUBLE AS v FROM draw),
bt AS MATERIALIZED (SELECT row_number() OVER (ORDER BY e, first, second) - 1 AS t, e, sum(v * x * x) / sum(v) AS a, sum(v * x) / sum(v) AS m, sum(v * x * y) / sum(v) AS c, sum(v * y) / sum(v) AS d
  FROM z GROUP BY e, first, second HAVING sum(v) > 0),
r(t, w, b) AS (
  SELECT 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT t + 1, {update} FROM (SELECT r.*, bt.e, a * w + m * b - c + {g} AS g1, m * w + b - d AS g2 FROM r JOIN bt USING (t)))
SELECT {epochs}::INTEGER AS epoch, round(w, 7) + 0.0 AS w, round(b, 7) + 0.0 AS b FROM r WHERE t = (SELECT count(*) FROM bt)"""


def _stored(spark, sf, mode, **setup):
    s = SgdSetup(batch_size=64, epochs=3, tolerance=0.0, **{"learning_rate": 0.05, **setup})
    blocks = store_blocks(parts(spark, sf), ["x"], "y", "p_partkey", shared_folder(spark), multiplicative_hash("p_partkey", 42), block_rows=1024)
    model, _ = fit_stored(spark, blocks, s, mode)
    return rounded(model.select(F.col("final_epoch").alias("epoch"), F.col("last_weights")[0].alias("w"), F.col("last_weights")[1].alias("b")), 7, "w", "b")


_PLAIN = "w - 0.05 * g1, b - 0.05 * g2"
_UNIT = "w - 0.01 * g1 / sqrt(g1 * g1 + g2 * g2), b - 0.01 * g2 / sqrt(g1 * g1 + g2 * g2)"


@query("train_sgd_stored_reshuffled", _stored_sql("0.1 * w", _PLAIN))
def sgd_stored_reshuffled(spark, sf):
    """Ridge; blocks and the rows in them in a new order each epoch, no sort of rows."""
    return _stored(spark, sf, "exact", loss="ridge", regularization=0.1)


@query("train_sgd_stored_bootstrap", _stored_sql("0", _PLAIN, order="bootstrap"))
def sgd_stored_bootstrap(spark, sf):
    return _stored(spark, sf, "exact", order="bootstrap")


@query("train_sgd_fixed_length_sequential", _stored_sql("0", _UNIT, order="once"))
def sgd_fixed_length_sequential(spark, sf):
    """Unit-length steps over all batches in order, run in chunks until their starts agree."""
    return _stored(spark, sf, "sequential", order="once", step_length=0.01)


@query("train_sgd_l1_sequential", _stored_sql("0.01 * sign(w)", _PLAIN))
def sgd_l1_sequential(spark, sf):
    """Per-batch L1 signs, reshuffled each epoch."""
    return _stored(spark, sf, "sequential", loss="l1", regularization=0.01)


@query("train_huber_by_passes")
def huber(spark, sf):
    model, _ = fit_by_passes(parts(spark, sf), ["x"], "y", loss="huber", delta=0.01, max_iter=20)
    return model


@query("train_ols_by_passes", f"WITH {_SUMS} SELECT round(w, 4) + 0.0 AS w, round(b, 4) + 0.0 AS b FROM ({_CLOSED['ols']})")
def ols_by_passes(spark, sf):
    model, _ = fit_by_passes(parts(spark, sf), ["x"], "y", loss="ols", max_iter=30, tolerance=1e-8)
    return rounded(model.select(F.col("weights")[0].alias("w"), F.col("weights")[1].alias("b")), 4, "w", "b")


@query("train_library_baseline", f"""
SELECT 'x' AS feature, round(regr_slope(y, x), 6) + 0.0 AS weight FROM ({_PARTS}) UNION ALL SELECT 'bias', round(regr_intercept(y, x), 6) FROM ({_PARTS})""")
def baseline(spark, sf):
    return rounded(library_baseline(parts(spark, sf), ["x"], "y"), 6, "weight")


@query("train_grid_sweep", f"""
WITH {_SUMS}, g AS (SELECT lr, lam FROM (VALUES (0.1::DOUBLE), (0.3)) AS a(lr), (VALUES (0.1::DOUBLE), (0.2), (0.4)) AS b(lam))
SELECT lr AS learning_rate, lam AS regularization, true AS converged, round((c - m * k) / (a - m * m + lam), 5) + 0.0 AS w FROM g, s""")
def grid_sweep(spark, sf):
    """Six ridge setups as rows of one sweep."""
    setups = C.grid(spark, learning_rate=[0.1, 0.3], regularization=[0.1, 0.2, 0.4], method=["gd"], loss=["ridge"], tolerance=[1e-9])
    runs = fit(parts(spark, sf), ["x"], "y", setups)
    return rounded(runs.select("learning_rate", "regularization", "converged", F.col("weights")[0].alias("w")), 5, "w")


@query("train_random_sweep")
def random_sweep(spark, sf):
    setups = C.random_search(spark, 20, fixed={"method": "momentum", "loss": "ridge"}, learning_rate=(0.01, 0.1), regularization=(0.001, 1.0))
    return fit(parts(spark, sf), ["x"], "y", setups).select("setup", "learning_rate", "regularization", "converged", "final_iteration", "best_loss")


# Three features, solved in SQL by Cramer's rule on the covariances (the intercept is never penalised).
_THREE = """SELECT (p_partkey % 7) / 3.0::DOUBLE - 1 AS x1, (p_partkey % 11) / 5.0::DOUBLE - 1 AS x2, p_size / 25.0::DOUBLE - 1 AS x3, ln(1 + p_retailprice) AS y FROM part"""


def _three(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(((key % 7) / 3.0 - 1).alias("x1"), ((key % 11) / 5.0 - 1).alias("x2"), (F.col("p_size") / 25.0 - 1).alias("x3"), F.log1p("p_retailprice").alias("y"))


def _three_sql(penalty: float) -> str:
    s = {(i, j): f"c{min(i, j)}{max(i, j)}" for i in (1, 2, 3) for j in (1, 2, 3)}
    cov = ", ".join(f"covar_pop(x{i}, x{j}){f' + {penalty}' if i == j else ''} AS c{i}{j}" for i in (1, 2, 3) for j in range(i, 4))

    def det(m):
        return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
                f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")

    full = [[s[i, j] for j in (1, 2, 3)] for i in (1, 2, 3)]
    weights = [f"{det([[f'd{i}' if j == k else s[i, j] for j in (1, 2, 3)] for i in (1, 2, 3)])} / {det(full)}" for k in (1, 2, 3)]
    return f"""WITH c AS (SELECT {cov}, covar_pop(x1, y) AS d1, covar_pop(x2, y) AS d2, covar_pop(x3, y) AS d3, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my FROM ({_THREE})),
w AS (SELECT c.*, {', '.join(f'{w} AS w{k + 1}' for k, w in enumerate(weights))} FROM c)
SELECT round(w1, 5) + 0.0 AS w1, round(w2, 5) + 0.0 AS w2, round(w3, 5) + 0.0 AS w3, round(my - w1 * m1 - w2 * m2 - w3 * m3, 5) + 0.0 AS b FROM w"""


def _three_fit(spark, sf, **setup):
    run = fit(_three(spark, sf), ["x1", "x2", "x3"], "y", [C.Setup(max_iter=2000, check_every=1, tolerance=1e-11, **setup)])
    return rounded(run.select(*[F.col("last_weights")[k].alias(f"w{k + 1}") for k in range(3)], F.col("last_weights")[3].alias("b")), 5, "w1", "w2", "w3", "b")


_SECOND = {"newton": {}, "bfgs": {}, "lbfgs": {}, "sr1": {}, "momentum": {"learning_rate": 0.2, "momentum": 0.8}, "cg": {}}
for _method, _more in _SECOND.items():
    @query(f"train_three_features_{_method}", _three_sql(0.0))
    def three(spark, sf, method=_method, more=_more):
        return _three_fit(spark, sf, method=method, **more)

for _method in ("newton", "lbfgs"):
    @query(f"train_three_features_ridge_{_method}", _three_sql(0.1))
    def three_ridge(spark, sf, method=_method):
        return _three_fit(spark, sf, method=method, loss="ridge", regularization=0.1)


_LINES = """SELECT l_returnflag, l_orderkey % 5 = 0 AS held_out, l_quantity / 25.0::DOUBLE - 1 AS x1, (l_quantity % 10) / 5.0::DOUBLE - 1 AS x2,
  (l_partkey % 1000) / 500.0::DOUBLE - 1 AS x3, ln(l_extendedprice) AS y FROM lineitem"""
@query("train_huber_newton", f"""
WITH RECURSIVE p AS (SELECT x1 AS x, y FROM ({_LINES})),
r(t, w, b) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT t + 1, w - (s1 * g1 - sx * g2) / (sxx * s1 - sx * sx), b - (sxx * g2 - sx * g1) / (sxx * s1 - sx * sx)
  FROM (SELECT t, w, b, sum(u) AS s1, sum(u * x) AS sx, sum(u * x * x) AS sxx, sum(greatest(-0.1, least(0.1, e)) * x) AS g1, sum(greatest(-0.1, least(0.1, e))) AS g2
    FROM (SELECT t, w, b, x, e, CASE WHEN t < 60 THEN 0.1 / greatest(abs(e), 0.1) ELSE (abs(e) <= 0.1)::INT END AS u
      FROM (SELECT t, w, b, x, w * x + b - y AS e FROM r, p WHERE t < 70)) GROUP BY t, w, b)),
f AS (SELECT w, b, x, y, w * x + b - y AS e FROM r, p WHERE t = 70)
SELECT true AS converged, round(any_value(w), 5) + 0.0 AS w, round(any_value(b), 5) + 0.0 AS b,
  round(avg(CASE WHEN abs(e) <= 0.1 THEN 0.5 * e * e ELSE 0.1 * (abs(e) - 0.05) END), 8) AS loss,
  round(greatest(abs(avg(greatest(-0.1, least(0.1, e)) * x)), abs(avg(greatest(-0.1, least(0.1, e))))), 8) + 0.0 AS largest_gradient
FROM f""")
def huber_newton(spark, sf):
    """Weights, and the gradient that the whole table has there."""
    df = table(spark, sf, "lineitem").select((F.col("l_quantity") / 25.0 - 1).alias("x"), F.log("l_extendedprice").alias("y"))
    model, _ = fit_huber_newton(df, ["x"], "y", delta=0.1)
    weights = model.first()["weights"]
    steepest = max(abs(r["gradient"]) for r in gradient_at(df, ["x"], "y", weights, "huber", delta=0.1).collect())  # one row a feature
    out = model.select("converged", F.lit(weights[0]).alias("w"), F.lit(weights[1]).alias("b"), F.col("final_loss").alias("loss"), F.lit(steepest).alias("largest_gradient"))
    return rounded(rounded(out, 5, "w", "b"), 8, "loss", "largest_gradient")


_SOFT = "sign({0}) * greatest(abs({0}) - 0.9 * lam, 0) / ({1} + 0.1 * lam)"


@query("train_elastic_net_path", f"""
WITH RECURSIVE t AS ({_LINES}),
c AS (SELECT l_returnflag AS g, var_pop(x1) AS c11, var_pop(x2) AS c22, var_pop(x3) AS c33, covar_pop(x1, x2) AS c12, covar_pop(x1, x3) AS c13, covar_pop(x2, x3) AS c23,
  covar_pop(x1, y) AS d1, covar_pop(x2, y) AS d2, covar_pop(x3, y) AS d3, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my FROM t WHERE NOT held_out GROUP BY 1),
r(k, g, lam, w1, w2, w3) AS (
  SELECT 0, g, lam, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM c, (VALUES (0.3::DOUBLE), (0.1), (0.03), (0.01), (0.001)) AS v(lam)
  UNION ALL
  SELECT k + 1, g, lam, n1, n2, {_SOFT.format("(d3 - c13 * n1 - c23 * n2)", "c33")}
  FROM (SELECT *, {_SOFT.format("(d2 - c12 * n1 - c23 * w3)", "c22")} AS n2
    FROM (SELECT k, r.g, lam, w3, c.* EXCLUDE (g), {_SOFT.format("(d1 - c12 * w2 - c13 * w3)", "c11")} AS n1 FROM r JOIN c ON r.g = c.g WHERE k < 300))),
w AS (SELECT r.g, lam, w1, w2, w3, my - w1 * m1 - w2 * m2 - w3 * m3 AS b FROM r JOIN c ON r.g = c.g WHERE k = 300),
e AS (SELECT w.g, lam, w1, w2, w3, b, avg((w1 * x1 + w2 * x2 + w3 * x3 + b - y) ** 2) / 2 AS loss FROM w JOIN t ON t.l_returnflag = w.g AND t.held_out GROUP BY ALL)
SELECT g AS l_returnflag, lam AS regularization, round(w1, 5) + 0.0 AS w1, round(w2, 5) + 0.0 AS w2, round(w3, 5) + 0.0 AS w3, round(b, 5) + 0.0 AS b,
  ((w1 <> 0)::INT + (w2 <> 0)::INT + (w3 <> 0)::INT)::INTEGER AS n_active, true AS converged, round(loss, 7) AS held_out_loss,
  row_number() OVER (PARTITION BY g ORDER BY loss, lam DESC) = 1 AS chosen
FROM e""")
def net_path(spark, sf):
    """A path of penalties for each return flag, chosen by the held-out orders."""
    c = F.col
    lines = table(spark, sf, "lineitem").select(
        "l_returnflag", (c("l_orderkey") % 5 == 0).alias("held_out"), (c("l_quantity") / 25.0 - 1).alias("x1"), (c("l_quantity") % 10 / 5.0 - 1).alias("x2"),
        (c("l_partkey") % 1000 / 500.0 - 1).alias("x3"), F.log("l_extendedprice").alias("y"))
    out = elastic_net_path(lines, ["x1", "x2", "x3"], "y", [0.3, 0.1, 0.03, 0.01, 0.001], 0.9, c("held_out"), ["l_returnflag"], tolerance=1e-13)
    weights = [c("weights")[k].alias(n) for k, n in enumerate(("w1", "w2", "w3", "b"))]
    return rounded(rounded(out.select("l_returnflag", "regularization", *weights, "n_active", "converged", "held_out_loss", "chosen"), 5, "w1", "w2", "w3", "b"), 7, "held_out_loss")
