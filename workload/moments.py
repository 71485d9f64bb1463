"""Statistics, losses, gradients and Hessians over whole tables (J)."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from slopeworks.operators import gram as G
from slopeworks.operators import losses as L
from workload.registry import query, rounded, table, union_all

FEATURES = ["l_quantity", "l_discount", "l_tax"]
Z = {"l_quantity": "l_quantity", "l_discount": "l_discount", "l_tax": "l_tax", "bias": "1.0::DOUBLE", "label": "y"}
_LINES = "SELECT *, ln(1 + l_extendedprice) AS y FROM lineitem"
WEIGHTS = [0.02, -0.5, 0.25, 9.5]
_E = "(0.02 * l_quantity - 0.5 * l_discount + 0.25 * l_tax + 9.5 - y)"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("y", F.log1p("l_extendedprice"))


def _cells_sql(group: str = "") -> str:
    keys = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return union_all([f"SELECT {keys}'{a}' AS row, '{b}' AS col, round(sum({Z[a]} * {Z[b]}), 4) AS value FROM ({_LINES}){tail}"
                      for a, b in combinations_with_replacement(Z, 2)])


@query("gram_cells", _cells_sql())
def gram_cells(spark, sf):
    return rounded(G.gram_cells(G.gram_stats(_lines(spark, sf), FEATURES, "y"), FEATURES), 4, "value")


@query("gram_cells_by_blocks", _cells_sql())
def gram_cells_blocks(spark, sf):
    return rounded(G.gram_cells(G.gram_stats(_lines(spark, sf), FEATURES, "y", wide_features=0), FEATURES), 4, "value")


@query("gram_cells_grouped", _cells_sql("l_returnflag"))
def gram_cells_grouped(spark, sf):
    stats = G.gram_stats(_lines(spark, sf), FEATURES, "y", ["l_returnflag"])
    return rounded(G.gram_cells(stats, FEATURES, ["l_returnflag"]), 4, "value")


@query("gram_cells_grouped_by_blocks", _cells_sql("l_suppkey"))
def gram_cells_grouped_blocks(spark, sf):
    stats = G.gram_stats(_lines(spark, sf), FEATURES, "y", ["l_suppkey"], wide_features=0)
    return rounded(G.gram_cells(stats, FEATURES, ["l_suppkey"]), 4, "value")


_REGR = "round(regr_slope(y, l_quantity), 8) AS slope, round(regr_intercept(y, l_quantity), 6) AS intercept"


@query("regression_normal_equations", f"SELECT count(*)::DOUBLE AS n, {_REGR} FROM ({_LINES})")
def normal_equations(spark, sf):
    fit = G.normal_equations(G.gram_stats(_lines(spark, sf), ["l_quantity"], "y"))
    return rounded(rounded(fit.select("n", F.col("weights")[0].alias("slope"), F.col("weights")[1].alias("intercept")), 8, "slope"), 6, "intercept")


@query("regression_by_group", f"SELECT l_suppkey, count(*)::DOUBLE AS n, {_REGR} FROM ({_LINES}) GROUP BY 1")
def regression_by_group(spark, sf):
    fit = G.normal_equations(G.gram_stats(_lines(spark, sf), ["l_quantity"], "y", ["l_suppkey"]), ["l_suppkey"])
    out = fit.select("l_suppkey", "n", F.col("weights")[0].alias("slope"), F.col("weights")[1].alias("intercept"))
    return rounded(rounded(out, 8, "slope"), 6, "intercept")


@query("regression_conditioning", f"""
WITH s AS (SELECT avg(l_quantity * l_quantity) AS a, avg(l_quantity) AS m, count(*)::DOUBLE AS n FROM ({_LINES})),
e AS (SELECT n, (a + 1) / 2 AS h, sqrt(((a - 1) / 2) ** 2 + m * m) AS d FROM s)
SELECT n, round(h - d, 8) AS min_eigenvalue, round(h + d, 4) AS max_eigenvalue, round((h + d) / (h - d), 2) AS condition_number, true AS positive_definite FROM e""")
def conditioning(spark, sf):
    out = G.conditioning(G.gram_stats(_lines(spark, sf), ["l_quantity"], "y"))
    return rounded(rounded(rounded(out, 8, "min_eigenvalue"), 4, "max_eigenvalue"), 2, "condition_number")


_PENALTY = {
    "ols": "0.0", "ridge": "0.05 * (0.02 ** 2 + 0.5 ** 2 + 0.25 ** 2)",
    "lasso": "0.1 * (sqrt(0.02 ** 2 + 1e-8) + sqrt(0.5 ** 2 + 1e-8) + sqrt(0.25 ** 2 + 1e-8))",
    "elastic_net": "0.1 * (0.5 * (0.02 + 0.5 + 0.25) + 0.25 * (0.02 ** 2 + 0.5 ** 2 + 0.25 ** 2))", "huber": "0.0"}
_SLOPES = {
    "ols": ["0", "0", "0"], "ridge": ["0.1 * 0.02", "0.1 * -0.5", "0.1 * 0.25"],
    "lasso": [f"0.1 * {w} / sqrt({w} * {w} + 1e-8)" for w in ("0.02::DOUBLE", "-0.5::DOUBLE", "0.25::DOUBLE")],
    "elastic_net": ["0.1 * (0.5 + 0.5 * 0.02)", "0.1 * (-0.5 + 0.5 * -0.5)", "0.1 * (0.5 + 0.5 * 0.25)"], "huber": ["0", "0", "0"]}

for _loss in _PENALTY:
    _data = f"avg({_E} * {_E}) / 2" if _loss != "huber" else f"avg(CASE WHEN abs({_E}) <= 0.5 THEN 0.5 * {_E} * {_E} ELSE 0.5 * (abs({_E}) - 0.25) END)"

    @query(f"loss_{_loss}", f"""SELECT n, round(d, 8) AS data_loss, round(p, 8) AS penalty, round(d + p, 8) AS loss
FROM (SELECT count(*) AS n, {_data} AS d, ({_PENALTY[_loss]})::DOUBLE AS p FROM ({_LINES}))""")
    def loss(spark, sf, kind=_loss):
        out = L.loss_at(_lines(spark, sf), FEATURES, "y", WEIGHTS, kind, lam=0.1, delta=0.5)
        return rounded(out, 8, "data_loss", "penalty", "loss")

    _error = _E if _loss != "huber" else f"greatest(-0.5, least(0.5, {_E}))"

    @query(f"gradient_{_loss}", union_all([
        f"SELECT '{c}' AS feature, round(avg({_error} * {Z[c]}) + {p}, 6) AS gradient FROM ({_LINES})"
        for c, p in zip([*FEATURES, "bias"], [*_SLOPES[_loss], "0"])]))
    def gradient(spark, sf, kind=_loss):
        return rounded(L.gradient_at(_lines(spark, sf), FEATURES, "y", WEIGHTS, kind, lam=0.1, delta=0.5), 6, "gradient")


_CURVES = {"ols": ["0"] * 3, "ridge": ["0.1"] * 3,
           "lasso": [f"0.1 * 1e-8 / ({w} * {w} + 1e-8) ** 1.5" for w in ("0.02::DOUBLE", "0.5::DOUBLE", "0.25::DOUBLE")]}
for _loss, _diagonal in _CURVES.items():
    _names = [*FEATURES, "bias"]

    @query(f"hessian_{_loss}", union_all([
        f"SELECT '{a}' AS row, '{b}' AS col, round(avg({Z[a]} * {Z[b]}) + {(_diagonal + ['0'])[_names.index(a)] if a == b else '0'}, 6) AS value FROM ({_LINES})"
        for a, b in combinations_with_replacement(_names, 2)]))
    def hessian(spark, sf, kind=_loss):
        stats = G.gram_stats(_lines(spark, sf), FEATURES, "y")
        return rounded(L.hessian_cells(stats, FEATURES, WEIGHTS, kind, lam=0.1), 6, "value")


def _cubic_sql() -> str:
    """Cramer's rule on the covariances of the powers of p_size / max(p_size)."""
    s = {(i, j): f"c{min(i, j)}{max(i, j)}" for i in (1, 2, 3) for j in (1, 2, 3)}
    det = lambda m: (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"  # noqa: E731
                     f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")
    full = det([[s[i, j] for j in (1, 2, 3)] for i in (1, 2, 3)])
    weights = [f"{det([[f'd{i}' if j == k else s[i, j] for j in (1, 2, 3)] for i in (1, 2, 3)])} / {full} AS w{k}" for k in (1, 2, 3)]
    cov = ", ".join(f"covar_pop(u{i}, u{j}) AS c{i}{j}" for i in (1, 2, 3) for j in range(i, 4))
    return f"""WITH t AS (SELECT u AS u1, u * u AS u2, u * u * u AS u3, y FROM (SELECT p_size / (SELECT max(p_size) FROM part)::DOUBLE AS u, p_retailprice AS y FROM part)),
c AS (SELECT {cov}, covar_pop(u1, y) AS d1, covar_pop(u2, y) AS d2, covar_pop(u3, y) AS d3, var_pop(y) AS v FROM t), w AS (SELECT c.*, {', '.join(weights)} FROM c)
SELECT round(w1, 2) + 0.0 AS p1, round(w2, 2) + 0.0 AS p2, round(w3, 2) + 0.0 AS p3, round((w1 * d1 + w2 * d2 + w3 * d3) / v, 6) + 0.0 AS r2 FROM w"""


@query("regression_cubic_trend", _cubic_sql())
def cubic_trend(spark, sf):
    fit = G.poly_fit(table(spark, sf, "part"), "p_size", "p_retailprice", 3)
    return rounded(rounded(fit.select(*[F.col("weights")[k].alias(f"p{k + 1}") for k in range(3)], "r2"), 2, "p1", "p2", "p3"), 6, "r2")


@query("regression_quadratic_trend", """
WITH t AS (SELECT l_linenumber / 7.0::DOUBLE AS u, y FROM (SELECT l_linenumber, ln(1 + l_extendedprice) AS y FROM lineitem)),
c AS (SELECT avg(u) AS u1, avg(u * u) AS u2, avg(y) AS y1 FROM t),
s AS (SELECT avg((u - u1) ** 2) AS aa, avg((u - u1) * (u * u - u2)) AS ab, avg((u * u - u2) ** 2) AS bb, avg((u - u1) * (y - y1)) AS ay,
  avg((u * u - u2) * (y - y1)) AS by_, avg((y - y1) ** 2) AS yy FROM t, c)
SELECT round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 5) AS p1, round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 5) AS p2,
  round(((ay * bb - by_ * ab) * ay + (by_ * aa - ay * ab) * by_) / (aa * bb - ab * ab) / yy, 6) AS r2 FROM s""")
def quadratic_trend(spark, sf):
    fit = G.poly_fit(_lines(spark, sf), "l_linenumber", "y", 2)
    return rounded(rounded(fit.select(F.col("weights")[0].alias("p1"), F.col("weights")[1].alias("p2"), "r2"), 5, "p1", "p2"), 6, "r2")
