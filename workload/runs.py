"""Run analytics over runs and histories computed from whole tables (A7, A8, B13, C3, C4, C6, E2-E8, M).

Every customer is a run; its orders are the history. Trained runs come from one sweep over all line items.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from slopeworks.operators import experiments as X
from slopeworks.operators import losses as L
from slopeworks.operators.gram import poly_fit
from slopeworks.operators.ranking import multiplicative_hash, with_lags, with_running_min
from slopeworks.plans import compare as CM
from slopeworks.plans import config as C
from slopeworks.plans.passes import fit_by_passes, measured_sizes
from slopeworks.plans.train import fit, history_of
from slopeworks.session import shared_folder
from slopeworks.sources import runs as R
from workload.registry import ORACLES, query, rounded, table, union_all

_RUNS = """
SELECT CAST(c_custkey AS VARCHAR) AS run_id, c_name AS setup,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'gradient_descent' WHEN 'MACHINERY' THEN 'newton_method' WHEN 'FURNITURE' THEN 'quasi_newton'
    WHEN 'HOUSEHOLD' THEN 'stochastic_gd' ELSE 'subgradient' END AS family,
  c_mktsegment || ' - ' || CASE WHEN c_nationkey % 2 = 0 THEN 'OLS' ELSE 'RIDGE' END AS algorithm,
  c_custkey % 3 <> 0 AS converged, (c_nationkey * 10 + c_custkey % 7)::INTEGER AS iterations, abs(c_acctbal) / 100 + 0.5 AS training_time,
  CASE WHEN c_custkey % 17 = 0 THEN 'inf'::DOUBLE ELSE (c_acctbal + 2000) / 1e4 END AS final_loss, (c_custkey % 101) / 1000.0::DOUBLE AS final_gradient_norm,
  CASE WHEN c_custkey % 5 <> 0 THEN (c_acctbal + 1500) / 1e4 END AS best_loss, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS best_iteration,
  CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 97) / 1000.0::DOUBLE END AS best_gradient_norm,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_custkey % 10) / 10.0::DOUBLE END AS learning_rate FROM customer"""
_HISTORY = """
SELECT CAST(o_custkey AS VARCHAR) AS run_id, CAST(o_orderkey AS INTEGER) AS iteration,
  CASE WHEN o_orderkey % 1009 = 0 THEN 'inf'::DOUBLE ELSE o_totalprice / 1000 END AS loss, (o_orderkey % 211) / 10.0::DOUBLE AS gradient_norm FROM orders"""


def runs(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    seg = F.col("c_mktsegment")
    best = k % 5 != 0
    return c.select(
        k.cast("string").alias("run_id"), F.col("c_name").alias("setup"),
        F.when(seg == "BUILDING", "gradient_descent").when(seg == "MACHINERY", "newton_method").when(seg == "FURNITURE", "quasi_newton")
        .when(seg == "HOUSEHOLD", "stochastic_gd").otherwise("subgradient").alias("family"),
        F.concat(seg, F.lit(" - "), F.when(F.col("c_nationkey") % 2 == 0, "OLS").otherwise("RIDGE")).alias("algorithm"),
        (k % 3 != 0).alias("converged"), (F.col("c_nationkey") * 10 + k % 7).cast("int").alias("iterations"),
        (F.abs("c_acctbal") / 100 + 0.5).alias("training_time"),
        F.when(k % 17 == 0, float("inf")).otherwise((F.col("c_acctbal") + 2000) / 1e4).alias("final_loss"), ((k % 101) / 1000.0).alias("final_gradient_norm"),
        F.when(best, (F.col("c_acctbal") + 1500) / 1e4).alias("best_loss"), F.when(best, F.col("c_nationkey")).alias("best_iteration"),
        F.when(best, (k % 97) / 1000.0).alias("best_gradient_norm"), F.when(k % 4 != 0, (k % 10) / 10.0).alias("learning_rate"))


def history(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("run_id"), k.cast("int").alias("iteration"),
        F.when(k % 1009 == 0, float("inf")).otherwise(F.col("o_totalprice") / 1000).alias("loss"), ((k % 211) / 10.0).alias("gradient_norm"))


_DISPLAY = f"""SELECT *, CASE WHEN best_loss IS NOT NULL THEN best_loss ELSE final_loss END AS display_loss,
  CASE WHEN best_loss IS NOT NULL THEN best_gradient_norm ELSE final_gradient_norm END AS display_gradient_norm,
  CASE WHEN best_loss IS NOT NULL THEN best_iteration ELSE iterations END AS display_iteration,
  CASE WHEN best_loss IS NOT NULL THEN 'Best' ELSE 'Final' END AS result_type FROM ({_RUNS})"""


@query("runs_display", f"SELECT run_id, round(display_loss, 6) AS display_loss, display_gradient_norm, display_iteration, result_type FROM ({_DISPLAY})")
def display(spark, sf):
    out = X.display_metrics(runs(spark, sf)).select("run_id", "display_loss", "display_gradient_norm", "display_iteration", "result_type")
    return rounded(out, 6, "display_loss")


@query("runs_summary", f"""
WITH d AS ({_DISPLAY})
SELECT count(*) AS n_runs, count(*) FILTER (converged) AS n_converged, round(count(*) FILTER (converged) * 100.0 / count(*), 6)::DOUBLE AS converged_pct,
  round(avg(training_time), 6) AS mean_time, (SELECT run_id FROM d ORDER BY display_loss, run_id LIMIT 1) AS best_loss_run, round(min(display_loss), 6) AS best_loss,
  (SELECT run_id FROM d ORDER BY training_time, run_id LIMIT 1) AS fastest_run, round(min(training_time), 6) AS fastest_time,
  (SELECT run_id FROM d WHERE converged ORDER BY display_iteration, run_id LIMIT 1) AS fastest_converged_run FROM d""")
def summary(spark, sf):
    return rounded(X.run_summary(runs(spark, sf)), 6, "converged_pct", "mean_time", "best_loss", "fastest_time")


@query("runs_by_family", f"""
SELECT split_part(algorithm, ' - ', 1) AS "group", count(*) AS n_runs, count(*) FILTER (converged) AS n_converged,
  round(count(*) FILTER (converged) * 100.0 / count(*), 6)::DOUBLE AS converged_pct, round(avg(display_loss) FILTER (NOT isinf(display_loss)), 6) AS mean_loss,
  round(avg(display_iteration) FILTER (converged), 6) AS mean_iterations FROM ({_DISPLAY}) GROUP BY 1""")
def families(spark, sf):
    return rounded(X.family_breakdown(runs(spark, sf)), 6, "converged_pct", "mean_loss", "mean_iterations")


@query("runs_recommended", f"WITH d AS (SELECT * FROM ({_DISPLAY}) WHERE converged)\n" + union_all([
    f"SELECT * FROM (SELECT '{n}' AS reason, run_id, round({c}::DOUBLE, 6) AS value FROM d ORDER BY {c}, run_id LIMIT 1)" for n, c in (
        ("lowest_loss", "display_loss"), ("fastest", "training_time"), ("fewest_iterations", "display_iteration"), ("smallest_gradient", "display_gradient_norm"))]))
def recommended(spark, sf):
    return rounded(X.recommended_runs(runs(spark, sf)), 6, "value")


_SCORED = f"""
WITH r AS ({_RUNS}), h AS (SELECT run_id, min_by(loss, iteration) AS first_loss, max_by(loss, iteration) AS last_loss FROM ({_HISTORY}) GROUP BY 1),
x AS (SELECT min(final_loss) FILTER (NOT isinf(final_loss)) AS l0, max(final_loss) FILTER (NOT isinf(final_loss)) AS l1, min(training_time) AS t0, max(training_time) AS t1,
  min(iterations) FILTER (iterations > 0) AS i0, max(iterations) AS i1 FROM r)
SELECT r.*, CASE family WHEN 'gradient_descent' THEN 'First-Order Methods' WHEN 'stochastic_gd' THEN 'Stochastic Methods' WHEN 'newton_method' THEN 'Second-Order Methods'
    WHEN 'quasi_newton' THEN 'Quasi-Newton Methods' ELSE 'Other' END AS category,
  CASE WHEN converged THEN 40 ELSE 0 END + CASE WHEN isinf(final_loss) THEN 0 ELSE (1 - (final_loss - l0) / (l1 - l0)) * 30 END
    + (1 - (training_time - t0) / (t1 - t0)) * 20 + CASE WHEN iterations > 0 THEN (1 - (iterations - i0) / (i1 - i0)) * 10 ELSE 0 END AS performance_score,
  CASE WHEN isinf(final_loss) OR final_loss = 0 THEN 0 ELSE 1 / (final_loss * training_time) END AS efficiency_score,
  CASE WHEN iterations > 0 AND first_loss - last_loss IS NOT NULL THEN (first_loss - last_loss) / iterations ELSE 0 END AS convergence_rate
FROM r LEFT JOIN h USING (run_id) CROSS JOIN x"""


@query("runs_comparison", f"""SELECT run_id, category, round(performance_score, 6)::DOUBLE AS performance_score, round(efficiency_score, 6)::DOUBLE AS efficiency_score,
  CASE WHEN isfinite(convergence_rate) THEN round(convergence_rate * iterations, 6) + 0.0 ELSE convergence_rate END::DOUBLE AS gain FROM ({_SCORED})""")
def comparison(spark, sf):
    out = X.comparison_table(runs(spark, sf), history(spark, sf))
    gain = F.col("convergence_rate") * F.when(F.col("iterations") > 0, F.col("iterations")).otherwise(1)
    out = out.select("run_id", "category", "performance_score", "efficiency_score", gain.alias("gain"))
    return rounded(out, 6, "performance_score", "efficiency_score", "gain")


def _reports(spark, sf):
    """The report job over stored runs and histories: a failed batch, then a batch that is retried, then one of reports."""
    path = shared_folder(spark)
    all_runs, all_history = runs(spark, sf), history(spark, sf)
    with contextlib.suppress(InterruptedError), R.Batch(spark, path, "lost") as b:
        b.store(all_runs, "runs")
        raise InterruptedError("stopped before its histories were written")
    for part in (all_runs.filter("converged"), all_runs):  # the second attempt takes the place of the first
        with R.Batch(spark, path, "kept") as b:
            b.store(part, "runs")
            b.store(all_history, "history")
    stored, past = R.read_written_runs(spark, path)
    CM.store_reports(stored, path, past, "reports")
    return path


@query("reports_stored_comparison", ORACLES["runs_comparison"])
def reports_stored_comparison(spark, sf):
    out = R.read_committed(spark, _reports(spark, sf), "comparison")
    gain = F.col("convergence_rate") * F.when(F.col("iterations") > 0, F.col("iterations")).otherwise(1)
    return rounded(out.select("run_id", "category", "performance_score", "efficiency_score", gain.alias("gain")), 6, "performance_score", "efficiency_score", "gain")


@query("reports_store_state", f"""
SELECT 'runs' AS name, count(*) AS n, count(DISTINCT run_id) AS n_runs FROM ({_RUNS}) UNION ALL
SELECT 'history', count(*), count(DISTINCT run_id) FROM ({_HISTORY}) UNION ALL
SELECT 'ordered', count(*), count(DISTINCT run_id) FROM ({_RUNS}) UNION ALL
SELECT 'unfinished', 1, 0""")
def reports_store_state(spark, sf):
    """Rows that readers of the store see, and the attempt that was not committed."""
    path = _reports(spark, sf)
    counts = [R.read_committed(spark, path, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.count_distinct("run_id").alias("n_runs"))
              for t in ("runs", "history", "ordered")]
    lost = R.unfinished(spark, path).agg(F.lit("unfinished").alias("name"), F.count("*").alias("n"), F.lit(0).cast("long").alias("n_runs"))
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(lost)


@query("runs_by_category", f"""
SELECT category, count(*) AS n_runs, round(avg(performance_score), 6) AS mean_score, round(max(performance_score), 6)::DOUBLE AS max_score, round(avg(training_time), 6) AS mean_time,
  round(count(*) FILTER (converged) * 100.0 / count(*), 6)::DOUBLE AS converged_pct FROM ({_SCORED}) GROUP BY 1""")
def categories(spark, sf):
    return rounded(X.category_summary(X.with_scores(runs(spark, sf))), 6, "mean_score", "max_score", "mean_time", "converged_pct")


@query("runs_top", f"SELECT run_id, round(performance_score, 6)::DOUBLE AS performance_score FROM ({_SCORED}) ORDER BY performance_score DESC, run_id LIMIT 5")
def top(spark, sf):
    return rounded(X.top_runs(X.with_scores(runs(spark, sf))).select("run_id", "performance_score"), 6, "performance_score")


@query("runs_ordered", f"SELECT run_id, converged, round(display_loss, 6) AS display_loss FROM ({_DISPLAY}) ORDER BY converged DESC, display_loss, run_id")
def ordered(spark, sf):
    return rounded(X.ordered_report(runs(spark, sf)).select("run_id", "converged", "display_loss"), 6, "display_loss")


@query("runs_by_iterations", f"SELECT run_id, converged, iterations FROM ({_RUNS}) ORDER BY converged DESC, iterations, run_id")
def by_iterations(spark, sf):
    return X.by_iterations(runs(spark, sf)).select("run_id", "converged", "iterations")


@query("runs_parameter_points", f"SELECT run_id, learning_rate AS parameter, round(performance_score, 6)::DOUBLE AS performance_score, iterations FROM ({_SCORED}) WHERE learning_rate IS NOT NULL")
def parameter_points(spark, sf):
    return rounded(X.parameter_points(X.with_scores(runs(spark, sf))), 6, "performance_score")


@query("runs_radar", f"""
SELECT run_id, 'training_time' AS metric, round(1 / (1 + training_time), 8) AS value FROM ({_RUNS})
UNION ALL SELECT run_id, 'learning_rate', CASE WHEN learning_rate IS NULL THEN 0.5 ELSE least(learning_rate, 1) END::DOUBLE FROM ({_RUNS})""")
def radar(spark, sf):
    return rounded(X.radar(runs(spark, sf), ["training_time"], ["learning_rate"]), 8, "value")


@query("runs_requested", f"""
SELECT CAST(o_custkey AS VARCHAR) AS run_id, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS valid, count(*) AS n FROM orders GROUP BY 1, 2""")
def requested(spark, sf):
    have = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("run_id"))
    asked = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("run_id"))
    valid, invalid = X.requested_runs(asked, have)
    both = valid.withColumn("valid", F.lit(True)).unionByName(invalid.withColumn("valid", F.lit(False)))
    return both.groupBy("run_id", "valid").agg(F.count("*").alias("n"))


_CHANGE = f"""
SELECT run_id, iteration, CASE WHEN isinf(loss) OR isinf(p) THEN NULL ELSE round(loss - p, 6) + 0.0 END AS cost_change, coalesce(loss > 2 * p4, false) AS diverging
FROM (SELECT *, lag(loss) OVER w AS p, lag(loss, 4) OVER w AS p4 FROM ({_HISTORY}) WINDOW w AS (PARTITION BY run_id ORDER BY iteration))"""


def _change(df):
    out = df.select("run_id", "iteration", X.finite_or_null(F.col("cost_change")).alias("cost_change"), "diverging")
    return rounded(out, 6, "cost_change")


@query("history_cost_change", _CHANGE)
def cost_change(spark, sf):
    return _change(X.with_cost_change(history(spark, sf)))


@query("history_cost_change_chunked", _CHANGE)
def cost_change_chunked(spark, sf):
    """The plan for runs longer than one task should hold, forced here by chunks of eight records."""
    return _change(X.with_cost_change(history(spark, sf), chunk_rows=8))


_MINIMUM = f"""SELECT run_id, iteration, min(loss) OVER (PARTITION BY run_id ORDER BY iteration) AS min_loss,
  min(loss) OVER (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_min FROM ({_HISTORY})"""


@query("history_running_minimum", _MINIMUM)
def running_minimum(spark, sf):
    return X.with_minimum_so_far(history(spark, sf)).select("run_id", "iteration", "min_loss", "previous_min")


@query("history_running_minimum_chunked", _MINIMUM)
def running_minimum_chunked(spark, sf):
    return X.with_minimum_so_far(history(spark, sf), chunk_rows=8).select("run_id", "iteration", "min_loss", "previous_min")


@query("history_facts", f"""
SELECT run_id, count(*) AS history_length, min_by(loss, iteration) AS first_loss, max_by(loss, iteration) AS last_loss, min(loss) AS lowest_loss,
  round(min_by(loss, iteration) / min(loss), 6) AS loss_reduction_ratio, first(iteration ORDER BY gradient_norm, iteration) AS best_iteration_by_gradient,
  min(gradient_norm) AS best_gradient FROM ({_HISTORY}) GROUP BY 1""")
def facts(spark, sf):
    return rounded(X.history_facts(history(spark, sf)).drop("loss_improvement"), 6, "loss_reduction_ratio")


@query("history_convergence_table", f"""
SELECT h.*, r.setup, r.family FROM ({_HISTORY}) h JOIN ({_RUNS}) r USING (run_id)
WHERE run_id NOT IN (SELECT run_id FROM ({_HISTORY}) WHERE isinf(loss))""")
def convergence(spark, sf):
    return X.convergence_table(runs(spark, sf), history(spark, sf))


@query("history_thinned", f"SELECT * FROM ({_HISTORY}) WHERE iteration % 10 = 0")
def thinned(spark, sf):
    return X.thin_history(history(spark, sf), 10)


@query("history_issues", f"SELECT run_id, iteration, loss, gradient_norm, 'Inf in loss' AS issue FROM ({_HISTORY}) WHERE isinf(loss)")
def issues(spark, sf):
    return L.numerical_issues(history(spark, sf))


@query("history_operations", f"""
SELECT h.run_id, sum(h.iteration * 2)::BIGINT AS operations_to_convergence FROM ({_HISTORY}) h JOIN ({_RUNS}) r USING (run_id)
WHERE r.converged AND h.iteration <= r.iterations * 40 GROUP BY 1""")
def operations(spark, sf):
    h = history(spark, sf).withColumn("operations", F.col("iteration") * 2)
    return X.operations_to(h, runs(spark, sf).withColumn("iterations", F.col("iterations") * 40))


# Result documents: one JSON text per order, in three of the layouts the families use.
_JSON_RUNS = """
SELECT CAST(o_orderkey AS VARCHAR) AS run_id,
  CASE WHEN o_orderkey % 3 = 2 THEN 'Unknown' ELSE 'algo ' || o_orderstatus END AS algorithm, o_orderkey % 2 = 0 AND o_orderkey % 3 <> 2 AS converged,
  CASE o_orderkey % 3 WHEN 2 THEN 'inf'::DOUBLE ELSE o_totalprice END AS final_loss, (o_custkey % 100)::INTEGER AS iterations,
  CASE o_orderkey % 3 WHEN 0 THEN o_totalprice / 2 END AS best_loss, CASE WHEN o_orderkey % 3 = 0 THEN 0.5::DOUBLE END AS learning_rate,
  o_totalprice / 8 AS training_time FROM orders"""


def _documents(spark, sf):
    k, price, its = F.col("o_orderkey"), F.col("o_totalprice"), (F.col("o_custkey") % 100).cast("int")
    name = F.concat(F.lit("algo "), "o_orderstatus")
    nested = F.to_json(F.struct(name.alias("algorithm"), F.struct(F.lit(0.5).alias("learning_rate")).alias("parameters"), F.struct(
        (price / 8).alias("training_time"), (k % 2 == 0).alias("converged"), its.alias("final_epoch"), price.alias("final_cost"),
        (price / 2).alias("best_loss")).alias("training_results")))
    middle = F.to_json(F.struct(name.alias("algorithm"), (price / 8).alias("training_time"), F.struct(
        (k % 2 == 0).alias("converged"), its.alias("iterations"), price.alias("final_loss")).alias("convergence")))
    flat = F.to_json(F.struct((price / 8).alias("training_time_seconds"), its.alias("final_iterations")))
    text = F.when(k % 3 == 0, nested).when(k % 3 == 1, middle).otherwise(flat)
    return table(spark, sf, "orders").select(k.cast("string").alias("run_id"), text.alias("value"))


def _flat(df):
    return df.select("run_id", "algorithm", "converged", "final_loss", "iterations", "best_loss", "learning_rate", "training_time")


@query("results_flattened", _JSON_RUNS)
def flattened(spark, sf):
    parsed = _documents(spark, sf).select("run_id", F.from_json("value", R.RESULT_SCHEMA).alias("r")).select("run_id", "r.*")
    return _flat(R.flatten_results(parsed))


@query("results_read_from_files", _JSON_RUNS.replace("SELECT CAST(o_orderkey AS VARCHAR) AS run_id,", "SELECT").replace("o_totalprice / 8 AS training_time", "o_totalprice / 8 AS training_time, 'setup_' || o_orderstatus AS setup, 'family_' || (o_orderkey % 3) AS family"))
def from_files(spark, sf):
    """Writes the documents as a family/setup tree of JSON lines and scans the tree."""
    path = shared_folder(spark)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), "o_orderstatus")
    docs = _documents(spark, sf).join(o, "run_id").withColumns({
        "family": F.concat(F.lit("family_"), (F.col("run_id").cast("long") % 3).cast("string")), "setup": F.concat(F.lit("setup_"), "o_orderstatus")})
    docs.select("value", "family", "setup").write.partitionBy("family", "setup").text(path)
    flat = R.flatten_results(R.read_results(spark, f"{path}/*/*/*", multi_line=False))
    return flat.select("family", "setup", "algorithm", "converged", "final_loss", "iterations", "best_loss", "learning_rate", "training_time")


# Trained runs.


def trained(spark, sf, **options):
    df = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") / 25.0 - 1).alias("x"), F.col("l_discount"), F.log1p("l_extendedprice").alias("y"))
    setups = [C.Setup(setup="gd", learning_rate=0.3, check_every=10, tolerance=1e-8, max_iter=2000, **options),
              C.Setup(setup="momentum", method="momentum", learning_rate=0.1, check_every=10, tolerance=1e-8, max_iter=2000, **options),
              C.Setup(setup="newton", method="newton", check_every=1, tolerance=1e-8, **options),
              C.Setup(setup="lbfgs", method="lbfgs", check_every=1, tolerance=1e-8, **options)]
    return fit(df, ["x", "l_discount"], "y", setups, ["l_returnflag"])


@query("trained_complexity")
def complexity(spark, sf):
    return X.complexity_table(trained(spark, sf))


@query("trained_scalability")
def scalability(spark, sf):
    return X.scalability(trained(spark, sf))


# Rows that the passes of one training read, on shares of the line items: measured while they run.
_MEASURED = """
SELECT share::DOUBLE AS share, count(*) AS n, 4::BIGINT AS passes, 4 * count(*) AS rows_read, 16 * count(*) AS multiplications
FROM lineitem, (VALUES (0.25), (0.5), (1.0)) AS s(share) WHERE l_orderkey % 2147483648 * 2654435761 % 4294967296 < share * 4294967296 GROUP BY share"""


def _measured(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_quantity") / 25.0 - 1).alias("x"), F.log1p("l_extendedprice").alias("y"))

    def train(part, meter):
        fit_by_passes(part, ["x"], "y", loss="ols", method="gd", learning_rate=0.1, max_iter=3, tolerance=0.0, meter=meter)

    return measured_sizes(df, [0.25, 0.5, 1.0], multiplicative_hash("l_orderkey"), train)


@query("trained_measured_cost", _MEASURED)
def measured_cost(spark, sf):
    return _measured(spark, sf).select("share", "n", "passes", "rows_read", "multiplications")


@query("trained_measured_trend", f"SELECT round(regr_slope(rows_read, n), 6) AS rows_read_a_row, round(regr_r2(rows_read, n), 6) AS r2 FROM ({_MEASURED})")
def measured_trend(spark, sf):
    """Rows read grow in proportion to the table."""
    fit = poly_fit(_measured(spark, sf), "n", "rows_read", 1)
    return rounded(fit.select((F.col("weights")[0] / F.col("scale")).alias("rows_read_a_row"), "r2"), 6, "rows_read_a_row", "r2")


@query("trained_active_weights")
def active_weights(spark, sf):
    return X.active_weights(trained(spark, sf, keep_weights=True))


@query("trained_trajectory")
def trajectory(spark, sf):
    return X.trajectory(trained(spark, sf, keep_weights=True))


@query("trained_comparison")
def trained_comparison(spark, sf):
    """Writes trained runs and histories, reads them back, ranks them."""
    path = shared_folder(spark)
    R.write_runs(R.as_comparison_runs(trained(spark, sf)), path, ["l_returnflag"])
    stored, past = R.read_written_runs(spark, path)
    out = X.comparison_table(stored, past)
    return out.select("run_id", "category", "converged", "iterations", "performance_score", "convergence_rate")


@query("trained_history")
def trained_history(spark, sf):
    return history_of(trained(spark, sf), ["l_returnflag"]).drop("weights")


# One run under a null key, and an outlying place in the order of every run.
_NULL_KEYS = f"""SELECT CASE WHEN run_id = (SELECT min(run_id) FROM ({_HISTORY})) THEN NULL ELSE run_id END AS run_id,
  CASE WHEN iteration = (SELECT max(iteration) FROM ({_HISTORY})) THEN iteration::BIGINT * 1000000 ELSE iteration END AS iteration, loss FROM ({_HISTORY})"""


def _null_keys(spark, sf):
    h = history(spark, sf)
    first, last = h.agg(F.min("run_id"), F.max("iteration")).first()
    i = F.col("iteration").cast("long")
    return h.select(F.when(F.col("run_id") != first, F.col("run_id")).alias("run_id"), F.when(i == last, i * 1000000).otherwise(i).alias("iteration"), "loss")


def _both_plans(frame):
    return frame(1_000_000).withColumn("plan", F.lit("window")).unionByName(frame(8).withColumn("plan", F.lit("chunks")))


def _both_sql(sql: str) -> str:
    return union_all([f"SELECT *, '{p}' AS plan FROM ({sql})" for p in ("window", "chunks")])


@query("history_cost_change_null_keys", _both_sql(f"""
SELECT *, lag(loss) OVER (PARTITION BY run_id ORDER BY iteration) AS previous, lag(loss, 5) OVER (PARTITION BY run_id ORDER BY iteration) AS fifth FROM ({_NULL_KEYS})"""))
def cost_change_null_keys(spark, sf):
    df = _null_keys(spark, sf)
    return _both_plans(lambda rows: with_lags(df, ["run_id"], "iteration", {"previous": ("loss", 1), "fifth": ("loss", 5)}, chunk_rows=rows))


@query("history_running_minimum_null_keys", _both_sql(f"""
SELECT *, min(loss) OVER (PARTITION BY run_id ORDER BY iteration) AS lowest,
  min(loss) OVER (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({_NULL_KEYS})"""))
def running_minimum_null_keys(spark, sf):
    df = _null_keys(spark, sf)
    return _both_plans(lambda rows: with_running_min(df, ["run_id"], "iteration", "loss", "lowest", "before", chunk_rows=rows))


_FILES = """
WITH o AS (SELECT o_custkey % 24 AS g, ((year(o_orderdate) - 1990) * 12 + month(o_orderdate))::INTEGER AS iteration,
  sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS loss, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT CASE g % 3 WHEN 0 THEN 'gradient_descent' WHEN 1 THEN 'stochastic_gd' ELSE 'newton_method' END || '/s' || g AS run_id, iteration,
  loss::DOUBLE AS loss, n::DOUBLE AS gradient_norm, CASE WHEN g % 3 = 2 THEN 0.5::DOUBLE END AS step_size FROM o"""


@query("history_read_from_files", _FILES)
def history_files(spark, sf):
    """Writes history files of three families, each with a header of its own, and reads them back as one table."""
    month = ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")).alias("iteration")
    o = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 24).alias("g"), month).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("loss"), F.count("*").alias("n"))
    third = F.col("g") % 3
    family = F.when(third == 0, "gradient_descent").when(third == 1, "stochastic_gd").otherwise("newton_method")
    header = F.when(third == 0, "iteration,loss,gradient_norm").when(third == 1, "epoch,loss,gradient_norm").otherwise("iteration,loss,gradient_norm,step_size")
    line = F.concat_ws(",", "iteration", "loss", "n", F.when(third == 2, "0.5"))
    # One file for each run; a run has one line for each month.
    files = o.groupBy(family.alias("family"), F.concat(F.lit("s"), F.col("g")).alias("setup"), header.alias("header")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    path = shared_folder(spark)
    files.select("family", "setup", F.concat_ws("\n", "header", "lines").alias("value")).write.partitionBy("family", "setup").text(path)
    return R.read_histories(spark, f"{path}/*/*").select("run_id", "iteration", "loss", "gradient_norm", "step_size")
