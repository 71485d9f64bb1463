"""Run analytics (M1-M16, B13, C3, C4, C6, E2-E8, O3-O8): ordinary DataFrame queries over runs and histories.

A runs table has one row per run_id: family, setup, algorithm, loss_function, converged, iterations, training_time,
final_* and best_* columns. A history table has (run_id, iteration, loss, gradient_norm).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.functions import constants as K
from slopeworks.functions.numeric import is_finite
from slopeworks.functions.text import head_of
from slopeworks.operators.clean import finite_groups
from slopeworks.operators.gram import poly_fit
from slopeworks.operators.ranking import with_lags, with_running_min


def category_of(family: Column) -> Column:
    """Category of a family, `Other` by default."""
    table = F.create_map(*[F.lit(x) for kv in K.FAMILY_CATEGORY.items() for x in kv])
    return F.coalesce(table[family], F.lit("Other"))


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)


def display_metrics(runs: DataFrame) -> DataFrame:
    """Best values if the run has them, else final ones, with a tag (M2)."""
    best = F.col("best_loss").isNotNull()
    pick = {f"display_{n}": F.when(best, F.col(f"best_{b}")).otherwise(F.col(f))
            for n, b, f in (("loss", "loss", "final_loss"), ("gradient_norm", "gradient_norm", "final_gradient_norm"),
                            ("iteration", "iteration", "iterations"))}
    return runs.withColumns({**pick, "result_type": F.when(best, "Best").otherwise("Final")})


def _first_by(value: Column, *order: Column) -> Column:
    """Name of the run with the smallest order values; ties go to the smallest name, unknown values do not compete."""
    known = reduce(lambda a, b: a & b, [o.isNotNull() for o in order])
    return F.min_by(value, F.when(known, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("name"))))


def run_summary(runs: DataFrame) -> DataFrame:
    """Counts, convergence share, mean time, best and fastest runs."""
    r = display_metrics(runs)
    name, conv = F.col("run_id"), F.col("converged")
    loss = F.coalesce(finite_or_null(F.col("display_loss")), F.lit(float("inf")))
    return r.agg(F.count("*").alias("n_runs"), F.count_if(conv).alias("n_converged"),
                 F.try_divide(F.count_if(conv) * 100.0, F.count("*")).alias("converged_pct"),
                 F.avg("training_time").alias("mean_time"), _first_by(name, loss).alias("best_loss_run"), F.min(loss).alias("best_loss"),
                 _first_by(name, F.col("training_time")).alias("fastest_run"), F.min("training_time").alias("fastest_time"),
                 _first_by(name, F.when(conv, F.col("display_iteration"))).alias("fastest_converged_run"))


def family_breakdown(runs: DataFrame, family: Column | None = None) -> DataFrame:
    """Runs, convergence, mean finite loss, mean iterations of converged runs per family."""
    r = display_metrics(runs).withColumn("group", head_of(F.col("algorithm")) if family is None else family)
    conv = F.col("converged")
    return r.groupBy("group").agg(
        F.count("*").alias("n_runs"), F.count_if(conv).alias("n_converged"),
        (F.count_if(conv) * 100.0 / F.count("*")).alias("converged_pct"),
        F.avg(finite_or_null(F.col("display_loss"))).alias("mean_loss"),
        F.avg(F.when(conv, F.col("display_iteration"))).alias("mean_iterations"))


def recommended_runs(runs: DataFrame) -> DataFrame:
    """Lowest loss, fastest, fewest iterations, smallest gradient among converged runs: rows (reason, run_id, value) (M5)."""
    r = display_metrics(runs).filter("converged")
    picks = {"lowest_loss": "display_loss", "fastest": "training_time", "fewest_iterations": "display_iteration",
             "smallest_gradient": "display_gradient_norm"}
    row = r.agg(*[F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("value"), F.col("run_id")))).alias(n)
                  for n, c in picks.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n)["run_id"].alias("run_id"), F.col(n)["value"].alias("value")) for n in picks])
    return row.select(F.explode(cells).alias("x")).select("x.*").filter(F.col("run_id").isNotNull())


def min_max_share(runs: DataFrame, valid: dict[str, Column]) -> dict[str, Column]:
    """Per column: 1 - (x - min) / (max - min) over valid rows, 0 if the range is 0 or the row is not valid.

    The ranges are one aggregate, read back as a scalar struct, so no window gathers all runs in one task.
    """
    aggs = [a for c, ok in valid.items() for a in (F.min(F.when(ok, F.col(c))).alias(f"lo_{c}"), F.max(F.when(ok, F.col(c))).alias(f"hi_{c}"))]
    names = [n for c in valid for n in (f"lo_{c}", f"hi_{c}")]
    ranges = runs.agg(*aggs).select(F.struct(*names)).scalar()
    out = {}
    for c, ok in valid.items():
        lo, hi = ranges[f"lo_{c}"], ranges[f"hi_{c}"]
        out[c] = F.when(F.coalesce(ok & (hi > lo), F.lit(False)), 1 - (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return out


def with_scores(runs: DataFrame) -> DataFrame:
    """Category, performance score 40/30/20/10, efficiency 1/(loss*time), loss gain per iteration (M6, M7)."""
    finite = is_finite(F.col("final_loss"))
    share = min_max_share(runs, {"final_loss": finite, "training_time": F.col("training_time") > 0, "iterations": F.col("iterations") > 0})
    score = (F.when(F.col("converged"), 40.0).otherwise(0.0) + share["final_loss"] * 30
             + share["training_time"] * 20 + share["iterations"] * 10)
    product = F.col("final_loss") * F.col("training_time")
    efficient = F.when(finite & (F.col("training_time") > 0), F.try_divide(F.lit(1.0), product))
    new = {"category": category_of(F.col("family")), "performance_score": score,
           "efficiency_score": F.coalesce(efficient, F.lit(0.0))}
    if "loss_improvement" in runs.columns:
        rate = F.when(F.col("iterations") > 0, F.col("loss_improvement") / F.col("iterations"))
        new["convergence_rate"] = F.coalesce(rate, F.lit(0.0))
    return runs.withColumns(new)


def comparison_table(runs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Scored runs, categories in order, best score first."""
    r = runs if history is None else with_history_facts(runs, history)
    return with_scores(r).orderBy("category", F.desc("performance_score"), "run_id")


def category_summary(scored: DataFrame) -> DataFrame:
    """Mean and best score, mean time, convergence share per category (M9)."""
    return scored.groupBy("category").agg(
        F.count("*").alias("n_runs"), F.avg("performance_score").alias("mean_score"), F.max("performance_score").alias("max_score"),
        F.avg("training_time").alias("mean_time"), (F.count_if("converged") * 100.0 / F.count("*")).alias("converged_pct"))


def top_runs(scored: DataFrame, n: int = 5, by: str = "performance_score") -> DataFrame:
    """The n best runs (O3)."""
    return scored.orderBy(F.desc(by), "run_id").limit(n)


def ordered_report(runs: DataFrame) -> DataFrame:
    """Converged first, then by displayed loss with infinity last."""
    r = display_metrics(runs)
    loss = F.coalesce(finite_or_null(F.col("display_loss")), F.lit(float("inf")))
    return r.orderBy(F.desc("converged"), loss, "run_id")


def by_iterations(runs: DataFrame) -> DataFrame:
    """Converged runs by iteration count, unknown last."""
    return runs.orderBy(F.desc("converged"), F.col("iterations").asc_nulls_last(), "run_id")


def parameter_points(scored: DataFrame, parameter: str = "learning_rate") -> DataFrame:
    """(parameter, score) points of the runs that have the parameter."""
    return scored.filter(F.col(parameter).isNotNull()).select("run_id", F.col(parameter).cast("double").alias("parameter"), "performance_score", "iterations")


def radar(runs: DataFrame, smaller_better: Sequence[str], larger_better: Sequence[str] = ()) -> DataFrame:
    """Rows (run_id, metric, value) scaled to 0..1: 1/(1+x) or min(x, 1), 0.5 when unknown."""
    cells = []
    for c in [*smaller_better, *larger_better]:
        x = F.col(c).cast("double")
        value = F.when(x > 0, 1 / (1 + x)).otherwise(1.0) if c in smaller_better else F.least(x, F.lit(1.0))
        cells.append(F.struct(F.lit(c).alias("metric"), F.when(x.isNull(), 0.5).otherwise(value).alias("value")))
    return runs.select("run_id", F.explode(F.array(*cells)).alias("x")).select("run_id", "x.*")


# Histories.


def with_cost_change(history: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Loss change against the previous record (E2) and the flag for a loss doubled over five records (E5)."""
    options = {"chunk_rows": chunk_rows} if chunk_rows else {}
    out = with_lags(history, ["run_id"], "iteration", {"__l1": ("loss", 1), "__l4": ("loss", 4)}, **options)
    return out.withColumns({"cost_change": F.col("loss") - F.col("__l1"),
                            "diverging": F.coalesce(F.col("loss") > 2 * F.col("__l4"), F.lit(False))}).drop("__l1", "__l4")


def with_minimum_so_far(history: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Running minimum of the loss and the minimum before the record."""
    options = {"chunk_rows": chunk_rows} if chunk_rows else {}
    return with_running_min(history, ["run_id"], "iteration", "loss", "min_loss", "previous_min", **options)


def history_facts(history: DataFrame) -> DataFrame:
    """Per run: length, first, last and best loss, improvement, reduction ratio, best iteration."""
    at = F.col("iteration")
    out = history.groupBy("run_id").agg(
        F.count("*").alias("history_length"), F.min_by("loss", at).alias("first_loss"), F.max_by("loss", at).alias("last_loss"),
        F.min("loss").alias("lowest_loss"), F.min(F.when(F.col("gradient_norm").isNotNull(), F.struct("gradient_norm", "iteration"))).alias("b"))
    return out.select("run_id", "history_length", "first_loss", "last_loss", "lowest_loss",
                      (F.col("first_loss") - F.col("last_loss")).alias("loss_improvement"),
                      F.try_divide(F.col("first_loss"), F.col("lowest_loss")).alias("loss_reduction_ratio"),
                      F.col("b.iteration").alias("best_iteration_by_gradient"), F.col("b.gradient_norm").alias("best_gradient"))


def with_history_facts(runs: DataFrame, history: DataFrame) -> DataFrame:
    """Runs with their history facts; a run without history keeps nulls."""
    return runs.join(history_facts(history), "run_id", "left")


def convergence_table(runs: DataFrame, history: DataFrame) -> DataFrame:
    """Long table of the histories that are finite throughout, with setup and family."""
    clean = finite_groups(history, ["run_id"], ["loss", "gradient_norm"])
    return clean.drop("setup", "family").join(runs.select("run_id", "setup", "family"), "run_id")


def requested_runs(requested: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested run ids that have a result, and those that have none (C4)."""
    have = runs.select("run_id")
    return requested.join(have, "run_id", "left_semi"), requested.join(have, "run_id", "left_anti")


def thin_history(history: DataFrame, every: int) -> DataFrame:
    """Every k-th iteration."""
    return history.filter(F.col("iteration") % every == 0)


def head_of_weights(runs: DataFrame, n: int = 50) -> DataFrame:
    return runs.withColumn("weights", F.slice("weights", 1, n))


def operations_to(history: DataFrame, runs: DataFrame) -> DataFrame:
    """Operations spent up to the converged iteration; `history` has an `operations` column per record."""
    limits = runs.select("run_id", F.col("iterations").alias("__k"), "converged")
    joined = history.join(limits, "run_id").filter(F.col("converged") & (F.col("iteration") <= F.col("__k")))
    return joined.groupBy("run_id").agg(F.sum("operations").alias("operations_to_convergence"))


def complexity_table(runs: DataFrame) -> DataFrame:
    """Evaluation counts, operations per iteration and per matrix cell, convergence efficiency."""
    cells = F.col("n") * F.col("n_features")
    return runs.select(
        "run_id", "function_evaluations", "gradient_evaluations", "total_operations",
        F.try_divide(F.col("total_operations"), F.col("final_iteration")).alias("operations_per_iteration"),
        F.try_divide(F.col("total_operations"), cells).alias("operations_per_cell"),
        F.when(F.col("converged"), F.try_divide(F.col("best_iteration"), F.greatest(F.col("final_iteration"), F.lit(1)))).alias("convergence_efficiency"))


def scalability(runs: DataFrame) -> DataFrame:
    """Degree-2 trend of operations over n*d."""
    return poly_fit(runs.withColumn("__size", F.col("n") * F.col("n_features")), "__size", "total_operations", 2)


def weight_points(runs: DataFrame) -> DataFrame:
    """Rows (run_id, record, n_records, iteration, position, n_weights, w) of the recorded weights."""
    records = runs.select("run_id", F.size("history").alias("n_records"), F.posexplode("history").alias("record", "h"))
    return records.select("run_id", "record", "n_records", F.col("h.iteration").alias("iteration"),
                          F.size("h.weights").alias("n_weights"), F.posexplode("h.weights").alias("position", "w"))


def active_weights(runs: DataFrame, k: int = 2) -> DataFrame:
    """Per run the k weights with the largest variance over all records times variance over the last half.

    The bias (last position) is left out when its variance is over ten times the mean of the others.
    """
    late = F.col("record") >= F.floor(F.col("n_records") / 2)
    var = weight_points(runs).groupBy("run_id", "position", (F.col("position") == F.col("n_weights") - 1).alias("is_bias")).agg(
        F.var_pop("w").alias("variance"), (F.var_pop("w") * F.var_pop(F.when(late, F.col("w")))).alias("activity"))
    others = F.avg(F.when(~F.col("is_bias"), F.col("variance")))
    rules = var.groupBy("run_id").agg((F.max(F.when(F.col("is_bias"), F.col("variance"))) > 10 * others).alias("skip_bias"), F.count("*").alias("d"))
    kept = var.join(rules, "run_id").filter(~(F.col("is_bias") & F.col("skip_bias") & (F.col("d") > 2)))
    best = F.slice(F.sort_array(F.collect_list(F.struct("activity", "position", "variance")), asc=False), 1, k)  # d rows per run
    return kept.groupBy("run_id").agg(best.alias("top")).select("run_id", F.explode("top").alias("t")).select(
        "run_id", "t.position", "t.activity", "t.variance")


def trajectory(runs: DataFrame, k: int = 2) -> DataFrame:
    """Paths of the most active weights, for plotting."""
    points = weight_points(runs).select("run_id", "iteration", "position", F.col("w").alias("weight"))
    return points.join(active_weights(runs, k).select("run_id", "position"), ["run_id", "position"], "left_semi")
