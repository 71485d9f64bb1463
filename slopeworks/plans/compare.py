"""The comparison job (Entry 3): run files to report tables, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slopeworks.operators import experiments as X
from slopeworks.sources.runs import Batch, read_histories, read_runs
from slopeworks.sources.tables import write_report


def compare_files(spark: SparkSession, results: str, histories: str | None = None) -> dict[str, DataFrame]:
    runs = read_runs(spark, results).persist()  # one row per run
    history = read_histories(spark, histories) if histories else None
    return compare_runs(runs, history)


def compare_runs(runs: DataFrame, history: DataFrame | None = None) -> dict[str, DataFrame]:
    """All report tables of a set of runs."""
    scored = X.comparison_table(runs, history)
    reports = {
        "summary": X.run_summary(runs), "families": X.family_breakdown(runs), "recommended": X.recommended_runs(runs),
        "comparison": scored, "categories": X.category_summary(scored), "top": X.top_runs(scored), "ordered": X.ordered_report(runs),
    }
    if "learning_rate" in runs.columns:
        reports["learning_rate"] = X.parameter_points(scored)
    if history is not None:
        reports["convergence"] = X.convergence_table(runs, history)
    return reports


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    for name, df in reports.items():
        write_report(df, f"{path}/{name}")


def store_reports(runs: DataFrame, path: str, history: DataFrame | None = None, batch: str | None = None) -> None:
    """All report tables of a set of runs as one batch of a store; `read_committed` reads them."""
    with Batch(runs.sparkSession, path, batch) as b:
        for name, df in compare_runs(runs, history).items():
            b.store(df, name)
