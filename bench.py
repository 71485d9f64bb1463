"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "profile_overview", "profile_target_statistics", "profile_numeric_summary", "profile_correlations", "profile_categorical_summary",
    "profile_quality_report", "clean_listings", "clean_text_columns", "impute_smart", "features_basic", "features_interaction",
    "encode_by_cardinality", "scale_standard", "split_exact", "gram_cells_grouped", "gram_cells_by_blocks", "regression_by_group",
    "train_gd_constant", "train_momentum", "train_newton", "train_lbfgs", "train_by_group", "train_sgd_constant", "train_grid_sweep",
    "evaluate_full", "runs_comparison", "history_cost_change", "results_flattened",
]


def reference_scale_training(spark, sf: str) -> dict[str, float]:
    """Training on 62 features of every line item, the width of the published runs (they used 100,000 rows)."""
    from pyspark.sql import functions as F

    from slopeworks.operators.gram import gram_stats
    from slopeworks.operators.scale import fit_scaler
    from slopeworks.plans.config import Setup
    from slopeworks.plans.sgd import SgdSetup, fit_sgd
    from slopeworks.plans.train import fit_stats

    base = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey", "l_partkey"]
    # The test file is one row group and would be one task; a real table has many.
    li = spark.read.parquet(f"{sf}/lineitem.parquet").repartition(spark.sparkContext.defaultParallelism)
    # Six columns of the table and 56 independent ones from hashes of the row: a regular matrix, as real features give.
    draw = lambda k: F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", F.lit(k)), F.lit(1_000_003)) / 1_000_003.0
    wide = li.select(F.log1p("l_extendedprice").alias("y"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("row_id"), *[
        (F.col(base[k]).cast("double") if k < 6 else draw(k)).alias(f"f{k}") for k in range(62)])
    features = [f"f{k}" for k in range(62)]
    out = {}
    started = time.time()
    scaled = fit_scaler(wide, features).transform(wide)  # its pass is part of the time
    stats = gram_stats(scaled, features, "y").persist()
    stats.count()
    out["wide_statistics_pass_62_features"] = time.time() - started
    for name, setup in {
        "wide_gd_10000_iterations": Setup(method="gd", learning_rate=0.1, tolerance=0.0), "wide_momentum": Setup(method="momentum", learning_rate=0.1),
        "wide_gd_backtracking": Setup(method="gd", step="backtracking", learning_rate=1.0), "wide_newton": Setup(method="newton", check_every=1, tolerance=1e-10),
        "wide_bfgs": Setup(method="bfgs", check_every=1), "wide_lbfgs": Setup(method="lbfgs", check_every=1),
        "wide_subgradient": Setup(method="subgradient", loss="l1", step="diminishing", regularization=0.1, max_iter=750, check_every=1),
    }.items():
        started = time.time()
        fit_stats(stats, [setup]).drop("history").collect()
        out[name] = time.time() - started
    started = time.time()
    fit_sgd(scaled, features, "y", "row_id", SgdSetup(batch_size=256, order="once", epochs=100, learning_rate=0.001), mode="exact")[0].collect()
    out["wide_sgd_100_epochs"] = time.time() - started
    stats.unpersist()
    return out


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from slopeworks.session import local_session
    from workload import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # starts the JVM and the workers
    spark.range(8).repartition(8).mapInPandas(lambda it: it, "id long").collect()
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    seconds.update({k: round(v, 3) for k, v in reference_scale_training(spark, sf).items()})
    print(json.dumps({"metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
