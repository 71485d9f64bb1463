"""Preparation, run files, model state and streaming, end to end on small tables."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.operators import clean as C
from slopeworks.operators import encode as E
from slopeworks.operators import evaluate as V
from slopeworks.operators import experiments as X
from slopeworks.operators import impute as I
from slopeworks.operators import profile as P
from slopeworks.operators.gram import gram_stats, normal_equations
from slopeworks.operators.scale import fit_scaler
from slopeworks.plans import compare as CM
from slopeworks.plans.config import Setup
from slopeworks.plans.prepare import prepare_listings, quick_prepare
from slopeworks.plans.train import fit, fit_stats
from slopeworks.sources import runs as R
from slopeworks.sources import tables as S
from slopeworks.streaming import jobs as J


def raw_listings(n=300):
    rng = np.random.default_rng(7)
    makes = [f"make{i}" for i in range(12)]
    rows = []
    for i in range(n):
        year, hp = int(rng.integers(1995, 2021)), float(rng.integers(90, 400))
        rows.append({
            "price": float(2000 + 900 * (year - 1994) + 40 * hp + rng.normal() * 300), "year": year, "make_name": f" {makes[i % 12].upper()} ",
            "model_name": f"m{i % 25}", "body_type": ["Sedan", "SUV", "Van"][i % 3], "fuel_type": ["Gasoline", "Hybrid", None][i % 3] if i % 10 else None,
            "mileage": None if i % 13 == 0 else float(rng.integers(0, 200000)), "horsepower": None if i % 10 == 0 else hp,
            "engine_displacement": 2000.0 if i % 3 else None, "daysonmarket": int(rng.integers(1, 100)), "length": f"{180 + i % 9} in", "width": "70.5 in",
            "height": f"{60 + i % 5} in", "power": f"{int(hp)} hp @ 5,{i % 10}00 RPM", "owner_count": 1.0 if i % 3 == 0 else None, "is_new": bool(i % 2),
            "has_accidents": [True, False, None][i % 3], "frame_damaged": False, "fleet": None if i % 4 else True, "exterior_color": f"c{i}"})
    return pd.DataFrame(rows)


def listing_frame(spark, frame):
    types = {"price": "double", "year": "int", "mileage": "double", "horsepower": "double", "engine_displacement": "double", "daysonmarket": "int",
             "owner_count": "double", "is_new": "boolean", "has_accidents": "boolean", "frame_damaged": "boolean", "fleet": "boolean"}
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in frame.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"{c} {types.get(c, 'string')}" for c in frame.columns))


def test_clean_listings_rules(spark):
    def row(**k):
        return {"price": 100.0, "year": 2000, "mileage": 10.0, "tag": "x", **k}

    rows = [row(), row(), row(price=0.0), row(price=9e9), row(year=1899), row(year=2026), row(year=2025, tag="y"), row(mileage=None), row(mileage=500000.0),
            row(mileage=0.0, tag="z")]
    out = C.clean_listings(spark.createDataFrame([tuple(r.values()) for r in rows], "price double, year int, mileage double, tag string"), as_of=2024)
    assert sorted(r["tag"] for r in out.collect()) == ["x", "y", "z"]


def test_prepare_and_train(spark):
    prepared = prepare_listings(listing_frame(spark, raw_listings()), as_of=2021)
    m = prepared.matrix.persist()
    assert m.count() == m.select("row_id").distinct().count()
    meta = {r["split"]: r for r in S.matrix_metadata(m).collect()}
    assert meta["train"]["all_finite"] and meta["test"]["all_finite"] and meta["train"]["n_features"] == len(prepared.features)
    assert meta["test"]["n_rows"] == int(np.ceil(0.2 * m.count() - 1e-9))
    assert "price" not in prepared.features and not any("price_tier" in f for f in prepared.features)
    assert {"age", "vehicle_volume", "power_hp", "condition_score", "make_name_target_encoded"} <= set(prepared.features)
    d = len(prepared.features)
    wide = m.select("split", "label", *[F.col("features")[i].alias(f"f{i}") for i in range(d)])
    names = [f"f{i}" for i in range(d)]
    runs = fit(wide.filter("split = 'train'"), names, "label", [Setup(method="newton", loss="ridge", regularization=1e-3, check_every=1)])
    w = runs.first()["weights"]
    metrics = V.full_metrics(V.predict(wide.filter("split = 'test'"), names, w)).first()
    assert metrics["r2"] > 0.8
    m.unpersist()
    prepared.release()


def test_preparation_holds_the_coded_rows_for_its_last_fits(spark):
    prepared = prepare_listings(listing_frame(spark, raw_listings(60)), as_of=2021)
    assert set(prepared.features) <= set(prepared.kept.columns) and prepared.kept.storageLevel.useDisk
    assert "InMemoryTableScan" in prepared.matrix._jdf.queryExecution().executedPlan().toString()
    prepared.release()
    assert not prepared.kept.storageLevel.useDisk


def test_preparation_keeps_its_rows_on_disk_alone_and_in_short_batches(spark, monkeypatch):
    in_memory, persist, batch = [], DataFrame.persist, "spark.sql.inMemoryColumnarStorage.batchSize"

    def marked(df, *level):
        out = persist(df, *level)
        if out.storageLevel.useMemory:
            in_memory.append(df.columns)
        return out

    monkeypatch.setattr(DataFrame, "persist", marked)
    monkeypatch.setattr("slopeworks.plans.prepare.HELD_BATCH_ROWS", 7, raising=False)
    before = spark.conf.get(batch)
    raw = listing_frame(spark, raw_listings()).withColumn("seller_rating", F.lit(None))  # a column without a type
    prepared = prepare_listings(raw, as_of=2021)
    # The target of the trim bound and tables with one row a group or candidate, which have counts, are what memory may hold.
    assert [c for c in in_memory if len(c) > 1 and not {"n", "n_group"} & set(c)] == []
    assert not prepared.kept.storageLevel.useMemory
    held = spark._jsparkSession.sharedState().cacheManager().lookupCachedData(prepared.kept._jdf).get().cachedRepresentation()
    assert held.cacheBuilder().cachedColumnBuffers().count() >= prepared.kept.count() / 7
    assert spark.conf.get(batch) == before
    prepared.release()


def test_facts_of_many_columns_come_from_narrow_aggregates(spark, monkeypatch):
    wide = spark.range(9).select(*[F.when(F.col("id") >= k % 3, F.col("id") * 1.0 + k).alias(f"c{k}") for k in range(40)]).localCheckpoint()
    widths, agg = [], type(wide).agg
    monkeypatch.setattr(type(wide), "agg", lambda df, *e: widths.append(len(e)) or agg(df, *e))
    scaler = fit_scaler(wide, wide.columns)
    assert len(C.final_types(wide).columns) == 40
    assert widths and max(widths) <= 2 * P.FACTS_AT_ONCE
    values = {c: np.arange(int(c[1:]) % 3, 9) + float(c[1:]) for c in wide.columns}
    assert scaler.shift == pytest.approx({c: v.mean() for c, v in values.items()})
    assert scaler.scale == pytest.approx({c: v.std() for c, v in values.items()})


def test_smart_imputation_tiers(spark):
    rows = []
    for i in range(100):
        rows.append((f"g{i % 2}" if i % 25 else None, None if i % 33 == 0 else float(i), None if i % 10 == 0 else float(i), None if i % 3 == 0 else float(i),
                     None if i % 5 < 3 else 1.0, None if i % 20 == 0 else "b", None if i % 4 == 0 else "c"))
    df = spark.createDataFrame(rows, "g string, low double, mid double, high double, gone double, s_low string, s_high string")
    plan = I.fit_smart(df, group_cols=["g"])
    assert plan.dropped == ["gone"] and plan.flagged == ["high"] and list(plan.grouped) == ["mid"]
    out = plan.transform(df)
    pdf, src = out.toPandas(), df.toPandas()
    assert pdf[["low", "mid", "high", "s_low", "s_high"]].notna().all().all() and pdf["high_was_missing"].sum() == src["high"].isna().sum()
    known = src["mid"].dropna()
    assert sorted(set(pdf["mid"]) - set(known)) == sorted({*src.groupby("g")["mid"].median(), known.median()} - set(known))
    assert (pdf["s_high"] == "unknown").sum() == 25 and (pdf["s_low"] == "b").all()


def test_imputation_strategies_and_ties(spark):
    df = spark.createDataFrame([(1.0, "b"), (10.0, "a"), (None, None), (10.0, "a"), (1.0, "b")], "x double, s string")
    assert I.impute(df, "mode").filter("x = 1.0").count() == 3 and I.impute(df, "mode").filter("s = 'a'").count() == 3
    assert I.impute(df, "mean").filter("x = 5.5").count() == 1 and I.impute(df, "drop").count() == 4
    with pytest.raises(ValueError):
        I.impute(df, "magic")


def test_encoders_on_unseen_and_null_levels(spark):
    train = spark.createDataFrame([(f"k{i % 12}", float(i)) for i in range(60)], "k string, y double")
    table, overall = E.fit_target_encoding(train, "k", "y")
    new = spark.createDataFrame([("k0",), ("never",), (None,)], "k string")
    got = {r["k"]: r["k_target_encoded"] for r in E.apply_target_encoding(new, "k", table, overall).collect()}
    assert got["never"] == got[None] == overall and got["k0"] == pytest.approx((24.0 * 5 + overall * 30) / 35)
    coded = new.select(E.label_code("k", ["k0", "k1"])).collect()
    assert [r[0] for r in coded] == [0, None, None]
    with pytest.raises(ValueError, match="more than"):
        E.levels_of(train, "k", max_levels=5)


def test_scalers_on_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    for kind, x in (("standard", [-1.0, 1.0]), ("minmax", [0.0, 1.0]), ("sample", [-(0.5**0.5), 0.5**0.5]), ("robust", [-1.0, 1.0])):
        out = fit_scaler(df, ["x", "c"], kind).transform(df).orderBy("x").collect()
        assert np.allclose([r["x"] for r in out], x)
        assert {r["c"] for r in out} == ({0.0} if kind == "standard" else {5.0})


def test_constant_and_empty_columns_in_reports(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (1.0, None, "b")], "x double, z double, s string")
    assert {(r["issue"], r["column"]) for r in P.quality_issues(df).collect()} == {("constant", "x"), ("constant", "z"), ("mostly_null", "z")}
    assert C.final_types(df).columns == ["x"]
    summary = {r["column"]: r for r in P.numeric_summary(df).collect()}
    assert summary["z"]["count"] == 0 and summary["z"]["distinct_count"] == 0 and summary["z"]["median"] is None
    assert P.correlations(df, ["x", "z"]).first()["r"] is None
    assert sum(r["n"] for r in P.histogram(df, "x", 5).collect()) == 2
    assert quick_prepare(df, "x").columns == ["x"]


def test_metrics_edge_cases(spark):
    same = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    assert V.regression_metrics(same).first()["r2"] == 1.0
    assert V.regression_metrics(same.withColumn("prediction", F.lit(1.0))).first()["r2"] == 0.0
    zero = spark.createDataFrame([(0.0, 0.0), (float(np.log1p(10.0)), float(np.log1p(5.0)))], "label double, prediction double")
    assert V.full_metrics(zero).first()["mape"] == pytest.approx(50.0)


def test_matrix_round_trip_and_checks(spark, tmp_path):
    good = spark.createDataFrame([(1, "train", [1.0], 0.5), (2, "test", [2.0], 0.6)], "row_id long, split string, features array<double>, label double")
    S.write_matrix(good, str(tmp_path / "m"))
    train, test = S.read_matrix(spark, str(tmp_path / "m"))
    assert train.count() == test.count() == 1
    with pytest.raises(ValueError, match="empty"):
        S.write_matrix(good.filter("split = 'train'"), str(tmp_path / "one"))
    ragged = good.withColumn("features", F.when(F.col("row_id") == 1, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.col("features")))
    with pytest.raises(Exception, match="feature count"):
        S.write_matrix(ragged, str(tmp_path / "ragged"))


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A,B\n1,x\n2,\n3,z\n")
    df = S.read_table(spark, str(tmp_path / "a.csv"), "a int, b string", ["a"], max_rows=2, order_by=["a"])
    assert [r["a"] for r in df.collect()] == [1, 2]
    with pytest.raises(ValueError, match="schema"):
        S.read_table(spark, str(tmp_path / "a.csv"))


def test_model_state_round_trip_scores_the_same(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 5), 2.0 * i - i % 5) for i in range(40)], "a double, b double, y double")
    scaler = fit_scaler(df, ["a", "b"])
    model = normal_equations(gram_stats(scaler.transform(df), ["a", "b"], "y")).select(F.lit("r1").alias("run_id"), F.lit("ols").alias("algorithm"), "weights")
    S.save_state(S.model_state(df, model, ["a", "b"], "y"), str(tmp_path / "s"))
    stored = S.load_state(spark, str(tmp_path / "s"), "r1")
    out = V.score_table(df.withColumn("x", F.array("a", "b")), "x", stored, "r1")
    assert out.agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1e-8


def write_run(root, family, setup, result, history=None):
    folder = root / family / setup
    os.makedirs(folder)
    (folder / "results.json").write_text(result if isinstance(result, str) else json.dumps(result))
    if history:
        (folder / "training_history.csv").write_text(history)


def test_run_files_of_all_layouts(spark, tmp_path):
    nested = {"algorithm": "Gradient Descent - OLS", "loss_function": "OLS", "parameters": {"learning_rate": 0.1, "max_iterations": 100},
              "training_results": {"training_time": 2.0, "converged": True, "final_iteration": 40, "final_loss": 0.5, "final_gradient_norm": 0.1,
                                   "best_loss": 0.4, "best_iteration": 30, "best_gradient_norm": 0.05},
              "computational_complexity": {"basic_metrics": {"function_evaluations": 10, "gradient_evaluations": 40, "total_operations": 900}}}
    write_run(tmp_path, "gradient_descent", "a", nested, "iteration,loss,gradient_norm\n0,3.0,1.0\n10,0.5,0.1\n")
    write_run(tmp_path, "gradient_descent", "b", '{"algorithm": "GD", "training_results": {"final_loss": Infinity, "converged": false, "training_time": 1.0}}',
              "iteration,loss,gradient_norm,velocity_norm\n0,1.0,1.0,0.1\n1,inf,2.0,0.2\n")
    write_run(tmp_path, "stochastic_gd", "c", {"training_results": {"final_epoch": 9, "final_cost": 0.7, "training_time": 4.0}}, "epoch,loss,gradient_norm\n0,2.0,1.0\n9,0.7,0.2\n")
    write_run(tmp_path, "subgradient", "d", {"algorithm": "Sub", "training_time": 8.0, "convergence": {"converged": False, "iterations": 7, "final_loss": 1.5}})
    write_run(tmp_path, "stochastic_gd", "e", {"training_time_seconds": 0.5, "final_iterations": 6, "final_loss": 1e21, "converged": True})
    write_run(tmp_path, "gradient_descent", "broken", '{"weights": ')
    runs = R.read_runs(spark, f"{tmp_path}/*/*/results.json").persist()
    got = {r["setup"]: r for r in runs.collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    assert (got["a"]["iterations"], got["a"]["learning_rate"], got["a"]["best_loss"], got["a"]["total_operations"]) == (40, 0.1, 0.4, 900)
    assert got["b"]["final_loss"] == float("inf") and got["c"]["iterations"] == 9 and got["c"]["final_loss"] == 0.7
    assert got["d"]["training_time"] == 8.0 and got["d"]["iterations"] == 7 and got["e"]["iterations"] == 6 and got["e"]["converged"]
    history = R.read_histories(spark, f"{tmp_path}/*/*/training_history.csv")
    assert history.count() == 6 and history.filter("velocity_norm is not null").count() == 2
    assert {r["run_id"] for r in history.filter("iteration = 9").collect()} == {"stochastic_gd/c"}
    reports = CM.compare_files(spark, f"{tmp_path}/*/*/results.json", f"{tmp_path}/*/*/training_history.csv")
    assert {r["run_id"] for r in reports["convergence"].select("run_id").distinct().collect()} == {"gradient_descent/a", "stochastic_gd/c"}
    scored = {r["setup"]: r for r in reports["comparison"].collect()}
    assert scored["a"]["performance_score"] > 40 and scored["b"]["efficiency_score"] == 0 and scored["a"]["convergence_rate"] == pytest.approx(2.5 / 40)
    assert scored["d"]["category"] == "Other" and scored["d"]["convergence_rate"] == 0
    CM.write_reports(reports, str(tmp_path / "reports"))
    assert spark.read.json(str(tmp_path / "reports" / "summary")).first()["n_runs"] == 5
    runs.unpersist()


def test_equal_times_score_zero(spark):
    runs = spark.createDataFrame([("a", "x", True, 1.0, 2.0, 5), ("b", "x", False, 1.0, 2.0, 5)],
                                 "run_id string, family string, converged boolean, final_loss double, training_time double, iterations int")
    assert {r["run_id"]: r["performance_score"] for r in X.with_scores(runs).collect()} == {"a": 40.0, "b": 0.0}


def test_report_orders(spark):
    rows = [("a", False, 1.0, 3), ("b", True, float("inf"), None), ("c", True, 0.5, 9), ("d", True, 0.5, 2), ("e", False, float("inf"), 1)]
    runs = spark.createDataFrame(rows, "run_id string, converged boolean, final_loss double, iterations int").withColumns(
        {"best_loss": F.lit(None).cast("double"), "best_gradient_norm": F.lit(None).cast("double"), "best_iteration": F.lit(None).cast("int"),
         "final_gradient_norm": F.lit(0.1)})
    assert [r["run_id"] for r in X.ordered_report(runs).collect()] == ["c", "d", "b", "a", "e"]
    assert [r["run_id"] for r in X.by_iterations(runs).collect()] == ["d", "c", "b", "e", "a"]


def test_unknown_values_do_not_win(spark):
    rows = [("a", True, None, 1.0), ("b", True, 0.3, None), ("c", True, 0.2, 5.0)]
    runs = spark.createDataFrame(rows, "run_id string, converged boolean, final_gradient_norm double, training_time double").withColumns(
        {"final_loss": F.lit(1.0), "iterations": F.lit(4), "best_loss": F.lit(None).cast("double"), "best_gradient_norm": F.lit(None).cast("double"),
         "best_iteration": F.lit(None).cast("int")})
    got = {r["reason"]: r["run_id"] for r in X.recommended_runs(runs).collect()}
    assert got["smallest_gradient"] == "c" and got["fastest"] == "a" and got["lowest_loss"] == "a"
    assert X.run_summary(runs).first()["fastest_run"] == "a"


def test_written_runs_read_back(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    runs = R.as_comparison_runs(fit_stats(gram_stats(df, ["x"], "y"), [Setup(method="newton", check_every=1), Setup(setup="b", method="bfgs", check_every=1)]))
    R.write_runs(runs, str(tmp_path / "r"))
    stored, history = R.read_written_runs(spark, str(tmp_path / "r"))
    assert stored.count() == 2 and history.select("run_id").distinct().count() == 2 and X.history_facts(history).count() == 2
    assert CM.compare_runs(stored, history)["families"].count() == 2


def test_active_weights_leave_out_a_dominant_bias(spark):
    history = [(i, 0.0, 0.0, 0.0, [0.1 * i, 0.2 * i, 0.0, 100.0 * i]) for i in range(6)]
    runs = spark.createDataFrame([("r", history)], "run_id string, history array<struct<iteration:int,loss:double,gradient_norm:double,step_size:double,weights:array<double>>>")
    assert [r["position"] for r in X.active_weights(runs).orderBy(F.desc("activity")).collect()] == [1, 0]
    assert X.trajectory(runs).count() == 12


def test_streaming_statistics_are_idempotent(spark, tmp_path):
    frame = pd.DataFrame({"x": np.arange(30.0), "y": 3 + 2 * np.arange(30.0)})
    src = tmp_path / "in"
    os.makedirs(src)
    for i in range(3):
        spark.createDataFrame(frame[i * 10:(i + 1) * 10]).coalesce(1).write.mode("append").parquet(str(src))
    stream = J.read_stream(spark, str(src), spark.read.parquet(str(src)).schema, files_per_batch=1)
    path, ckpt = str(tmp_path / "stats"), str(tmp_path / "ckpt")
    J.accumulate_stats(stream, ["x"], "y", path, ckpt).awaitTermination()
    before = J.current_model(spark, path).first()
    assert before["n"] == 30 and np.allclose(before["weights"], [2, 3])
    # The same batch again, as after a restart: its partition is overwritten.
    again = gram_stats(spark.read.parquet(path).limit(0).selectExpr("1.0D as x", "1.0D as y"), ["x"], "y")
    assert again.count() == 1
    kept = spark.read.parquet(path).filter("batch_id = 0").persist()
    kept.count()
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream_id", "batch_id").parquet(path)
    assert J.current_model(spark, path).first()["n"] == 30
    J.accumulate_stats(stream, ["x"], "y", path, ckpt).awaitTermination()  # nothing new: nothing changes
    assert J.current_model(spark, path).first()["n"] == 30
    kept.unpersist()


def test_streams_of_two_checkpoints_add_up_and_compact(spark, tmp_path):
    from slopeworks.streaming import jobs as J

    for k in range(2):
        spark.createDataFrame([(float(i), 2.0 * i + k) for i in range(10)], "x double, y double").coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        stream = J.read_stream(spark, f"{tmp_path}/in{k}", "x double, y double")
        J.accumulate_stats(stream, ["x"], "y", f"{tmp_path}/stats", f"{tmp_path}/checkpoint{k}").awaitTermination()
    both = J.current_model(spark, f"{tmp_path}/stats").first()
    assert both["n"] == 20 and both["weights"] == pytest.approx([2.0, 0.5])
    J.compact_stats(spark, f"{tmp_path}/stats", f"{tmp_path}/compact")
    assert J.current_model(spark, f"{tmp_path}/compact").first()["weights"] == pytest.approx([2.0, 0.5])
