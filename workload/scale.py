"""Scalers and target transforms over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeworks.functions.vectors import standardise
from slopeworks.operators.scale import fit_scaler, log_target, original_target
from workload.registry import query, rounded, table

COLUMNS = ["l_quantity", "l_extendedprice", "one"]
# Shift and spread of each scaler; the third column is constant.
_RULES = {
    "standard": ("avg({c}) OVER ()", "stddev_pop({c}) OVER ()", "0"),
    "sample": ("avg({c}) OVER ()", "stddev_samp({c}) OVER ()", "1"),
    "minmax": ("min({c}) OVER ()", "max({c}) OVER () - min({c}) OVER ()", "1"),
    "robust": ("median({c}) OVER ()", "quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER ()", "1"),
}

for _kind, (_shift, _spread, _one) in _RULES.items():
    _cells = ", ".join(f"round(({c} - {_shift.format(c=c)}) / ({_spread.format(c=c)}), 6) + 0.0 AS {c}" for c in COLUMNS[:2])

    @query(f"scale_{_kind}", f"SELECT l_orderkey, l_linenumber, {_cells}, {_one}::DOUBLE AS one FROM lineitem")
    def scaled(spark, sf, kind=_kind):
        df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.lit(1.0).alias("one"))
        return rounded(fit_scaler(df, COLUMNS, kind).transform(df), 6, *COLUMNS)


@query("scale_stored", """
SELECT l_orderkey, l_linenumber, round((l_quantity - 25) / 14, 6) + 0.0 AS f0, round((l_tax - 0.5) / 1e-8, 2) + 0.0 AS f1 FROM lineitem""")
def stored(spark, sf):
    """Stored statistics; a zero deviation is replaced by the floor."""
    x = standardise(F.array("l_quantity", "l_tax"), [25.0, 0.5], [14.0, 0.0])
    out = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))
    out = out.select("l_orderkey", "l_linenumber", F.col("x")[0].alias("f0"), F.col("x")[1].alias("f1"))
    return rounded(rounded(out, 6, "f0"), 2, "f1")


@query("scale_log_target", "SELECT o_orderkey, round(ln(1 + o_totalprice), 8) AS label, round(o_totalprice, 4) AS target FROM orders")
def log(spark, sf):
    out = original_target(log_target(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice"))
    return rounded(rounded(out.drop("o_totalprice"), 8, "label"), 4, "target")


@query("vector_bias", "SELECT vec_id, len(embedding) + 1 AS length, 1.0::DOUBLE AS bias FROM embeddings")
def bias(spark, sf):
    """Every feature vector followed by a constant 1."""
    from slopeworks.functions.vectors import with_bias

    e = table(spark, sf, "embeddings").select("vec_id", with_bias(F.col("embedding").cast("array<double>")).alias("x"))
    return e.select("vec_id", F.size("x").cast("long").alias("length"), F.element_at("x", -1).alias("bias"))


@query("vector_head", "SELECT vec_id, 5::BIGINT AS kept, round(list_sum(embedding[1:5]::DOUBLE[]), 6) + 0.0 AS total FROM embeddings")
def head(spark, sf):
    """The first five weights of every vector."""
    from slopeworks.functions.vectors import array_sum
    from slopeworks.operators.experiments import head_of_weights

    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("weights"))
    out = head_of_weights(e, 5).select("vec_id", F.size("weights").cast("long").alias("kept"), array_sum(F.col("weights")).alias("total"))
    return rounded(out, 6, "total")
