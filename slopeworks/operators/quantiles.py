"""Exact quantiles with linear interpolation, global or per group. Nulls and NaN are ignored.

Spark's `percentile` keeps a map of all distinct values of a group in one task, which neither a whole column nor a
hot group fits at scale.

Global: one sketch a column brackets all wanted ranks, and one pass counts the rows below each bracket and at its
ends and takes up the few values between, from which the wanted ones are picked; two scans in all. Where more values
lie between than a task should hold, rows are counted first and wide brackets are narrowed again. The counts prove
that the rank is inside, so the result is exact whatever the sketch did.

Per group: `percentile` for groups within `one_pass_rows`. Larger groups are counted: values fall into
order-preserving buckets (logarithmic, then linear inside a bucket), only the buckets that hold a wanted rank are
opened, and inside them equal values are counted together, so that no task holds a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeworks.operators.joins import lookup_join
from slopeworks.operators.sketches import rank_error, sketch_columns, sketched_quantiles

ONE_PASS_ROWS = 2_000_000
ACCURACY = 10_000
PER_OCTAVE = 256  # logarithmic buckets per doubling of |value|
SUB_BUCKETS = 4096


def _value(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def between(v: Column, lo: float, hi: float) -> Column:
    """An aggregate: the rows below a bracket, at its ends, and the values between them."""
    return F.struct(F.count_if(v < lo).alias("below"), F.count_if(v == lo).alias("at_lo"), F.count_if(v == hi).alias("at_hi"),
                    F.collect_list(F.when((v > lo) & (v < hi), v)).alias("inside"))


def picked(seen: DataFrame, targets: Sequence[tuple[str, float, float, float]]) -> list[float | None]:
    """The interpolated values at (column of `between`, lo, hi, position) of a one-row frame; None where a rank lies outside of
    its bracket. Each target becomes a row, so that one expression serves all."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(name).alias("s"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.lit(math.floor(pos)).cast("long").alias("low"),
                              F.lit(math.ceil(pos)).cast("long").alias("high"), F.lit(pos - math.floor(pos)).alias("frac")) for k, (name, lo, hi, pos) in enumerate(targets)])
    t = seen.select(F.explode(rows).alias("t")).select("t.*", F.sort_array("t.s.inside").alias("inside"))

    def at(rank: str) -> Column:
        place = F.col(rank) - F.col("s.below") - F.col("s.at_lo")
        last = F.size("inside") + F.when(F.col("lo") == F.col("hi"), F.lit(0)).otherwise(F.col("s.at_hi"))
        within = F.get("inside", F.greatest(place, F.lit(0)).cast("int"))
        return F.when(F.col(rank) >= F.col("s.below"), F.when(place < 0, F.col("lo")).when(place < F.size("inside"), within).when(place < last, F.col("hi")))

    ends = t.select("k", "frac", at("low").alias("a"), at("high").alias("b"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("frac"))
    found = {r["k"]: r["v"] for r in ends.select("k", value.alias("v")).collect()}  # one row for each target
    return [found[k] for k in range(len(targets))]


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], group_cols: Sequence[str] = (),
                    one_pass_rows: int = ONE_PASS_ROWS, reuse: bool = False, accuracy: int = ACCURACY) -> DataFrame:
    """Rows (group..., column, p, value); a column without values has no row.

    Global quantiles run a few small jobs here. With `reuse` the needed columns are kept meanwhile: for frames that
    are more than a scan.
    """
    columns, probs, groups = list(columns), sorted({float(p) for p in probs}), list(group_cols)
    if not groups:
        return _bracketed(df, columns, probs, max(one_pass_rows, accuracy), reuse, accuracy)
    sizes = df.groupBy(*groups).agg(F.count("*").alias("__n"))
    hot = sizes.filter(F.col("__n") > one_pass_rows).drop("__n")
    if hot.isEmpty():
        return _one_pass(df, columns, probs, groups)
    same = reduce(lambda a, b: a & b, [F.col(f"d.{g}").eqNullSafe(F.col(f"h.{g}")) for g in groups])
    pair = (df.alias("d"), hot.alias("h"), same)
    return _one_pass(pair[0].join(*pair[1:], "left_anti"), columns, probs, groups).unionByName(
        _counted(pair[0].join(*pair[1:], "left_semi"), columns, probs, groups))


def _bracketed(df: DataFrame, columns: list[str], probs: list[float], few_rows: int, reuse: bool, accuracy: int) -> DataFrame:
    x = df.select(*[_value(c).alias(c) for c in columns])
    x = x.persist(StorageLevel.MEMORY_AND_DISK) if reuse else x
    size = max(8, min(65_535, int(0.4 * accuracy)))
    step = rank_error(size)

    def around(p: float) -> list[float]:
        return [max(0.0, p - step), min(1.0, p + step)]

    def approx(values: Column, ps: list[float]) -> Column:
        sketch = F.kll_sketch_agg_double(values, F.lit(size))
        return F.when(F.count(values) > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(q) for q in ps])))

    try:
        first = x.agg(*[a for c in columns for a in (
            F.count(c).alias(f"n_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"),
            approx(F.col(c), [q for p in probs for q in around(p)]).alias(f"a_{c}"))]).first()
        targets = []
        for c in columns:
            n = first[f"n_{c}"]
            for i, p in enumerate(probs if n else []):
                lo, hi = first[f"a_{c}"][2 * i], first[f"a_{c}"][2 * i + 1]
                lo = first[f"lo_{c}"] if around(p)[0] == 0.0 else lo
                hi = first[f"hi_{c}"] if around(p)[1] == 1.0 else hi
                targets.append({"c": c, "p": p, "n": n, "pos": p * (n - 1), "lo": lo, "hi": hi,
                                "outer": (first[f"lo_{c}"], first[f"hi_{c}"])})
        if targets and sum(4 * step * t["n"] for t in targets) <= few_rows:
            seen = x.agg(*[between(F.col(t["c"]), t["lo"], t["hi"]).alias(f"s{i}") for i, t in enumerate(targets)])
            values = picked(seen, [(f"s{i}", t["lo"], t["hi"], t["pos"]) for i, t in enumerate(targets)])
            done = [(t["c"], t["p"], v) for t, v in zip(targets, values)]
            if all(v is not None for _, _, v in done):
                return df.sparkSession.createDataFrame(done, "column string, p double, value double")
        open_targets = list(targets)
        while open_targets:
            counts = x.agg(*[a for i, t in enumerate(open_targets) for a in (
                F.count_if(F.col(t["c"]) < t["lo"]).alias(f"b{i}"), F.count_if(F.col(t["c"]).between(t["lo"], t["hi"])).alias(f"i{i}"),
                F.count_if((F.col(t["c"]) > t["lo"]) & (F.col(t["c"]) < t["hi"])).alias(f"m{i}"))]).first()
            wide, missed = [], []
            for i, t in enumerate(open_targets):
                t["below"], t["inside"] = counts[f"b{i}"], counts[f"i{i}"]
                if not (t["below"] <= math.floor(t["pos"]) and math.ceil(t["pos"]) < t["below"] + t["inside"]):
                    # The rank is on the missed side, inside the last bracket that held it.
                    low, high = t["outer"]
                    t["lo"], t["hi"] = (low, t["lo"]) if math.floor(t["pos"]) < t["below"] else (t["hi"], high)
                    missed.append(t)
                elif counts[f"m{i}"] > few_rows and t.get("tried") != (t["lo"], t["hi"]):
                    t["outer"] = (t["lo"], t["hi"])
                    # Copies of the end values count once in the map of `percentile`, so only the rows between matter.
                    t["tried"] = (t["lo"], t["hi"])
                    wide.append(t)
            if wide:
                inner = [max(0.0, min(1.0, (t["pos"] - t["below"]) / max(t["inside"] - 1, 1))) for t in wide]
                narrowed = x.agg(*[approx(F.when(F.col(t["c"]).between(t["lo"], t["hi"]), F.col(t["c"])), around(q)).alias(f"a{i}")
                                   for i, (t, q) in enumerate(zip(wide, inner))]).first()
                for i, (t, q) in enumerate(zip(wide, inner)):
                    t["lo"] = narrowed[f"a{i}"][0] if around(q)[0] > 0.0 else t["lo"]
                    t["hi"] = narrowed[f"a{i}"][1] if around(q)[1] < 1.0 else t["hi"]
            open_targets = wide + missed
        found = []
        if targets:
            row = x.agg(*[F.percentile(F.when(F.col(t["c"]).between(t["lo"], t["hi"]), F.col(t["c"])),
                                       F.lit(min(1.0, (t["pos"] - t["below"]) / max(t["inside"] - 1, 1)))).alias(f"v{i}")
                          for i, t in enumerate(targets)]).first()
            found = [(t["c"], t["p"], row[f"v{i}"]) for i, t in enumerate(targets)]
    finally:
        if reuse:
            x.unpersist()
    return df.sparkSession.createDataFrame(found, "column string, p double, value double")


def _one_pass(df, columns, probs, groups):
    wanted = F.array(*[F.lit(p) for p in probs])
    wide = df.groupBy(*groups).agg(*[F.percentile(_value(c), wanted).alias(c) for c in columns])
    cells = [F.struct(F.lit(c).alias("column"), F.lit(p).alias("p"), F.col(c)[i].alias("value"))
             for c in columns for i, p in enumerate(probs)]
    long = wide.select(*groups, F.explode(F.array(*cells)).alias("cell"))
    return long.select(*groups, "cell.*").filter(F.col("value").isNotNull())


def _rank_targets(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds the 0-based rank range [start, end) and the total of each key to rows that carry a count `n`."""
    by = Window.partitionBy(*keys)
    end = F.sum("n").over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumns({"end": end, "total": F.sum("n").over(by)}).withColumn("start", F.col("end") - F.col("n"))


def _opened(ranked: DataFrame, targets) -> DataFrame:
    """One row for every wanted rank that falls into the row's range; `rank` becomes relative to it."""
    inside = F.filter(targets, lambda t: (t.rank >= F.col("start")) & (t.rank < F.col("end")))
    out = ranked.withColumn("t", F.explode(inside))
    return out.withColumn("rank", F.col("t.rank") - F.col("start"))


def _counted(df, columns, probs, groups):
    keys = [*groups, "column"]
    long = df.select(*groups, *[_value(c).alias(c) for c in columns]).unpivot(
        groups, columns, "column", "value").filter(F.col("value").isNotNull())
    # A null group key is a group of its own here, so joins below use a null-safe stand-in.
    safe = {g: F.coalesce(F.concat(F.lit("v"), F.col(g).cast("string")), F.lit("n")) for g in groups}
    long = long.withColumns({f"__{g}": e for g, e in safe.items()}) if safe else long
    skeys = [f"__{g}" for g in groups] + ["column"]

    v = F.col("value")
    logarithmic = (F.signum(v) * F.floor(F.log2(F.abs(v) + 1.0) * PER_OCTAVE)).cast("long")
    extreme = F.when(v == float("inf"), F.lit(2**39)).when(v == float("-inf"), F.lit(-(2**39)))
    long = long.withColumn("bucket", F.coalesce(extreme, logarithmic))

    carried = [F.first(g).alias(g) for g in groups]
    hist = long.groupBy(*skeys, "bucket").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), *carried)
    ranked = _rank_targets(hist, skeys, "bucket")
    pos = lambda p: F.lit(float(p)) * (F.col("total") - 1)
    wanted = F.array(*[
        F.struct(F.lit(float(p)).alias("p"), F.lit(side).alias("side"), (pos(p) - F.floor(pos(p))).alias("frac"),
                 (F.floor(pos(p)) if side == 0 else F.ceil(pos(p))).cast("long").alias("rank"))
        for p in probs for side in (0, 1)])
    first = _opened(ranked, wanted).select(*groups, *skeys, "bucket", "lo", "hi", "t.p", "t.side", "t.frac", "rank")
    opened = first.groupBy(*skeys, "bucket").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))

    rows = lookup_join(long.select(*skeys, "bucket", "value"), opened, [*skeys, "bucket"], "inner")
    span = F.col("hi") - F.col("lo")
    place = F.floor(F.try_divide(v - F.col("lo"), span) * (SUB_BUCKETS - 1))
    sub = F.when((span > 0) & (span < float("inf")), place).otherwise(F.lit(0)).cast("int")
    counts = rows.groupBy(*skeys, "bucket", sub.alias("sub"), "value").agg(F.count("*").alias("n"))

    at = [*skeys, "bucket"]
    subs = _rank_targets(counts.groupBy(*at, "sub").agg(F.sum("n").alias("n")), at, "sub")
    wanted_here = first.groupBy(*at).agg(F.collect_list(F.struct("p", "side", "frac", "rank", *groups)).alias("ts"))
    second = _opened(subs.join(wanted_here, at), F.col("ts")).select(
        *at, "sub", "t.p", "t.side", "t.frac", *[F.col(f"t.{g}").alias(g) for g in groups], "rank")
    wanted_sub = second.groupBy(*at, "sub").agg(F.collect_list(F.struct("p", "side", "frac", "rank", *groups)).alias("ts"))
    values = _rank_targets(counts.join(wanted_sub.select(*at, "sub"), [*at, "sub"], "left_semi"), [*at, "sub"], "value")
    third = _opened(values.join(wanted_sub, [*at, "sub"]), F.col("ts"))
    sides = third.groupBy(*skeys, F.col("t.p").alias("p")).agg(
        F.max(F.when(F.col("t.side") == 0, v)).alias("below"), F.max(F.when(F.col("t.side") == 1, v)).alias("above"),
        F.first("t.frac").alias("frac"), *[F.first(f"t.{g}").alias(g) for g in groups])
    value = F.when(F.col("frac") == 0, F.col("below")).otherwise(
        F.col("below") * (1 - F.col("frac")) + F.col("above") * F.col("frac"))
    return sides.select(*groups, "column", "p", value.alias("value"))


def quantile_columns(df: DataFrame, wanted: dict[str, tuple[str, float]], group_cols: Sequence[str] = (),
                     **quantile_options) -> DataFrame:
    """Wide form: one row per group, `wanted` maps an output name to (column, probability)."""
    columns = sorted({c for c, _ in wanted.values()})
    long = exact_quantiles(df, columns, [p for _, p in wanted.values()], group_cols, **quantile_options)
    picks = [F.max(F.when((F.col("column") == c) & (F.col("p") == float(p)), F.col("value"))).alias(name)
             for name, (c, p) in wanted.items()]
    return long.groupBy(*group_cols).agg(*picks)


def quantile_values(df: DataFrame, wanted: dict[str, tuple[str, float]], **quantile_options) -> dict[str, float]:
    """Global quantiles as plain numbers; a column without values gives None."""
    columns = sorted({c for c, _ in wanted.values()})
    rows = exact_quantiles(df, columns, [p for _, p in wanted.values()], **quantile_options).collect()  # one row per wanted value
    found = {(r["column"], r["p"]): r["value"] for r in rows}
    return {name: found.get((c, float(p))) for name, (c, p) in wanted.items()}


def approximate_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                          group_cols: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Long form from one sketch a group and column, for callers that accept a rank error of about 40/accuracy; the ends are exact."""
    size = max(8, min(65_535, int(0.4 * accuracy)))
    return sketched_quantiles(sketch_columns(df, list(columns), group_cols, kll_size=size), probs, group_cols)
