"""Exact quantiles by distributed selection: no task holds a group's values.

A group's values are counted by ranges that cover the doubles, then only the ranges in which a wanted rank lies
are cut again between the least and the greatest value they hold, until a range is one value, or has so few rows that
its values can be put in order. What passes from round to round is a table of at most two ranges for each
wanted quantile of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import order_bucket
from .steps import stored

#: A range of no more rows is finished by ordering its values; a larger one is cut in SPLITS.
FINISH_ROWS, SPLITS = 50_000, 4096


def _first_range(value: Column) -> Column:
    """A number that never falls as value rises; NaN, the greatest, and the infinities are alone in theirs."""
    return F.when(F.isnan(value), F.lit(1 << 20)).otherwise(order_bucket(value))


def _with_ranks(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Of parts (keys, _from, _part, before, ranks, total, n, low, high), those in which one of the ranks of their range lies."""
    upto = F.sum("n").over(Window.partitionBy(*keys, "_from").orderBy("_part"))
    placed = parts.withColumn("upto", F.col("before") + upto).withColumn("before", F.col("upto") - F.col("n"))
    held = placed.withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("upto"))))
    return held.where(F.size("ranks") > 0).select(*keys, "low", "high", "before", "n", "rows", "total", "ranks")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, points: list[float], weight: str | None = None, finish_rows: int = FINISH_ROWS, small: bool = False) -> DataFrame:
    """(keys, q, n): the array of quantiles at points, interpolated between neighbouring ranks, and the number of
    values that aren't null. A row counts weight times. Groups without a value are left out; null keys are a group.

    rows is read once a round: a group of any number of rows takes two or three, for each cuts the ranges some
    thousandfold. Who knows rows to be few (finish_rows at most) says small: they are put in order at once, without rounds."""
    group, plain = keys or ["_all"], rows.withColumn("_all", F.lit(1)) if not keys else rows
    plain = plain.select(*group, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w")).where("_v IS NOT NULL AND _w > 0")
    found = [F.sum("_w").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("_v").alias("low"), F.max("_v").alias("high")]
    first = plain.groupBy(*group, (F.col("_v") if small else _first_range(F.col("_v"))).alias("_part")).agg(*found)
    first = first.withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    at = [(F.col("total") - 1) * F.lit(float(p)) for p in points]
    ranks = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
    ranges = _with_ranks(first.withColumns({"_from": F.lit(0.0), "before": F.lit(0).cast("long"), "ranks": ranks}), group)
    if small:
        return _interpolated(ranges, group, at, keys)
    state = stored(ranges, "ranges")
    while True:
        open_ = state.rows.where("low < high")
        most = open_.agg(F.max("rows")).first()[0]
        if most is None:
            break
        state = stored(state.rows.where("NOT low < high").unionByName(_cut(plain, open_, group, most <= finish_rows, found)), "ranges", state)
    return _interpolated(state.rows, group, at, keys)


def _cut(plain: DataFrame, open_: DataFrame, group: list[str], last: bool, found: list[Column]) -> DataFrame:
    """The open ranges with a finer cut: by value in the last round."""
    asked = open_.select(*[F.col(k).alias(f"_k_{k}") for k in group], F.col("low").alias("_low"), F.col("high").alias("_high"), "before", "total", "ranks")
    same = F.col("_v").between(F.col("_low"), F.col("_high"))  # ranges of a group are apart, so a row meets one at most
    for k in group:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    held = plain.join(asked, same)
    part = F.col("_v") if last else F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * SPLITS).cast("double")
    kept = [F.first(c).alias(c) for c in ("before", "total", "ranks")]
    return _with_ranks(held.groupBy(*group, F.col("_low").alias("_from"), part.alias("_part")).agg(*found, *kept), group)


def _interpolated(state: DataFrame, group: list[str], at: list[Column], keys: list[str]) -> DataFrame:
    values = state.select(*group, "total", F.explode("ranks").alias("rank"), F.col("low").alias("value"))
    made = values.groupBy(*group).agg(F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m"))
    get = lambda r: F.element_at("_m", r.cast("long"))
    q = []
    for a in at:
        low, high = get(F.floor(a)), get(F.ceil(a))
        q.append(F.when((F.floor(a) == F.ceil(a)) | (low == high), low).otherwise((F.ceil(a) - a) * low + (a - F.floor(a)) * high))
    return made.select(*keys, F.array(*q).alias("q"), F.col("total").alias("n"))
