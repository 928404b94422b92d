"""Binary-model evaluation over long prediction tables (keys, y, p), all groups in one job each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .steps import stored

Metric = Callable[[DataFrame, list[str]], DataFrame]


def checked(rows: DataFrame) -> DataFrame:
    """rows, with an error as soon as a y that isn't 0 or 1 or a p outside 0..1 is read."""
    good = F.col("y").isin(0, 1) & F.col("p").between(0, 1)
    return rows.where(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.lit("y must be 0 or 1, and p within 0..1")).cast("boolean")))


def score_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, pos, neg): what every rank metric works on, one row per distinct score."""
    return rows.groupBy(*keys, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def order_bucket(value: Column) -> Column:
    """A number that never falls as value rises: 64 ranges for each doubling, on both sides of zero."""
    # doubles lie between 2^-1074 and 2^1024; infinity is in the last range
    size = F.floor(F.least(F.greatest(64 * F.log2(F.abs(value.cast("double"))), F.lit(-68_800.0)), F.lit(65_600.0))) + 68_801
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("int")


def ordered_sums(rows: DataFrame, keys: list[str], order: str, sums: list[str], bucket: Column | None = None) -> DataFrame:
    """rows with upto_<c>, the sum of c over the key's rows up to this one in order, and all_<c>.

    Rows of one key are dealt out by ranges of order (see order_bucket); sums over the ranges, which are
    few, tell what lies before each, so no task orders a whole key's rows."""
    made = rows.withColumn("_range", order_bucket(F.col(order)) if bucket is None else bucket)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = made.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    ranges = ranges.withColumns({f"before_{c}": F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)) for c in sums} | {f"all_{c}": F.sum(f"_{c}").over(whole) for c in sums})
    named = ranges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[F.col(f"{x}_{c}") for c in sums for x in ("before", "all")])
    same = F.col("_range").eqNullSafe(F.col("_r"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    out = made.withColumns({f"upto_{c}": F.sum(c).over(inside) for c in sums}).join(named, same)
    out = out.withColumns({f"upto_{c}": F.col(f"upto_{c}") + F.col(f"before_{c}") for c in sums})
    return out.drop("_range", "_r", *[f"_k_{k}" for k in keys], *[f"before_{c}" for c in sums])


def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's further columns, for equal keys; null keys are equal. Neither side is multiplied
    if keys are right's key."""
    if not keys:
        return left.crossJoin(right)  # one row each
    other = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(other, same, "left").drop(*[f"_k_{k}" for k in keys])


def auroc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): chance that a positive outranks a negative, ties half; null for one class."""
    return curve(rows, keys).groupBy(*keys).agg(_area().alias("value"))


def _area() -> Column:
    below = F.col("n_neg") - F.col("fp")
    return F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2)), F.max("n_pos") * F.max("n_neg"))


def curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Score counts with true and false positives at p and above, and the group's totals."""
    return _curve_of(score_counts(rows, keys), keys).drop("upto_pos", "upto_neg")


def auprc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): average precision over distinct scores; null for one class."""
    return curve(rows, keys).groupBy(*keys).agg(_precision().alias("value"))


def _both_classes() -> Column:
    return (F.max("n_pos") > 0) & (F.max("n_neg") > 0)


def _precision() -> Column:
    return F.when(_both_classes(), F.sum(F.try_divide("pos", "n_pos") * F.try_divide("tp", F.col("tp") + F.col("fp"))))


def _sensitivity(specificity: float) -> Column:
    if not 0 < specificity < 1:
        raise ValueError("specificity must lie between 0 and 1")
    enough = (1 - F.try_divide("fp", "n_neg")) >= specificity
    return F.when(_both_classes(), F.coalesce(F.max(F.when(enough, F.col("tp") / F.col("n_pos"))), F.lit(0.0)))


def brier(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("value"))


def calibration(rows: DataFrame, keys: list[str], rounds: int = 25) -> DataFrame:
    """(keys, slope, intercept) of y on logit(p), by Newton steps for all groups at once; null for
    one class or separated groups. A step collects five sums a group: there are few groups."""
    z = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    counts = rows.select(*keys, F.col("y").cast("double").alias("y"), F.ln(z / (1 - z)).alias("z")).groupBy(*keys, "z").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).cache()
    named = F.struct(*keys) if keys else F.lit(1)
    state: dict = {r["k"]: [0.0, 0.0] for r in counts.groupBy(named.alias("k")).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).where("pos > 0 AND pos < n").collect()}
    live = set(state)
    for _ in range(rounds):
        if not live:
            break
        beta = rows.sparkSession.createDataFrame([(*(k if keys else ()), float(state[k][0]), float(state[k][1])) for k in live], counts.select(*keys, F.lit(0.0).alias("b0"), F.lit(0.0).alias("b1")).schema)
        joined = counts.join(F.broadcast(beta), keys) if keys else counts.crossJoin(F.broadcast(beta))
        q = 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * F.col("z"))))
        w, g = F.col("n") * q * (1 - q), F.col("pos") - F.col("n") * q
        sums = joined.groupBy(named.alias("k")).agg(F.sum(g).alias("g0"), F.sum(g * F.col("z")).alias("g1"), F.sum(w).alias("h00"), F.sum(w * F.col("z")).alias("h01"), F.sum(w * F.col("z") * F.col("z")).alias("h11"))
        for s in sums.collect():
            det = s["h00"] * s["h11"] - s["h01"] ** 2
            if abs(det) < 1e-12:
                live.discard(s["k"])
                state[s["k"]] = [float("nan")] * 2
                continue
            d0, d1 = (s["h11"] * s["g0"] - s["h01"] * s["g1"]) / det, (s["h00"] * s["g1"] - s["h01"] * s["g0"]) / det
            new = [state[s["k"]][0] + d0, state[s["k"]][1] + d1]
            state[s["k"]] = new if max(map(abs, new)) <= 30 else [float("nan")] * 2
            if max(abs(d0), abs(d1)) < 1e-10 or max(map(abs, new)) > 30:
                live.discard(s["k"])
    counts.unpersist()
    schema = rows.select(*keys, F.lit(0.0).cast("double").alias("slope"), F.lit(0.0).alias("intercept")).schema
    found = rows.sparkSession.createDataFrame([(*(k if keys else ()), *(None if v != v else float(v) for v in (s[1], s[0]))) for k, s in state.items()], schema.__class__([f.__class__(f.name, f.dataType, True) for f in schema.fields]))
    return rows.select(*keys).distinct().join(found, keys, "left") if keys else found


def sensitivity_at_specificity(rows: DataFrame, keys: list[str], specificity: float = 0.9) -> DataFrame:
    """(keys, value): the best true-positive rate at that specificity or more, 0 if none; null for one class."""
    return curve(rows, keys).groupBy(*keys).agg(_sensitivity(specificity).alias("value"))


def headline(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: n, prevalence and the headline metrics, all from one table of score counts."""
    n, p = F.col("pos") + F.col("neg"), F.col("p")
    metrics = [F.sum(n).alias("n"), (F.sum("pos") / F.sum(n)).alias("prevalence"), _area().alias("auroc"), _precision().alias("auprc")]
    metrics += [(F.sum(F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p) / F.sum(n)).alias("brier"), *[_sensitivity(s).alias(f"sens_at_{int(100 * s)}") for s in (0.9, 0.95)]]
    return matched(curve(rows, keys).groupBy(*keys).agg(*metrics), calibration(rows, keys), keys)


def portable_hash(*parts: Column) -> Column:
    """A 32-bit hash other engines can reproduce."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with _i, the place (from 0) among those of equal keys in order, and _n, their number. Rows are dealt out by
    ranges of keys and order, and counts of the ranges tell what lies before each, so no task orders a whole group."""
    dealt = rows.repartitionByRange(*[F.col(c) for c in (*keys, order)]).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "numbered").rows
    whole = Window.partitionBy(*keys)
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_own"))
    counts = counts.withColumns({"_before": F.sum("_own").over(whole.orderBy("_part")) - F.col("_own"), "_n": F.sum("_own").over(whole)}).drop("_own")
    inside = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)) - 1)
    return matched(inside, counts, [*keys, "_part"]).withColumn("_i", F.col("_i") + F.col("_before")).drop("_part", "_before")


def resampled(rows: DataFrame, keys: list[str], n_resamples: int, seed: int) -> DataFrame:
    """rows drawn with replacement within each group, a resample number b with each.

    rows needs row_id. Draws are hashes of (seed, b, place), so they don't depend on partitions. Draws are joined by a
    shuffle: the optimiser's estimate does not know that they are n_resamples times the rows, and would broadcast them."""
    placed = stored(numbered(rows, keys, "row_id"), "placed").rows
    draws = placed.select(*keys, "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))).alias("b"))
    drawn = draws.select(*keys, "b", F.pmod(portable_hash(F.lit(seed), F.col("b"), F.col("_i")), F.col("_n")).alias("_i"))
    return drawn.hint("merge").join(placed.drop("_n"), [*keys, "_i"]).drop("_i")


def bootstrap_ci(rows: DataFrame, keys: list[str], metric: Metric, n_resamples: int = 2000, alpha: float = 0.05, seed: int = 20260505) -> DataFrame:
    """(keys, point, lower, upper, n_valid): percentile interval; null resamples are dropped, and a
    group with fewer than half of them valid has a null interval."""
    if n_resamples < 100:
        raise ValueError("n_resamples must be 100 at least")
    values = metric(resampled(rows, keys, n_resamples, seed), [*keys, "b"]).where("value IS NOT NULL AND NOT isnan(value)")
    ends = values.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("e"), F.count("value").alias("n_valid"))
    enough = F.col("n_valid") * 2 >= n_resamples
    point = metric(rows, keys).withColumnRenamed("value", "point")
    out = point.join(ends, keys, "left") if keys else point.crossJoin(ends)
    return out.select(*keys, "point", F.when(enough, F.col("e")[0]).alias("lower"), F.when(enough, F.col("e")[1]).alias("upper"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"))


#: Scores of a group that one task draws for, in their order, and resamples that it holds at a time.
BLOCK_SCORES, RESAMPLES_HELD = 2048, 250


def _draws(block: pd.DataFrame, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each score's positives and negatives are in each of n Poisson resamples: each row is in a
    resample 0, 1, 2... times, and those of one score are drawn at once, from a generator seeded by group and score."""
    pos, neg = np.empty((len(block), n), np.int64), np.empty((len(block), n), np.int64)
    for i, (h, a, b) in enumerate(zip(block["_h"], block["pos"], block["neg"], strict=True)):
        draw = np.random.default_rng((seed, h & 0xFFFFFFFFFFFFFFFF))
        pos[i], neg[i] = draw.poisson(a, n), draw.poisson(b, n)
    return pos, neg


def resampled_sums(rows: DataFrame, keys: list[str], n_resamples: int, seed: int, specificities: tuple[float, ...]) -> DataFrame:
    """(keys, b, n_pos, n_neg, area, precision, error, sens_<k>): what the rank metrics of each resample b are made of.

    Scores in their order are cut into blocks of BLOCK_SCORES. A block's draws stay in its task as arrays: it gives its
    sums once, so that each block learns what lies before it, and then its parts of the metrics. So neither rows nor
    distinct scores are multiplied by resamples, only blocks are; no task holds a group."""
    counts = score_counts(rows, keys).select(*keys, "p", F.col("pos").cast("long").alias("pos"), F.col("neg").cast("long").alias("neg"), F.lit(1).alias("one"))
    block = F.floor((F.col("upto_one") - 1) / BLOCK_SCORES).cast("long")
    scores = stored(ordered_sums(counts, keys, "p", ["one"]).select(*keys, "p", "pos", "neg", block.alias("_block"), F.xxhash64(*keys, "p").alias("_h")), "scores").rows
    named, on = [f for f in scores.schema.fields if f.name in keys], [*keys, "_block"]
    whole = [T.StructField("_block", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("pos", "neg")]]

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        pos, neg = _draws(part, n_resamples, seed)
        return part[on].head(1).assign(pos=[pos.sum(0)], neg=[neg.sum(0)])

    totals = scores.groupBy(*on).applyInPandas(sums, T.StructType([*named, *whole]))
    each = totals.select(*on, F.posexplode(F.arrays_zip("pos", "neg")).alias("b", "s")).select(*on, "b", "s.pos", "s.neg")
    group = Window.partitionBy(*keys, "b")
    before = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("pos", "neg")} | {f"all_{c}": F.sum(c).over(group) for c in ("pos", "neg")})
    names = ["area", "precision", "error", *[f"sens_{k}" for k in range(len(specificities))]]

    def parts(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        part, known = part.sort_values("p"), known.sort_values("b")
        pos, neg = _draws(part, n_resamples, seed)
        p, out = part["p"].to_numpy()[:, None], {n: np.zeros(n_resamples) for n in names}
        for i in range(0, n_resamples, RESAMPLES_HELD):
            at = slice(i, i + RESAMPLES_HELD)
            a, b = pos[:, at], neg[:, at]
            n_pos, n_neg = known["all_pos"].to_numpy()[at], known["all_neg"].to_numpy()[at]
            upto_pos, upto_neg = known["before_pos"].to_numpy()[at] + a.cumsum(0), known["before_neg"].to_numpy()[at] + b.cumsum(0)
            tp, fp = n_pos - upto_pos + a, n_neg - upto_neg + b
            out["area"][at] = (a * (upto_neg - b + b / 2)).sum(0)
            out["precision"][at] = (a / np.maximum(n_pos, 1) * tp / np.maximum(tp + fp, 1)).sum(0)
            out["error"][at] = (a * (1 - p) ** 2 + b * p**2).sum(0)
            for k, s in enumerate(specificities):
                out[f"sens_{k}"][at] = np.where(1 - fp / np.maximum(n_neg, 1) >= s, tp / np.maximum(n_pos, 1), 0.0).max(0)
        return known[[*keys, "b", "all_pos", "all_neg"]].assign(**out)

    kinds = [T.StructField("b", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("all_pos", "all_neg")], *[T.StructField(c, T.DoubleType()) for c in names]]
    made = scores.groupBy(*on).cogroup(each.drop("pos", "neg").groupBy(*on)).applyInPandas(parts, T.StructType([*named, *kinds]))
    found = [F.max("all_pos").alias("n_pos"), F.max("all_neg").alias("n_neg"), *[F.sum(c).alias(c) for c in names[:3]], *[F.max(c).alias(c) for c in names[3:]]]
    return made.groupBy(*keys, "b").agg(*found)


def _curve_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    made = ordered_sums(counts, keys, "p", ["pos", "neg"]).withColumnsRenamed({"all_pos": "n_pos", "all_neg": "n_neg"})
    return made.withColumns({"tp": F.col("n_pos") - F.col("upto_pos") + F.col("pos"), "fp": F.col("n_neg") - F.col("upto_neg") + F.col("neg")})


def headline_intervals(rows: DataFrame, keys: list[str], n_resamples: int = 2000, alpha: float = 0.05, seed: int = 20260505, specificities: tuple[float, ...] = (0.85, 0.9)) -> DataFrame:
    """(keys, metric, point, lower, upper, n_valid): percentile intervals of AUROC, average precision, Brier
    score and sensitivities from the same resamples. A metric with fewer than half of its resamples valid
    has a null interval. Slope and intercept have points only: their resamples are unstable."""
    n, p = F.col("pos") + F.col("neg"), F.col("p")
    brier_ = F.sum(F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p) / F.sum(n)
    metrics = {"auroc": _area(), "auprc": _precision(), "brier": brier_} | {f"sens_at_{int(100 * s)}": _sensitivity(s) for s in specificities}
    names = list(metrics)
    points = curve(rows, keys).groupBy(*keys).agg(*[m.cast("double").alias(k) for k, m in metrics.items()]).unpivot(keys, names, "metric", "point")
    both, sums = (F.col("n_pos") > 0) & (F.col("n_neg") > 0), resampled_sums(rows, keys, n_resamples, seed, specificities)
    made = {"auroc": F.when(both, F.col("area") / (F.col("n_pos") * F.col("n_neg"))), "auprc": F.when(both, F.col("precision")), "brier": F.try_divide("error", F.col("n_pos") + F.col("n_neg"))}
    made |= {f"sens_at_{int(100 * s)}": F.when(both, F.col(f"sens_{k}")) for k, s in enumerate(specificities)}
    drawn = sums.select(*keys, "b", *[c.alias(n) for n, c in made.items()])
    ends = drawn.unpivot([*keys, "b"], names, "metric", "value").where("value IS NOT NULL").groupBy(*keys, "metric").agg(F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("e"), F.count("value").alias("n_valid"))
    enough = F.col("n_valid") * 2 >= n_resamples
    out = matched(points, ends, [*keys, "metric"])
    return out.select(*keys, "metric", "point", F.when(enough, F.col("e")[0]).alias("lower"), F.when(enough, F.col("e")[1]).alias("upper"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"))


def mean_metric(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of a column v, for bootstrap intervals of means."""
    return rows.groupBy(*keys).agg(F.avg("v").alias("value"))


def ci_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"width": F.col("upper") - F.col("lower"), "contains_point": (F.col("lower") <= F.col("point")) & (F.col("point") <= F.col("upper"))})


def reliability_bins(rows: DataFrame, keys: list[str], n_bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """(keys, bin, n, mean_p, rate) for each bin, empty ones with nulls."""
    if strategy == "uniform":
        edges = rows.select(*keys).distinct().withColumn("edges", F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)]))
    else:
        from .quantiles import exact_quantiles  # it is made of this module's parts

        edges = exact_quantiles(rows, keys, "p", [i / n_bins for i in range(1, n_bins)]).select(*keys, F.array_sort(F.array_distinct("q")).alias("edges"))
    placed = rows.join(edges, keys) if keys else rows.crossJoin(F.broadcast(edges))
    held = placed.groupBy(*keys, F.size(F.filter("edges", lambda e: e <= F.col("p"))).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
    every = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    return every.join(held, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def stratified(rows: DataFrame, keys: list[str], stratum: str, metric: Metric, least: int = 10) -> DataFrame:
    """(keys, stratum, n, value); strata of fewer than least rows have a null value."""
    group = [*keys, stratum]
    return matched(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), metric(rows, group), group).withColumn("value", F.when(F.col("n") >= least, F.col("value")))


def evaluation_block(rows: DataFrame, keys: list[str], strata: list[str], thresholds: tuple[float, ...] = (0.05, 0.10), least: int = 10) -> DataFrame:
    """One row per group: the headline, for each stratum column auroc_by_<c> (an array of stratum, n, value)
    and gap_<c>, and for each threshold at_<percent> (net benefits, and whether the model is of use)."""
    out = headline(rows, keys)
    for c in strata:
        made = stratified(rows, keys, c, auroc, least)
        listed = F.array_sort(F.collect_list(F.struct(F.col(c).alias("stratum"), "n", "value"))).alias(f"auroc_by_{c}")
        out = matched(out, made.groupBy(*keys).agg(listed), keys)
        out = matched(out, fairness_gap(made, keys).withColumnRenamed("gap", f"gap_{c}"), keys)
    points = decision_curve(rows, keys)
    for t in thresholds:
        at = curve_at(points, keys, t).select(*keys, F.struct("threshold", "model", "treat_all", "useful").alias(f"at_{round(100 * t)}"))
        out = matched(out, at, keys)
    return out


def fairness_gap(strata: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap): largest minus smallest valid value; null for fewer than two."""
    return strata.groupBy(*keys).agg(F.when(F.count("value") >= 2, F.max("value") - F.min("value")).alias("gap"))


def decision_curve(rows: DataFrame, keys: list[str], thresholds: list[float] | None = None) -> DataFrame:
    """(keys, threshold, model, treat_all, treat_none): net benefit at each threshold.

    A row adds to all thresholds up to its p, so rows are counted by the last such threshold and
    summed from above; nothing is multiplied by the number of thresholds."""
    grid = sorted(thresholds or [i / 100 for i in range(1, 100)])
    every = F.array(*[F.lit(t) for t in grid])
    scores = score_counts(rows, keys)  # so that a score, not a row, looks for its threshold
    counts = scores.groupBy(*keys, F.size(F.filter(every, lambda t: t <= F.col("p"))).alias("k")).agg(F.sum("pos").alias("pos"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("pos").alias("n_pos"))
    points = totals.select(*keys, "total", "n_pos", F.posexplode(every).alias("at", "threshold")).withColumn("k", F.col("at") + 1)
    held = points.join(counts, [*keys, "k"], "left").fillna(0, ["pos", "n"])
    # rows above the last threshold have k = its number, so each row is at one point or at none (k = 0)
    above = Window.partitionBy(*keys).orderBy(F.col("k").desc())
    odds = F.col("threshold") / (1 - F.col("threshold"))
    out = held.withColumns({"tp": F.sum("pos").over(above), "all": F.sum("n").over(above)})
    prevalence = F.col("n_pos") / F.col("total")
    return out.select(*keys, "threshold", (F.col("tp") / F.col("total") - (F.col("all") - F.col("tp")) / F.col("total") * odds).alias("model"), (prevalence - (1 - prevalence) * odds).alias("treat_all"), F.lit(0.0).alias("treat_none"))


def curve_at(points: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The row of the nearest threshold, with useful: the model beats both policies."""
    nearest = points.groupBy(*keys).agg(F.min_by(F.struct("threshold", "model", "treat_all", "treat_none"), F.struct(F.abs(F.col("threshold") - threshold), "threshold")).alias("s")).select(*keys, "s.*")
    return nearest.withColumn("useful", F.col("model") > F.greatest("treat_all", "treat_none"))


def across_folds(values: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, metric, mean, std, n) over the folds of a wide metric table, nulls left out."""
    return values.select(*keys, *[F.col(n).cast("double") for n in names]).unpivot(keys, names, "metric", "value").groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))
