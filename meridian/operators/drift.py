"""Distribution drift: quantile-binned references, PSI, two-sample KS, severity. Long tables
(keys, feature, value) carry all features at once; keys may hold folds, models or windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import matched, ordered_sums
from .quantiles import FINISH_ROWS, exact_quantiles
from .steps import stored

FLOOR = 1e-6
STABLE, MODERATE = 0.10, 0.25


def melt(df: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, value): absent features are skipped, NaN becomes null."""
    keys, there = keys or [], [f for f in features if f in df.columns]
    long = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in there]).unpivot(keys, there, "feature", "value")
    return long.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def melt_levels(df: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    keys, there = keys or [], [f for f in features if f in df.columns]
    return df.select(*keys, *[F.col(f).cast("string").alias(f) for f in there]).unpivot(keys, there, "feature", "level")


def _cells(df: DataFrame, numeric: list[str], categorical: list[str], keys: list[str]) -> DataFrame:
    """(keys, kind, feature, value, level), numbers and levels in one pass over df; kind is numeric or categorical.
    Absent features are skipped, NaN becomes null."""
    cell = lambda kind, f, v, l: F.struct(F.lit(kind).alias("kind"), F.lit(f).alias("feature"), v.cast("double").alias("value"), l.cast("string").alias("level"))
    none = F.lit(None)
    cells = [cell("numeric", f, F.nanvl(F.col(f).cast("double"), none.cast("double")), none) for f in numeric if f in df.columns]
    cells += [cell("categorical", f, none, F.col(f)) for f in categorical if f in df.columns]
    return df.select(*keys, F.inline(F.array(*cells))) if cells else df.limit(0).select(*keys, F.inline(F.array(cell("numeric", "", none, none))))


def value_counts(df: DataFrame, numeric: list[str], categorical: list[str], keys: list[str]) -> DataFrame:
    """(keys, kind, feature, value, level, weight): how often each value and level occurs, nulls too."""
    return _cells(df, numeric, categorical, keys).groupBy(*keys, "kind", "feature", "value", "level").agg(F.count(F.lit(1)).alias("weight"))


def _weight(long: DataFrame) -> Column:
    return F.col("weight") if "weight" in long.columns else F.lit(1)


def bin_of(value: Column, edges: Column) -> Column:
    """Number of the bin [edge, next edge) that holds value, the outer ones unbounded."""
    return F.when(value.isNotNull(), F.size(F.filter(edges, lambda e: e <= value)))


def numeric_edges(long: DataFrame, keys: list[str], n_bins: int = 10, exact: bool = True, small: bool = False) -> DataFrame:
    """(keys, feature, edges, n, n_missing): the bin edges between -inf and +inf, n values and n nulls; a row
    counts weight times, if there is such a column.

    exact interpolates between the ranks that selection finds (small as for exact_quantiles); without it a sketch of
    bounded size answers in one pass."""
    on, w, there = [*keys, "feature"], _weight(long), F.col("value").isNotNull()
    points = [i / n_bins for i in range(1, n_bins)]
    sums = [F.sum(F.when(there, w).otherwise(0)).alias("n"), F.sum(F.when(there, 0).otherwise(w)).alias("n_missing")]
    sketch = [] if exact else [F.percentile_approx("value", F.array(*map(F.lit, points)), 100_000, w).alias("q")]
    found = long.groupBy(*on).agg(*sums, *sketch)
    if exact:
        weighted = "weight" if "weight" in long.columns else None
        found = matched(found, exact_quantiles(long, on, "value", points, weighted, small=small).drop("n"), on)
    edges = F.coalesce(F.array_sort(F.array_distinct("q")), F.array().cast("array<double>"))
    return found.select(*on, edges.alias("edges"), "n", "n_missing")


def bin_counts(long: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, bin, cnt) for every bin of edges, empty ones too."""
    on = [*keys, "feature"]
    count = F.sum(F.when(F.col("value").isNotNull(), _weight(long)).otherwise(0))
    held = long.join(edges.select(*on, "edges"), on).groupBy(*on, bin_of(F.col("value"), F.col("edges")).alias("bin")).agg(count.alias("cnt"))
    every = edges.select(*on, F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    return every.join(held, [*on, "bin"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def numeric_reference(long: DataFrame, keys: list[str], n_bins: int = 10, exact: bool = True, small: bool = False) -> DataFrame:
    """(keys, feature, edges, counts, n, n_missing): what is stored for later comparisons."""
    edges = stored(numeric_edges(long, keys, n_bins, exact, small), "edges").rows  # small, and asked three times
    counts = bin_counts(long, edges, keys).groupBy(*keys, "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "cnt"))), lambda s: s["cnt"]).alias("counts"))
    return edges.join(counts, [*keys, "feature"])


def level_counts(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.where("level IS NOT NULL").groupBy(*keys, "feature", "level").agg(F.sum(_weight(long)).alias("cnt"))


def proportion(count: Column, group: list[str]) -> Column:
    """Share of the group's total; an empty cell gets a small floor."""
    share = count / F.nullif(F.sum(count).over(Window.partitionBy(*group)), F.lit(0))
    return F.when(count == 0, F.lit(FLOOR)).otherwise(share)


def psi(reference: DataFrame, current: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """(keys, feature, psi) from counts per cell (bin or level); a cell absent on a side counts 0,
    and a side without rows gives 0."""
    on = [*keys, "feature", cell]
    group = [*keys, "feature"]
    both = reference.select(*on, F.col("cnt").alias("r")).join(current.select(*on, F.col("cnt").alias("c")), on, "full_outer").fillna(0, ["r", "c"])
    both = both.withColumns({"rp": proportion(F.col("r"), group), "cp": proportion(F.col("c"), group)})
    summed = both.groupBy(*group).agg(F.sum((F.col("cp") - F.col("rp")) * F.ln(F.col("cp") / F.col("rp"))).alias("psi"), F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    return summed.withColumn("psi", F.when((F.col("n_ref") == 0) | (F.col("n_cur") == 0), 0.0).otherwise(F.col("psi")))


def severity(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "major").when(value < STABLE, "stable").when(value < MODERATE, "moderate").otherwise("major")


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    x = d * F.sqrt(n * m / (n + m))
    terms = F.sequence(F.lit(1), F.lit(100))
    series = F.aggregate(terms, F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def ks_weighted(reference: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, ks, ks_p, n_ref, n_cur) from weighted values (keys, feature, value, weight);
    values are counted before they are ordered."""
    on = [*keys, "feature"]
    both = reference.select(*on, "value", F.col("weight").alias("r"), F.lit(0).alias("c")).unionByName(current.select(*on, "value", F.lit(0).alias("r"), F.col("weight").alias("c")))
    points = both.where("value IS NOT NULL").groupBy(*on, "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    gap = F.abs(F.try_divide("upto_r", "all_r") - F.try_divide("upto_c", "all_c"))
    found = ordered_sums(points, on, "value", ["r", "c"]).withColumn("gap", gap).groupBy(*on).agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("ks"), F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    return found.withColumn("ks_p", _ks_p())


def ks_two_sample(reference: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """ks_weighted of rows (keys, feature, value); each side is read once, for the counts of its values."""
    on = [*keys, "feature", "value"]
    sides = [rows.groupBy(*on).agg(F.count(F.lit(1)).alias("weight")).withColumn("side", F.lit(k)) for k, rows in enumerate((reference, current))]
    counts = stored(sides[0].unionByName(sides[1]), "counts").rows
    return ks_weighted(counts.where("side = 0"), counts.where("side = 1"), keys)


def _middles() -> Column:
    """The middles of the bins between inner edges, the open bins' a span beyond their edge."""
    inner = F.col("edges")
    span = F.greatest(F.element_at(inner, -1) - inner[0], F.lit(1.0))
    edges = F.concat(F.array(inner[0] - span), inner, F.array(F.element_at(inner, -1) + span))
    return F.transform(F.sequence(F.lit(0), F.size(inner)), lambda i: (F.get(edges, i) + F.get(edges, i + 1)) / 2)


def midpoints(reference: DataFrame, keys: list[str]) -> DataFrame:
    """A binned reference as weighted values at the middles of its bins."""
    cells = F.transform("counts", lambda n, i: F.struct(F.get(_middles(), i).alias("value"), n.alias("weight")))
    return reference.where(F.size("edges") > 0).select(*keys, "feature", F.inline(cells))


def reference_counts(reference: DataFrame, keys: list[str]) -> DataFrame:
    return reference.select(*keys, "feature", F.posexplode("counts").alias("bin", "cnt"))


def drift_report(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str], keys: list[str] | None = None, n_bins: int = 10, exact: bool = True) -> DataFrame:
    """(keys, feature, kind, psi, severity, n_ref, n_cur, n_missing, ks, ks_p) for each feature; exact
    as for numeric_edges. Both tables are read once, for the counts of their values."""
    keys = keys or []
    was = stored(value_counts(reference, numeric, categorical, keys), "counts").rows
    bins = stored(numeric_reference(was.where("kind = 'numeric'"), keys, n_bins, exact, was.count() <= FINISH_ROWS), "bins").rows  # small, and asked four times
    return report_against(bins, level_counts(was.where("kind = 'categorical'"), keys), current, numeric, categorical, keys)


def report_against(reference: DataFrame, levels: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str], keys: list[str]) -> DataFrame:
    """drift_report from stored references (see numeric_reference and level_counts).

    current is read once, and only counts of the cells that bins and their middles cut come of it: a binned
    reference's steps lie at the middles, so the two-sample statistic needs no value of current in order."""
    on = [*keys, "feature"]
    counts = stored(_cell_counts(_cells(current, numeric, categorical, keys), reference, keys), "cells").rows
    empty = F.col("bin").isNull() & F.col("level").isNull()
    missing = counts.groupBy(*on, "kind").agg(F.sum(F.when(empty, F.col("weight")).otherwise(0)).alias("n_missing"))
    now = reference.select(*on, F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin")).join(counts.groupBy(*on, "bin").agg(F.sum("weight").alias("cnt")), [*on, "bin"], "left").fillna(0, ["cnt"])
    now_levels = counts.where("level IS NOT NULL").groupBy(*on, "level").agg(F.sum("weight").alias("cnt"))
    one = psi(reference_counts(reference, keys), now, keys, "bin").join(missing.where("kind = 'numeric'"), on).join(_ks_of_cells(reference, counts, keys), on, "left")
    two = psi(levels, now_levels, keys, "level").join(missing.where("kind = 'categorical'"), on)
    two = two.withColumns({"ks": F.lit(None).cast("double"), "ks_p": F.lit(None).cast("double")})
    both = one.unionByName(two).withColumn("severity", severity(F.col("psi")))
    return both.select(*keys, "feature", "kind", "psi", "severity", "n_ref", "n_cur", "n_missing", "ks", "ks_p")


#: So many cuts are compared one by one in generated code; more are looked through as an array.
MOST_COMPARED = 80


def _cell_counts(long: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, feature, level, bin, below, upto, weight): below and upto are how many middles of the
    reference's bins are less than a value, and at most equal to it.

    Rows are counted by how many cuts, edges and middles in one order, lie below them; the counts, which are few, are
    then told apart."""
    on, value = [*keys, "feature"], F.col("value")
    cuts = reference.select(*on, "edges", F.when(F.size("edges") > 0, _middles()).otherwise(F.array().cast("array<double>")).alias("middles"))
    cuts = cuts.withColumn("cuts", F.array_sort(F.array_distinct(F.concat("edges", "middles"))))
    most = cuts.agg(F.max(F.size("cuts"))).first()[0] or 0

    if most > MOST_COMPARED:
        upto = F.size(F.filter("cuts", lambda c: c <= value))
    else:
        upto = sum((F.when(F.get("cuts", F.lit(i)) <= value, 1).otherwise(0) for i in range(most)), F.lit(0))
    placed = long.join(cuts.select(*on, "cuts"), on, "left").withColumn("upto", F.when(value.isNotNull(), upto))
    placed = placed.withColumn("below", F.col("upto") - F.when(F.get("cuts", F.col("upto") - 1) == value, 1).otherwise(0))
    found = placed.groupBy(*keys, "kind", "feature", "level", "upto", "below").agg(F.count(F.lit(1)).alias("weight"))
    held = lambda of, n: F.size(F.array_intersect(of, F.slice("cuts", F.lit(1), F.col(n))))
    of = {"bin": held("edges", "upto"), "below": held("middles", "below"), "upto": held("middles", "upto")}
    told = found.join(cuts, on, "left").select(*keys, "kind", "feature", "level", *[F.when(F.col("upto").isNotNull() & (F.col("kind") == "numeric"), c).alias(n) for n, c in of.items()], "weight")
    return told.groupBy(*keys, "kind", "feature", "level", "bin", "below", "upto").agg(F.sum("weight").alias("weight"))


def _ks_of_cells(reference: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, ks, ks_p) of a binned reference, its weights at the middles, against counted cells."""
    on = [*keys, "feature"]
    steps = reference.where(F.size("edges") > 0).select(*on, F.posexplode("counts").alias("j", "r"))
    before = Window.partitionBy(*on).orderBy("j")
    steps = steps.withColumns({"upto_r": F.sum("r").over(before), "n_ref": F.sum("r").over(Window.partitionBy(*on))})
    held = steps.join(counts.where("bin IS NOT NULL").select(*on, "below", "upto", "weight"), on, "left")
    within = lambda c: F.sum(F.when(F.col(c) <= F.col("j"), F.col("weight")).otherwise(0))
    at = held.groupBy(*on, "j", "r", "upto_r", "n_ref").agg(within("below").alias("c_at"), within("upto").alias("c_before"), F.coalesce(F.sum("weight"), F.lit(0)).alias("n_cur"))
    share = lambda r, c: F.abs(F.try_divide(r, "n_ref") - F.try_divide(c, "n_cur"))
    gap = F.greatest(share(F.col("upto_r"), F.col("c_at")), share(F.col("upto_r") - F.col("r"), F.col("c_before")))
    found = at.groupBy(*on).agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"))
    return found.select(*on, "ks", _ks_p().alias("ks_p"))


def _ks_p() -> Column:
    return F.when((F.col("n_ref") == 0) | (F.col("n_cur") == 0), 1.0).otherwise(kolmogorov_p(F.col("ks"), F.col("n_ref").cast("double"), F.col("n_cur").cast("double")))


def reference_bundle(rows: DataFrame, predictions: DataFrame, numeric: list[str], categorical: list[str], fold: str = "fold", model: str = "model", n_bins: int = 10) -> dict[str, DataFrame]:
    """What is stored for all folds: bins of numbers, counts of levels, and bins and mean of each model's p."""
    p = melt(predictions, ["p"], [fold, model])
    mean = p.groupBy(fold, model, "feature").agg(F.avg("value").alias("mean"))
    return {
        "numeric": numeric_reference(melt(rows, numeric, [fold]), [fold], n_bins),
        "categorical": level_counts(melt_levels(rows, categorical, [fold]), [fold]),
        "prediction": numeric_reference(p, [fold, model], n_bins).join(mean, [fold, model, "feature"]),
    }


def fold_sweep(stored: dict[str, DataFrame], rows: DataFrame, predictions: DataFrame, numeric: list[str], categorical: list[str], fold: str = "fold", model: str = "model") -> tuple[DataFrame, DataFrame]:
    """The drift of features by fold and of predictions by fold and model, against a reference_bundle."""
    report = report_against(stored["numeric"], stored["categorical"], rows, numeric, categorical, [fold])
    keys, now = [fold, model], melt(predictions, ["p"], [fold, model])
    found = psi(reference_counts(stored["prediction"], keys), bin_counts(now, stored["prediction"], keys), keys, "bin").drop("feature")
    was = stored["prediction"].select(*keys, F.col("mean").alias("mean_ref"))
    means = now.groupBy(*keys).agg(F.avg("value").alias("mean_cur"))
    return report, found.join(was, keys).join(means, keys).withColumn("severity", severity(F.col("psi")))


def severity_counts(report: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with a count for each severity, zeros kept."""
    return report.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("stable", "moderate", "major")])


def top_drifted(report: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("psi").desc(), "feature")
    return report.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def prediction_drift(reference: DataFrame, current: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """(keys, psi, severity, mean_ref, mean_cur) of predictions p."""
    was, now = melt(reference, ["p"], keys), melt(current, ["p"], keys)
    stored = numeric_reference(was, keys, n_bins)
    found = psi(reference_counts(stored, keys), bin_counts(now, stored, keys), keys, "bin")
    mean = lambda rows, name: rows.groupBy(*keys, "feature").agg(F.avg("value").alias(name))
    on = [*keys, "feature"]
    return found.join(mean(was, "mean_ref"), on).join(mean(now, "mean_cur"), on).withColumn("severity", severity(F.col("psi"))).drop("feature")


def drift_tally(report: DataFrame, predictions: DataFrame, model: str = "model") -> DataFrame:
    """Severity totals and the mean and largest prediction PSI for each model."""
    return severity_counts(report, [model]).join(predictions.groupBy(model).agg(F.avg("psi").alias("mean_psi"), F.max("psi").alias("max_psi")), model)


def ecdf(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, value, share) with one row for each distinct value."""
    on = [*keys, "feature"]
    counts = long.where("value IS NOT NULL").withColumn("weight", F.col("weight") if "weight" in long.columns else F.lit(1)).groupBy(*on, "value").agg(F.sum("weight").alias("w"))
    return ordered_sums(counts, on, "value", ["w"]).select(*on, "value", (F.col("upto_w") / F.col("all_w")).alias("share"))


def overlay_histogram(reference: DataFrame, current: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """(keys, bin, low, high, ref_share, cur_share) of predictions p clipped to 0..1."""
    stored = numeric_reference(melt(reference, ["p"], keys), keys, n_bins)
    clipped = melt(current, ["p"], keys).withColumn("value", F.least(F.greatest("value", F.lit(0.0)), F.lit(1.0)))
    on = [*keys, "feature", "bin"]
    both = reference_counts(stored, keys).withColumnRenamed("cnt", "r").join(bin_counts(clipped, stored, keys).withColumnRenamed("cnt", "c"), on)
    both = both.join(stored.select(*keys, "feature", "edges"), [*keys, "feature"])
    share = lambda c: F.col(c) / F.nullif(F.sum(c).over(Window.partitionBy(*keys, "feature")), F.lit(0))
    low, high = F.coalesce(F.get("edges", F.col("bin") - 1), F.lit(0.0)), F.coalesce(F.get("edges", F.col("bin")), F.lit(1.0))
    return both.select(*keys, "bin", low.alias("low"), high.alias("high"), share("r").alias("ref_share"), share("c").alias("cur_share"))
