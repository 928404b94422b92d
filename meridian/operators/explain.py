"""Attributions and their roll-ups: linear parts, sampled Shapley values, importance, archetypes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import portable_hash
from .models import counted

#: Points are dealt to so many tasks by value for k means, whatever the cluster, so that the means are the same on each.
TASKS = 32


def linear_parts(features: Column, weights: list[float], names: list[str], intercept: float | None = None) -> Column:
    """Structs (basis, value): weight times feature, and the intercept, if given; another length is an error."""
    if len(weights) != len(names):
        raise ValueError("a weight is needed for each name")
    products = F.zip_with(features, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)
    made = F.zip_with(F.array(*map(F.lit, names)), products, lambda n, v: F.struct(n.alias("basis"), v.alias("value")))
    if intercept is not None:
        made = F.concat(made, F.array(F.struct(F.lit("intercept").alias("basis"), F.lit(float(intercept)).alias("value"))))
    return F.when(F.size(features) == len(weights), made).otherwise(F.raise_error(F.lit("features and weights differ in length")).cast("array<struct<basis:string,value:double>>"))


def raw_names(basis: list[str], raw: list[str]) -> dict[str, str]:
    """The raw feature of each basis column: itself, a spline term, or a level (longest prefix)."""
    out = {}
    for b in basis:
        fits = [r for r in raw if b == r or b.startswith((f"{r}_rcs", f"{r}__", f"{r}_"))]
        if not fits:
            raise KeyError(f"no raw feature for {b}")
        out[b] = max(fits, key=len)
    return out


def summed_back(parts: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, value) from (keys, basis, value) and (basis, feature)."""
    return parts.join(mapping, "basis").groupBy(*keys, "feature").agg(F.sum("value").alias("value"))


def summed_rows(rows: DataFrame, parts: Column, basis: list[str], mapping: dict[str, str], keys: list[str]) -> DataFrame:
    """As summed_back, of parts (an array of basis and value, in the order of basis) that are still side by side in
    their row: one row for each of the keys is shuffled, not one for each part."""
    held = rows.select(*keys, parts.alias("_p"))
    sums = held.groupBy(*keys).agg(*[F.sum(F.get("_p", F.lit(i))["value"]).alias(f"_{i}") for i in range(len(basis))])
    features = {}
    for i, b in enumerate(basis):
        features.setdefault(mapping[b], []).append(F.col(f"_{i}"))
    # nulls count as nothing unless all are null
    total = lambda c: F.when(F.coalesce(*c).isNotNull(), sum((F.coalesce(x, F.lit(0.0)) for x in c[1:]), F.coalesce(c[0], F.lit(0.0))))
    return sums.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), total(c).alias("value")) for n, c in features.items()])))


def alike(rows: DataFrame) -> DataFrame:
    """(row_id, features, weight): rows with equal features once, under the least row_id, with their number. They have one
    score, so one attribution."""
    return rows.groupBy("features").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).cast("double").alias("weight"))


def background(rows: DataFrame, k: int = 50, seed: int = 5) -> list[list[float]]:
    """k means of the feature arrays of all rows. Equal ones are clustered once, with their number (or the sum of weight, if
    rows have it) as weight."""
    points = counted(rows, "features").repartition(TASKS, "features").sortWithinPartitions("features")
    points = points.select(array_to_vector("features").alias("v"), "weight")
    return [list(map(float, c)) for c in KMeans(k=k, featuresCol="v", weightCol="weight", seed=seed).fit(points).clusterCenters()]


def shapley(rows: DataFrame, score: Callable[[DataFrame], DataFrame], centers: list[list[float]], names: list[str], permutations: int = 4, seed: int = 5) -> DataFrame:
    """(row_id, feature, value) by sampled permutations. rows: row_id, features (array of double); further columns
    (a weight) are kept.

    Walking a permutation, features change from a background point's to the row's, and each gets the
    difference its change makes in p; sums are p minus the mean p of the walks' starts exactly. score
    adds p to a table with a vector column features."""
    n, points = len(names), F.array(*[F.array(*map(F.lit, c)) for c in centers])
    kept = [c for c in rows.columns if c not in ("row_id", "features")]
    walks = rows.select("row_id", *kept, "features", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("w"))
    draw = lambda *x: portable_hash(F.lit(seed), F.col("row_id"), F.col("w"), *x)
    walks = walks.withColumns(
        {
            "start": F.get(points, F.pmod(draw(F.lit("b")), F.lit(len(centers))).cast("int")),
            "order": F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(portable_hash(F.lit(seed), F.col("row_id"), F.col("w"), i).alias("h"), i.alias("i")))), lambda s: s["i"]),
        }
    )
    steps = walks.select("row_id", *kept, "w", "order", "start", F.col("features").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("step"))
    mixed = F.transform("own", lambda x, i: F.when(F.array_position("order", i) <= F.col("step"), x).otherwise(F.get("start", i)))
    points_scored = score(steps.select("row_id", *kept, "w", "step", F.get("order", F.col("step") - 1).alias("changed"), array_to_vector(mixed).alias("features")))
    before = F.lag("p").over(Window.partitionBy("row_id", "w").orderBy("step"))
    diffs = points_scored.withColumn("diff", F.col("p") - before).where("step > 0")
    return diffs.groupBy("row_id", *kept, F.element_at(F.array(*map(F.lit, names)), F.col("changed") + 1).alias("feature")).agg((F.sum("diff") / permutations).alias("value"))


def importance(parts: DataFrame, keys: list[str], k: int | None = None, weight: str | None = None) -> DataFrame:
    """(keys, feature, importance, rank): mean size of the attributions. weight names a column that tells how often a row counts."""
    size = F.abs("value")
    mean = F.avg(size) if weight is None else F.sum(size * F.col(weight)) / F.sum(F.when(size.isNotNull(), F.col(weight)))
    made = parts.groupBy(*keys, "feature").agg(mean.alias("importance"))
    ranked = made.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("importance").desc(), "feature")))
    return ranked.where(F.col("rank") <= k) if k else ranked


def archetypes(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """(keys, kind, row_id, p): surest and least sure true positive, least-scored miss, surest false
    alarm; the first row of equals; kinds without rows are left out."""
    hit, y = F.col("p") >= threshold, F.col("y") == 1
    kinds = F.array_compact(F.array(F.when(y & hit, F.struct(F.lit("tp_max").alias("kind"), (-F.col("p")).alias("o"))), F.when(y & hit, F.struct(F.lit("tp_min").alias("kind"), F.col("p").alias("o"))), F.when(y & ~hit, F.struct(F.lit("fn_min").alias("kind"), F.col("p").alias("o"))), F.when(~y & hit, F.struct(F.lit("fp_max").alias("kind"), (-F.col("p")).alias("o")))))
    found = rows.select(*keys, "row_id", "p", F.inline(kinds))
    return found.groupBy(*keys, "kind").agg(F.min(F.struct("o", "row_id", "p")).alias("s")).select(*keys, "kind", "s.row_id", "s.p")


def subgroup_delta(parts: DataFrame, keys: list[str], stratum: str, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(keys, stratum, feature, delta) of mean sizes against all rows, and the strata too small."""
    group = [*keys, stratum]
    sizes = parts.groupBy(*group).agg(F.count_distinct("row_id").alias("n"))
    own = parts.groupBy(*group, "feature").agg(F.avg(F.abs("value")).alias("own"))
    every = parts.groupBy(*keys, "feature").agg(F.avg(F.abs("value")).alias("every"))
    made = own.join(sizes.where(F.col("n") >= least), group).join(every, [*keys, "feature"])
    return made.select(*group, "feature", (F.col("own") - F.col("every")).alias("delta")), sizes.where(F.col("n") < least)


def agreement(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, rho): Spearman correlation of the models' importances (keys, model, feature,
    importance), with average ranks."""
    by = Window.partitionBy(*keys, "model")
    ranked = table.withColumn("r", F.rank().over(by.orderBy("importance")) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, "model", "importance")) - 1) / 2)
    one, two = (ranked.select(*keys, "feature", F.col("model").alias(m), F.col("r").alias(f"r{m}")) for m in ("a", "b"))
    return one.join(two, [*keys, "feature"]).groupBy(*keys, "a", "b").agg(F.corr("ra", "rb").alias("rho"))


def mean_agreement(matrices: DataFrame) -> DataFrame:
    return matrices.groupBy("a", "b").agg(F.avg("rho").alias("rho"), F.count("rho").alias("n_folds"))


def waterfall(parts: DataFrame, base: float, k: int = 12) -> DataFrame:
    """(row_id, place, feature, value, total): the k largest, the rest as (other), running totals."""
    r = F.row_number().over(Window.partitionBy("row_id").orderBy(F.abs("value").desc(), "feature"))
    kept = parts.withColumn("place", F.least(r, F.lit(k + 1))).groupBy("row_id", "place").agg(F.when(F.col("place") > k, "(other)").otherwise(F.max("feature")).alias("feature"), F.sum("value").alias("value"))
    return kept.withColumn("total", base + F.sum("value").over(Window.partitionBy("row_id").orderBy("place")))
