"""Splits and samples as columns on the rows, drawn by hashes of row ids: they do not depend on
partitions or row order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import matched, portable_hash
from .steps import stored

SEED = 20260505


def leave_one_out(df: DataFrame, domain: str) -> DataFrame:
    """Each row once for each domain value: fold, and role test in its own fold, train elsewhere."""
    folds = df.select(F.col(domain).alias("fold")).where("fold IS NOT NULL").distinct()
    named = folds.agg(F.array_sort(F.collect_list("fold")).alias("_folds"))  # one row: domains are few by definition
    return df.where(F.col(domain).isNotNull()).crossJoin(named).withColumn("fold", F.explode("_folds")).drop("_folds").withColumn("role", F.when(F.col(domain) == F.col("fold"), "test").otherwise("train"))


def placed(df: DataFrame, keys: list[str], row_id: str, seed: int, place: str, total: str) -> DataFrame:
    """df with the row's place (from 1) among those of equal keys in the order of a hash of row_id, and
    their number. The hash deals a key's rows to 1,024 ranges, so no task orders all of them."""
    made = df.withColumn("_hash", portable_hash(F.lit(seed), F.col(row_id))).withColumn("_range", F.shiftright("_hash", 22))
    whole = Window.partitionBy(*keys)
    counts = made.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumns({"_before": F.sum("_n").over(whole.orderBy("_range")) - F.col("_n"), total: F.sum("_n").over(whole)}).drop("_n")
    inside = made.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_hash", row_id)))
    return matched(inside, counts, [*keys, "_range"]).withColumn(place, (F.col("_before") + F.col("_inside")).cast("int")).drop("_hash", "_range", "_before", "_inside")


def drawn(row_id: str, seed: int = SEED) -> Column:
    """The hash by which splits and samples are drawn: who draws often from the same rows keeps it in a column."""
    return portable_hash(F.lit(seed), F.col(row_id))


def among_first(df: DataFrame, keys: list[str], row_id: str, seed: int, limits: dict[str, Column], draw: str | None = None) -> DataFrame:
    """df with a boolean for each of limits: whether the row's place (see placed) is no larger. Limits are made of the keys
    and _total, the number of rows of equal keys; rows of one id go together. draw names a column that holds the hash (see drawn).

    Counts by ranges of the hash tell in which range a limit lies, and only the rows of these few ranges are put in
    order, to find the last row within. All other rows are compared with it where they are."""
    made = df.withColumn("_hash", F.col(draw) if draw else drawn(row_id, seed)).withColumn("_range", F.shiftright("_hash", 22))
    whole = Window.partitionBy(*keys)
    counts = made.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumns({"_before": F.sum("_n").over(whole.orderBy("_range")) - F.col("_n"), "_total": F.sum("_n").over(whole)})
    lies = {f"_at_{n}": (F.col("_before") < c) & (F.least(c, F.col("_total")) <= F.col("_before") + F.col("_n")) for n, c in limits.items()}
    edges = counts.withColumns({f"_limit_{n}": F.least(c, F.col("_total")) for n, c in limits.items()} | lies).where(" OR ".join(lies))
    edges = stored(edges.drop("_total", "_n"), "edges").rows  # two ranges for each limit and key at most
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    near = made.select(*keys, row_id, "_hash", "_range").join(edges.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_range": "_r"}), same)
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_hash", row_id)) + F.col("_before")
    last = {n: F.max(F.when(F.col(f"_at_{n}") & (F.col("_place") <= F.col(f"_limit_{n}")), F.struct("_hash", row_id))).alias(f"_last_{n}") for n in limits}
    cuts = stored(near.withColumn("_place", place).groupBy(*keys).agg(*last.values()), "cuts").rows  # a row for each key
    inside = {n: F.coalesce(F.struct("_hash", row_id) <= F.col(f"_last_{n}"), F.lit(False)) for n in limits}
    return matched(made.drop("_range"), cuts, keys).withColumns(inside).drop("_hash", *[f"_last_{n}" for n in limits])


def within_split(df: DataFrame, keys: list[str], target: str, row_id: str, val: float = 0.1, calib: float = 0.1, seed: int = SEED, draw: str | None = None) -> DataFrame:
    """split: train, val or calib, stratified by target with exact sizes in each stratum. draw: see among_first."""
    if val <= 0 or calib <= 0 or val + calib >= 1:
        raise ValueError("shares must be positive and leave rows to train on")
    n = F.col("_total")
    n_val, n_calib = F.bround(n * val), F.bround(n * calib)
    made = among_first(df, [*keys, target], row_id, seed, {"_val": n_val, "_held": n_val + n_calib}, draw)
    return made.withColumn("split", F.when(F.col("_val"), "val").when(F.col("_held"), "calib").otherwise("train")).drop("_val", "_held")


def random_folds(df: DataFrame, target: str, row_id: str, k: int = 5, seed: int = SEED) -> DataFrame:
    made = placed(df, [target], row_id, seed, "_place", "_total")
    return made.withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_place", "_total")


def overlaps(df: DataFrame, row_id: str, split: str) -> DataFrame:
    """Row ids that are in more than one split: none, if the splits are sound."""
    return df.groupBy(row_id).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def _sizes(target: str) -> list[Column]:
    positive = F.col(target) == 1
    return [F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"), F.avg(positive.cast("int")).alias("share")]


def capped_samples(df: DataFrame, target: str, row_id: str, most: int, forced: dict[str, DataFrame], seed: int = SEED, draw: str | None = None) -> dict[str, DataFrame]:
    """A capped_sample for each table of forced rows. All are drawn from one table of the rows that any of them can
    hold, the forced ones and as many others of each target as come first, so df is not read again for each."""
    ids = reduce(DataFrame.unionByName, [t.select(F.col(row_id).alias("_f")) for t in forced.values()]).distinct()
    ids = stored(ids, "forced").rows
    held = stored(df.join(ids, F.col(row_id) == F.col("_f"), "left_semi"), "held").rows
    first = among_first(df, [target], row_id, seed, {"_first": F.lit(most + held.count())}, draw).where("_first").drop("_first")
    near = stored(first.join(ids, F.col(row_id) == F.col("_f"), "left_anti").unionByName(held), "near").rows
    whole = df.agg(*_sizes(target)).first()
    return {k: capped_sample(near, target, row_id, most, t, seed, whole.asDict()) for k, t in forced.items()}


def capped_sample(df: DataFrame, target: str, row_id: str, most: int, forced: DataFrame, seed: int = SEED, whole: dict | None = None) -> DataFrame:
    """The forced rows (a table of row ids), all of them, and others up to `most` rows in all: as many
    positives as their share of all rows gives, then negatives; neither gives more than it has. All rows,
    if they are no more than `most`. whole has the sizes of the table from which df was cut, if it was (see capped_samples)."""
    ids = forced.select(F.col(row_id).alias("_f")).distinct()
    marked = df.join(ids, F.col(row_id) == F.col("_f"), "left").withColumn("_forced", F.col("_f").isNotNull()).drop("_f")
    positive = F.col(target) == 1
    sizes = marked.agg(F.count_if("_forced").alias("held"), F.count_if(F.col("_forced") & positive).alias("held_pos"), F.count_if(F.col("_forced") & ~positive).alias("held_neg"), *_sizes(target))
    if whole:
        sizes = sizes.withColumns({k: F.lit(whole[k]) for k in ("n", "pos", "neg", "share")})
    sizes = sizes.withColumns({"pos": F.col("pos") - F.col("held_pos"), "neg": F.col("neg") - F.col("held_neg")})
    budget = F.greatest(F.lit(most) - F.col("held"), F.lit(0))
    q1 = F.when(F.col("n") <= most, F.col("pos")).otherwise(F.least(F.bround(budget * F.col("share")).cast("long"), F.col("pos")))
    quota = sizes.select(q1.alias("q1"), F.least(budget - q1, F.col("neg")).alias("q0")).first()
    limit = F.when(positive, F.lit(quota["q1"])).otherwise(F.lit(quota["q0"]))
    rest = among_first(marked, [target, "_forced"], row_id, seed, {"_within": limit})
    return rest.where(F.col("_forced") | F.col("_within")).drop("_forced", "_within")
