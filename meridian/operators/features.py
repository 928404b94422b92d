"""Feature recipes fitted on training rows and applied anywhere. Fits are small tables or Python
values: knots, levels, means, modes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

#: Quantiles of the knots for each number of them.
KNOTS = {3: (0.10, 0.50, 0.90), 4: (0.05, 0.35, 0.65, 0.95), 5: (0.05, 0.275, 0.50, 0.725, 0.95)}


def fit_knots(train: DataFrame, columns: list[str], k: int = 4) -> dict[str, list[float]]:
    """Knots of all columns, by selection; fewer than k rows or three distinct knots are an error."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    found = {r["feature"]: r for r in exact_quantiles(long, ["feature"], "value", list(KNOTS[k])).collect()}  # a row a column
    out = {}
    for c in columns:
        knots = sorted(set(found[c]["q"])) if c in found else []
        if c not in found or found[c]["n"] < k or len(knots) < 3:
            raise ValueError(f"{c} has too few distinct values for a spline")
        out[c] = knots
    return out


def spline_names(column: str, knots: list[float]) -> list[str]:
    return [column, *[f"{column}_rcs{j}" for j in range(1, len(knots) - 1)]]


def spline(x: Column, knots: list[float]) -> list[Column]:
    """The value and its k - 2 restricted cubic terms, linear beyond the outer knots."""
    t, last, before = knots, knots[-1], knots[-2]
    cube = lambda a: F.pow(F.greatest(x - a, F.lit(0.0)), 3)
    terms = [(cube(t[j]) - cube(before) * ((last - t[j]) / (last - before)) + cube(last) * ((before - t[j]) / (last - before))) / (last - t[0]) ** 2 for j in range(len(t) - 2)]
    return [x, *[F.when(x.isNotNull(), v) for v in terms]]


@dataclass
class Encoder:
    """Levels of the categorical columns, and numeric columns, as one array in a fixed order."""

    levels: dict[str, list[str]]
    numbers: list[str]
    names: list[str] = field(init=False)
    groups: dict[str, list[int]] = field(init=False)

    def __post_init__(self) -> None:
        self.names = [f"{c}__{v}" for c, vs in self.levels.items() for v in vs] + self.numbers
        self.groups = {c: [i for i, n in enumerate(self.names) if n.startswith(f"{c}__")] for c in self.levels} | {n: [self.names.index(n)] for n in self.numbers}

    @classmethod
    def fit(cls, train: DataFrame, categories: list[str], numbers: list[str]) -> Encoder:
        row = train.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in categories], *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in categories]).first()
        if bad := [c for c in categories if row[f"n_{c}"]]:
            raise ValueError(f"nulls in {bad}: label them first")
        return cls({c: list(row[c]) for c in categories}, numbers)

    def encode(self) -> Column:
        """Zeros for a level that was not fitted."""
        hot = [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, vs in self.levels.items() for v in vs]
        return F.array(*hot, *[F.col(n).cast("double") for n in self.numbers])

    def decode(self, encoded: Column) -> dict[str, Column]:
        """Each block's largest place (the first of equals) as its level, and the numbers."""
        out = {}
        for c, vs in self.levels.items():
            block = F.slice(encoded, self.groups[c][0] + 1, len(vs))
            out[c] = F.element_at(F.array(*map(F.lit, vs)), F.array_position(block, F.array_max(block)).cast("int"))
        return out | {n: F.get(encoded, self.groups[n][0]) for n in self.numbers}


@dataclass
class Recipe:
    """Mean or mode for nulls, splines, and scaling by the population deviation."""

    means: dict[str, float]
    modes: dict[str, float]
    knots: dict[str, list[float]]
    scale: dict[str, tuple[float, float]]
    passed: list[str]

    @classmethod
    def fit(cls, train: DataFrame, continuous: list[str], binary: list[str], passed: list[str], splines: bool = True) -> Recipe:
        row = train.agg(*[F.avg(c).alias(c) for c in continuous]).first()
        means = {c: float(row[c] or 0.0) for c in continuous}
        modes = {}
        for c in binary:  # a handful of values each
            first = train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.col("count").desc(), c).first()
            modes[c] = float(first[0]) if first else 0.0
        knots = fit_knots(train, continuous) if splines else {}
        made = cls(means, modes, knots, {}, passed)
        parts = made._unscaled()
        stats = train.agg(*[F.struct(F.avg(v), F.stddev_pop(v)).alias(n) for n, v in parts.items()]).first()
        made.scale = {n: (float(stats[n][0] or 0.0), float(stats[n][1] or 0.0) or 1.0) for n in parts}
        return made

    def _unscaled(self) -> dict[str, Column]:
        out = {}
        for c, mean in self.means.items():
            x = F.coalesce(F.col(c).cast("double"), F.lit(mean))
            out |= dict(zip(spline_names(c, self.knots[c]), spline(x, self.knots[c]), strict=True)) if c in self.knots else {c: x}
        return out | {c: F.coalesce(F.col(c).cast("double"), F.lit(mode)) for c, mode in self.modes.items()}

    def columns(self) -> dict[str, Column]:
        scaled = {n: (v - self.scale[n][0]) / self.scale[n][1] for n, v in self._unscaled().items()}
        return scaled | {c: F.col(c).cast("double") for c in self.passed}


def forest_impute(df: DataFrame, columns: list[str], trained: Column, rounds: int = 10, trees: int = 50, seed: int = 5, binary: tuple[str, ...] = (), tolerance: float = 1e-3) -> DataFrame:
    """Chained imputation fitted on the rows where `trained` holds (see recipes.ForestImputer); only cells that
    were null are filled. Columns of binary (0 or 1) begin with their mode and get a classifier's answer."""
    from .recipes import ForestImputer  # it is made of this module's parts

    imputer = ForestImputer(columns=columns, binary=list(binary), rounds=rounds, trees=trees, seed=seed, tolerance=tolerance)
    return imputer.fit(df.where(trained)).transform(df)


RECIPES = ("plain", "forest", "splines", "scaled_forest")


def prepared(df: DataFrame, recipe: str, trained: Column, continuous: list[str], binary: list[str], categories: list[str], passed: list[str], rounds: int = 10, trees: int = 50) -> tuple[DataFrame, dict[str, Column]]:
    """The table and named feature columns of one of four recipes, all fitted on the rows where `trained`
    holds: levels as zeros and ones (a level not fitted: zeros) and passed columns as they are, with
    plain: numbers as they are, nulls too; forest: numbers imputed by forests; splines: mean or mode, spline
    terms, scaled; scaled_forest: imputed by forests, then scaled."""
    if recipe not in RECIPES:
        raise ValueError(f"unknown recipe {recipe}")
    levels = Encoder.fit(df.where(trained), categories, [])
    hot = {f"{c}__{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, vs in levels.levels.items() for v in vs}
    if recipe in ("forest", "scaled_forest"):
        df = forest_impute(df, [*continuous, *binary], trained, rounds, trees, binary=tuple(binary))
    if recipe in ("plain", "forest"):
        numbers = {c: F.col(c).cast("double") for c in [*continuous, *binary]}
    else:
        numbers = Recipe.fit(df.where(trained), continuous, binary, [], splines=recipe == "splines").columns()
    return df, hot | numbers | {c: F.col(c).cast("double") for c in passed}
