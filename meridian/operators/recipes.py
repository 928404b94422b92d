"""Feature recipes as Spark ML stages: an estimator fits knots, means, modes, levels and scales, or chained forests, on
whatever rows it is given, so cross-validation fits them anew in each fold, and the fitted stages save and load."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasOutputCol
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import RECIPES, Encoder, Recipe
from .steps import Stored, stored


def _param(name: str, doc: str, kind=TypeConverters.identity) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class RecipeParams(HasOutputCol):
    continuous = _param("continuous", "columns of numbers", TypeConverters.toListString)
    binary = _param("binary", "columns of 0 and 1", TypeConverters.toListString)
    categories = _param("categories", "columns of levels, without nulls", TypeConverters.toListString)
    passed = _param("passed", "columns that go through as they are", TypeConverters.toListString)
    scaled = _param("scaled", "whether numbers are imputed and scaled", TypeConverters.toBoolean)
    splines = _param("splines", "whether numbers get spline terms", TypeConverters.toBoolean)

    def _columns(self) -> tuple[list[str], ...]:
        return tuple(self.getOrDefault(p) for p in (self.continuous, self.binary, self.categories, self.passed))


class RecipeEstimator(Estimator, RecipeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a RecipeModel on the rows at hand."""

    @keyword_only
    def __init__(self, *, continuous=None, binary=None, categories=None, passed=None, scaled=True, splines=True, outputCol="features"):
        super().__init__()
        self._setDefault(continuous=[], binary=[], categories=[], passed=[], scaled=True, splines=True, outputCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> RecipeModel:
        continuous, binary, categories, passed = self._columns()
        state: dict = {"levels": Encoder.fit(dataset, categories, []).levels if categories else {}}
        plain = [*passed] if self.getOrDefault(self.scaled) else [*continuous, *binary, *passed]
        ends = dataset.agg(F.lit(1), *[F.struct(F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))).alias(c) for c in plain]).first()
        state["missing"] = {c: 2 * (ends[c][0] or 0.0) - (ends[c][1] or 0.0) - 1.0 for c in plain}
        if self.getOrDefault(self.scaled):
            fitted = Recipe.fit(dataset, continuous, binary, [], splines=self.getOrDefault(self.splines))
            state |= {"means": fitted.means, "modes": fitted.modes, "knots": fitted.knots, "scale": {n: list(s) for n, s in fitted.scale.items()}}
        return self._copyValues(RecipeModel()._set(state=state))


class RecipeModel(Model, RecipeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the vector of the recipe's features: levels as zeros and ones, numbers, passed columns.

    MLlib's vectors hold neither null nor NaN: one that the recipe leaves is a number well below the least that was
    fitted, so that a tree can tell it apart."""

    state = _param("state", "what was fitted: levels, means, modes, knots, scale")

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(continuous=[], binary=[], categories=[], passed=[], scaled=True, splines=True, outputCol="features")

    def columns(self) -> dict[str, Column]:
        """The features by name."""
        continuous, binary, _, passed = self._columns()
        state = self.getOrDefault(self.state)
        hot = {f"{c}__{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, vs in state["levels"].items() for v in vs}
        if self.getOrDefault(self.scaled):
            numbers = Recipe(state["means"], state["modes"], state["knots"], {n: tuple(s) for n, s in state["scale"].items()}, []).columns()
        else:
            numbers = {c: F.col(c).cast("double") for c in [*continuous, *binary]}
        return hot | numbers | {c: F.col(c).cast("double") for c in passed}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        missing = self.getOrDefault(self.state)["missing"]
        made = [F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(missing.get(n))) if n in missing else c for n, c in self.columns().items()]
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.array(*made)))


class ForestParams(Params):
    columns = _param("columns", "columns to impute, each from the others", TypeConverters.toListString)
    binary = _param("binary", "those of 0 and 1", TypeConverters.toListString)
    rounds = _param("rounds", "most rounds", TypeConverters.toInt)
    trees = _param("trees", "trees of a forest", TypeConverters.toInt)
    seed = _param("seed", "seed of the forests", TypeConverters.toInt)
    tolerance = _param("tolerance", "a round that changes no cell by more than this share of the largest number is the last", TypeConverters.toFloat)

    def _ready(self, dataset: DataFrame, first: dict[str, float]) -> DataFrame:
        """dataset with nulls filled by the first guess, and flags of where they were."""
        gaps = {f"_null_{c}": F.col(c).isNull() for c in first}
        return dataset.withColumns(gaps).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in first.items()})

    def _filled(self, table: DataFrame, column: str, forest: Model) -> DataFrame:
        inputs = VectorAssembler(inputCols=[c for c in self.getOrDefault(self.columns) if c != column], outputCol="_x", handleInvalid="keep")
        made = forest.transform(inputs.transform(table))
        return made.withColumn(column, F.when(F.col(f"_null_{column}"), F.col("_y")).otherwise(F.col(column))).drop("_x", "_y", "_raw", "_p")


_FOREST = {"rounds": 10, "trees": 50, "seed": 5, "tolerance": 1e-3, "binary": []}


class ForestImputer(Estimator, ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Chained imputation: each column's nulls are predicted from the others by a forest of the rows that have it, round
    after round over written tables, until a round changes little. The plan of a round does not grow with the rounds."""

    @keyword_only
    def __init__(self, *, columns=None, binary=None, rounds=10, trees=50, seed=5, tolerance=1e-3):
        super().__init__()
        self._setDefault(**_FOREST)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ForestImputerModel:
        columns, binary = self.getOrDefault(self.columns), self.getOrDefault(self.binary)
        facts = dataset.agg(*[F.struct(F.avg(c).alias("mean"), F.max(F.abs(F.col(c).cast("double"))).alias("most"), F.count_if(F.col(c).isNull()).alias("gaps")).alias(c) for c in columns]).first()
        first = {c: float((facts[c]["mean"] or 0.0) > 0.5) if c in binary else float(facts[c]["mean"] or 0.0) for c in columns}
        limit = self.getOrDefault(self.tolerance) * max((facts[c]["most"] or 0.0 for c in columns), default=0.0)
        open_ = [c for c in columns if facts[c]["gaps"]]
        table = stored(self._ready(dataset.select(*columns), first), "impute")
        forests: list[tuple[str, Model]] = []
        rounds = 0
        for _ in range(self.getOrDefault(self.rounds)):
            rounds += 1
            table = stored(table.rows.withColumns({f"_old_{c}": F.col(c) for c in open_}), "impute", table)
            for c in columns:  # one without nulls has a forest too, for rows to come
                forest = self._forest(table.rows, c, columns, c in binary)
                forests.append((c, forest))
                if c in open_:
                    table = stored(self._filled(table.rows, c, forest), "impute", table)
            moved = table.rows.agg(F.greatest(F.lit(0.0), F.lit(0.0), *[F.max(F.abs(F.col(c) - F.col(f"_old_{c}"))) for c in open_]).alias("m")).first()["m"]
            if not moved > limit:
                break
        table.remove()
        model = ForestImputerModel()._set(first=first, fitted=[c for c, _ in forests], done=rounds)
        model.forests = [m for _, m in forests]
        return self._copyValues(model)

    def _forest(self, table: DataFrame, column: str, columns: list[str], binary: bool) -> Model:
        known = VectorAssembler(inputCols=[c for c in columns if c != column], outputCol="_x", handleInvalid="keep").transform(table.where(~F.col(f"_null_{column}")))
        made = {"featuresCol": "_x", "labelCol": column, "predictionCol": "_y", "numTrees": self.getOrDefault(self.trees), "maxDepth": 5, "seed": self.getOrDefault(self.seed)}
        return (RandomForestClassifier(**made, rawPredictionCol="_raw", probabilityCol="_p") if binary else RandomForestRegressor(**made)).fit(known)


class ForestImputerModel(Model, ForestParams, MLReadable, MLWritable):
    """Fills nulls as the fitted rounds did. Rounds but the last are written, so the plan stays that of one."""

    first = _param("first", "first guesses")
    fitted = _param("fitted", "columns of the forests in turn", TypeConverters.toListString)
    done = _param("done", "rounds that were fitted", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(**_FOREST)
        self.forests: list[Model] = []

    def copy(self, extra=None) -> ForestImputerModel:
        made = super().copy(extra)
        made.forests = self.forests
        return made

    def _transform(self, dataset: DataFrame) -> DataFrame:
        first, fitted, done = (self.getOrDefault(p) for p in (self.first, self.fitted, self.done))
        a_round, table = len(fitted) // max(1, done), self._ready(dataset, first)
        before: Stored | None = None
        for k, (column, forest) in enumerate(zip(fitted, self.forests, strict=True), 1):
            table = self._filled(table, column, forest)
            if k % a_round == 0 and k < len(fitted):
                before = stored(table, "impute", before)
                table = before.rows
        return table.drop(*[f"_null_{c}" for c in first])

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, instance: ForestImputerModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for k, forest in enumerate(self.instance.forests):
            forest.write().save(f"{path}/forests/{k}")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestImputerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestImputerModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        binary = model.getOrDefault(model.binary)
        kinds = [RandomForestClassificationModel if c in binary else RandomForestRegressionModel for c in model.getOrDefault(model.fitted)]
        model.forests = [kind.load(f"{path}/forests/{k}") for k, kind in enumerate(kinds)]
        return model


def recipe_stages(recipe: str, continuous: list[str], binary: list[str] = (), categories: list[str] = (), passed: list[str] = (), rounds: int = 10, trees: int = 50) -> list[Estimator]:
    """Stages of one of the four recipes (see features.prepared), to stand before a classifier in a Pipeline."""
    if recipe not in RECIPES:
        raise ValueError(f"unknown recipe {recipe}")
    forest = [ForestImputer(columns=[*continuous, *binary], binary=list(binary), rounds=rounds, trees=trees)] if recipe in ("forest", "scaled_forest") else []
    return [*forest, RecipeEstimator(continuous=list(continuous), binary=list(binary), categories=list(categories), passed=list(passed), scaled=recipe in ("splines", "scaled_forest"), splines=recipe == "splines")]


def recipe_pipeline(recipe: str, classifier: Estimator, continuous: list[str], **columns) -> Pipeline:
    """The recipe and the classifier as one estimator: whoever fits it fits both on the same rows."""
    return Pipeline(stages=[*recipe_stages(recipe, continuous, **columns), classifier])
