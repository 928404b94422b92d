"""Fitting, tuning and calibration with MLlib; predictions of all cells go to one long table."""

from __future__ import annotations

import random
import time
from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .steps import stored

GRID = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)


def lasso(c: float, n: int, **more) -> LogisticRegression:
    """L1 logistic regression with the inverse strength c of a sum over n rows."""
    return LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * max(n, 1)), standardization=False, **more)


def tuned(base: Estimator, maps: list[dict], train: DataFrame, fold: str, folds: int, stages: Sequence[Estimator] = (), parallelism: int = 4, seconds: float | None = None):
    """Cross-validation of base over maps by AUROC on the given folds: what has the best of them, fitted again on all rows.

    stages come before base and are fitted within each fold, on its training rows alone. With seconds, maps are
    tried parallelism at a time while they last; the first ones always are. avgMetrics has those tried."""
    estimator, evaluator = Pipeline(stages=[*stages, base]) if stages else base, BinaryClassificationEvaluator(labelCol=base.getLabelCol())
    step, began, best, metrics = len(maps) if seconds is None else parallelism, time.monotonic(), None, []
    for k in range(0, len(maps), step):
        if k and time.monotonic() - began > seconds:
            break
        found = CrossValidator(estimator=estimator, estimatorParamMaps=maps[k : k + step], evaluator=evaluator, numFolds=folds, foldCol=fold, parallelism=parallelism).fit(train)
        if best is None or max(found.avgMetrics) > max(best.avgMetrics):
            best = found
        metrics += found.avgMetrics
    best.avgMetrics = metrics
    return best


def tune_lasso(train: DataFrame, fold: str, folds: int, grid: tuple[float, ...] = GRID, parallelism: int = 4, stages: Sequence[Estimator] = (), **more):
    """The best of the grid by AUROC over the given folds, fitted again on all rows (features, label); see tuned."""
    n, base = train.count(), LogisticRegression(elasticNetParam=1.0, standardization=False, **more)
    params = ParamGridBuilder().addGrid(base.regParam, [1.0 / (c * max(n, 1)) for c in grid]).build()
    return tuned(base, params, train, fold, folds, stages, parallelism)


def boosting_draws(base: GBTClassifier, trials: int, seed: int) -> list[dict]:
    """Seeded draws over eight parameters: rounds, depth, rate, rows and columns sampled, least rows and
    least gain of a split, and bins."""
    draw = random.Random(seed)
    return [
        {
            base.maxIter: draw.choice([5, 10, 20]), base.maxDepth: draw.randint(2, 5), base.stepSize: 10 ** draw.uniform(-2, -0.5), base.subsamplingRate: draw.uniform(0.6, 1.0),
            base.featureSubsetStrategy: str(round(draw.uniform(0.5, 1.0), 3)), base.minInstancesPerNode: draw.randint(1, 10), base.minInfoGain: 10 ** draw.uniform(-8, -2), base.maxBins: draw.choice([32, 64]),
        }
        for _ in range(trials)
    ]


def tune_boosting(train: DataFrame, fold: str, folds: int, trials: int = 50, seed: int = 20260505, parallelism: int = 4, stages: Sequence[Estimator] = (), seconds: float | None = None):
    """The best of seeded random draws over the boosting parameters, by AUROC over the folds; see tuned."""
    base = GBTClassifier(seed=seed)
    return tuned(base, boosting_draws(base, trials, seed), train, fold, folds, stages, parallelism, seconds)


def scored(model: Model, rows: DataFrame) -> DataFrame:
    """rows with p, the probability of the positive class."""
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def weighted(estimator: Estimator) -> bool:
    """Whether equal rows, counted in a weight, are to the estimator what they are one by one: not if it draws from rows or counts them."""
    value = lambda name, usual: estimator.getOrDefault(name) if estimator.hasParam(name) else usual
    return estimator.hasParam("weightCol") and not estimator.isSet("weightCol") and value("subsamplingRate", 1.0) == 1.0 and value("minInstancesPerNode", 1) == 1


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, weight): rows that are equal in keys once, with their number."""
    return rows.groupBy(*keys).agg(F.sum(_weight(rows)).cast("double").alias("weight"))


def _weight(rows: DataFrame) -> Column:
    return F.col("weight") if "weight" in rows.columns else F.lit(1)


def isotonic(held: DataFrame) -> IsotonicRegression:
    """Fitted on held-out rows (y, p, and weight, if rows are counted), of both classes."""
    _both(held)
    rows = VectorAssembler(inputCols=["p"], outputCol="_f").transform(counted(held.withColumn("y", F.col("y").cast("double")), "p", "y"))
    return IsotonicRegression(featuresCol="_f", labelCol="y", predictionCol="_c", weightCol="weight").fit(rows)


def apply_isotonic(model, rows: DataFrame) -> DataFrame:
    made = model.transform(VectorAssembler(inputCols=["p"], outputCol="_f").transform(rows))
    return made.withColumn("p", F.least(F.greatest("_c", F.lit(0.0)), F.lit(1.0))).drop("_f", "_c")


def _both(held: DataFrame) -> tuple[int, int]:
    w = _weight(held)
    row = held.agg(F.coalesce(F.sum(F.col("y") * w), F.lit(0)).alias("pos"), F.coalesce(F.sum(F.when(F.col("y").isNotNull(), w)), F.lit(0)).alias("n")).first()
    if not 0 < row["pos"] < row["n"]:
        raise ValueError("calibration needs both classes")
    return int(row["pos"]), int(row["n"] - row["pos"])


def platt(held: DataFrame, score: str = "p", rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a sigmoid on the score, with smoothed targets, by Newton steps over
    five sums. A row of held counts weight times, if it has that column."""
    pos, neg = _both(held)
    target = F.when(F.col("y") == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
    counts = held.select(F.col(score).cast("double").alias("s"), target.alias("t"), _weight(held).alias("w")).groupBy("s", "t").agg(F.sum("w").alias("n")).cache()
    a = b = 0.0
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(F.lit(a) * F.col("s") + F.lit(b))))
        g, w = F.col("n") * (F.col("t") - q), F.col("n") * q * (1 - q)
        r = counts.agg(F.sum(g * F.col("s")).alias("ga"), F.sum(g).alias("gb"), F.sum(w * F.col("s") * F.col("s")).alias("aa"), F.sum(w * F.col("s")).alias("ab"), F.sum(w).alias("bb")).first()
        det = r["aa"] * r["bb"] - r["ab"] ** 2
        if abs(det) < 1e-14:
            break
        da, db = (r["bb"] * r["ga"] - r["ab"] * r["gb"]) / det, (r["aa"] * r["gb"] - r["ab"] * r["ga"]) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < 1e-9:
            break
    counts.unpersist()
    return a, b


def calibrated(kind: str, held: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with p calibrated on held: isotonic, sigmoid, or native (unchanged)."""
    if kind == "native":
        return rows
    if kind == "isotonic":
        return apply_isotonic(isotonic(held), rows)
    if kind == "sigmoid":
        a, b = platt(held)
        return rows.withColumn("p", 1 / (1 + F.exp(-(F.lit(a) * F.col("p") + F.lit(b)))))
    raise ValueError(f"unknown calibration {kind}")


def run_cells(df: DataFrame, folds: list[str], stages: Sequence[Estimator], models: dict[str, Estimator], target: str, path: str, fold: str = "fold", calibration: dict[str, str] | None = None) -> DataFrame:
    """Long predictions (fold, model, row_id, y, p): for each fold the stages and models are fitted on its
    training rows, calibrated on its calib rows and applied to its test rows. Training and calib rows that are equal
    in features and label are fitted once, with their number as weight (see weighted).

    df has fold, split (train, calib, test), row_id and target. Each cell's fitted pipeline and predictions are
    written below path; a cell that is there whole is not fitted again, so a run that broke off goes on."""
    spark = df.sparkSession
    for name in folds:
        own = df.where(F.col(fold) == name).withColumn("label", F.col(target).cast("double"))
        todo = {k: m for k, m in models.items() if not _exists(spark, f"{path}/predictions/fold={name}/model={k}/_SUCCESS")}
        if not todo:
            continue
        prepared = Pipeline(stages=list(stages)).fit(own.where("split = 'train'"))
        known = stored(counted(prepared.transform(own.where("split IN ('train', 'calib')")), "split", "label", "features"), "known")
        ready = stored(prepared.transform(own.where("split = 'test'")).select("row_id", "label", "features"), "cell")
        for model_name, estimator in todo.items():
            if weighted(estimator):
                model = estimator.fit(known.rows.where("split = 'train'"), {estimator.weightCol: "weight"})
            else:
                model = estimator.fit(prepared.transform(own.where("split = 'train'")).select("label", "features"))
            PipelineModel(stages=[*prepared.stages, model]).write().overwrite().save(f"{path}/models/{name}-{model_name}")
            y = F.col("label").cast("int").alias("y")
            held = scored(model, known.rows.where("split = 'calib'")).select(y, "p", "weight")
            made = calibrated((calibration or {}).get(model_name, "native"), held, scored(model, ready.rows).select("row_id", y, "p"))
            made.write.mode("overwrite").parquet(f"{path}/predictions/fold={name}/model={model_name}")
        ready.remove()
        known.remove()
    rows = spark.read.option("basePath", f"{path}/predictions").parquet(*[f"{path}/predictions/fold={name}/model={k}" for name in folds for k in models])
    return rows.select(F.col("fold").cast("string").alias("fold"), F.col("model").cast("string").alias("model"), "row_id", "y", "p")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
