"""Queries over feature, model and explanation operators; line items as records, with the return
flag as target and the line status as domain."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explain as X
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import splits as S
from ..operators.recipes import recipe_stages
from ..operators.steps import stored
from .evaluation import PREDS, predictions
from .tables import load, scratch

QUERIES, ORACLE_SQL = {}, {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


NUMBERS = ["l_quantity", "l_discount", "l_tax"]
KNOTS = "k AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0.05, 0.35, 0.65, 0.95]))) AS t FROM lineitem)"
CUBE = "greatest(l_quantity - {}, 0) ** 3"


def _term(j: int) -> str:
    return f"({CUBE.format(f't[{j}]')} - {CUBE.format('t[3]')} * (t[4] - t[{j}]) / (t[4] - t[3]) + {CUBE.format('t[4]')} * (t[3] - t[{j}]) / (t[4] - t[3])) / (t[4] - t[1]) ** 2"


@_query(f"WITH {KNOTS}, x AS (SELECT l_returnflag, l_quantity AS a, {_term(1)} AS b, {_term(2)} AS c FROM lineitem, k) SELECT l_returnflag, round(sum(a), 3) AS l_quantity, round(sum(b), 3) AS l_quantity_rcs1, round(sum(c), 3) AS l_quantity_rcs2 FROM x GROUP BY 1")
def fe02_spline(spark, sf_dir):
    """FE-01, 02, 03."""
    li = load(spark, sf_dir, "lineitem")
    knots = FE.fit_knots(li, ["l_quantity"])["l_quantity"]
    names = FE.spline_names("l_quantity", knots)
    made = li.select("l_returnflag", *[c.alias(n) for n, c in zip(names, FE.spline(F.col("l_quantity"), knots), strict=True)])
    return made.groupBy("l_returnflag").agg(*[F.round(F.sum(n), 3).alias(n) for n in names])


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 3) AS l_quantity FROM lineitem GROUP BY ALL")
def fe10_encode_decode(spark, sf_dir):
    """FE-04, 09, 10: encoded, then decoded again."""
    li = load(spark, sf_dir, "lineitem")
    enc = FE.Encoder.fit(li, ["l_returnflag", "l_linestatus"], ["l_quantity"])
    back = li.select(enc.encode().alias("e")).select(*[c.alias(n) for n, c in enc.decode(F.col("e")).items()])
    return back.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 3).alias("l_quantity"))


@_query("""WITH d AS (SELECT CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity END AS q, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_linenumber % 2 END AS b FROM lineitem), m AS (SELECT avg(q) AS mq, (SELECT b FROM d WHERE b IS NOT NULL GROUP BY b ORDER BY count(*) DESC, b LIMIT 1) AS mb FROM d),
f AS (SELECT coalesce(q, mq) AS q, coalesce(b, mb) AS b FROM d, m), s AS (SELECT avg(q) AS aq, stddev_pop(q) AS sq, avg(b) AS ab, stddev_pop(b) AS sb FROM f)
SELECT count(*) AS n, round(min((q - aq) / sq), 6) AS min_q, round(max((q - aq) / sq), 6) AS max_q, round(max((b - ab) / sb), 6) AS max_b FROM f, s""")
def fe05_impute_scale(spark, sf_dir):
    """FE-05, 06, 08."""
    d = load(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 10 != 0, F.col("l_quantity")).alias("q"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_linenumber") % 2).alias("b"))
    made = d.select(*[c.alias(n) for n, c in FE.Recipe.fit(d, ["q"], ["b"], [], splines=False).columns().items()])
    return made.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("q"), 6).alias("min_q"), F.round(F.max("q"), 6).alias("max_q"), F.round(F.max("b"), 6).alias("max_b"))


@_query()
def fe07_forest_impute(spark, sf_dir):
    gaps = load(spark, sf_dir, "lineitem").select("l_linenumber", *[F.when(F.col("l_partkey") % (7 + i) != 0, F.col(c)).alias(c) for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount"])])
    made = FE.forest_impute(gaps, ["l_quantity", "l_extendedprice", "l_discount"], F.col("l_linenumber") <= 4, rounds=2, trees=10)
    return made.groupBy("l_linenumber").agg(F.count("l_quantity").alias("n"), F.round(F.avg("l_quantity"), 4).alias("l_quantity"), F.round(F.avg("l_extendedprice"), 2).alias("l_extendedprice"))


def _rows(spark: SparkSession, sf_dir: str, kept: str = "true") -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"), F.col("l_linestatus").alias("domain"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), *NUMBERS)
    li = stored(li.withColumn("draw", S.drawn("row_id")), "drawn").rows  # the hash is made once a row, not for each fold, split and sample
    folds = S.leave_one_out(li, "domain")
    split = S.within_split(folds.where("role = 'train'"), ["fold"], "y", "row_id", draw="draw").where("split <> 'val'")
    made = split.unionByName(folds.where("role = 'test'").withColumn("split", F.lit("test"))).where(kept)
    return stored(made, "rows").rows  # fits, samples and scores all read it


def _recipe(train: DataFrame):
    return FE.Recipe.fit(train, NUMBERS, [], [], splines=False).columns()


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = {"lasso": ML.lasso(1.0, 10_000, maxIter=10), "boosted": GBTClassifier(maxIter=2, maxDepth=3, seed=5)}
    stages = recipe_stages("splines", ["l_quantity"], passed=["l_discount", "l_tax"])
    return ML.run_cells(_rows(spark, sf_dir), ["F", "O"], stages, models, "y", scratch(spark, "cells"), calibration={"lasso": "sigmoid", "boosted": "isotonic"})


@_query()
def ml07_cells(spark, sf_dir):
    """ML-01, 04..07: two domains by two models, each fitted once and stored, scored in one grouped job."""
    made = _predictions(spark, sf_dir)
    return M.auroc(made, ["fold", "model"]).join(M.brier(made, ["fold", "model"]).withColumnRenamed("value", "brier"), ["fold", "model"])


@_query()
def ml02_tuned(spark, sf_dir):
    """ML-02, 03: labelled documents, quality from lengths; the whole grid, two draws, three folds, with knots, means and
    scales fitted within each fold."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n"), F.length(F.regexp_replace("text", "[a-z ]", "")).cast("double").alias("odd"))
    rows = S.random_folds(load(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("y", F.col("quality")), "y", "doc_id", 3)
    ready = stored(rows.select("fold", F.col("y").cast("double").alias("label"), F.log1p("n").alias("size"), F.log1p("odd").alias("odd"), (F.col("odd") / (F.col("n") + 1)).alias("share")), "labelled").rows
    stages = recipe_stages("splines", ["size", "odd"], passed=["share"])
    one, two = ML.tune_lasso(ready, "fold", 3, maxIter=25, stages=stages), ML.tune_boosting(ready, "fold", 3, 2, stages=stages)
    return spark.createDataFrame([("lasso", float(max(one.avgMetrics))), ("boosted", float(max(two.avgMetrics)))], "model string, auroc double")


LINEAR = "b AS (SELECT l_orderkey AS o, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity * 0.02::DOUBLE, l_discount * -3.0::DOUBLE, l_tax * 2.0::DOUBLE]) AS value, l_returnflag AS s FROM lineitem), p AS (SELECT o, ln, pk, sk, s, feature, sum(value) AS value FROM b GROUP BY ALL)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    made = X.linear_parts(F.array(*NUMBERS), [0.02, -3.0, 2.0], NUMBERS)
    rows = li.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"), F.col("l_returnflag").alias("s"), *NUMBERS)
    return X.summed_rows(rows, made, NUMBERS, X.raw_names(NUMBERS, NUMBERS), ["row_id", "s"])


@_query(f"WITH {LINEAR}, i AS (SELECT feature, avg(abs(value)) AS v FROM p GROUP BY 1) SELECT feature, round(v, 9) AS importance, (row_number() OVER (ORDER BY v DESC, feature))::INT AS rank FROM i")
def ex05_importance(spark, sf_dir):
    """EX-01, 02, 04, 05."""
    return X.importance(_parts(spark, sf_dir).withColumn("cell", F.lit(1)), ["cell"]).select("feature", F.round("importance", 9).alias("importance"), "rank")


@_query(f"WITH {LINEAR}, e AS (SELECT feature, avg(abs(value)) AS e FROM p GROUP BY 1) SELECT s, feature, round(avg(abs(value)) - any_value(e), 9) AS delta FROM p JOIN e USING (feature) GROUP BY ALL")
def ex07_subgroup_delta(spark, sf_dir):
    return X.subgroup_delta(_parts(spark, sf_dir), [], "s")[0].withColumn("delta", F.round("delta", 9))


@_query(f"""WITH {PREDS}, k AS (SELECT fold, row_id, p, unnest(CASE WHEN y = 1 AND p >= 0.5 THEN ['tp_max', 'tp_min'] WHEN y = 1 THEN ['fn_min'] WHEN p >= 0.5 THEN ['fp_max'] ELSE [] END) AS kind FROM preds),
r AS (SELECT *, row_number() OVER (PARTITION BY fold, kind ORDER BY CASE WHEN kind LIKE '%max' THEN -p ELSE p END, row_id) AS n FROM k) SELECT fold, kind, row_id, p FROM r WHERE n = 1""")
def ex06_archetypes(spark, sf_dir):
    return X.archetypes(predictions(spark, sf_dir), ["fold"])


@_query(f"WITH {LINEAR}, i AS (SELECT s AS model, feature, avg(abs(value)) AS v FROM p GROUP BY ALL), r AS (SELECT model, feature, rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2 AS r FROM i) SELECT x.model AS a, y.model AS b, round(corr(x.r, y.r), 9) AS rho, 1::BIGINT AS n_folds FROM r x JOIN r y USING (feature) GROUP BY ALL")
def ex08_agreement(spark, sf_dir):
    """EX-08, 09: return flags as models."""
    table = X.importance(_parts(spark, sf_dir), ["s"]).select(F.lit(1).alias("fold"), F.col("s").alias("model"), "feature", "importance")
    return X.mean_agreement(X.agreement(table, ["fold"])).withColumn("rho", F.round("rho", 9))


@_query(f"WITH {LINEAR}, w AS (SELECT feature, value, row_number() OVER (PARTITION BY o, ln, pk, sk ORDER BY abs(value) DESC, feature) AS r FROM p) SELECT least(r, 2)::INT AS place, count(DISTINCT CASE WHEN r >= 2 THEN '(other)' ELSE feature END) AS n_features, round(sum(value), 4) AS value FROM w GROUP BY 1")
def ex10_waterfall(spark, sf_dir):
    return X.waterfall(_parts(spark, sf_dir), 0.1, 1).groupBy("place").agg(F.count_distinct("feature").alias("n_features"), F.round(F.sum("value"), 4).alias("value"))


@_query()
def ex03_shapley(spark, sf_dir):
    """EX-03: all training rows of a fold, equal ones once, with their number."""
    rows = _rows(spark, sf_dir, "fold = 'F' AND split = 'train'").select("row_id", F.array(*NUMBERS).alias("features"))
    explained = stored(X.alike(rows), "alike").rows
    centers = X.background(explained, 5)
    from pyspark.ml.functions import vector_to_array

    def score(points: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        return points.withColumn("p", 1 / (1 + F.exp(-(x[0] * 0.02 - x[1] * 3 + x[2] * 2))))

    return X.importance(X.shapley(explained, score, centers, NUMBERS).withColumn("cell", F.lit(1)), ["cell"], weight="weight").drop("cell")


@_query()
def ex11_cells(spark, sf_dir):
    """EX-11: for each fold its fitted models (stored, then loaded) explain all of its test rows, archetypes among them,
    against 50 means of all its training rows. Equal rows are fitted, clustered and explained once, with their number as weight."""
    from pyspark.ml.functions import array_to_vector

    rows, path, out = _rows(spark, sf_dir), scratch(spark, "models"), []
    kinds = {"lasso": (ML.lasso(1.0, 10_000, maxIter=10), LogisticRegressionModel), "boosted": (GBTClassifier(maxIter=2, maxDepth=3, seed=5), GBTClassificationModel)}
    for fold in ("F", "O"):
        own = rows.where(F.col("fold") == fold)
        columns = _recipe(own.where("split = 'train'"))
        ready = own.select("row_id", "split", "y", F.array(*columns.values()).alias("features"))
        known = stored(ML.counted(ready.where("split = 'train'"), "features", "y"), "known").rows
        centers = X.background(known, 50)
        known = known.select(F.col("y").cast("double").alias("label"), array_to_vector("features").alias("features"), "weight")
        explained = stored(X.alike(ready.where("split = 'test'")), "alike").rows
        for name, (estimator, loader) in kinds.items():
            estimator.fit(known, {estimator.weightCol: "weight"}).write().save(f"{path}/{fold}-{name}")
            model = loader.load(f"{path}/{fold}-{name}")
            score = lambda points, m=model: ML.scored(m, points)
            out.append(X.shapley(explained, score, centers, list(columns)).withColumns({"fold": F.lit(fold), "model": F.lit(name)}))
    return X.importance(reduce(DataFrame.unionByName, out), ["fold", "model"], weight="weight")
