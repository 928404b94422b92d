"""Exact quantiles by selection, drift from counts, recipes as stages and stored cells."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from meridian.operators import drift as D
from meridian.operators import features as FE
from meridian.operators import metrics as M
from meridian.operators import models as ML
from meridian.operators import quantiles as Q
from meridian.operators import recipes as R

POINTS = [0.0, 0.05, 0.275, 0.5, 0.9, 1.0]


def _same(a, b):
    return all(x == y or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("finish", [1, 30, 50_000])
def test_quantiles_equal_the_built_in(spark, finish):
    draw = random.Random(1)
    values = [None, 0.0, -0.0, float("inf"), float("-inf"), 5e-324, 1e308, -1e308, 1.0, 1.0 + 2**-52] + [draw.choice([draw.gauss(0, 1), draw.lognormvariate(0, 9), 7.0 + 1e-12 * draw.random(), float(draw.randrange(4))]) for _ in range(3000)]
    rows = [(draw.choice(["a", "b", None]), v) for v in values] + [("one", 3.5), ("none", None)] + [("same", 2.0)] * 400
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.q, r.n) for r in Q.exact_quantiles(df, ["k"], "v", POINTS, finish_rows=finish).collect()}
    want = {r.k: (r.q, r.n) for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, POINTS))).alias("q"), F.count("v").alias("n")).where("n > 0").collect()}
    assert got.keys() == want.keys() == {"a", "b", None, "one", "same"}
    assert all(_same(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)
    whole = Q.exact_quantiles(df, [], "v", POINTS, finish_rows=finish).first()
    assert _same(whole.q, df.agg(F.percentile("v", F.array(*map(F.lit, POINTS)))).first()[0])


def test_weighted_quantiles_and_empty_tables(spark):
    draw = random.Random(2)
    rows = [(round(draw.gauss(0, 1), 2), draw.randrange(0, 5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "v double, w int")
    got = Q.exact_quantiles(df, [], "v", POINTS, "w", finish_rows=10).first()
    flat = np.repeat([v for v, _ in rows], [w for _, w in rows])
    assert got.n == len(flat) and np.allclose(got.q, np.quantile(flat, POINTS), atol=1e-12)
    assert Q.exact_quantiles(df.limit(0), ["w"], "v", POINTS).count() == 0
    huge = spark.createDataFrame([(1.0, 10**15), (2.0, 10**15), (3.0, 1)], "v double, w long")
    assert Q.exact_quantiles(huge, [], "v", [0.25, 0.75, 1.0], "w").first().q == [1.0, 2.0, 3.0]


def test_no_task_holds_a_groups_values(spark):
    """All rows but few are gone after the first cut, and the last order is over a small range."""
    df = spark.range(200_000).select((F.xxhash64("id") / 2.0**40).alias("v"))
    seen = []
    kept, Q.stored = Q.stored, lambda d, name, before=None: seen.append(made := kept(d, name, before)) or made
    try:
        found = Q.exact_quantiles(df, [], "v", [0.9], finish_rows=500).first()
    finally:
        Q.stored = kept
    assert found.q[0] == df.agg(F.percentile("v", F.lit(0.9))).first()[0]
    assert len(seen) in (3, 4) and seen[-1].rows.count() <= 2


def test_report_reads_each_side_once(spark, monkeypatch):
    rows = [(float(i % 97), "xyz"[i % 3], "a" if i % 4 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "x double, c string, d string")
    reads = []
    kept = D._cells
    monkeypatch.setattr(D, "_cells", lambda *a: reads.append(1) or kept(*a))
    made = D.drift_report(df.where("x < 80"), df.where("x > 10"), ["x", "absent"], ["c", "d"])
    got = {r.feature: r for r in made.collect()}
    assert len(reads) == 2 and got.keys() == {"x", "c", "d"}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan  # counts only, the tables of this test are gone from the plan
    assert got["d"].n_missing == sum(r[2] is None and r[0] > 10 for r in rows) and got["x"].n_cur == sum(r[0] > 10 for r in rows)


def _rows(spark, n=600):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(n):
        fold = i % 3
        x = float(draw.normal() + 10 * fold)  # so that knots and means tell the folds apart
        rows.append((i, fold, None if i % 13 == 0 else x, None if i % 11 == 0 else float(i % 2), "uvw"[i % 3 if i % 7 else 0], int(draw.random() < 1 / (1 + np.exp(-(x - 10 * fold) - 2 * (i % 2))))))
    return spark.createDataFrame(rows, "row_id long, fold int, x double, b double, c string, y int")


def test_recipe_is_fitted_anew_in_each_fold_and_sees_no_held_row(spark):
    rows = _rows(spark).withColumn("label", F.col("y").cast("double"))
    seen = []

    class Watched(R.RecipeEstimator):
        def _fit(self, dataset):
            model = super()._fit(dataset)
            seen.append((sorted(r.fold for r in dataset.select("fold").distinct().collect()), model.getOrDefault(model.state)))
            return model

    base = LogisticRegression(maxIter=5)
    cv = CrossValidator(
        estimator=R.Pipeline(stages=[Watched(continuous=["x"], binary=["b"], categories=["c"]), base]), estimatorParamMaps=ParamGridBuilder().addGrid(base.regParam, [0.01]).build(), evaluator=BinaryClassificationEvaluator(), numFolds=3, foldCol="fold"
    )
    cv.fit(rows)
    assert [s[0] for s in seen] == [[1, 2], [0, 2], [0, 1], [0, 1, 2]]  # a fold's own rows are in none of its fits
    means, knots = [s[1]["means"]["x"] for s in seen], [s[1]["knots"]["x"] for s in seen]
    assert len({round(m, 3) for m in means}) == 4 and len({tuple(k) for k in knots}) == 4
    held_out = rows.where("fold <> 0").agg(F.avg("x")).first()[0]
    assert math.isclose(means[0], held_out, rel_tol=1e-12)


@pytest.mark.parametrize("recipe", FE.RECIPES)
def test_fitted_recipes_save_and_load(spark, tmp_path, recipe):
    rows = _rows(spark, 240).withColumn("label", F.col("y").cast("double"))
    pipeline = R.recipe_pipeline(recipe, LogisticRegression(maxIter=3) if recipe != "plain" else ML.GBTClassifier(maxIter=1, maxDepth=2), ["x"], binary=["b"], categories=["c"], passed=["fold"], rounds=2, trees=3)
    pipeline.write().overwrite().save(f"{tmp_path}/p")
    fitted = R.Pipeline.load(f"{tmp_path}/p").fit(rows)
    fitted.write().overwrite().save(f"{tmp_path}/m")
    loaded = PipelineModel.load(f"{tmp_path}/m")
    vectors = lambda m: [(r.row_id, str(r.features), str(r.probability)) for r in m.transform(rows).orderBy("row_id").collect()]
    assert vectors(fitted) == vectors(loaded)
    assert len(fitted.transform(rows).first().features) == len(loaded.stages[-2].columns())


def test_imputation_stops_when_little_changes(spark):
    rows = [(i, float(i % 10), None if i % 6 == 0 else 2.0 * (i % 10) + 1) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, x double, z double")
    eager = R.ForestImputer(columns=["x", "z"], rounds=10, trees=5).fit(df)
    assert eager.getOrDefault(eager.done) < 10  # z alone has nulls, so its second fill is its first
    slow = R.ForestImputer(columns=["x", "z"], rounds=3, trees=5, tolerance=-1.0).fit(df)
    assert slow.getOrDefault(slow.done) == 3 and len(slow.forests) == 6
    depth = lambda m: m.transform(df)._jdf.queryExecution().analyzed().toString().count("\n")
    longer = R.ForestImputer(columns=["x", "z"], rounds=5, trees=5, tolerance=-1.0).fit(df)
    assert depth(longer) == depth(slow)  # a plan of one round, whatever their number
    out = {r.id: r.z for r in eager.transform(df).collect()}
    assert all(out[i] == z for i, _, z in rows if z is not None) and None not in out.values()


def test_cells_are_fitted_once_and_go_on_after_a_break(spark, tmp_path):
    rows = _rows(spark).withColumn("split", F.expr("CASE row_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'calib' ELSE 'train' END")).withColumn("fold", F.concat(F.lit("f"), F.col("fold") % 2))
    fits = []

    class Watched(LogisticRegression):
        def _fit(self, dataset):
            fits.append(1)
            return super()._fit(dataset)

    stages = R.recipe_stages("splines", ["x"], ["b"], ["c"])
    run = lambda models: ML.run_cells(rows, ["f0", "f1"], stages, models, "y", f"{tmp_path}/cells", calibration={"one": "sigmoid"})
    one = run({"one": Watched(maxIter=5)})
    first = sorted(map(tuple, one.collect()))
    assert len(fits) == 2 and len(first) == rows.where("split = 'test'").count() and one.columns == ["fold", "model", "row_id", "y", "p"]
    both = run({"one": Watched(maxIter=5), "two": Watched(maxIter=2)})
    assert len(fits) == 4 and sorted(tuple(r) for r in both.where("model = 'one'").collect()) == first  # only the new cells
    loaded = PipelineModel.load(f"{tmp_path}/cells/models/f1-two")
    assert loaded.transform(rows.where("fold = 'f1'")).count() > 0


def test_tuning_in_time(spark):
    rows = _rows(spark, 150).select("fold", F.col("y").cast("double").alias("label"), "x", "b", "c")
    stages = R.recipe_stages("splines", ["x"], ["b"], ["c"])
    maps = ML.boosting_draws(base := ML.GBTClassifier(maxIter=1, maxDepth=2, seed=1), 3, 1)
    maps = [{base.maxDepth: 2}, {base.maxDepth: 1}, maps[0]]
    best = ML.tuned(base, maps, rows, "fold", 3, stages, parallelism=1, seconds=0.0)
    assert len(best.avgMetrics) == 1  # the first are tried whatever the time
    grid = ML.tune_lasso(rows, "fold", 3, (0.1, 10.0), stages=stages, maxIter=5)
    assert len(grid.avgMetrics) == 2 and max(grid.avgMetrics) > 0.6


def test_interval_sums_equal_plain_resamples(spark, monkeypatch):
    draw, n = np.random.default_rng(5), 60
    rows = [(draw.choice(["a", "b"]) if k % 9 else None, int(draw.random() < 0.4), float(draw.random() if k % 3 else round(draw.random(), 1))) for k in range(400)] + [("one", 1, 0.3), ("one", 1, 0.7)]
    df = spark.createDataFrame([(str(g) if g is not None else None, y, p) for g, y, p in rows], "g string, y int, p double")
    monkeypatch.setattr(M, "BLOCK_SCORES", 16)
    monkeypatch.setattr(M, "RESAMPLES_HELD", 25)
    got = {(r.g, r.b): r for r in M.resampled_sums(df, ["g"], n, 7, (0.85, 0.9)).collect()}
    counts = M.score_counts(df, ["g"]).withColumn("h", F.xxhash64("g", "p")).collect()
    assert len(got) == n * 4
    for group in ("a", "b", None, "one"):
        own = sorted((r for r in counts if r.g == group), key=lambda r: r.p)
        p, made = np.array([r.p for r in own]), []
        for r in own:
            rng = np.random.default_rng((7, r.h & 0xFFFFFFFFFFFFFFFF))
            made.append((rng.poisson(r.pos, n), rng.poisson(r.neg, n)))
        pos, neg = (np.array([m[k] for m in made]) for k in (0, 1))
        for b in (0, 24, 25, n - 1):
            x, y, r = pos[:, b], neg[:, b], got[group, b]
            tp, fp = x[::-1].cumsum()[::-1], y[::-1].cumsum()[::-1]
            assert (r.n_pos, r.n_neg) == (x.sum(), y.sum())
            assert math.isclose(r.area, sum(a * (y[:i].sum() + y[i] / 2) for i, a in enumerate(x)), abs_tol=1e-9)
            assert math.isclose(r.precision, sum(a / max(1, x.sum()) * t / max(1, t + f) for a, t, f in zip(x, tp, fp, strict=True)), abs_tol=1e-9)
            assert math.isclose(r.error, float((x * (1 - p) ** 2 + y * p**2).sum()), abs_tol=1e-9)
            assert math.isclose(r.sens_1, max([t / max(1, x.sum()) for t, f in zip(tp, fp, strict=True) if 1 - f / max(1, y.sum()) >= 0.9], default=0.0), abs_tol=1e-12)


def test_intervals_of_continuous_scores_multiply_no_rows(spark):
    df = spark.range(6000).select(F.lit("g").alias("g"), (F.rand(3) < F.rand(4)).cast("int").alias("y"), F.rand(4).alias("p"))
    made = M.resampled_sums(df, ["g"], 200, 1, (0.9,))
    assert made.count() == 200
    blocks = math.ceil(6000 / M.BLOCK_SCORES)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and blocks * 200 < 6000  # what is exploded is blocks by resamples


def test_the_statistic_of_cells_equals_that_of_ordered_values(spark):
    draw = random.Random(9)
    was = spark.createDataFrame([(f, float(round(draw.gauss(0, 1), 1)) if draw.random() < 0.9 else None) for f in "abc" for _ in range(300)] + [("flat", 1.0)] * 20 + [("none", None)], "feature string, value double")
    now = spark.createDataFrame([(f, float(round(draw.gauss(0.3, 1.2), 1)) if draw.random() < 0.9 else None) for f in "abc" for _ in range(200)] + [("flat", 1.0), ("flat", 0.5), ("none", 2.0)], "feature string, value double")
    stored = D.numeric_reference(was, [])
    want = {r.feature: (r.ks, r.ks_p) for r in D.ks_weighted(D.midpoints(stored, []), now.withColumn("weight", F.lit(1)), []).collect() if r.feature != "none"}
    long = now.select(F.lit("numeric").alias("kind"), "feature", "value", F.lit(None).cast("string").alias("level"))
    for most in (80, 3):  # compared one by one, and looked through
        D.MOST_COMPARED, kept = most, D.MOST_COMPARED
        try:
            cells = D._cell_counts(long, stored, [])
        finally:
            D.MOST_COMPARED = kept
        assert {r.feature: (r.ks, r.ks_p) for r in D._ks_of_cells(stored, cells, []).collect()} == want
        bins = {(r.feature, r.bin): r.cnt for r in D.bin_counts(now, stored, []).collect() if r.cnt}
        held = {(r.feature, r.bin): r.w for r in cells.where("bin IS NOT NULL").groupBy("feature", "bin").agg(F.sum("weight").alias("w")).collect()}
        assert held == bins


def test_draws_of_resamples_are_not_broadcast(spark):
    rows = spark.createDataFrame([(i % 2, (i * 37) % 500, float(i % 7)) for i in range(500)], "g int, row_id long, v double")
    placed = {(r.g, r.row_id): (r._i, r._n) for r in M.numbered(rows, ["g"], "row_id").collect()}
    for g in (0, 1):
        own = sorted(r for k, r in placed if k == g)
        assert [placed[g, r] for r in own] == [(i, len(own)) for i in range(len(own))]
    drawn = M.resampled(rows, ["g"], 100, 7)
    assert "Broadcast" not in drawn._jdf.queryExecution().executedPlan().toString()
    assert drawn.count() == 100 * 500


def test_equal_rows_are_fitted_once(spark, tmp_path):
    rows = _rows(spark).withColumn("split", F.expr("CASE row_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'calib' ELSE 'train' END")).withColumn("fold", F.lit("f"))
    rows = rows.withColumns({"x": F.round(F.col("x")), "z": F.lit(1)}).withColumn("x", F.coalesce("x", F.lit(0.0)))
    seen = []

    class Watched(LogisticRegression):
        def _fit(self, dataset):
            seen.append(dataset.groupBy("features", "label").count().agg(F.max("count")).first()[0])
            return super()._fit(dataset)

    stages = R.recipe_stages("scaled_forest", ["x"], rounds=1, trees=2)[1:]
    run = lambda model, at, kind: sorted(map(tuple, ML.run_cells(rows, ["f"], stages, {"m": model}, "y", f"{tmp_path}/{at}", calibration={"m": kind}).select("row_id", "y", "p").collect()))
    one_by_one = ML.LogisticRegression(maxIter=30)
    for kind in ("sigmoid", "isotonic"):
        found = run(Watched(maxIter=30), f"counted-{kind}", kind)
        own = rows.where("split = 'train'").withColumn("label", F.col("y").cast("double"))
        prepared = R.Pipeline(stages=list(stages)).fit(own)
        model = one_by_one.fit(prepared.transform(own))
        made = lambda s: ML.scored(model, prepared.transform(rows.where(f"split = '{s}'"))).select("row_id", "y", "p")  # noqa: B023, E731
        want = sorted(map(tuple, ML.calibrated(kind, made("calib"), made("test")).select("row_id", "y", "p").collect()))
        assert [r[:2] for r in found] == [r[:2] for r in want] and np.allclose([r[2] for r in found], [r[2] for r in want], atol=1e-6)
    assert seen == [1, 1]
    assert not ML.weighted(ML.GBTClassifier(subsamplingRate=0.5)) and not ML.weighted(ML.GBTClassifier(minInstancesPerNode=3)) and ML.weighted(ML.GBTClassifier())


def test_samples_of_several_forced_tables_are_those_of_each(spark):
    from meridian.operators import splits as S

    rows = spark.range(400).selectExpr("id AS row_id", "CAST(id % 4 = 0 AS INT) AS y").withColumn("draw", S.drawn("row_id"))
    forced = {k: spark.createDataFrame([(i,) for i in ids], "row_id long") for k, ids in {"a": [1, 4, 399], "b": [8, 9], "none": []}.items()}
    for most in (20, 1000):
        found = S.capped_samples(rows, "y", "row_id", most, forced, draw="draw")
        for k, t in forced.items():
            got = sorted(r.row_id for r in found[k].collect())
            assert got == sorted(r.row_id for r in S.capped_sample(rows, "y", "row_id", most, t).collect()), k
