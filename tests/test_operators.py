"""Closed-form cases and invariants."""

import math
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from meridian.functions import text as T
from meridian.operators import answers as A
from meridian.operators import drift as D
from meridian.operators import events as E
from meridian.operators import explain as X
from meridian.operators import metrics as M
from meridian.operators import retrieval as R
from meridian.operators import scoring as S
from meridian.operators import splits as SP
from meridian.operators import tabular as P


def rows(spark, values):
    return spark.createDataFrame([("g", i, y, p) for i, (y, p) in enumerate(values)], "g string, row_id long, y int, p double")


def value(df):
    return df.collect()[0]["value"]


def test_psi_known_values(spark):
    cells = lambda *n: spark.createDataFrame([("f", str(i), c) for i, c in enumerate(n)], "feature string, level string, cnt long")
    psi = lambda r, c: D.psi(r, c, [], "level").collect()[0]["psi"]
    assert math.isclose(psi(cells(50, 50), cells(60, 40)), 0.04054651, abs_tol=1e-7)
    assert abs(psi(cells(5, 3), cells(5, 3))) < 1e-12
    assert psi(cells(9, 0), cells(0, 9)) > 0.25
    assert psi(cells(0, 0), cells(1, 2)) == 0
    got = spark.createDataFrame([(0.05,), (0.1,), (0.3,), (None,), (float("inf"),)], "x double").select(D.severity(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == ["stable", "moderate", "major", "major", "major"]


def test_constant_column_has_two_bins(spark):
    long = spark.createDataFrame([("f", 2.0)] * 5, "feature string, value double")
    ref = D.numeric_reference(long, []).collect()[0]
    assert ref.edges == [2.0] and ref.counts == [0, 5]


def test_ks_of_shifted_samples(spark):
    one = spark.createDataFrame([("f", float(i)) for i in range(10)], "feature string, value double")
    two = spark.createDataFrame([("f", float(i + 5)) for i in range(10)], "feature string, value double")
    assert math.isclose(D.ks_two_sample(one, two, []).collect()[0]["ks"], 0.5)


def test_rank_metrics(spark):
    assert value(M.auroc(rows(spark, [(0, 0.1), (1, 0.9)]), ["g"])) == 1
    assert value(M.auroc(rows(spark, [(0, 0.5), (1, 0.5)]), ["g"])) == 0.5
    assert value(M.auroc(rows(spark, [(1, 0.1), (0, 0.9)]), ["g"])) == 0
    assert value(M.auroc(rows(spark, [(1, 0.1), (1, 0.9)]), ["g"])) is None
    assert value(M.brier(rows(spark, [(0, 0.5), (1, 0.5)]), ["g"])) == 0.25
    draw = random.Random(2)
    data = [(draw.randrange(2), round(draw.random(), 1)) for _ in range(200)]
    won = sum((a > b) + 0.5 * (a == b) for y, a in data if y for z, b in data if not z)
    assert math.isclose(value(M.auroc(rows(spark, data), ["g"])), won / sum(y for y, _ in data) / sum(1 - y for y, _ in data))


def test_calibrated_scores_have_slope_one(spark):
    data = [(int(k < 10 * p), p) for p in (0.1, 0.2, 0.5, 0.8) for k in range(10)]
    got = M.calibration(rows(spark, data), ["g"]).collect()[0]
    assert math.isclose(got.slope, 1, abs_tol=1e-6) and abs(got.intercept) < 1e-6
    assert M.calibration(rows(spark, [(1, 0.2), (1, 0.4)]), ["g"]).collect()[0].slope is None


def test_checks_raise(spark):
    with pytest.raises(Exception, match="y must be"):
        M.checked(rows(spark, [(2, 0.5)])).collect()


def test_bootstrap_narrows_and_holds_the_point(spark):
    data = spark.createDataFrame([("a" if i < 20 else "b", i, float(i % 2)) for i in range(220)], "g string, row_id long, v double")
    got = {r.g: r for r in M.ci_columns(M.bootstrap_ci(data, ["g"], M.mean_metric, 200)).collect()}
    assert got["a"].contains_point and got["b"].contains_point and got["b"].width < got["a"].width


def test_treat_all_is_zero_at_the_prevalence(spark):
    points = M.decision_curve(rows(spark, [(1, 0.9), (0, 0.1), (0, 0.2), (0, 0.3)]), ["g"], [0.25])
    assert math.isclose(points.collect()[0].treat_all, 0, abs_tol=1e-12)


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 2).alias("y"))
    got = SP.within_split(df.repartition(7), [], "y", "id")
    assert got.count() == 100 and SP.overlaps(got, "id", "split").count() == 0
    assert {(r.id, r.split) for r in got.collect()} == {(r.id, r.split) for r in SP.within_split(df, [], "y", "id").collect()}
    assert sorted(r["count"] for r in got.groupBy("y", "split").count().collect()) == [5, 5, 5, 5, 40, 40]


def test_sections_follow_a_heading_stack(spark):
    draw = random.Random(6)
    for seed in range(5):
        lines, want, stack = [], [], []
        for k in range(25):
            if draw.random() < 0.4:
                level = draw.randrange(1, 5)
                lines.append("#" * level + f" h{k}")
                stack = [s for s in stack if s[0] < level] + [(level, f"h{k}")]
                want.append([t for _, t in stack])
            else:
                lines.append(f"text {k}.")
        docs = spark.createDataFrame([(seed, "\n".join(lines))], "doc_id long, text string")
        got = [r.path for r in T.sections(docs).orderBy("section_no").collect()]
        assert got == ([[]] if lines[0][0] != "#" else []) + want


def test_sentence_packing_equals_a_loop(spark):
    def loop(sizes, budget):
        out, first, held = [], 0, 0
        for i, n in enumerate(sizes):
            if i > first and held + n > budget:
                out.append((first, i))
                if i - first > 1:
                    first, held = i - 1, sizes[i - 1]
                    if held + n > budget:
                        out.append((first, i))
                        first, held = i, 0
                else:
                    first, held = i, 0
            held += n
        return out + ([(first, len(sizes))] if sizes else [])

    draw = random.Random(1)
    data = [(k, [draw.randrange(1, 12) for _ in range(draw.randrange(0, 15))]) for k in range(60)]
    got = spark.createDataFrame(data, "k long, n array<int>").select("k", T.packed(F.col("n"), 15).alias("r")).collect()
    assert {r.k: [tuple(x) for x in r.r] for r in got} == {k: loop(n, 15) for k, n in data}


def test_chunks_equal_their_spans(spark):
    docs = spark.createDataFrame([(1, "  One two. Three four five! (Six) seven.  " * 30), (2, ""), (3, None)], "doc_id long, text string")
    text = docs.first().text
    for chunks in (T.window_chunks(docs, 16, 12), T.sentence_chunks(docs, 10), T.hybrid_chunks(docs, 16, 12)):
        found = chunks.collect()
        assert found and all(text[r.char_start : r.char_end] == r.text for r in found)


def test_fusion_ties_and_doubling(spark):
    leg = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, id string, rank int")
    one, two = ({r.id: r.rrf_score for r in R.fuse(legs).collect()} for legs in ({"x": leg}, {"x": leg, "y": leg}))
    assert all(math.isclose(two[k], 2 * one[k]) for k in one)
    even = R.top(spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0)], "query_id int, id string, score double"), 2)
    assert [r.id for r in even.orderBy("rank").collect()] == ["a", "b"]


def test_claims_and_verdicts(spark):
    passages = spark.createDataFrame([("q", 1, "c1", "Statins lower cholesterol in adults."), ("q", 2, "c2", "Exercise helps.")], "query_id string, rank int, chunk_id string, text string")
    answers = spark.createDataFrame([("q", "Statins lower cholesterol [c1]. Bananas cure everything [2]. Nobody knows why. Ghosts exist [zz].")], "query_id string, answer string")
    said = A.claims(answers)
    got = {r.pos: (r.verified, r.reason) for r in A.verdicts(said, A.resolved(said, passages), passages).collect()}
    assert got == {0: (True, None), 1: (False, "no_passage_entails"), 2: (False, "no_citation"), 3: (False, "phantom_citation")}


def test_gate(spark):
    table = lambda v: spark.createDataFrame([("m", v)], "metric string, value double")
    failed = lambda kind, c, b, t=0.02: S.gate(table(c), table(b), spark.createDataFrame([("m", kind, t)], "metric string, direction string, tolerance double")).collect()[0].failed
    assert failed("higher", 0.90, 0.95) and not failed("higher", 0.94, 0.95) and not failed("higher", 0.99, 0.95)
    assert failed("lower", 0.2, 0.1) and failed("latency", 1.0, 0.0, 0.2) and not failed("latency", 1.1, 1.0, 0.2)


def test_case_status_and_edits(spark):
    log = [(1, "triage", "approve", 1, None), (1, "risk", "edit", 2, {"a": "x"}), (1, "letter", "edit", 3, {"b": "1"}), (1, "letter", "edit", 4, {"b": "2"}), (2, "triage", "reject", 1, None)]
    log = spark.createDataFrame(log, "case_id long, stage string, status string, ts long, edits map<string,string>")
    assert {(r.case_id, r.status, r.next_stage) for r in E.case_status(log).collect()} == {(1, "awaiting_decision", "guideline"), (2, "rejected", None)}
    base = spark.createDataFrame([(1, {"b": "0", "c": "9"}), (3, {"b": "0"})], "case_id long, fields map<string,string>")
    assert {r.case_id: r.fields for r in E.apply_edits(base, log).collect()} == {1: {"c": "9", "b": "2"}, 3: {"b": "0"}}


def test_agreement_of_rankings(spark):
    table = spark.createDataFrame([("x", f, float(i)) for i, f in enumerate("abc")] + [("y", f, float(i)) for i, f in enumerate("abc")] + [("z", f, float(-i)) for i, f in enumerate("abc")], "model string, feature string, importance double")
    got = {(r.a, r.b): round(r.rho, 9) for r in X.agreement(table, []).collect()}
    assert got[("x", "y")] == 1 and got[("x", "z")] == -1 and got[("x", "x")] == 1


def test_shapley_sums_to_the_difference(spark):
    data = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 5.0])], "row_id long, features array<double>")
    from pyspark.ml.functions import vector_to_array

    score = lambda df: df.withColumn("p", vector_to_array("features")[0] * 2 + vector_to_array("features")[1])
    got = {(r.row_id, r.feature): r.value for r in X.shapley(data, score, [[0.0, 0.0]], ["a", "b"]).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 2, (2, "a"): 0, (2, "b"): 5}


def test_background_and_importance_hold_every_row(spark):
    """More rows than the former sample of 5,000: 500 that lie far off have a mean of their own, with all of their rows."""
    rows = spark.range(20_000).select(F.col("id").alias("row_id"), F.array(F.when(F.col("id") < 500, 1000.0 + F.col("id")).otherwise(F.col("id") / 20_000), F.lit(1.0)).alias("features"))
    far = max(X.background(rows, 2))
    assert far == pytest.approx([1249.5, 1.0], abs=1e-9)
    one, two = (sorted(X.background(x, 3)) for x in (rows.repartition(7), rows.coalesce(1)))
    assert sum(one, []) == pytest.approx(sum(two, []), abs=1e-9)
    twice = X.alike(rows.unionByName(rows.where("row_id < 100")))
    assert twice.count() == 20_000 and twice.agg(F.sum("weight")).first()[0] == 20_100
    parts = X.shapley(twice, lambda t: t.withColumn("p", F.element_at(vector_to_array("features"), 1)), [[0.0, 1.0]], ["a", "b"])
    got = {r.feature: r.importance for r in X.importance(parts.withColumn("cell", F.lit(1)), ["cell"], weight="weight").collect()}
    want = sum((1000 + i) * (2 if i < 100 else 1) for i in range(500)) + sum(i / 20_000 for i in range(500, 20_000))
    assert got["a"] == pytest.approx(want / 20_100) and got["b"] == 0


def test_cleaning_is_idempotent_and_guards_columns(spark):
    df = spark.createDataFrame([(0, None, "x")], "chol int, bp double, sex string")
    once = P.clean(df, "chol", ["bp"], ["sex"], ["chol", "bp"])
    assert once.collect() == P.clean(once, "chol", ["bp"], ["sex"], ["chol", "bp"]).collect()
    with pytest.raises(KeyError):
        P.clean(df, "chol", ["nope"], [], [])


def test_parts_side_by_side_are_summed_as_long_ones(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, None, 4.0), (1, "a", 0.5, None, 2.0), (2, "b", 3.0, 7.0, None), (2, None, 1.0, 1.0, 1.0)], "row_id int, s string, x_rcs1 double, x_rcs2 double, y double")
    names, keys = ["x_rcs1", "x_rcs2", "y"], ["row_id", "s"]
    parts, mapping = X.linear_parts(F.array(*names), [2.0, 3.0, -1.0], names), X.raw_names(names, ["x", "y"])
    long = X.summed_back(rows.select(*keys, F.inline(parts)), spark.createDataFrame(list(mapping.items()), "basis string, feature string"), keys)
    wide = X.summed_rows(rows, parts, names, mapping, keys)
    tell = lambda d: sorted(map(str, d.select(*keys, "feature", "value").collect()))
    assert tell(wide) == tell(long)
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
