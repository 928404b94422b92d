"""Operators that no SQL states, against plain Python on whole tables, and ordered sums at their edges."""

import math
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from meridian.functions import text as T
from meridian.operators import answers as A
from meridian.operators import events as E
from meridian.operators import explain as X
from meridian.operators import features as FE
from meridian.operators import metrics as M
from meridian.operators import models as ML
from meridian.operators import retrieval as R
from meridian.operators import splits as SP
from meridian.operators import tabular as P
from meridian.plans.catalog import QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def plain_pieces(text):
    return regex.findall(r"\S+\s*|\s+", text, flags=regex.ASCII)


def plain_sentences(text):
    return regex.split("\0", regex.sub(r"([.!?]\s+)(?=[A-Z\"'(])", "\\1\0", text, flags=regex.ASCII))


def plain_chunks(text, budget):
    s = plain_sentences(text)
    n, out, i = [len(plain_pieces(x)) for x in s], [], 0
    while i < len(s):
        end, held = i + 1, n[i]
        while end < len(s) and held + n[end] <= budget:
            held, end = held + n[end], end + 1
        begin, body = len("".join(s[:i])), regex.sub(r"\s+$", "", "".join(s[i:end]), flags=regex.ASCII)
        out.append((begin, begin + len(body), held))
        if end == len(s):
            break
        i = max(end - 1, i + 1)
    return out


@pytest.mark.parametrize("budget", [16, 64])
def test_sentence_chunks(spark, texts, budget):
    got = {}
    for r in T.sentence_chunks(spark.read.parquet(f"{SF}/documents.parquet"), budget).orderBy("doc_id", "chunk_no").collect():
        assert texts[r.doc_id][r.char_start : r.char_end] == r.text
        got.setdefault(r.doc_id, []).append((r.char_start, r.char_end, r.n_tokens))
    assert got == {i: plain_chunks(t, budget) for i, t in texts.items() if t.strip(" ")}


def plain_level(line):
    body = line.strip(" ")
    if regex.search(r"^#{1,6}\s+\S", body):
        return len(regex.match("#+", body)[0])
    letters, upper = len(regex.findall(r"\p{L}", body)), len(regex.findall(r"\p{Lu}", body))
    short = 0 < len(body) <= 80 and not regex.search(r"[.!?:;,]$", body)
    return 1 if short and (regex.search(r"^(?:\d+(?:\.\d+){0,4}\.?|[A-Z]\.(?:\d+\.?)?)\s+\S", body) or (letters and upper >= 0.7 * letters)) else None


def plain_sections(text):
    out, stack, start, at = [], {}, 0, 0
    lines = []
    path = []
    for line in text.split("\n"):
        level = plain_level(line)
        if level:
            if lines:
                out.append((path, start, "\n".join(lines)))
            stack = {k: v for k, v in stack.items() if k < level} | {level: regex.sub(r"^#{1,6}\s+|\s+$", "", line.strip(" "))}
            lines, start, path = [], at, [stack[k] for k in sorted(stack)]
        lines.append(line)
        at += len(line) + 1
    return [*out, (path, start, "\n".join(lines))]


def test_sections_and_hybrid_chunks(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = {9_001: "# A\nx\n## B\ny\n# C\nz\n### D\n1.2 Numbered\nend", 9_002: "SHOUT\n\n  \nlow\n", 9_003: ""}
    docs = docs.unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    want = {i: plain_sections(t) for i, t in (texts | more).items()}
    got = {}
    for r in T.sections(docs).orderBy("doc_id", "char_start", "section_no").collect():
        got.setdefault(r.doc_id, []).append((r.path, r.char_start, r.text))
    assert got == want
    chunks = {}
    for r in T.hybrid_chunks(docs, 40, 30).collect():
        assert (texts | more)[r.doc_id][r.char_start : r.char_end] == r.text and r.n_tokens <= 40
        chunks.setdefault(r.doc_id, set()).add((r.char_start, r.char_end))
    for i, parts in want.items():
        held = set()
        for _, start, body in parts:
            p = plain_pieces(body)
            if not body.strip(" "):
                continue
            if len(p) <= 40:
                held.add((start, start + len(body)))
                continue
            for c in range(0, 1 + math.ceil((len(p) - 40) / 30)):
                begin = start + len("".join(p[: c * 30]))
                held.add((begin, begin + len("".join(p[c * 30 : c * 30 + 40]))))
        assert chunks.get(i, set()) == held


def test_texts_with_control_characters_are_not_cut(spark):
    got = spark.createDataFrame([("a\x01b. C d",)], "text string").select(T.sentences(F.col("text")).alias("s")).first().s
    assert got == ["a\x01b. ", "C d"]
    said = A.claims(spark.createDataFrame([(1, "One\x01 two [10, 100]. Three [20].")], "query_id long, answer string")).orderBy("pos").collect()
    assert [(r.claim, r.tokens) for r in said] == [("One\x01 two.", ["10", "100"]), ("Three.", ["20"])]


def test_ordered_sums_equal_a_loop(spark):
    draw = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.0, 1e-320, -1e-320, 1e300, -1e300, math.inf, -math.inf] + [draw.uniform(-9, 9) * 10 ** draw.randrange(-6, 6) for _ in range(300)]
    rows = [(k, v, draw.randrange(5)) for k in ("a", None) for v in dict.fromkeys(values)]
    got = M.ordered_sums(spark.createDataFrame(rows, "k string, v double, n int"), ["k"], "v", ["n"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.upto_n == sum(n for k, v, n in rows if k == r.k and v <= r.v) and r.all_n == sum(n for k, _, n in rows if k == r.k)


def test_places_equal_a_sort(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(500)], "id long, k int")
    got = SP.placed(rows, ["k"], "id", 5, "place", "total").withColumn("h", M.portable_hash(F.lit(5), F.col("id"))).collect()
    for k in (0, 1, 2, None):
        own = sorted((r.h, r.id, r.place) for r in got if r.k == k)
        assert [p for _, _, p in own] == list(range(1, len(own) + 1)) and all(r.total == len(own) for r in got if r.k == k)


def test_samples_keep_all_forced_rows(spark):
    rows = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "id long, y int")
    forced = rows.where("id < 8").select("id")
    assert {r.id for r in SP.capped_sample(rows, "y", "id", 5, forced).collect()} == set(range(8))
    got = SP.capped_sample(rows, "y", "id", 40, forced).collect()
    assert len(got) == 40 and {r.id for r in got} >= set(range(8)) and sum(r.y for r in got) == 2 + 8
    assert SP.capped_sample(rows, "y", "id", 100, forced).count() == 100


def test_intervals_equal_resampled_rows(spark):
    draw = np.random.default_rng(3)
    y = draw.integers(0, 2, 400)
    p = np.clip(np.round(0.35 + 0.3 * y + draw.normal(0, 0.25, 400), 2), 0, 1)
    frame = spark.createDataFrame([("g", int(a), float(b)) for a, b in zip(y, p)], "g string, y int, p double")
    got = {r.metric: r for r in M.headline_intervals(frame, ["g"], 1_000).collect()}

    def area(a, b):
        return float(np.mean((b[a == 1][:, None] > b[a == 0]) + 0.5 * (b[a == 1][:, None] == b[a == 0])))

    drawn = [draw.integers(0, 400, 400) for _ in range(600)]
    for name, f in (("auroc", area), ("brier", lambda a, b: float(np.mean((a - b) ** 2)))):
        low, high = np.percentile([f(y[d], p[d]) for d in drawn], [2.5, 97.5])
        assert math.isclose(got[name].point, f(y, p), abs_tol=1e-9) and got[name].n_valid == 1_000
        assert abs(got[name].lower - low) < 0.012 and abs(got[name].upper - high) < 0.012
    assert got["sens_at_85"].lower <= got["sens_at_85"].point <= got["sens_at_85"].upper


def test_searches_are_filled_with_chunks_of_score_zero(spark):
    chunks = spark.createDataFrame([(5, "kale soup"), (3, "bread"), (4, "cheese"), (9, "wine")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "kale"), (2, "?")], "query_id long, text string")
    got = R.bm25_search(R.bm25_index(chunks), asked, 3).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.score > 0) for r in got] == [(1, 5, True), (1, 3, False), (1, 4, False)]


def test_approximate_search_recalls_nine_tenths(spark):
    assert QUERIES["rt07_lsh_recall"](spark, SF).first().recall >= 0.9


def test_small_parts(spark):
    rows = spark.createDataFrame([(20, "M", "ATA", 80.0, 0.0, 150.0, "Up", -1.0)], "Age int, Sex string, ChestPainType string, RestingBP double, Cholesterol double, MaxHR double, ST_Slope string, Oldpeak double")
    flags = P.flags(P.triage_rules())
    assert rows.select(P.triage_summary(flags)).first()[0] == "Triage: 20y M, chest pain=ATA, resting BP=80.0, chol=0.0, max HR=150.0, ST slope=Up. Flags: cholesterol_missing_sentinel, oldpeak_negative, resting_bp_extreme, age_outside_training_range."
    made = spark.range(1).select(P.model_contributions(F.array(F.lit(-3.0), F.lit(0.0), F.lit(9.0)), [0.2, 0.5, 0.3], ["a", "b", "c"], signs=True).alias("m")).first().m
    assert [tuple(x) for x in made] == [("c", 0.3), ("a", -0.2), ("b", 0.0)]
    parts = spark.range(1).select(X.linear_parts(F.array(F.lit(2.0)), [3.0], ["a"], intercept=-1.0).alias("m")).first().m
    assert [tuple(x) for x in parts] == [("a", 6.0), ("intercept", -1.0)]
    said = spark.createDataFrame([(1, "triage", "approve"), (2, "triage", "approve")], "case_id long, stage string, status string")
    bad = spark.createDataFrame([(2,), (3,)], "case_id long")
    assert {(r.case_id, r.status, r.next_stage) for r in E.case_status(said, invalid=bad).collect()} == {(1, "awaiting_decision", "risk"), (2, "failed", None), (3, "failed", None)}


def test_recipes(spark):
    draw = random.Random(4)
    rows = [(i, None if i % 9 == 0 else float(i % 20), None if i % 11 == 0 else i % 2, draw.choice("uv"), float(i % 2), i % 5 != 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, b int, c string, other double, train boolean").cache()
    for recipe in FE.RECIPES:
        made, columns = FE.prepared(df, recipe, F.col("train"), ["x"], ["b"], ["c"], ["other"], rounds=1, trees=3)
        got = made.select("id", *[c.alias(n) for n, c in columns.items()]).orderBy("id").collect()
        assert len(got) == 200 and [r["c__u"] for r in got] == [float(c == "u") for _, _, _, c, _, _ in rows] and [r.other for r in got] == [r[4] for r in rows]
        if recipe == "plain":
            assert [r.x for r in got] == [r[1] for r in rows]
        else:
            assert all(r.x is not None and r.b is not None for r in got)
        if recipe == "forest":
            assert all(r.x == w[1] for r, w in zip(got, rows) if w[1] is not None) and {r.b for r in got} == {0.0, 1.0}
        if recipe in ("splines", "scaled_forest"):
            own = [r.x for r, w in zip(got, rows) if w[5]]
            assert abs(np.mean(own)) < 1e-9 and abs(np.std(own) - 1) < 1e-9
    df.unpersist()


def test_models_tell_the_classes_apart(spark):
    from pyspark.ml.functions import array_to_vector

    draw = np.random.default_rng(6)
    rows = [(i, i % 3, int(i % 2), float(i % 2 + draw.normal(0, 0.6)), float(draw.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, fold int, y int, a double, b double")
    ready = df.select("fold", F.col("y").cast("double").alias("label"), array_to_vector(F.array("a", "b")).alias("features")).cache()
    tuned = ML.tune_lasso(ready, "fold", 3, (0.1, 10.0), maxIter=20)
    assert max(tuned.avgMetrics) > 0.8 and tuned.bestModel.coefficients[0] > abs(tuned.bestModel.coefficients[1])
    assert max(ML.tune_boosting(ready, "fold", 3, 1).avgMetrics) > 0.75
    ready.unpersist()
    assert len({str(sorted((k.name, v) for k, v in d.items())) for d in ML.boosting_draws(ML.GBTClassifier(), 5, 1)}) == 5


def test_forest_imputation_beats_the_mean(spark):
    rows = [(i, float(i % 10), None if i % 6 == 0 else 2.0 * (i % 10) + 1) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, x double, z double").cache()
    got = FE.forest_impute(df, ["x", "z"], F.lit(True), rounds=2, trees=5).where("id % 6 = 0").collect()
    assert sum(abs(r.z - (2 * (r.id % 10) + 1)) for r in got) / len(got) < 1.5  # the mean is off by 5
    df.unpersist()


def test_first_places_need_no_order_of_all_rows(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(700)], "id long, k int").cache()
    limits = {"none": F.lit(0), "some": F.bround(F.col("_total") * 0.1), "most": F.col("_total") - 1, "all": F.col("_total") + 5}
    made = SP.among_first(rows, ["k"], "id", 5, limits)
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()  # the rows themselves are not put in order
    want = {r.id: (r.place, r.total) for r in SP.placed(rows, ["k"], "id", 5, "place", "total").collect()}
    got = made.collect()
    assert len(got) == 700
    for r in got:
        place, total = want[r.id]
        assert (r["none"], r["some"], r["most"], r["all"]) == (False, place <= round(total * 0.1), place < total, True)
    rows.unpersist()
