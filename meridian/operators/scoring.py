"""Answer and case scores, roll-ups, confusion, judge, regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count
from .metrics import ordered_sums

#: The bands, and the reasons for which a claim is suppressed.
BANDS = ("low", "intermediate", "high")
SUPPRESSED = ("no_citation", "phantom_citation", "no_passage_entails")
#: The metrics a gate compares: (name, direction, tolerance). A latency's tolerance is
#: a share of the baseline, the others' is absolute.
GATE = [
    ("triage_pass_rate", "higher", 0.02), ("risk_band_match_rate", "higher", 0.02), ("guideline_pass_rate", "higher", 0.02), ("letter_pass_rate", "higher", 0.02),
    ("full_pipeline_pass_rate", "higher", 0.02), ("recommendation_correctness_rate", "higher", 0.02), ("mean_citation_precision", "higher", 0.02), ("mean_citation_recall", "higher", 0.02),
    ("judge_pass_rate", "higher", 0.02), ("mean_hallucination_rate", "lower", 0.02), ("median_total_duration_ms", "latency", 0.20), ("p95_total_duration_ms", "latency", 0.20),
]
#: Words that show a recommendation of a family.
FAMILIES = {
    "lifestyle_only": ["lifestyle", "diet", "exercise", "physical activity", "smoking cessation", "weight"],
    "lifestyle_plus_review": ["lifestyle", "review", "follow-up", "follow up", "reassess", "recheck"],
    "statin_consider": ["statin", "consider statin", "lipid-lowering", "lipid lowering"],
    "statin_plus_bp": ["statin", "blood pressure", "antihypertens", "bp control", "ace inhibitor", "arb"],
    "statin_plus_bp_plus_referral": ["statin", "blood pressure", "refer", "referral", "cardiology", "cardiologist"],
    "specialist_referral_urgent": ["urgent", "refer", "referral", "cardiology", "cardiologist", "emergency"],
    "refusal_no_recommendation": ["i do not have the supporting guidance", "unable to recommend", "insufficient evidence", "cannot provide a recommendation", "no specific recommendation"],
}


def keyword_recall(text: Column, keywords: Column) -> Column:
    """Share of the keywords the text holds, case aside; 1 if there are none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(F.try_divide(F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k)))), F.size(keywords)), F.lit(1.0))


def answer_scores(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """answers: query_id, text, keywords, expected (document ids), should_refuse, refused.
    claims: query_id, verified, doc_id of the headline. One row per answer: keyword_recall,
    citation_precision (1 without claims), hallucinated, n_verified, n_suppressed."""
    wanted = answers.select("query_id", F.explode("expected").alias("doc_id")).distinct().withColumn("wanted", F.lit(True))
    held = claims.join(wanted, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.count_if("verified").alias("n_verified"), F.count_if(~F.col("verified")).alias("n_suppressed"), F.count_if(F.col("verified") & F.col("wanted")).alias("good"), F.coalesce(F.bool_or(F.col("verified") & F.col("doc_id").isNotNull() & F.col("wanted").isNull()), F.lit(False)).alias("strange")
    )
    out = answers.join(held, "query_id", "left").fillna(0, ["n_verified", "n_suppressed", "good"])
    recall = F.when(F.col("should_refuse"), F.col("refused").cast("double")).otherwise(keyword_recall(F.col("text"), F.col("keywords")))
    return out.select("query_id", "should_refuse", recall.alias("keyword_recall"), F.coalesce(F.try_divide("good", "n_verified"), F.lit(1.0)).alias("citation_precision"), F.coalesce("strange", F.lit(False)).alias("hallucinated"), "n_verified", "n_suppressed")


def by_tag(rows: DataFrame, tags: str, measures: dict[str, Column]) -> DataFrame:
    """The measures over all rows (tag null) and for each tag; a row counts in each of its tags.

    Expanding a row once for the total and once per tag makes one pass of both."""
    every = rows.withColumn("tag", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct(tags), F.array().cast("array<string>")))))
    return every.groupBy("tag").agg(*[m.alias(n) for n, m in measures.items()])


def citation_scores(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(case_id, precision, recall) of cited chunks against the retrieved ones; 1 where vacuous."""
    c, r = cited.select("case_id", "chunk_id").distinct(), retrieved.select("case_id", "chunk_id").distinct()
    both = c.withColumn("c", F.lit(1)).join(r.withColumn("r", F.lit(1)), ["case_id", "chunk_id"], "full_outer")
    hit = F.count_if(F.col("c").isNotNull() & F.col("r").isNotNull())
    return both.groupBy("case_id").agg(F.coalesce(F.try_divide(hit, F.count("c")), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide(hit, F.count("r")), F.lit(1.0)).alias("recall"))


def hallucination_rate(claims: DataFrame) -> DataFrame:
    return claims.groupBy("case_id").agg(F.coalesce(F.try_divide(F.count_if(F.col("reason").isin(*SUPPRESSED)), F.count(F.lit(1))), F.lit(0.0)).alias("hallucination_rate"))


def recommendation_correct(family: Column, draft: Column) -> Column:
    low, out = F.lower(F.coalesce(draft, F.lit(""))), F.lit(False)
    for name, words in FAMILIES.items():
        held = F.lit(False)
        for w in words:
            held |= F.contains(low, F.lit(w))
        out = F.when(family == name, held).otherwise(out)
    return out


def stage_verdicts(cases: DataFrame) -> DataFrame:
    """cases with the four stage verdicts and all_pass."""
    c = F.col
    made = cases.withColumns(
        {
            "triage_pass": (F.size(F.array_except("expected_flags", "flags")) == 0) & (F.length(F.trim("summary")) > 0),
            "risk_match": F.coalesce(c("band") == c("expected_band"), F.lit(False)),
            "guideline_pass": c("n_verified") >= c("min_claims"),
            "letter_pass": word_count(F.coalesce("letter", F.lit(""))) >= c("min_words"),
        }
    )
    return made.withColumn("all_pass", c("triage_pass") & c("risk_match") & c("guideline_pass") & c("letter_pass"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, <name>...): the values at rank round-half-even(share * (n - 1))."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    rank = lambda p: F.bround(F.lit(p) * (F.col("all_n") - 1))
    return ordered_sums(counts, keys, value, ["n"]).groupBy(*keys).agg(*[F.min(F.when(F.col("upto_n") > rank(p), F.col(value))).alias(n) for n, p in shares.items()])


def roll_up(cases: DataFrame, tag: str = "tag") -> DataFrame:
    """Pass rates over all cases (tag null) and per tag, in one pass by grouping sets."""
    rates = [F.avg(F.col(c).cast("int")).alias(n) for c, n in (("triage_pass", "triage_pass_rate"), ("risk_match", "risk_band_match_rate"), ("guideline_pass", "guideline_pass_rate"), ("letter_pass", "letter_pass_rate"), ("all_pass", "full_pipeline_pass_rate"))]
    return cases.groupingSets([[], [F.col(tag)]], F.col(tag)).agg(F.count(F.lit(1)).alias("n"), *rates, F.grouping(tag).cast("int").alias("overall"))


def confusion(cases: DataFrame) -> DataFrame:
    """Nine rows (expected, observed, n), zeros kept; a null observed band is left out."""
    spark = cases.sparkSession
    every = spark.createDataFrame([(a, b) for a in BANDS for b in BANDS], "expected string, observed string")
    held = cases.where("band IS NOT NULL").groupBy(F.col("expected_band").alias("expected"), F.col("band").alias("observed")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(held, ["expected", "observed"], "left").fillna(0, ["n"])


def keyword_judge(correct: Column, letter: Column) -> Column:
    """Struct (alignment, quality, passed)."""
    n = word_count(F.coalesce(letter, F.lit("")))
    a, q = F.when(correct, 5).otherwise(1), F.when(n == 0, 1).when(n < 30, 3).otherwise(5)
    return F.struct(a.alias("alignment"), q.alias("quality"), ((a >= 4) & (q >= 4)).alias("passed"))


def with_judgements(reports: DataFrame, judged: DataFrame) -> DataFrame:
    """reports (case_id, ...) with the judge's columns, those of its own case; a case that was not judged is left out."""
    return reports.join(judged, "case_id")


def judge_roll_up(judged: DataFrame, tag: str = "tag") -> DataFrame:
    return judged.groupingSets([[], [F.col(tag)]], F.col(tag)).agg(F.count(F.lit(1)).alias("n"), F.avg("alignment").alias("mean_alignment"), F.avg("quality").alias("mean_quality"), F.avg(F.col("passed").cast("int")).alias("pass_rate"), F.grouping(tag).cast("int").alias("overall"))


def gate(current: DataFrame, baseline: DataFrame, spec: DataFrame) -> DataFrame:
    """(metric, direction, current, baseline, delta, missing, failed) for each metric of the spec
    (metric, direction, tolerance). Missing sides never fail, nor do improvements."""
    out = spec.join(current.withColumnRenamed("value", "current"), "metric", "left").join(baseline.withColumnRenamed("value", "baseline"), "metric", "left")
    c, b, t = F.col("current"), F.col("baseline"), F.col("tolerance")
    missing = c.isNull() | b.isNull()
    worse = F.when(F.col("direction") == "higher", b - c > t + 1e-12).when(F.col("direction") == "lower", c - b > t + 1e-12).otherwise(F.when(b <= 0, c > 0).otherwise(c > b * (1 + t) + 1e-12))
    return out.select("metric", "direction", "current", "baseline", (c - b).alias("delta"), missing.alias("missing"), (~missing & F.coalesce(worse, F.lit(False))).alias("failed"))
