"""Queries over case scoring, gates and event logs. Orders stand in for cases, line items for
claims, conversations for decision logs and events for audit entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import scoring as S
from .tables import load

QUERIES, ORACLE_SQL = {}, {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


BAND = "CASE WHEN {0} < 100000 THEN 'low' WHEN {0} < 250000 THEN 'intermediate' ELSE 'high' END"
LETTER = "repeat('word ', CAST(o_orderkey % 90 AS INT)) || CASE WHEN o_orderkey % 3 = 0 THEN 'Statin and diet' ELSE 'Refer urgently' END"
FAMILY = "CASE WHEN o_custkey % 2 = 0 THEN 'lifestyle_only' ELSE 'specialist_referral_urgent' END"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS case_id", "o_orderpriority AS tag", f"CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE {BAND.format('o_totalprice')} END AS band", f"{BAND.format('o_totalprice * (1 + (o_custkey % 3) * 0.25D)')} AS expected_band",
        "CASE WHEN o_custkey % 5 = 0 THEN array('a', 'b') ELSE array('a') END AS flags", "CASE WHEN o_custkey % 7 = 0 THEN array('b') ELSE array('a') END AS expected_flags", "o_orderstatus AS summary",
        "CAST(o_orderkey % 4 AS INT) AS n_verified", "1 AS min_claims", f"{LETTER} AS letter", "60 AS min_words", f"{FAMILY} AS family",
    )


CASES = f"""WITH c AS (SELECT o_orderkey AS case_id, o_orderpriority AS tag, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE {BAND.format('o_totalprice')} END AS band,
{BAND.format('o_totalprice * (1 + (o_custkey % 3) * 0.25::DOUBLE)')} AS expected_band, CASE WHEN o_custkey % 5 = 0 THEN ['a', 'b'] ELSE ['a'] END AS flags, CASE WHEN o_custkey % 7 = 0 THEN 'b' ELSE 'a' END AS want,
o_orderkey % 4 AS n_verified, o_orderkey % 90 + CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 2 END AS words, o_custkey, o_orderkey FROM orders),
v AS (SELECT *, list_contains(flags, want) AS triage, coalesce(band = expected_band, FALSE) AS risk, n_verified >= 1 AS guideline, words >= 60 AS letter FROM c)"""


@_query(CASES + " SELECT tag, count(*) AS n, round(avg(triage::INT), 9) AS triage_pass_rate, round(avg(risk::INT), 9) AS risk_band_match_rate, round(avg(guideline::INT), 9) AS guideline_pass_rate, round(avg(letter::INT), 9) AS letter_pass_rate, round(avg((triage AND risk AND guideline AND letter)::INT), 9) AS full_pipeline_pass_rate, grouping(tag)::INT AS overall FROM v GROUP BY GROUPING SETS ((), (tag))")
def sc11_roll_up(spark, sf_dir):
    """SC-10, 11, 13."""
    made = S.roll_up(S.stage_verdicts(cases(spark, sf_dir)))
    return made.withColumns({c: F.round(c, 9) for c in made.columns if c.endswith("_rate")})


@_query(CASES + ", e AS (SELECT unnest(['low', 'intermediate', 'high']) AS b) SELECT x.b AS expected, y.b AS observed, count(c.case_id) AS n FROM e x CROSS JOIN e y LEFT JOIN c ON c.expected_band = x.b AND c.band = y.b GROUP BY ALL")
def sc12_confusion(spark, sf_dir):
    return S.confusion(cases(spark, sf_dir))


@_query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = round_even(0.5::DOUBLE * (n - 1), 0)) AS median, max(value) FILTER (i = round_even(0.95::DOUBLE * (n - 1), 0)) AS p95 FROM r GROUP BY 1""")
def sc11_nearest_rank(spark, sf_dir):
    return S.nearest_rank(load(spark, sf_dir, "events"), ["event_type"], "value", {"median": 0.5, "p95": 0.95})


JUDGED = ", j AS (SELECT tag, CASE WHEN (o_custkey % 2 = 0 AND o_orderkey % 3 = 0) OR (o_custkey % 2 = 1 AND o_orderkey % 3 <> 0) THEN 5 ELSE 1 END AS alignment, CASE WHEN words = 0 THEN 1 WHEN words < 30 THEN 3 ELSE 5 END AS quality FROM c)"


@_query(CASES + JUDGED + " SELECT tag, count(*) AS n, round(avg(alignment), 9) AS mean_alignment, round(avg(quality), 9) AS mean_quality, round(avg((alignment >= 4 AND quality >= 4)::INT), 9) AS pass_rate, grouping(tag)::INT AS overall FROM j GROUP BY GROUPING SETS ((), (tag))")
def sc15_judge_roll_up(spark, sf_dir):
    """SC-09, 14, 15, JN-09."""
    c = cases(spark, sf_dir).withColumn("correct", S.recommendation_correct(F.col("family"), F.col("letter")))
    judged = c.select("case_id", S.keyword_judge(F.col("correct"), F.col("letter")).alias("j")).select("case_id", "j.*")
    made = S.judge_roll_up(S.with_judgements(c.select("case_id", "tag"), judged))
    return made.withColumns({n: F.round(n, 9) for n in ("mean_alignment", "mean_quality", "pass_rate")})


CITED = "c AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem WHERE l_linenumber <= 2), r AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem WHERE l_linenumber >= 2)"


@_query(f"WITH {CITED}, b AS (SELECT coalesce(c.k, r.k) AS case_id, c.k IS NOT NULL AS c, r.k IS NOT NULL AS r FROM c FULL JOIN r ON c.k = r.k AND c.p = r.p) SELECT case_id, round(coalesce(count(*) FILTER (c AND r) / nullif(count(*) FILTER (c), 0), 1), 9) AS precision, round(coalesce(count(*) FILTER (c AND r) / nullif(count(*) FILTER (r), 0), 1), 9) AS recall FROM b GROUP BY 1")
def sc07_citations(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("chunk_id"), "l_linenumber")
    made = S.citation_scores(li.where("l_linenumber <= 2"), li.where("l_linenumber >= 2"))
    return made.withColumns({n: F.round(n, 9) for n in ("precision", "recall")})


@_query("SELECT l_orderkey AS case_id, round(count(*) FILTER (l_returnflag IN ('A', 'R')) / count(*), 9) AS hallucination_rate FROM lineitem GROUP BY 1")
def sc08_hallucination(spark, sf_dir):
    reason = F.when(F.col("l_returnflag") == "A", "no_citation").when(F.col("l_returnflag") == "R", "phantom_citation")
    made = S.hallucination_rate(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), reason.alias("reason")))
    return made.withColumn("hallucination_rate", F.round("hallucination_rate", 9))


ANSWERS = """WITH a AS (SELECT o_orderkey AS id, o_comment AS t, o_custkey FROM (SELECT *, o_orderpriority || ' ' || o_orderstatus AS o_comment FROM orders)),
k AS (SELECT l_orderkey AS id, l_returnflag <> 'R' AS verified, l_suppkey AS doc FROM lineitem),
h AS (SELECT a.id, count(*) FILTER (verified) AS nv, count(*) FILTER (NOT verified) AS ns, count(*) FILTER (verified AND doc % 2 = 0 AND doc IN (2, 4, 6)) AS good, bool_or(verified AND doc NOT IN (2, 4, 6)) AS strange FROM a JOIN k ON k.id = a.id GROUP BY 1),
s AS (SELECT a.id, o_custkey % 4 = 0 AS refuse, CASE WHEN o_custkey % 4 = 0 THEN (o_custkey % 8 = 0)::INT::DOUBLE ELSE (contains(lower(t), 'urgent')::INT + contains(lower(t), 'o')::INT) / 2 END AS recall, coalesce(good / nullif(nv, 0), 1) AS precision, coalesce(strange, FALSE) AS h, coalesce(nv, 0) AS nv, coalesce(ns, 0) AS ns FROM a LEFT JOIN h ON h.id = a.id)"""


def _answer_scores(spark, sf_dir) -> DataFrame:
    orders, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    answers = orders.select(F.col("o_orderkey").alias("query_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"), F.array(F.lit("urgent"), F.lit("o")).alias("keywords"), F.array(*[F.lit(i).cast("long") for i in (2, 4, 6)]).alias("expected"), (F.col("o_custkey") % 4 == 0).alias("should_refuse"), (F.col("o_custkey") % 8 == 0).alias("refused"))
    claims = li.select(F.col("l_orderkey").alias("query_id"), (F.col("l_returnflag") != "R").alias("verified"), F.col("l_suppkey").alias("doc_id"))
    return S.answer_scores(answers, claims)


@_query(ANSWERS + " SELECT id AS query_id, refuse AS should_refuse, round(recall, 9) AS keyword_recall, round(precision, 9) AS citation_precision, h AS hallucinated, nv AS n_verified, ns AS n_suppressed FROM s")
def sc05_answer_scores(spark, sf_dir):
    """SC-05, JN-11."""
    return _answer_scores(spark, sf_dir).withColumns({n: F.round(n, 9) for n in ("keyword_recall", "citation_precision")})


@_query(ANSWERS + ", t AS (SELECT s.*, unnest([NULL, 'all', CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END]) AS tag FROM s) SELECT tag, count(*) AS n, round(avg(recall) FILTER (NOT refuse), 6) AS positive_recall, round(avg(recall) FILTER (refuse), 6) AS refusal_rate, round(avg(h::INT), 6) AS hallucination FROM t GROUP BY 1")
def sc06_answer_roll_up(spark, sf_dir):
    tags = F.array(F.lit("all"), F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    rows = _answer_scores(spark, sf_dir).withColumn("tags", tags)
    mean = lambda c, w: F.round(F.avg(F.when(w, F.col(c))), 6)
    return S.by_tag(rows, "tags", {"n": F.count(F.lit(1)), "positive_recall": mean("keyword_recall", ~F.col("should_refuse")), "refusal_rate": mean("keyword_recall", F.col("should_refuse")), "hallucination": F.round(F.avg(F.col("hallucinated").cast("int")), 6)})


GATE_ROWS = ", ".join(f"('{m}', '{d}', {t}::DOUBLE)" for m, d, t in S.GATE)
RATES = """SELECT 'triage_pass_rate' AS metric, avg((o_orderkey % 10 > {0})::INT) AS value FROM orders UNION ALL SELECT 'mean_hallucination_rate', avg((o_custkey % 10 < {0})::INT) FROM orders UNION ALL
SELECT 'median_total_duration_ms', median(o_totalprice) * (1 + {0} * 0.09::DOUBLE) FROM orders"""


@_query(f"""WITH g(metric, direction, tolerance) AS (VALUES {GATE_ROWS}), c AS ({RATES.format(3)}), b AS ({RATES.format(1)} UNION ALL SELECT 'p95_total_duration_ms', 1.0),
j AS (SELECT g.*, c.value AS c, b.value AS b FROM g LEFT JOIN c USING (metric) LEFT JOIN b USING (metric))
SELECT metric, direction, round(c, 6) AS "current", round(b, 6) AS baseline, c IS NULL OR b IS NULL AS missing,
c IS NOT NULL AND b IS NOT NULL AND CASE direction WHEN 'higher' THEN b - c > tolerance WHEN 'lower' THEN c - b > tolerance ELSE c > b * (1 + tolerance) END AS failed FROM j""")
def gate01_regression(spark, sf_dir):
    """GATE-01, JN-08."""
    orders = load(spark, sf_dir, "orders")

    def rates(k: int) -> DataFrame:
        wide = orders.agg(F.avg((F.col("o_orderkey") % 10 > k).cast("int")).alias("triage_pass_rate"), F.avg((F.col("o_custkey") % 10 < k).cast("int")).alias("mean_hallucination_rate"), (F.median("o_totalprice") * (1 + k * 0.09)).alias("median_total_duration_ms"))
        return wide.unpivot([], wide.columns, "metric", "value")

    spec = spark.createDataFrame(S.GATE, "metric string, direction string, tolerance double")
    baseline = rates(1).unionByName(spark.createDataFrame([("p95_total_duration_ms", 1.0)], "metric string, value double"))
    return S.gate(rates(3), baseline, spec).drop("delta").withColumns({n: F.round(n, 6) for n in ("current", "baseline")})


@_query("""WITH a AS (SELECT user_id, event_type, ts, ts + (value * 1000)::BIGINT * INTERVAL 1 MILLISECOND AS done FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, done) AS r FROM a)
SELECT user_id AS case_id, event_type AS stage, (epoch_us(done) - epoch_us(ts)) / 1000 AS duration_ms FROM r WHERE r = 1""")
def ev01_stage_durations(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    done = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.round(F.col("value") * 1000).cast("long") * 1000))
    return E.stage_durations(ev.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("stage"), F.col("ts").alias("started_at"), done.alias("completed_at")))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    stage = F.element_at(F.array(*[F.lit(s) for s in E.STAGES]), (F.col("turn") % 4 + 1).cast("int"))
    status = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 2), "reject").when(F.col("role") == "user", "edit").otherwise("approve")
    return c.select(F.col("conv_id").alias("case_id"), stage.alias("stage"), status.alias("status"), F.col("role").alias("actor"), F.col("turn").alias("ts"), F.when(F.col("turn") % 2 == 0, F.substring("text", 1, 5)).alias("note"), F.lit("why").alias("reason"), F.create_map(F.concat(F.lit("f"), (F.col("turn") % 3).cast("string")), F.substring("text", 1, 8)).alias("edits"))


DECISIONS = """WITH d AS (SELECT conv_id AS case_id, (['triage', 'risk', 'guideline', 'letter'])[turn % 4 + 1] AS stage, CASE WHEN conv_id % 5 = 0 AND turn = 2 THEN 'reject' WHEN role = 'user' THEN 'edit' ELSE 'approve' END AS status, role AS actor, turn AS ts,
CASE WHEN turn % 2 = 0 THEN substr(text, 1, 5) END AS note, 'f' || (turn % 3) AS field, substr(text, 1, 8) AS value FROM conversations)"""


@_query(DECISIONS + """, h AS (SELECT case_id, list(DISTINCT stage) FILTER (status IN ('approve', 'edit')) AS done, bool_or(status = 'reject') AS rej FROM d GROUP BY 1), o AS (SELECT *, list_filter(['triage', 'risk', 'guideline', 'letter'], lambda s: NOT coalesce(list_contains(done, s), FALSE)) AS open FROM h)
SELECT case_id, CASE WHEN rej THEN 'rejected' WHEN len(open) = 0 THEN 'complete' ELSE 'awaiting_decision' END AS status, CASE WHEN NOT rej AND len(open) > 0 THEN open[1] END AS next_stage FROM o""".replace("CASE WHEN rej THEN 'rejected'", "CASE WHEN case_id % 11 = 0 THEN 'failed' WHEN rej THEN 'rejected'").replace("CASE WHEN NOT rej", "CASE WHEN case_id % 11 <> 0 AND NOT rej"))
def ev02_case_status(spark, sf_dir):
    """EV-02: cases whose number is divisible by 11 failed in triage."""
    made = decisions(spark, sf_dir)
    return E.case_status(made, invalid=made.where("case_id % 11 = 0"))


@_query(DECISIONS + " SELECT case_id, field, arg_max(value, {'a': ts, 'b': value}) AS value FROM d WHERE status = 'edit' AND stage <> 'risk' GROUP BY ALL")
def ev03_edits(spark, sf_dir):
    return E.edited_fields(decisions(spark, sf_dir))


@_query(DECISIONS + " SELECT case_id, stage, CASE status WHEN 'approve' THEN 'approved' WHEN 'edit' THEN 'edited' ELSE 'rejected' END AS status, actor, ts, coalesce(note, 'why') AS note FROM d")
def ev04_records(spark, sf_dir):
    return E.decision_records(decisions(spark, sf_dir))
