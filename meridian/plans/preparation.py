"""Queries over the tabular and split operators; line items stand in for the raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits as S
from ..operators import tabular as P
from .tables import load

QUERIES, ORACLE_SQL = {}, {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


FIELDS = {
    "age": "CAST(20 + l_partkey % 65 AS VARCHAR) || '.5'",
    "sex": "CAST(l_suppkey % 3 AS VARCHAR)",
    "cp": "CAST(l_linenumber % 6 AS VARCHAR)",
    "trestbps": "CASE WHEN l_partkey % 11 = 0 THEN '?' ELSE CAST(80 + l_partkey % 120 AS VARCHAR) END",
    "chol": "CASE WHEN l_partkey % 7 = 0 THEN '0' ELSE CAST(120 + l_suppkey % 300 AS VARCHAR) END",
    "fbs": "CAST(l_linenumber % 2 AS VARCHAR)",
    "restecg": "CAST(l_partkey % 4 AS VARCHAR)",
    "thalach": "CASE WHEN l_suppkey % 9 = 0 THEN 'x' ELSE CAST(70 + l_partkey % 130 AS VARCHAR) END",
    "exang": "CAST(l_partkey % 3 AS VARCHAR)",
    "oldpeak": "CAST(l_linenumber % 5 - 1 AS VARCHAR)",
    "slope": "CAST(l_suppkey % 5 AS VARCHAR)",
    "ca": "'0'",
    "thal": "'3'",
    "num": "CASE WHEN l_returnflag = 'R' THEN '2' WHEN l_returnflag = 'A' THEN '?' ELSE '0' END",
}
RAW = "raw AS (SELECT l_orderkey AS oid, l_linenumber AS lno, l_linestatus AS source, " + ", ".join(f"{v} AS {k}" for k, v in FIELDS.items()) + " FROM lineitem)"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").selectExpr("l_linestatus AS source", *[f"{v.replace('VARCHAR', 'STRING')} AS {k}" for k, v in FIELDS.items()])


RECODED = """
h AS (SELECT round_even(TRY_CAST(age AS DOUBLE), 0)::INT AS Age, CASE TRY_CAST(sex AS DOUBLE) WHEN 1 THEN 'M' WHEN 0 THEN 'F' END AS Sex,
  CASE TRY_CAST(cp AS DOUBLE) WHEN 1 THEN 'TA' WHEN 2 THEN 'ATA' WHEN 3 THEN 'NAP' WHEN 4 THEN 'ASY' END AS ChestPainType, TRY_CAST(trestbps AS DOUBLE) AS RestingBP, TRY_CAST(chol AS DOUBLE) AS Cholesterol,
  TRY_CAST(fbs AS DOUBLE)::INT AS FastingBS, CASE TRY_CAST(restecg AS DOUBLE) WHEN 0 THEN 'Normal' WHEN 1 THEN 'ST' WHEN 2 THEN 'LVH' END AS RestingECG, TRY_CAST(thalach AS DOUBLE) AS MaxHR,
  CASE TRY_CAST(exang AS DOUBLE) WHEN 0 THEN 'N' WHEN 1 THEN 'Y' END AS ExerciseAngina, TRY_CAST(oldpeak AS DOUBLE) AS Oldpeak,
  CASE TRY_CAST(slope AS DOUBLE) WHEN 1 THEN 'Up' WHEN 2 THEN 'Flat' WHEN 3 THEN 'Down' END AS ST_Slope, (coalesce(TRY_CAST(num AS DOUBLE), 0) >= 1)::INT AS HeartDisease, source FROM raw)"""
GROUP = "Age, Sex, ChestPainType, RestingBP, Cholesterol, FastingBS, RestingECG, MaxHR, ExerciseAngina, Oldpeak, ST_Slope, HeartDisease, source"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.recode(raw(spark, sf_dir))


INDICATED = ["RestingBP", "MaxHR", "ExerciseAngina", "Oldpeak", "ST_Slope"]
LABELLED = ["Sex", "ChestPainType", "RestingECG", "ExerciseAngina", "ST_Slope"]
NUMBERS = ["Age", "RestingBP", "Cholesterol", "FastingBS", "MaxHR", "Oldpeak"]


@_query(f"WITH {RAW}, {RECODED} SELECT {GROUP} FROM h")
def prj02_recode(spark, sf_dir):
    """PRJ-01..03."""
    return records(spark, sf_dir)


@_query(f"""WITH {RAW}, {RECODED} SELECT Age::DOUBLE AS Age, coalesce(Sex, 'Missing') AS Sex, coalesce(ChestPainType, 'Missing') AS ChestPainType, RestingBP, nullif(Cholesterol, 0) AS Cholesterol, FastingBS::DOUBLE AS FastingBS,
coalesce(RestingECG, 'Missing') AS RestingECG, MaxHR, coalesce(ExerciseAngina, 'Missing') AS ExerciseAngina, Oldpeak, coalesce(ST_Slope, 'Missing') AS ST_Slope, HeartDisease, source,
(RestingBP IS NULL)::TINYINT AS RestingBP_was_missing, (MaxHR IS NULL)::TINYINT AS MaxHR_was_missing, (ExerciseAngina IS NULL)::TINYINT AS ExerciseAngina_was_missing, (Oldpeak IS NULL)::TINYINT AS Oldpeak_was_missing, (ST_Slope IS NULL)::TINYINT AS ST_Slope_was_missing FROM h""")
def prj08_clean(spark, sf_dir):
    """PRJ-04..08; run twice, as it is idempotent."""
    step = lambda d: P.clean(d, "Cholesterol", INDICATED, LABELLED, NUMBERS)
    return step(step(records(spark, sf_dir)))


@_query(f"""WITH {RAW}, {RECODED}, f AS (SELECT *, list_filter([CASE WHEN Cholesterol = 0 THEN 'cholesterol_missing_sentinel' END, CASE WHEN Oldpeak < 0 THEN 'oldpeak_negative' END,
CASE WHEN RestingBP < 90 OR RestingBP > 180 THEN 'resting_bp_extreme' END, CASE WHEN Age < 28 OR Age > 77 THEN 'age_outside_training_range' END], lambda x: x IS NOT NULL) AS fl FROM h)
SELECT CASE WHEN Age >= 0 AND Age < 50 THEN '<50' WHEN Age < 70 THEN '50-70' WHEN Age < 200 THEN '>=70' ELSE 'unknown' END AS age_band, array_to_string(fl, ',') AS flags, count(*) AS n FROM f GROUP BY ALL""")
def prj10_flags(spark, sf_dir):
    """PRJ-09, 10."""
    made = records(spark, sf_dir).select(P.band(F.col("Age"), P.AGE_BANDS).alias("age_band"), F.concat_ws(",", P.flags(P.triage_rules())).alias("flags"))
    return made.groupBy("age_band", "flags").agg(F.count(F.lit(1)).alias("n"))


#: A talk as an object: every kind of rule, at three depths.
TALK = {
    "type": "object", "required": ["talk", "turns", "owner"],
    "properties": {
        "talk": {"type": "string", "pattern": "^t-[0-9]+$"},
        "turns": {
            "type": "array", "minItems": 2, "maxItems": 5,
            "items": {"type": "object", "required": ["role"], "properties": {"turn": {"type": "integer", "minimum": 0, "maximum": 3}, "role": {"enum": ["user", "assistant"]}, "text": {"type": "string", "minLength": 20, "maxLength": 400}}},
        },
    },
}


@_query(r"""WITH c AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 0 THEN NULL WHEN (conv_id + turn) % 11 = 0 THEN 'bot' ELSE role END AS role, text FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM c),
p AS (SELECT *, '$.turns[' || i || ']' AS place FROM t), d AS (SELECT conv_id, any_value(n) AS n FROM t GROUP BY 1)
SELECT conv_id, '$.owner: required' AS violation FROM d
UNION ALL SELECT conv_id, '$.talk: pattern' FROM d WHERE conv_id % 5 = 0
UNION ALL SELECT conv_id, '$.turns: minItems' FROM d WHERE n < 2
UNION ALL SELECT conv_id, '$.turns: maxItems' FROM d WHERE n > 5
UNION ALL SELECT conv_id, place || '.role: required' FROM p WHERE role IS NULL
UNION ALL SELECT conv_id, place || '.role: enum' FROM p WHERE role NOT IN ('user', 'assistant')
UNION ALL SELECT conv_id, place || '.turn: maximum' FROM p WHERE turn > 3
UNION ALL SELECT conv_id, place || '.text: minLength' FROM p WHERE length(text) < 20
UNION ALL SELECT conv_id, place || '.text: maxLength' FROM p WHERE length(text) > 400""")
def prj11_schema(spark, sf_dir):
    """PRJ-11: talks as nested objects, against a schema; a row for each violation."""
    c = load(spark, sf_dir, "conversations")
    mark = (F.col("conv_id") + F.col("turn")).cast("long")
    role = F.when(mark % 7 == 0, F.lit(None)).when(mark % 11 == 0, "bot").otherwise(F.col("role"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", role.alias("role")))), lambda s: F.struct(s["turn"].alias("turn"), s["role"].alias("role"), s["text"].alias("text")))
    talks = c.groupBy("conv_id").agg(turns.alias("turns")).withColumn("talk", F.concat(F.when(F.col("conv_id") % 5 == 0, "x-").otherwise("t-"), F.col("conv_id").cast("string")))
    return P.validate_schema(talks, TALK)[1].select("conv_id", F.explode("violations").alias("violation"))


@_query(f"""WITH {RAW}, {RECODED}, v AS (SELECT list_filter([CASE WHEN NOT coalesce(Age BETWEEN 18 AND 120, FALSE) THEN 'age' END, CASE WHEN NOT coalesce(Sex IN ('M', 'F'), FALSE) THEN 'sex' END,
CASE WHEN NOT coalesce(RestingBP BETWEEN 60 AND 260, FALSE) THEN 'resting_bp' END, CASE WHEN NOT coalesce(MaxHR BETWEEN 50 AND 240, FALSE) THEN 'max_hr' END], lambda x: x IS NOT NULL) AS bad FROM h)
SELECT array_to_string(bad, ',') AS violations, count(*) AS n FROM v GROUP BY ALL""")
def prj11_validate(spark, sf_dir):
    c = F.col
    good, bad = P.validate(records(spark, sf_dir), {"age": c("Age").between(18, 120), "sex": c("Sex").isin("M", "F"), "resting_bp": c("RestingBP").between(60, 260), "max_hr": c("MaxHR").between(50, 240)})
    return good.select(F.lit("").alias("violations")).unionByName(bad.select(F.concat_ws(",", "violations").alias("violations"))).groupBy("violations").agg(F.count(F.lit(1)).alias("n"))


RISK = f"""WITH {RAW}, {RECODED}, z AS (SELECT *, [(Age - 50) * 0.04::DOUBLE, CASE WHEN Sex = 'M' THEN 0.4 ELSE 0 END, CASE ChestPainType WHEN 'ASY' THEN 1.2 WHEN 'TA' THEN 0.6 ELSE 0 END, CASE WHEN ExerciseAngina = 'Y' THEN 0.7 ELSE 0 END,
CASE ST_Slope WHEN 'Down' THEN 0.9 WHEN 'Flat' THEN 0.6 ELSE 0 END, CASE WHEN Cholesterol = 0 THEN 0.05 ELSE (Cholesterol - 200) * 0.001::DOUBLE END, -(MaxHR - 140) * 0.005::DOUBLE] AS t FROM h WHERE MaxHR IS NOT NULL),
p AS (SELECT *, 1 / (1 + exp(-(list_sum(t) - 2.5))) AS p FROM z)"""


@_query(RISK + " SELECT CASE WHEN p >= 0.10 THEN 'high' WHEN p <= 0.05 THEN 'low' ELSE 'intermediate' END AS band, count(*) AS n, round(avg(p), 9) AS mean_p FROM p GROUP BY 1")
def prj14_risk_bands(spark, sf_dir):
    """PRJ-12, 14."""
    p = records(spark, sf_dir).where("MaxHR IS NOT NULL").select(P.risk_probability(P.risk_terms()).alias("p"))
    return p.groupBy(P.risk_band(F.col("p")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 9).alias("mean_p"))


@_query(RISK + """, u AS (SELECT unnest(list_sort(list_transform(range(1, 8), lambda i: {'s': -abs(t[i]), 'i': i, 'v': t[i]}))[1:6]) AS e FROM p)
SELECT (['Age', 'Sex', 'ChestPainType', 'ExerciseAngina', 'ST_Slope', 'Cholesterol', 'MaxHR'])[e.i] AS feature, count(*) AS n, round(sum(e.v), 6) AS total FROM u GROUP BY 1""")
def prj13_contributions(spark, sf_dir):
    made = records(spark, sf_dir).where("MaxHR IS NOT NULL").select(F.inline(P.contributions(P.risk_terms())))
    return made.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("contribution"), 6).alias("total"))


@_query("""WITH e AS (SELECT unnest(list_sort(list_transform(range(1, 5), lambda i: {'s': -abs(t[i]), 'f': (['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'])[i], 'v': t[i]}))) AS e FROM (SELECT [l_quantity * 0.5::DOUBLE, l_extendedprice * -0.001::DOUBLE, l_discount * 3.0::DOUBLE, l_tax * 2.0::DOUBLE] AS t FROM lineitem))
SELECT e.f AS feature, count(*) AS n, round(avg(e.v), 6) AS mean FROM e GROUP BY 1""")
def prj15_model_contributions(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    made = load(spark, sf_dir, "lineitem").select(F.inline(P.model_contributions(F.array(*names), [0.5, -0.001, 3.0, 2.0], names)))
    return made.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("contribution"), 6).alias("mean"))


@_query("SELECT event_id, '<scrubbed>' AS patient, event_type AS kind FROM events")
def prj18_scrub(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select(F.array(F.struct(F.col("user_id").alias("Patient"), F.col("event_type").alias("kind"))).alias("payload"), "event_id")
    return P.scrub(ev).select("event_id", F.col("payload")[0]["Patient"].alias("patient"), F.col("payload")[0]["kind"].alias("kind"))


@_query("""WITH j AS (SELECT user_id % 7 AS a, event_id % 6 AS q FROM events)
SELECT least(greatest(a, 1), 5)::INT AS alignment, least(greatest(q, 1), 5)::INT AS quality, least(greatest(a, 1), 5) >= 4 AND least(greatest(q, 1), 5) >= 4 AS passed, count(*) AS n FROM j GROUP BY ALL""")
def prj21_judge_json(spark, sf_dir):
    """PRJ-20, 21."""
    ev = load(spark, sf_dir, "events")
    text = F.concat(F.lit('Score: {"alignment": '), (F.col("user_id") % 7).cast("string"), F.lit(', "quality": '), (F.col("event_id") % 6).cast("string"), F.lit("} done {"))
    return ev.select(P.judge_json(text).alias("j")).select("j.*").groupBy("alignment", "quality", "passed").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {RAW}, {RECODED} SELECT source, count(*) AS n, round(100 * avg(HeartDisease), 9) AS pct_positive, round(100 * count(*) / sum(count(*)) OVER (), 9) AS pct_of_total FROM h GROUP BY 1")
def eda01_source_profile(spark, sf_dir):
    made = P.source_profile(records(spark, sf_dir), "source", "HeartDisease")
    return made.withColumns({c: F.round(c, 9) for c in ("pct_positive", "pct_of_total")})


@_query(f"WITH {RAW}, {RECODED} SELECT source, round(100 * avg((RestingBP IS NULL)::INT), 1) AS RestingBP, round(100 * avg((MaxHR IS NULL)::INT), 1) AS MaxHR, round(100 * avg((ST_Slope IS NULL)::INT), 1) AS ST_Slope FROM h GROUP BY 1")
def eda02_missing_rates(spark, sf_dir):
    return P.missing_rates(records(spark, sf_dir), "source", ["RestingBP", "MaxHR", "ST_Slope"])


@_query(f"WITH {RAW}, {RECODED} SELECT source, count(*) AS n, count(*) FILTER (Cholesterol = 0) AS n_zero, round(100 * count(*) FILTER (Cholesterol = 0) / count(*), 9) AS pct_zero FROM h GROUP BY 1")
def eda03_sentinel_audit(spark, sf_dir):
    return P.sentinel_audit(records(spark, sf_dir), "Cholesterol", "source").withColumn("pct_zero", F.round("pct_zero", 9))


@_query(f"WITH {RAW}, {RECODED}, m AS (SELECT source, unnest(['Age', 'RestingBP', 'MaxHR']) AS feature, unnest([Age::DOUBLE, RestingBP, MaxHR]) AS value FROM h) SELECT source, feature, value FROM m WHERE value IS NOT NULL")
def eda04_melt_numeric(spark, sf_dir):
    return P.melt_numeric(records(spark, sf_dir), ["source"], ["Age", "RestingBP", "MaxHR"])


@_query(f"WITH {RAW}, {RECODED}, m AS (SELECT unnest(['Sex', 'ST_Slope']) AS feature, unnest([Sex, ST_Slope]) AS level FROM h) SELECT feature, level, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY feature), 9) AS share FROM m GROUP BY feature, level")
def eda05_level_shares(spark, sf_dir):
    return P.level_shares(records(spark, sf_dir), ["Sex", "ST_Slope"]).withColumn("share", F.round("share", 9))


@_query("""SELECT a, b, round(r, 6) AS r FROM (SELECT unnest(['q', 'q', 'q', 'd', 'd', 'd', 't', 't', 't']) AS x, unnest(['l_quantity', 'l_quantity', 'l_quantity', 'l_discount', 'l_discount', 'l_discount', 'l_tax', 'l_tax', 'l_tax']) AS a,
unnest(['l_quantity', 'l_discount', 'l_tax', 'l_quantity', 'l_discount', 'l_tax', 'l_quantity', 'l_discount', 'l_tax']) AS b,
unnest([corr(l_quantity, l_quantity), corr(l_quantity, l_discount), corr(l_quantity, l_tax), corr(l_discount, l_quantity), corr(l_discount, l_discount), corr(l_discount, l_tax), corr(l_tax, l_quantity), corr(l_tax, l_discount), corr(l_tax, l_tax)]) AS r FROM lineitem)""")
def eda06_pearson(spark, sf_dir):
    return P.pearson_matrix(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumn("r", F.round("r", 6))


@_query("SELECT l_linestatus, 'l_quantity' AS feature, greatest(0, least(9, floor(l_quantity / 5)))::INT AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def eda08_histogram(spark, sf_dir):
    return P.histogram(load(spark, sf_dir, "lineitem"), ["l_quantity"], "l_linestatus", 10, 0.0, 50.0)


@_query("SELECT p AS fold, CASE WHEN o_orderpriority = p THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM orders, (SELECT DISTINCT o_orderpriority AS p FROM orders) GROUP BY ALL")
def spl01_leave_one_out(spark, sf_dir):
    return S.leave_one_out(load(spark, sf_dir, "orders"), "o_orderpriority").groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


ROWS = "r AS (SELECT doc_id, quality AS y, ('0x' || substr(md5(20260505 || '|' || doc_id), 1, 8))::UBIGINT AS h FROM labels)"


@_query(f"""WITH {ROWS}, p AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, doc_id) AS i, count(*) OVER (PARTITION BY y) AS n FROM r)
SELECT doc_id, y, CASE WHEN i <= round_even(n * 0.1::DOUBLE, 0) THEN 'val' WHEN i <= round_even(n * 0.1::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'calib' ELSE 'train' END AS split FROM p""")
def spl02_within_split(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return S.within_split(rows, [], "y", "doc_id").select("doc_id", "y", "split")


@_query(f"WITH {ROWS} SELECT doc_id, y, ((row_number() OVER (PARTITION BY y ORDER BY h, doc_id) - 1) % 5)::INT AS fold FROM r")
def spl03_random_folds(spark, sf_dir):
    return S.random_folds(load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "y", "doc_id")


@_query("SELECT doc_id, 2::BIGINT AS n_splits FROM labels WHERE FALSE")
def spl04_overlaps(spark, sf_dir):
    return S.overlaps(spl02_within_split(spark, sf_dir), "doc_id", "split")


@_query("""WITH f AS (SELECT doc_id FROM labels ORDER BY doc_id LIMIT 20), r AS (SELECT doc_id, toxic AS y, doc_id IN (SELECT doc_id FROM f) AS forced, ('0x' || substr(md5('20260505|' || doc_id), 1, 8))::UBIGINT AS h FROM labels),
z AS (SELECT count(*) AS n, avg(y) AS share, count(*) FILTER (NOT forced AND y = 1) AS pos, count(*) FILTER (NOT forced AND y = 0) AS neg, greatest(80 - count(*) FILTER (forced), 0) AS budget FROM r),
q AS (SELECT *, CASE WHEN n <= 80 THEN pos ELSE least(round_even(budget * share, 0)::BIGINT, pos) END AS q1 FROM z), p AS (SELECT *, row_number() OVER (PARTITION BY y, forced ORDER BY h, doc_id) AS place FROM r)
SELECT doc_id, y FROM p, q WHERE forced OR place <= CASE WHEN y = 1 THEN q1 ELSE least(budget - q1, neg) END""")
def spl05_capped_sample(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    forced = rows.orderBy("doc_id").limit(20).select("doc_id")
    return S.capped_sample(rows, "y", "doc_id", 80, forced)
