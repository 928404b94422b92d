"""Queries over sources and streams. Streams read the given tables once and stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import drift as D
from ..sources import files as S
from ..streaming import drift as SD
from ..streaming import status as SS
from .cases import DECISIONS, decisions
from .corpus import MARKER, PAGES
from .tables import load, scratch

QUERIES, ORACLE_SQL = {}, {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@_query("SELECT sum(value) AS total, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS n_null FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 1.5::DOUBLE END AS value FROM events)")
def src09_report_sink(spark, sf_dir):
    """SRC-09: NaN and infinities written as null, read back."""
    path = scratch(spark, "report")
    ev = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 6 == 0, float("nan")).when(F.col("event_id") % 3 == 0, float("inf")).otherwise(1.5).alias("value"))
    S.write_report(ev, path)
    return spark.read.schema("event_id long, value double").json(path).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("n_null"))


@_query("SELECT o_orderpriority AS source, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders GROUP BY 1")
def src05_partitioned_sink(spark, sf_dir):
    """SRC-04, 05: written by partition, read back by suffix."""
    path = scratch(spark, "table") + ".parquet"
    S.write_table(load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("source")), path, ["source"])
    return S.read_any(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"))


@_query("SELECT item_id, md5(text) AS digest FROM benchmark ORDER BY item_id LIMIT 25")
def src06_first_questions(spark, sf_dir):
    """SRC-06: the first lines of several files, in the order of the files; a limit is the feature."""
    path = scratch(spark, "questions")
    S.write_ordered(load(spark, sf_dir, "benchmark").select("item_id", "text"), path, ["item_id"])
    schema = load(spark, sf_dir, "benchmark").select("item_id", "text").schema
    return S.read_questions(spark, path, schema, {}, limit=25).select("item_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@_query(PAGES + "SELECT doc_id, page_no::INT AS page_no, page_no::INT AS nth, md5(text) AS digest, char_offset FROM o")
def src07_page_table(spark, sf_dir):
    """SRC-07: saved in order, read back; nth is a page's place among the lines of its document."""
    path = scratch(spark, "pages")
    S.save_pages(T.pages(load(spark, sf_dir, "documents").select("doc_id", "text"), MARKER), path)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
    return S.load_pages(spark, path).select("doc_id", "page_no", nth.alias("nth"), F.md5(F.col("text").cast("binary")).alias("digest"), "char_offset")


@_query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+\s*|\s+') AS p FROM documents), w AS (SELECT doc_id, p, unnest(range(0, 1 + greatest(0, ceil((len(p) - 128) / 96.0)::INT))) AS c FROM t WHERE len(p) > 0)
SELECT 'small' AS strategy, doc_id, c::INT AS chunk_no, (c + 1)::INT AS nth, least(128, len(p) - c * 96)::INT AS n_tokens, md5(array_to_string(p[c * 96 + 1:c * 96 + 128], '')) AS digest FROM w""")
def src08_chunk_table(spark, sf_dir):
    """SRC-08: chunks of two strategies saved in folders, one strategy read back in order."""
    path, docs = scratch(spark, "chunks"), load(spark, sf_dir, "documents").select("doc_id", "text")
    S.save_chunks(T.window_chunks(docs).unionByName(T.window_chunks(docs, 128, 96, "small")), path)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
    return S.load_chunks(spark, path, "small").select("strategy", "doc_id", "chunk_no", nth.alias("nth"), "n_tokens", F.md5(F.col("text").cast("binary")).alias("digest"))


@_query(PAGES + r""", w AS (SELECT doc_id, p, unnest(range(0, 1 + greatest(0, ceil((len(p) - 512) / 448.0)::INT))) AS c FROM (SELECT doc_id, regexp_extract_all(text, '\S+\s*|\s+') AS p FROM documents) WHERE len(p) > 0),
t AS (SELECT doc_id, c, array_to_string(p[c * 448 + 1:c * 448 + 512], '') AS text FROM w)
SELECT 'document' AS kind, doc_id::VARCHAR AS key, count(*) AS n, sum(length(text))::BIGINT AS n_chars, sha256(string_agg(md5(text), '' ORDER BY page_no)) AS sha256 FROM o GROUP BY doc_id
UNION ALL SELECT 'strategy', 'token', count(*), sum(length(text))::BIGINT, sha256(sum(('0x' || substr(md5(doc_id || '|' || c || '|' || text), 1, 8))::UBIGINT)::VARCHAR) FROM t""")
def src11_manifest(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return S.corpus_manifest(T.pages(docs, r"[A-Za-z]+\."), T.window_chunks(docs))


U = "('0x' || substr(md5('20260505|' || {}), 1, 8))::UBIGINT / 4294967296.0::DOUBLE"


def _u(name: str) -> str:
    return U.format(f"o_orderkey || '|{name}'")


@_query(f"""WITH r AS (SELECT o_orderkey AS id, (28 + floor({_u('age')} * 50))::INT AS Age, CASE WHEN {_u('sex')} < 0.7 THEN 'M' ELSE 'F' END AS Sex,
CASE WHEN {_u('cp')} < 0.5 THEN 'ASY' WHEN {_u('cp')} < 0.75 THEN 'NAP' WHEN {_u('cp')} < 0.9 THEN 'ATA' ELSE 'TA' END AS ChestPainType, (90 + floor({_u('bp')} * 91))::INT AS RestingBP,
CASE WHEN {_u('zero')} < 0.1 THEN 0 ELSE (120 + floor({_u('chol')} * 281))::INT END AS Cholesterol, (70 + floor({_u('hr')} * 131))::INT AS MaxHR, CASE WHEN {_u('ex')} < 0.6 THEN 'N' ELSE 'Y' END AS ExerciseAngina,
CASE WHEN {_u('st')} < 0.5 THEN 'Flat' WHEN {_u('st')} < 0.9 THEN 'Up' ELSE 'Down' END AS ST_Slope, {_u('y')} AS u FROM orders)
SELECT * EXCLUDE (u), (u < 1 / (1 + exp(-((Age - 54) * 0.05::DOUBLE + CASE WHEN ChestPainType = 'ASY' THEN 1.0::DOUBLE ELSE -0.6 END + CASE WHEN ExerciseAngina = 'Y' THEN 0.8::DOUBLE ELSE -0.5 END))))::INT AS HeartDisease FROM r""")
def src13_synthetic(spark, sf_dir):
    """A synthetic record for each order."""
    return S.synthetic_records(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


@_query(f"""WITH c AS (SELECT o_orderpriority AS tag, o_orderstatus AS band, count(*) AS n FROM orders GROUP BY ALL), d AS (SELECT tag, band, (SELECT max(n) FROM c) - n AS need FROM c WHERE n < (SELECT max(n) FROM c)),
b AS (SELECT *, sum(need) OVER (ORDER BY tag, band) - need AS before FROM d), k AS (SELECT tag, band, before, unnest(range(1, need + 1)) AS k FROM b)
SELECT ((SELECT max(o_orderkey) FROM orders) + before + k)::BIGINT AS case_id, tag, band, CASE band WHEN 'F' THEN (28 + floor({U.format("tag || '|' || band || '|' || k || '|age'")} * 22))::INT WHEN 'O' THEN (50 + floor({U.format("tag || '|' || band || '|' || k || '|age'")} * 20))::INT
WHEN 'P' THEN (70 + floor({U.format("tag || '|' || band || '|' || k || '|age'")} * 8))::INT END AS age, {U.format("tag || '|' || band || '|' || k || '|fault'")} < 0.1 AS faulty FROM k""")
def src14_top_up(spark, sf_dir):
    """Orders' priorities and statuses as tags and bands, topped up to the largest count there is."""
    cases = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("tag"), F.col("o_orderstatus").alias("band"))
    counts = cases.groupBy("tag", "band").agg(F.count(F.lit(1)).alias("n"))
    targets = counts.crossJoin(counts.agg(F.max("n").alias("target"))).select("tag", "band", "target")  # the right side is one row
    return S.top_up(cases, targets, {"F": (28, 49), "O": (50, 69), "P": (70, 77)})


def _stored(spark, sf_dir) -> DataFrame:
    return D.numeric_reference(D.melt(load(spark, sf_dir, "events"), ["value"]), [], 5)


EVENT_PSI = """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(value, [0.2, 0.4, 0.6, 0.8]))) AS edges FROM events), b AS (SELECT date_trunc('day', ts) AS day, len(list_filter(edges, lambda x: x <= value)) AS bin FROM events, e),
r AS (SELECT bin, count(*) AS r FROM b GROUP BY 1), d AS (SELECT DISTINCT day FROM b), k AS (SELECT d.day, r.bin, r.r, count(b.bin) AS c FROM d CROSS JOIN r LEFT JOIN b ON b.day = d.day AND b.bin = r.bin GROUP BY ALL),
s AS (SELECT day, CASE WHEN r = 0 THEN 1e-6 ELSE r / sum(r) OVER w END AS rp, CASE WHEN c = 0 THEN 1e-6 ELSE c / sum(c) OVER w END AS cp FROM k WINDOW w AS (PARTITION BY day)), p AS (SELECT day, sum((cp - rp) * ln(cp / rp)) AS psi FROM s GROUP BY 1)"""


@_query(EVENT_PSI + " SELECT strftime(day, '%Y-%m-%d') AS day, round(psi, 9) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'major' END AS severity FROM p")
def st01_windowed_drift(spark, sf_dir):
    """ST-01's report over the whole table at once; the stream gives these rows window by window."""
    stored = _stored(spark, sf_dir)
    ev = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    report = SD.window_report(SD.windowed_bins(ev, stored, "ts", ["value"]), stored)
    return report.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), F.round("psi", 9).alias("psi"), "severity")


@_query(EVENT_PSI + " SELECT strftime(day, '%Y-%m-%d') AS day, round(psi, 9) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'major' END AS severity FROM p")
def st01_drift_stream(spark, sf_dir):
    """ST-01: the stream's windows, as its sink has them; a closing row ends the last of them."""
    path, stored = scratch(spark, "drift"), _stored(spark, sf_dir)
    table = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    closing = table.limit(0)
    closing.write.parquet(f"{path}/closing")
    # the name as a pattern, as a stream wants a folder and the table may be a file
    rows = spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = rows.unionByName(spark.readStream.schema(closing.schema).parquet(f"{path}/closing"))
    sink = lambda found, n: found.write.mode("append").parquet(f"{path}/out")
    run = lambda: SD.run_drift(stream, stored, "ts", ["value"], sink, f"{path}/state").awaitTermination()
    run()
    end = table.agg((F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"))
    end.select(*[F.col(c) if c == "ts" else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns]).write.mode("append").parquet(f"{path}/closing")
    run()
    return spark.read.parquet(f"{path}/out").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), F.round("psi", 9).alias("psi"), "severity")


@_query(DECISIONS + """, h AS (SELECT case_id, list(DISTINCT stage) FILTER (status IN ('approve', 'edit')) AS done, bool_or(status = 'reject') AS rej FROM d GROUP BY 1), o AS (SELECT *, list_filter(['triage', 'risk', 'guideline', 'letter'], lambda s: NOT coalesce(list_contains(done, s), FALSE)) AS open FROM h)
SELECT case_id, CASE WHEN rej THEN 'rejected' WHEN len(open) = 0 THEN 'complete' ELSE 'awaiting_decision' END AS status, CASE WHEN NOT rej AND len(open) > 0 THEN open[1] END AS next_stage FROM o""")
def st02_status_stream(spark, sf_dir):
    """ST-02: statuses from a decision stream; of a case's updates the last batch's."""
    path = scratch(spark, "status")
    decisions(spark, sf_dir).select("case_id", "stage", "status").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("case_id long, stage string, status string").parquet(f"{path}/in")
    sink = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{path}/out")
    SS.status_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    last = spark.read.parquet(f"{path}/out").groupBy("case_id").agg(F.max_by(F.struct("status", "next_stage"), "batch").alias("s"))
    return last.select("case_id", "s.*")
