"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each measure's distribution is kept per language and source as a mergeable quantile sketch: counts
of logarithmic buckets of 2 % width (relative error 1 %), which any two parts of the data combine
by addition. Tukey fences read from the sketches replace fixed cutoffs; a group of fewer than
MIN_DOCS documents takes the sketch of its language, or else of the whole corpus. Documents are
then joined with the fences of their group and filtered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_name, load, written

GAMMA = 1.02
MIN_DOCS = 100
#: Fences of at most so many groups are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEATED_PERCENT = 50, 50
#: Measure: (multiple of the interquartile range, least upper fence, whether a lower fence holds too).
RULES = {
    "symbols_per_word": (3.0, 0.1, False),
    "dup_line_share": (3.0, 0.5, False),
    "chars_per_word": (8.0, 0.0, True),
}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeated_words(words: Column) -> Column:
    """Number of words within 3-word windows that occur twice or more in the array."""

    def covered(keys: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda x, k: x["h"] == F.get(s, k)["h"]
            marked = F.transform(s, lambda x, k: F.when(F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)), x["i"]))
            return F.array_sort(F.array_compact(marked))

        ordered = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = _let(ordered, places)
        return _let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x))

    def counted(hashes: Column) -> Column:
        keys = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))), lambda h, i: F.xxhash64(h, hashes[i + 1], hashes[i + 2]))
        return _let(keys, lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), covered(t)).otherwise(F.lit(0).cast("long")))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), counted)


def measures(text: Column) -> dict[str, Column]:
    """Counts of a text (null: no words): see op9's contract for their meaning."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\f\r")) != "")
    return {
        "n_words": F.size(words_of(body)).cast("long"),
        "word_chars": F.length(F.array_join(words_of(body), "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def with_measures(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs with the counts, n_repeat_words and base_failed as further columns.

    The names get the prefix; a column of docs of such a name is replaced.
    """
    made = docs.withColumns({prefix + k: v for k, v in measures(F.col("text")).items()})
    made = made.withColumn(prefix + "n_repeat_words", repeated_words(words_of(F.coalesce("text", F.lit("")))))
    return made.withColumn(prefix + "base_failed", (F.col(prefix + "n_words") < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > REPEATED_PERCENT * F.col(prefix + "n_words")))


def _values(prefix: str = "") -> dict[str, Column]:
    c = lambda name: F.col(prefix + name).cast("double")
    return {
        "symbols_per_word": F.try_divide(c("n_symbols"), c("n_words")),
        "dup_line_share": F.try_divide(c("n_dup_lines"), c("n_lines")),
        "chars_per_word": F.try_divide(c("word_chars"), c("n_words")),
    }


def sketches(measured: DataFrame) -> DataFrame:
    """Bucket counts by measure and (lang, source), (lang) and all; level 0, 1 and 3. Documents
    without words are left out. Zero is bucket null's stand-in, -1000000."""
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in _values().items()])
    rows = measured.where("n_words > 0").select("lang", "source", F.inline(pairs))
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / F.log(F.lit(GAMMA)))).otherwise(-1000000).cast("long")
    fine = rows.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    sets = [["measure", "bucket", "lang", "source"], ["measure", "bucket", "lang"], ["measure", "bucket"]]
    return fine.groupingSets([[F.col(c) for c in s] for s in sets], "measure", "bucket", "lang", "source").agg(F.sum("n").alias("n"), (2 * F.grouping("lang").cast("int") + F.grouping("source").cast("int")).alias("level"))


def fences(sketch: DataFrame) -> DataFrame:
    """A row for each (lang, source, level): n documents and the fences low_* and high_*.

    A quartile is known to its bucket only, so the range between them runs from the lower end of the
    first one's bucket to the upper end of the third one's: a uniform group isn't fenced in to a point."""
    key = ["level", "lang", "source", "measure"]
    by = Window.partitionBy(*key)
    run = sketch.withColumns({"upto": F.sum("n").over(by.orderBy("bucket")), "total": F.sum("n").over(by)})
    value = F.when(F.col("bucket") == -1000000, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket").cast("double")))
    quart = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    quarters = run.groupBy(*key).agg(F.max("total").alias("total"), quart(0.25).alias("q1"), quart(0.75).alias("q3"))
    pick = lambda name, what: F.max(F.when(F.col("measure") == name, what))
    out = [F.max("total").alias("n_docs")]
    for name, (k, least, low) in RULES.items():
        least_q1 = F.col("q1") / GAMMA
        spread = k * (F.col("q3") - least_q1)
        out.append(pick(name, F.greatest(F.lit(least), F.col("q3") + spread)).alias(f"high_{name}"))
        out.append(pick(name, least_q1 - spread if low else F.lit(0.0)).alias(f"low_{name}"))
    return quarters.groupBy("level", "lang", "source").agg(*out)


def judged(measured: DataFrame, prefix: str = "", least_docs: int = MIN_DOCS) -> DataFrame:
    """measured (see with_measures) with kept: false where base_failed or a measure lies outside
    the fences. Null languages and sources are groups of their own; a table without such a column
    is taken as having nulls there. An empty table gives none. measured is read twice, so write it
    first if its counts are not at hand."""
    of = {c: F.col(c) if c in measured.columns else F.lit(None).cast("string") for c in ("lang", "source")}
    plain = measured.select(*[v.alias(k) for k, v in of.items()], *[F.col(prefix + n).alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")])
    all_fences = fences(sketches(plain))
    limits = [f"{side}_{name}" for name in RULES for side in ("high", "low")]
    pack = F.struct(*limits)
    group = all_fences.where("level = 0").select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.when(F.col("n_docs") >= least_docs, pack).alias("own"))
    tongue = all_fences.where("level = 1").select(F.col("lang").alias("_l"), F.when(F.col("n_docs") >= least_docs, pack).alias("wide"))
    whole = all_fences.where("level = 3").select(pack.alias("whole"))
    table = group.join(tongue, group["_l"].eqNullSafe(tongue["_l"]), "left").drop(tongue["_l"]).crossJoin(whole)  # whole is one row
    table = table.select("_l", "_s", F.coalesce("own", "wide", "whole").alias("_fence"))
    table = written(table, "fences")
    small = table.count() <= BROADCAST_ROWS
    lang, source, fence = fresh_name(measured, "l", "s", "fence")
    table = table.toDF(lang, source, fence)
    table = F.broadcast(table) if small else table
    joined = measured.join(table, of["lang"].eqNullSafe(F.col(lang)) & of["source"].eqNullSafe(F.col(source)), "left").drop(lang, source)
    outside = F.lit(False)
    for name, value in _values(prefix).items():
        outside |= F.coalesce((value > F.col(fence)[f"high_{name}"]) | (value < F.col(fence)[f"low_{name}"]), F.lit(False))
    return joined.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & ~outside).drop(fence)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of docs.

    Documents with null or empty text fail (they have fewer than MIN_WORDS words); repeated rows
    are judged alike; further columns stay. The counts are made once and written with the rows.
    """
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    measured = written(with_measures(docs, prefix), "measured")
    return judged(measured, prefix).where(f"{prefix}kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = written(with_measures(docs).drop("text"), "measured")
    return judged(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), r AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1
), m AS (
  SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols / nullif(n_words, 0)::DOUBLE AS symbols_per_word, n_dup_lines / nullif(n_lines, 0)::DOUBLE AS dup_line_share,
         word_chars / nullif(n_words, 0)::DOUBLE AS chars_per_word
  FROM m
), u AS (
  SELECT lang, source, measure, CASE WHEN value > 0 THEN ceil(ln(value) / ln(1.02::DOUBLE))::BIGINT ELSE -1000000 END AS bucket FROM (
    SELECT lang, source, unnest(['symbols_per_word', 'dup_line_share', 'chars_per_word']) AS measure,
           unnest([symbols_per_word, dup_line_share, chars_per_word]) AS value FROM v WHERE n_words > 0)
), s AS (
  SELECT measure, bucket, lang, source, count(*) AS n, grouping(lang, source) AS level
  FROM u GROUP BY GROUPING SETS ((measure, bucket, lang, source), (measure, bucket, lang), (measure, bucket))
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, measure) AS total,
         CASE WHEN bucket = -1000000 THEN 0.0::DOUBLE ELSE pow(1.02::DOUBLE, bucket) END AS value FROM s
), q AS (
  SELECT level, lang, source, measure, max(total) AS total,
         min(CASE WHEN upto >= 0.25 * total THEN value END) AS q1, min(CASE WHEN upto >= 0.75 * total THEN value END) AS q3
  FROM c GROUP BY ALL
), f AS (
  SELECT level, lang, source, max(total) AS n_docs,
         max(CASE WHEN measure = 'symbols_per_word' THEN greatest(0.1, q3 + 3 * (q3 - q1 / 1.02::DOUBLE)) END) AS hs,
         max(CASE WHEN measure = 'dup_line_share' THEN greatest(0.5, q3 + 3 * (q3 - q1 / 1.02::DOUBLE)) END) AS hd,
         max(CASE WHEN measure = 'chars_per_word' THEN q3 + 8 * (q3 - q1 / 1.02::DOUBLE) END) AS hc,
         max(CASE WHEN measure = 'chars_per_word' THEN q1 / 1.02::DOUBLE - 8 * (q3 - q1 / 1.02::DOUBLE) END) AS lc
  FROM q GROUP BY ALL
), p AS (
  SELECT v.*, CASE WHEN a.n_docs >= 100 THEN a WHEN b.n_docs >= 100 THEN b ELSE z END AS fence
  FROM v LEFT JOIN f a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM v.lang AND a.source IS NOT DISTINCT FROM v.source
         LEFT JOIN f b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM v.lang LEFT JOIN f z ON z.level = 3
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(symbols_per_word > fence.hs OR dup_line_share > fence.hd OR chars_per_word > fence.hc OR chars_per_word < fence.lc, FALSE) AS kept
FROM p
"""
