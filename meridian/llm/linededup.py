"""Line dedup by overlapping three-line windows.

The lines that hold more than white space are numbered; each three consecutive ones are a window,
hashed to 128 bits. Of a window that occurs more than once, all occurrences after the first (by
doc_id, then line) cover their lines, and a document loses the lines that any such window covers.

With short=True a document of fewer content lines has one window, the whole of them, which equals
such a window of another document only. op4_linededup is the three-line method that its SQL states;
the pipeline takes the short windows too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, load

LINES = 3
BLANK = " \t\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _content(text: Column) -> Column:
    """Structs (at, line): the lines with more than white space, trimmed, and their places among all."""
    placed = F.transform(_lines(text), lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(BLANK)).alias("line")))
    return F.filter(placed, lambda s: s["line"] != "")


def windows(docs: DataFrame, size: int = LINES, short: bool = False) -> DataFrame:
    """Rows (h, g, doc_id, at): the two halves of each window's hash and its first content line.

    A short document's only window has minus its number of lines as place."""
    small = lambda m: [F.when(F.size(m) == n, F.array(F.struct(*[F.xxhash64(F.lit("short"), *[m[k][part] for k in range(n)]).alias(part) for part in ("h", "g")], F.lit(-n).alias("at")))) for n in range(1, size)]
    marks = F.transform(_content(F.col("text")), lambda s: F.struct(F.xxhash64(s["line"]).alias("h"), F.xxhash64(F.lit(1), s["line"]).alias("g")))
    full = lambda m: F.transform(F.slice(m, 1, F.greatest(F.size(m) - (size - 1), F.lit(0))), lambda _, i: F.struct(*[F.xxhash64(*[m[i + k][part] for k in range(size)]).alias(part) for part in ("h", "g")], i.alias("at")))
    held = docs.where("doc_id IS NOT NULL").select("doc_id", F.transform(F.array(marks), lambda m: F.coalesce(*(small(m) if short else []), full(m)))[0].alias("w"))
    return held.select("doc_id", F.inline("w"))


def covered_starts(docs: DataFrame, size: int = LINES, short: bool = False) -> DataFrame:
    """(doc_id, starts): the windows of each document that occurred before."""
    found = windows(docs, size, short)
    first = found.groupBy("h", "g").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = found.join(first.select("h", "g", "first"), ["h", "g"]).where("first <> struct(doc_id, at)")
    return later.groupBy("doc_id").agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame, size: int = LINES, short: bool = False) -> DataFrame:
    """docs with text freed of repeated windows, n_lines (content lines before) and n_removed.

    A document of fewer content lines than size stays as it is or, with short, loses them all if an
    earlier document holds the same lines and no more. Null and empty texts and rows without doc_id
    stay as they are. Rows that repeat a doc_id count as one document: they hold
    the same first occurrences and lose the same lines. Lines that stay keep their white space, and
    blank lines stay. Columns named n_lines or n_removed are replaced, others kept.
    """
    of, name = fresh_name(docs, "of", "starts")
    starts = covered_starts(docs.select("doc_id", "text"), size, short).select(F.col("doc_id").alias(of), F.col("starts").alias(name))
    joined = docs.join(starts, F.col("doc_id") == F.col(of), "left").drop(of)
    content, held = _content(F.col("text")), F.col(name)
    # rows of one doc_id may differ in length, so a short window's place must fit the row's
    fits = lambda n: F.filter(held, lambda s: (s >= 0) | (n == -s)) if short else held
    covered = lambda n: F.array_distinct(F.flatten(F.transform(fits(n), lambda s: F.sequence(F.greatest(s, F.lit(0)), F.when(s < 0, -s - 1).otherwise(s + (size - 1))))))
    out = F.transform(F.array(F.size(content)), covered)[0]
    gone = F.transform(F.array(content), lambda c: F.transform(out, lambda i: c[i]["at"]))[0]
    stay = F.transform(F.array(_lines(F.col("text"))), lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: ls[i]))[0]
    return joined.withColumns(
        {
            "n_lines": F.size(content).cast("long"),
            "n_removed": F.when(held.isNull(), 0).otherwise(F.size(out)).cast("long"),
            "text": F.when(held.isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")),
        }
    ).drop(name)


def clean_documents(docs: DataFrame) -> DataFrame:
    """docs without repeated passages, with the columns of docs; n_chars (if there) is the new
    length. A document that loses all its content goes, as it is a copy; short ones are compared as
    a whole."""
    names = {"n_lines": fresh_name(docs, "own_lines")[0], "n_removed": fresh_name(docs, "own_removed")[0]}
    aside = docs.withColumnsRenamed({k: v for k, v in names.items() if k in docs.columns})
    kept = dedup_lines(aside, short=True).where("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in names.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(1, len(s) + 1)) AS pos, unnest(s) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), c AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM l
), k AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM c WHERE t <> ''
), w AS (
  SELECT doc_id, i, t AS a, lead(t) OVER p AS b, lead(t, 2) OVER p AS d FROM k WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, d ORDER BY doc_id, i) AS n FROM w WHERE d IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM r WHERE n > 1
), g AS (
  SELECT k.doc_id, k.pos FROM k JOIN gone USING (doc_id, i)
)
SELECT l.doc_id, count(k.pos)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '')) AS text_sha256
FROM l LEFT JOIN k ON l.doc_id = k.doc_id AND l.pos = k.pos LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos
GROUP BY l.doc_id
"""
