"""Audit of how the sources of a language differ in words, over collapsed copies of texts.

Identical texts of a language are one row with the sources that hold it and how often; it is cut into words once,
and its counts are added to each source by their multiplicities, as is its weight to document frequencies. Sources
are then compared by sparse sums: what a word adds where one side or both lack it depends on that side's zero
share alone, so those parts come from counts of equal shares, and only words that both sources have are met by pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .collocations import scaled
from .common import load, remove_scratch, scratch_tables, written
from .shingles import _bytes_of, blocks

SCALE = (1000, 1000, 1000)
LEAST_DOCS, TOP_TERMS = 3, 200
BLOCK_BYTES, MOST_EXPANDED = 4_000_000, 1_000_000
#: Shares of words and sources that one task compares, about.
BLOCK_CELLS = 200_000
_LETTER, _LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER[65:91] += 32


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, held): each different text of a language once, with (source, m) of the sources that hold it.

    Texts are told apart by SHA-256. Multiplicities are counted before anything is gathered, so a text has one
    entry for each source whatever its copies. Nulls are ''.
    """
    base = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]).withColumn("h", F.unhex(F.sha2("text", 256)))
    counts = base.groupBy("lang", "h", "source").agg(F.count(F.lit(1)).alias("m"))
    held = counts.groupBy("lang", "h").agg(F.collect_list(F.struct("source", "m")).alias("held"))
    return base.groupBy("lang", "h").agg(F.first("text").alias("text")).join(held, ["lang", "h"]).drop("h")


def _reduced(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of whole numbers by key, exactly."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[heads], *(np.add.reduceat(v[order], heads) if len(heads) else v for v in values)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, cnt, docs) of collapsed texts, summed over as many blocks as give MOST_EXPANDED rows at
    most and in order, as neighbours alike take less room in a shuffle."""
    pending: list[pa.RecordBatch] = []
    waiting = 0
    for batch in _block_counts(batches):
        pending.append(batch)
        waiting += batch.num_rows
        if waiting >= MOST_EXPANDED:
            pending = _summed(pending)
            waiting = sum(b.num_rows for b in pending)
            if 2 * waiting > MOST_EXPANDED:
                yield from pending
                pending, waiting = [], 0
    if pending:
        yield from _summed(pending)


def _summed(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).group_by(["lang", "term", "source"], use_threads=False).aggregate([("cnt", "sum"), ("docs", "sum")])
    table = table.select(["lang", "source", "term", "cnt_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "cnt", "docs"])
    return table.sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")]).to_batches(max_chunksize=100_000)


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, cnt, docs) of each block of texts."""
    for batch in batches:
        for block in blocks(batch, "text", BLOCK_BYTES):
            raw, offsets = _bytes_of(block.column("text"))
            raw = _LOWER[raw]
            dark = _LETTER[raw]
            begin = dark.copy()
            begin[1:] &= ~dark[:-1]
            heads = offsets[:-1][offsets[:-1] < len(raw)]
            begin[heads] = dark[heads]
            first = np.flatnonzero(begin)
            letters = np.append(np.cumsum(dark)[first] - 1, dark.sum())  # words lie end to end once gaps are out
            words = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(letters.astype(np.int64)), pa.py_buffer(raw[dark])]).dictionary_encode()
            v = max(1, len(words.dictionary))
            text = np.searchsorted(offsets, first, "right") - 1
            pair, tf = _reduced(text * v + words.indices.to_numpy(), np.ones(len(first), np.int64))
            text, term = pair // v, pair % v

            held = block.column("held")
            begins = np.append(0, np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False)))
            flat = held.flatten()
            source, m = flat.field("source").dictionary_encode(), flat.field("m").to_numpy(zero_copy_only=False)
            lang = block.column("lang").dictionary_encode()
            n_sources = max(1, len(source.dictionary))
            group = np.repeat(lang.indices.to_numpy(), np.diff(begins)).astype(np.int64) * n_sources + source.indices.to_numpy()

            times = np.diff(begins)[text]  # sources of each text's words
            done = np.append(0, np.cumsum(times))
            i = 0
            while i < len(text):
                j = max(i + 1, int(np.searchsorted(done, done[i] + MOST_EXPANDED, "right")) - 1)
                each = np.repeat(np.arange(i, j), times[i:j])
                at = begins[text[each]] + np.arange(len(each)) - (done[each] - done[i])
                key, cnt, docs = _reduced(group[at] * v + term[each], tf[each] * m[at], m[at])
                g = key // v
                columns = [lang.dictionary.take(pa.array(g // n_sources)), source.dictionary.take(pa.array(g % n_sources)), words.dictionary.take(pa.array(key % v)).cast(pa.string()), pa.array(cnt), pa.array(docs)]
                yield pa.record_batch(columns, names=["lang", "source", "term", "cnt", "docs"])
                i = j


def kept_terms(texts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, cnt, all_cnt, head): occurrences of the terms that least_docs documents of the language
    have, in the source and in the language; head is 1 in one row of each term. texts as from collapsed.

    Counts are dealt out by term once: its sums by source and over all sources are made where it lies."""
    rows = texts.mapInArrow(_term_counts, "lang string, source string, term string, cnt long, docs long").repartition("lang", "term")
    counts = rows.groupBy("lang", "term", "source").agg(F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"all_cnt": F.sum("cnt").over(whole), "all_docs": F.sum("docs").over(whole), "least": F.min("source").over(whole)}).where(F.col("all_docs") >= least_docs)
    return counts.select("lang", "source", "term", "cnt", "all_cnt", (F.col("source") == F.col("least")).cast("long").alias("head"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), null if total is 0."""
    return 1 + scaled(count + 1, F.nullif(total, F.lit(0)), SCALE)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shared(table: pa.Table) -> pa.Table:
    """Of the terms that two sources both have, what they add to the pair over the parts for zero shares."""
    langs, names = table.column("lang").unique(), table.column("source").combine_chunks().dictionary_encode()
    n = max(1, len(names.dictionary))
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    source = names.indices.to_numpy().astype(np.int64)
    order = np.lexsort((source, term))
    term, source = term[order], source[order]
    p, zero = (table.column(c).to_numpy()[order] for c in ("p", "p_zero"))
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    waiting, d = 0, 1
    while d < len(term):
        left = np.flatnonzero(term[d:] == term[:-d])
        if not len(left):
            break
        for i, j in ((left, left + d), (left + d, left)):
            value = _gap(p[i], p[j]) - _gap(p[i], zero[j]) - _gap(zero[i], p[j]) + _gap(zero[i], zero[j])
            pending.append((source[i] * n + source[j], value))
        waiting, d = waiting + 2 * len(left), d + 1
        if waiting > MOST_EXPANDED:
            pending = [_reduced(*map(np.concatenate, zip(*pending, strict=True)))]
            waiting = len(pending[0][0])
    key, value = _reduced(*map(np.concatenate, zip(*pending, strict=True))) if pending else (np.zeros(0, np.int64),) * 2
    return pa.table({"lang": pa.array([langs[0].as_py()] * len(key), pa.string()), "source": names.dictionary.take(pa.array(key // n)), "item": names.dictionary.take(pa.array(key % n)), "value": pa.array(value, pa.int64())})


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each (lang, source) its distance from each other source of the
    language (part pair, all ranks) and its over-used terms against the language (part term, the first top_terms).

    Terms are runs of letters A-Z (lower-cased) and of characters beyond ASCII. Null languages, sources and texts are
    ''; a group without terms has zero counts; without kept terms distances are 0. Repeated rows count again, further
    columns are ignored, an empty table gives no rows. The pairs of sources are the result, so they grow with
    the square of a language's sources; words are never paired.
    """
    spark, before = docs.sparkSession, scratch_tables()
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    cells = written(kept_terms(collapsed(docs), least_docs), "cells")
    own = cells.groupBy("lang", "source").agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("held"), F.sum("head").alias("head"))
    tongue = cells.groupBy("lang").agg(F.sum("cnt").alias("all_n"), F.sum("head").alias("v"))
    stats = groups.join(own.drop("head"), ["lang", "source"], "left").join(tongue, "lang", "left").fillna(0, ["n", "held", "all_n", "v"])
    stats = written(stats.withColumn("p_zero", share(F.lit(0), F.col("n") + F.col("v"))), "sources")
    stats_at = scratch_tables()[-1]
    shares = cells.join(stats, ["lang", "source"]).withColumn("p", share(F.col("cnt"), F.col("n") + F.col("v")))
    shares = written(shares.select("lang", "source", "term", "p", "p_zero", share(F.col("all_cnt"), F.col("all_n") + F.col("v")).alias("q")), "shares")
    shares_at = scratch_tables()[-1]
    remove_scratch(spark, [p for p in scratch_tables() if p not in (*before, stats_at, shares_at)])

    n_blocks = max(1, shares.count() // BLOCK_CELLS)
    block = F.pmod(F.xxhash64("term"), F.lit(n_blocks)).alias("block")
    shared = shares.select("lang", block, "source", "term", "p", "p_zero").groupBy("lang", "block").applyInArrow(_shared, "lang string, source string, item string, value long")
    alike = shares.groupBy("lang", "source", "p", "p_zero").agg(F.count(F.lit(1)).alias("times"))
    other = stats.select("lang", F.col("source").alias("item"), F.col("p_zero").alias("q_zero"), F.col("held").alias("item_held"))
    apart = F.col("source") != F.col("item")
    met = alike.join(other, "lang").where(apart)  # shares of one source with the zero shares of the others
    one = met.select("lang", "source", "item", (F.col("times") * gap(F.col("p"), F.col("q_zero"))).alias("value"))
    two = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("times") * gap(F.col("q_zero"), F.col("p"))).alias("value"))
    absent = (F.col("v") - F.col("held") - F.col("item_held")) * gap(F.col("p_zero"), F.col("q_zero"))
    none = stats.join(other, "lang").where(apart).select("lang", "source", "item", F.coalesce(absent, F.lit(0)).alias("value"))
    pairs = none.unionByName(one).unionByName(two).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    first = terms.withColumn("rank", rank).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    return pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(first).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(load(spark, sf_dir, "documents").select("lang", "source", "text"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS all_cnt FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS cnt FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce(sum(cnt), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL
), l AS (
  SELECT lang, count(*) AS v, sum(all_cnt) AS n FROM k GROUP BY 1
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.cnt, 0) AS cnt,
         1 + 1000000000::HUGEINT * (coalesce(c.cnt, 0) + 1) // (g.n + l.v) AS p, 1 + 1000000000::HUGEINT * (k.all_cnt + 1) // (l.n + l.v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE cnt > 0 AND p > q
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r
)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""
