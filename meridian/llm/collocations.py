"""Phrase collocations by Rabin-Karp fingerprints.

Prefix polynomials give the fingerprint of every run of one to four words of a block of texts in a few array
steps. A block's equal runs are counted (and told apart by their words where fingerprints agree by chance), and one
entry for each different run, its fingerprint and count, is shuffled in packed parts by ranges of the fingerprint; its
place among the block's entries, which are made the same each time, is the pointer to an occurrence. Where a
fingerprint's counts reach the least frequency, the places go back to their blocks as bits, the words are taken from the
texts there, and counts are added by the words themselves: runs that share a fingerprint part again, and no other phrase
is ever made a string. The rest is joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, remove_scratch, scratch_tables, written
from .shingles import _bytes_of, blocks, mix

LONGEST, LEAST, TOP = 4, 30, 2000
#: A longer candidate with so many hundredths of a candidate's occurrences takes its place.
SWALLOWED_PERCENT = 80
#: Bytes of the texts that a task holds at a time, and entries of a range of fingerprints.
BLOCK_BYTES, RANGE_ENTRIES = 4_000_000, 1 << 20
CUTS = r"[\x20\x09.,;:!?\x0A-\x0D]+"
_GAP, _END, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_GAP[[9, 32]] = True
_END[[*b".,;:!?", 10, 11, 12, 13]] = True
_LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
#: What is sent of an entry, as whole numbers of these sizes: fingerprint (as the step from the one before) and count.
FIELDS = ("<u8", "<u4")


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length, byte plane after byte plane, compressed."""
    planes = [c.astype(kind).view(np.uint8).reshape(len(c), -1).T.tobytes() for c, kind in zip(columns, FIELDS, strict=True)]
    return pa.Codec("zstd", compression_level=1).compress(b"".join(planes), asbytes=True)


def _unpack(body: bytes, n: int) -> list[np.ndarray]:
    widths = [np.dtype(kind).itemsize for kind in FIELDS]
    raw = np.frombuffer(pa.Codec("zstd").decompress(body, n * sum(widths)), np.uint8)
    at = np.cumsum([0, *widths]) * n
    return [np.ascontiguousarray(raw[i:j].reshape(w, n).T).view(kind).ravel() for i, j, w, kind in zip(at[:-1], at[1:], widths, FIELDS, strict=True)]


@dataclass
class Entries:
    """The different runs of words of some texts, by fingerprint: an occurrence of each begins at word `at`. Those of one
    entry are equal in words and language; a run may have two entries, where another run of its fingerprint comes between."""

    mark: np.ndarray
    count: np.ndarray
    size: np.ndarray
    at: np.ndarray
    word: np.ndarray  # of each occurrence, its place in words
    words: pa.Array
    lang: np.ndarray  # of each occurrence, the place of its text's language in langs
    langs: pa.Array

    def bounds(self, bits: int, range_bits: int) -> np.ndarray:
        """Where the entries of each range of fingerprints begin, and their number."""
        starts = np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(bits - range_bits)
        return np.concatenate([[0], np.searchsorted(self.mark, starts), [len(self.mark)]])

    def phrases(self, wanted: np.ndarray) -> pa.Table:
        """(lang, mark, phrase, count) of the wanted entries."""
        out = []
        for n in range(1, LONGEST + 1):
            k = wanted[self.size[wanted] == n]
            parts = [self.words.take(pa.array(self.word[self.at[k] + j])).cast(pa.large_string()) for j in range(n)]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
            out.append(pa.table({"lang": self.langs.take(pa.array(self.lang[self.at[k]])), "mark": pa.array(self.mark[k]), "phrase": phrase, "count": pa.array(self.count[k].astype(np.uint32))}))
        return pa.concat_tables(out)


def entries_of(texts: pa.Array, langs: pa.Array, bits: int) -> Entries:
    """The entries of runs of 1 to LONGEST words within pieces of texts, made the same each time."""
    raw, offsets = _bytes_of(texts)
    raw = _LOWER[raw]
    end = _END[raw]
    dark = ~(end | _GAP[raw])
    begin = dark.copy()
    begin[1:] &= ~dark[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    begin[heads] = dark[heads]
    first = np.flatnonzero(begin)
    text = np.searchsorted(offsets, first, "right") - 1
    piece = np.cumsum(end)[first] + text
    letters = np.append(np.cumsum(dark)[first] - 1, dark.sum())  # words lie end to end once gaps are out
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(letters.astype(np.int64)), pa.py_buffer(raw[dark])]).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w.as_py()) for w in words.dictionary], np.uint64)
    word = np.concatenate([words.indices.to_numpy(), np.full(LONGEST, -1, np.int32)])
    named = langs.dictionary_encode()
    lang = named.indices.to_numpy()[text]
    salts = np.array([xxhash.xxh3_64_intdigest(x.as_py()) for x in named.dictionary], np.uint64)

    m = len(first)
    power = np.cumprod(np.append(np.uint64(1), np.full(m, BASE, np.uint64)))
    back = np.cumprod(np.append(np.uint64(1), np.full(m, pow(BASE, -1, 1 << 64), np.uint64)))
    prefix = np.append(np.uint64(0), np.cumsum(hashes[word[:m]] * power[:m]))
    marks, at, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)]
    for n in range(1, min(LONGEST, m) + 1):
        run = np.flatnonzero(piece[: m - n + 1] == piece[n - 1 :])
        marks.append(mix((prefix[run + n] - prefix[run]) * back[run] + salts[lang[run]] + np.uint64(n)) >> np.uint64(64 - bits))
        at.append(run.astype(np.int32))
        size.append(np.full(len(run), n, np.uint8))
    mark, at, size = np.concatenate(marks), np.concatenate(at), np.concatenate(size)
    del marks, prefix, power, back
    order = np.argsort(mark, kind="stable")
    mark, at, size = mark[order], at[order], size[order]
    new = np.ones(len(mark), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (size[1:] != size[:-1]) | (lang[at[1:]] != lang[at[:-1]])
    for k in range(LONGEST):
        new[1:] |= (word[at[1:] + k] != word[at[:-1] + k]) & (size[1:] > k)
    starts = np.flatnonzero(new)
    return Entries(mark[starts], np.diff(np.append(starts, len(mark))), size[starts], at[starts], word, words.dictionary, lang, named.dictionary)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a number, and that of the first row of their block."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for block in blocks(batch, "text", BLOCK_BYTES):
            n = len(block)
            yield pa.record_batch([pa.array(np.arange(row, row + n)), pa.array(np.full(n, row)), block.column("lang"), block.column("text")], names=["row", "block", "lang", "text"])
            row += n


def _fingerprints(bits: int, range_bits: int):
    """Packed entries of each run of rows of a block (one, unless a block is read in parts) and range of fingerprints."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "row"))
            cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else np.zeros(1, np.int64)
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                found = entries_of(batch.column("text").slice(i, j - i), batch.column("lang").slice(i, j - i), bits)
                at, step = found.bounds(bits, range_bits), np.append(found.mark[:1], np.diff(found.mark))
                held = np.flatnonzero(np.diff(at))
                step[at[held]] = found.mark[at[held]]
                bodies = [_pack([step[at[k] : at[k + 1]], found.count[at[k] : at[k + 1]]]) for k in held]
                columns = [pa.array(held), pa.array(np.full(len(held), block[i])), pa.array(np.full(len(held), row[i])), pa.array(np.diff(at)[held].astype(np.int32)), pa.array(bodies, pa.binary())]
                yield pa.record_batch(columns, names=["range", "block", "run", "n", "body"])

    return rows


def _frequent(least: int):
    """For each part of a range, bits of the entries whose fingerprint has least occurrences or more in all."""

    def rows(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        parts = [_unpack(body, n) for n, body in zip(sizes, table.column("body").to_pylist(), strict=True)]
        mark = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        count = np.concatenate([p[1] for p in parts]).astype(np.int64)
        order = np.argsort(mark)
        heads = np.flatnonzero(np.append(True, np.diff(mark[order]) != 0))
        total = np.add.reduceat(count[order], heads)
        wanted = np.zeros(len(mark), bool)
        wanted[order] = np.repeat(total >= least, np.diff(np.append(heads, len(mark))))
        at = np.cumsum([0, *sizes])
        bits = [np.packbits(wanted[i:j]).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        return table.select(["range", "block", "run", "n"]).append_column("bits", pa.array(bits, pa.binary()))

    return rows


def _words_of(bits: int, range_bits: int):
    """The words of a block's frequent entries, with their counts: packed by language and range, in order."""

    def rows(texts: pa.Table, flags: pa.Table) -> pa.Table:
        texts, flags = texts.sort_by("row").combine_chunks(), flags.sort_by([("run", "ascending"), ("range", "ascending")])
        row, run = texts.column("row").to_numpy(), flags.column("run").to_numpy()
        starts = np.unique(run)
        ends = np.append(np.searchsorted(row, starts[1:]), len(row))
        out = []
        for start, i, j in zip(starts, np.searchsorted(row, starts).tolist(), ends.tolist(), strict=True):
            found = entries_of(texts.column("text").slice(i, j - i).combine_chunks(), texts.column("lang").slice(i, j - i).combine_chunks(), bits)
            own = flags.slice(int(np.searchsorted(run, start)), int((run == start).sum()))
            sizes = own.column("n").to_pylist()
            if sum(sizes) != len(found.mark):
                raise ValueError("a block's entries changed between two readings")
            wanted = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(own.column("bits").to_pylist(), sizes, strict=True)])
            out.append(found.phrases(np.flatnonzero(wanted)))
        if not out:
            return pa.table({k: pa.array([], t) for k, t in zip(PACKED, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)})
        made = pa.concat_tables(out)
        place = pa.array((made.column("mark").to_numpy() >> np.uint64(bits - range_bits)).astype(np.int64))
        made = made.append_column("range", place).sort_by([("lang", "ascending"), ("range", "ascending"), ("phrase", "ascending")]).combine_chunks()
        lang, place = made.column("lang").combine_chunks().dictionary_encode(), made.column("range").to_numpy()
        code = lang.indices.to_numpy()
        cuts = np.concatenate([np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (code[1:] != code[:-1]))), [len(place)]]) if len(place) else np.zeros(1, np.int64)
        phrases, counts = made.column("phrase").to_pylist(), made.column("count").to_numpy()
        raw = [counts[i:j].view(np.uint8).reshape(-1, 4).T.tobytes() + "\n".join(phrases[i:j]).encode() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        codec = pa.Codec("zstd", compression_level=3)
        columns = [lang.dictionary.take(pa.array(code[cuts[:-1]])), pa.array(place[cuts[:-1]]), pa.array(np.diff(cuts).astype(np.int32)), pa.array([len(r) for r in raw], pa.int32()), pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary())]
        return pa.table(columns, names=list(PACKED))

    return rows


PACKED = ("lang", "range", "n", "size", "body")


def _added(least: int):
    """Counts of a language's phrases of one range, by their words; those with least occurrences or more."""

    def rows(table: pa.Table) -> pa.Table:
        phrases: list[str] = []
        counts = []
        for n, size, body in zip(*(table.column(c).to_pylist() for c in ("n", "size", "body")), strict=True):
            raw = pa.Codec("zstd").decompress(body, size, asbytes=True)
            counts.append(np.ascontiguousarray(np.frombuffer(raw[: 4 * n], np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64))
            phrases += raw[4 * n :].decode().split("\n")
        found = pa.table({"phrase": pa.array(phrases, pa.string()), "count": np.concatenate(counts)}).group_by("phrase").aggregate([("count", "sum")])
        found = found.filter(pc.greater_equal(found.column("count_sum"), least))
        sizes = pc.add(pc.count_substring(found.column("phrase"), " "), pa.scalar(1, pa.int32()))
        lang = pa.array([table.column("lang")[0].as_py()] * len(found), pa.string())
        return pa.table({"lang": lang, "phrase": found.column("phrase"), "size": sizes.cast(pa.int32()), "f": found.column("count_sum").cast(pa.int64())})

    return rows


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of runs of 1 to 4 words with f >= least occurrences, and (lang, n) words of a language.

    Both are written tables. Null languages are 'und'; null and empty texts have no words.
    """
    text = F.col("text").cast("string")
    base = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text")).where("text <> ''")
    base = written(base.mapInArrow(_numbered, "row long, block long, lang string, text string"), "texts")  # rows are numbered once and for all
    rows_at = scratch_tables()[-1]
    totals = written(base.groupBy("lang").agg(F.sum(F.size(F.array_remove(F.split("text", CUTS), ""))).alias("n")), "words")
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    range_bits = max(0, math.ceil(math.log2((LONGEST * total + 1) / RANGE_ENTRIES)))
    bits = min(64, max(range_bits, math.ceil(math.log2(LONGEST * total + 1)) + 2))  # chance agreements with a frequent run cost a look at the text
    packed = base.mapInArrow(_fingerprints(bits, range_bits), "range long, block long, run long, n int, body binary")
    flags = packed.groupBy("range").applyInArrow(_frequent(least), "range long, block long, run long, n int, bits binary")
    pairs = base.groupBy("block").cogroup(flags.groupBy("block"))
    cut = pairs.applyInArrow(_words_of(bits, range_bits), "lang string, range long, n int, size int, body binary")
    counts = written(cut.groupBy("lang", "range").applyInArrow(_added(least), "lang string, phrase string, size int, f long"), "phrases")
    remove_scratch(docs.sparkSession, [rows_at])
    return counts, totals


def scaled(a: Column, b: Column, steps: tuple[int, ...]) -> Column:
    """floor(a * product of steps / b) for 0 <= a <= b, by long division: no product passes 64 bits while
    b times the largest step does not."""
    state = F.struct(F.lit(0).cast("long").alias("q"), a.cast("long").alias("r"))
    step = lambda s, m: F.struct((s["q"] * m + _quotient(s["r"] * m, b)).alias("q"), (s["r"] * m % b).alias("r"))
    return F.aggregate(F.array(*[F.lit(m).cast("long") for m in steps]), state, step, lambda s: s["q"])


def _quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to 4 words by score.

    A phrase is scored at its weakest cut (l occurrences before it, r after it: 2,000,000 a / (l + r)) and left
    out where a longer one has SWALLOWED_PERCENT of its occurrences. Repeated rows count again; further columns are ignored;
    without a frequent phrase, as for an empty table, there are no rows.
    """
    counts, totals = phrase_counts(docs, least)
    found = counts.where("size > 1").withColumn("w", F.split("phrase", " ", -1))
    join = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    cut = found.select("lang", "phrase", "size", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("before"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("after"))
    left = counts.select("lang", F.col("phrase").alias("before"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("after"), F.col("f").alias("r"))
    cut = cut.join(left, ["lang", "before"]).join(right, ["lang", "after"])
    weakest = F.min(F.struct(scaled(F.col("a"), F.col("l") + F.col("r"), (1000, 1000, 2)).alias("score"), "k", "l", "r"))
    scored = cut.groupBy("lang", "phrase", "a").agg(weakest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    sizes = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.struct(i.alias("i"), n.alias("n")))))
    inner = found.where("size > 2").select("lang", "f", "w", F.inline(sizes)).select("lang", "f", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("longer") >= SWALLOWED_PERCENT * F.col("a"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return first.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t
), g AS (
  SELECT lang, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS phrase FROM p, range(1, 5) AS s(n)
), f AS (
  SELECT lang, n AS size, phrase, count(*) AS f FROM g GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY 1
), c AS (
  SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE f >= 30 AND size > 1
), k AS (
  SELECT lang, phrase, a, w, size, unnest(range(1, size)) AS k FROM c
), s AS (
  SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f + r.f))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1 : k.size], ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), o AS (
  SELECT DISTINCT x.lang, x.phrase FROM c x JOIN (SELECT lang, a, size, n, unnest(list_transform(range(1, size - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS phrase FROM c, range(2, 4) AS s(n) WHERE n < size) y
  ON x.lang = y.lang AND x.phrase = y.phrase WHERE 100 * y.a >= 80 * x.a
), z AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN o USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN total USING (lang) WHERE rank <= 2000
"""
