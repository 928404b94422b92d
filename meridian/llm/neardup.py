"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full shingle sets
and union of the confirmed links.

Documents of equal sets are one class, so copies cost nothing further. Buckets do not emit their
pairs: each member is held against its bucket's leader, and confirmed links merge classes into
components. Only buckets that still hold several components go on: small ones list their remaining
pairs, larger ones are dealt out as pairs of blocks, where a task counts all intersections by one
matrix product and returns a spanning forest of the links. Blocks are of bounded bytes; a component
with much text has blocks of its own, which are not held against one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_name, load, written
from .graph import components, local_roots
from .shingles import mix, parts, shingle_sets

#: Bands and ranks in each: a pair at similarity 0.8 is missed with probability (1 - 0.8^6)^42 = 3e-6.
BANDS, ROWS = 42, 6
#: Buckets of at most SMALL members list their pairs; larger ones are cut into blocks of about BLOCK
#: members or BLOCK_BYTES of text, whichever is less.
SMALL, BLOCK, BLOCK_BYTES = 8, 256, 4_000_000
#: Signatures are made of about so many bytes of texts at once: short texts stay to the last of the 252 steps,
#: and each step keeps four bytes a shingle, so this bounds a Python worker's memory (about 150 MB).
SKETCH_BYTES = 1_000_000
_GOLDEN = 0x9E3779B97F4A7C15
_BAND = np.random.default_rng(11).integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)


def superminhash(hashes: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Signatures (texts x size) of sets given one after another.

    Step j draws for each element a fraction r and a swap partner of its own random permutation;
    place p_j of the signature gets the minimum of j + r. A text takes part in step j only while its
    largest value is above j, as later steps can't lower the others.
    """
    n = len(bounds) - 1
    sig = np.full((n, size), np.uint64(size) << np.uint64(32), np.uint64)
    flat, doc = sig.reshape(-1), np.repeat(np.arange(n), np.diff(bounds))
    x, swaps = hashes, []
    for j in range(size):
        if len(x) == 0:
            break
        draw = mix(x + np.uint64((j + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF))
        k = (np.uint64(j) + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(size - j) >> np.uint64(32))).astype(np.int32)
        place = k.copy()
        for i in range(j - 1, -1, -1):  # where the earlier swaps have put place k's entry
            place[swaps[i] == place] = i
        np.minimum.at(flat, doc * size + place, (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
        swaps.append(k)
        live = (sig.max(axis=1) > (np.uint64(j + 1) << np.uint64(32)))[doc]
        if not live.all():
            x, doc, swaps = x[live], doc[live], [s[live] for s in swaps]
    return sig


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark (a hash of the text), bytes, n_shingles, digest of the set, and a hash for each
    band (null for empty sets)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", SKETCH_BYTES):
                sets, at = shingle_sets(part.column("text"), width)
                sig = superminhash(sets, at, BANDS * ROWS).reshape(-1, BANDS, ROWS)
                bands = mix((sig * _BAND).sum(axis=2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                raw, n = sets.view(np.uint8), np.diff(at)
                digest = [xxhash.xxh3_128_digest(raw[8 * i : 8 * j].tobytes()) if j > i else None for i, j in zip(at[:-1], at[1:], strict=True)]
                held = np.repeat(n > 0, BANDS)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32))
                yield pa.record_batch([*[part.column(c) for c in ("doc_id", "mark", "bytes")], pa.array(n), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1)[held]))], names=["doc_id", "mark", "bytes", "n_shingles", "digest", "bands"])

    text = F.col("text").cast("string")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark(text).alias("mark"), F.octet_length(text).cast("long").alias("bytes"), text.alias("text"))
    return marked.mapInArrow(rows, "doc_id long, mark long, bytes long, n_shingles long, digest binary, bands array<long>")


def _mark(text: Column) -> Column:
    """Tells the texts of rows of one doc_id apart."""
    return F.xxhash64(text)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets have 100 * intersection >= percent * union. pairs has
    the texts' marks mark_a and mark_b as well, texts one row (id, mark, text) for each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text_a", 2_000_000):
                xs, xat = shingle_sets(part.column("text_a"), width)
                ys, yat = shingle_sets(part.column("text_b"), width)
                keep = []
                for i in range(len(part)):
                    both = np.concatenate([xs[xat[i] : xat[i + 1]], ys[yat[i] : yat[i + 1]]])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * shared >= percent * (len(both) - shared))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs
    for side in ("a", "b"):
        full = full.hint("merge").join(texts.select(F.col("id").alias(side), F.col("mark").alias(f"mark_{side}"), F.col("text").alias(f"text_{side}")), [side, f"mark_{side}"])
    return full.select("a", "b", "text_a", "text_b").mapInArrow(rows, "a long, b long")


def _intersections(sets: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections of the first n sets with the others (with all, if n is all)."""
    count = len(at) - 1
    owner = np.repeat(np.arange(count), np.diff(at))
    _, ids, held = np.unique(sets, return_inverse=True, return_counts=True)
    common = held[ids] > 1
    _, ids = np.unique(ids[common], return_inverse=True)
    owner = owner[common]
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    begin = 0 if n == count else n
    out = np.zeros((n, count - begin), np.int64)
    for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, 16_384):
        i, j = np.searchsorted(ids, [low, low + 16_384])
        rows = np.zeros((count, 16_384), np.float32)
        rows[owner[i:j], ids[i:j] - low] = 1
        out += (rows[:n] @ rows[begin:].T).astype(np.int64)  # at most 16,384 a product, exact in single precision
    return out


def _block_links(width: int, percent: int):
    def links(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["side", "rep", "mark"], ignore_index=True)
        n = int((block["side"] == 0).sum())
        if n == 0 or len(block) < 2:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        sets, at = shingle_sets(pa.array(block["text"], pa.large_string()), width)
        sizes = np.diff(at)
        shared = _intersections(sets, at, n)
        begin = 0 if n == len(block) else n
        union = sizes[:n, None] + sizes[None, begin:] - shared
        comp = block["comp"].to_numpy()
        i, j = np.nonzero((100 * shared >= percent * union) & (shared > 0) & (comp[:n, None] != comp[None, begin:]))
        reps = block["rep"].to_numpy()
        order = np.argsort(reps, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = reps[order][local_roots(place[np.stack([i, j + begin], axis=1)], len(block))[place]]
        return pd.DataFrame({"a": reps, "b": root})[reps != root]

    return links


def dealt_blocks(members: DataFrame) -> DataFrame:
    """members (key, rep, mark, bytes, comp) with the block pairs (i, j) that each takes part in, and
    its side there.

    Of a bucket, components of less text than a block share the first blocks, the others have blocks
    of their own, of which no two of one component are dealt. Blocks are numbered from sums over
    components, so no task sees a whole bucket."""
    weight = F.greatest(F.col("bytes") / BLOCK_BYTES, F.lit(1 / BLOCK))
    sizes = members.groupBy("key", "comp").agg(F.sum(weight).alias("w"))
    shared = sizes.groupBy("key").agg(F.ceil(F.sum(F.when(F.col("w") < 1, F.col("w")).otherwise(0.0))).cast("int").alias("shared"), F.sum(F.when(F.col("w") >= 1, F.ceil("w")).otherwise(0)).cast("int").alias("single"))
    own = sizes.where("w >= 1").withColumn("n", F.ceil("w").cast("int"))
    own = own.withColumn("low", (F.sum("n").over(Window.partitionBy("key").orderBy("comp")) - F.col("n")).cast("int")).select("key", "comp", "n", "low")
    placed = members.select("key", "rep", "mark", "comp").join(shared, "key").join(own, ["key", "comp"], "left")
    mixed = F.pmod(F.xxhash64("comp"), F.greatest("shared", F.lit(1))).cast("int")
    first = F.col("shared") + F.col("low")
    at = F.when(F.col("n").isNull(), mixed).otherwise(first + F.pmod(F.xxhash64("rep", "mark"), F.col("n")).cast("int"))
    placed = placed.withColumns({"own": at, "first": first})
    others = F.filter(F.sequence(F.lit(0), F.col("shared") + F.col("single") - 1), lambda k: F.col("n").isNull() | (k < F.col("first")) | (k >= F.col("first") + F.col("n")))
    turns = F.transform(others, lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), (F.col("own") > k).cast("int").alias("side")))
    return placed.select("key", "rep", "mark", "comp", F.inline(turns))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), kept.

    One row for each row of docs; its further columns are ignored. Null and empty texts have no
    shingles and no links. Rows with a null doc_id are linked with nothing: component_id null, kept.
    Rows that repeat a doc_id share its component; if their texts differ, each of them is compared.
    """
    made = written(sketch(docs, width), "sketch")
    usable = made.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = F.min(F.struct("doc_id", "mark", "bytes"))
    classes = usable.groupBy("digest", "n_shingles").agg(first.alias("first"), F.any_value("bands").alias("bands"))
    classes = written(classes.select("digest", "n_shingles", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark"), F.col("first.bytes").alias("bytes"), "bands"), "classes")
    rows = classes.select("rep", "mark", "bytes", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    fit = f"100 * least(n, ln) >= {percent} * greatest(n, ln)"
    lead = rows.groupBy("key").agg(F.min(F.struct("rep", "mark", "n")).alias("lead"), F.count(F.lit(1)).alias("held")).where("held > 1")
    crowd = written(rows.join(lead.select("key", F.col("lead.rep").alias("lead"), F.col("lead.mark").alias("lead_mark"), F.col("lead.n").alias("ln")), "key"), "crowd")
    needed = crowd.select(F.col("rep").alias("id"), "mark").distinct()
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), _mark(text).alias("mark"), text.alias("text"))
    texts = written(texts.hint("merge").join(needed, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"]), "texts")
    tested = written(crowd.where("rep <> lead").where(fit).select(F.col("rep").alias("a"), F.col("mark").alias("mark_a"), F.col("lead").alias("b"), F.col("lead_mark").alias("mark_b")).distinct(), "pairs")
    several = usable.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    same = usable.join(several, "doc_id", "left_semi").join(classes.select("digest", "n_shingles", "rep"), ["digest", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = written(confirmed(tested, texts, width, percent).unionByName(same), "links")
    found = written(components(links), "components")
    named = crowd.select("key", "rep", "mark", "bytes", "n").join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", "mark", "bytes", "n", F.coalesce("component", "rep").alias("comp"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("held")).where("x < y").select("key", "held")
    left = written(named.join(mixed, "key"), "mixed")
    few = left.where(F.col("held") <= SMALL)
    other = few.select("key", F.col("rep").alias("b"), F.col("mark").alias("mark_b"), F.col("n").alias("ln"), F.col("comp").alias("lc"))
    pairs = few.join(other, "key").where("comp <> lc AND rep > b").where(fit).select(F.col("rep").alias("a"), F.col("mark").alias("mark_a"), "b", "mark_b").distinct()
    pairs = written(pairs.join(tested, ["a", "mark_a", "b", "mark_b"], "left_anti"), "pairs")
    dealt = dealt_blocks(left.where(F.col("held") > SMALL)).join(texts.withColumnRenamed("id", "rep"), ["rep", "mark"])
    forest = dealt.groupBy("key", "i", "j").applyInPandas(_block_links(width, percent), "a long, b long")
    links = links.unionByName(written(confirmed(pairs, texts, width, percent).unionByName(forest), "links"))
    found = written(components(links), "components")
    named = classes.select("digest", F.col("n_shingles").alias("_n"), "rep").join(found, F.col("rep") == F.col("node"), "left").select("digest", "_n", F.coalesce("component", "rep").alias("comp"))
    out = made.drop("bands").join(named, (made["digest"] == named["digest"]) & (made["n_shingles"] == named["_n"]), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near duplicates: of each component the document with the smallest doc_id.

    Repeated rows of a document that stays are taken as that document and stay too."""
    (name,) = fresh_name(docs, "gone")
    gone = near_duplicates(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), width=4, percent=80)
