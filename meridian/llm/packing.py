"""Best-fit packing of tokenised documents into sequences by linear grouping.

Large lengths are sorted and cut into groups of equal cardinality, each rounded up to its largest
length; the few sizes left are packed by configurations from a linear programme (column
generation); actual documents take the places of their groups; small documents are then put into
the fullest sequence that still takes them. The driver plans over counts of lengths alone, of which
there are at most as many as a sequence has tokens, so the plan's size is bounded whatever the
input's; ranks within a length are counted in buckets and joined, so no task sees a whole length.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, written
from .tokens import byte_bpe

CAPACITY = 2048
GROUPS = 64
#: Pieces of at most the capacity divided by one of these are small.
SMALL_SHARES = (5, 3, 2)
BUCKET_ROWS = 20_000
PIECES = "spot long, doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, last_id: int = 0) -> DataFrame:
    """Pieces of the documents' ids, each followed by last_id; spot numbers the rows.

    Only documents longer than capacity are cut; the first piece has what is left over by whole
    ones. A null or empty text is one piece of last_id alone. Rows may repeat or have no doc_id.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, bpe = TaskContext.get().partitionId() << 40, byte_bpe(vocabulary)
        stop = last_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = bpe.ids(text.as_py()) + stop
                n, begin, piece = len(ids) // 4, 0, 0
                while begin < n:
                    end = min(n, begin + ((n - begin) % capacity or capacity))
                    out.append((spot, doc_id, piece, begin, end - begin, zlib.crc32(ids[4 * begin : 4 * end])))
                    spot, begin, piece = spot + 1, end, piece + 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, PIECES)


def best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Counts of the sizes of most value that fit together (unbounded knapsack)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    size, order = np.array(sizes), np.argsort(sizes)
    size, worth = size[order], values[order]
    for c in range(int(size[0]), capacity + 1):
        fits = int(np.searchsorted(size, c, "right"))
        got = best[c - size[:fits]] + worth[:fits]
        k = int(got.argmax())
        best[c], took[c] = (got[k], k) if got[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    counts, c = [0] * len(sizes), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[order[took[c]]] += 1
            c -= int(size[took[c]])
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 10_000) -> list[tuple[list[int], int]]:
    """(counts of each size, how often) that cover the demand, from the linear programme's basis
    rounded down and the rest packed largest first.

    Columns are made until none improves the programme. Should rounds of them not be enough, the plan
    still covers the demand, and a warning gives the factor within which it is of the optimum (the
    value of the best column left, as prices divided by it are feasible)."""
    n = len(sizes)
    if not n:
        return []
    need = np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(n))
        value, column = best_configuration(sizes, price, capacity)
        if value <= 1 + 1e-9:
            break
        level, step = np.linalg.solve(basis, need), np.linalg.solve(basis, np.array(column, float))
        ratio = np.where(step > 1e-9, np.maximum(level, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    else:
        logging.getLogger(__name__).warning("column generation stopped after %d columns, within a factor %.4f of the programme's optimum", rounds, value)
    level = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-9).astype(int)
    out = [([int(x) for x in basis[:, k]], int(level[k])) for k in range(n) if level[k] > 0]
    left = need.astype(int) - np.sum([np.array(p) * m for p, m in out], axis=0, dtype=int) if out else need.astype(int)
    order = sorted(range(n), key=lambda g: -sizes[g])
    while (left > 0).any():
        room, counts = capacity, [0] * n
        for g in order:
            counts[g] = int(max(0, min(left[g], room // sizes[g])))
            room -= counts[g] * sizes[g]
        times = max(1, min(int(left[g]) // c for g, c in enumerate(counts) if c))
        out.append((counts, times))
        left = left - np.array(counts) * times
    return out


def large_plan(lengths: dict[int, int], capacity: int, groups: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]], int]:
    """Places (length, first rank, end rank, first sequence), one for each sequence in turn; runs
    (room, first sequence, how many) of sequences that hold alike; and the number of sequences."""
    total, seen, size, count, own = sum(lengths.values()), 0, [], [], []
    last = -1
    for length in sorted(lengths, reverse=True):
        if (g := seen * groups // total) != last:
            size.append(length)
            count.append(0)
            own.append([])
            last = g
        own[-1].append((count[-1], length))  # longest first within the group
        count[-1] += lengths[length]
        seen += lengths[length]
    places, runs, rank, first = [], [], [0] * len(size), 0
    for counts, times in configurations(size, count, capacity):
        cuts, held = {0, times}, []
        for g, a in enumerate(counts):
            for _ in range(a):
                base = rank[g]
                rank[g] += times
                for k, (begin, length) in enumerate(own[g]):
                    end = own[g][k + 1][0] if k + 1 < len(own[g]) else count[g]
                    lo, hi = max(begin, base), min(end, base + times)
                    if lo < hi:
                        places.append((length, lo - begin, hi - begin, first + lo - base))
                        held.append((lo - base, hi - base, length))
                        cuts |= {lo - base, hi - base}
        points = sorted(cuts)
        for lo, hi in zip(points, points[1:], strict=False):
            used = sum(length for x, y, length in held if x <= lo and hi <= y)
            if used:
                runs.append((capacity - used, first + lo, hi - lo))
        first += times
    return places, runs, first


def small_plan(lengths: dict[int, int], alike: list[tuple[int, int, int]], first: int, capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Places as those of large_plan, by best fit, longest first; new sequences are numbered from
    first. Also the number of new sequences. Runs of sequences alike are planned as one."""
    runs: dict[int, list[tuple[int, int]]] = {}
    for room, begin, many in alike:
        runs.setdefault(room, []).append((begin, many))
    places, opened = [], 0
    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            room = next((r for r in range(length, capacity + 1) if runs.get(r)), None)
            if room is None:
                fresh = -(-left // (capacity // length))
                runs[capacity] = [(first + opened, fresh)]
                opened += fresh
                continue
            begin, many = runs[room].pop()
            took = min(many, left)
            if took < many:
                runs[room].append((begin + took, many - took))
            runs.setdefault(room - length, []).append((begin, took))
            places.append((length, rank, rank + took, begin))
            rank, left = rank + took, left - took
    return places, opened


def plan(lengths: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int]]:
    """Places for pieces counted by length. Of the shares of the capacity up to which a piece is
    small, that with the fewest sequences is taken."""
    best: tuple[int, list] | None = None
    for share in SMALL_SHARES:
        limit = capacity // share
        places, runs, used = large_plan({k: n for k, n in lengths.items() if k > limit}, capacity, groups)
        more, opened = small_plan({k: n for k, n in lengths.items() if k <= limit}, runs, used, capacity)
        total = sum(many for _, _, many in runs) + opened
        if best is None or total < best[0]:
            best = total, places + more
    return best[1]


def ranked(rows: DataFrame, key: str, spot: str, n_rows: int, into: str) -> DataFrame:
    """rows with their rank (from 0) among those of equal key, counted in buckets of spots."""
    buckets = max(1, n_rows // BUCKET_ROWS)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(spot), F.lit(buckets)))
    counts = rows.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_n")).drop("_n")
    within = rows.withColumn("_within", F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(spot)) - 1)
    return within.join(before, [key, "_bucket"]).withColumn(into, F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within")


def _counts(rows: DataFrame, key: str) -> dict[int, int]:
    """Rows by a key of at most a capacity's number of values."""
    return {r[0]: r[1] for r in rows.groupBy(key).count().collect()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """pieces (see tokenised) with sequence_id and offset. An empty table gives an empty one."""
    lengths = _counts(pieces, "length")
    places = pieces.sparkSession.createDataFrame(plan(lengths, capacity, groups), "l long, lo long, hi long, first long")
    places = F.broadcast(places)  # its rows are bounded by the capacity, not by the input
    at = ranked(pieces, "length", "spot", sum(lengths.values()), "_rank")
    put = at.join(places, (F.col("length") == F.col("l")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    put = put.select(*pieces.columns, (F.col("first") + F.col("_rank") - F.col("lo")).alias("sequence_id"))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "spot").rowsBetween(Window.unboundedPreceding, 0)
    return put.withColumn("offset", F.sum("length").over(inside) - F.col("length"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs."""
    pieces = written(tokenised(docs, capacity, vocabulary), "pieces")
    return pack(pieces, capacity, groups).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
