"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, union of links.

Vectors of one label and equal components are one class. Vectors of one length and label form a
node; a large node is parted into the cells of a spherical k-means of its own, and large cells once
more, so cells grow in number with the rows. A class lives in the cell of its nearest centroid and
also visits every cell with a smaller number whose bounding hyperplane is within the chord of the
threshold, so no linked pair is missed, wherever the cells' borders run. A node whose cells would be
visited so often that parting saves nothing stays whole. Cells are cut into blocks; a task
multiplies two blocks, counts each vector's links and returns a spanning forest of them, never the
pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, written
from .graph import components, local_roots

#: The centroids of a node are fitted on about so many of its vectors (those of least hash); every vector
#: is assigned. A node has at most CHILDREN cells, each of which may be parted again (LEVELS times in all).
SAMPLE, CHILDREN, LEVELS = 8_192, 256, 2
CELL_ROWS = 4_000
#: Parting a node must save at least this share of its products, as counted on the sample.
GAIN = 0.5
#: A task holds at most so many numbers of a block, and at most BLOCK rows.
BLOCK, BLOCK_NUMBERS, SLICE = 4_096, 4_000_000, 1_024
SLACK = 1e-6
NODE = ["size", "label", "cell"]
PLACED = "rep long, label long, mult long, size int, cell long, mask int, embedding array<{}>"


def unit_rows(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.array(vectors, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit rows; an empty cell takes a row far from its centroid."""
    k = min(k, len(x))
    centroids = x[np.sort(np.random.default_rng(seed).choice(len(x), k, replace=False))]
    for _ in range(rounds):
        nearest = x @ centroids.T
        cell = nearest.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1)
        worst = iter(np.argsort(nearest.max(axis=1)))
        for j in np.flatnonzero(norm < 1e-12):
            sums[j], norm[j] = x[next(worst)], 1.0
        centroids = sums / norm[:, None]
    return centroids


def _visits(near: np.ndarray, home: np.ndarray, centroids: np.ndarray, threshold: float) -> np.ndarray:
    """Which cells each row visits: near holds its products with the centroids, home its own cell."""
    gap = near[np.arange(len(near)), home][:, None] - near
    # the distance to the plane between two centroids is the gap over their distance
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    chord = math.sqrt(2 - 2 * threshold) + SLACK
    return (gap <= chord * apart[home]) & (np.arange(len(centroids)) < home[:, None])


def _fitted(threshold: float, cell_rows: int, gain: float, children: int):
    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        """The centroids of a node's cells; none where cells would save too little."""
        x = unit_rows(list(sample["embedding"]))
        centroids = spherical_kmeans(x, max(1, min(children, int(sample["n_home"].iloc[0]) // cell_rows, len(x) // 8)))
        near = x @ centroids.T
        home = near.argmax(axis=1)
        own = np.bincount(home, minlength=len(centroids)).astype(float)
        guests = _visits(near, home, centroids, threshold).sum(axis=0)
        if len(centroids) < 2 or float(own @ (own + 2 * guests)) > gain * len(x) ** 2:
            centroids = centroids[:0]
        head = {c: [sample[c].iloc[0]] * len(centroids) for c in NODE}
        return pd.DataFrame({**head, "child": np.arange(len(centroids)), "centroid": pd.Series(list(centroids), dtype=object)})

    return fit


def _assigned(threshold: float, level: int, children: int):
    def assign(rows: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        """A row for each class and cell: its own, and those with smaller numbers it visits (whose
        bit of this level is then set in mask)."""
        rows = rows[[c.split()[0] for c in PLACED.split(", ")]]
        if not len(rows) or len(cells) < 2:
            return rows.assign(cell=rows["cell"] * children)
        centroids = np.array(list(cells.sort_values("child")["centroid"]))
        near = unit_rows(list(rows["embedding"])) @ centroids.T
        home = near.argmax(axis=1)
        i, j = np.nonzero(_visits(near, home, centroids, threshold))
        at = np.concatenate([np.arange(len(rows)), i])
        out = rows.iloc[at]
        cell = out["cell"].to_numpy() * children + np.concatenate([home, j])
        return out.assign(cell=cell, mask=out["mask"].to_numpy() | np.where(np.arange(len(at)) < len(rows), 0, 1 << level).astype(np.int32))

    return assign


def parted(rows: DataFrame, level: int, threshold: float, cell_rows: int, gain: float) -> DataFrame:
    """rows (see PLACED) with the large nodes parted into cells. Nodes are dealt out in parts of
    bounded size, and the centroids (bounded for each node) to each of its parts."""
    counts = rows.groupBy(*NODE).agg(F.count_if(F.col("mask") == 0).alias("n_home"), F.count(F.lit(1)).alias("n")).where(F.col("n_home") >= 2 * cell_rows)
    parts = F.greatest(F.ceil(F.col("n") * F.col("size") / BLOCK_NUMBERS), F.ceil(F.col("n") / (4 * BLOCK))).cast("int")
    big = written(counts.withColumn("parts", parts), "nodes")
    if big.isEmpty():
        return rows.withColumn("cell", F.col("cell") * CHILDREN)
    share = F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(1 << 30)) * F.col("n_home") < SAMPLE * (1 << 30)
    sample = rows.where("mask = 0").join(big, NODE).where(share).select(*NODE, "n_home", F.col("embedding").cast("array<double>").alias("embedding"))
    cells = written(sample.groupBy(*NODE).applyInPandas(_fitted(threshold, cell_rows, gain, CHILDREN), "size int, label long, cell long, child int, centroid array<double>"), "centroids")
    # nodes without cells stay as they are and need no dealing
    split = cells.select(*NODE).distinct().join(big, NODE)
    kept = [c.split()[0] for c in PLACED.split(", ")]
    dealt = rows.join(split, NODE).select(*kept, F.pmod(F.xxhash64("rep", F.lit(-1 - level)), F.col("parts")).cast("int").alias("part"))
    named = [F.col(c).alias(c) for c in NODE]
    centres = cells.join(split, NODE).select(*named, "child", "centroid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    keys = [*NODE, "part"]
    own = dealt.groupBy(*keys).cogroup(centres.groupBy(*keys)).applyInPandas(_assigned(threshold, level, CHILDREN), PLACED.format(kind))
    rest = rows.join(split.select(*NODE), NODE, "left_anti").withColumn("cell", F.col("cell") * CHILDREN)
    return written(rest.select(*own.columns).unionByName(own), "cells")


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of the truth table of x[i] . y[j] >= threshold, with the first i of each; near ties are
    summed again without blocking."""
    for low in range(0, len(x), SLICE):
        cos = x[low : low + SLICE] @ y.T
        hit = cos >= threshold
        for i, j in np.argwhere(np.abs(cos - threshold) < 1e-9):
            hit[i, j] = math.fsum(x[low + i] * y[j]) >= threshold
        yield low, hit


def _product(threshold: float):
    def product(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("side", ignore_index=True)
        same = bool(block["i"].iloc[0] == block["j"].iloc[0] and block["u"].iloc[0] == 0 and block["v"].iloc[0] == 0)
        n = len(block) if same else int((block["side"] == 0).sum())
        begin = 0 if same else n
        if len(block) < 2 or n == 0 or begin == len(block):
            return pd.DataFrame({"rep": [], "n": [], "root": []}).astype("int64")
        x = unit_rows(list(block["embedding"]))
        reps, mult = block["rep"].to_numpy(), block["mult"].to_numpy()
        order = np.argsort(reps, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        count, root = np.zeros(len(block), np.int64), np.arange(len(block))
        for low, hit in linked(x[:n], x[begin:], threshold):
            if same:
                hit &= np.arange(n) > np.arange(low, low + len(hit))[:, None]
            count[low : low + len(hit)] += hit @ mult[begin:]
            count[begin:] += mult[low : low + len(hit)] @ hit
            i, j = np.nonzero(hit)
            pairs = np.concatenate([np.stack([place[i + low], place[j + begin]], axis=1), np.stack([np.arange(len(root)), root], axis=1)])
            root = local_roots(pairs, len(root))
        found = count > 0
        return pd.DataFrame({"rep": reps[found], "n": count[found], "root": reps[order][root[place]][found]})

    return product


def dealt_blocks(placed: DataFrame) -> DataFrame:
    """placed with the block pairs (u, v, i, j) that each row takes part in, and its side there.

    Rows of a cell are blocked by mask. Two rows are compared in a cell unless some level has both as
    visitors there, as another cell then holds them: masks u <= v meet if they share no bit."""
    masks = 1 << LEVELS
    rows = F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_NUMBERS) / F.col("size")))).cast("int")
    blocks = placed.groupBy(*NODE).agg(*[F.ceil(F.count_if(F.col("mask") == m) / rows).cast("int").alias(f"n_{m}") for m in range(masks)])
    own = F.pmod(F.xxhash64("rep"), F.array(*[f"n_{m}" for m in range(masks)])[F.col("mask")]).cast("int")
    located = placed.join(blocks, NODE).withColumn("own", own)
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda k: k < n)
    task = lambda u, v, i, j, side: F.struct(F.lit(u).alias("u"), F.lit(v).alias("v"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    def meeting(m: int, w: int):
        if m == w:
            return F.transform(upto(F.col("n_0")), lambda k: task(0, 0, F.least("own", k), F.greatest("own", k), F.col("own") > k))
        if m < w:
            return F.transform(upto(F.col(f"n_{w}")), lambda k: task(m, w, F.col("own"), k, F.lit(0)))
        return F.transform(upto(F.col(f"n_{w}")), lambda k: task(w, m, k, F.col("own"), F.lit(1)))

    meetings = lambda m: F.concat(*[meeting(m, w) for w in range(masks) if not m & w])
    turns = F.when(F.col("mask") == 0, meetings(0))
    for m in range(1, masks):
        turns = turns.when(F.col("mask") == m, meetings(m))
    return located.select(*NODE, "rep", "mult", "embedding", F.inline(turns))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, cell_rows: int = CELL_ROWS, gain: float = GAIN) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Vectors with cosine >= threshold and equal labels are linked. A null label or vector, a zero
    vector, one with null or non-finite components, or a null vec_id has no links; vectors are
    compared with those of their own length only. Rows that repeat a vec_id and vector count as
    vectors of their own; different vectors of one vec_id share its links and component. Further columns are ignored; an empty table gives an empty one.
    """
    kind = vectors.schema["embedding"].dataType
    kept = kind.simpleString() in ("array<float>", "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind if kept else "array<double>").alias("embedding"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    plain = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))  # no negative zeros
    key = F.when(good, F.struct(F.xxhash64(plain).alias("h"), F.md5(F.array_join(plain.cast("array<string>"), " ")).alias("m")))
    keyed = rows.withColumn("_key", key)
    groups = keyed.where("_key IS NOT NULL").groupBy("label", "_key")
    classes = written(groups.agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.any_value("embedding").alias("embedding")), "classes")
    placed = classes.select("rep", "label", "mult", F.size("embedding").alias("size"), F.lit(0).cast("long").alias("cell"), F.lit(0).alias("mask"), "embedding")
    for level in range(LEVELS):
        placed = parted(placed, level, threshold, cell_rows, gain)
    found = dealt_blocks(placed).groupBy(*NODE, "u", "v", "i", "j").applyInPandas(_product(threshold), "rep long, n long, root long")
    found = written(found, "products")
    linked, edges = found.select("rep", "n"), found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    tree = components(edges)
    named = classes.select("label", "_key", "rep", "mult").join(linked.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(tree, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("label").alias("_label"), F.col("_key").alias("_class"), (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("comp"))
    out = keyed.join(named, (F.col("label") == F.col("_label")) & (F.col("_key") == F.col("_class")), "left")
    component = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(load(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE u AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), v AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM u
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
   AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), r AS (
  SELECT vec_id AS node, vec_id AS seen FROM u UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a
), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM u LEFT JOIN n ON n.a = vec_id JOIN c ON c.node = vec_id
"""
