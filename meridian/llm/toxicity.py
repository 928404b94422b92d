"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another, and each model sees the probabilities of the
categories before it. In training these are out-of-fold predictions, as the models' own answers on
rows they were fitted to would be too good; thresholds are chosen on out-of-fold predictions too.
Features are hashed words and the first letters of words, so inflected forms are met half-way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .common import fresh_name, load, written

#: At most so many labelled rows (those of least hash) are fitted; all documents are scored.
MOST_ROWS = 20_000
FOLDS, PREFIX, BLOCK_ROWS = 3, 4, 1_000
#: Hashed places of words, then those of first letters; places held by fewer rows have no weight
#: (chosen by out-of-fold results, which the README gives).
WORDS, STARTS, LEAST_ROWS = 1 << 18, 1 << 16, 3
FEATURES = WORDS + STARTS


def features(text: Column) -> Column:
    """Distinct hashes of the lower-case words and of their first letters; punctuation parts words."""
    words = F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), ""))
    place = lambda t, base, size: (F.pmod(F.xxhash64(t), F.lit(size)) + base).cast("int")
    both = lambda w: F.concat(F.transform(w, lambda t: place(t, 0, WORDS)), F.transform(F.array_distinct(F.transform(w, lambda t: F.substring(t, 1, PREFIX))), lambda t: place(t, WORDS, STARTS)))
    return F.array_distinct(F.transform(F.array(words), both)[0])


def _margins(w: np.ndarray, flat: np.ndarray, row: np.ndarray, before: np.ndarray) -> np.ndarray:
    """w holds the hashed features' weights, then those of the earlier categories, then the bias."""
    return np.bincount(row, w[flat], len(before)) + before @ w[FEATURES:-1] + w[-1]


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = lists.map(len).to_numpy(dtype=np.int64)
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if sizes.sum() else np.zeros(0, np.int64)
    return flat, np.repeat(np.arange(len(lists)), sizes)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_logistic(lists: pd.Series, before: np.ndarray, y: np.ndarray, ridge: float = 3e-5, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by L-BFGS; labels of one value give a constant near that value.

    Rows are summed in blocks, so beside the features themselves little memory is held."""
    n, size = len(y), FEATURES + before.shape[1] + 1
    cuts = [slice(k, k + BLOCK_ROWS) for k in range(0, n, BLOCK_ROWS)]
    blocks = [(np.concatenate([np.asarray(x, np.int32) for x in lists.iloc[c]] or [np.zeros(0, np.int32)]), lists.iloc[c].map(len).to_numpy(dtype=np.int64), before[c], y[c]) for c in cuts]

    held_by = sum((np.bincount(b[0], minlength=FEATURES) for b in blocks), np.zeros(FEATURES, np.int64))
    rare = np.flatnonzero(held_by < LEAST_ROWS)  # else the words of one row alone would explain it

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        total, grad = 0.0, np.zeros(size)
        for flat, sizes, held, truth in blocks:
            row = np.repeat(np.arange(len(truth)), sizes)
            z = _margins(w, flat, row, held)
            miss = (_sigmoid(z) - truth) / n
            total += float(np.sum(np.logaddexp(0, z) - truth * z)) / n
            grad += np.concatenate([np.bincount(flat, miss[row], FEATURES), miss @ held, [miss.sum()]])
        grad[:-1] += ridge * w[:-1]
        grad[rare] = 0
        return total + ridge / 2 * float(w[:-1] @ w[:-1]), grad

    w = np.zeros(size)
    value, grad = loss(w)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step, kept = grad.copy(), []
        for s, t in reversed(history):
            a = (s @ step) / (s @ t)
            kept.append(a)
            step -= a * t
        if history:
            s, t = history[-1]
            step *= (s @ t) / (t @ t)
        for (s, t), a in zip(history, reversed(kept), strict=True):
            step += (a - (t @ step) / (s @ t)) * s
        rate = 1.0 if history else 1.0 / max(1e-9, float(np.abs(grad).sum()))
        for _ in range(20):
            new = w - rate * step
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * rate * float(grad @ step):
                break
            rate /= 2
        else:
            break
        s, t = new - w, new_grad - grad
        if s @ t > 1e-12:
            history = [*history[-7:], (s, t)]
        done = value - new_value < 1e-7
        w, value, grad = new, new_value, new_grad
        if done:
            break
    return w


def _fit_task(part: pd.DataFrame) -> pd.DataFrame:
    """Fits the rows that are not held out; returns the weights (row -1) and the held rows' p."""
    fit, held = part[~part["held"]], part[part["held"]]
    stack = lambda rows: np.array(list(rows["before"]), float).reshape(len(rows), -1)
    width = len(part["before"].iloc[0])
    before = stack(fit) if len(fit) else np.zeros((0, width))
    w = fit_logistic(fit["idx"], before, fit["y"].to_numpy(float))
    out = pd.DataFrame({"row": [-1], "p": [np.nan], "weights": [w]})
    if len(held):
        p = _sigmoid(_margins(w, *_flat(held["idx"]), stack(held)))
        out = pd.concat([out, pd.DataFrame({"row": held["row"].to_numpy(), "p": p, "weights": [None] * len(held)})], ignore_index=True)
    return out.assign(task=part["task"].iloc[0])[["task", "row", "p", "weights"]]


def _scorer(weights):
    @pandas_udf(DoubleType())
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for idx, before in parts:
            rows = np.array(list(before), float).reshape(len(idx), -1)
            yield pd.Series(_sigmoid(_margins(weights.value, *_flat(idx), rows)))

    return score


@dataclass
class Chain:
    categories: tuple[str, ...]
    weights: list[np.ndarray]
    thresholds: list[float]

    def predict(self, docs: DataFrame) -> DataFrame:
        """docs with p_<category> and a flag <category> for each; such columns are replaced.

        A null or empty text has no features and gets the models' bias. Rows may repeat.
        """
        (places,) = fresh_name(docs, "idx")
        out = docs.withColumn(places, features(F.col("text")))
        for k, name in enumerate(self.categories):
            weights = out.sparkSession.sparkContext.broadcast(self.weights[k])  # FEATURES numbers
            earlier = F.array(*[F.col(f"p_{n}") for n in self.categories[:k]]).cast("array<double>")
            out = out.withColumn(f"p_{name}", _scorer(weights)(F.col(places), earlier))
        return out.withColumns({n: F.col(f"p_{n}") >= t for n, t in zip(self.categories, self.thresholds, strict=True)}).drop(places)


def _threshold(rows: DataFrame, p: str, label: str) -> float:
    """The cut of best overlap (and so F1) on a grid of twentieths; the middle of equally good ones."""
    cuts = F.explode(F.array(*[F.lit(k / 20) for k in range(1, 20)]))
    hits = rows.select(p, label, cuts.alias("cut")).groupBy("cut").agg(F.count_if((F.col(p) >= F.col("cut")) & (F.col(label) == 1)).alias("tp"), F.count_if((F.col(p) >= F.col("cut")) | (F.col(label) == 1)).alias("any"))
    found = sorted((r["cut"], r["tp"] / r["any"] if r["any"] else 0.0) for r in hits.collect())
    best = max((s for _, s in found), default=0.0)
    even = [c for c, s in found if s == best]
    return even[len(even) // 2] if even else 0.5


def fit_chain(labelled: DataFrame, categories: tuple[str, ...], most_rows: int = MOST_ROWS, folds: int = FOLDS) -> Chain:
    """labelled: doc_id, text and a 0/1 column for each category, in the chain's order.

    Rows with a null label are left out before the sample is taken; null texts have no features; of
    rows that repeat a doc_id the least counts. Labels of one value give probabilities near it. The
    sample's fits run as one task for each fold and one for all rows. Without labelled rows every
    probability is a half.
    """
    each = F.struct(*[F.col(c).cast("int").alias(c) for c in categories], features(F.col("text")).alias("idx"))
    bounded = labelled.dropna(subset=list(categories)).groupBy("doc_id").agg(F.min(each).alias("s")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = bounded.select(F.monotonically_increasing_id().alias("row"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(folds)).cast("int").alias("fold"), "s.*")
    rows, weights, thresholds = written(rows, "train"), [], []
    for k, name in enumerate(categories):
        earlier = F.array(*[F.col(f"p_{n}") for n in categories[:k]]).cast("array<double>")
        tasks = rows.select("row", "idx", F.col(name).alias("y"), earlier.alias("before"), "fold", F.explode(F.sequence(F.lit(0), F.lit(folds))).alias("task")).withColumn("held", F.col("fold") == F.col("task")).drop("fold")
        fits = written(tasks.groupBy("task").applyInPandas(_fit_task, "task int, row long, p double, weights array<double>"), "fits")
        whole = fits.where(f"row = -1 AND task = {folds}").first()
        weights.append(np.array(whole["weights"]) if whole else np.zeros(FEATURES + k + 1))
        outside = fits.where("row >= 0").select("row", F.col("p").alias(f"p_{name}"))
        rows = written(rows.join(outside, "row"), "folds")
        thresholds.append(_threshold(rows, f"p_{name}", name))
    return Chain(tuple(categories), weights, thresholds)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table has two columns, so the chain has two links: low quality, then toxic."""
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")
    made = labels.select(F.col("doc_id").alias("_of"), (1 - F.col("quality")).alias("low_quality"), "toxic").dropna()
    known = made.groupBy("_of").agg(F.min(F.struct("low_quality", "toxic")).alias("s")).select("_of", "s.*").orderBy(F.xxhash64("_of"), "_of").limit(MOST_ROWS)
    labelled = docs.join(F.broadcast(known), F.col("doc_id") == F.col("_of")).drop("_of")  # MOST_ROWS rows
    chain = fit_chain(labelled, ("low_quality", "toxic"))
    return chain.predict(docs).select("doc_id", "p_low_quality", "low_quality", "p_toxic", "toxic")
