"""Quality classifier by Bradley-Terry pairwise ranking (operator 4).

The chance that document a is preferred to b is sigmoid(s(a) - s(b)), where s is linear in features of the text's
form: shares of upper case, digits, symbols and separators, lengths of words and lines, how often words, word
pairs and characters repeat, how varied the words are, how alike neighbouring words end.

1. Features: one pass over the texts, in Arrow batches; from here on only numbers travel.
2. Preference pairs: documents of label 1 are preferred to those of label 0. The fit uses labelled documents that are
   not held out, at most ``max_fit_rows`` of them (those with the smallest hashes), and ``pairs_per_row`` opponents of
   the other label for each. Logistic loss on feature differences, by Newton's method with a ridge penalty.
3. Threshold: the quantile of the scores of all labelled, not held-out documents that leaves below it the share of
   label 0. The reported score is sigmoid((s - threshold) * slope), so it is 0.5 at the threshold.

Only texts feed a score. Defined cases: a null or empty text has zero words and gets the score of that; a text of any length is
read whole; equal texts get equal scores; further columns pass through ``keep_good`` and are ignored by scores; a null doc_id
is not held out and has no label; labels that are null are no labels; of a doc_id with several labels the largest
counts; without labels of both kinds every score is 0.5 and every document is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import load, materialize
from .columns import Through
from .words import SPACE_WORDS, Words, gram_hashes, order_by, pieces

MAX_FIT_ROWS, PAIRS_PER_ROW, RIDGE = 20_000, 8, 1e-2
FOLDS, HELD_OUT = 3, 1

_CLASS = np.zeros(256, np.int64)  # 0 other
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A] = 1, 2, 3
_CLASS[0x80:] = 4
for _i, _c in enumerate(b".,!?;:|$%&*#=_-/<>(){}[]\"'@\\~^+"):
    _CLASS[_c] = 5 + _i
N_CLASSES = 5 + len(b".,!?;:|$%&*#=_-/<>(){}[]\"'@\\~^+")
N_SHAPES = 13
N_FEATURES = N_CLASSES + N_SHAPES


def text_features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text; shares are square-rooted, so that small ones tell too."""
    words = Words(column, SPACE_WORDS)
    n = len(words.counts)
    length = (words.end - words.start).astype(np.float64)
    text_of = words.text_of_word()
    count = np.maximum(words.counts, 1).astype(np.float64)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(text_of, values, n)

    # classes of bytes inside words, by text
    sizes = per_text(length)
    owner = np.repeat(text_of, words.end - words.start)
    inside = SPACE_WORDS[words.data]
    kinds = np.bincount(owner * N_CLASSES + _CLASS[words.data[inside]], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    out = np.zeros((n, N_FEATURES))
    out[:, :N_CLASSES] = np.sqrt(kinds / np.maximum(sizes, 1)[:, None])
    if not len(text_of):
        return out
    h = words.hashes()
    pair = np.zeros(len(h), np.uint64)
    pair[:-1] = gram_hashes(h, 2)
    last = np.zeros(len(h), bool)
    last[words.first[1:][words.counts > 0] - 1] = True

    def distinct(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many distinct values each text has, and how often its most frequent one stands there."""
        order = order_by(of, values)
        v, o = values[order], of[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(new)
        runs = np.diff(np.append(at, len(v)))
        most = np.zeros(n)
        np.maximum.at(most, o[at], runs)
        return np.bincount(o[at], minlength=n), most

    kinds_of_words, most = distinct(h, text_of)
    pairs, most_pairs = distinct(pair[~last], text_of[~last])
    n_pairs = np.maximum(words.counts - 1, 1)
    ends = words.data[words.end - 1]
    starts = words.data[words.start]
    same_end = np.zeros(len(h), bool)
    same_end[1:] = (ends[1:] == ends[:-1]) & (text_of[1:] == text_of[:-1])
    repeated = np.zeros(len(h), bool)
    repeated[1:] = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
    mean = sizes / count
    spread = np.sqrt(np.maximum(per_text(length**2) / count - mean**2, 0))
    letters = (ends >= 0x61) & (ends < 0x7B) | (ends >= 0x80)
    shapes = [
        np.log1p(words.counts), kinds_of_words / count, most / count, np.where(words.counts > 1, pairs / n_pairs, 1.0), most_pairs / n_pairs,
        np.log1p(mean), np.log1p(spread), per_text(same_end) / count, per_text(repeated) / count, per_text(length == 1) / count,
        per_text(~letters) / count, per_text((starts >= 0x41) & (starts < 0x5B)) / count, (words.counts == 0).astype(float),
    ]
    out[:, N_CLASSES:] = np.stack(shapes, 1)
    return out


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with an array of features in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            at = batch.schema.get_field_index(text)
            made = text_features(batch.column(at)).astype(np.float32)
            features = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, N_FEATURES, dtype=np.int32)), pa.array(made.ravel()))
            own = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), features], [*own, "features"])

    kept = [f for f in docs.schema if f.name != text]
    return docs.mapInArrow(run, StructType([*kept, *StructType.fromDDL("features array<float>")]))


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


class Ranker:
    """s(x) = weights . (x - mean) / scale, with the threshold and slope of the reported score."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs_per_row: int = PAIRS_PER_ROW, ridge: float = RIDGE, seed: int = 7) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        rng = np.random.default_rng(seed)
        a = np.concatenate([np.repeat(good, pairs_per_row), rng.choice(good, len(bad) * pairs_per_row)])
        b = np.concatenate([rng.choice(bad, len(good) * pairs_per_row), np.repeat(bad, pairs_per_row)])
        self.weights = np.zeros(x.shape[1])
        for _ in range(25):
            gradient, hessian = ridge * len(a) * self.weights, ridge * len(a) * np.eye(x.shape[1])
            for i in range(0, len(a), 20_000):
                d = z[a[i : i + 20_000]] - z[b[i : i + 20_000]]
                p = 1 / (1 + np.exp(np.clip(d @ self.weights, -40, 40)))  # chance of the wrong order
                gradient = gradient - d.T @ p
                hessian = hessian + (d * (p * (1 - p))[:, None]).T @ d
            step = np.linalg.solve(hessian, gradient)
            self.weights = self.weights - step
            if np.abs(step).max() < 1e-6:
                break
        self.threshold, self.slope = 0.0, 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) * self.slope, -40, 40)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(features: DataFrame, labels: DataFrame, label: str, train: Column, max_fit_rows: int = MAX_FIT_ROWS) -> Ranker | None:
    """``features`` has doc_id and features. None without labels of both kinds."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max(label).alias("y"))
    rows = materialize(features.join(known, "doc_id").select("features", "y", F.xxhash64("doc_id").alias("h"), "doc_id"), "quality-fit")
    by = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not by.get(0) or not by.get(1):
        return None
    sample = rows.orderBy("h", "doc_id").limit(max_fit_rows).toPandas()
    x, y = np.stack(sample["features"].to_numpy()).astype(np.float64), sample["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    ranker = Ranker(x, y)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranker.raw(_matrix(batch.column(0))))], ["raw"])

    scored = rows.select("features").mapInArrow(raw, "raw double")
    share = by[0] / (by[0] + by[1])
    low, cut, high = scored.select(F.percentile_approx("raw", [share / 2, share, (1 + share) / 2], 10_000)).first()[0]
    ranker.threshold, ranker.slope = cut, 4.0 / max(high - low, 1e-6)
    return ranker


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    features = materialize(with_features(docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))), "quality-features")
    ranker = fit(features, labels, label, fold(F.col("doc_id"), folds) != held_out, max_fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            score = ranker.score(x) if ranker else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = features.select("doc_id", "features").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns.

    The second pass over the texts makes their features anew, which costs less than a shuffle of the texts.
    """
    features = materialize(with_features(docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))), "quality-features")
    ranker = fit(features, labels, label, fold(F.col("doc_id"), folds) != held_out, max_fit_rows)
    if ranker is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            x = text_features(batch.column(batch.schema.get_field_index(text))).astype(np.float32).astype(np.float64)
            yield batch.filter(pa.array(ranker.score(x) >= 0.5))

    through = Through(docs, text)
    return through.back(through.rows.mapInArrow(run, through.rows.schema))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"))
