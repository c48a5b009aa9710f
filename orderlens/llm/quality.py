"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Features are indicators of hashed n-grams: word unigrams and bigrams, and
unigrams, bigrams and trigrams of word shapes (case, length, punctuation, digits,
same as the word before). Each indicator is scaled by its class log-count ratio
and a linear model with hinge loss is fitted by dual coordinate descent; its
margin becomes a probability by a logistic fit on rows left out of the descent.

The labelled rows for the fit are the ``SAMPLE_PER_CLASS`` rows of each class with
the smallest id hashes (a documented bound, rows whole); every document is scored.

Defined cases: words are as in the text, ASCII case folded for word n-grams; a
null, empty or wordless text has no features and takes the score of a zero
margin; repeated label rows of an id count once, by their larger label, and of
documents that share an id one is learnt from; without labels of both classes the
score is the share of label 1, or 0.5 without labels; repeated rows get equal
scores; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from orderlens.llm.common import free_name, held_out, row_ranges, text_bytes
from orderlens.llm.words import mix, word_hashes, word_spans

SAMPLE_PER_CLASS = 4000
DIMENSIONS = 1 << 18
THRESHOLD = 0.3
SCORE = "_quality_score"
_SLICE_BYTES = 1 << 18  # a slice takes some 50 bytes of worker memory a byte of text
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _per_word(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[ends] - total[starts]


def ngram_features(data: np.ndarray, off: np.ndarray, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Row and index of every distinct n-gram indicator of each row, in row order."""
    starts, ends, first = word_spans(data, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    words = word_hashes(_FOLD[data], starts, ends)
    size = ends - starts
    upper = _per_word(_UPPER[data], starts, ends)
    case = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(2 * upper < size, 2, 3)))
    shape = case + 4 * np.minimum(_per_word(_SIGN[data], starts, ends), 3)
    shape += 16 * np.minimum(_per_word(_DIGIT[data], starts, ends), 2) + 64 * np.minimum(size // 2, 7)
    again = np.zeros(len(words), np.int64)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    shape = mix((shape + 512 * again).astype(np.uint64) + np.uint64(0xABCD))
    grams = []
    for kind, (values, longest) in enumerate(((words, 2), (shape, 3))):
        for n in range(1, longest + 1):
            gram = np.full(max(0, len(values) - n + 1), kind * 8 + n, np.uint64)
            for k in range(n):
                gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) ^ values[k: k + len(gram)])
            same = row[: len(gram)] == row[n - 1:]
            grams.append(row[: len(gram)][same] * dimensions + (gram[same] % np.uint64(dimensions)).astype(np.int64))
    distinct = np.unique(np.concatenate(grams))
    return distinct // dimensions, distinct % dimensions


@dataclass
class QualityModel:
    """Feature weights (ratio times descent weight), squared ratios for the norm, and the logistic map."""

    weight: np.ndarray
    square: np.ndarray
    slope: float
    offset: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        row, index = ngram_features(data, off, len(self.weight))
        dot = np.bincount(row, self.weight[index], n)
        norm = np.sqrt(np.bincount(row, self.square[index], n))
        margin = np.divide(dot, norm, out=np.zeros(n), where=norm > 0)
        return 1.0 / (1.0 + np.exp(-(self.slope * margin + self.offset)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, dimensions: int) -> np.ndarray:
    counts = np.ones((2, dimensions))
    for index, label in zip(rows, labels):
        counts[label, index] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, dimensions: int,
                            cost: float = 4.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of the linear hinge-loss model; one dual variable per row, clipped to [0, cost]."""
    weight, alpha = np.zeros(dimensions), np.zeros(len(rows))
    sign = np.where(labels == 1, 1.0, -1.0)
    square = np.array([v @ v for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            if square[i] == 0:
                continue
            gradient = sign[i] * (weight[rows[i]] @ values[i]) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if new != alpha[i]:
                weight[rows[i]] += (new - alpha[i]) * sign[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weight


def logistic_map(margin: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * margin + b, -30, 30)))
        pull = x.T @ (weights * (labels - p)) - 1e-3 * weights.sum() * np.array([a, b]) * 1e-2
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-5 * weights.sum() * np.eye(2)
        step = np.linalg.solve(curve, pull)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit_model(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray,
              dimensions: int = DIMENSIONS) -> QualityModel:
    """Every fifth row calibrates; the others give ratios and weights."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 0.5
        none = np.zeros(dimensions)
        return QualityModel(none, none, 1.0, float(np.log(share / (1 - share))))
    # fold by rank within the class, so both parts hold both classes
    rank = np.empty(len(labels), np.int64)
    for c in (0, 1):
        rank[labels == c] = np.arange((labels == c).sum())
    aside = rank % 5 == 4
    if len(set(labels[aside].tolist())) < 2:
        aside = np.zeros(len(labels), bool)
    fit = np.flatnonzero(~aside)
    ratio = log_count_ratios([rows[i] for i in fit], labels[fit], dimensions)
    # one flat array behind all rows: its memory goes back to the system when the fit is done
    ends = np.cumsum([len(r) for r in rows])
    flat = ratio[np.concatenate(rows)]
    scaled = np.split(flat, ends[:-1])
    for v in scaled:
        v /= max(np.sqrt(v @ v), 1e-12)
    w = dual_coordinate_descent([rows[i] for i in fit], [scaled[i] for i in fit], labels[fit], dimensions)
    check = np.flatnonzero(aside) if aside.any() else fit
    margin = np.array([w[rows[i]] @ scaled[i] for i in check])
    slope, offset = logistic_map(margin, labels[check], weights[check])
    return QualityModel((w * ratio), ratio ** 2, slope, offset)


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str,
                  per_class: int, dimensions: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Indicator lists of the labelled sample, labels, and rows each stands for (bounded by ``per_class``)."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    marks = marks.filter("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.max("_label").alias("_label"))
    marks = marks.filter(learn)
    size = {r["_label"]: r["n"] for r in marks.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    share = {c: min(1.0, per_class / n) for c, n in size.items()}
    first = [marks.filter(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    # at most 2 * per_class rows of an id and a label: the texts stay where they are read
    sample = F.broadcast(first[0].unionByName(first[1]))
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(sample, "_id")

    def indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for a, b in row_ranges(off, _SLICE_BYTES):
                row, index = ngram_features(data[off[a]: off[b]], off[a: b + 1] - off[a], dimensions)
                bounds = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(index.astype(np.int32)))],
                    names=["_id", "_label", "_index"])

    kind = joined.schema["_id"].dataType.simpleString()
    found = joined.select("_id", "_text", "_label").mapInArrow(indicators, f"_id {kind}, _label int, _index array<int>")
    # one row an id, however often its document is repeated
    once = found.groupBy("_id", "_label").agg(F.min("_index").alias("_index"))
    table = once.toArrow()
    order = pc.sort_indices(table.column("_id")).to_numpy()
    rows = [part for chunk in table.column("_index").chunks
            for part in np.split(chunk.flatten().to_numpy(), chunk.value_lengths().to_numpy().cumsum()[:-1])[: len(chunk)]]
    y = table.column("_label").to_numpy().astype(np.int64)[order]
    return [rows[i] for i in order], y, np.array([1.0 / max(share[c], 1e-6) for c in y.tolist()])


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS,
                  dimensions: int = DIMENSIONS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` ids (or the columns of ``keep``) and last ``_quality_score`` (or a free name): probability of label 1.

    ``learn`` is a condition over ``_id`` for label rows the model may see.
    """
    spark = docs.sparkSession
    model = fit_model(*training_rows(docs, labels, learn, id_col, text_col, label_col, per_class, dimensions),
                      dimensions)
    pa.default_memory_pool().release_unused()
    shared = spark.sparkContext.broadcast(model)
    names = [id_col] if keep is None else keep
    text, out = free_name(docs, "_score_text"), free_name(docs, SCORE)
    source = docs.select(*names, F.col(text_col).cast("string").alias(text))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(batch.num_columns - 1))
            parts = [shared.value.scores(data[off[a]: off[b]], off[a: b + 1] - off[a])
                     for a, b in row_ranges(off, _SLICE_BYTES)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)],
                                             names=[*batch.schema.names[:-1], out])

    schema = source.drop(text).schema.add(out, "double")
    return source.mapInArrow(score, schema)


def quality_predictions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        threshold: float = THRESHOLD) -> DataFrame:
    """Id, held_out, score, predicted; rows whose crc32(id) mod 5 is 0 are never learnt from."""
    scored = score_quality(docs, labels, ~held_out("_id", 5, 0), id_col, text_col)
    score = F.col(scored.columns[-1])
    return scored.select(id_col, held_out(id_col, 5, 0).alias("held_out"), score.alias("score"),
                         (score >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, with their columns."""
    scored = score_quality(docs, labels, ~held_out("_id", 5, 0), id_col, text_col, keep=docs.columns)
    return scored.filter(F.col(scored.columns[-1]) >= threshold).select(*docs.columns)
