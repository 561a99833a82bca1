"""Operator 1: quality classifier with Naive Bayes support vectors.

Features are indicators of byte 1-grams to 4-grams, hashed into 2^17 buckets, and of n-grams of the
sequence that says whether a word equals the one before it (and whether a line repeats), which no n-gram
of bytes can tell for words not seen before.  A row is divided by the root of its number of indicators,
so short and long texts weigh alike.  The model is fitted on a documented, bounded sample of labelled
rows: of each class the SAMPLE / 2 rows that come first in a seeded hash order of their keys (all of them
where there are fewer), and of these, in that order, those keys whose texts still fit in SAMPLE_BYTES / 2
bytes.  Class log-count ratios r = log((p / |p|) / (q / |q|)) of the indicators scale
them; dual coordinate descent on the driver fits a linear hinge-loss model, its rows weighted to the
classes' own rates among all labels.  Weights are interpolated with their mean magnitude, as usual for
this model, and a logistic curve turns margins into scores.  Scoring reads each whole text.

Defined results: a null or empty text has no features and gets the curve's value at the bias; with no
labels, or labels of one class only, every score is that class's share (0.5 without labels); labels other
than 0 and 1, or null, teach nothing; repeated rows count each; a score of exactly 0.5 is predicted 1; rows of one
hash in the sample's order follow their keys; an empty table gives no rows, and a model without labels; columns
other than those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 17
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
#: UTF-8 bytes of their texts, at most: what the driver holds while it fits is bounded whatever the rows' length.
SAMPLE_BYTES = 64 << 20
EPOCHS, COST, MIXED = 12, 0.3, 0.5
#: Buckets of the repetition indicators: 1, 2, 4, 8 or 16 words in a row that equal the one before; a repeated line.
RUNS = (1, 2, 4, 8, 16)


def repeats(text: str) -> np.ndarray:
    words = text.split()
    same = bytes([a == b for a, b in zip(words, words[1:])])
    lines = [x for x in text.split("\n") if x]
    found = [i for i, n in enumerate(RUNS) if b"\x01" * n in same]
    return np.array(found + [len(RUNS)] * (len(set(lines)) < len(lines)), np.int32)


def gram_ids(text: str | None) -> list[np.ndarray]:
    """Hash buckets of the text's byte n-grams, n = 1 to 4, with repeats, and of its repetitions."""
    x = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
    out, code = [repeats(text or "")], np.zeros(len(x), np.uint32)
    for n in range(4):
        code = code[: len(x) - n] * np.uint32(257) + x[n:] + np.uint32(1) if len(x) > n else x[:0]
        if len(code):
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
            out.append((mixed >> np.uint32(15)).astype(np.int32))
    return out


def features(text: str | None) -> np.ndarray:
    return np.unique(np.concatenate(gram_ids(text)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) for each bucket; p, q: rows of label 1, 0 that have it, and 1."""
    counts = np.ones((2, BUCKETS))
    for x, y in zip(rows, labels, strict=True):
        counts[y, x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, signs: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 7) -> np.ndarray:
    """Weights (the last: bias) of the L2-regularised hinge-loss model; row i has values[rows[i]] / root of its size at rows[i]."""
    w, alpha = np.zeros(len(values) + 1), np.zeros(len(rows))
    scale = np.array([1 / np.sqrt(max(len(x), 1)) for x in rows])
    norms = np.array([float(np.dot(values[x], values[x])) * s * s + 1.0 for x, s in zip(rows, scale, strict=True)])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            x, y = rows[i], signs[i]
            v = values[x] * scale[i]
            gradient = y * (float(np.dot(w[x], v)) + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[x] += step * y * v
                w[-1] += step * y
                moved = max(moved, abs(step) / cost[i])
        if moved < 1e-3:
            break
    return w


def logistic(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """a > 0 and b of 1 / (1 + exp(-(a m + b))), by damped Newton steps with smoothed targets."""
    a, b = 1.0, 0.0
    target = np.where(labels > 0, 0.99, 0.01)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, h = weights * (p - target), weights * np.maximum(p * (1 - p), 1e-6)
        gradient = np.array([np.dot(g, margins), g.sum()])
        hessian = np.array([[np.dot(h * margins, margins) + 1e-3, np.dot(h, margins)], [np.dot(h, margins), h.sum() + 1e-3]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        a, b = max(a - step[0], 1e-2), b - step[1]
    return float(a), float(b)


class Model:
    """Weights for all buckets, and the curve from margins to scores."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights.astype(np.float32), bias, a, b

    def margin(self, grams: list[np.ndarray], marks: np.ndarray) -> float:
        for x in grams:
            marks[x] = 1
        found = float(np.dot(self.weights, marks)) / np.sqrt(max(np.count_nonzero(marks), 1)) + self.bias
        for x in grams:
            marks[x] = 0
        return found

    def scores(self, texts: list[str | None]) -> np.ndarray:
        marks = np.zeros(BUCKETS, np.float32)
        margins = np.array([self.margin(gram_ids(x), marks) for x in texts])
        return 1 / (1 + np.exp(-np.clip(self.a * margins + self.b, -35, 35)))


def sampled(docs: DataFrame, labels: DataFrame, label: str, sample: int, key: str = "doc_id", text: str = "text", most_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, np.ndarray]:
    """`key`, `text` and `label` of the sampled labelled rows as a table, and how many labels are 0 and 1 in all.

    The sample's labels (at most `sample` rows, whatever the corpus) are broadcast to the documents.
    """
    spark = docs.sparkSession
    usable = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_k").isNotNull())
    rows = np.zeros(2, np.int64)
    for y, n in usable.groupBy("_y").count().collect():
        rows[y] = n
    order = [F.xxhash64(F.lit(11), "_k"), F.col("_k"), F.col("_y")]
    first = [[tuple(x) for x in usable.filter(F.col("_y") == y).orderBy(*order).limit(sample // 2).collect()] for y in (0, 1)]
    chosen = spark.createDataFrame(first[0] + first[1], usable.schema)
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("key") == F.col("_k"))
    found = common.written(found.select("key", "text", F.col("_y").alias("label")), "labelled-sample")
    sizes = {r[0]: r[1] for r in found.groupBy("key").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()}  # `sample` keys at most
    fitting: set = set()
    for side in first:
        room = most_bytes // 2
        for k, _ in side:
            if sizes.get(k, 0) <= room:
                fitting.add(k)
                room -= sizes.get(k, 0)
    left_out = [(k,) for k in sizes if k not in fitting]
    if left_out:
        kind = docs.schema[key].dataType.simpleString()
        found = found.join(F.broadcast(spark.createDataFrame(left_out, f"key {kind}")), "key", "left_anti")
    return found, rows


def fit(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Model:
    """The model that tells documents whose label is 1 from those whose label is 0."""
    examples, rows = sampled(docs, labels, label, sample, key, text)

    def featured(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [features(x).astype("<i4").tobytes() for x in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(1)], ["x", "y"])

    # read back a partition at a time: the driver holds the features once, not the JVM's copy of all of them too
    made = common.written(common.mapped(examples.select("text", "label"), "x binary, y int", featured), "quality-features")
    got = [(bytes(x), y) for x, y in made.toLocalIterator()]
    got.sort(key=lambda x: (x[1], x[0]))  # the model does not depend on the order in which tasks end
    drawn = np.bincount([y for _, y in got], minlength=2)[:2]
    if drawn.min() == 0:
        share = 0.5 if drawn.sum() == 0 else float(drawn[1] > 0)
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    indices = [np.frombuffer(x, "<i4") for x, _ in got]
    classes = np.array([y for _, y in got])
    r = log_count_ratios(indices, classes)
    natural = (rows / rows.sum() / (drawn / drawn.sum()))[classes]
    w = dual_coordinate_descent(indices, r, np.where(classes > 0, 1.0, -1.0), COST * natural, EPOCHS)
    weights = ((1 - MIXED) * np.abs(w[:-1]).mean() + MIXED * w[:-1]) * r
    margins = np.array([float(weights[x].sum()) / np.sqrt(max(len(x), 1)) for x in indices]) + w[-1]
    a, b = logistic(margins, classes, natural)
    return Model(weights, float(w[-1]), a, b)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, `score` (0 to 1) and `predicted` (1 from 0.5 on) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^17 weights of 4 bytes, whatever the corpus

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.scores(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype("int32"))], [key, "score", "predicted"])

    return common.mapped(docs.select(key, text), f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int", each)


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.scores(batch.column(batch.schema.get_field_index(text)).to_pylist()) >= 0.5))

    return common.mapped(docs, docs.schema, each)


def not_held_out(labels: DataFrame, modulus: int, held: int) -> DataFrame:
    return labels.filter(common.crc_remainder(F.col("doc_id"), modulus) != held)


def op1_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that are not held out."""
    docs = common.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(common.crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    with common.scratch(spark) as kept:
        model = fit(docs, not_held_out(labels, 3, 1), "quality")
        return kept(scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted"), "quality-scores")
