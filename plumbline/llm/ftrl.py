"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Words are runs of letters and digits or runs of other signs, A-Z in lower case; a word that repeats
the one before is read as a mark of its own. Words and word pairs are hashed into `BINS` bins; a text
is the vector of their shares. Training takes at most `TRAIN_TEXTS` labelled texts (those of least
hash) and runs per-coordinate FTRL-proximal updates over them in one task; the weights are one
vector of BINS numbers. A score is a sparse dot product, made for a whole batch of texts at once.

Defined results: null and empty texts get the score of the bias; null labels are not learned from, of
several labels of a doc_id the least counts; without labels every score is one half; repeated rows
are scored one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import IS_SPACE, U64, Chunk, chunks, hash_spans, hash_windows, runs, sums_by, texts_of

BINS = 1 << 18
#: The bound of the training sample, in texts.
TRAIN_TEXTS = 8000
FOLDS, HELD_OUT = 3, 1
ALPHA, BETA, L1, L2, EPOCHS = 0.2, 1.0, 0.001, 0.01, 4
#: Scale of the shares.
SCALE = 16.0

_KINDS = np.full(256, 2, np.uint8)
_KINDS[IS_SPACE] = 0
_KINDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_REPEAT = U64(0x5851F42D4C957F2D)


def gram_bins(chunk: Chunk, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins of all words with each text's first, and of all word pairs with each text's first."""
    start, length, first = runs(chunk, _KINDS)
    plain = hash_spans(chunk, start, length)
    head = np.zeros(len(plain), bool)
    head[first[:-1][first[:-1] < len(plain)]] = True
    repeat = np.zeros(len(plain), bool)
    repeat[1:] = plain[1:] == plain[:-1]
    marked = np.where(repeat & ~head, _REPEAT, plain)
    mask = U64(bins - 1)
    pairs = hash_windows(marked, 2)
    # pairs begin at every word but the last of a text
    keep = ~head[1:] if len(head) else head
    pair_first = first - np.searchsorted(np.flatnonzero(np.r_[head[1:], True]) if len(head) else np.zeros(0, int), first)
    return (marked & mask).astype(np.int64), first, (pairs[keep[: len(pairs)]] & mask).astype(np.int64), pair_first


def dense_scores(chunk: Chunk, weights: np.ndarray, bias: float) -> np.ndarray:
    one, first, two, pair_first = gram_bins(chunk, len(weights))
    total = sums_by(weights[one].astype(np.float64), first) + sums_by(weights[two].astype(np.float64), pair_first)
    n = np.diff(first) + np.diff(pair_first)
    return bias + SCALE * total / np.maximum(n, 1)


def _sparse(chunk: Chunk, bins: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    one, first, two, pair_first = gram_bins(chunk, bins)
    for i in range(chunk.n):
        grams = np.concatenate([one[first[i] : first[i + 1]], two[pair_first[i] : pair_first[i + 1]]])
        index, counts = np.unique(grams, return_counts=True)
        yield index, SCALE * counts / max(len(grams), 1)


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], bins: int) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the samples in their order; the last coordinate is the bias."""
    z, n = np.zeros(bins + 1), np.zeros(bins + 1)
    for _ in range(EPOCHS):
        for index, value, label in samples:
            index, value = np.r_[index, bins], np.r_[value, 1.0]
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            z[index] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[index] += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w[:bins], float(w[bins])


def train(docs: DataFrame, labels: DataFrame, bins: int = BINS, most: int = TRAIN_TEXTS) -> tuple[np.ndarray, float]:
    """Weights and bias from at most `most` rows of `labels(doc_id, label)` and their texts."""
    chosen = (labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
              .withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(most))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(texts_of(batch), lower=True):
                part = batch.slice(chunk.first, chunk.n)
                rows = list(_sparse(chunk, bins))
                yield pa.record_batch([part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
                                      names=["rank", "label", "index", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = []
        for batch in batches:
            index, value = batch.column(2), batch.column(3)
            samples += [(np.asarray(index[i].values, np.int64), np.asarray(value[i].values), batch.column(1)[i].as_py()) for i in range(batch.num_rows)]
        weights, bias = fit(samples[:most], bins)
        yield pa.record_batch([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("rank", "label", "text")
    model = (joined.mapInArrow(features, "rank long, label int, index array<long>, value array<double>")
             .repartition(1).sortWithinPartitions("rank", "label").mapInArrow(learn, "weights binary, bias double").first())
    return (np.frombuffer(model["weights"], "<f4"), model["bias"]) if model else (np.zeros(bins, np.float32), 0.0)


def quality_scores(docs: DataFrame, labels: DataFrame, bins: int = BINS, most: int = TRAIN_TEXTS) -> DataFrame:
    """`(doc_id, held_out, score, predicted)` for every row of `docs(doc_id, text)`; learns from `labels(doc_id, label)`.

    Labels whose crc32(doc_id) leaves HELD_OUT when divided by FOLDS are never learned from.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    weights, bias = train(docs, labels.filter(fold != HELD_OUT), bins, most)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(texts_of(batch), lower=True):
                score = 1 / (1 + np.exp(-np.clip(dense_scores(chunk, shared.value, bias), -35, 35)))
                part = batch.slice(chunk.first, chunk.n)
                yield pa.record_batch([part.column(0), part.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", (fold == HELD_OUT).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
