"""Scoring texts with a context-tree weighting model learned from the corpus.

Texts are byte strings with A-Z in lower case. A byte is eight binary decisions; each of the 255
decision nodes has a context tree over the preceding `DEPTH` bytes (zero bytes before the text). In
every tree node a Krichevsky-Trofimov estimate of its zeros and ones is mixed, half and half, with
the product of its children, down to full depth. The mix of a node after training is known, so the
probability of a byte depends on its DEPTH + 1 bytes alone, and a text's score is a sum over these.

Training counts all byte windows of all training texts; the trees are folded from the leaves to the
root, and the estimates from the root to the leaves, by grouping and joining on the context, one
depth at a time. Windows that only texts outside training have enter with zero counts.

The base score is that of a smoothed word distribution. For either lookup, the entries that make
up at least 1 / BOUND of all occurrences (at most BOUND) are broadcast; rarer ones are joined, and
no key of that join can be hot.

Defined results: a null text is empty: one token (the end), score 0, no bits_per_byte; an empty table gives an empty
result; without training texts every estimate is one half; repeated rows are scored one by one (each
counts in training); a null doc_id is held out; further columns are ignored. Words and windows are
compared by 64-bit hashes and exact bytes respectively.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textbatch import PAD, U64, chunks, hash_spans, mixed, sums_by, texts_of, windows, words

DEPTH = 4
FOLDS = 10
WORD_BOUND = 1_000_000
GRAM_BOUND = 4_000_000
WORD, GRAM, END = 0, 1, 2
ALPHA = 0.1


class Lookup:
    """Open-addressing table from 64-bit keys to doubles; whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.at = np.full(1 << bits, -1, np.int32)
        self.keys, self.values = keys, values
        left = np.arange(len(keys))
        slot = (mixed(keys) >> self.shift).astype(np.int64)
        while len(left):
            free = self.at[slot[left]] < 0
            self.at[slot[left[free]]] = left[free]  # of equals the last one stays
            placed = self.at[slot[left]] == left
            left = left[~placed]
            slot[left] = (slot[left] + 1) & self.mask

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        out = np.full(len(wanted), -1, np.int32)
        if not len(self.keys):
            return out
        slot = (mixed(wanted) >> self.shift).astype(np.int64)
        left = np.arange(len(wanted))
        while len(left):
            found = self.at[slot]
            there = found >= 0
            left, slot, found = left[there], slot[there], found[there]
            same = self.keys[found] == wanted[left]
            out[left[same]] = found[same]
            left, slot = left[~same], (slot[~same] + 1) & self.mask
        return out


def _counts(docs: DataFrame, depth: int) -> DataFrame:
    """`(kind, key, train, every)` over `docs(doc_id, text, held_out)`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            found: dict[tuple[int, bool], list] = {}
            for chunk in chunks(texts_of(batch), lower=True):
                out = held[chunk.first : chunk.first + chunk.n]
                by_text = np.repeat(out, np.diff(chunk.at))
                keys = windows(chunk, depth)
                start, length, first = words(chunk)
                used = ~np.repeat(out, np.diff(first))
                for kind, off, part in ((GRAM, False, keys[~by_text]), (GRAM, True, keys[by_text]), (WORD, False, hash_spans(chunk, start[used], length[used]))):
                    found.setdefault((kind, off), []).append(np.unique(part, return_counts=True))
            for (kind, off), parts in found.items():
                keys, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                order = np.argsort(keys)
                keys, counts = keys[order], counts[order]
                new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
                sums = np.add.reduceat(counts, new) if len(new) else counts
                yield _count_rows(kind, keys[new], sums * (not off), sums)
            yield _count_rows(END, np.zeros(1, U64), np.array([(~held).sum()]), np.array([len(held)]))

    return docs.mapInArrow(run, "kind int, key long, train long, every long")


def _count_rows(kind: int, keys: np.ndarray, train: np.ndarray, every: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(train.astype(np.int64)), pa.array(every.astype(np.int64))],
                           names=["kind", "key", "train", "every"])


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8."""
    x = x.cast("double")
    y, product = x + 8, x
    for k in range(1, 8):
        product = product * (x + k)
    return ((y - 0.5) * F.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(product))


def _block(n0: Column, n1: Column) -> Column:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - float(np.log(np.pi))


def _decisions(grams: DataFrame, depth: int) -> DataFrame:
    """Eight rows a window: `node` is context * 256 + decision node, `bit` the way taken."""
    byte, context = F.expr(f"(key >> {8 * depth}) & 255"), F.expr(f"key & {(1 << 8 * depth) - 1}")
    return (grams.withColumn("byte", byte).withColumn("context", context).withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(8)))))
            .withColumn("node", F.expr("(context << 8) | (1L << k) | (byte >> (8 - k))")).withColumn("bit", F.expr("(byte >> (7 - k)) & 1")))


def window_scores(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """`(key, value)`: log10 probability of the last byte of every window of `grams(key, train)`."""
    up = F.expr("((node >> 16) << 8) | (node & 255)")
    ones = F.sum(F.col("train") * F.col("bit"))
    level = _decisions(grams, depth).groupBy("node").agg((F.sum("train") - ones).alias("n0"), ones.alias("n1")).withColumn("weighted", _block(F.col("n0"), F.col("n1")))
    levels = [written(level, f"tree-{depth}")]
    for d in range(depth - 1, -1, -1):
        level = (levels[-1].groupBy(up.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
                 .withColumn("own", _block(F.col("n0"), F.col("n1"))).withColumn("top", F.greatest("own", "below"))
                 .withColumn("weighted", F.col("top") + F.log((F.exp(F.col("own") - F.col("top")) + F.exp(F.col("below") - F.col("top"))) / 2))
                 .withColumn("stop", F.exp(F.col("own") - F.col("weighted")) / 2)
                 .select("node", "n0", "n1", "weighted", "stop"))
        levels.append(written(level, f"tree-{d}"))
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    # said: mixed estimate of the depths so far; rest: the share left to the depths below
    state = levels[-1].select("node", (F.col("stop") * one).alias("said"), (1 - F.col("stop")).alias("rest"))
    for level in levels[-2:0:-1]:
        parents = state.select(F.col("node").alias("parent"), "said", "rest")
        state = written(level.withColumn("parent", up).join(parents, "parent").select(
            "node", (F.col("said") + F.col("rest") * F.col("stop") * one).alias("said"), (F.col("rest") * (1 - F.col("stop"))).alias("rest")), "estimates")
    parents = state.select(F.col("node").alias("parent"), "said", "rest")
    leaves = levels[0].withColumn("parent", up).join(parents, "parent").select("node", (F.col("said") + F.col("rest") * one).alias("one"))
    steps = _decisions(grams.select("key"), depth).select("key", "node", "bit").join(leaves, "node")
    return steps.groupBy("key").agg(F.sum(F.log10(F.when(F.col("bit") == 1, F.col("one")).otherwise(1 - F.col("one")))).alias("value"))


def _arrays(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = frame.select("key", "value").toArrow()
    return table["key"].to_numpy().view(U64), table["value"].to_numpy()


def _rare(keys: np.ndarray, text: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Lists, one a text, of distinct keys and their counts."""
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])]) if len(keys) else np.zeros(0, int)
    offsets = pa.array(np.searchsorted(text[new], np.arange(n + 1)).astype(np.int32))
    counts = np.diff(np.r_[new, len(keys)]).astype(np.int64)
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (keys[new].view(np.int64), counts))


_PASS = "row long, doc_id long, held_out boolean, n_words long, known long, base double, score double, words array<long>, word_counts array<long>, grams array<long>, gram_counts array<long>, n_bytes long"


def _partial_scores(docs: DataFrame, frequent, depth: int) -> DataFrame:
    """Sums over frequent words and windows, and each text's rare ones with counts."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Lookup(*t) for t in shared.value]
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for chunk in chunks(texts_of(batch), lower=True, size=1 << 20):
                start, length, first = words(chunk)
                cells = []
                for table, keys, ends in ((tables[0], hash_spans(chunk, start, length), first), (tables[1], windows(chunk, depth), chunk.at - PAD)):
                    at = table.find(keys)
                    seen = at >= 0
                    values = np.where(seen, table.values[at] if len(table.values) else 0.0, 0.0)
                    text = np.repeat(np.arange(chunk.n), np.diff(ends))
                    cells += [sums_by(values, ends), sums_by(seen.astype(np.int64), ends), *_rare(keys[~seen], text[~seen], chunk.n)]
                part = batch.slice(chunk.first, chunk.n)
                yield pa.record_batch([pa.array(np.arange(row, row + chunk.n)), part.column(0), part.column(2), pa.array(np.diff(first), pa.int64()), pa.array(cells[1]), pa.array(cells[0]),
                                       pa.array(cells[4]), cells[2], cells[3], cells[6], cells[7], pa.array(np.diff(chunk.at), pa.int64())], names=[f.split()[0] for f in _PASS.split(", ")])
                row += chunk.n

    return docs.mapInArrow(run, _PASS)


def score_texts(docs: DataFrame, depth: int = DEPTH, folds: int = FOLDS, word_bound: int = WORD_BOUND, gram_bound: int = GRAM_BOUND) -> DataFrame:
    """`(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)` for every row of `docs(doc_id, text)`.

    Texts whose crc32(doc_id) is divisible by `folds` are held out of training. Scores are log10. n_bytes:
    of the text in UTF-8; bits_per_byte: code length of the text by its score, null for an empty text.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    source = docs.select("doc_id", "text", (fold == 0).alias("held_out"))
    counts = written(_counts(source, depth).groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("every").alias("every")), "corpus-counts")
    totals = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("train").alias("train"), F.sum("every").alias("every"), F.count_if(F.col("train") > 0).alias("distinct")).collect()}
    n_words, n_texts, n_bytes = (totals[k][f] if k in totals else 0 for k, f in ((WORD, "train"), (END, "train"), (GRAM, "every")))
    distinct = (totals[WORD]["distinct"] if WORD in totals else 0) + (n_texts > 0)
    train_tokens = n_words + n_texts
    word_values = counts.filter(F.col("kind") == WORD).select("key", F.log10(F.col("train") + ALPHA).alias("value"), F.col("train").alias("n"))
    grams = counts.filter(F.col("kind") == GRAM)
    gram_values = written(window_scores(grams.select("key", "train"), depth).join(grams.select("key", F.col("every").alias("n")), "key"), "window-scores")
    # at most word_bound words and gram_bound windows reach these counts
    often = [(v, F.col("n") >= max(1, -(-total // bound))) for v, total, bound in ((word_values, n_words, word_bound), (gram_values, n_bytes, gram_bound))]
    partial = written(_partial_scores(source, [_arrays(v.filter(many)) for v, many in often], depth), "partial-scores")
    rare = [v.filter(~many).select(F.lit(kind).alias("kind"), "key", "value") for kind, (v, many) in zip((WORD, GRAM), often)]
    asked = [partial.select("row", F.lit(kind).alias("kind"), F.explode(F.arrays_zip(keys, n)).alias("x")).select("row", "kind", F.col(f"x.{keys}").alias("key"), F.col(f"x.{n}").alias("n"))
             for kind, keys, n in ((WORD, "words", "word_counts"), (GRAM, "grams", "gram_counts"))]
    found = asked[0].union(asked[1]).join(rare[0].union(rare[1]), ["kind", "key"], "left")
    is_word = F.col("kind") == WORD
    # a word without a count has log10(0 + ALPHA); every window has a value
    more = found.groupBy("row").agg(
        F.sum(F.when(is_word, F.col("n") * F.coalesce("value", F.lit(float(np.log10(ALPHA)))))).alias("base_more"),
        F.sum(F.when(is_word & F.col("value").isNotNull(), F.col("n"))).alias("known_more"),
        F.sum(F.when(~is_word, F.col("n") * F.col("value"))).alias("score_more"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    end = float(np.log10(n_texts + ALPHA))
    per_token = float(np.log10(train_tokens + ALPHA * (distinct + 1)))
    n_tokens = F.col("n_words") + 1
    return partial.drop("words", "word_counts", "grams", "gram_counts").join(more, "row", "left").select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("known") + zero("known_more") + int(n_texts > 0)).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_more") + end - n_tokens * per_token).alias("base_score"),
        (F.col("score") + zero("score_more")).alias("score"), "n_bytes").withColumn(
        "bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("score") / float(np.log10(2)) / F.col("n_bytes")))
