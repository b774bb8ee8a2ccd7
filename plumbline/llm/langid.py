"""Language identification: the language family first, then one-against-one linear machines within it.

A text is the vector of the shares of its hashed byte 2-, 3- and 4-grams (A-Z in lower case). Linear
support vector machines, trained by dual coordinate descent, tell each family from the others and,
within a family, each language from each other one; the family's languages then win by votes, and by
summed margin where votes are equal. All machines score a batch at once.

Training takes about `PER_LANGUAGE` texts of each language (those of least hash; never more). Each
machine is trained in a task of its own from these bounded samples.

Defined results: `und` with score 0 for a null text, a text without a letter, and where nothing was
learned; null languages are not learned from; a language of no listed family forms its own; repeated
rows are judged one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import U64, Chunk, chunks, mixed, sums_by, texts_of, windows

# Families of closely related languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi ur bn mr gu pa ne si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "malayic": "id ms jv su tl",
    "celtic": "ga gd cy br",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"
ORDERS = (2, 3, 4)
BINS = 1 << 16
PER_LANGUAGE = 800
FOLDS, HELD_OUT = 4, 2
COST, EPOCHS = 10.0, 12
#: Scale of the shares.
SCALE = 32.0


def gram_bins(chunk: Chunk, bins: int) -> list[np.ndarray]:
    """For every order, the bin of the window that ends at each byte."""
    mask = U64(bins - 1)
    return [(mixed(windows(chunk, n - 1) + U64(n << 40)) & mask).astype(np.int64) for n in ORDERS]


def margins(chunk: Chunk, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(text, machine) margins; weights: (bin, machine)."""
    first = chunk.at - chunk.at[0]
    total = np.zeros((chunk.n, weights.shape[1]))
    for bins in gram_bins(chunk, len(weights)):
        for k in range(weights.shape[1]):
            total[:, k] += sums_by(weights[:, k][bins].astype(np.float64), first)
    return bias + SCALE * total / np.maximum(len(ORDERS) * np.diff(first), 1)[:, None]


def machine(rows: list[tuple[np.ndarray, np.ndarray, int]], bins: int) -> tuple[np.ndarray, float]:
    """Linear support vector machine (hinge loss) by dual coordinate descent; labels 1 and -1."""
    w, bias = np.zeros(bins), 0.0
    alpha, norm = np.zeros(len(rows)), np.array([v @ v + 1.0 for _, v, _ in rows])
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            index, value, y = rows[i]
            step = min(max(alpha[i] - (y * (w[index] @ value + bias) - 1) / norm[i], 0.0), COST) - alpha[i]
            if step:
                alpha[i] += step
                w[index] += step * y * value
                bias += step * y
    return w, bias


def problems(languages: list[str]) -> list[tuple[str, dict[str, int]]]:
    """Name and labels by language of every machine: families first, then pairs within families."""
    of = {x: FAMILY_OF.get(x, f"only {x}") for x in languages}
    families = sorted(set(of.values()))
    found = [(f, {x: 1 if of[x] == f else -1 for x in languages}) for f in families] if len(families) > 1 else []
    return found + [(f"{a}|{b}", {a: 1, b: -1}) for a, b in combinations(languages, 2) if of[a] == of[b]]


def decide(found: np.ndarray, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language and a score between 0 and 1, from the margins of all machines."""
    names = [name for name, _ in problems(languages)]
    of = [FAMILY_OF.get(x, f"only {x}") for x in languages]
    families = sorted(set(of))
    place = np.zeros(len(found), np.int64)
    sure = np.ones(len(found))
    if len(families) > 1:
        own = found[:, : len(families)]
        place = own.argmax(axis=1)
        sure = 1 / (1 + np.exp(-2 * np.clip(own.max(axis=1), -15, 15)))
    out, score = np.zeros(len(found), np.int64), sure.copy()
    for f, family in enumerate(families):
        rows = np.flatnonzero(place == f)
        members = [k for k, x in enumerate(of) if x == family]
        votes, total = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
        weakest = np.full((len(rows), len(members)), np.inf)
        for a, b in combinations(range(len(members)), 2):
            m = found[rows, names.index(f"{languages[members[a]]}|{languages[members[b]]}")]
            for k, side in ((a, m), (b, -m)):
                votes[:, k] += side > 0
                total[:, k] += side
                weakest[:, k] = np.minimum(weakest[:, k], side)
        best = np.lexsort((total, votes), axis=1)[:, -1] if len(rows) else np.zeros(0, int)
        out[rows] = np.array(members)[best]
        if len(members) > 1:
            score[rows] *= 1 / (1 + np.exp(-2 * np.clip(weakest[np.arange(len(rows)), best], -15, 15)))
    return out, score


def train(docs: DataFrame, bins: int = BINS, most: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, weights (bin, machine) and biases from the rows of `docs(doc_id, text, lang)`."""
    usable = docs.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("rank", F.xxhash64("doc_id"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    kinds = problems(languages)
    if not kinds:
        return languages, np.zeros((bins, 0), np.float32), np.zeros(0)
    # the share of the hash range that holds about `most` texts of a language
    share = F.create_map(*[F.lit(v) for x in languages for v in (x, int(min(1.0, most / counts[x]) * (2.0 ** 64 - 1025)) - 2 ** 63)])
    sample = usable.filter(F.col("rank") <= F.element_at(share, F.col("lang")))
    joined = F.create_map(*[F.lit(v) for x in languages for v in (x, ",".join(str(k) for k, (_, labels) in enumerate(kinds) if x in labels))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(texts_of(batch), lower=True):
                first, bins_ = chunk.at - chunk.at[0], gram_bins(chunk, bins)
                cells = []
                for i in range(chunk.n):
                    index, n = np.unique(np.concatenate([b[first[i] : first[i + 1]] for b in bins_]), return_counts=True)
                    cells.append((index.astype(np.int32), (SCALE * n / max(n.sum(), 1)).astype(np.float32)))
                part = batch.slice(chunk.first, chunk.n)
                yield pa.record_batch([part.column(0), part.column(1), pa.array([c[0] for c in cells], pa.list_(pa.int32())), pa.array([c[1] for c in cells], pa.list_(pa.float32()))],
                                      names=["rank", "lang", "index", "value"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["lang", "rank"]).groupby("lang").head(most)
        labels = kinds[int(group["problem"].iloc[0])][1]
        rows = [(np.asarray(i), np.asarray(v, np.float64), labels[x]) for i, v, x in zip(group["index"], group["value"], group["lang"])]
        w, bias = machine(rows, bins)
        return pd.DataFrame({"problem": [int(group["problem"].iloc[0])], "weights": [w.astype("<f4").tobytes()], "bias": [bias]})

    rows = (sample.select("rank", "lang", "text").mapInArrow(features, "rank long, lang string, index array<int>, value array<float>")
            .withColumn("problem", F.explode(F.split(F.element_at(joined, F.col("lang")), ","))).withColumn("problem", F.col("problem").cast("int")))
    models = {r["problem"]: r for r in rows.groupBy("problem").applyInPandas(learn, "problem int, weights binary, bias double").collect()}
    order = range(len(kinds))
    return languages, np.stack([np.frombuffer(models[k]["weights"], "<f4") for k in order], axis=1), np.array([models[k]["bias"] for k in order])


def predict_languages(docs: DataFrame, bins: int = BINS, most: int = PER_LANGUAGE) -> DataFrame:
    """`(doc_id, held_out, lang_pred, score)` for every row of `docs(doc_id, text, lang)`.

    Rows whose crc32(doc_id) leaves HELD_OUT when divided by FOLDS are never learned from.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    languages, weights, bias = train(docs.filter(fold != HELD_OUT).select("doc_id", "text", "lang"), bins, most)
    shared = docs.sparkSession.sparkContext.broadcast(np.asfortranarray(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(texts_of(batch), lower=True):
                part = batch.slice(chunk.first, chunk.n)
                known = part.column(3).to_numpy(zero_copy_only=False).astype(bool) & bool(languages)
                best, score = decide(margins(chunk, shared.value, bias), languages) if languages else (np.zeros(chunk.n, int), np.zeros(chunk.n))
                names = [languages[k] if ok else UNKNOWN for k, ok in zip(best, known)]
                yield pa.record_batch([part.column(0), part.column(2), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", (fold == HELD_OUT).alias("held_out"), letter.alias("letter")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
