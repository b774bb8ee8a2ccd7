"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Every word and every pair of words is an n-gram. It is hashed twice: as it is written, and by shape. A
shape has one sign for each run of small letters, capitals or digits, and a pair of equal words has one
of its own. `BINS` is shared out between words, pairs and shapes (`_parts`). `bin_weights` counts the
bins over all documents (raw) and over at most `TRUSTED_TEXTS` trusted ones (target), in one pass, and gives `log p_target - log p_raw`
for each bin, smoothed towards the raw share of its part; the table has `BINS` entries whatever the corpus. The score of
a text is the mean weight of its n-grams. A text is kept unless its score is below `THRESHOLD` or the
base rule fails.

An n-gram has the weight of its own bin if that says something about it, else that of its shape. A bin
of words or pairs says nothing if fewer than `LEAST_COUNT` of its n-grams are found, and fewer are
expected at the raw rate, in the target; or if it holds less than `LEAST_LOAD` times the median of its
part, since rare n-grams share their bins with others, more of them the larger the corpus. So a text
of words that the corpus does not hold is judged by its shapes alone. Built-in functions only.

Defined results: a null or blank text has no words, score 0, and fails the base rule; empty tables
give empty results; repeated rows are judged one by one; without trusted documents every weight is 0;
a null doc_id is not trusted. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, WORD, written

BINS = 1 << 17
THRESHOLD = -1.0
#: Trusted documents that the target is counted over, at most; raw counts cover all documents.
TRUSTED_TEXTS = 20_000
SMOOTHING = 0.5
#: Of a bin of words or pairs: least count found or expected in the target, and least multiple of the median raw count.
LEAST_COUNT = 8
LEAST_LOAD = 4
MIN_WORDS = 10
#: Most words in repeated windows, of 100.
MOST_REPEATED = 20
WINDOW = 5


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, rf"[{SPACE}]+"), "")


def _shaped(text: Column) -> Column:
    """The text with letter and digit runs replaced by one sign for each kind; its words stay aligned."""
    text = F.regexp_replace(text, r"\p{Ll}+", "a")
    text = F.regexp_replace(text, r"\p{Lu}+", "A")
    return F.regexp_replace(text, r"\p{Nd}+", "0")


def _with_hashes(docs: DataFrame, *keep: str) -> DataFrame:
    """Adds `hashes` and `shapes`: a 64-bit hash of every word, and of every word's shape."""
    hashed = lambda text: F.transform(_word_array(text), lambda w: F.xxhash64(w))
    return docs.select(*keep, _text().alias("text")).withColumn("shapes", hashed(_shaped(F.col("text")))).withColumn("hashes", hashed(F.col("text")))


def _parts(bins: int) -> tuple[int, int]:
    """Where the bins of pairs and those of shapes begin; those of words come first."""
    return bins * 3 // 8, bins * 7 // 8


def _place(h: Column, start: int, end: int) -> Column:
    return (F.pmod(h, F.lit(end - start)) + start).cast("int")


def _word_bins(bins: int, hashed: Column, shape: Column) -> tuple[Column, Column]:
    """Own bin and shape bin of a word."""
    at_pairs, at_shapes = _parts(bins)
    return _place(hashed, 0, at_pairs), _place(shape, at_shapes, bins)


def _pair_bins(bins: int, hashed: Column, before: Column, shape: Column, shape_before: Column) -> tuple[Column, Column]:
    """Own bin and shape bin of a word and the one before it; null where there is none."""
    at_pairs, at_shapes = _parts(bins)
    pair = lambda h: F.when(before.isNotNull(), h)
    return (_place(pair(F.xxhash64(hashed, before)), at_pairs, at_shapes),
            _place(pair(F.xxhash64(shape, shape_before, hashed == before)), at_shapes, bins))


def gram_rows(texts: DataFrame, bins: int, *keep: str) -> DataFrame:
    """`(*keep, bin)`: two rows for each word and word pair; needs `hashes` and `shapes`.

    A row a word first, so that the bins are compiled expressions over rows.
    """
    at = F.explode(F.when(F.size("hashes") > 0, F.sequence(F.lit(0), F.size("hashes") - 1)).otherwise(F.array().cast("array<int>")))
    one = texts.select(*keep, "hashes", "shapes", at.alias("i")).select(
        *keep, *(F.get(c, F.col("i") - k).alias(f"{c}_{k}") for c in ("hashes", "shapes") for k in (0, 1)))
    h, before, shape, shape_before = (F.col(f"{c}_{k}") for c in ("hashes", "shapes") for k in (0, 1))
    every = F.array(*_word_bins(bins, h, shape), *_pair_bins(bins, h, before, shape, shape_before))
    return one.select(*keep, F.explode(every).alias("bin")).filter("bin IS NOT NULL")


def trusted_sample(trusted: DataFrame, most: int = TRUSTED_TEXTS) -> DataFrame:
    """`(doc_id)`: at most `most` trusted documents, those of least hash."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def bin_counts(docs: DataFrame, trusted: DataFrame, bins: int = BINS, most: int = TRUSTED_TEXTS) -> DataFrame:
    """`(bin, raw, target)` over all n-grams of `docs`, and of those whose doc_id is in the sample of `trusted(doc_id)`."""
    # at most `most` rows, in the session's memory once
    good = trusted_sample(trusted, most).select(F.col("doc_id").alias("_good"))
    marked = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("_good"), "left").select("text", F.col("_good").isNotNull().alias("good"))
    return (gram_rows(_with_hashes(marked, "good"), bins, "good").groupBy("bin")
            .agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("target")))


def weight_table(counts: DataFrame, bins: int = BINS, smoothing: float = SMOOTHING) -> DataFrame:
    """`(weights)`: one row with `bins` log-likelihood ratios joined by commas, NaN where the shape decides, from `counts(bin, raw, target)`."""
    at_pairs, at_shapes = _parts(bins)
    part = F.when(F.col("bin") < at_pairs, 0).when(F.col("bin") < at_shapes, 1).otherwise(2)
    filled = (F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "target"))
    every = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", part.alias("part"), *filled)
    parts = every.groupBy("part").agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"), (F.median("raw") * LEAST_LOAD).alias("load"))
    expected = F.when(F.col("all_target") > 0, F.col("raw").cast("double") * F.col("all_target") / F.col("all_raw")).otherwise(0.0)
    untold = (F.col("all_target") > 0) & (F.col("part") < 2) & ((F.col("raw") < F.col("load")) | (F.greatest(F.col("target").cast("double"), expected) < LEAST_COUNT))
    weight = F.when(untold, F.lit(float("nan"))).otherwise(F.log((F.col("target") + smoothing) / (expected + smoothing)))
    placed = every.join(F.broadcast(parts), "part").agg(F.array_sort(F.collect_list(F.struct("bin", weight.alias("weight")))).alias("placed"))
    return placed.select(F.array_join(F.transform("placed", lambda x: x["weight"].cast("string")), ",").alias("weights"))


def bin_weights(docs: DataFrame, trusted: DataFrame, bins: int = BINS, smoothing: float = SMOOTHING) -> Column:
    """A constant array of `bins` log-likelihood ratios; the driver sees one text of them only.

    Use it once in a frame: every use is written out in every plan that Spark prints for its listeners.
    """
    counts = written(bin_counts(docs, trusted, bins), "bin-counts")
    return F.split(F.lit(weight_table(counts, bins, smoothing).first()["weights"]), ",").cast("array<double>")


def base_measures(docs: DataFrame, *keep: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to `hashes` and `shapes`."""
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(rf"[^{SPACE}]"))
    starts = F.when(F.size("hashes") >= WINDOW, F.sequence(F.lit(0), F.size("hashes") - WINDOW)).otherwise(F.array().cast("array<int>"))
    empty = "array<struct<win:bigint,at:int>>"
    staged = (
        _with_hashes(docs, *keep)
        .withColumn("wins", F.transform(starts, lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(WINDOW)))))
        .withColumn("repeated", F.when(F.size(F.array_distinct("wins")) < F.size("wins"), F.sort_array(F.arrays_zip(
            F.col("wins").alias("win"), F.sequence(F.lit(0), F.size("wins") - 1).alias("at")))).otherwise(F.array().cast(empty)))
        .withColumn("starts", F.sort_array(F.transform(
            F.filter("repeated", lambda x, i: F.coalesce(F.get("repeated", i - 1)["win"] == x["win"], F.lit(False))
                     | F.coalesce(F.get("repeated", i + 1)["win"] == x["win"], F.lit(False))), lambda x: x["at"])))
        .withColumn("covers", F.transform("starts", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - x, F.lit(WINDOW)))))
    )
    total = F.aggregate("covers", F.lit(0).cast("long"), lambda a, x: a + x)
    long = lambda c: c.cast("long")
    return staged.select(
        *keep, "hashes", "shapes", long(F.size("hashes")).alias("n_words"),
        long(F.length("text") - F.regexp_count("text", F.lit(rf"[{SPACE}]"))).alias("word_chars"),
        long(F.regexp_count("text", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"), total.alias("n_repeat_words"))


def quality_rules(docs: DataFrame, trusted: DataFrame, bins: int = BINS, threshold: float = THRESHOLD, *keep: str) -> DataFrame:
    """Base measures, `kept` and `score` (mean log-likelihood ratio of an n-gram) for every row of `docs(doc_id, text)`.

    keep: further columns to pass on, of names other than those made here.
    """
    measured = base_measures(docs, "doc_id", *keep)

    def total(weights: Column) -> Column:
        def said(h: Column, i: Column) -> Column:
            weight = lambda own, shape: F.nanvl(F.get(weights, own), F.get(weights, shape))
            shape = F.get("shapes", i)
            word = weight(*_word_bins(bins, h, shape))
            pair = weight(*_pair_bins(bins, h, F.get("hashes", i - 1), shape, F.get("shapes", i - 1)))
            return F.when(i > 0, word + pair).otherwise(word)

        return F.aggregate(F.transform("hashes", said), F.lit(0.0), lambda a, w: a + w)

    # handed to the lambda, so that the plan holds the array once
    summed = F.get(F.transform(F.array(bin_weights(docs, trusted, bins)), total), F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    score = F.when(F.size("hashes") > 0, summed / (2 * F.size("hashes") - 1)).otherwise(0.0)
    return (measured.withColumn("score", score).withColumn("base_failed", failed)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score", *keep))


def passing_documents(docs: DataFrame, trusted: DataFrame, bins: int = BINS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the rules keep, all columns; no row is moved."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    judged = quality_rules(whole, trusted, bins, threshold, "_row")
    # the partition number keeps the optimizer from moving the filter, and with it a second copy of every measure, below
    return judged.withColumn("_part", F.spark_partition_id()).filter("kept AND _part >= 0").select("_row.*")
