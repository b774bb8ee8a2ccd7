"""Exact duplicates by an extendible-hash index whose entries are checked byte by byte.

1. Every document becomes a key `(doc_id, h, sha256)` in an index table in the shared folder.
2. The directory doubles until no bucket (a prefix of the hash) holds more than `capacity` different hashes, hot ones
   apart; its depth therefore follows the number of keys, without a limit. It is the prefix itself, so that no table of
   buckets is looked up; hashes fill buckets evenly, so that all are split alike. A hot hash, that of more than `capacity` keys and of at least 1 / `HOT_BOUND` of all, gets
   overflow pages of `capacity` keys by doc_id; there are at most `HOT_BOUND` of them, which are broadcast.
3. Texts are sent to the owner of their (bucket, page). Within one, equal hashes form a chain; the
   grouping on (h, text) compares whole texts byte by byte. Equal texts share a bucket, so their bytes are compared
   at every size; only the pages of one hot hash are merged by (h, sha256).

Built-in functions only. Null texts count as empty; an empty table gives an empty result. Rows that
repeat a doc_id count one by one in `group_size`. A null doc_id never becomes `keep_id` unless all
of its group are null. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Runs that differ from one space; a single space needs no replacement.
_UNEVEN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
CAPACITY = 256
HOT_BOUND = 100_000
#: A hash has this many bits; more doublings than this never help.
BITS = 64


def normalised(text):
    """White-space runs to one space; null to empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN, " ")


def _prefix(depth: int):
    """The bucket of a key: a one followed by the first `depth` bits of its hash, so that depths never meet."""
    return F.expr(f"shiftrightunsigned(h, {BITS} - {depth}) + (1L << {depth})") if depth else F.lit(1).cast("long")


def hot_hashes(keys: DataFrame, capacity: int = CAPACITY, bound: int = HOT_BOUND) -> DataFrame:
    """`(h, pages)` of hashes that overfill a bucket alone; at most `bound` rows."""
    total = keys.count()
    counts = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(capacity + 1, -(-total // bound)))
    return written(counts.select("h", F.ceil(F.col("n") / capacity).cast("long").alias("pages")), "exact-hot")


def depth_of(keys: DataFrame, hot: DataFrame, capacity: int = CAPACITY) -> int:
    """Doublings until every bucket fits; the count starts it near its end, since a hash fills buckets evenly."""
    cold = keys.join(F.broadcast(hot.select("h")), "h", "left_anti").select("h").distinct()
    n = cold.count()
    depth = max(0, (2 * n // capacity).bit_length() - 1)
    while depth < BITS - 2 and n > capacity:
        fullest = cold.groupBy(_prefix(depth)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if fullest <= capacity:
            break
        depth += 1
    return depth


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", normalised(F.col("text")).alias("body")).withColumn("h", F.xxhash64("body"))


def _chains(texts: DataFrame, keys: DataFrame, capacity: int, bound: int) -> DataFrame:
    """`(bucket, page, h, text_sha256, first, n)`: equal texts of every owner, found by their bytes."""
    hot = hot_hashes(keys, capacity, bound)
    placed = texts.withColumn("bucket", _prefix(depth_of(keys, hot, capacity))).join(F.broadcast(hot), "h", "left")
    page = F.when(F.col("pages").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("pages")))
    owned = placed.select("bucket", page.alias("page"), "h", "body", "doc_id").repartition("bucket", "page")
    return (owned.groupBy("bucket", "page", "h", "body").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
            .select("bucket", "page", "h", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), "first", "n"))


def _groups(docs: DataFrame, capacity: int, bound: int) -> DataFrame:
    texts = _texts(docs)
    keys = written(texts.select("doc_id", "h", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")), "exact-keys")
    # written, so that the session may split the keys of a hot text in the join below
    groups = written(_chains(texts, keys, capacity, bound).groupBy("h", "text_sha256").agg(F.min("first").alias("keep_id"), F.sum("n").alias("group_size")), "exact-groups")
    return keys.join(groups, ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "h")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, bound: int = HOT_BOUND) -> DataFrame:
    """`(doc_id, keep_id, group_size, kept, text_sha256)` for every row of `docs(doc_id, text)`."""
    return _groups(docs, capacity, bound).drop("h")


def distinct_documents(docs: DataFrame, capacity: int = CAPACITY, bound: int = HOT_BOUND) -> DataFrame:
    """The rows of `docs` that stay, all columns; of rows with equal doc_id and text one stays.

    Two different texts under one doc_id both stay.
    """
    stays = written(_groups(docs, capacity, bound).filter("kept").groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("_n")), "exact-stays")
    rows = docs.withColumn("_hash", F.xxhash64(normalised(F.col("text"))))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))
    once = rows.join(stays.filter("_n = 1"), same, "left_semi")
    repeated = stays.filter("_n > 1")
    if repeated.isEmpty():
        return once.drop("_hash")
    return once.union(rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_hash"])).drop("_hash")


EXACT_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
WINDOW g AS (PARTITION BY body)
"""
