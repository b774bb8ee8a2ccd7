"""Mixing sources to target weights by Pareto order sampling.

A source with target `t` and `S` words gives every document `floor(t / S)` certain whole copies. The
remaining share `f = t / S - floor(t / S)` is drawn without replacement: a document has inclusion
probability `p = f * w` (held within 0.0001 and 0.9999), where `w = 2 m / (m + size)` favours
documents below the source's mean size `m`, so that a sample of few words still holds many texts.
Documents are ranked by random odds divided by inclusion odds, `u / (1 - u) * (1 - p) / p`, and taken in that
order up to the document that comes nearest to the source's remaining words. The random number is an MD5 of the
seed and doc_id, so reruns agree.

The cut is found without sorting a source: ranks become numbers in (0, 1), words are summed per
(source, 1/1024 of the range), and only the interval that holds the cut is divided again, three
times; what is left of it is ranked exactly. A hot source is thus summed by all tasks.

Defined results: null text has size 0; the null source is a source of its own, last in order; rows
with equal rank (the same doc_id) are taken together or not at all; an empty table gives an empty
result; a source without words takes no copy. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, written

#: No document is used more often than this.
MOST_COPIES = 3
SPLIT = 1024
LEVELS = 3


def targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """`(source, n_docs, source_size, target)`; weights 1, 2, 3 repeat over the sources by code point, null last.

    A source is full at `most` times its words. With full sources ordered by words per weight, the
    others share what is left by weight; the first position where none of those is above its limit
    gives the level. One row per source passes the windows.
    """
    sums = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sums.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("per", F.lit(most) * F.col("source_size") / F.col("weight"))
    rising = Window.orderBy("per", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    levelled = (weighed
                .withColumn("left", F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(rising), F.lit(0)))
                .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0)))
                .withColumn("level", F.col("left") / F.col("open"))
                .withColumn("at", F.min(F.when(F.col("level") <= F.col("per"), F.col("per"))).over(everything))
                .withColumn("final", F.max(F.when((F.col("level") <= F.col("per")) & (F.col("per") == F.col("at")), F.col("level"))).over(everything)))
    full = F.lit(float(most)) * F.col("source_size")
    return levelled.select("source", "n_docs", "source_size", F.least(full, F.col("final") * F.col("weight")).alias("target"))


def ranked(docs: DataFrame, seed: str, most: int) -> DataFrame:
    """One row per document with its certain copies, the source's words left to draw, and its rank in (0, 1)."""
    sizes = written(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")), "mix-sizes")
    by_source = targets(sizes, most).withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 12)
    joined = sizes.join(by_source, sizes["source"].eqNullSafe(by_source["of"])).drop("of")
    # the operators below are plain arithmetic, so that SQL gives the same doubles
    return (joined.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio")).withColumn("share", F.col("ratio") - F.col("whole"))
            .withColumn("mean", F.col("source_size") / F.col("n_docs"))
            .withColumn("p", F.greatest(F.lit(0.0001), F.least(F.lit(0.9999), F.when(F.col("mean") > 0, F.col("share") * (2.0 * F.col("mean") / (F.col("mean") + F.col("size")))).otherwise(0.0))))
            .withColumn("u", (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48)))
            .withColumn("odds", F.col("u") / (1.0 - F.col("u")) * ((1.0 - F.col("p")) / F.col("p")))
            .select("doc_id", "source", "size", "source_size", "target", "whole", (F.col("source_size") * F.col("share")).alias("room"),
                    (F.col("odds") / (1.0 + F.col("odds"))).alias("rank")))


def pareto_mix(docs: DataFrame, seed: str = "mix", most: int = MOST_COPIES) -> DataFrame:
    """`(doc_id, source, size, source_size, target, copies, taken)` for every row of `docs(doc_id, source, text)`."""
    rows = written(ranked(docs, seed, most).withColumn("cell", F.floor(F.col("rank") * (SPLIT ** LEVELS)).cast("long")), "mix-ranks")
    cuts = rows.select("source", "room").distinct().select(F.col("source").alias("of"), F.lit(0).cast("long").alias("head"), "room")
    for level in range(LEVELS):
        # `head`: the interval of the cut so far; `room`: words left when it begins
        below, own = SPLIT ** (LEVELS - level), SPLIT ** (LEVELS - level - 1)
        inside = rows.join(cuts, rows["source"].eqNullSafe(cuts["of"]) & (F.floor(F.col("cell") / below) == F.col("head"))).select("of", F.floor(F.col("cell") / own).alias("part"), "size")
        words = inside.groupBy("of", "part").agg(F.sum("size").alias("words"))
        running = Window.partitionBy("of").orderBy("part")
        over = F.col("after") > F.col("room")
        first = (words.withColumn("after", F.sum("words").over(running)).withColumnRenamed("of", "_of")
                 .join(cuts, F.col("_of").eqNullSafe(F.col("of"))).groupBy("_of")
                 .agg(F.min(F.when(over, F.struct("part", (F.col("room") - F.col("after") + F.col("words")).alias("rest")))).alias("first")))
        # an interval that fits whole leaves the cut past its end
        cuts = written(cuts.join(first, F.col("of").eqNullSafe(F.col("_of")), "left").select(
            "of", F.coalesce("first.part", (F.col("head") + 1) * SPLIT - 1).alias("head"),
            F.coalesce("first.rest", "room").alias("room")), "mix-cuts")
    near = rows.join(cuts.withColumnRenamed("room", "rest"), rows["source"].eqNullSafe(cuts["of"]), "left").drop("of")
    decided = near.withColumn("in_cut", F.col("cell") == F.col("head")).withColumn("drawn", F.col("cell") < F.coalesce(F.col("head"), F.lit(0)))
    exactly = Window.partitionBy("source").orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = decided.filter("in_cut").withColumn("drawn", F.sum("size").over(exactly) - F.col("size") * 0.5 <= F.col("rest"))
    both = decided.filter(~F.coalesce(F.col("in_cut"), F.lit(False))).unionByName(last)
    copies = (F.col("whole") + F.when(F.col("drawn"), 1).otherwise(0)).cast("long")
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it.

    The mix decides by doc_id; a doc_id that is repeated in `docs` counts as its rows.
    """
    mix = pareto_mix(docs, **options).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies"))
    times = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return (docs.join(mix.filter("_copies > 0"), F.col("doc_id").eqNullSafe(F.col("_id")))
            .select(*[docs[c] for c in docs.columns], times.alias("_copy")).drop("_copy"))


MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sums AS (SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, 3 * source_size / weight AS per FROM (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sums)),
levelled AS (SELECT *, l / o AS level FROM (SELECT *,
  sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER r, 0) AS l,
  sum(weight) OVER () - coalesce(sum(weight) OVER r, 0) AS o
  FROM weighed WINDOW r AS (ORDER BY per, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
leveled2 AS (SELECT *, (SELECT max(level) FROM levelled WHERE level <= per AND per = (SELECT min(per) FROM levelled WHERE level <= per)) AS final FROM levelled),
t AS (SELECT source, n_docs, source_size, least(3.0::DOUBLE * source_size, final * weight)::DOUBLE AS target FROM leveled2),
r AS (SELECT doc_id, s.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio,
  source_size / n_docs AS mean,
  (('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sizes s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS share, greatest(0.0001::DOUBLE, least(0.9999::DOUBLE, CASE WHEN mean > 0
  THEN (ratio - floor(ratio)) * (2.0::DOUBLE * mean / (mean + size)) ELSE 0.0 END)) AS p FROM r),
o AS (SELECT *, u / (1.0::DOUBLE - u) * ((1.0::DOUBLE - p) / p) AS odds FROM p),
d AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds / (1.0::DOUBLE + odds) RANGE UNBOUNDED PRECEDING) - size * 0.5::DOUBLE <= source_size * share AS drawn FROM o)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN drawn THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM d
"""
