"""Report texts as long tables, one numbered block per file and rule.

Blocks stay separate rows with their sort keys.  They are never concatenated
per repository, because one repository may hold a third of all findings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.source import with_symbols
from plumbline.functions.text import basename, numbered
from plumbline.operators import comments, flags, language, naming, scopes
from plumbline.policy import DEFAULT_POLICY, AuditPolicy
from plumbline.sources.files import REPO_KEY
from plumbline.sources.shared import checkpointed


def pandas_line(uses: Column, name: Column) -> Column:
    return F.when(uses, F.concat(F.lit("❌ "), name, F.lit(": yes"))).otherwise(F.concat(F.lit("✅ "), name, F.lit(": no")))


def file_blocks(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """Blocks of the verb, import, comment, variable and pandas rules, from one scan of the bodies.

    Of variables and pandas the block of the last file of a base name stays, under that name and without a file
    order; a file of the pandas scope that is absent counts as one without pandas.
    """
    scoped, in_variables, in_pandas = scopes.in_verb_scope(), F.size(scopes.variable_entries()) > 0, F.size(scopes.pandas_entries()) > 0
    base, first = basename(F.col("path")), F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("pos"))
    names = naming.verb_variables(F.col("assigned"), policy)

    def last(entries: Column) -> Column:
        entry = F.array_max(entries)
        return F.struct(entry["scope_part"].cast("int").alias("part"), entry["scope_pos"].cast("bigint").alias("pos"))

    rules = (
        ("verbs", F.col("path"), first, F.when(scoped, naming.verb_block(F.col("functions"), policy))),
        ("imports", F.col("path"), first, naming.udf_block(policy)),
        ("comments", F.col("path"), first, comments.comment_block()),
        ("variables", base, last(scopes.variable_entries()), F.when(in_variables & (F.size(names) > 0), F.concat(base, F.lit(":\n"), numbered(names, indent="  ")))),
        ("pandas", base, last(scopes.pandas_entries()), F.when(in_pandas, pandas_line(flags.imports_pandas(), base))),
    )
    rows = F.array(*(F.struct(
        F.lit(rule).alias("rule_id"), key.alias("path"), order.alias("order"),
        F.when(~F.lit(rule).isin("variables", "pandas"), F.col("file_ord")).alias("file_ord"), block.alias("block"),
    ) for rule, key, order, block in rules))
    found = with_symbols(files, scoped | in_variables, headers_only=True).select(*REPO_KEY, F.inline_outer(rows)).filter(F.col("block").isNotNull())
    name = basename(F.col("path"))
    absent = scopes.missing_paths(files, scopes.PANDAS_FIXED).select(
        *REPO_KEY, F.lit("pandas").alias("rule_id"), name.alias("path"),
        F.struct(F.lit(2).alias("part"), F.col("scope_pos").cast("bigint").alias("pos")).alias("order"),
        F.lit(None).cast("bigint").alias("file_ord"), pandas_line(F.lit(False), name).alias("block"))
    kept = found.unionByName(absent).groupBy(*REPO_KEY, "rule_id", "path").agg(F.max_by(F.struct("file_ord", "block"), "order").alias("kept"))
    return kept.select(*REPO_KEY, "path", "kept.file_ord", "rule_id", "kept.block")


def findings_text(files: DataFrame, words: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """The texts of the six scorecard cells that only count findings; the bodies are scanned twice.

    Language blocks have their place in the language scope for a file order.
    """
    spoken = language.language_report(files, words, policy).filter("n_findings > 0").select(
        *REPO_KEY, "path", F.col("scope_pos").cast("bigint").alias("file_ord"), F.lit("language").alias("rule_id"), "block")
    return file_blocks(files, policy).unionByName(spoken)


def running_numbers(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "number") -> DataFrame:
    """Adds 1, 2, ... within each group, in the given order, without gathering a group in one task.

    The rows are dealt by ranges of (group, order); each range numbers its own, and what lies before it in the group is
    the sum of the counts of earlier ranges. The window passes one row a range and group.
    """
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    # both readers below must see the same ranges
    placed = checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    ranges = placed.groupBy(*group, "_range").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    for column in (*group, "_range"):
        starts = starts.withColumnRenamed(column, f"_own_{column}")
    same = F.col("_range") == F.col("_own__range")
    for column in group:
        same &= F.col(column).eqNullSafe(F.col(f"_own_{column}"))
    return placed.join(starts, same).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))


def numbered_findings(found: DataFrame) -> DataFrame:
    """Every finding with its running number in its repository and rule."""
    return running_numbers(found, (*REPO_KEY, "rule_id"), ("path", "seq", "line_no", "detail"))


def write_report(blocks: DataFrame, path: str, sort_by: tuple[str, ...] = ("file_ord",)) -> None:
    """Write blocks so that files read in name order give each repository's report in order.

    Range partitioning includes the sort keys, so a huge repository spans
    several output files instead of one task.
    """
    keys = [*REPO_KEY, *sort_by]
    blocks.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
