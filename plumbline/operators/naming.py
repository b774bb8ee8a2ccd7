"""Verb rules for functions and variables, and forbidden imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.source import with_symbols
from plumbline.functions.text import any_of, basename, let, numbered, strip
from plumbline.operators import scopes
from plumbline.policy import DEFAULT_POLICY, AuditPolicy
from plumbline.sources.files import FILE_KEY, REPO_KEY


def starts_with_verb(name: Column, policy: AuditPolicy) -> Column:
    return F.substring_index(name, "_", 1).isin(*policy.verbs)


def breaks_verb_rule(name: Column, policy: AuditPolicy) -> Column:
    """Ordinary functions: a verb first, and the infix some verbs need."""
    prefix = F.substring_index(name, "_", 1)
    lacks_infix = any_of((prefix == verb) & ~name.contains(infix) for verb, infix in policy.required_infixes)
    return ~prefix.isin(*policy.verbs) | lacks_infix


def breaks_test_rule(name: Column, policy: AuditPolicy) -> Column:
    """Test functions: ``test_`` first, then a verb."""
    second = F.split_part(name, F.lit("_"), F.lit(2))
    return ~name.startswith("test_") | ~second.isin(*policy.verbs)


def checked_functions(names: Column, policy: AuditPolicy) -> Column:
    """Functions left to check: fixed names are not, nor the first of a test file in a walk through its syntax tree."""
    order = lambda f: F.struct(f["depth"], f["pos"])
    first = F.array_min(F.transform(names, order))
    kept = F.when(scopes.is_test_file(), F.filter(names, lambda f: order(f) != first)).otherwise(names)
    return F.filter(kept, lambda f: ~f["name"].isin(*policy.ignored_functions))


def bad_functions(names: Column, policy: AuditPolicy) -> Column:
    """The badly named ones of an array of functions; ``names`` must be a column."""
    checked = checked_functions(names, policy)
    is_bad = lambda f: F.when(
        scopes.is_test_file(), breaks_test_rule(f["name"], policy)
    ).otherwise(breaks_verb_rule(f["name"], policy))
    return F.filter(checked, is_bad)


def _verb_files(files: DataFrame) -> DataFrame:
    return with_symbols(files.filter(scopes.in_verb_scope()), F.lit(True))


def _violations(files: DataFrame, policy: AuditPolicy) -> DataFrame:
    return _verb_files(files).select(
        *FILE_KEY, F.inline_outer(bad_functions(F.col("functions"), policy))
    ).filter(F.col("pos").isNotNull()).select(*FILE_KEY, F.col("pos").alias("fn_pos"), F.col("name").alias("fn_name"))


def fn_verb_violations(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    return _violations(files.filter(~scopes.is_test_file()), policy)


def test_fn_violations(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    return _violations(files.filter(scopes.is_test_file()), policy)


def test_fn_skip_first(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """Functions of test files that remain to be checked."""
    return _verb_files(files.filter(scopes.is_test_file())).select(
        *FILE_KEY, F.inline_outer(checked_functions(F.col("functions"), policy))
    ).filter(F.col("pos").isNotNull()).select(*FILE_KEY, F.col("pos").alias("fn_pos"), F.col("name").alias("fn_name"))


def verb_block(names: Column, policy: AuditPolicy) -> Column:
    """Numbered block of one file's badly named functions; null when there are none."""
    bad = F.array_sort(F.transform(bad_functions(names, policy), lambda f: f["name"]))
    return F.when(
        F.size(bad) > 0, F.concat(basename(F.col("path")), F.lit(":\n"), numbered(bad, indent="    "))
    )


def blocks_or_ok(blocks: DataFrame) -> DataFrame:
    """Report rows: every file block, and one 'OK' row per repository without any.

    Blocks stay one row per file, ordered by (sort_name, file_ord); they are
    never gathered per repository.  ``blocks`` has a null block for clean files.
    Each file also feeds a counter of its repository, in the same aggregation,
    so bodies are scanned once and a huge repository is pre-counted per task.
    """
    found = F.col("block").isNotNull()
    entries = F.array_compact(F.array(
        F.when(found, F.struct("sort_name", "file_ord", "block", F.lit(0).alias("n"))),
        F.struct(F.lit(None).cast("string").alias("sort_name"), F.lit(None).cast("bigint").alias("file_ord"),
                 F.lit(None).cast("string").alias("block"), found.cast("int").alias("n")),
    ))
    rows = blocks.select(*REPO_KEY, F.inline(entries)).groupBy(*REPO_KEY, "sort_name", "file_ord").agg(
        F.max("block").alias("block"), F.sum("n").alias("n")
    )
    return rows.filter(F.col("file_ord").isNotNull() | (F.col("n") == 0)).select(
        *REPO_KEY, F.coalesce("sort_name", F.lit("")).alias("sort_name"),
        F.coalesce("file_ord", F.lit(0)).alias("file_ord"), F.coalesce("block", F.lit("OK")).alias("block"),
    )


def with_listing(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of the files in scope, and an empty row for every listed file; no body is read for these."""
    return blocks.unionByName(files.select(*REPO_KEY), allowMissingColumns=True)


def fn_verb_report(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    return blocks_or_ok(with_listing(files, _verb_files(files).select(
        *REPO_KEY, basename(F.col("path")).alias("sort_name"), "file_ord",
        verb_block(F.col("functions"), policy).alias("block"),
    )))


def verb_variables(assigned: Column, policy: AuditPolicy) -> Column:
    """Assigned names that start with a verb, duplicates kept, in the order of a walk through the syntax tree."""
    return F.filter(F.transform(F.array_sort(assigned), lambda a: a["name"]), lambda name: starts_with_verb(name, policy))


def variable_verb_violations(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """Verb-named variables per base name; the last file of a name that has any wins."""
    entries = files.withColumn("entries", scopes.variable_entries()).filter(F.size("entries") > 0)
    found = with_symbols(entries, F.lit(True)).select(
        *REPO_KEY, basename(F.col("path")).alias("basename"), F.array_max("entries").alias("scope"),
        verb_variables(F.col("assigned"), policy).alias("names"),
    )
    has_names = F.when(F.size("names") > 0, F.col("scope"))
    return (
        found.groupBy(*REPO_KEY, "basename").agg(F.max_by("names", has_names).alias("names"))
        .select(*REPO_KEY, "basename", F.posexplode("names").alias("pos", "name"))
        .select(*REPO_KEY, "basename", (F.col("pos") + 1).alias("seq"), "name")
    )


def udf_hits(policy: AuditPolicy) -> Column:
    """array<struct<line_no, label>>: forbidden imports on lines that are not comments."""
    def labels(text: Column) -> Column:
        found = F.array_compact(F.array(*(
            F.when(text.rlike(pattern), F.lit(label)) for pattern, label in policy.udf_imports
        )))
        return F.when(text.startswith("#"), F.array().cast("array<string>")).otherwise(found)

    def line_hits(line: Column, i: Column) -> Column:
        return F.transform(
            let(strip(line), labels),
            lambda label: F.struct((i + 1).alias("line_no"), label.alias("label")),
        )

    return F.flatten(F.transform(F.split("content", "\n", -1), line_hits))


def may_import_udf(policy: AuditPolicy) -> Column:
    """Cheap whole-body test that every file with a hit passes."""
    return F.col("content").rlike("|".join(f"(?:{pattern})" for pattern, _ in policy.udf_imports))


def udf_import_hits(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    scoped = files.filter(scopes.in_udf_scope()).filter(may_import_udf(policy))
    return scoped.select(*FILE_KEY, F.posexplode(udf_hits(policy)).alias("pos", "hit")).select(
        *FILE_KEY, (F.col("pos") + 1).alias("seq"), "hit.line_no", "hit.label"
    )


def udf_block(policy: AuditPolicy) -> Column:
    hits = F.when(scopes.in_udf_scope() & may_import_udf(policy), udf_hits(policy))
    labels = F.transform(hits, lambda hit: hit["label"])
    return F.when(
        F.size(labels) > 0, F.concat(basename(F.col("path")), F.lit(":\n"), numbered(labels, indent="    "))
    )


def udf_report(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """Blocks in listing order; the sort name is constant."""
    return blocks_or_ok(with_listing(files, files.filter(scopes.in_udf_scope()).select(
        *REPO_KEY, F.lit("").alias("sort_name"), "file_ord", udf_block(policy).alias("block")
    )))
