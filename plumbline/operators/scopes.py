"""Which files each rule looks at; only paths are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import basename
from plumbline.policy import FLAG_FRAGMENTS, UDF_FILE_PATTERNS, VERB_FILE_PATTERNS
from plumbline.sources.files import FILE_KEY, REPO_KEY, fixed_position, missing_paths

LANGUAGE_FIXED = (
    ("utils/utils.py", True), ("app.py", True), ("fields.py", True), ("constants.py", True),
    ("tests/transformations/test_transformations.py", False),
    ("tests/utils/test_utils.py", False), ("tests/test_app.py", False),
)
VARIABLE_FIXED = (
    ("utils/utils.py", True), ("app.py", True), ("fields.py", True), ("constants.py", True),
    ("tests/utils/test_utils.py", False), ("tests/test_app.py", False),
)
PANDAS_FIXED = (("utils/utils.py", True),)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def flag_matches() -> Column:
    """Number of flag fragments in the path."""
    return F.expr(" + ".join(f"cast(contains(path, {_sql(f)}) AS int)" for f in FLAG_FRAGMENTS))


def in_flag_scope() -> Column:
    return F.expr(" OR ".join(f"contains(path, {_sql(f)})" for f in FLAG_FRAGMENTS))


def in_verb_scope() -> Column:
    return basename(F.col("path")).rlike("|".join(VERB_FILE_PATTERNS))


def in_udf_scope() -> Column:
    return basename(F.col("path")).rlike("|".join(UDF_FILE_PATTERNS))


def is_fields_file() -> Column:
    return F.col("path").endswith("fields.py")


def is_test_file() -> Column:
    path = F.col("path")
    return path.startswith("test_") | path.contains("/test") | path.contains("\\test")


def is_python() -> Column:
    return F.col("path").endswith(".py")


def main_glob() -> Column:
    return F.col("path").rlike(r"^(?s:.*)/transformations/transformations(?s:.*)\.py$")


def test_glob() -> Column:
    return F.col("path").rlike(r"^(?s:.*)tests/transformations/test_transformations(?s:.*)\.py$")


def below_transformations() -> Column:
    return F.contains(F.col("path"), F.concat("repo", F.lit("/transformations/"))) & basename(
        F.col("path")
    ).contains("transformations")


def scope_entries(globs: list[Column], fixed: tuple[tuple[str, bool], ...]) -> Column:
    """array<struct<scope_part, scope_pos>>: every place a present file has in a scope list."""
    position = fixed_position(fixed)
    entries = [
        F.when(test, F.struct(F.lit(i).alias("scope_part"), F.col("file_ord").alias("scope_pos")))
        for i, test in enumerate(globs)
    ]
    entries.append(
        F.when(position.isNotNull(), F.struct(
            F.lit(len(globs)).alias("scope_part"), position.cast("bigint").alias("scope_pos")))
    )
    return F.array_compact(F.array(*entries))


def language_entries() -> Column:
    return scope_entries([below_transformations()], LANGUAGE_FIXED)


def variable_entries() -> Column:
    return scope_entries([main_glob(), test_glob()], VARIABLE_FIXED)


def pandas_entries() -> Column:
    return scope_entries([main_glob(), test_glob()], PANDAS_FIXED)


def scope_list(files: DataFrame, entries: Column, n_globs: int, fixed: tuple[tuple[str, bool], ...]) -> DataFrame:
    """A scope as rows, absent fixed files included."""
    present = files.select(*FILE_KEY, F.inline(entries), F.lit(False).alias("is_missing"))
    absent = missing_paths(files, fixed).select(
        *FILE_KEY, F.lit(n_globs).alias("scope_part"), "scope_pos", F.lit(True).alias("is_missing")
    )
    return present.unionByName(absent)


def scope_flags(files: DataFrame) -> DataFrame:
    return files.filter(in_flag_scope()).select(*FILE_KEY, flag_matches().alias("n_matches"))


def scope_verbs(files: DataFrame) -> DataFrame:
    return files.filter(in_verb_scope()).select(*FILE_KEY)


def scope_udf(files: DataFrame) -> DataFrame:
    return files.filter(in_udf_scope()).select(*FILE_KEY)


def pick_fields_file(files: DataFrame) -> DataFrame:
    """The first fields file of each listing."""
    return files.filter(is_fields_file()).groupBy(*REPO_KEY).agg(F.min_by("path", "file_ord").alias("path"))


def scope_language(files: DataFrame) -> DataFrame:
    return scope_list(files, language_entries(), 1, LANGUAGE_FIXED)


def scope_globs(files: DataFrame) -> DataFrame:
    tests = F.array_compact(F.array(F.when(main_glob(), "main"), F.when(test_glob(), "test")))
    return files.select(*FILE_KEY, F.explode(tests).alias("glob"))


def scope_variables(files: DataFrame) -> DataFrame:
    return scope_list(files, variable_entries(), 2, VARIABLE_FIXED)


def scope_pandas(files: DataFrame) -> DataFrame:
    return scope_list(files, pandas_entries(), 2, PANDAS_FIXED)


def test_files(files: DataFrame) -> DataFrame:
    return files.select(*FILE_KEY, is_test_file().alias("is_test"))
