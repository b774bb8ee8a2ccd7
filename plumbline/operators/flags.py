"""Content flags: substring and regex tests over whole file bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import contains_any
from plumbline.operators import scopes
from plumbline.policy import DEFAULT_POLICY, AuditPolicy
from plumbline.sources.files import FILE_KEY, REPO_KEY, fixed_path, repo_facts

SALTS = 64


def _body() -> Column:
    return F.col("content")


def reads_spark() -> Column:
    return _body().contains("spark.read.")


def writes_spark(policy: AuditPolicy) -> Column:
    return _body().contains(".write.") & ~_body().contains(policy.sanctioned_writer)


def uses_hadoop() -> Column:
    return _body().contains("apache.hadoop")


def conf_reads_object() -> Column:
    """An '=' left in the configuration once ' = ' is taken out."""
    return F.replace(_body(), F.lit(" = "), F.lit("")).contains("=")


def code_reads_object() -> Column:
    """An '=' left in the code once ' = ' and then '==' are taken out."""
    return F.replace(F.replace(_body(), F.lit(" = "), F.lit("")), F.lit("=="), F.lit("")).contains("=")


def compacts() -> Column:
    return contains_any(_body(), (".coalesce(", "compact"))


def uses_base_path() -> Column:
    return contains_any(_body(), ("base_path", "full_path"))


def has_logic() -> Column:
    return contains_any(_body(), ("if ", "for ", "else "))


def imports_pandas() -> Column:
    return _body().rlike(r"(?m)^\s*import\s+pandas") | _body().rlike(r"(?m)^\s*from\s+pandas")


def is_conf() -> Column:
    return F.col("path") == "resources/application.conf"


def is_app() -> Column:
    return F.col("path") == fixed_path("app.py", True)


def flag_rows(files: DataFrame, flag: Column) -> DataFrame:
    """One row per file in the flag scope."""
    return files.filter(scopes.in_flag_scope()).select(*FILE_KEY, flag.alias("flagged"))


def partition_read(files: DataFrame, salts: int = SALTS) -> DataFrame:
    """The object-read flag of each scoped file, its repository's configuration included.

    Only booleans are joined.  The join key carries a salt, so the files of one
    huge repository spread over ``salts`` tasks while its single configuration
    row is repeated once per salt.
    """
    conf = files.filter(is_conf()).groupBy(*REPO_KEY).agg(F.bool_or(conf_reads_object()).alias("conf_flag"))
    conf = conf.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    code = files.filter(scopes.in_flag_scope()).select(
        *FILE_KEY, code_reads_object().alias("code_flag"),
        F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int").alias("salt"),
    )
    return code.join(conf, [*REPO_KEY, "salt"], "left").select(
        *FILE_KEY, (F.coalesce("conf_flag", F.lit(False)) | F.col("code_flag")).alias("flagged")
    )


def app_logic(files: DataFrame) -> DataFrame:
    """Whether the entry file of each repository holds control flow."""
    facts = repo_facts(files, F.col("path").endswith("/app.py") & is_app(), has_logic().alias("found"))
    return facts.groupBy(*REPO_KEY).agg(F.coalesce(F.bool_or("found"), F.lit(False)).alias("has_logic"))


def pandas_rows(files: DataFrame) -> DataFrame:
    """Every entry of the pandas scope; an absent file does not use pandas."""
    scoped = files.withColumn("entries", scopes.pandas_entries()).filter(F.size("entries") > 0)
    present = scoped.select(*FILE_KEY, F.inline("entries"), imports_pandas().alias("uses_pandas"))
    absent = scopes.missing_paths(files, scopes.PANDAS_FIXED).select(
        *FILE_KEY, F.lit(2).alias("scope_part"), "scope_pos", F.lit(False).alias("uses_pandas")
    )
    return present.unionByName(absent)


def pandas_by_basename(files: DataFrame) -> DataFrame:
    """Later entries of the pandas scope replace earlier ones of the same base name."""
    order = F.struct("scope_part", "scope_pos")
    return (
        pandas_rows(files)
        .groupBy(*REPO_KEY, F.substring_index("path", "/", -1).alias("basename"))
        .agg(F.max_by("uses_pandas", order).alias("uses_pandas"))
    )


def pandas_file_count(files: DataFrame) -> DataFrame:
    return pandas_by_basename(files).groupBy(*REPO_KEY).agg(
        F.count_if("uses_pandas").alias("n_pandas_files")
    )


def flags_by_repo(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """The six sticky flags per repository, from one scan of the bodies in scope and one aggregation."""
    scoped = scopes.in_flag_scope()
    facts = {
        "spark_read": reads_spark(), "hadoop": uses_hadoop(), "code_object": code_reads_object(),
        "spark_write": writes_spark(policy), "compaction": compacts(), "base_path": uses_base_path(), "in_scope": F.lit(True),
    }
    rows = repo_facts(
        files, scoped | is_conf(), *(F.when(scoped, flag).alias(name) for name, flag in facts.items()),
        F.when(is_conf(), conf_reads_object()).alias("conf_object"),
    )
    conf = F.coalesce(F.bool_or("conf_object"), F.lit(False))
    some = lambda name: F.bool_or(name).alias(name)
    return rows.groupBy(*REPO_KEY).agg(
        some("spark_read"), some("hadoop"),
        (F.bool_or("code_object") | (conf & F.bool_or("in_scope"))).alias("partition_read"),
        some("spark_write"), some("compaction"), some("base_path"),
        F.when(F.bool_or("in_scope"), "OK").otherwise("NO_SCOPE_FILES").alias("audit_status"),
    )
