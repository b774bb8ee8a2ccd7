"""Configuration-file, documentation and version checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import split_lines, strip
from plumbline.operators.flags import is_conf
from plumbline.policy import DEFAULT_POLICY, AuditPolicy
from plumbline.sources.files import REPO_KEY, fixed_path, is_one_of, repo_facts

NOT_FOUND = "version not found"


def conf_chars() -> Column:
    """Characters from the first brace on, line ends counted as two; 0 without a brace."""
    body = F.col("content")
    start = F.instr(body, F.lit("{"))
    tail = F.substr(body, start)
    breaks = F.length(tail) - F.length(F.replace(tail, F.lit("\n"), F.lit("")))
    return F.when(start > 0, F.length(tail) + breaks).otherwise(0)


def conf_schema_state(policy: AuditPolicy) -> Column:
    """0 clean, 1 forbidden value under a top-level schema key, 2 unbalanced braces.

    Folds over the lines of one file with the running brace depth; a later
    value of the same key replaces an earlier one.
    """
    body = F.col("content")
    top = F.when(strip(body).startswith("{"), 1).otherwise(0)
    lines = F.transform(
        split_lines(body),
        lambda raw: F.struct(
            F.regexp_replace(raw, F.lit(r'("(?:[^"\\]|\\.)*+")|(?:#|//)[^\n]*'), F.lit("$1")).alias("raw"),
            F.regexp_replace(
                F.regexp_replace(raw, F.lit(r'"(?:[^"\\]|\\.)*+"'), F.lit('"')), F.lit(r"(?:#|//)[^\n]*"), F.lit("")
            ).alias("code"),
        ),
    )
    key_pattern = r'^[ \t]*"?([^"=:.{}\[\],]*?)"?[ \t]*[=:]'
    state = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("lowest"),
        F.array().cast("array<string>").alias("bad"),
    )

    def step(acc: Column, line: Column) -> Column:
        code = line["code"]
        key = F.regexp_extract(line["raw"], key_pattern, 1)
        value = strip(F.regexp_extract(line["raw"], r"^[^=:]*[=:](.*)$", 1))
        applies = (acc["depth"] == top) & code.rlike("[=:]") & F.upper(key).contains("SCHEMA") & ~value.rlike(r"^[\[{]")
        is_bad = value.contains(policy.forbidden_schema_value)
        others = F.array_remove(acc["bad"], key)
        opened = F.length(F.regexp_replace(code, "[^{]", ""))
        closed = F.length(F.regexp_replace(code, "[^}]", ""))
        depth = acc["depth"] + opened - closed
        return F.struct(
            depth.alias("depth"),
            F.least(acc["lowest"], depth).alias("lowest"),
            F.when(applies & is_bad, F.concat(others, F.array(key)))
            .when(applies, others).otherwise(acc["bad"]).alias("bad"),
        )

    def finish(acc: Column) -> Column:
        return (
            F.when((acc["depth"] != 0) | (acc["lowest"] < 0), 2)
            .when(F.size(acc["bad"]) > 0, 1).otherwise(0)
        )

    return F.aggregate(lines, state, step, finish)


def has_key_suffix(suffix: str) -> Column:
    """Some 'key = value' line has a key ending in the suffix, in any case."""
    return F.col("content").rlike(rf"(?im)^[^=\r\n]*{suffix}[ \t\f]*=")


def _fixed(path: str, below: bool = False) -> Column:
    return F.col("path") == fixed_path(path, below)


def conf_size(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    facts = repo_facts(files, is_conf(), conf_chars().alias("chars"))
    return facts.groupBy(*REPO_KEY).agg(F.coalesce(F.max("chars"), F.lit(0)).alias("conf_chars")).withColumn("status", size_status(F.col("conf_chars"), policy))


def size_status(chars: Column, policy: AuditPolicy) -> Column:
    return F.when(chars == 0, "NO_BRACE").when(chars > policy.max_conf_chars, "TOO_LONG").otherwise("OK")


def schema_status(state: Column) -> Column:
    return F.when(state == 2, "UNPARSABLE").when(state == 1, "ERROR").otherwise("OK")


def conf_schema(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    facts = repo_facts(files, is_conf(), conf_schema_state(policy).alias("state"))
    return facts.groupBy(*REPO_KEY).agg(schema_status(F.max("state")).alias("status"))


def io_suffixes(files: DataFrame) -> DataFrame:
    facts = repo_facts(files, is_conf(), has_key_suffix("INPUT").alias("reads"), has_key_suffix("OUTPUT").alias("writes"))
    seen = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return facts.groupBy(*REPO_KEY).agg((seen("reads") & seen("writes")).alias("passed"))


def docs_present(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.groupBy(*REPO_KEY).agg(
        (F.bool_or(path.contains("CONTRIBUTING")) & F.bool_or(path.contains("README"))).alias("passed")
    )


def sonar(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    facts = repo_facts(files, _fixed("sonar-project.properties"), F.col("content").contains(policy.coverage_line).alias("covered"))
    return facts.groupBy(*REPO_KEY).agg(F.coalesce(F.bool_or("covered"), F.lit(False)).alias("passed"))


def sonar_passed(policy: AuditPolicy) -> Column:
    return F.coalesce(
        F.bool_or(F.when(_fixed("sonar-project.properties"), F.col("content").contains(policy.coverage_line))),
        F.lit(False),
    )


def sdk_version(policy: AuditPolicy) -> Column:
    found = F.regexp_extract("content", rf"{re.escape(policy.sdk_package)}==([0-9.]+)", 1)
    return F.when(_fixed("requirements.txt"), F.nullif(found, F.lit("")))


def version_reached(version: Column, policy: AuditPolicy) -> Column:
    """Numeric comparison part by part; unreadable or absent versions fail."""
    parts = F.transform(F.split(version, "[.]", -1), lambda p: p.try_cast("int"))
    wanted = F.array(*(F.lit(n) for n in policy.min_sdk_version))
    return F.coalesce(F.forall(parts, lambda p: p.isNotNull()) & (parts >= wanted), F.lit(False))


def min_version(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    facts = repo_facts(files, _fixed("requirements.txt"), sdk_version(policy).alias("found"))
    return facts.groupBy(*REPO_KEY).agg(F.max("found").alias("sdk_version")).withColumn(
        "passed", version_reached(F.col("sdk_version"), policy)
    )


def _extract(pattern: str) -> Column:
    body = F.col("content")
    return F.when(body.rlike(pattern), strip(F.regexp_extract(body, pattern, 1)))


def version_facts(policy: AuditPolicy) -> dict[str, Column]:
    """Version strings of one file; null for files that carry none.

    A missing or one-line setup.cfg counts as unreadable.
    """
    second = F.regexp_extract("content", "^[^\r\n]*(?:\r\n|\n|\r)([^\r\n]*)", 1)
    cfg = F.nullif(F.regexp_extract(second, r"=\s*(\S+)", 1), F.lit(""))
    readable = F.col("content").rlike("^[^\r\n]*(?:\r\n|\n|\r)(?s:.)")
    return {
        "v_cfg": F.when(_fixed("setup.cfg"), cfg),
        "v_py": F.when(_fixed("setup.py"), _extract(r"""version=["'](.*?)["']""")),
        "v_init": F.when(_fixed("__init__.py", True), _extract(r"""__version__\s*=\s*["'](.*?)["']""")),
        "v_build": F.when(_fixed(policy.build_file), _extract(r"""version\s*=\s*["'](.*?)["']""")),
        "cfg_readable": F.when(_fixed("setup.cfg"), readable),
    }


def found_versions() -> Column:
    return F.array_compact(F.array("v_cfg", "v_py", "v_init", "v_build"))


def versions_consistent() -> Column:
    return F.size(F.array_distinct(found_versions())) == 1


def repo_versions(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """The version strings of each repository's four version files."""
    facts = version_facts(policy)
    sources = (("setup.cfg", False), ("setup.py", False), ("__init__.py", True), (policy.build_file, False))
    rows = repo_facts(files, is_one_of(sources), *(v.alias(name) for name, v in facts.items()))
    readable = F.coalesce(F.bool_or("cfg_readable"), F.lit(False)).alias("cfg_readable")
    return rows.groupBy(*REPO_KEY).agg(*(F.max(name).alias(name) for name in facts if name != "cfg_readable"), readable)


def _version_rows(policy: AuditPolicy) -> Column:
    """Rows in report order; a source whose file has no version gives no row."""
    names = ("setup.cfg", "setup.py", "__init__.py", policy.build_file)
    rows = [
        F.when(F.col(v).isNotNull(), F.struct(F.lit(name).alias("source"), F.col(v).alias("version"), F.lit(True).alias("is_found")))
        for name, v in zip(names, ("v_cfg", "v_py", "v_init", "v_build"))
    ]
    rows[0] = F.when(
        ~F.col("cfg_readable"),
        F.struct(F.lit(names[0]).alias("source"), F.lit(NOT_FOUND).alias("version"), F.lit(False).alias("is_found")),
    ).otherwise(rows[0])
    return F.array_compact(F.array(*rows))


def version_extract(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    return repo_versions(files, policy).select(*REPO_KEY, F.inline(_version_rows(policy)))


def version_consistency(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    return repo_versions(files, policy).select(
        *REPO_KEY, F.size(found_versions()).alias("n_found"),
        F.size(F.array_distinct(found_versions())).alias("n_distinct"),
        versions_consistent().alias("is_consistent"),
    )


def version_vs_reference(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """Each version against setup.cfg, whose place-holder also counts as a reference."""
    reference = F.when(~F.col("cfg_readable"), F.lit(NOT_FOUND)).otherwise(F.col("v_cfg"))
    rows = repo_versions(files, policy).select(
        *REPO_KEY, versions_consistent().alias("is_consistent"), reference.alias("expected"),
        F.inline(_version_rows(policy)),
    )
    status = (
        F.when(F.col("is_consistent"), "CORRECT")
        .when(F.col("source") == "setup.cfg", "REFERENCE")
        .when(F.col("expected").isNull(), "INCONSISTENT")
        .when(F.col("version") == F.col("expected"), "MATCH")
        .otherwise("SHOULD_BE")
    )
    return rows.select(*REPO_KEY, "source", "version", "expected", status.alias("status"))
