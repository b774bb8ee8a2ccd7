"""The scorecard: one row per repository with the verdict of every check.

All checks but the language one come from a single scan.  Per-file facts are
narrow columns, bodies are dropped before the first shuffle, and the
aggregation runs first per (repository, base name) and then per repository, so
no task ever holds a whole repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.source import with_symbols
from plumbline.functions.text import basename
from plumbline.operators import comments, config, constants, flags, language, naming, scopes
from plumbline.policy import DEFAULT_POLICY, AuditPolicy
from plumbline.sources.files import REPO_KEY

CELLS = (
    "spark_read", "hadoop", "partition_read", "sdk_version", "spark_write", "compaction",
    "base_path", "app_logic", "conf_size", "conf_chars", "conf_schema", "sonar", "io_suffixes",
    "docs_present", "language", "function_names", "constant_names", "variable_names", "pandas",
    "udf", "commented_code", "versions",
)


def file_facts(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """One narrow row per file with everything the scorecard folds; needs no shuffle."""
    body = F.col("content")
    variable_entries, pandas_entries = scopes.variable_entries(), scopes.pandas_entries()
    in_variables, in_pandas = F.size(variable_entries) > 0, F.size(pandas_entries) > 0
    prepared = constants.with_constants(with_symbols(files, scopes.in_verb_scope() | in_variables | scopes.is_fields_file(), headers_only=True))
    scoped, conf, listed = scopes.in_flag_scope(), flags.is_conf(), F.size(scopes.language_entries())
    n_verbs = F.size(naming.verb_variables(F.col("assigned"), policy))
    facts = {
        "scoped": F.when(scoped, F.lit(True)),
        "f_spark_read": F.when(scoped, flags.reads_spark()),
        "f_hadoop": F.when(scoped, flags.uses_hadoop()),
        "f_object_read": F.when(scoped, flags.code_reads_object()),
        "f_conf_object": F.when(conf, flags.conf_reads_object()),
        "f_spark_write": F.when(scoped, flags.writes_spark(policy)),
        "f_compaction": F.when(scoped, flags.compacts()),
        "f_base_path": F.when(scoped, flags.uses_base_path()),
        "f_app_logic": F.when(flags.is_app(), flags.has_logic()),
        "c_chars": F.when(conf, config.conf_chars()),
        "c_schema": F.when(conf, config.conf_schema_state(policy)),
        "c_input": F.when(conf, config.has_key_suffix("INPUT")),
        "c_output": F.when(conf, config.has_key_suffix("OUTPUT")),
        "c_contributing": F.col("path").contains("CONTRIBUTING"),
        "c_readme": F.col("path").contains("README"),
        "c_sonar": F.when(F.col("path") == "sonar-project.properties", body.contains(policy.coverage_line)),
        "sdk": config.sdk_version(policy),
        **config.version_facts(policy),
        "n_bad_functions": F.when(scopes.in_verb_scope(), F.size(naming.bad_functions(F.col("functions"), policy))),
        "n_udf": F.when(scopes.in_udf_scope() & naming.may_import_udf(policy), F.size(naming.udf_hits(policy))),
        "n_listed": F.when(listed > 0, listed),
        "n_commented": F.when(listed > 0, F.when(F.size(comments.comments()) > 0, listed)),
        "fields": F.when(scopes.is_fields_file(), constants.fields_summary()),
        "fields_ord": F.when(scopes.is_fields_file(), F.col("file_ord")),
        "uses_pandas": F.when(in_pandas, flags.imports_pandas()),
        "pandas_ord": F.when(in_pandas, F.array_max(pandas_entries)),
        "n_verbs": F.when(in_variables, n_verbs),
        "verbs_ord": F.when(in_variables, F.array_max(variable_entries)),
        "has_utils": F.when(F.col("path") == F.concat("repo", F.lit("/utils/utils.py")), F.lit(True)),
        "same_name": F.when(in_variables | in_pandas, basename(F.col("path"))),
    }
    return prepared.select(*REPO_KEY, *(value.alias(name) for name, value in facts.items()))


ANY = (
    "scoped", "f_spark_read", "f_hadoop", "f_object_read", "f_conf_object", "f_spark_write",
    "f_compaction", "f_base_path", "f_app_logic", "c_input", "c_output", "c_contributing",
    "c_readme", "c_sonar", "cfg_readable", "has_utils",
)
GREATEST = ("c_chars", "c_schema", "sdk", "v_cfg", "v_py", "v_init", "v_build")
TOTAL = ("n_bad_functions", "n_udf", "n_listed", "n_commented")


def repo_facts(facts: DataFrame) -> DataFrame:
    """Fold file facts to one row per repository, last-wins names in between."""
    merged = [F.bool_or(c).alias(c) for c in ANY] + [F.max(c).alias(c) for c in GREATEST]
    merged += [F.sum(c).alias(c) for c in TOTAL]
    merged += [F.min_by("fields", "fields_ord").alias("fields"), F.min("fields_ord").alias("fields_ord")]
    by_name = facts.groupBy(*REPO_KEY, "same_name").agg(
        *merged,
        F.max_by("uses_pandas", "pandas_ord").alias("uses_pandas"),
        F.max_by("n_verbs", F.when(F.col("n_verbs") > 0, F.col("verbs_ord"))).alias("n_verbs"),
    )
    return by_name.groupBy(*REPO_KEY).agg(
        *merged,
        F.count_if("uses_pandas").alias("n_pandas"),
        F.count_if(~F.col("uses_pandas")).alias("n_clean"),
        F.coalesce(F.sum("n_verbs"), F.lit(0)).alias("n_verb_variables"),
    )


def _mark(bad: Column, bad_text: str, good_text: str) -> Column:
    return F.when(bad, f"❌ {bad_text}").when(~bad, f"✅ {good_text}")


def _ok_or(passed: Column, text: str) -> Column:
    return F.when(F.coalesce(passed, F.lit(False)), "OK").otherwise(text)


def _count_or(count: Column, none: str) -> Column:
    total = F.coalesce(count, F.lit(0))
    return F.when(total > 0, F.concat(total.cast("string"), F.lit(" findings"))).otherwise(none)


def _false(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def version_text(policy: AuditPolicy) -> Column:
    sources = (("setup.cfg", "v_cfg"), ("setup.py", "v_py"), ("__init__.py", "v_init"), (policy.build_file, "v_build"))
    lines = [F.concat(F.lit(f"\n- {name}: "), F.col(v)) for name, v in sources]
    lines[0] = F.when(~_false("cfg_readable"), F.lit(f"\n- setup.cfg: {config.NOT_FOUND}")).otherwise(lines[0])
    head = F.when(config.versions_consistent(), "equal versions:").otherwise("different versions:")
    return F.concat_ws("", head, *lines)


def cell_values(policy: AuditPolicy) -> dict[str, Column]:
    """Text of every scorecard cell from the folded facts."""
    picked, chars = F.col("fields"), F.coalesce("c_chars", F.lit(0))
    n_clean = F.col("n_clean") + F.when(_false("has_utils"), 0).otherwise(1)
    schema = F.coalesce("c_schema", F.lit(0))
    return {
        "spark_read": _mark(F.col("f_spark_read"), "reads with Spark", "no reads with Spark"),
        "hadoop": _mark(F.col("f_hadoop"), "uses Hadoop", "no Hadoop"),
        "partition_read": _mark(
            ~(F.col("f_object_read") | (_false("f_conf_object") & F.col("scoped"))),
            "reads down to the partition", "reads down to the object"),
        "sdk_version": _mark(~config.version_reached(F.col("sdk"), policy), "SDK version too low", "SDK version"),
        "spark_write": _mark(F.col("f_spark_write"), "writes with Spark", "no writes with Spark"),
        "compaction": _mark(~F.col("f_compaction"), "no compaction", "compaction"),
        "base_path": _mark(F.col("f_base_path"), "uses a base path", "no base path"),
        "app_logic": _mark(_false("f_app_logic"), "control flow in the entry file", "no control flow"),
        "conf_size": F.when(chars == 0, "size ERROR: no opening brace")
        .when(chars > policy.max_conf_chars, "over the limit").otherwise("OK"),
        "conf_chars": chars,
        "conf_schema": F.when(schema == 2, "SCHEMA ERROR: unbalanced braces")
        .when(schema == 1, "ERROR: forbidden value").otherwise("OK"),
        "sonar": _ok_or(F.col("c_sonar"), "coverage line missing"),
        "io_suffixes": _ok_or(F.col("c_input") & F.col("c_output"), "input or output suffix missing"),
        "docs_present": _ok_or(F.col("c_contributing") & F.col("c_readme"), "CONTRIBUTING or README missing"),
        "language": _count_or(F.col("n_language"), "OK"),
        "function_names": _count_or(F.col("n_bad_functions"), "OK"),
        "constant_names": F.when(picked.isNull(), "⚠️ no fields file")
        .when(picked["n_constants"] == 0, "ℹ️ no constants")
        .when(picked["n_errors"] == 0, "✅ OK")
        .otherwise(F.concat(F.lit("❌ "), picked["n_errors"].cast("string"), F.lit(" errors:\n"),
                            constants.error_bullets(picked["errors"]))),
        "variable_names": _count_or(F.col("n_verb_variables"), ""),
        "pandas": F.concat_ws(
            ", ",
            F.when(F.col("n_pandas") > 0, F.concat(F.lit("❌ "), F.col("n_pandas").cast("string"), F.lit(" with pandas"))),
            F.when(n_clean > 0, F.concat(F.lit("✅ "), n_clean.cast("string"), F.lit(" without"))),
        ),
        "udf": _count_or(F.col("n_udf"), "OK"),
        "commented_code": F.concat(
            F.coalesce("n_commented", F.lit(0)).cast("string"), F.lit(" files with invalid comments")),
        "versions": version_text(policy),
    }


def scorecard(files: DataFrame, dictionary: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """scorecard(repo, branch, audit_status, one column per cell)."""
    found = language.language_findings(files, dictionary, policy)
    n_language = found.groupBy(*REPO_KEY).agg(F.count("*").alias("n_language"))
    folded = repo_facts(file_facts(files, policy)).join(n_language, list(REPO_KEY), "left")
    cells = cell_values(policy)
    status = F.when(_false("scoped"), "OK").otherwise("NO_SCOPE_FILES")
    return folded.select(*REPO_KEY, status.alias("audit_status"), *(cells[c].alias(c) for c in CELLS))


def scorecard_json(card: DataFrame) -> DataFrame:
    """Each scorecard row as a response document: columns, and a one-value list per column."""
    names = ("repo", *CELLS)
    document = F.to_json(F.struct(
        F.lit(True).alias("success"),
        F.struct(*(F.array(c).alias(c) for c in names)).alias("data"),
        F.array(*(F.lit(c) for c in names)).alias("columns"),
        F.col("branch").alias("branch"),
    ), {"ignoreNullFields": "false"})
    return card.select(*REPO_KEY, document.alias("document"))


def status_class(text: Column) -> Column:
    """Traffic light of a cell: the first marker in this order decides."""
    return (
        F.when(F.coalesce(text, F.lit("")).isin("", "0"), "hidden")
        .when(text.contains("✅") | text.contains("OK"), "ok")
        .when(text.contains("❌") | text.contains("ERROR"), "error")
        .when(text.contains("⚠️") | text.contains("WARNING"), "warning")
        .otherwise("none")
    )


def status_classes(card: DataFrame) -> DataFrame:
    """How many repositories show each class in each cell."""
    cells = card.select(F.inline(F.array(*(
        F.struct(F.lit(c).alias("cell"), F.col(c).cast("string").alias("text")) for c in CELLS
    ))))
    return cells.groupBy("cell", status_class(F.col("text")).alias("status")).agg(F.count("*").alias("n"))
