"""Every registered query: a function of the session and the table directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import comments, config, constants, flags, language, naming, scopes, symbols
from plumbline.plans import findings, report, scorecard
from plumbline.policy import DEFAULT_POLICY
from plumbline.sources import corpus, files, requests

Query = Callable[[SparkSession, str], DataFrame]

LISTING_RULES = {
    "repo_manifest": files.manifest,
    "expected_files_missing": files.expected_files_missing,
    "scope_flags": scopes.scope_flags,
    "scope_verbs": scopes.scope_verbs,
    "scope_udf": scopes.scope_udf,
    "pick_fields_file": scopes.pick_fields_file,
    "scope_language": scopes.scope_language,
    "scope_globs": scopes.scope_globs,
    "scope_variables": scopes.scope_variables,
    "scope_pandas": scopes.scope_pandas,
    "is_test_file": scopes.test_files,
    "check_docs_present": config.docs_present,
}

FILE_RULES = {
    "content_lookup": files.content_lookup,
    "flag_spark_read": lambda rf: flags.flag_rows(rf, flags.reads_spark()),
    "flag_spark_write": lambda rf: flags.flag_rows(rf, flags.writes_spark(DEFAULT_POLICY)),
    "flag_hadoop": lambda rf: flags.flag_rows(rf, flags.uses_hadoop()),
    "flag_partition_read": flags.partition_read,
    "flag_compaction": lambda rf: flags.flag_rows(rf, flags.compacts()),
    "flag_base_path": lambda rf: flags.flag_rows(rf, flags.uses_base_path()),
    "flag_app_logic": flags.app_logic,
    "flag_pandas": flags.pandas_rows,
    "flags_by_repo": flags.flags_by_repo,
    "last_wins_by_basename": flags.pandas_by_basename,
    "pandas_file_count": flags.pandas_file_count,
    "check_sonar": config.sonar,
    "check_conf_size": config.conf_size,
    "check_conf_schema": config.conf_schema,
    "check_io_suffixes": config.io_suffixes,
    "check_min_version": config.min_version,
    "version_extract": config.version_extract,
    "version_consistency": config.version_consistency,
    "version_vs_reference": config.version_vs_reference,
    "extract_functions": symbols.extract_functions,
    "extract_assignments": symbols.extract_assignments,
    "extract_params": symbols.extract_params,
    "extract_docstrings": symbols.extract_docstrings,
    "docstring_params": symbols.docstring_params,
    "extract_local_vars": symbols.extract_local_vars,
    "extract_constants": constants.extract_constants,
    "const_plurality": constants.const_plurality,
    "const_suggested_name": constants.const_suggested_name,
    "const_naming_findings": constants.const_naming_findings,
    "const_naming_verdict": constants.const_naming_verdict,
    "const_structure_summary": constants.const_structure_summary,
    "fn_verb_violations": naming.fn_verb_violations,
    "test_fn_violations": naming.test_fn_violations,
    "test_fn_skip_first": naming.test_fn_skip_first,
    "fn_verb_report": naming.fn_verb_report,
    "variable_verb_violations": naming.variable_verb_violations,
    "udf_import_hits": naming.udf_import_hits,
    "udf_report": naming.udf_report,
    "comment_findings": comments.comment_findings,
    "comment_findings_app": comments.comment_findings_app,
    "comment_verdicts": comments.comment_verdicts,
    "comment_file_count": comments.comment_file_count,
    "docstring_param_drift": language.docstring_param_drift,
}

DOCUMENT_RULES = {
    "words_not_whitelisted": language.words_not_whitelisted,
    "zipf_table": language.zipf_table,
    "english_words": language.english_words,
}

DICTIONARY_RULES = {
    "docstring_language": language.docstring_language,
    "param_language": language.param_language,
    "variable_language": language.variable_language,
    "language_report": language.language_report,
    "findings": findings.findings,
    "findings_text": report.findings_text,
    "numbered_findings": lambda rf, words: report.numbered_findings(findings.findings(rf, words)),
    "scorecard": scorecard.scorecard,
    "status_classes": lambda rf, words: scorecard.status_classes(scorecard.scorecard(rf, words)),
    "scorecard_json": lambda rf, words: json_fields(scorecard.scorecard_json(scorecard.scorecard(rf, words))),
}

REQUEST_RULES = {
    "branch_default": requests.default_branch,
    "repo_url_parse": requests.parse_urls,
    "request_filter": requests.admit,
}


def json_fields(documents: DataFrame) -> DataFrame:
    """Fields read back from the response documents."""
    value = lambda path: F.get_json_object("document", path)
    columns = F.from_json(value("$.columns"), "array<string>")
    return documents.select(
        "repo", "branch", (value("$.success") == "true").alias("success"),
        *(value(f"$.data.{c}[0]").alias(f"{c}_value") for c in ("repo", *scorecard.CELLS)),
        F.array_join(columns, ",").alias("column_list"),
    )


def request_fields(documents: DataFrame) -> DataFrame:
    value = lambda path: F.get_json_object("document", path)
    return documents.select(
        "request_id", (value("$.success") == "true").alias("success"), value("$.error").alias("error"), value("$.branch").alias("branch"),
        F.coalesce(value("$.url"), value("$.data.url[0]")).alias("url"),
        *(value(f"$.data.{c}[0]").alias(f"{c}_value") for c in ("repo", *scorecard.CELLS)),
    )


def queries() -> dict[str, Query]:
    registry: dict[str, Query] = {}
    for name, rule in LISTING_RULES.items():
        registry[name] = lambda spark, sf_dir, rule=rule: rule(corpus.repo_listing(spark, sf_dir))
    for name, rule in FILE_RULES.items():
        registry[name] = lambda spark, sf_dir, rule=rule: rule(corpus.repo_files(spark, sf_dir))
    for name, rule in DOCUMENT_RULES.items():
        registry[name] = lambda spark, sf_dir, rule=rule: rule(corpus.documents(spark, sf_dir))
    for name, rule in DICTIONARY_RULES.items():
        registry[name] = lambda spark, sf_dir, rule=rule: rule(
            corpus.repo_files(spark, sf_dir), language.english_dictionary(corpus.documents(spark, sf_dir)))
    for name, rule in REQUEST_RULES.items():
        registry[name] = lambda spark, sf_dir, rule=rule: rule(corpus.audit_requests(spark, sf_dir))
    registry["audit_by_request"] = lambda spark, sf_dir: findings.audit_by_request(
        corpus.audit_requests(spark, sf_dir), registry["scorecard"](spark, sf_dir))
    registry["audit_documents"] = lambda spark, sf_dir: request_fields(findings.audit_documents(registry["audit_by_request"](spark, sf_dir)))
    registry["english_texts"] = lambda spark, sf_dir: language.english_texts(
        corpus.documents(spark, sf_dir), language.english_dictionary(corpus.documents(spark, sf_dir)))
    return registry
