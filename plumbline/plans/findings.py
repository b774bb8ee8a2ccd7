"""All findings of an audit in one table, and one result for every audit request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.source import with_symbols
from plumbline.functions.text import basename
from plumbline.operators import comments, constants, flags, language, naming, scopes
from plumbline.policy import DEFAULT_POLICY, AuditPolicy
from plumbline.sources import requests as admission
from plumbline.sources.files import REPO_KEY

MIN_URL_PARTS = 4
FINDING = "struct<rule_id:string,path:string,seq:int,line_no:int,detail:string>"
LANGUAGE_RULES = {
    language.DOCSTRING: "docstring_language", language.PARAMETER: "parameter_language", language.VARIABLE: "variable_language",
    language.UNDOCUMENTED: "docstring_parameters", language.UNDEFINED: "docstring_parameters", language.UNREADABLE: "unreadable_file",
}


def _finding(rule_id: str | Column, seq: Column, detail: Column, line_no: Column | None = None, path: Column | None = None) -> Column:
    rule = F.lit(rule_id) if isinstance(rule_id, str) else rule_id
    return F.struct(rule.alias("rule_id"), (F.col("path") if path is None else path).alias("path"), seq.cast("int").alias("seq"),
                    (F.lit(None) if line_no is None else line_no).cast("int").alias("line_no"), detail.alias("detail"))


def file_findings(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """Findings of all rules that need no dictionary, from one scan of the bodies.

    A file gives groups of findings. Of groups with the same key the one of highest order stays: that of the last
    namesake for variables and pandas, of the first fields file for constants. Other groups are alone with their key.
    """
    scoped, in_variables, in_pandas = scopes.in_verb_scope(), F.size(scopes.variable_entries()) > 0, F.size(scopes.pandas_entries()) > 0
    prepared = constants.with_constants(with_symbols(files, scoped | in_variables | scopes.is_fields_file(), headers_only=True))
    base, no_order = basename(F.col("path")), F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("pos"))
    bad = F.transform(naming.bad_functions(F.col("functions"), policy), lambda f: _finding(
        F.when(scopes.is_test_file(), "test_function_name").otherwise("function_verb"), f["pos"] + 1, f["name"]))
    variables = F.transform(naming.verb_variables(F.col("assigned"), policy), lambda name, i: _finding("variable_verb", i + 1, name, path=base))
    imports = F.transform(naming.udf_hits(policy), lambda hit, i: _finding("forbidden_import", i + 1, hit["label"], hit["line_no"]))
    wrong = F.transform(constants.naming_errors(F.col("constants")), lambda e, i: _finding(
        "constant_name", i + 1, F.concat(e["name"], F.lit(" -> "), e["suggested"], F.lit(" ("), e["detail"], F.lit(")"))))
    remarks = F.transform(comments.comments(), lambda c, i: _finding("comment", i + 1, c["detail"], c["line_no"]))
    pandas = F.when(flags.imports_pandas(), F.array(_finding("pandas", F.lit(1), F.lit("imports pandas"), path=base))).otherwise(F.array())

    def last(entries: Column) -> Column:
        return F.struct(F.array_max(entries)["scope_part"].cast("int").alias("part"), F.array_max(entries)["scope_pos"].cast("bigint").alias("pos"))

    first_file = F.struct(F.lit(0).alias("part"), (-F.col("file_ord")).cast("bigint").alias("pos"))
    none = F.array().cast(f"array<{FINDING}>")
    groups = [
        (F.col("path"), no_order, F.concat(
            F.when(scoped, bad).otherwise(none), F.when(scopes.in_udf_scope() & naming.may_import_udf(policy), imports).otherwise(none),
            F.when(F.size(scopes.language_entries()) > 0, remarks).otherwise(none)), False),
        (base, last(scopes.variable_entries()), F.when(in_variables, variables), False),
        (base, last(scopes.pandas_entries()), F.when(in_pandas, pandas.cast(f"array<{FINDING}>")), True),
        (F.lit(""), first_file, F.when(scopes.is_fields_file(), wrong), True),
    ]
    rows = F.array(*(F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), order.alias("order"), (F.when(found.isNotNull(), found) if empty else F.when(F.size(found) > 0, found)).cast(f"array<{FINDING}>").alias("found"))
        for kind, (key, order, found, empty) in enumerate(groups)))
    narrow = prepared.select(*REPO_KEY, F.inline_outer(rows)).filter(F.col("found").isNotNull())
    kept = narrow.groupBy(*REPO_KEY, "kind", "key").agg(F.max_by("found", "order").alias("found"))
    return kept.select(*REPO_KEY, F.inline_outer("found")).filter(F.col("rule_id").isNotNull())


def findings(files: DataFrame, words: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """`(repo, branch, rule_id, path, seq, line_no, detail)` of every rule that names places in files.

    The bodies are scanned twice: once for all rules that need no dictionary, once for the language rules.
    Rules of variables and pandas report the base name of the file whose later namesake wins.
    """
    kind = F.col("kind")
    rule = F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGE_RULES.items() for x in pair)), kind)
    detail = (
        F.when(kind == language.UNDOCUMENTED, F.concat(F.lit("undocumented "), F.col("detail")))
        .when(kind == language.UNDEFINED, F.concat(F.lit("undefined "), F.col("detail")))
        .when(kind == language.UNREADABLE, F.col("detail")).otherwise(F.concat_ws(": ", "fn_name", "detail"))
    )
    spoken = language.language_findings(files, words, policy).select(*REPO_KEY, F.inline(F.array(_finding(
        rule, F.col("fn_pos") + 1, detail, F.when(kind == language.DOCSTRING, F.col("item_pos"))))))
    return file_findings(files, policy).unionByName(spoken)


def audit_by_request(requests: DataFrame, cards: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """Every request row with its repository's scorecard, or the reason why there is none.

    What a request says is one projection of its row, so that repeated and null request ids keep their rows; only the
    card is joined. A repository that most requests ask for adds rows to one side only, which the session splits.
    """
    accepted, place = admission.admission(), admission.address(policy)
    has_parts = F.size(F.split("url", "/", -1)) >= MIN_URL_PARTS
    refusal = (
        F.when(~accepted["accepted"], F.concat(F.lit("REFUSED: "), accepted["reason"]))
        .when(~has_parts, "SHORT_URL").when(~place["is_valid"], "INVALID_URL")
    )
    asked = requests.select("request_id", "url", place["repo"].alias("repo"), admission.branch_or_default(policy).alias("branch"), refusal.alias("refusal"))
    asked = asked.withColumn("asked", F.when(F.col("refusal").isNull(), F.col("repo")))
    card = cards.withColumnRenamed("repo", "card_repo").withColumnRenamed("branch", "card_branch").withColumnRenamed("audit_status", "card_status")
    found = asked.join(card, (F.col("asked") == F.col("card_repo")) & (F.col("branch") == F.col("card_branch")), "left")
    cells = [c for c in cards.columns if c not in ("repo", "branch", "audit_status")]
    return found.select(
        "request_id", "url", "repo", "branch",
        F.coalesce("refusal", "card_status", F.lit("UNKNOWN_REPOSITORY")).alias("audit_status"), *cells)


def audit_documents(audited: DataFrame) -> DataFrame:
    """`(request_id, document)`: the response to each request, its URL and every cell, or the error alone."""
    answered = F.col("audit_status").isin("OK", "NO_SCOPE_FILES")
    cells = [c for c in audited.columns if c not in ("request_id", "url", "repo", "branch", "audit_status")]
    names = ("url", "repo", *cells)
    good = F.to_json(F.struct(
        F.lit(True).alias("success"), F.struct(*(F.array(c).alias(c) for c in names)).alias("data"),
        F.array(*(F.lit(c) for c in names)).alias("columns"), F.col("branch"),
    ), {"ignoreNullFields": "false"})
    bad = F.to_json(F.struct(F.lit(False).alias("success"), F.col("audit_status").alias("error"), F.col("url"), F.col("branch")), {"ignoreNullFields": "false"})
    return audited.select("request_id", F.when(answered, good).otherwise(bad).alias("document"))
