"""Small hand-derived cases of the flag, configuration, naming and comment rules."""

import pytest

from plumbline.operators import comments, config, constants, flags, naming, scopes
from plumbline.policy import DEFAULT_POLICY


def value(df, column):
    (row,) = df.collect()
    return row[column]


def flag(make_files, column, text):
    return value(flags.flag_rows(make_files({"R": {"R/app.py": text}}), column), "flagged")


def test_fields_file_is_first_of_listing(make_files):
    rf = make_files({"R": {"z/my_fields.py": "", "R/fields.py": ""}})
    assert value(scopes.pick_fields_file(rf), "path") == "z/my_fields.py"


@pytest.mark.parametrize("path,expected", [
    ("tests/utils.py", False), ("tests/test_app.py", True), ("test_x.py", True), ("a/test/b.py", True)])
def test_test_files(make_files, path, expected):
    assert value(scopes.test_files(make_files({"R": {path: ""}})), "is_test") is expected


def test_path_counts_once_per_fragment(make_files):
    rf = make_files({"R": {"R/utils/transformations/app.py": "", "R/app.py": "", "app.py": ""}})
    assert {r.path: r.n_matches for r in scopes.scope_flags(rf).collect()} == {
        "R/utils/transformations/app.py": 3, "R/app.py": 1}


def test_globs_cross_folders(make_files):
    rf = make_files({"R": {"a/b/transformations/transformations_x.py": "", "transformations/transformations.py": "",
                           "xtests/transformations/test_transformations.py": ""}})
    assert {(r.path, r.glob) for r in scopes.scope_globs(rf).collect()} == {
        ("a/b/transformations/transformations_x.py", "main"), ("xtests/transformations/test_transformations.py", "test")}


def test_write_flag_spares_the_sanctioned_writer(make_files):
    writes = flags.writes_spark(DEFAULT_POLICY)
    assert flag(make_files, writes, "x.write.parquet()")
    assert not flag(make_files, writes, "x.write.parquet()\nengine_mock.write(y)")


@pytest.mark.parametrize("conf,code,expected", [
    ("x = 1", "a == b", False), ("x = 1", "f(a=1)", True), ("x=1", "", True), ("x = 1", "a = b", False)])
def test_partition_read(make_files, conf, code, expected):
    rf = make_files({"R": {"resources/application.conf": conf, "R/app.py": code}})
    assert value(flags.partition_read(rf), "flagged") is expected
    assert value(flags.flags_by_repo(rf), "partition_read") is expected


@pytest.mark.parametrize("text,expected", [("else:", False), ("# for x", True), ("elif x", True)])
def test_app_logic(make_files, text, expected):
    assert value(flags.app_logic(make_files({"R": {"R/app.py": text}})), "has_logic") is expected


@pytest.mark.parametrize("text,expected", [
    ("import os, pandas", False), ("x\n  from pandas import x", True), ("import pandas_x", True)])
def test_pandas(make_files, text, expected):
    assert value(flags.pandas_by_basename(make_files({"R": {"R/utils/utils.py": text}})), "uses_pandas") is expected


def test_absent_utils_counts_as_clean(make_files):
    assert value(flags.pandas_by_basename(make_files({"R": {"x": ""}})), "uses_pandas") is False


def test_flags_stick_and_last_base_name_wins(make_files):
    rf = make_files({"R": {
        "a/transformations/transformations_u.py": "import pandas", "b/transformations/transformations_u.py": "",
        "R/app.py": "spark.read.x"}})
    assert value(flags.flags_by_repo(rf), "spark_read") is True
    assert value(flags.pandas_file_count(rf), "n_pandas_files") == 0


def test_repository_without_scoped_files(make_files):
    row = flags.flags_by_repo(make_files({"R": {"README.md": "spark.read."}})).first()
    assert row.audit_status == "NO_SCOPE_FILES" and row.spark_read is None and row.partition_read is None


@pytest.mark.parametrize("text,chars,status", [
    ("no brace", 0, "NO_BRACE"), ("x{" + "a" * 2399, 2400, "OK"), ("{" + "a" * 2400, 2401, "TOO_LONG"), ("{\n}", 4, "OK"), ("{ñ", 2, "OK")])
def test_conf_size(make_files, text, chars, status):
    row = config.conf_size(make_files({"R": {"resources/application.conf": text}})).first()
    assert (row.conf_chars, row.status) == (chars, status)


@pytest.mark.parametrize("text,status", [
    ('a {\n SCHEMA = "dev-bucket/x"\n}', "OK"), ('my_schema = "gs/dev-bucket/x"', "ERROR"), ('a.SCHEMA = "dev-bucket"', "OK"),
    ('{\nSCHEMA : "dev-bucket"\n}', "ERROR"), ("a {", "UNPARSABLE"), ("}\n{", "UNPARSABLE"), ("", "OK"),
    ('S_SCHEMA = "dev-bucket"\nS_SCHEMA = "prod"', "OK"), ('note = "{"\nSCHEMA = "dev-bucket"', "ERROR"), ('SCHEMA = ["dev-bucket"]', "OK")])
def test_conf_schema(make_files, text, status):
    assert value(config.conf_schema(make_files({"R": {"resources/application.conf": text}})), "status") == status


@pytest.mark.parametrize("text,expected", [
    ("A_INPUT = 1\nb_output=2", True), ("A_INPUT = 1", False), ("INPUT_A = 1\nOUTPUT = 1", False), ("x = INPUT = 1\nOUTPUT=1", False)])
def test_io_suffixes(make_files, text, expected):
    assert value(config.io_suffixes(make_files({"R": {"resources/application.conf": text}})), "passed") is expected


@pytest.mark.parametrize("version,expected", [
    ("0.4.10", True), ("0.5", True), ("0.4", False), ("0.4.9", True), ("1", True), ("0.5.", False), (None, False)])
def test_min_version(make_files, version, expected):
    text = f"engine_sdk=={version}\n" if version else "pandas==2"
    assert value(config.min_version(make_files({"R": {"requirements.txt": text}})), "passed") is expected


def test_version_consistency(make_files):
    rf = make_files({
        "A": {"setup.py": 'setup(version="1.0")'}, "B": {"README.md": ""},
        "C": {"setup.cfg": "[m]\nversion = 1.0\n", "setup.py": "version='1.1'", "C/__init__.py": '__version__ = "1.0"'},
        "D": {"setup.cfg": "[m]\nname", "Buildfile": 'version = "2"', "setup.py": 'version="3"'}})
    assert {r.repo: r.is_consistent for r in config.version_consistency(rf).collect()} == {
        "A": True, "B": False, "C": False, "D": False}
    assert {(r.repo, r.source, r.is_found) for r in config.version_extract(rf).filter("repo in ('A', 'B')").collect()} == {
        ("A", "setup.cfg", False), ("A", "setup.py", True), ("B", "setup.cfg", False)}
    status = {(r.repo, r.source): r.status for r in config.version_vs_reference(rf).collect()}
    assert status["C", "setup.cfg"] == "REFERENCE" and status["C", "__init__.py"] == "MATCH"
    assert status["C", "setup.py"] == "SHOULD_BE" and status["D", "Buildfile"] == "INCONSISTENT"
    assert status["A", "setup.py"] == "CORRECT"


def bad_names(make_files, path, code):
    rf = make_files({"R": {path: code}})
    found = naming.fn_verb_violations(rf).unionByName(naming.test_fn_violations(rf))
    return [r.fn_name for r in found.orderBy("fn_pos").collect()]


def test_function_verbs(make_files):
    code = "\n".join(f"def {n}():\n    pass" for n in (
        "join_a", "join_a_with_b", "_x", "run", "main", "group_x", "union_a_with_b", "filter_by_x", "filtered_by"))
    assert bad_names(make_files, "R/utils.py", code) == ["join_a", "_x", "group_x", "filtered_by"]


def test_test_function_verbs(make_files):
    code = "\n".join(f"def {n}():\n    pass" for n in ("first", "test_add_x", "test_foo", "test", "setUp", "add_x"))
    assert bad_names(make_files, "R/tests/test_transformations_a.py", code) == ["test_foo", "test", "add_x"]


def test_first_function_of_a_test_file_is_the_outermost(make_files):
    code = "class T:\n    def setUp(self): pass\n    def bad_a(self): pass\ndef bad_b(): pass\n"
    assert bad_names(make_files, "tests/x/test_transformations.py", code) == ["bad_a"]


def test_report_blocks(make_files):
    rf = make_files({"R": {"b/utils.py": "def zeta(): pass\ndef alpha(): pass", "a/app.py": "def run(): pass"}, "S": {"x": ""}})
    assert {(r.repo, r.block) for r in naming.fn_verb_report(rf).collect()} == {
        ("R", "utils.py:\n    1. alpha\n    2. zeta"), ("S", "OK")}


def test_variable_verbs(make_files):
    rf = make_files({"R": {"R/app.py": "add_x = 1\na, Sort_y = 1, 2\nload_z += 1\nget_w: int = 2\nf(run_k=1)\n"}})
    assert [r.name for r in naming.variable_verb_violations(rf).orderBy("seq").collect()] == ["add_x", "sort_y"]


def test_last_file_with_matches_wins(make_files):
    rf = make_files({"R": {f"{d}/transformations/transformations_u.py": text for d, text in
                           (("a", "add_a = 1"), ("b", "add_b = 1\nadd_c = 2"), ("c", "x = 1"))}})
    assert [(r.seq, r.name) for r in naming.variable_verb_violations(rf).orderBy("seq").collect()] == [(1, "add_b"), (2, "add_c")]


def test_udf_imports(make_files):
    text = ("from pyspark.sql.functions import col, udf\n  from pyspark.sql.functions import udf\n# pyspark.sql.functions.udf\n"
            "import pyspark.sql.functions as F; pyspark.sql.functions.udf(x)\n")
    rf = make_files({"R": {"R/utils/utils.py": text, "R/app.py": text}})
    assert [(r.seq, r.line_no, r.label) for r in naming.udf_import_hits(rf).orderBy("seq").collect()] == [
        (1, 2, "from pyspark.sql.functions import udf"), (2, 4, "pyspark.sql.functions.udf"),
        (3, 4, "import pyspark.sql.functions as <alias>")]


@pytest.mark.parametrize("text,plural,suggested", [
    ("A_FIELD = {}", True, "A_FIELDS"), ("A = [1]", False, "A_FIELD"), ("A_FIELDS = [1, 2]", True, "A_FIELDS"),
    ('B = "s"', False, "B_FIELD"), ("C_FIELDS = None", False, "C_FIELD"), ("A = (1, 2)", True, "A_FIELDS"),
    ("A = 1, 2", True, "A_FIELDS"), ("A = {1}", False, "A_FIELD"), ("A = f(x)", False, "A_FIELD"), ("A = [x, y]", False, "A_FIELD"),
    ("A = {x: y}", True, "A_FIELDS")])
def test_constant_plurality(make_files, text, plural, suggested):
    rf = make_files({"R": {"R/fields.py": text}})
    assert value(constants.const_plurality(rf), "is_plural") is plural
    assert value(constants.const_suggested_name(rf), "suggested") == suggested


def test_constant_findings_and_verdicts(make_files):
    long = "x" * 60
    rf = make_files({
        "R": {"R/fields.py": f'A = 1\nB_FIELDS = "{long}"\nclass K:\n    C_FIELD = {{"a": [1, 2], "b": 2}}\nA = 2\nD_FIELD = 3\n'},
        "S": {"S/fields.py": "x = 1"}, "T": {"x": ""}, "U": {"U/fields.py": "A_FIELD = 1"}})
    found = constants.const_naming_findings(rf).orderBy("seq").collect()
    assert [(r.name, r.suggested, r.detail) for r in found] == [
        ("A", "A_FIELD", "missing suffix"), ("B_FIELDS", "B_FIELD", f"str: {'x' * 50}..."), ("C_FIELD", "C_FIELDS", "dict with 2 elements")]
    assert {r.repo: (r.verdict, r.n_errors) for r in constants.const_naming_verdict(rf).collect()} == {
        "R": ("ERRORS", 3), "S": ("NO_CONSTANTS", 0), "T": ("NO_FILE", 0), "U": ("OK", 0)}


def test_structure_summary_shows_ten(make_files):
    rf = make_files({"R": {"R/fields.py": "\n".join(f"A{i} = 1" for i in range(12)) + "\nB_FIELD = 1\n"}})
    row = constants.const_structure_summary(rf).first()
    assert (row.n_constants, row.n_field, row.n_fields, row.n_no_suffix, row.n_errors, row.n_more) == (13, 1, 0, 12, 12, 2)
    assert row.shown_errors.count("\n") == 9


def test_comments(make_files):
    text = "#! x\n# coding: utf-8\n  # bad " + "y" * 90 + "\n# ---- #\nx = 1  # trailing\n# Start here\n"
    rf = make_files({"R": {"tests/test_app.py": text, "R/utils/utils.py": text}})
    assert [(r.seq, r.line_no, len(r.detail)) for r in comments.comment_findings_app(rf).collect()] == [(1, 3, 80)]
    assert [r.line_no for r in comments.comment_findings(rf).orderBy("seq").collect()] == [3, 4, 6]
    verdicts = {r.path: (r.passed, r.is_missing) for r in comments.comment_verdicts(rf).collect()}
    assert verdicts["R/app.py"] == (True, True) and verdicts["tests/test_app.py"] == (False, False) and len(verdicts) == 7


def test_schema_value_ends_at_a_comment(make_files):
    from plumbline.operators import config

    conf = lambda line: {"resources/application.conf": f"a {{\n}}\n{line}\n"}
    table = make_files({"A": conf('SCHEMA_P = "prod/x" # not dev-bucket/x'), "B": conf('SCHEMA_P = "dev-bucket#1"'), "C": conf("SCHEMA_P = x // dev-bucket")})
    assert {r.repo: r.status for r in config.conf_schema(table).collect()} == {"A": "OK", "B": "ERROR", "C": "OK"}


def test_package_name_is_literal(make_files):
    from dataclasses import replace

    from plumbline.operators import config
    from plumbline.policy import DEFAULT_POLICY

    table = make_files({"R": {"requirements.txt": "aXb==1.0.0"}})
    assert config.min_version(table, replace(DEFAULT_POLICY, sdk_package="a.b")).first().sdk_version is None
