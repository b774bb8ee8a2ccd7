"""Plain-SQL statements of the rules, for comparison with the Spark queries.

Every statement is a chain of named subqueries over the raw tables.  They use
row-wise joins, windows and group-bys where the Spark rules fold inside one
file's row, so the two forms check each other.
"""

from __future__ import annotations

import re

from plumbline import policy as P
from plumbline.checks.sqlpatterns import (
    AFTER_SEMICOLON, BRACKET_GROUP, CALL_GROUP, CLASS_MARGIN, CONSTANT_HEAD, IDENT, ONE_LINE_BLOCK, PARAM_DOC, PLAIN, UPPER_NAME,
)

POLICY = P.DEFAULT_POLICY
SEPARATORS = "_:.-,;*\\/"
WORD = r"[\p{L}\p{N}]+(?:'\p{L}+)*"
#: Fixed files of the scopes; true: below the folder named as the repository.
_CODE = [("utils/utils.py", True), ("app.py", True), ("fields.py", True), ("constants.py", True)]
_TESTS = [("tests/utils/test_utils.py", False), ("tests/test_app.py", False)]
LANGUAGE_FIXED = [*_CODE, ("tests/transformations/test_transformations.py", False), *_TESTS]
VARIABLE_FIXED = [*_CODE, *_TESTS]
PANDAS_FIXED = _CODE[:1]
NL = "chr(10)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def sub(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(by)}, 'g')"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def find(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({text}, {lit(pattern)}, {group})"


def find_all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, {group})"


def any_contains(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(p)})" for p in parts) + ")"


def any_suffix(text: str, parts) -> str:
    return "(" + " OR ".join(f"ends_with({text}, {lit(p)})" for p in parts) + ")"


def any_prefix(text: str, parts) -> str:
    return "(" + " OR ".join(f"starts_with({text}, {lit(p)})" for p in parts) + ")"


def any_match(text: str, patterns) -> str:
    return "(" + " OR ".join(has(text, p) for p in patterns) + ")"


def strip(text: str) -> str:
    return f"trim({text}, ' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11))"


def mask(text: str) -> str:
    return sub(text, PLAIN.lexeme, r"\1\2\3\4")


def shrink(text: str, group: str, by: str, levels: int = 10) -> str:
    for _ in range(levels):
        text = sub(text, group, by)
    return text


def blocks(text: str) -> str:
    marked = f"regexp_replace({text}, {lit(PLAIN.block_start)}, chr(1) || '\\1', 'g')"
    return f"string_split({marked}, chr(1))"


def unquote(text: str) -> str:
    width = f"(CASE WHEN {has(text, chr(94) + '(?:' + chr(34) * 3 + '|' + chr(39) * 3 + ')')} THEN 3 ELSE 1 END)"
    return f"substr({text}, {width} + 1, greatest(length({text}) - 2 * {width}, 0))"


def fixed_values(paths) -> str:
    rows = ", ".join(f"({i}, {lit(p)}, {'true' if below else 'false'})" for i, (p, below) in enumerate(paths))
    return f"(VALUES {rows}) AS v(scope_pos, tail, below)"


def expected(paths) -> str:
    return (
        "SELECT r.repo, r.branch, v.scope_pos, CASE WHEN v.below THEN r.repo || '/' || v.tail ELSE v.tail END AS path "
        f"FROM (SELECT DISTINCT repo, branch FROM listing) r CROSS JOIN {fixed_values(paths)}"
    )


def scope_list(globs, paths) -> str:
    parts = [
        f"SELECT repo, branch, path, {i} AS scope_part, file_ord AS scope_pos, false AS is_missing FROM listing WHERE {g}"
        for i, g in enumerate(globs)
    ]
    parts.append(
        f"SELECT e.repo, e.branch, e.path, {len(globs)} AS scope_part, CAST(e.scope_pos AS BIGINT) AS scope_pos, "
        f"l.path IS NULL AS is_missing FROM ({expected(paths)}) e LEFT JOIN listing l USING (repo, branch, path)"
    )
    return " UNION ALL ".join(parts)


PYTHON = "ends_with(path, '.py')"
BASE = "regexp_extract(path, '([^/]*)$', 1)"
FLAG_SCOPE = any_contains("path", P.FLAG_FRAGMENTS)
VERB_SCOPE = any_match(BASE, P.VERB_FILE_PATTERNS)
UDF_SCOPE = any_match(BASE, P.UDF_FILE_PATTERNS)
IS_TEST = r"(starts_with(path, 'test_') OR contains(path, '/test') OR contains(path, '\test'))"
MAIN_GLOB = "(path GLOB '*/transformations/transformations*.py')"
TEST_GLOB = "(path GLOB '*tests/transformations/test_transformations*.py')"
BELOW = f"(contains(path, repo || '/transformations/') AND contains({BASE}, 'transformations'))"
IS_CONF = "path = 'resources/application.conf'"
IS_APP = "path = repo || '/app.py'"
CONF_OBJECT = "contains(replace(content, ' = ', ''), '=')"
CODE_OBJECT = "contains(replace(replace(content, ' = ', ''), '==', ''), '=')"
PANDAS = "(regexp_matches(content, '(?m)^\\s*import\\s+pandas') OR regexp_matches(content, '(?m)^\\s*from\\s+pandas'))"
WRITES = f"(contains(content, '.write.') AND NOT contains(content, {lit(POLICY.sanctioned_writer)}))"
K = "repo, branch"
FK = "repo, branch, path"

CTE: dict[str, str] = {}

CTE["placed"] = """
SELECT doc_id, text, file_ord, k, repo, 'develop' AS branch,
  CASE WHEN file_ord < 17 AND doc_id % 11 = 3 THEN 'attic/part_' || file_ord || '.txt'
    WHEN file_ord = 0 THEN 'resources/application.conf' WHEN file_ord = 1 THEN 'requirements.txt'
    WHEN file_ord = 2 THEN 'sonar-project.properties' WHEN file_ord = 3 THEN 'Buildfile'
    WHEN file_ord = 4 THEN 'setup.cfg' WHEN file_ord = 5 THEN 'setup.py'
    WHEN file_ord = 6 THEN repo || '/__init__.py' WHEN file_ord = 7 THEN repo || '/app.py'
    WHEN file_ord = 8 THEN repo || '/utils/utils.py' WHEN file_ord = 9 THEN repo || '/fields.py'
    WHEN file_ord = 10 THEN repo || '/constants.py' WHEN file_ord = 11 THEN 'tests/test_app.py'
    WHEN file_ord = 12 THEN 'tests/utils/test_utils.py'
    WHEN file_ord = 13 THEN 'tests/transformations/test_transformations.py'
    WHEN file_ord = 14 THEN 'README.md' WHEN file_ord = 15 THEN 'CONTRIBUTING.md'
    WHEN file_ord = 16 THEN repo || '/experiment.py'
    WHEN file_ord = 22 THEN 'tests/transformations/test_transformations_more.py'
    WHEN file_ord = 24 THEN repo || '/old/transformations/transformations_17.py'
    ELSE repo || '/transformations/transformations_' || file_ord || '.py' END AS path
FROM (SELECT doc_id, coalesce(text, '') AS text, doc_id % 25 AS file_ord, doc_id // 25 AS k,
        'repo_' || (doc_id // 25) AS repo FROM documents)"""

CTE["listing"] = "SELECT repo, branch, file_ord, path FROM placed"

CTE["seeds"] = r"""
SELECT *, regexp_extract(text, '([A-Z][a-z]+[^.' || chr(10) || ']*)', 1) AS sent,
  lower(coalesce(nullif(regexp_extract(text, '([A-Za-z][a-z]+)', 1), ''), 'word')) AS w1,
  lower(coalesce(nullif(regexp_extract(text, '[A-Za-z][a-z]+[^A-Za-z]+([A-Za-z][a-z]+)', 1), ''), 'term')) AS w2,
  lower(coalesce(nullif(regexp_extract(text, '(?:^|[^A-Za-z])([A-Za-z]*[^\x00-\x7F]\p{L}*)', 1), ''), 'value')) AS w3,
  '1.' || (k % 3) || CASE WHEN doc_id % 17 = 0 THEN '.9' ELSE '.0' END AS ver
FROM placed"""

CTE["rf"] = r"""
SELECT repo, branch, file_ord, path, CASE
  WHEN file_ord = 0 THEN concat_ws(chr(10),
    CASE WHEN doc_id % 9 = 1 THEN '{' END, 'app {', '  SALES_INPUT = "/in"',
    CASE WHEN doc_id % 3 <> 0 THEN '  SALES_OUTPUT = "/out"' END,
    '  NOTE = "' || replace(replace(replace(text, chr(10), ' '), chr(92), repeat(chr(92), 2)), '"', chr(92) || '"') || '"', '  SCHEMA = "dev-bucket/nested"',
    CASE WHEN doc_id % 7 <> 0 THEN '}' END, CASE WHEN doc_id % 8 = 1 THEN 'MODE=batch' END,
    CASE WHEN doc_id % 4 = 0 THEN 'SCHEMA_PATH = "dev-bucket/x"' ELSE 'SCHEMA_PATH = "prod-bucket/x"' END,
    CASE WHEN doc_id % 12 = 0 THEN 'SCHEMA_PATH = "prod-bucket/y"' END,
    CASE WHEN doc_id % 5 = 1 THEN 'SCHEMA_NOTE = "prod/#x"  # not dev-bucket/x' END, CASE WHEN doc_id % 9 = 1 THEN '}' END)
  WHEN file_ord = 1 THEN 'pandas==1.5.3' || chr(10) || 'engine_sdk==0.' || (doc_id % 3 + 3) || '.' || (doc_id % 13) || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ')
  WHEN file_ord = 2 THEN CASE WHEN doc_id % 2 = 0
    THEN 'a=1' || chr(10) || 'sonar.python.coverage.reportPaths=coverage.xml' ELSE 'sonar.x=1' END || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ')
  WHEN file_ord = 3 THEN 'version = "' || ver || '"' || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ')
  WHEN file_ord = 4 THEN '[metadata]' || chr(10) || 'version = ' || ver || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ')
  WHEN file_ord = 5 THEN 'setup(version="' || ver || '")' || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ')
  WHEN file_ord = 6 THEN '__version__ = "' || ver || '"' || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ')
  WHEN file_ord IN (9, 10) THEN concat_ws(chr(10),
    repeat('"', 3) || replace(sent, '"', '') || repeat('"', 3), upper(w1) || '_FIELD = "' || w1 || '"',
    upper(w2) || '_FIELDS = ["' || w2 || '"]', upper(w1) || ' = {"k": 1}',
    'NOTES_FIELDS = ' || repeat('"', 3) || replace(text, '"', '') || repeat('"', 3),
    'PAIR_FIELD = ("a",' || chr(10) || '    "b, c")  # two', 'class Names:',
    '    ' || upper(w2) || '_FIELD = {"a": [1, 2], "b": 2}', '    LIMIT_FIELDS = 10',
    '    def run(self):', '        INNER = 1', '',
    CASE WHEN doc_id % 2 = 0 THEN upper(w1) || '_FIELD = ["x", "y"]' END,
    'DEEP_FIELD = {"a": [[[[[[1]]]]]], "b": 2}', 'AÑO_FIELD = 1', 'class Two:', '  # two', '  TWO_FIELD = 2', '',
    'COLUMN_FIELDS = F.col("x")', 'EMPTY_FIELDS = []', 'lower_name = 1', '')
  WHEN file_ord IN (14, 15) THEN text
  ELSE concat_ws(chr(10),
    CASE WHEN doc_id % 4 = 0 THEN '# ' || replace(text, chr(10), chr(10) || '# ') END,
    CASE WHEN doc_id % 3 = 0 THEN '# ---- #' || chr(10) || '# Your code starts here' END,
    CASE WHEN doc_id % 7 = 0 THEN '#!/usr/bin/env python' || chr(10) || '# -*- coding: utf-8 -*-' END,
    CASE WHEN doc_id % 37 = 0 THEN 'import pandas as pd' END,
    CASE WHEN doc_id % 41 = 0 THEN 'from pyspark.sql.functions import udf' END,
    CASE WHEN doc_id % 19 = 0 THEN 'import pyspark.sql.functions as F' END,
    'def ' || CASE WHEN starts_with(path, 'tests/') THEN 'test_' ELSE '' END || CASE doc_id % 6
        WHEN 0 THEN 'join_' || w1 || '_with_' || w2 WHEN 1 THEN 'filter_' || w1
        WHEN 2 THEN 'group_' || w1 || '_by_' || w2 WHEN 3 THEN w1 || '_' || w2
        WHEN 4 THEN 'add_' || w1 ELSE 'union_' || w1 END
      || '(self, ' || w1 || '_df, ' || w2 || '_v=(1, [2, 3]), ' || w3 || '9: int = 3):',
    '    ' || repeat('"', 3) || sent, '', '    :param ' || w1 || '_df: input',
    CASE WHEN doc_id % 3 = 1 THEN concat_ws(chr(10), '    :param alpha: a', '    :param beta: b',
        '    :param gamma: c', '    :param delta: d') END,
    text, '    ' || repeat('"', 3), '    add_' || w1 || ' = 1', '    ' || w2 || '_total, other = 1, 2',
    '    ' || w3 || '_Total9 = other',
    CASE WHEN doc_id % 29 = 0 THEN '    x = spark.read.parquet("p")' END,
    CASE WHEN doc_id % 31 = 0 THEN '    x.write.parquet("p")' END,
    CASE WHEN doc_id % 23 = 0 THEN '    x.coalesce(1)' END,
    CASE WHEN doc_id % 43 = 0 THEN '    base_path = "/data"' END,
    CASE WHEN doc_id % 47 = 0 THEN '    conf = "org.apache.hadoop.fs"' END,
    CASE WHEN doc_id % 62 = 0 THEN '    engine_mock.write(x)' END,
    CASE WHEN doc_id % 4 = 1 THEN '    for row in rows:' || chr(10) || '        add_row = row' END,
    '    return ' || w1 || '_df', '',
    CASE WHEN doc_id % 8 = 3 THEN concat_ws(chr(10), 'def deep_' || w1 || '(a, b=f(g(h(i(j(k([1])))))), c=2) -> Dict[', '    str, int',
        ']:', '    ' || repeat('"', 3) || 'Deep ' || w1 || '.' || repeat('"', 3), '    x_df.select(',
        '        add_kw=f(g(h(i(j(k(1)))))),', '        b=2)', '    if a: late_value = 3', '    left_value, *rest_value = 1, 2; last_value = 4',
        '    def inner_part(b):', '        inner_value = 1', '    deep_value = 1', '') END,
    CASE WHEN doc_id % 9 = 4 THEN concat_ws(chr(10), 'class ' || w1 || 'Job:', '    def setUp(self):', '        pass',
        '', '    def bad_' || w1 || '(self, ' || w2 || ', *args, key=None):', '        ''''''Short note.''''''',
        '        self.value = 1', '        ' || w1 || '_Value = dict(', '            add_key=1,',
        '            b=[2, 3])', '') END,
    'def run(spark):', '    return 1', '') END AS content
FROM seeds"""

CTE["repos"] = "SELECT DISTINCT repo, branch FROM listing"

# --- sources -------------------------------------------------------------------------------
CTE["requests"] = r"""
SELECT page_id AS request_id,
  CASE WHEN page_id % 13 = 0 THEN '' WHEN page_id % 7 = 0 THEN browse || '/' WHEN page_id % 5 = 0 THEN url
    WHEN page_id % 11 = 0 THEN 'x/y' ELSE browse END AS url,
  CASE WHEN page_id % 3 = 0 THEN '  ' WHEN page_id % 4 <> 0
    THEN ' ' || regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) || ' ' END AS branch,
  contains(url, '?') AS has_token
FROM (SELECT page_id, url, regexp_replace(url, '^(https?://[^/]+)/([a-z]+)/([0-9]+)(.*)$',
        '\1/projects/\2/repos/repo_' || (page_id // 25) || '/browse\4') AS browse FROM pages)"""
CTE["q_branch_default"] = (
    f"SELECT request_id, coalesce(nullif({strip('branch')}, ''), {lit(POLICY.default_branch)}) AS branch FROM requests"
)
CTE["q_repo_url_parse"] = (
    f"SELECT request_id, url, {has('url', POLICY.url_pattern)} AS is_valid, "
    "string_split(url, '/')[-4] AS project, string_split(url, '/')[-2] AS repo FROM requests"
)
CTE["q_request_filter"] = """
SELECT request_id, url, url <> '' AND has_token AS accepted,
  CASE WHEN url = '' AND NOT has_token THEN 'no url and token' WHEN url = '' THEN 'no url'
    WHEN NOT has_token THEN 'no token' END AS reason FROM requests"""
CTE["q_repo_manifest"] = (
    "SELECT repo, branch, count(*) AS n_files, count(DISTINCT path) AS n_paths FROM listing GROUP BY ALL"
)
CTE["q_content_lookup"] = (
    f"SELECT e.repo, e.branch, e.path, coalesce(rf.content, '') AS content, rf.path IS NULL AS is_missing "
    f"FROM ({expected(POLICY.expected_paths())}) e LEFT JOIN rf USING (repo, branch, path)"
)
CTE["q_expected_files_missing"] = (
    f"SELECT e.repo, e.branch, e.path FROM ({expected(POLICY.expected_paths())}) e ANTI JOIN listing USING (repo, branch, path)"
)

# --- scopes --------------------------------------------------------------------------------
CTE["q_scope_flags"] = (
    "SELECT repo, branch, path, CAST(sum(CAST(contains(path, f) AS INT)) AS INT) AS n_matches FROM listing, "
    f"(VALUES {', '.join(f'({lit(f)})' for f in P.FLAG_FRAGMENTS)}) AS v(f) GROUP BY ALL HAVING sum(CAST(contains(path, f) AS INT)) > 0"
)
CTE["q_scope_verbs"] = f"SELECT {FK} FROM listing WHERE {VERB_SCOPE}"
CTE["q_scope_udf"] = f"SELECT {FK} FROM listing WHERE {UDF_SCOPE}"
CTE["q_pick_fields_file"] = (
    f"SELECT {K}, arg_min(path, file_ord) AS path FROM listing WHERE path LIKE '%fields.py' GROUP BY ALL"
)
CTE["q_scope_language"] = scope_list([BELOW], LANGUAGE_FIXED)
CTE["q_scope_globs"] = (
    f"SELECT {FK}, 'main' AS glob FROM listing WHERE {MAIN_GLOB} UNION ALL SELECT {FK}, 'test' FROM listing WHERE {TEST_GLOB}"
)
CTE["q_scope_variables"] = scope_list([MAIN_GLOB, TEST_GLOB], VARIABLE_FIXED)
CTE["q_scope_pandas"] = scope_list([MAIN_GLOB, TEST_GLOB], PANDAS_FIXED)
CTE["q_is_test_file"] = f"SELECT {FK}, {IS_TEST} AS is_test FROM listing"

# --- flags ---------------------------------------------------------------------------------
FLAGS = {
    "spark_read": "contains(content, 'spark.read.')",
    "hadoop": "contains(content, 'apache.hadoop')",
    "spark_write": WRITES,
    "compaction": "(contains(content, '.coalesce(') OR contains(content, 'compact'))",
    "base_path": "(contains(content, 'base_path') OR contains(content, 'full_path'))",
}
for _name, _flag in FLAGS.items():
    CTE[f"q_flag_{_name}"] = f"SELECT {FK}, {_flag} AS flagged FROM rf WHERE {FLAG_SCOPE}"
CTE["q_flag_partition_read"] = f"""
SELECT f.repo, f.branch, f.path, {CODE_OBJECT.replace('content', 'f.content')} OR coalesce({CONF_OBJECT.replace('content', 'c.content')}, false) AS flagged
FROM (SELECT * FROM rf WHERE {FLAG_SCOPE}) f LEFT JOIN (SELECT * FROM rf WHERE {IS_CONF}) c USING (repo, branch)"""
CTE["q_flag_app_logic"] = f"""
SELECT r.repo, r.branch, coalesce(contains(content, 'if ') OR contains(content, 'for ') OR contains(content, 'else '), false) AS has_logic
FROM repos r LEFT JOIN (SELECT * FROM rf WHERE {IS_APP}) a USING (repo, branch)"""
CTE["q_flag_pandas"] = f"""
SELECT {FK}, s.scope_part, s.scope_pos, coalesce({PANDAS}, false) AS uses_pandas
FROM q_scope_pandas s LEFT JOIN rf USING (repo, branch, path)"""
CTE["q_last_wins_by_basename"] = f"""
SELECT {K}, {BASE} AS basename, arg_max(uses_pandas, scope_part * 1000000 + scope_pos) AS uses_pandas
FROM q_flag_pandas GROUP BY ALL"""
CTE["q_pandas_file_count"] = (
    f"SELECT {K}, count(*) FILTER (WHERE uses_pandas) AS n_pandas_files FROM q_last_wins_by_basename GROUP BY ALL"
)
CTE["q_flags_by_repo"] = f"""
SELECT r.repo, r.branch, any_read AS spark_read, any_hadoop AS hadoop, any_object AS partition_read, any_write AS spark_write,
  any_compact AS compaction, any_base AS base_path, CASE WHEN any_read IS NULL THEN 'NO_SCOPE_FILES' ELSE 'OK' END AS audit_status
FROM repos r LEFT JOIN (
  SELECT rf.repo, rf.branch, bool_or({FLAGS['spark_read']}) AS any_read, bool_or({FLAGS['hadoop']}) AS any_hadoop,
    bool_or(p.flagged) AS any_object, bool_or({FLAGS['spark_write']}) AS any_write,
    bool_or({FLAGS['compaction']}) AS any_compact, bool_or({FLAGS['base_path']}) AS any_base
  FROM rf JOIN q_flag_partition_read p USING (repo, branch, path) GROUP BY ALL) f USING (repo, branch)"""
CTE["q_check_sonar"] = f"""
SELECT r.repo, r.branch, coalesce(contains(content, {lit(POLICY.coverage_line)}), false) AS passed
FROM repos r LEFT JOIN (SELECT * FROM rf WHERE path = 'sonar-project.properties') s USING (repo, branch)"""

# --- configuration and versions ------------------------------------------------------------
CTE["conf"] = f"""
SELECT r.repo, r.branch, coalesce(content, '') AS content
FROM repos r LEFT JOIN (SELECT * FROM rf WHERE {IS_CONF}) c USING (repo, branch)"""
CTE["q_check_conf_size"] = f"""
SELECT {K}, n AS conf_chars, CASE WHEN n = 0 THEN 'NO_BRACE' WHEN n > {POLICY.max_conf_chars} THEN 'TOO_LONG' ELSE 'OK' END AS status
FROM (SELECT {K}, CAST(CASE WHEN instr(content, '{{') > 0 THEN
    length(replace(substr(content, instr(content, '{{')), {NL}, chr(13) || {NL})) ELSE 0 END AS INT) AS n FROM conf)"""
CTE["conf_lines"] = f"""
SELECT {K}, CASE WHEN starts_with({strip('content')}, '{{') THEN 1 ELSE 0 END AS top,
  unnest(string_split(content, {NL})) AS raw, generate_subscripts(string_split(content, {NL}), 1) AS i FROM conf"""
CTE["conf_depth"] = rf"""
SELECT *, coalesce(sum(delta) OVER (PARTITION BY repo, branch ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth,
  sum(delta) OVER (PARTITION BY repo, branch ORDER BY i) AS depth_after
FROM (SELECT *, length(code) - length(replace(code, '{{', '')) - length(code) + length(replace(code, '}}', '')) AS delta
  FROM (SELECT *, {sub(sub('raw', r'"(?:[^"\\]|\\.)*"', '"'), r'(?:#|//)[^' + chr(10) + r']*')} AS code,
    {sub('raw', r'("(?:[^"\\]|\\.)*")|(?:#|//)[^' + chr(10) + r']*', chr(92) + '1')} AS kept FROM conf_lines))"""
CTE["conf_schema_keys"] = rf"""
SELECT {K}, key, arg_max(contains(value, {lit(POLICY.forbidden_schema_value)}), i) AS bad
FROM (SELECT *, {find('kept', r'^[ \t]*"?([^"=:.{}\[\],]*?)"?[ \t]*[=:]', 1)} AS key,
    {strip(find('kept', r'^[^=:]*[=:](.*)$', 1))} AS value FROM conf_depth WHERE depth = top AND {has('code', '[=:]')})
WHERE contains(upper(key), 'SCHEMA') AND NOT {has('value', r'^[\[{]')} GROUP BY ALL"""
CTE["q_check_conf_schema"] = f"""
SELECT d.repo, d.branch, CASE WHEN final <> 0 OR lowest < 0 THEN 'UNPARSABLE' WHEN coalesce(any_bad, false) THEN 'ERROR' ELSE 'OK' END AS status
FROM (SELECT {K}, arg_max(depth_after, i) AS final, min(depth_after) AS lowest FROM conf_depth GROUP BY ALL) d
LEFT JOIN (SELECT {K}, bool_or(bad) AS any_bad FROM conf_schema_keys GROUP BY ALL) s USING (repo, branch)"""
CTE["q_check_io_suffixes"] = f"""
SELECT r.repo, r.branch, coalesce(i AND o, false) AS passed FROM repos r LEFT JOIN (
  SELECT {K}, bool_or(ends_with(key, 'INPUT')) AS i, bool_or(ends_with(key, 'OUTPUT')) AS o
  FROM (SELECT {K}, upper({strip("split_part(raw, '=', 1)")}) AS key FROM conf_lines WHERE contains(raw, '=')) GROUP BY ALL) USING (repo, branch)"""
CTE["q_check_docs_present"] = (
    f"SELECT {K}, bool_or(contains(path, 'CONTRIBUTING')) AND bool_or(contains(path, 'README')) AS passed FROM listing GROUP BY ALL"
)
_min = POLICY.min_sdk_version
CTE["q_check_min_version"] = f"""
SELECT {K}, v AS sdk_version, coalesce(NOT list_contains(list_transform(parts, lambda p: p IS NULL), true)
  AND parts >= [{', '.join(map(str, _min))}], false) AS passed
FROM (SELECT *, list_transform(string_split(v, '.'), lambda p: TRY_CAST(p AS INT)) AS parts FROM (
  SELECT r.repo, r.branch, nullif({find('content', POLICY.sdk_package + '==([0-9.]+)', 1)}, '') AS v
  FROM repos r LEFT JOIN (SELECT * FROM rf WHERE path = 'requirements.txt') q USING (repo, branch)))"""


def _version(path: str, pattern: str) -> str:
    return (
        f"SELECT {K}, CASE WHEN {has('content', pattern)} THEN {strip(find('content', pattern, 1))} END AS version FROM rf WHERE path = {path}"
    )


NOT_FOUND = "version not found"
CTE["versions"] = rf"""
SELECT {K}, 'setup.cfg' AS source, version, true AS is_found FROM (
  SELECT {K}, nullif({find("string_split(content, chr(10))[2]", r'=\s*(\S+)', 1)}, '') AS version FROM rf WHERE path = 'setup.cfg') WHERE version IS NOT NULL
UNION ALL SELECT r.repo, r.branch, 'setup.cfg', {lit(NOT_FOUND)}, false FROM repos r
  ANTI JOIN (SELECT * FROM rf WHERE path = 'setup.cfg' AND len(string_split(content, chr(10))) > 1) c USING (repo, branch)
UNION ALL SELECT {K}, 'setup.py', version, true FROM ({_version("'setup.py'", 'version=["' + chr(39) + '](.*?)["' + chr(39) + ']')}) WHERE version IS NOT NULL
UNION ALL SELECT {K}, '__init__.py', version, true FROM ({_version("repo || '/__init__.py'", r'__version__\s*=\s*["' + chr(39) + '](.*?)["' + chr(39) + ']')}) WHERE version IS NOT NULL
UNION ALL SELECT {K}, {lit(POLICY.build_file)}, version, true FROM ({_version(lit(POLICY.build_file), r'version\s*=\s*["' + chr(39) + '](.*?)["' + chr(39) + ']')}) WHERE version IS NOT NULL"""
CTE["q_version_extract"] = "SELECT * FROM versions"
CTE["q_version_consistency"] = f"""
SELECT r.repo, r.branch, CAST(count(version) AS INT) AS n_found, CAST(count(DISTINCT version) AS INT) AS n_distinct,
  count(DISTINCT version) = 1 AS is_consistent
FROM repos r LEFT JOIN (SELECT * FROM versions WHERE is_found) v USING (repo, branch) GROUP BY ALL"""
CTE["q_version_vs_reference"] = f"""
SELECT v.repo, v.branch, v.source, v.version, e.version AS expected,
  CASE WHEN c.is_consistent THEN 'CORRECT' WHEN v.source = 'setup.cfg' THEN 'REFERENCE' WHEN e.version IS NULL THEN 'INCONSISTENT'
    WHEN v.version = e.version THEN 'MATCH' ELSE 'SHOULD_BE' END AS status
FROM versions v JOIN q_version_consistency c USING (repo, branch)
LEFT JOIN (SELECT * FROM versions WHERE source = 'setup.cfg') e USING (repo, branch)"""

# --- symbols -------------------------------------------------------------------------------
CTE["fn_tokens"] = f"""
SELECT {FK}, t, row_number() OVER (PARTITION BY repo, branch, path ORDER BY i) - 1 AS fn_pos FROM (
  SELECT {FK}, unnest(toks) AS t, generate_subscripts(toks, 1) AS i
  FROM (SELECT {FK}, {find_all('content', PLAIN.function_or_lexeme)} AS toks FROM rf WHERE {PYTHON}))
WHERE {has('t', PLAIN.block_header)}"""
CTE["fn_raw"] = f"""
SELECT {FK}, CAST(fn_pos AS INT) AS fn_pos, CAST(length({find('t', PLAIN.block_header, 1)}) AS INT) AS indent,
  {find('t', PLAIN.block_header, 2)} AS fn_name, {find('t', PLAIN.header, 3)} AS params,
  string_split({unquote('d')}, {NL}) AS lines
FROM (SELECT *, {find('t', PLAIN.function, 4)} AS d FROM fn_tokens)"""
CTE["fns"] = f"""
SELECT {FK}, fn_pos, indent, fn_name, params,
  {sub(f"rtrim(array_to_string(list_concat([ltrim(lines[1])], list_transform(lines[2:], lambda x: substr(x, margin + 1))), {NL}))", r'^\s+|\s+$')} AS docstring
FROM (SELECT *, coalesce(list_min(list_transform(list_filter(lines[2:], lambda x: {strip('x')} <> ''),
  lambda x: length(x) - length(ltrim(x)))), 0) AS margin FROM fn_raw)"""
CTE["masked"] = f"SELECT {FK}, file_ord, {mask('content')} AS code FROM rf WHERE {PYTHON}"
CTE["fn_blocks"] = f"""
SELECT {FK}, b, CAST(row_number() OVER (PARTITION BY repo, branch, path ORDER BY i) - 1 AS INT) AS fn_pos FROM (
  SELECT {FK}, unnest(bs) AS b, generate_subscripts(bs, 1) AS i FROM (SELECT {FK}, {blocks('code')} AS bs FROM masked))
WHERE {has('b', PLAIN.block_header)}"""
CTE["q_extract_functions"] = f"""
SELECT {FK}, fn_pos, CAST(length({find('b', PLAIN.block_header, 1)}) AS INT) AS indent, {find('b', PLAIN.block_header, 2)} AS fn_name FROM fn_blocks"""
def one_statement_a_line(text: str) -> str:
    apart = f"regexp_replace({text}, ';[ ' || chr(9) || ']*', chr(10) || repeat(' ', {AFTER_SEMICOLON}), 'g')"
    return sub(apart, ONE_LINE_BLOCK, r"\1\2")


CTE["indented_lines"] = f"""
SELECT {FK}, n, line, length(line) - length(ltrim(line, ' ' || chr(9))) AS indent FROM (
  SELECT {FK}, unnest(ls) AS line, generate_subscripts(ls, 1) AS n
  FROM (SELECT {FK}, string_split({shrink('code', CALL_GROUP, '')}, {NL}) AS ls FROM masked))
WHERE {strip('line')} <> ''"""
# a line lies in the blocks of all earlier lines of less indent that no line of as little indent has ended
CTE["line_ends"] = f"""
SELECT b.repo, b.branch, b.path, b.n, b.indent, min(c.n) AS ends FROM indented_lines b
LEFT JOIN indented_lines c ON c.repo = b.repo AND c.branch = b.branch AND c.path = b.path AND c.n > b.n AND c.indent <= b.indent GROUP BY ALL"""
CTE["line_depths"] = f"""
SELECT a.repo, a.branch, a.path, a.n, any_value(a.line) AS line, 1 + count(b.n) AS depth FROM indented_lines a
LEFT JOIN line_ends b ON a.repo = b.repo AND a.branch = b.branch AND a.path = b.path
  AND b.n < a.n AND b.indent < a.indent AND (b.ends IS NULL OR b.ends > a.n)
GROUP BY a.repo, a.branch, a.path, a.n"""
CTE["targets"] = f"""
SELECT {FK}, depth, n, i, j, lower(name) AS name FROM (
  SELECT {FK}, depth, n, i, unnest(names) AS raw, generate_subscripts(names, 1) AS j, {strip('raw')} AS name FROM (
    SELECT {FK}, depth, n, i, string_split(g, ',') AS names FROM (
      SELECT {FK}, depth, n, unnest(gs) AS g, generate_subscripts(gs, 1) AS i FROM (
        SELECT {FK}, n, depth + CAST({has('line', ONE_LINE_BLOCK)} AS INT) AS depth, {find_all(one_statement_a_line('line'), PLAIN.assignment, 1)} AS gs FROM line_depths))))
WHERE {has('name', f'^{IDENT}$')} AND NOT {has('name', '^[0-9]')}"""
CTE["q_extract_assignments"] = (
    f"SELECT {FK}, CAST(row_number() OVER (PARTITION BY repo, branch, path ORDER BY depth, n, i, j) - 1 AS INT) AS pos, name FROM targets"
)
CTE["param_names"] = rf"""
SELECT {FK}, fn_pos, fn_name, indent, docstring, list_filter(CASE WHEN coalesce(list_position(pre, '/'), 0) > 0
  THEN pre[list_position(pre, '/') + 1:] ELSE pre END, lambda x: x NOT IN ('', 'self', 'cls')) AS names
FROM (SELECT *, CASE WHEN coalesce(list_position(parts, '*'), 0) > 0 THEN parts[1:list_position(parts, '*') - 1] ELSE parts END AS pre
  FROM (SELECT *, list_transform(string_split({shrink(mask('params'), BRACKET_GROUP, '')}, ','),
    lambda p: {find('p', rf'^\s*([*/]|{IDENT})', 1)}) AS parts FROM fns))"""
CTE["q_extract_params"] = f"""
SELECT {FK}, fn_pos, fn_name, CAST(generate_subscripts(names, 1) - 1 AS INT) AS param_pos, unnest(names) AS param FROM param_names"""
CTE["doc_lines"] = f"""
SELECT {FK}, fn_pos, fn_name, indent, CAST(generate_subscripts(ls, 1) AS INT) AS line_no, {strip('unnest(ls)')} AS line
FROM (SELECT *, string_split(docstring, {NL}) AS ls FROM fns WHERE docstring <> '')"""
CTE["q_extract_docstrings"] = f"SELECT {FK}, fn_pos, fn_name, line_no, line FROM doc_lines"
CTE["q_docstring_params"] = f"""
SELECT {FK}, fn_pos, fn_name, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS param_pos, unnest(ps) AS param
FROM (SELECT *, {find_all('docstring', PARAM_DOC, 1)} AS ps FROM fns)"""
CTE["code_lines"] = rf"""
SELECT *, length({find('line', '^([ ' + chr(9) + ']*)', 1)}) AS ind, {has('line', PLAIN.block_header)} AS is_def FROM (
  SELECT {FK}, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln
  FROM (SELECT {FK}, string_split({one_statement_a_line(shrink('code', BRACKET_GROUP, chr(2)))}, {NL}) AS ls FROM masked))"""
CTE["def_lines"] = rf"""
SELECT d.repo, d.branch, d.path, d.ln, d.ind, any_value(d.line) AS line, min(n.ln) AS stop,
  CAST(row_number() OVER (PARTITION BY d.repo, d.branch, d.path ORDER BY d.ln) - 1 AS INT) AS fn_pos
FROM code_lines d LEFT JOIN code_lines n ON d.repo = n.repo AND d.branch = n.branch AND d.path = n.path AND n.ln > d.ln AND n.ind <= d.ind
  AND {has('n.line', '[^ ' + chr(9) + ']')}
WHERE d.is_def GROUP BY d.repo, d.branch, d.path, d.ln, d.ind"""
CTE["local_vars"] = rf"""
SELECT DISTINCT {FK}, fn_pos, fn_name, indent, variable FROM (
  SELECT d.repo, d.branch, d.path, fn_pos, {find('d.line', PLAIN.block_header, 2)} AS fn_name, CAST(d.ind AS INT) AS indent,
    {strip(find('n.line', rf'^([ {chr(9)}]*{IDENT}[ {chr(9)}]*)=(?:[^=]|$)', 1))} AS variable
  FROM def_lines d JOIN code_lines n ON d.repo = n.repo AND d.branch = n.branch AND d.path = n.path AND n.ln > d.ln AND (stop IS NULL OR n.ln < stop))
WHERE variable <> '' AND NOT {has('variable', '^[0-9]')}"""
CTE["telling_vars"] = f"""
SELECT * FROM local_vars WHERE variable NOT IN {in_list(P.TECHNICAL_NAMES)} AND length(variable) > 4
  AND NOT {any_suffix('variable', P.VARIABLE_SUFFIXES)} AND NOT {any_contains('variable', P.VARIABLE_INFIXES)}"""
CTE["q_extract_local_vars"] = f"SELECT {FK}, fn_pos, fn_name, variable FROM telling_vars"

# --- naming --------------------------------------------------------------------------------
PREFIX = "split_part(fn_name, '_', 1)"
CTE["checked"] = f"""
SELECT {FK}, fn_pos, fn_name, is_test FROM (
  SELECT *, {IS_TEST} AS is_test, row_number() OVER (PARTITION BY repo, branch, path ORDER BY indent, fn_pos) AS rank
  FROM q_extract_functions WHERE {VERB_SCOPE})
WHERE NOT (is_test AND rank = 1) AND fn_name NOT IN {in_list(POLICY.ignored_functions)}"""
CTE["q_test_fn_skip_first"] = f"SELECT {FK}, fn_pos, fn_name FROM checked WHERE is_test"
CTE["q_fn_verb_violations"] = f"""
SELECT {FK}, fn_pos, fn_name FROM checked WHERE NOT is_test AND ({PREFIX} NOT IN {in_list(POLICY.verbs)}
  OR {' OR '.join(f"({PREFIX} = {lit(v)} AND NOT contains(fn_name, {lit(i)}))" for v, i in POLICY.required_infixes)})"""
CTE["q_test_fn_violations"] = f"""
SELECT {FK}, fn_pos, fn_name FROM checked WHERE is_test AND (NOT starts_with(fn_name, 'test_')
  OR split_part(fn_name, '_', 2) NOT IN {in_list(POLICY.verbs)})"""
CTE["verb_blocks"] = f"""
SELECT {FK}, {BASE} || ':' || {NL} || string_agg('    ' || rn || '. ' || fn_name, {NL} ORDER BY rn) AS block FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, branch, path ORDER BY fn_name) AS rn
  FROM (SELECT * FROM q_fn_verb_violations UNION ALL SELECT * FROM q_test_fn_violations)) GROUP BY {FK}"""
CTE["q_fn_verb_report"] = f"""
SELECT b.repo, b.branch, {BASE} AS sort_name, file_ord, block FROM verb_blocks b JOIN listing USING (repo, branch, path)
UNION ALL SELECT repo, branch, '', 0, 'OK' FROM repos ANTI JOIN verb_blocks USING (repo, branch)"""
CTE["verb_vars"] = f"""
SELECT a.repo, a.branch, a.path, {BASE} AS basename, a.pos, a.name, s.ord FROM q_extract_assignments a
JOIN (SELECT {FK}, max(scope_part * 1000000 + scope_pos) AS ord FROM q_scope_variables WHERE NOT is_missing GROUP BY ALL) s USING (repo, branch, path)
WHERE split_part(a.name, '_', 1) IN {in_list(POLICY.verbs)}"""
CTE["q_variable_verb_violations"] = f"""
SELECT {K}, basename, CAST(row_number() OVER (PARTITION BY repo, branch, basename ORDER BY pos) AS INT) AS seq, name FROM (
  SELECT *, max(ord) OVER (PARTITION BY repo, branch, basename) AS last_ord FROM verb_vars) WHERE ord = last_ord"""
_hits = " UNION ALL ".join(
    f"SELECT {FK}, i, {n} AS n, {lit(label)} AS label FROM udf_lines WHERE {has('line', pattern)}"
    for n, (pattern, label) in enumerate(POLICY.udf_imports)
)
CTE["udf_lines"] = f"""
SELECT * FROM (SELECT {FK}, {strip('unnest(ls)')} AS line, generate_subscripts(ls, 1) AS i
  FROM (SELECT {FK}, string_split(content, {NL}) AS ls FROM rf WHERE {UDF_SCOPE})) WHERE NOT starts_with(line, '#')"""
CTE["q_udf_import_hits"] = f"""
SELECT {FK}, CAST(row_number() OVER (PARTITION BY repo, branch, path ORDER BY i, n) AS INT) AS seq, CAST(i AS INT) AS line_no, label FROM ({_hits})"""
CTE["udf_blocks"] = f"""
SELECT {FK}, {BASE} || ':' || {NL} || string_agg('    ' || seq || '. ' || label, {NL} ORDER BY seq) AS block FROM q_udf_import_hits GROUP BY {FK}"""
CTE["q_udf_report"] = f"""
SELECT b.repo, b.branch, '' AS sort_name, file_ord, block FROM udf_blocks b JOIN listing USING (repo, branch, path)
UNION ALL SELECT repo, branch, '', 0, 'OK' FROM repos ANTI JOIN udf_blocks USING (repo, branch)"""

# --- constants -----------------------------------------------------------------------------
CTE["const_tokens"] = f"""
SELECT {FK}, file_ord, unnest(toks) AS t, generate_subscripts(toks, 1) AS i
FROM (SELECT {FK}, file_ord, {find_all(f'content || {NL}', PLAIN.module_constant)} AS toks FROM rf WHERE {PYTHON})"""
CTE["const_heads"] = f"""
SELECT {FK}, t, i, 0 AS j FROM const_tokens WHERE NOT starts_with(t, 'class')
UNION ALL SELECT {FK}, t, i, j FROM (
  SELECT {FK}, margin, unnest(inner_toks) AS t, i, generate_subscripts(inner_toks, 1) AS j
  FROM (SELECT {FK}, i, {find('t', CLASS_MARGIN, 1)} AS margin, {find_all('t', PLAIN.class_constant)} AS inner_toks FROM const_tokens WHERE starts_with(t, 'class')))
WHERE {find('t', '^([ ' + chr(9) + ']*)', 1)} = margin"""
CTE["const_rows"] = rf"""
SELECT {FK}, row_number() OVER (PARTITION BY repo, branch, path ORDER BY i, j) - 1 AS pos, name, value, in_class FROM (
  SELECT {FK}, i, j, {find('t', rf'^[ \t]*({UPPER_NAME})', 1)} AS name, {strip(find('t', r'^[^=]*=((?s:.*))$', 1))} AS value,
    {has('t', '^[ \t]')} AS in_class FROM const_heads WHERE {has('t', CONSTANT_HEAD)})
WHERE {has('name', chr(92) + 'p{Lu}')} AND NOT starts_with(value, '=')"""
CTE["const_last"] = f"""
SELECT {FK}, name, min(pos) AS pos, arg_max(value, pos) AS value, arg_max(in_class, pos) AS in_class FROM const_rows GROUP BY ALL"""
CTE["const_masked"] = rf"""
SELECT *, {sub('m', r'\b(?:True|False|None)\b', '0')} AS plain FROM (
  SELECT *, {sub(mask('value'), r'\b[rRuUbB]{1,2}(["' + chr(39) + '])', r'\1')} AS m FROM const_last)"""
CTE["const_shape"] = rf"""
SELECT *, outer_text = '0' AND first IN ('[', '(', '{{') AS is_group,
  NOT {has('plain', r'(?:^|[^0-9A-Za-z_.])[A-Za-z_]')} AND NOT {has('plain', r'[0-9"' + chr(39) + r'\])}][ \t\n]*[-+*/%|&<>@]')} AS is_literal
FROM (SELECT *, left(plain, 1) AS first, {shrink('plain', BRACKET_GROUP, '0')} AS outer_text,
    {strip(shrink('substr(plain, 2, greatest(length(plain) - 2, 0))', BRACKET_GROUP, '0'))} AS inner_text FROM const_masked)"""
CTE["const_kind"] = rf"""
SELECT *, CASE WHEN is_literal AND shape <> 'scalar' THEN shape
    WHEN is_literal THEN CASE WHEN first IN ('"', '''') THEN 'str' WHEN m IN ('True', 'False') THEN 'bool' WHEN m = 'None' THEN 'NoneType'
      WHEN {has('m', r'^[-+]?(?:[0-9_]+|0[xXoObB][0-9A-Fa-f_]+)$')} THEN 'int' ELSE 'float' END
    WHEN NOT in_class AND shape IN ('dict', 'list') THEN shape ELSE 'NoneType' END AS type
FROM (SELECT *, CASE WHEN is_group AND first = '{{' AND (contains(inner_text, ':') OR inner_text = '') THEN 'dict'
    WHEN is_group AND first = '{{' THEN 'set' WHEN is_group AND first = '[' THEN 'list'
    WHEN is_group AND (contains(inner_text, ',') OR inner_text = '') THEN 'tuple'
    WHEN NOT is_group AND contains(outer_text, ',') THEN 'tuple' ELSE 'scalar' END AS shape FROM const_shape)"""
CTE["consts"] = rf"""
SELECT {FK}, CAST(pos AS INT) AS pos, name, type,
  CAST(CASE WHEN is_literal AND shape <> 'scalar' THEN len(list_filter(string_split(CASE WHEN is_group THEN inner_text ELSE outer_text END, ','),
    lambda e: {strip('e')} <> '')) ELSE 0 END AS INT) AS size,
  CASE WHEN type = 'str' THEN {unquote('bare')} WHEN type = 'NoneType' THEN 'None' ELSE value END AS text
FROM (SELECT *, {sub('value', r'^[rRuUbB]{1,2}(["' + chr(39) + '])', r'\1')} AS bare FROM const_kind)"""
CTE["const_plural"] = """
SELECT *, type = 'dict' OR (type IN ('list', 'tuple', 'set') AND size > 1) AS is_plural,
  CASE WHEN type IN ('dict', 'list', 'tuple', 'set') THEN type WHEN type = 'NoneType' THEN 'none' ELSE 'scalar' END AS value_kind FROM consts"""
SUGGESTED = "regexp_replace(name, '_FIELDS?$', '') || CASE WHEN is_plural THEN '_FIELDS' ELSE '_FIELD' END"
CTE["q_extract_constants"] = (
    f"SELECT {FK}, pos, name, value_kind, size AS n_elems, text AS value_text, type AS value_type FROM const_plural"
)
CTE["q_const_plurality"] = f"SELECT {FK}, name, value_kind, size AS n_elems, is_plural FROM const_plural"
CTE["q_const_suggested_name"] = f"SELECT {FK}, name, {SUGGESTED} AS suggested FROM const_plural"
CTE["const_errors"] = f"""
SELECT {FK}, name, suggested, detail, CAST(row_number() OVER (PARTITION BY repo, branch, path ORDER BY pos) AS INT) AS seq FROM (
  SELECT c.*, {SUGGESTED} AS suggested,
    CASE WHEN NOT ends_with(name, '_FIELDS') AND NOT ends_with(name, '_FIELD') THEN 'missing suffix'
      WHEN ends_with(name, '_FIELDS') = is_plural THEN NULL
      WHEN type = 'dict' THEN 'dict with ' || size || ' elements'
      WHEN type IN ('list', 'tuple', 'set') THEN 'collection with ' || size || ' elements'
      ELSE type || ': ' || left(text, 50) || CASE WHEN length(text) > 50 THEN '...' ELSE '' END END AS detail
  FROM const_plural c SEMI JOIN q_pick_fields_file USING (repo, branch, path)) WHERE detail IS NOT NULL"""
CTE["q_const_naming_findings"] = f"SELECT {FK}, seq, name, suggested, detail FROM const_errors"
BULLET = "'  • ' || name || ' → ' || suggested || ' (' || detail || ')'"
CTE["const_counts"] = f"""
SELECT p.repo, p.branch, p.path, count(name) AS n_constants, count(name) FILTER (WHERE ends_with(name, '_FIELD')) AS n_field,
  count(name) FILTER (WHERE ends_with(name, '_FIELDS')) AS n_fields
FROM q_pick_fields_file p LEFT JOIN consts USING (repo, branch, path) GROUP BY ALL"""
CTE["const_bullets"] = f"""
SELECT {FK}, count(*) AS n_errors, string_agg({BULLET}, {NL} ORDER BY seq) AS details,
  string_agg({BULLET}, {NL} ORDER BY seq) FILTER (WHERE seq <= 10) AS shown FROM const_errors GROUP BY ALL"""
CTE["q_const_naming_verdict"] = """
SELECT r.repo, r.branch, CASE WHEN c.path IS NULL THEN 'NO_FILE' WHEN n_constants = 0 THEN 'NO_CONSTANTS'
    WHEN n_errors IS NULL THEN 'OK' ELSE 'ERRORS' END AS verdict,
  CAST(coalesce(n_errors, 0) AS INT) AS n_errors, coalesce(details, '') AS details
FROM repos r LEFT JOIN const_counts c USING (repo, branch) LEFT JOIN const_bullets b ON b.repo = c.repo AND b.branch = c.branch AND b.path = c.path"""
CTE["q_const_structure_summary"] = """
SELECT c.repo, c.branch, c.path, CAST(n_constants AS INT) AS n_constants, CAST(n_field AS INT) AS n_field, CAST(n_fields AS INT) AS n_fields,
  CAST(n_constants - n_field - n_fields AS INT) AS n_no_suffix, CAST(coalesce(n_errors, 0) AS INT) AS n_errors,
  coalesce(shown, '') AS shown_errors, CAST(greatest(coalesce(n_errors, 0) - 10, 0) AS INT) AS n_more
FROM const_counts c LEFT JOIN const_bullets USING (repo, branch, path)"""

# --- comments ------------------------------------------------------------------------------
IS_APP_PATH = "contains(path, 'app.py')"
CTE["comment_rows"] = f"""
SELECT {FK}, CAST(row_number() OVER (PARTITION BY repo, branch, path ORDER BY i) AS INT) AS seq, CAST(i AS INT) AS line_no, left(line, 80) AS detail
FROM (SELECT {FK}, {strip('unnest(ls)')} AS line, generate_subscripts(ls, 1) AS i FROM (
  SELECT {FK}, string_split_regex(content, '\\r\\n|[\\n\\r]') AS ls FROM rf SEMI JOIN q_scope_language USING (repo, branch, path)))
WHERE starts_with(line, '#') AND NOT starts_with(line, '#!') AND NOT contains(lower(line), 'coding')
  AND NOT ({IS_APP_PATH} AND ({has('line', '^[# =-]+$')} OR {any_contains('lower(line)', P.APP_COMMENT_MARKERS)}))"""
CTE["q_comment_findings"] = f"SELECT * FROM comment_rows WHERE NOT {IS_APP_PATH}"
CTE["q_comment_findings_app"] = f"SELECT * FROM comment_rows WHERE {IS_APP_PATH}"
CTE["q_comment_verdicts"] = f"""
SELECT s.repo, s.branch, s.path, s.scope_part, s.scope_pos, s.is_missing, CAST(coalesce(n, 0) AS INT) AS n_comments, coalesce(n, 0) = 0 AS passed
FROM q_scope_language s LEFT JOIN (SELECT {FK}, count(*) AS n FROM comment_rows GROUP BY ALL) USING (repo, branch, path)"""
CTE["q_comment_file_count"] = (
    f"SELECT {K}, count(*) FILTER (WHERE n_comments > 0) AS n_comment_files FROM q_comment_verdicts GROUP BY ALL"
)
CTE["comment_blocks"] = f"""
SELECT {FK}, 'invalid comments ' || {BASE} || ':' || {NL} || string_agg(seq || '. line ' || line_no || ': ' || detail, {NL} ORDER BY seq) AS block
FROM comment_rows GROUP BY {FK}"""
CTE["q_findings_text"] = f"""
SELECT b.repo, b.branch, b.path, file_ord, rule_id, block FROM (
  SELECT *, 'verbs' AS rule_id FROM verb_blocks UNION ALL SELECT *, 'imports' FROM udf_blocks UNION ALL SELECT *, 'comments' FROM comment_blocks) b
JOIN listing USING (repo, branch, path)
UNION ALL SELECT repo, branch, path, scope_pos, 'language', block FROM q_language_report WHERE n_findings > 0
UNION ALL SELECT repo, branch, basename, NULL::BIGINT, 'variables', basename || ':' || {NL} || string_agg('  ' || seq || '. ' || name, {NL} ORDER BY seq)
  FROM q_variable_verb_violations GROUP BY repo, branch, basename
UNION ALL SELECT repo, branch, basename, NULL::BIGINT, 'pandas', CASE WHEN uses_pandas THEN '❌ ' || basename || ': yes' ELSE '✅ ' || basename || ': no' END
  FROM q_last_wins_by_basename"""

# --- language ------------------------------------------------------------------------------
def known(word: str) -> str:
    low = strip(f"lower({word})")
    return (
        f"({low} IN {in_list(POLICY.allowed_words)} OR (length({low}) <= 2 AND {has(low, '^[A-Za-z0-9_]+$')}) "
        f"OR (contains({low}, '_') AND {has(f'replace({low}, {lit(chr(95))}, {lit(str())})', chr(94) + '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+$')}))"
    )


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


def telling(text: str) -> str:
    cut = f"translate({text}, {lit(SEPARATORS)}, {lit(' ' * len(SEPARATORS))})"
    return (
        f"list_filter({words(cut)}, lambda w: length(w) > 2 AND NOT {has('w', '^[A-Z][a-z]+[A-Z]')} "
        f"AND NOT {has('w', '^[a-z_]+$')} AND NOT {has('w', '^[A-Z_]+$')})"
    )


def key(word: str) -> str:
    return sub(f"lower({word})", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def zipf(n: str, total: str) -> str:
    return f"round(log10({n} * 1e9 / {total}), 6)"


CTE["doc_words"] = f"SELECT lang, unnest({find_all('lower(text)', WORD)}) AS word FROM documents"
CTE["q_words_not_whitelisted"] = (
    f"SELECT word, count(*) AS n FROM doc_words WHERE word NOT IN {in_list(POLICY.allowed_words)} GROUP BY ALL"
)
CTE["q_zipf_table"] = f"""
SELECT word, n, {zipf('n', 'sum(n) OVER ()')} AS zipf FROM (SELECT word, count(*) AS n FROM doc_words WHERE lang = 'en' GROUP BY ALL)"""
CTE["dictionary"] = f"SELECT word FROM q_zipf_table WHERE zipf >= {POLICY.min_zipf}"
CTE["q_english_words"] = f"""
SELECT w.word, w.n, coalesce(z.zipf, 0.0) AS zipf, {known('w.word')} OR coalesce(z.zipf >= {POLICY.min_zipf}, false) AS is_english
FROM (SELECT word, count(*) AS n FROM doc_words GROUP BY ALL) w LEFT JOIN q_zipf_table z USING (word)"""


def not_english(source: str, keys: str, text: str) -> str:
    """Keys of the rows of ``source`` whose text fails the whole-text test."""
    return (
        f"SELECT DISTINCT {keys} FROM (SELECT {keys}, unnest({telling(text)}) AS w FROM {source}) "
        f"WHERE NOT {known('w')} AND {key('w')} NOT IN (SELECT word FROM dictionary)"
    )


def english_count(source: str, keys: str, word_list: str, short: int) -> str:
    """English words and words per row of ``source``, word by word."""
    ok = f"{known('w')} OR {key('w')} IN (SELECT word FROM dictionary)" + (f" OR length(w) <= {short}" if short else "")
    return (
        f"SELECT {keys}, count(*) AS n_words, count(*) FILTER (WHERE {ok}) AS n_english "
        f"FROM (SELECT {keys}, unnest({word_list}) AS w FROM {source}) GROUP BY ALL"
    )


CTE["text_lines"] = f"""
SELECT doc_id, CAST(generate_subscripts(ls, 1) AS INT) AS line_no, unnest(ls) AS line
FROM (SELECT doc_id, string_split(text, {NL}) AS ls FROM documents)"""
CTE["q_english_texts"] = f"""
SELECT l.doc_id, l.line_no, b.doc_id IS NULL AS is_english
FROM text_lines l LEFT JOIN ({not_english('text_lines', 'doc_id, line_no', 'line')}) b USING (doc_id, line_no)"""
DK = f"{FK}, fn_pos, line_no"
CTE["doc_candidates"] = f"""
SELECT d.* FROM doc_lines d SEMI JOIN q_scope_language USING (repo, branch, path)
WHERE length(line) > {POLICY.min_line_chars} AND NOT {any_prefix('line', (':', '>>>', '...', '#'))}"""
CTE["doc_findings"] = f"""
SELECT d.* FROM doc_candidates d JOIN ({not_english('doc_candidates', DK, 'line')}) USING ({DK})
JOIN ({english_count('doc_candidates', DK, words('line'), 0)}) USING ({DK})
WHERE n_english < n_words * {POLICY.min_line_ratio}"""
CTE["q_docstring_language"] = f"SELECT {FK}, fn_pos, fn_name, line_no, line FROM doc_findings"
PK = f"{FK}, fn_pos, param_pos"
CTE["param_candidates"] = f"""
SELECT p.*, f.indent FROM q_extract_params p JOIN fns f USING (repo, branch, path, fn_pos) SEMI JOIN q_scope_language USING (repo, branch, path)
WHERE NOT {any_suffix('param', P.PARAM_SUFFIXES)} AND NOT {any_contains('param', P.PARAM_INFIXES)}
  AND NOT {any_prefix('param', P.PARAM_PREFIXES)} AND length(param) > 3
  AND NOT ({has("replace(param, '_', '')", r'^[\p{L}\p{N}]+$')} AND length(param) > 8)"""
CTE["param_findings"] = (
    f"SELECT c.* FROM param_candidates c JOIN ({not_english('param_candidates', PK, 'param')}) USING ({PK})"
)
CTE["q_param_language"] = f"SELECT {FK}, fn_pos, fn_name, param_pos, param FROM param_findings"
VK = f"{FK}, fn_pos, variable"
CTE["scoped_vars"] = "SELECT v.* FROM telling_vars v SEMI JOIN q_scope_language USING (repo, branch, path)"
CTE["var_findings"] = f"""
SELECT v.* FROM scoped_vars v JOIN ({not_english('scoped_vars', VK, 'variable')}) USING ({VK})
JOIN ({english_count('scoped_vars', VK, "string_split(variable, '_')", 3)}) USING ({VK})
WHERE n_words = 1 OR n_english < n_words * {POLICY.min_name_ratio}"""
CTE["q_variable_language"] = f"SELECT {FK}, fn_pos, fn_name, variable FROM var_findings"
CTE["drift"] = f"""
SELECT *, list_sort(list_distinct(list_filter(names, lambda x: NOT list_contains(docs, x)))) AS missing,
  list_sort(list_distinct(list_filter(docs, lambda x: NOT list_contains(names, x)))) AS extra
FROM (SELECT *, {find_all('docstring', PARAM_DOC, 1)} AS docs FROM param_names SEMI JOIN q_scope_language USING (repo, branch, path))
WHERE NOT contains(path, 'tests/') AND length(docstring) > {POLICY.min_docstring_chars} AND len(names) > 0 AND len(docs) > 0"""
CTE["drift_findings"] = f"""
SELECT {FK}, fn_pos, fn_name, indent, 'undocumented' AS drift, array_to_string(missing, ', ') AS names FROM drift
WHERE len(missing) > len(names) * {POLICY.max_missing_param_ratio}
UNION ALL SELECT {FK}, fn_pos, fn_name, indent, 'undefined', array_to_string(extra, ', ') FROM drift WHERE len(extra) > {POLICY.max_extra_params}"""
CTE["q_docstring_param_drift"] = f"SELECT {FK}, fn_pos, fn_name, drift, names FROM drift_findings"
CTE["language_rows"] = f"""
SELECT s.scope_part, s.scope_pos, f.* FROM (
  SELECT {FK}, indent, fn_pos, 1 AS kind, line_no AS pos, 'docstring line ' || line_no || ': ''' || line || '''' AS txt, '' AS tie FROM doc_findings
  UNION ALL SELECT {FK}, indent, fn_pos, 2, param_pos, 'parameter: ' || param, '' FROM param_findings
  UNION ALL SELECT {FK}, indent, fn_pos, 3, 0, 'variable: ' || variable, variable FROM var_findings
  UNION ALL SELECT {FK}, indent, fn_pos, CASE drift WHEN 'undocumented' THEN 4 ELSE 5 END, 0,
    CASE drift WHEN 'undocumented' THEN 'undocumented parameters: ' ELSE 'documented but undefined parameters: ' END || names, '' FROM drift_findings) f
JOIN q_scope_language s USING (repo, branch, path)"""
CTE["language_blocks"] = f"""
SELECT {FK}, scope_part, scope_pos, CAST(count(*) AS INT) AS n_findings,
  {BASE} || {NL} || string_agg(rn || '. ' || txt, {NL} ORDER BY rn) AS block FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, branch, path, scope_part, scope_pos ORDER BY indent, fn_pos, kind, pos, tie) AS rn FROM language_rows)
GROUP BY {FK}, scope_part, scope_pos"""
CTE["q_language_report"] = f"""
SELECT {FK}, scope_part, scope_pos, n_findings, block FROM language_blocks
UNION ALL SELECT repo, branch, '', 0, 0, 0, 'OK' FROM repos ANTI JOIN language_blocks USING (repo, branch)"""

# --- scorecard -----------------------------------------------------------------------------
def mark(test: str, bad: str, good: str) -> str:
    return f"CASE WHEN {test} THEN '❌ {bad}' WHEN NOT ({test}) THEN '✅ {good}' END"


def ok_or(test: str, text: str) -> str:
    return f"CASE WHEN {test} THEN 'OK' ELSE {lit(text)} END"


def count_or(n: str, none: str) -> str:
    return f"CASE WHEN coalesce({n}, 0) > 0 THEN {n} || ' findings' ELSE {lit(none)} END"


def per_repo(source: str, value: str = "count(*)") -> str:
    return f"(SELECT {K}, {value} AS n FROM {source} GROUP BY ALL)"


CTE["version_texts"] = f"""
SELECT {K}, string_agg({NL} || '- ' || source || ': ' || version, '' ORDER BY
  list_position(['setup.cfg', 'setup.py', '__init__.py', {lit(POLICY.build_file)}], source)) AS txt FROM versions GROUP BY ALL"""
CTE["q_scorecard"] = f"""
SELECT r.repo, r.branch, f.audit_status,
  {mark('f.spark_read', 'reads with Spark', 'no reads with Spark')} AS spark_read,
  {mark('f.hadoop', 'uses Hadoop', 'no Hadoop')} AS hadoop,
  {mark('NOT f.partition_read', 'reads down to the partition', 'reads down to the object')} AS partition_read,
  {mark('NOT sdk.passed', 'SDK version too low', 'SDK version')} AS sdk_version,
  {mark('f.spark_write', 'writes with Spark', 'no writes with Spark')} AS spark_write,
  {mark('NOT f.compaction', 'no compaction', 'compaction')} AS compaction,
  {mark('f.base_path', 'uses a base path', 'no base path')} AS base_path,
  {mark('logic.has_logic', 'control flow in the entry file', 'no control flow')} AS app_logic,
  CASE size.status WHEN 'NO_BRACE' THEN 'size ERROR: no opening brace' WHEN 'TOO_LONG' THEN 'over the limit' ELSE 'OK' END AS conf_size,
  size.conf_chars,
  CASE sch.status WHEN 'UNPARSABLE' THEN 'SCHEMA ERROR: unbalanced braces' WHEN 'ERROR' THEN 'ERROR: forbidden value' ELSE 'OK' END AS conf_schema,
  {ok_or('sonar.passed', 'coverage line missing')} AS sonar,
  {ok_or('io.passed', 'input or output suffix missing')} AS io_suffixes,
  {ok_or('docs.passed', 'CONTRIBUTING or README missing')} AS docs_present,
  {count_or('lang.n', 'OK')} AS language, {count_or('fn.n', 'OK')} AS function_names,
  CASE cn.verdict WHEN 'NO_FILE' THEN '⚠️ no fields file' WHEN 'NO_CONSTANTS' THEN 'ℹ️ no constants' WHEN 'OK' THEN '✅ OK'
    ELSE '❌ ' || cn.n_errors || ' errors:' || {NL} || cn.details END AS constant_names,
  {count_or('vars.n', '')} AS variable_names,
  concat_ws(', ', CASE WHEN pan.n_bad > 0 THEN '❌ ' || pan.n_bad || ' with pandas' END,
    CASE WHEN pan.n_good > 0 THEN '✅ ' || pan.n_good || ' without' END) AS pandas,
  {count_or('udf.n', 'OK')} AS udf,
  com.n_comment_files || ' files with invalid comments' AS commented_code,
  CASE WHEN vc.is_consistent THEN 'equal versions:' ELSE 'different versions:' END || coalesce(vt.txt, '') AS versions
FROM repos r JOIN q_flags_by_repo f USING (repo, branch) JOIN q_check_min_version sdk USING (repo, branch)
JOIN q_flag_app_logic logic USING (repo, branch) JOIN q_check_conf_size size USING (repo, branch)
JOIN q_check_conf_schema sch USING (repo, branch) JOIN q_check_sonar sonar USING (repo, branch)
JOIN q_check_io_suffixes io USING (repo, branch) JOIN q_check_docs_present docs USING (repo, branch)
JOIN q_const_naming_verdict cn USING (repo, branch) JOIN q_comment_file_count com USING (repo, branch)
JOIN q_version_consistency vc USING (repo, branch) LEFT JOIN version_texts vt USING (repo, branch)
JOIN (SELECT {K}, count(*) FILTER (WHERE uses_pandas) AS n_bad, count(*) FILTER (WHERE NOT uses_pandas) AS n_good
  FROM q_last_wins_by_basename GROUP BY ALL) pan USING (repo, branch)
LEFT JOIN {per_repo('language_rows')} lang USING (repo, branch)
LEFT JOIN {per_repo('(SELECT * FROM q_fn_verb_violations UNION ALL SELECT * FROM q_test_fn_violations)')} fn USING (repo, branch)
LEFT JOIN {per_repo('q_variable_verb_violations')} vars USING (repo, branch)
LEFT JOIN {per_repo('q_udf_import_hits')} udf USING (repo, branch)"""
CELLS = (
    "spark_read", "hadoop", "partition_read", "sdk_version", "spark_write", "compaction", "base_path", "app_logic",
    "conf_size", "conf_chars", "conf_schema", "sonar", "io_suffixes", "docs_present", "language", "function_names",
    "constant_names", "variable_names", "pandas", "udf", "commented_code", "versions",
)
CTE["q_status_classes"] = f"""
SELECT cell, CASE WHEN coalesce(txt, '') IN ('', '0') THEN 'hidden' WHEN contains(txt, '✅') OR contains(txt, 'OK') THEN 'ok'
    WHEN contains(txt, '❌') OR contains(txt, 'ERROR') THEN 'error' WHEN contains(txt, '⚠️') OR contains(txt, 'WARNING') THEN 'warning'
    ELSE 'none' END AS status, count(*) AS n
FROM ({' UNION ALL '.join(f"SELECT {lit(c)} AS cell, CAST({c} AS VARCHAR) AS txt FROM q_scorecard" for c in CELLS)}) GROUP BY ALL"""
CTE["q_scorecard_json"] = f"""
SELECT repo, branch, true AS success, repo AS repo_value, {', '.join(f"CAST({c} AS VARCHAR) AS {c}_value" for c in CELLS)},
  {lit(','.join(('repo', *CELLS)))} AS column_list FROM q_scorecard"""


CTE["q_findings"] = f"""
SELECT {K}, 'function_verb' AS rule_id, path, fn_pos + 1 AS seq, NULL::INT AS line_no, fn_name AS detail FROM q_fn_verb_violations
UNION ALL SELECT {K}, 'test_function_name', path, fn_pos + 1, NULL, fn_name FROM q_test_fn_violations
UNION ALL SELECT {K}, 'variable_verb', basename, seq, NULL, name FROM q_variable_verb_violations
UNION ALL SELECT {K}, 'forbidden_import', path, seq, line_no, label FROM q_udf_import_hits
UNION ALL SELECT {K}, 'constant_name', path, seq, NULL, name || ' -> ' || suggested || ' (' || detail || ')' FROM q_const_naming_findings
UNION ALL SELECT {K}, 'comment', path, seq, line_no, detail FROM q_comment_findings
UNION ALL SELECT {K}, 'comment', path, seq, line_no, detail FROM q_comment_findings_app
UNION ALL SELECT {K}, 'pandas', basename, 1, NULL, 'imports pandas' FROM q_last_wins_by_basename WHERE uses_pandas
UNION ALL SELECT {K}, 'docstring_language', path, fn_pos + 1, line_no, fn_name || ': ' || line FROM q_docstring_language
UNION ALL SELECT {K}, 'parameter_language', path, fn_pos + 1, NULL, fn_name || ': ' || param FROM q_param_language
UNION ALL SELECT {K}, 'variable_language', path, fn_pos + 1, NULL, fn_name || ': ' || variable FROM q_variable_language
UNION ALL SELECT {K}, 'docstring_parameters', path, fn_pos + 1, NULL, drift || ' ' || names FROM q_docstring_param_drift"""
CTE["q_numbered_findings"] = """
SELECT *, row_number() OVER (PARTITION BY repo, branch, rule_id ORDER BY path, seq, line_no NULLS FIRST, detail) AS number FROM q_findings"""
CTE["asked"] = """
SELECT u.request_id, u.url, u.repo, b.branch,
  CASE WHEN NOT f.accepted THEN 'REFUSED: ' || f.reason WHEN len(string_split(u.url, '/')) < 4 THEN 'SHORT_URL'
    WHEN NOT u.is_valid THEN 'INVALID_URL' END AS refusal
FROM q_repo_url_parse u JOIN q_request_filter f USING (request_id) JOIN q_branch_default b USING (request_id)"""
CTE["q_audit_by_request"] = """
SELECT a.request_id, a.url, a.repo, a.branch, coalesce(a.refusal, s.audit_status, 'UNKNOWN_REPOSITORY') AS audit_status,
  s.* EXCLUDE (repo, branch, audit_status)
FROM asked a LEFT JOIN q_scorecard s ON a.refusal IS NULL AND a.repo = s.repo AND a.branch = s.branch"""

CTE["q_audit_documents"] = f"""
SELECT request_id, audit_status IN ('OK', 'NO_SCOPE_FILES') AS success, CASE WHEN audit_status NOT IN ('OK', 'NO_SCOPE_FILES') THEN audit_status END AS error,
  branch, url, CASE WHEN audit_status IN ('OK', 'NO_SCOPE_FILES') THEN repo END AS repo_value, {', '.join(f"CAST({c} AS VARCHAR) AS {c}_value" for c in CELLS)} FROM q_audit_by_request"""


def statement(name: str) -> str:
    """The named result with every subquery it needs, in dependency order."""
    order: list[str] = []

    def visit(node: str) -> None:
        if node in order:
            return
        for word in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", CTE[node]):
            if word in CTE and word != node:
                visit(word)
        order.append(node)

    visit(f"q_{name}")
    body = ",\n".join(f"{node} AS ({CTE[node]})" for node in order)
    return f"WITH {body}\nSELECT * FROM q_{name}"


def statements() -> dict[str, str]:
    return {node[2:]: statement(node[2:]) for node in CTE if node.startswith("q_")}
