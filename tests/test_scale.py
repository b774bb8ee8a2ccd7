"""Scorecard invariants, one huge repository, and the shape of the plans."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.checks.queries import queries
from plumbline.operators import flags, language
from plumbline.plans import report, scorecard
from plumbline.sources import corpus

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus_files(spark):
    return corpus.repo_files(spark, SF_DIR).cache()


@pytest.fixture(scope="module")
def known(spark):
    return language.english_dictionary(corpus.documents(spark, SF_DIR)).cache()


def test_no_python_nodes_anywhere(spark):
    for name, query in queries().items():
        assert not re.search(r"Python|InPandas|CartesianProduct|NestedLoop|REPARTITION", plan_of(query(spark, SF_DIR))), name


def test_scorecard_scans_bodies_twice_and_shuffles_none(spark):
    plan = plan_of(queries()["scorecard"](spark, SF_DIR))
    exchanges = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning", line)]
    assert exchanges and not any("content" in line for line in exchanges)


def test_scorecard_does_not_depend_on_row_order(corpus_files, known):
    shuffled = corpus_files.orderBy(F.xxhash64("path", "repo")).repartition(7)
    assert sorted(scorecard.scorecard(corpus_files, known).collect()) == sorted(scorecard.scorecard(shuffled, known).collect())


def test_one_repository_holding_most_rows(corpus_files, known):
    """Merging repositories under one name keeps counts whole and drops nothing."""
    merged = corpus_files.withColumn("file_ord", F.monotonically_increasing_id()).withColumn("repo", F.lit("repo_1"))
    assert flags.partition_read(merged).count() == flags.partition_read(corpus_files).count()
    (row,) = flags.flags_by_repo(merged).collect()
    assert row.spark_read == any(r.spark_read for r in flags.flags_by_repo(corpus_files).collect())
    (card,) = scorecard.scorecard(merged.dropDuplicates(["path"]), known).collect()
    assert card.audit_status == "OK"


def test_salted_join_agrees_with_any_number_of_salts(corpus_files):
    expected = sorted(flags.partition_read(corpus_files, 1).collect())
    assert sorted(flags.partition_read(corpus_files, 17).collect()) == expected


def test_repository_without_files_in_scope(make_files, known):
    (row,) = scorecard.scorecard(make_files({"R": {"README.md": "x"}}), known).collect()
    assert row.audit_status == "NO_SCOPE_FILES" and row.spark_read is None
    assert row.function_names == "OK" and row.constant_names.startswith("⚠️") and row.pandas == "✅ 1 without"
    assert row.versions == "different versions:\n- setup.cfg: version not found"


@pytest.mark.parametrize("text,status", [
    ("✅ and ❌", "ok"), ("OK", "ok"), ("❌ x", "error"), ("an ERROR", "error"), ("⚠️ x", "warning"), ("x", "none"), ("", "hidden"), (None, "hidden"), ("0", "hidden")])
def test_status_class(spark, text, status):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(scorecard.status_class(F.col("t"))).first()[0] == status


def test_numbers_run_from_one_per_block(corpus_files, known):
    for row in report.findings_text(corpus_files, known).collect():
        numbers = [int(n) for n in re.findall(r"(?m)^ *(\d+)\. ", row.block)]
        assert numbers == list(range(1, len(numbers) + 1))


def test_written_report_is_in_order(corpus_files, tmp_path):
    blocks = report.file_blocks(corpus_files).filter("file_ord IS NOT NULL")
    report.write_report(blocks, str(tmp_path / "out"))
    import glob

    import pyarrow.parquet as pq

    written = []
    for part in sorted(glob.glob(str(tmp_path / "out" / "part-*"))):
        written += [(r["repo"], r["file_ord"]) for r in pq.read_table(part).to_pylist()]
    assert len(written) == blocks.count() and written == sorted(written)


def test_running_numbers_equal_a_window(spark):
    from pyspark.sql import Window

    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 10 < 8, 'hot', concat('g', id % 17))) AS g", "id % 701 AS v", "id AS w")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = report.running_numbers(rows, ("g",), ("v", "w"))
        want = rows.withColumn("number", F.row_number().over(Window.partitionBy("g").orderBy("v", "w")))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _body_scans(frame):
    """Scans of the documents that read their texts."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"FileScan parquet \[[^\]]*\btext#", plan))


def test_findings_and_texts_read_the_bodies_twice(spark, make_dictionary):
    from plumbline.plans import findings

    files, words = corpus.repo_files(spark, "/root/testdata/sf0.01"), make_dictionary("the", "and")  # neither is cached
    assert _body_scans(findings.file_findings(files)) == 1
    assert _body_scans(findings.findings(files, words)) == 2
    assert _body_scans(report.findings_text(files, words)) == 2
    assert _body_scans(scorecard.scorecard(files, words)) == 2


def test_findings_name_pandas_and_the_last_namesake_wins(make_files, known):
    from plumbline.plans import findings

    rf = make_files({"R": {
        "a/transformations/transformations_x.py": "import pandas\nload_a = 1\n", "b/transformations/transformations_x.py": "load_b = 1\n",
        "c/transformations/transformations_y.py": "from pandas import DataFrame\n", "d/transformations/transformations_y.py": "from pandas import Series\n"}})
    rows = {(r.rule_id, r.path, r.detail) for r in findings.findings(rf, known).collect() if r.rule_id in ("pandas", "variable_verb")}
    assert rows == {("pandas", "transformations_y.py", "imports pandas"), ("variable_verb", "transformations_x.py", "load_b")}
    texts = {(r.rule_id, r.block) for r in report.findings_text(rf, known).collect() if r.rule_id in ("pandas", "variables")}
    assert texts == {("variables", "transformations_x.py:\n  1. load_b"), ("pandas", "✅ transformations_x.py: no"),
                     ("pandas", "❌ transformations_y.py: yes"), ("pandas", "✅ utils.py: no")}


def test_every_request_row_gets_one_answer(spark, make_files, known):
    from plumbline.plans import findings

    url = "https://host.example.com/projects/P/repos/R/browse"
    rows = [(1, url, None, True), (1, url, None, True), (None, url, "  ", True), (None, "", None, True), (2, "x/y", "b", True), (3, url, "other", True), (4, None, None, None)]
    requests = spark.createDataFrame(rows, "request_id long, url string, branch string, has_token boolean")
    card = scorecard.scorecard(make_files({"R": {"README.md": "x"}}), known)
    from plumbline.policy import AuditPolicy

    policy = AuditPolicy(url_pattern="^https://host\\.example\\.com/")
    got = findings.audit_by_request(requests, card, policy)
    status = sorted((str(r.request_id), r.audit_status) for r in got.collect())
    assert status == [("1", "NO_SCOPE_FILES"), ("1", "NO_SCOPE_FILES"), ("2", "SHORT_URL"), ("3", "UNKNOWN_REPOSITORY"), ("4", "REFUSED: no url and token"),
                      ("None", "NO_SCOPE_FILES"), ("None", "REFUSED: no url")]
    import json

    documents = [json.loads(r.document) for r in findings.audit_documents(got).collect()]
    good = [d for d in documents if d["success"]]
    assert len(documents) == 7 and len(good) == 3
    assert all(d["data"]["url"] == [url] and len(d["data"]) == len(d["columns"]) == 24 for d in good)
    assert all(set(d) == {"success", "error", "url", "branch"} for d in documents if not d["success"])


def test_words_beyond_ascii_are_searched_only_where_a_text_has_such_a_sign(spark, tmp_path):
    """F3 to F6: the file table tests a text for one sign before it runs the pattern; its words are the same."""
    texts = ["plain words only", "xyz café la", "Été", "a1ß b", "", None]
    spark.createDataFrame(list(enumerate(texts, 17)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    files = corpus.repo_files(spark, str(tmp_path))
    searches = re.findall(r"(\S+ )regexp_extract\(text#\d+, \(\?:\^", files._jdf.queryExecution().optimizedPlan().toString())
    assert searches and set(searches) == {"THEN "}
    words = {r.file_ord: re.search(r"(\w+)9: int = 3", r.content).group(1) for r in files.collect()}
    assert [words[k] for k in sorted(words)] == ["value", "café", "été", "ß", "value", "value"]
