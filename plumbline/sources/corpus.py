"""Repository files and audit requests derived from the prose and page tables.

Every document becomes one file of a small repository, its whole text carried
in the file's comments, docstring, note or prose; every page URL becomes one
audit request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "\n"
FILES_PER_REPO = 25
SPREAD = "plumbline.spread"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(table: DataFrame, key: str) -> DataFrame:
    """The table as it is; spread over so many tasks only where a session asks for it.

    The setting is for test tables of a single split; on a cluster it stays unset, so no text is shuffled.
    """
    parts = int(table.sparkSession.conf.get(SPREAD, "0"))
    return table.repartition(parts, key) if parts else table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents(doc_id, text, lang) for the language rules."""
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")


def _every(divisor: int, remainder: int = 0) -> Column:
    return F.col("doc_id") % divisor == remainder


def _lines(*parts: Column | str) -> Column:
    """Join the non-null parts, one per line."""
    return F.concat_ws(NL, *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _code() -> Column:
    w1, w2, w3, text = F.col("w1"), F.col("w2"), F.col("w3"), F.col("text")
    base = (
        F.when(_every(6), F.concat(F.lit("join_"), w1, F.lit("_with_"), w2))
        .when(_every(6, 1), F.concat(F.lit("filter_"), w1))
        .when(_every(6, 2), F.concat(F.lit("group_"), w1, F.lit("_by_"), w2))
        .when(_every(6, 3), F.concat(w1, F.lit("_"), w2))
        .when(_every(6, 4), F.concat(F.lit("add_"), w1))
        .otherwise(F.concat(F.lit("union_"), w1))
    )
    name = F.when(F.col("path").startswith("tests/"), F.concat(F.lit("test_"), base)).otherwise(base)
    job = _lines(
        F.concat(F.lit("class "), w1, F.lit("Job:")),
        "    def setUp(self):",
        "        pass",
        "",
        F.concat(F.lit("    def bad_"), w1, F.lit("(self, "), w2, F.lit(", *args, key=None):")),
        "        '''Short note.'''",
        "        self.value = 1",
        F.concat(F.lit("        "), w1, F.lit("_Value = dict(")),
        "            add_key=1,",
        "            b=[2, 3])",
        "",
    )
    deep = _lines(
        F.concat(F.lit("def deep_"), w1, F.lit("(a, b=f(g(h(i(j(k([1])))))), c=2) -> Dict[")),
        "    str, int",
        "]:",
        F.concat(F.lit('    """Deep '), w1, F.lit('."""')),
        "    x_df.select(",
        "        add_kw=f(g(h(i(j(k(1)))))),",
        "        b=2)",
        "    if a: late_value = 3",
        "    left_value, *rest_value = 1, 2; last_value = 4",
        "    def inner_part(b):",
        "        inner_value = 1",
        "    deep_value = 1",
        "",
    )
    return _lines(
        F.when(_every(4), F.concat(F.lit("# "), F.replace(text, F.lit(NL), F.lit("\n# ")))),
        F.when(_every(3), "# ---- #\n# Your code starts here"),
        F.when(_every(7), "#!/usr/bin/env python\n# -*- coding: utf-8 -*-"),
        F.when(_every(37), "import pandas as pd"),
        F.when(_every(41), "from pyspark.sql.functions import udf"),
        F.when(_every(19), "import pyspark.sql.functions as F"),
        F.concat(
            F.lit("def "), name, F.lit("(self, "), w1, F.lit("_df, "), w2,
            F.lit("_v=(1, [2, 3]), "), w3, F.lit("9: int = 3):"),
        ),
        F.concat(F.lit('    """'), F.col("sent")),
        "",
        F.concat(F.lit("    :param "), w1, F.lit("_df: input")),
        F.when(_every(3, 1), "    :param alpha: a\n    :param beta: b\n    :param gamma: c\n    :param delta: d"),
        text,
        '    """',
        F.concat(F.lit("    add_"), w1, F.lit(" = 1")),
        F.concat(F.lit("    "), w2, F.lit("_total, other = 1, 2")),
        F.concat(F.lit("    "), w3, F.lit("_Total9 = other")),
        F.when(_every(29), '    x = spark.read.parquet("p")'),
        F.when(_every(31), '    x.write.parquet("p")'),
        F.when(_every(23), "    x.coalesce(1)"),
        F.when(_every(43), '    base_path = "/data"'),
        F.when(_every(47), '    conf = "org.apache.hadoop.fs"'),
        F.when(_every(62), "    engine_mock.write(x)"),
        F.when(_every(4, 1), "    for row in rows:\n        add_row = row"),
        F.concat(F.lit("    return "), w1, F.lit("_df")),
        "",
        F.when(_every(8, 3), deep),
        F.when(_every(9, 4), job),
        "def run(spark):",
        "    return 1",
        "",
    )


def _conf() -> Column:
    return _lines(
        F.when(_every(9, 1), "{"),
        "app {",
        '  SALES_INPUT = "/in"',
        F.when(~_every(3), '  SALES_OUTPUT = "/out"'),
        F.concat(F.lit('  NOTE = "'), F.replace(F.replace(F.translate("text", "\n", " "), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')),
        '  SCHEMA = "dev-bucket/nested"',
        F.when(~_every(7), "}"),
        F.when(_every(8, 1), "MODE=batch"),
        F.when(_every(4), 'SCHEMA_PATH = "dev-bucket/x"').otherwise('SCHEMA_PATH = "prod-bucket/x"'),
        F.when(_every(12), 'SCHEMA_PATH = "prod-bucket/y"'),
        F.when(_every(5, 1), 'SCHEMA_NOTE = "prod/#x"  # not dev-bucket/x'),
        F.when(_every(9, 1), "}"),
    )


def _constants() -> Column:
    up1, up2 = F.upper("w1"), F.upper("w2")
    return _lines(
        F.concat(F.lit('"""'), F.translate("sent", '"', ""), F.lit('"""')),
        F.concat(up1, F.lit('_FIELD = "'), F.col("w1"), F.lit('"')),
        F.concat(up2, F.lit('_FIELDS = ["'), F.col("w2"), F.lit('"]')),
        F.concat(up1, F.lit(' = {"k": 1}')),
        F.concat(F.lit('NOTES_FIELDS = """'), F.translate("text", '"', ""), F.lit('"""')),
        'PAIR_FIELD = ("a",\n    "b, c")  # two',
        "class Names:",
        F.concat(F.lit("    "), up2, F.lit('_FIELD = {"a": [1, 2], "b": 2}')),
        "    LIMIT_FIELDS = 10",
        "    def run(self):",
        "        INNER = 1",
        "",
        F.when(_every(2), F.concat(up1, F.lit('_FIELD = ["x", "y"]'))),
        'DEEP_FIELD = {"a": [[[[[[1]]]]]], "b": 2}',
        "AÑO_FIELD = 1",
        "class Two:",
        "  # two",
        "  TWO_FIELD = 2",
        "",
        'COLUMN_FIELDS = F.col("x")',
        "EMPTY_FIELDS = []",
        "lower_name = 1",
        "",
    )


def _placed(docs: DataFrame) -> DataFrame:
    """Documents with their place in a repository.

    The place comes from a one-row generator, so rules filter on the path as on
    a stored column, instead of repeating its derivation in every predicate.
    """
    slot, repo = F.col("file_ord"), F.col("repo")
    below = lambda tail: F.concat(repo, F.lit(tail))
    path = (
        F.when((slot < 17) & _every(11, 3), F.concat(F.lit("attic/part_"), slot.cast("string"), F.lit(".txt")))
        .when(slot == 0, "resources/application.conf")
        .when(slot == 1, "requirements.txt")
        .when(slot == 2, "sonar-project.properties")
        .when(slot == 3, "Buildfile")
        .when(slot == 4, "setup.cfg")
        .when(slot == 5, "setup.py")
        .when(slot == 6, below("/__init__.py"))
        .when(slot == 7, below("/app.py"))
        .when(slot == 8, below("/utils/utils.py"))
        .when(slot == 9, below("/fields.py"))
        .when(slot == 10, below("/constants.py"))
        .when(slot == 11, "tests/test_app.py")
        .when(slot == 12, "tests/utils/test_utils.py")
        .when(slot == 13, "tests/transformations/test_transformations.py")
        .when(slot == 14, "README.md")
        .when(slot == 15, "CONTRIBUTING.md")
        .when(slot == 16, below("/experiment.py"))
        .when(slot == 22, "tests/transformations/test_transformations_more.py")
        .when(slot == 24, below("/old/transformations/transformations_17.py"))
        .otherwise(F.concat(repo, F.lit("/transformations/transformations_"), slot.cast("string"), F.lit(".py")))
    )
    keyed = (
        docs.withColumn("file_ord", F.col("doc_id") % FILES_PER_REPO)
        .withColumn("k", F.expr(f"doc_id div {FILES_PER_REPO}"))
        .withColumn("repo", F.concat(F.lit("repo_"), F.col("k").cast("string")))
    )
    return keyed.select("doc_id", "text", "k", F.inline(F.array(
        F.struct("repo", F.lit("develop").alias("branch"), "file_ord", path.alias("path"))
    )))


def repo_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file table without bodies, for rules on paths alone."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _placed(docs).select("repo", "branch", "file_ord", "path")


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_files(repo, branch, file_ord, path, content), one row per document."""
    slot = F.col("file_ord")
    ver = F.concat(
        F.lit("1."), (F.col("k") % 3).cast("string"), F.when(_every(17), ".9").otherwise(".0")
    )
    noted = lambda c: F.concat(c, F.lit("\n# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))
    content = (
        F.when(slot == 0, _conf())
        .when(slot == 1, noted(F.concat(
            F.lit("pandas==1.5.3\nengine_sdk==0."), (F.col("doc_id") % 3 + 3).cast("string"),
            F.lit("."), (F.col("doc_id") % 13).cast("string"),
        )))
        .when(slot == 2, noted(F.when(_every(2), "a=1\nsonar.python.coverage.reportPaths=coverage.xml").otherwise("sonar.x=1")))
        .when(slot == 3, noted(F.concat(F.lit('version = "'), ver, F.lit('"'))))
        .when(slot == 4, noted(F.concat(F.lit("[metadata]\nversion = "), ver)))
        .when(slot == 5, noted(F.concat(F.lit('setup(version="'), ver, F.lit('")'))))
        .when(slot == 6, noted(F.concat(F.lit('__version__ = "'), ver, F.lit('"'))))
        .when(slot.isin(9, 10), _constants())
        .when(slot.isin(14, 15), F.col("text"))
        .otherwise(_code())
    )
    word = lambda group, default: F.lower(F.coalesce(F.nullif(group, F.lit("")), F.lit(default)))
    # most texts have no such word: a search for one sign leaves them out at a fraction of the pattern's time
    beyond_ascii = F.regexp_extract("text", r"(?:^|[^A-Za-z])([A-Za-z]*+[^\x00-\x7F]\p{L}*)", 1)
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    words = (
        _placed(docs).withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("w1", word(F.regexp_extract("text", "([A-Za-z][a-z]+)", 1), "word"))
        .withColumn("w2", word(F.regexp_extract("text", "[A-Za-z][a-z]+[^A-Za-z]+([A-Za-z][a-z]+)", 1), "term"))
        .withColumn("w3", word(F.when(F.col("text").rlike(r"[^\x00-\x7F]"), beyond_ascii), "value"))
        .withColumn("sent", F.regexp_extract("text", "([A-Z][a-z]+[^.\n]*)", 1))
    )
    return words.select("repo", "branch", "file_ord", "path", content.alias("content"))


def audit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audit_requests(request_id, url, branch, has_token), one row per page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    page = F.col("page_id")
    browse = F.regexp_replace(
        "url", F.lit("^(https?://[^/]+)/([a-z]+)/([0-9]+)(.*)$"),
        F.concat(F.lit("$1/projects/$2/repos/repo_"), F.expr(f"page_id div {FILES_PER_REPO}").cast("string"), F.lit("/browse$4")),
    )
    return pages.select(
        page.alias("request_id"),
        F.when(page % 13 == 0, "")
        .when(page % 7 == 0, F.concat(browse, F.lit("/")))
        .when(page % 5 == 0, F.col("url"))
        .when(page % 11 == 0, "x/y")
        .otherwise(browse).alias("url"),
        F.when(page % 3 == 0, "  ")
        .when(page % 4 != 0, F.concat(F.lit(" "), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1), F.lit(" ")))
        .alias("branch"),
        F.col("url").contains("?").alias("has_token"),
    )
