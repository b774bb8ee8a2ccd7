"""Repository-file tables: readers, listings and lookups of expected files.

A file table has the columns repo, branch, file_ord, path, content, keyed by
(repo, branch, path); ``file_ord`` is the order of the listing.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.policy import DEFAULT_POLICY, AuditPolicy

REPO_KEY = ("repo", "branch")
FILE_KEY = ("repo", "branch", "path")
MASK_BITS = 62

FILE_SCHEMA = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("branch", T.StringType()),
    T.StructField("file_ord", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
])


def read_file_table(spark: SparkSession, path: str) -> DataFrame:
    """File table stored as Parquet; a null body reads as an empty file."""
    return spark.read.schema(FILE_SCHEMA).parquet(path).withColumn("content", F.coalesce("content", F.lit("")))


def read_checkouts(spark: SparkSession, root: str, branch: str = "develop") -> DataFrame:
    """File table from checked-out text files stored as ``root/<repo>/<path>``.

    The listing order is path order: rows are range-partitioned by path, and the order number need
    not be dense, so no window over one repository is needed.  Bodies travel in that one shuffle;
    a table written from here (`read_file_table`) is never shuffled again.

    Spark's file sources do not list names that begin with ``_`` or ``.``.  Checkouts whose
    ``__init__.py`` matters must come as a file table.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    # the listing gives URIs; a plus sign stands for itself there
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    start = "/" + root.split("://", 1)[-1].strip("/") + "/"
    below = F.expr("substring(decoded, instr(decoded, start) + length(start))")
    return (
        files.select(F.col("value").alias("content"), decoded.alias("decoded"), F.lit(start).alias("start"))
        .select("content", below.alias("full"))
        .select(
            F.substring_index("full", "/", 1).alias("repo"), F.lit(branch).alias("branch"),
            F.regexp_replace("full", "^[^/]*/", "").alias("path"), "content",
        )
        .repartitionByRange("repo", "path")
        .sortWithinPartitions("repo", "path")
        .withColumn("file_ord", F.monotonically_increasing_id())
        .select(*(f.name for f in FILE_SCHEMA))
    )


def repo_facts(files: DataFrame, wanted: Column, *facts: Column) -> DataFrame:
    """Facts of the wanted files, and a row without facts for every listed file.

    The filter on the path stands below the facts, so a scan reads the bodies of wanted files
    only; the listing reads no body, and keeps repositories that lack the files.
    """
    return files.filter(wanted).select(*REPO_KEY, *facts).unionByName(files.select(*REPO_KEY), allowMissingColumns=True)


def is_one_of(paths: tuple[tuple[str, bool], ...]) -> Column:
    """Test on the path that a scan can take, for files whose exact place is tested afterwards."""
    plain = F.col("path").isin(*(p for p, below in paths if not below))
    return reduce(or_, (F.col("path").endswith(f"/{p}") for p, below in paths if below), plain)


def manifest(files: DataFrame) -> DataFrame:
    """Listing size per repository; never touches file bodies."""
    return files.groupBy(*REPO_KEY).agg(
        F.count("*").alias("n_files"), F.countDistinct("path").alias("n_paths")
    )


def fixed_path(path: str, below_repo: bool) -> Column:
    return F.expr(_fixed_sql(path, below_repo))


def _fixed_sql(path: str, below_repo: bool) -> str:
    quoted = path.replace("\\", "\\\\").replace("'", "\\'")
    return f"concat(repo, '/{quoted}')" if below_repo else f"'{quoted}'"


def fixed_position(paths: tuple[tuple[str, bool], ...]) -> Column:
    """Position of the row's path in a list of expected paths; null outside it."""
    cases = " ".join(f"WHEN {_fixed_sql(p, below)} THEN {i}" for i, (p, below) in enumerate(paths))
    return F.expr(f"CASE path {cases} END")


def missing_paths(files: DataFrame, paths: tuple[tuple[str, bool], ...]) -> DataFrame:
    """Expected paths each repository lacks, with their position in the list.

    Folds one bit per expected path, 62 to a number, so a repository of any size needs
    one small buffer, and paths and bodies are never shuffled.
    """
    position = fixed_position(paths)
    masks = [
        F.bit_or(F.when((position >= at) & (position < at + MASK_BITS), F.pow(F.lit(2), position - at).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        for at in range(0, max(len(paths), 1), MASK_BITS)
    ]
    found = files.groupBy(*REPO_KEY).agg(F.array(*masks).alias("found"))
    entries = F.expr("array({})".format(", ".join(
        f"struct({i} AS scope_pos, {_fixed_sql(p, below)} AS path)" for i, (p, below) in enumerate(paths)
    )))
    return (
        found.select(*REPO_KEY, "found", F.inline(entries))
        .filter(F.expr(f"(get(found, scope_pos div {MASK_BITS}) & shiftleft(1L, scope_pos % {MASK_BITS})) = 0"))
        .select(*FILE_KEY, F.col("scope_pos").cast("bigint").alias("scope_pos"))
    )


def expected_files_missing(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    return missing_paths(files, policy.expected_paths()).select(*FILE_KEY)


def content_lookup(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """Body of every expected file; a missing file has an empty body.

    Present files come straight from the scan and missing ones from the
    presence mask, so no body is ever shuffled.
    """
    paths = policy.expected_paths()
    present = files.filter(is_one_of(paths)).filter(fixed_position(paths).isNotNull()).select(
        *FILE_KEY, F.coalesce("content", F.lit("")).alias("content"), F.lit(False).alias("is_missing")
    )
    absent = missing_paths(files, paths).select(
        *FILE_KEY, F.lit("").alias("content"), F.lit(True).alias("is_missing")
    )
    return present.unionByName(absent)
