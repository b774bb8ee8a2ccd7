"""Commented-out lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import basename, contains_any, let, numbered, split_lines, strip
from plumbline.operators import scopes
from plumbline.policy import APP_COMMENT_MARKERS
from plumbline.sources.files import FILE_KEY, REPO_KEY, repo_facts

SHOWN_CHARS = 80


def is_app_path() -> Column:
    return F.col("path").contains("app.py")


def comments() -> Column:
    """array<struct<line_no, detail>> of invalid comment lines of one body."""
    # a body without the sign is not split: one empty line stands for it
    body = F.when(~F.col("content").contains("#"), "").otherwise(F.col("content"))
    lines = F.transform(
        split_lines(body),
        lambda line, i: F.struct((i + 1).alias("line_no"), strip(line).alias("text")),
    )

    def is_invalid(line: Column) -> Column:
        text = line["text"]
        allowed = lambda lower: is_app_path() & (
            text.rlike("^[# =-]+$") | contains_any(lower, APP_COMMENT_MARKERS)
        )
        return text.startswith("#") & ~text.startswith("#!") & let(
            F.lower(text), lambda lower: ~lower.contains("coding") & ~allowed(lower)
        )

    return F.transform(
        F.filter(lines, is_invalid),
        lambda line: F.struct(line["line_no"].alias("line_no"), F.substring(line["text"], 1, SHOWN_CHARS).alias("detail")),
    )


def _findings(files: DataFrame) -> DataFrame:
    scoped = files.filter(F.size(scopes.language_entries()) > 0)
    return scoped.select(*FILE_KEY, F.posexplode(comments()).alias("pos", "comment")).select(
        *FILE_KEY, (F.col("pos") + 1).alias("seq"), "comment.line_no", "comment.detail"
    )


def comment_findings(files: DataFrame) -> DataFrame:
    return _findings(files.filter(~is_app_path()))


def comment_findings_app(files: DataFrame) -> DataFrame:
    """Files with ``app.py`` in their path, where dividers and markers are allowed."""
    return _findings(files.filter(is_app_path()))


def comment_verdicts(files: DataFrame) -> DataFrame:
    """One verdict per scoped file; an absent file passes."""
    scoped = files.withColumn("entries", scopes.language_entries()).filter(F.size("entries") > 0)
    present = scoped.withColumn("n_comments", F.size(comments())).select(
        *FILE_KEY, F.inline("entries"), F.lit(False).alias("is_missing"), "n_comments"
    )
    absent = scopes.missing_paths(files, scopes.LANGUAGE_FIXED).select(
        *FILE_KEY, F.lit(1).alias("scope_part"), "scope_pos", F.lit(True).alias("is_missing"),
        F.lit(0).alias("n_comments"),
    )
    return present.unionByName(absent).withColumn("passed", F.col("n_comments") == 0)


def comment_file_count(files: DataFrame) -> DataFrame:
    """Scoped files with invalid comments; an absent file has none, so it needs no row."""
    listed = F.size(scopes.language_entries())
    facts = repo_facts(files, listed > 0, F.when(F.size(comments()) > 0, listed).alias("bad"))
    return facts.groupBy(*REPO_KEY).agg(F.coalesce(F.sum("bad"), F.lit(0).cast("bigint")).alias("n_comment_files"))


def comment_block() -> Column:
    """Numbered block of one scoped file's invalid comments; null when there are none."""
    found = F.when(F.size(scopes.language_entries()) > 0, comments())
    texts = F.transform(
        found, lambda c: F.concat(F.lit("line "), c["line_no"].cast("string"), F.lit(": "), c["detail"])
    )
    return F.when(
        F.size(texts) > 0, F.concat(F.lit("invalid comments "), basename(F.col("path")), F.lit(":\n"), numbered(texts))
    )
