"""Audit requests: branch defaults, URL validation and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import strip
from plumbline.policy import DEFAULT_POLICY, AuditPolicy


def branch_or_default(policy: AuditPolicy) -> Column:
    """Blank or absent branches become the default one; others are trimmed."""
    return F.coalesce(F.nullif(strip(F.col("branch")), F.lit("")), F.lit(policy.default_branch))


def address(policy: AuditPolicy) -> dict[str, Column]:
    """Whether the URL has the right beginning; project and repository count from its end."""
    parts = F.split("url", "/", -1)
    return {
        "is_valid": F.col("url").rlike(policy.url_pattern),
        "project": F.try_element_at(parts, F.lit(-4)), "repo": F.try_element_at(parts, F.lit(-2)),
    }


def admission() -> dict[str, Column]:
    """Accepted are requests with both a URL and a credential; the reason is named otherwise."""
    no_url = F.coalesce(F.col("url"), F.lit("")) == ""
    no_token = ~F.coalesce(F.col("has_token"), F.lit(False))
    return {
        "accepted": ~no_url & ~no_token,
        "reason": F.when(no_url & no_token, "no url and token").when(no_url, "no url").when(no_token, "no token"),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def default_branch(requests: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    return requests.select("request_id", branch_or_default(policy).alias("branch"))


def parse_urls(requests: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    return requests.select("request_id", "url", *_named(address(policy)))


def admit(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", "url", *_named(admission()))
