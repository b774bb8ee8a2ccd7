"""Upper-case constants and their singular/plural suffix convention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import code
from plumbline.functions.source import with_symbols
from plumbline.operators import scopes
from plumbline.sources.files import FILE_KEY, REPO_KEY

PLURAL = "_FIELDS"
SINGULAR = "_FIELD"
SHOWN_ERRORS = 10
SHOWN_VALUE_CHARS = 50


def with_constants(files: DataFrame) -> DataFrame:
    """Add ``constants``: array<struct<pos, name, type, size, text>>, one per name; needs ``constant_values``.

    Null where that is null.  The helper columns are separate projections because
    they are indexed from inside lambdas.
    """
    ordered = files.withColumn(
        "ordered_constants",
        F.array_sort(F.transform(
            "constant_values",
            lambda c, i: F.struct(c["name"].alias("name"), i.alias("pos"),
                                  c["in_class"].alias("in_class"), c["value"].alias("value")),
        )),
    )
    distinct = ordered.withColumn("distinct_constants", code.last_values(F.col("ordered_constants")))
    literal = F.transform(
        "distinct_constants",
        lambda c: F.struct(c["pos"].alias("pos"), c["name"].alias("name"),
                           code.constant_literal(c["value"], c["in_class"]).alias("literal")),
    )
    flat = F.transform(
        literal,
        lambda c: F.struct(
            c["pos"].alias("pos"), c["name"].alias("name"), c["literal"]["type"].alias("type"),
            c["literal"]["size"].alias("size"), c["literal"]["text"].alias("text"),
        ),
    )
    return distinct.withColumn("constants", flat).drop("ordered_constants", "distinct_constants")


def is_plural(kind: Column, size: Column) -> Column:
    return (kind == "dict") | (kind.isin("list", "tuple", "set") & (size > 1))


def suggested_name(name: Column, plural: Column) -> Column:
    stem = F.regexp_replace(name, "_FIELDS?$", "")
    return F.concat(stem, F.when(plural, PLURAL).otherwise(SINGULAR))


def value_kind(kind: Column) -> Column:
    return (
        F.when(kind.isin("dict", "list", "tuple", "set"), kind)
        .when(kind == "NoneType", "none").otherwise("scalar")
    )


def naming_errors(constants: Column) -> Column:
    """array<struct<name, suggested, detail>> of the constants that break the convention."""
    def error(c: Column) -> Column:
        plural = is_plural(c["type"], c["size"])
        has_plural = c["name"].endswith(PLURAL)
        has_singular = c["name"].endswith(SINGULAR)
        shown = F.concat(
            c["type"], F.lit(": "), F.substring(c["text"], 1, SHOWN_VALUE_CHARS),
            F.when(F.length(c["text"]) > SHOWN_VALUE_CHARS, "...").otherwise(""),
        )
        detail = (
            F.when(~has_plural & ~has_singular, "missing suffix")
            .when(has_plural == plural, F.lit(None))
            .when(c["type"] == "dict", F.concat(F.lit("dict with "), c["size"].cast("string"), F.lit(" elements")))
            .when(c["type"].isin("list", "tuple", "set"),
                  F.concat(F.lit("collection with "), c["size"].cast("string"), F.lit(" elements")))
            .otherwise(shown)
        )
        return F.struct(
            c["name"].alias("name"), suggested_name(c["name"], plural).alias("suggested"), detail.alias("detail")
        )

    return F.filter(F.transform(constants, error), lambda e: e["detail"].isNotNull())


def error_bullets(errors: Column) -> Column:
    return F.array_join(
        F.transform(errors, lambda e: F.concat(F.lit("  • "), e["name"], F.lit(" → "), e["suggested"],
                                               F.lit(" ("), e["detail"], F.lit(")"))),
        "\n",
    )


def extract_constants(files: DataFrame) -> DataFrame:
    rows = with_constants(with_symbols(files.filter(scopes.is_python()), F.lit(True)))
    # The outer form keeps Spark from computing the constants once more in a filter.
    return rows.select(*FILE_KEY, F.inline_outer("constants")).filter(F.col("name").isNotNull()).select(
        *FILE_KEY, "pos", "name", value_kind(F.col("type")).alias("value_kind"),
        F.col("size").alias("n_elems"), F.col("text").alias("value_text"), F.col("type").alias("value_type"),
    )


def const_plurality(files: DataFrame) -> DataFrame:
    return extract_constants(files).select(
        *FILE_KEY, "name", "value_kind", "n_elems",
        is_plural(F.col("value_type"), F.col("n_elems")).alias("is_plural"),
    )


def const_suggested_name(files: DataFrame) -> DataFrame:
    return extract_constants(files).select(
        *FILE_KEY, "name",
        suggested_name(F.col("name"), is_plural(F.col("value_type"), F.col("n_elems"))).alias("suggested"),
    )


def fields_summary() -> Column:
    """Naming facts of one fields file; needs the ``constants`` column."""
    errors = naming_errors(F.col("constants"))
    count = lambda test: F.size(F.filter("constants", test))
    return F.struct(
        F.col("path").alias("path"),
        F.size("constants").alias("n_constants"),
        count(lambda c: c["name"].endswith(SINGULAR)).alias("n_field"),
        count(lambda c: c["name"].endswith(PLURAL)).alias("n_fields"),
        F.size(errors).alias("n_errors"),
        errors.alias("errors"),
    )


def picked_fields(files: DataFrame) -> DataFrame:
    facts = with_constants(with_symbols(files.filter(scopes.is_fields_file()), F.lit(True))).select(*REPO_KEY, "file_ord", fields_summary().alias("fields"))
    rows = facts.unionByName(files.select(*REPO_KEY), allowMissingColumns=True)
    return rows.groupBy(*REPO_KEY).agg(F.min_by("fields", "file_ord").alias("picked"))


def const_naming_findings(files: DataFrame) -> DataFrame:
    return picked_fields(files).select(
        *REPO_KEY, F.col("picked.path").alias("path"), F.posexplode("picked.errors").alias("pos", "error")
    ).select(*FILE_KEY, (F.col("pos") + 1).alias("seq"), "error.name", "error.suggested", "error.detail")


def naming_verdict(picked: Column) -> Column:
    return (
        F.when(picked.isNull(), "NO_FILE")
        .when(picked["n_constants"] == 0, "NO_CONSTANTS")
        .when(picked["n_errors"] == 0, "OK")
        .otherwise("ERRORS")
    )


def const_naming_verdict(files: DataFrame) -> DataFrame:
    picked = F.col("picked")
    return picked_fields(files).select(
        *REPO_KEY, naming_verdict(picked).alias("verdict"),
        F.coalesce(picked["n_errors"], F.lit(0)).alias("n_errors"),
        F.coalesce(error_bullets(picked["errors"]), F.lit("")).alias("details"),
    )


def const_structure_summary(files: DataFrame) -> DataFrame:
    picked = F.col("picked")
    return picked_fields(files).filter(picked.isNotNull()).select(
        *REPO_KEY, picked["path"].alias("path"), picked["n_constants"].alias("n_constants"),
        picked["n_field"].alias("n_field"), picked["n_fields"].alias("n_fields"),
        (picked["n_constants"] - picked["n_field"] - picked["n_fields"]).alias("n_no_suffix"),
        picked["n_errors"].alias("n_errors"),
        error_bullets(F.slice(picked["errors"], 1, SHOWN_ERRORS)).alias("shown_errors"),
        F.greatest(picked["n_errors"] - SHOWN_ERRORS, F.lit(0)).alias("n_more"),
    )
