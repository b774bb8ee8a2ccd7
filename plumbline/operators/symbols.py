"""Functions, parameters, docstrings, assignments and constants of Python files.

Every extraction stays inside one file's row, so it needs no shuffle whatever
the size of a repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import code
from plumbline.functions.source import with_symbols
from plumbline.functions.text import contains_any, ends_with_any, strip
from plumbline.operators import scopes
from plumbline.policy import TECHNICAL_NAMES, VARIABLE_INFIXES, VARIABLE_SUFFIXES
from plumbline.sources.files import FILE_KEY


def functions(files: DataFrame) -> DataFrame:
    """One row per function: depth in the syntax tree, position in the text, indent, name, parameters, docstring."""
    found = with_symbols(files.filter(scopes.is_python()), F.lit(True))
    # the outer form keeps Spark from computing the functions once more in a filter
    return found.select(*FILE_KEY, F.inline_outer("functions")).filter(F.col("pos").isNotNull()).withColumnsRenamed({"pos": "fn_pos", "name": "fn_name"})


def extract_functions(files: DataFrame) -> DataFrame:
    return functions(files).select(*FILE_KEY, "fn_pos", "indent", "fn_name")


def extract_assignments(files: DataFrame) -> DataFrame:
    """Names that plain assignments assign to, in the order of a walk through the syntax tree."""
    found = with_symbols(files.filter(scopes.is_python()), F.lit(True))
    return found.select(*FILE_KEY, F.posexplode_outer(F.array_sort("assigned")).alias("pos", "target")).filter(F.col("pos").isNotNull()).select(*FILE_KEY, "pos", "target.name")


def extract_params(files: DataFrame) -> DataFrame:
    return functions(files).select(*FILE_KEY, "fn_pos", "fn_name", F.posexplode("params").alias("param_pos", "param"))


def extract_docstrings(files: DataFrame) -> DataFrame:
    return functions(files).filter(F.col("docstring") != "").select(
        *FILE_KEY, "fn_pos", "fn_name",
        F.posexplode(F.transform(F.split("docstring", "\n", -1), strip)).alias("line_pos", "line"),
    ).select(*FILE_KEY, "fn_pos", "fn_name", (F.col("line_pos") + 1).alias("line_no"), "line")


def docstring_params(files: DataFrame) -> DataFrame:
    return functions(files).select(
        *FILE_KEY, "fn_pos", "fn_name",
        F.posexplode(code.documented_params(F.col("docstring"))).alias("param_pos", "param"),
    )


def is_telling_variable(name: Column) -> Column:
    """Long enough and not one of the technical names or shapes."""
    return ~(
        name.isin(*TECHNICAL_NAMES) | (F.length(name) <= 4)
        | ends_with_any(name, VARIABLE_SUFFIXES) | contains_any(name, VARIABLE_INFIXES)
    )


def extract_local_vars(files: DataFrame) -> DataFrame:
    """Telling single names assigned inside each function, nested functions included."""
    return functions(files).select(
        *FILE_KEY, "fn_pos", "fn_name", F.explode(F.filter("variables", is_telling_variable)).alias("variable"),
    )


def files_that_do_not_parse(files: DataFrame) -> DataFrame:
    """Python files whose strings, brackets or indentation are unsound."""
    found = with_symbols(files.filter(scopes.is_python()), F.lit(True))
    return found.select(*FILE_KEY, F.explode_outer(F.array(F.col("broken"))).alias("broken")).filter("broken").select(*FILE_KEY)
