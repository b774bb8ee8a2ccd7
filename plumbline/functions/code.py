"""Literals, docstrings and values of Python code as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.patterns import BRACKET_GROUP, LEXEME, PARAM_DOC
from plumbline.functions.text import let, strip


def mask_literals(code: Column) -> Column:
    """Drop comments and shrink every string literal to one quote character."""
    return F.regexp_replace(code, F.lit(LEXEME), F.lit("$1$2$3$4"))


def nesting(text: Column) -> Column:
    """How deep the brackets of masked text nest; closing ones without an opening one do not count."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, bracket: Column) -> Column:
        now = F.greatest(acc["now"] + F.when(bracket.isin("[", "(", "{"), 1).otherwise(-1), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(r"[\[\](){}]"), F.lit(0)), start, step, lambda acc: acc["most"])


def shrink_groups(text: Column, group: str, by: str) -> Column:
    """Replace bracket groups from the inside out, as often as this row's brackets nest."""
    def folded(t: Column) -> Column:
        rounds = F.sequence(F.lit(1), F.greatest(nesting(t), F.lit(1)))
        return F.aggregate(rounds, t, lambda acc, _: F.regexp_replace(acc, F.lit(group), F.lit(by)))

    return let(text, folded)


def unquoted(literal: Column) -> Column:
    """Text of a string literal without its prefix-free quotes."""
    width = F.when(literal.rlike("^(?:\"\"\"|''')"), 3).otherwise(1)
    return F.substr(literal, width + 1, F.greatest(F.length(literal) - 2 * width, F.lit(0)))


def indent_of(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))


def clean_docstring(doc: Column) -> Column:
    """Strip the common margin and the blank lines around a docstring."""
    def with_lines(lines: Column) -> Column:
        rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        margin = F.array_min(F.transform(F.filter(rest, lambda line: strip(line) != ""), indent_of))
        return let(F.coalesce(margin, F.lit(0)), lambda m: F.concat(
            F.transform(F.slice(lines, 1, 1), F.ltrim),
            F.transform(rest, lambda line: F.substr(line, m + 1)),
        ))

    text = F.array_join(let(F.split(doc, "\n", -1), with_lines), "\n")
    return F.regexp_replace(F.rtrim(text), F.lit(r"^\s+|\s+$"), F.lit(""))


def documented_params(doc: Column) -> Column:
    return F.regexp_extract_all(doc, F.lit(PARAM_DOC), F.lit(1))


def last_values(ordered: Column) -> Column:
    """Constants sorted by (name, pos) reduced to one per name: first place, last value.

    ``ordered`` must be a plain column, because it is indexed from inside lambdas.
    """
    differs = lambda c, other: F.coalesce(F.get(ordered, other)["name"] != c["name"], F.lit(True))
    first = F.filter(ordered, lambda c, i: differs(c, i - 1))
    last = F.filter(ordered, lambda c, i: differs(c, i + 1))
    return F.array_sort(
        F.zip_with(
            first, last,
            lambda a, b: F.struct(a["pos"].alias("pos"), b["name"].alias("name"),
                                  b["in_class"].alias("in_class"), b["value"].alias("value")),
        )
    )


def constant_literal(value: Column, in_class: Column) -> Column:
    """struct<type, size, text>: literal type, element count and display text."""
    masked = F.regexp_replace(mask_literals(value), F.lit(r"\b[rRuUbB]{1,2}([\"'])"), F.lit("$1"))
    return let(masked, lambda m: _literal(value, in_class, m))


def _literal(value: Column, in_class: Column, masked: Column) -> Column:
    plain = F.regexp_replace(masked, F.lit(r"\b(?:True|False|None)\b"), F.lit("0"))

    def shaped(plain: Column) -> Column:
        is_literal = ~plain.rlike(r"(?:^|[^0-9A-Za-z_.])[A-Za-z_]") & ~plain.rlike(
            r"[0-9\"'\])}][ \t\n]*[-+*/%|&<>@]"
        )
        body = F.substr(plain, F.lit(2), F.greatest(F.length(plain) - 2, F.lit(0)))
        return F.struct(
            is_literal.alias("is_literal"), F.substring(plain, 1, 1).alias("first"),
            shrink_groups(plain, BRACKET_GROUP, "0").alias("outer"),
            strip(shrink_groups(body, BRACKET_GROUP, "0")).alias("inner"),
        )

    def typed(s: Column) -> Column:
        first, inner, outer = s["first"], s["inner"], s["outer"]
        is_group = (outer == "0") & first.isin("[", "(", "{")
        shape = (
            F.when(is_group & (first == "{") & (inner.contains(":") | (inner == "")), "dict")
            .when(is_group & (first == "{"), "set")
            .when(is_group & (first == "["), "list")
            .when(is_group & (first == "(") & (inner.contains(",") | (inner == "")), "tuple")
            .when(~is_group & outer.contains(","), "tuple")
            .otherwise("scalar")
        )
        scalar_type = (
            F.when(first.isin('"', "'"), "str")
            .when(masked.isin("True", "False"), "bool")
            .when(masked == "None", "NoneType")
            .when(masked.rlike(r"^[-+]?(?:[0-9_]+|0[xXoObB][0-9A-Fa-f_]+)$"), "int")
            .otherwise("float")
        )
        kind = let(shape, lambda sh: (
            F.when(s["is_literal"] & (sh != "scalar"), sh)
            .when(s["is_literal"], scalar_type)
            .when(~in_class & sh.isin("dict", "list"), sh)
            .otherwise("NoneType")
        ))
        elements = F.size(F.filter(
            F.split(F.when(is_group, inner).otherwise(outer), ",", -1), lambda e: strip(e) != ""
        ))
        return let(kind, lambda k: F.struct(
            k.alias("type"),
            F.when(s["is_literal"] & k.isin("dict", "list", "tuple", "set"), elements).otherwise(0).alias("size"),
            F.when(k == "str", unquoted(F.regexp_replace(value, F.lit(r"^[rRuUbB]{1,2}([\"'])"), F.lit("$1"))))
            .when(k == "NoneType", "None").otherwise(value).alias("text"),
        ))

    return let(let(plain, shaped), typed)
