"""Regular expressions for Python source text.

Quantifiers that never give back are possessive, which keeps Java's matcher iterative on long texts.
"""

from __future__ import annotations

IDENT = r"[\p{L}\p{N}_]+"
UPPER_NAME = r"[\p{Lu}_][\p{Lu}\p{Lo}\p{N}_]*"
BRACKET_GROUP = r"[\[({][^\[\](){}]*[\])}]"
PARAM_DOC = r":param\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*:"


def _long_string(quote: str) -> str:
    return rf"({quote}){quote * 2}(?:{quote}{{0,2}}+(?:[^{quote}\\]++|\\(?s:.)))*+{quote * 3}"


def _short_string(quote: str) -> str:
    return rf"({quote})(?:[^{quote}\\\n]++|\\(?s:.))*+{quote}"


#: Strings and comments; one capture per kind of string, holding its quote.
LEXEME = "|".join([*map(_long_string, "\"'"), *map(_short_string, "\"'"), r"#[^\n]*+"])
