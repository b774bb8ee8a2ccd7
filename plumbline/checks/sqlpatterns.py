"""Regular expressions of the plain SQL statements, for an engine without backtracking.

They describe whole constructs where the rules work on logical lines, so that the two forms check each other.
"""

from __future__ import annotations

from dataclasses import dataclass

IDENT = r"[\p{L}\p{N}_]+"
#: One target of an assignment; only plain names count, the others may stand beside them.
TARGET = rf"\*?{IDENT}(?:\.{IDENT}|\[[^\[\]\n]*\])*"
BLOCK_CHAR = "\u0001"
GROUP_CHAR = "\u0002"
AFTER_SEMICOLON = 400
ONE_LINE_BLOCK = r"(?m:^)([ \t]*)(?:if|elif|else|for|while|with|try|except|finally)\b[^:\n]*:[ \t]+([^ \t\n])"
UPPER_NAME = r"[\p{Lu}_][\p{Lu}\p{Lo}\p{N}_]*"


@dataclass(frozen=True)
class SourcePatterns:
    """Pattern texts; ``nesting`` is the depth of brackets that a pattern follows."""

    nesting: int = 9

    def long_string(self, quote: str, first: str | None = None) -> str:
        """A triple-quoted string; `first` may capture its first quote."""
        return rf"{first or quote}{quote}{quote}(?:{quote}{{0,2}}(?:[^{quote}\\]+|\\(?s:.)))*{quote * 3}"

    @property
    def string(self) -> str:
        return (
            self.long_string('"') + "|" + self.long_string("'")
            + rf'|"(?:[^"\\\n]+|\\(?s:.))*"' + rf"|'(?:[^'\\\n]+|\\(?s:.))*'"
        )

    @property
    def comment(self) -> str:
        return rf"#[^\n]*"

    @property
    def lexeme(self) -> str:
        """Strings and comments; one capture per kind of quote, holding that quote."""
        return (
            self.long_string('"', '(")') + "|" + self.long_string("'", "(')")
            + rf'|(")(?:[^"\\\n]+|\\(?s:.))*"' + rf"|(')(?:[^'\\\n]+|\\(?s:.))*'"
            + rf"|#[^\n]*"
        )

    @property
    def inside_brackets(self) -> str:
        """Text between brackets, with ``nesting`` further levels of brackets in it."""
        plain = "|".join([rf"[^\"'#\[\](){{}}]+", self.string, self.comment])
        text = f"(?:{plain})*"
        for _ in range(self.nesting):
            text = rf"(?:{plain}|[\[({{]{text}[\])}}])*"
        return text

    @property
    def header(self) -> str:
        """Function header up to its colon: captures indent, name, parameters."""
        return (
            rf"(?m:^)([ \t]*)def[ \t]+({IDENT})[ \t]*\(({self.inside_brackets})\)"
            rf"(?:[^:\n\"'#\[\](){{}}]+|{self.string}|[\[({{]{self.inside_brackets}[\])}}])*:"
        )

    @property
    def docstring(self) -> str:
        """Docstring after a header: captures the whole string literal."""
        return rf"(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*[rRuU]?({self.string})"

    @property
    def function(self) -> str:
        """One function header with its docstring, if it has one."""
        return rf"{self.header}(?:{self.docstring})?"

    @property
    def function_or_lexeme(self) -> str:
        """Functions, with strings and comments consumed so that none hides one."""
        return rf"{self.function}|{self.string}|{self.comment}"

    @property
    def block_start(self) -> str:
        return r"(?m:^)([ \t]*(?:async[ \t]+def|def|class)[ \t])"

    @property
    def block_header(self) -> str:
        return rf"^([ \t]*)def[ \t]+({IDENT})"

    @property
    def assignment(self) -> str:
        """Plain assignment on masked code: captures the comma-separated targets."""
        return (
            rf"(?m:^)[ \t]*\[?((?:{TARGET}[ \t]*,[ \t]*)*(?:{TARGET})?)[ \t]*\]?[ \t]*=[^=]"
        )

    @property
    def constant_value(self) -> str:
        return (
            rf"(?:[^\"'#\[\](){{}}\n]+|{self.string}"
            rf"|[\[({{]{self.inside_brackets}[\])}}])*"
        )

    @property
    def module_constant(self) -> str:
        """Module-level constants and whole class blocks, strings and comments consumed."""
        return (
            rf"(?m:^)class[ \t][^\n]*\n(?:[ \t]+[^\n]*\n|[ \t]*\n)*"
            rf"|(?m:^){UPPER_NAME}[ \t]*=[ \t]*{self.constant_value}"
            rf"|{self.string}|{self.comment}"
        )

    @property
    def class_constant(self) -> str:
        """Constants inside a class block, however deep; their indent tells those of the class itself."""
        return (
            rf"(?m:^)[ \t]+{UPPER_NAME}[ \t]*=[ \t]*{self.constant_value}"
            rf"|{self.string}|{self.comment}"
        )


PLAIN = SourcePatterns()

BRACKET_GROUP = r"[\[({][^\[\](){}]*[\])}]"
CALL_GROUP = r"\([^()]*\)"
CONSTANT_HEAD = rf"^[ \t]*{UPPER_NAME}[ \t]*="
CLASS_MARGIN = r"^class[^\n]*\n(?:[ \t]*(?:#[^\n]*)?\n)*([ \t]+)"
PARAM_DOC = r":param\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*:"
