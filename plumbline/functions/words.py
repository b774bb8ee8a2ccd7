"""Word tests that need no dictionary, and the keys for those that do."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import strip
from plumbline.policy import AuditPolicy

# Characters a text is cut at before its words are tested.
SEPARATORS = "_:.-,;*\\/"
WORD = r"[\p{L}\p{N}]+(?:'\p{L}+)*"


def dictionary_words(text: Column) -> Column:
    """Lower-cased words of a text, as counted by the frequency table."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def raw_words(text: Column) -> Column:
    """Words of a text that neither is empty nor begins or ends with a blank."""
    return F.split(text, r"\s+", -1)


# One pass a text instead of tests a word. As `$` does, the tests overlook one of Java's other line ends at a word's end.
_LETTER = r"[^\s" + re.escape(SEPARATORS) + "]"
_END = rf"[\u0085\u2028\u2029]?(?!{_LETTER})"
#: What lies before the next telling word: whole other words and separators. Each match begins where the last one ended, so that
#: words that tell nothing are passed in one go instead of tested at each sign.
_PASSED = rf"(?:[a-z]++{_END}|[\s{re.escape(SEPARATORS)}]++|{_LETTER}{{1,2}}+(?!{_LETTER})|[A-Z]++{_END}|(?=[A-Z][a-z]++[A-Z]){_LETTER}++)*+"
TELLING_WORD = rf"\G{_PASSED}({_LETTER}++)"


def telling_words(text: Column) -> Column:
    """Words that can fail the language test: not short, camel-, snake- or upper-case."""
    return F.regexp_extract_all(text, F.lit(TELLING_WORD), F.lit(1))


def is_known(word: Column, policy: AuditPolicy) -> Column:
    """English without a look-up: allowed, very short, or a snake-case name."""
    return is_known_lower(strip(F.lower(word)), policy)


def is_known_lower(lower: Column, policy: AuditPolicy) -> Column:
    """`is_known` of a word that is lower-cased and stripped."""
    return (
        lower.isin(*policy.allowed_words)
        | ((F.length(lower) <= 2) & lower.rlike("^[A-Za-z0-9_]+$"))
        | (lower.contains("_") & F.replace(lower, F.lit("_"), F.lit("")).rlike(r"^[\p{L}\p{N}]+$"))
    )


def bare(word: Column) -> Column:
    """The word without the punctuation around it."""
    return F.regexp_extract(word, r"(?s)[\p{L}\p{N}](?:.*[\p{L}\p{N}])?", 0)


def lookup_key(word: Column) -> Column:
    """Lower-cased word without the punctuation around it."""
    return bare(F.lower(word))


def unknown_keys(words: Column, policy: AuditPolicy) -> Column:
    """Look-up keys of the words only the dictionary can decide."""
    return unknown_lower_keys(F.transform(words, F.lower), policy)


def unknown_lower_keys(words: Column, policy: AuditPolicy) -> Column:
    """`unknown_keys` of words that are lower-cased and have no blanks."""
    return F.transform(F.filter(words, lambda word: ~is_known_lower(word, policy)), bare)
