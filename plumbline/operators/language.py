"""English-language checks with a word-frequency table built from a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import code
from plumbline.functions.source import with_symbols
from plumbline.functions.text import (
    basename, contains_any, ends_with_any, let, numbered, starts_with_any, strip,
)
from plumbline.functions.words import (
    dictionary_words, is_known, raw_words, telling_words, unknown_keys, unknown_lower_keys,
)
from plumbline.operators import scopes
from plumbline.operators.symbols import is_telling_variable
from plumbline.policy import (
    DEFAULT_POLICY, PARAM_INFIXES, PARAM_PREFIXES, PARAM_SUFFIXES, AuditPolicy,
)
from plumbline.sources.files import FILE_KEY, REPO_KEY

ENGLISH = "en"
BROADCAST_WORD_LIMIT = 5_000_000
SALTS = 64

DOCSTRING, PARAMETER, VARIABLE, UNDOCUMENTED, UNDEFINED, UNREADABLE = range(1, 7)
KIND_LABELS = {
    DOCSTRING: "docstring line", PARAMETER: "parameter", VARIABLE: "variable",
    UNDOCUMENTED: "undocumented parameters", UNDEFINED: "documented but undefined parameters", UNREADABLE: "ERROR",
}
NOT_PARSED = "strings, brackets or indentation do not parse"


def zipf(count: Column, total: Column) -> Column:
    """Zipf scale: log10 of the occurrences per billion words, to six decimals."""
    return F.round(F.log10(count * F.lit(1e9) / total), 6)


def word_counts(documents: DataFrame) -> DataFrame:
    """Occurrences of every word, in all texts and in English ones."""
    words = documents.select((F.col("lang") == ENGLISH).alias("english"), F.explode(dictionary_words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.count_if("english").alias("n_english"))


def zipf_table(documents: DataFrame) -> DataFrame:
    """zipf_table(word, n, zipf) of the English documents.

    The total is a scalar subquery over the same counts, whose shuffle it
    reuses, so no window spans the whole vocabulary.
    """
    words = documents.filter(F.col("lang") == ENGLISH).select(
        F.explode(dictionary_words(F.col("text"))).alias("word")
    ).filter(F.col("word").isNotNull())  # always so; readers that join on the word ask for it, and would count on their own
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.select("word", "n", zipf(F.col("n"), total).alias("zipf"))


def english_dictionary(documents: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """dictionary(key): words at least as frequent as the policy asks."""
    return zipf_table(documents).filter(F.col("zipf") >= policy.min_zipf).select(F.col("word").alias("key"))


def merged_counts(*tables: DataFrame) -> DataFrame:
    """Word counts of several collections as those of all their documents: new documents are counted, old ones not read."""
    return reduce(DataFrame.unionByName, tables).groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_english").alias("n_english"))


def stored_dictionary(counts: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """The dictionary of a stored table of `word_counts`; equal to `english_dictionary` of its documents."""
    total = counts.agg(F.sum("n_english").alias("total")).scalar()
    frequent = zipf(F.col("n_english"), total) >= policy.min_zipf
    return counts.filter("n_english > 0").filter(frequent).select(F.col("word").alias("key"))


def dictionary_bound(policy: AuditPolicy) -> float:
    """Most words a dictionary can have, whatever the corpus.

    A word on the list makes up at least 10 ** (min_zipf - 9) of all words, so
    there are at most 10 ** (9 - min_zipf) of them, and their summed length is
    at most that number times the mean word length.
    """
    return 10 ** (9 - policy.min_zipf)


def look_up(tokens: DataFrame, dictionary: DataFrame, policy: AuditPolicy, salt_on: tuple[str, ...]) -> DataFrame:
    """Add ``hit``: whether the dictionary holds the token's ``key``; null keys stay null.

    A dictionary whose bound is small is broadcast.  A larger one is joined on
    (key, salt), so a word that is most of the tokens still spreads.
    """
    known = dictionary.select("key", F.lit(True).alias("in_dictionary"))
    if dictionary_bound(policy) <= BROADCAST_WORD_LIMIT:
        joined = tokens.join(F.broadcast(known), "key", "left")
    else:
        salted = tokens.withColumn("salt", F.pmod(F.xxhash64(*salt_on), F.lit(SALTS)).cast("int"))
        repeated = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(repeated, ["key", "salt"], "left").drop("salt")
    hit = F.when(F.col("key").isNotNull(), F.coalesce("in_dictionary", F.lit(False)))
    return joined.withColumn("hit", hit).drop("in_dictionary")


def words_not_whitelisted(documents: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    words = documents.select(F.explode(dictionary_words(F.col("text"))).alias("word"))
    return words.filter(~F.col("word").isin(*policy.allowed_words)).groupBy("word").agg(F.count("*").alias("n"))


def english_words(documents: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """Verdict on every distinct word; its English count comes with it, so nothing is joined."""
    counts = word_counts(documents)
    total = counts.agg(F.sum("n_english").alias("total")).scalar()
    score = F.when(F.col("n_english") > 0, zipf(F.col("n_english"), total)).otherwise(F.lit(0.0))
    return counts.withColumn("zipf", score).select(
        "word", "n", "zipf",
        (is_known(F.col("word"), policy) | (F.col("zipf") >= policy.min_zipf)).alias("is_english"),
    )


def english_texts(documents: DataFrame, dictionary: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """Verdict on every line of every document."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    tokens = lines.select(
        "doc_id", (F.col("pos") + 1).alias("line_no"),
        F.explode_outer(F.array_distinct(unknown_keys(telling_words(F.col("line")), policy))).alias("key"),
    )
    looked_up = look_up(tokens, dictionary, policy, ("doc_id", "line_no"))
    return looked_up.groupBy("doc_id", "line_no").agg(
        F.coalesce(F.bool_and("hit"), F.lit(True)).alias("is_english")
    )


def _item(kind: int, depth: Column, fn_pos: Column, fn_name: Column, pos: Column, detail: Column,
          whole: Column, parts: Column, n_parts: Column) -> Column:
    """One thing to judge: words of its whole-text test, and lower-cased ones of its part-by-part test."""
    return F.struct(
        F.lit(kind).alias("kind"), depth.alias("depth"), fn_pos.alias("fn_pos"), fn_name.alias("fn_name"),
        pos.cast("int").alias("item_pos"), detail.alias("detail"), whole.alias("whole"),
        parts.alias("parts"), n_parts.alias("n_parts"),
    )


ITEM_FIELDS = ("kind", "depth", "fn_pos", "fn_name", "item_pos", "detail", "n_parts")


def _with_keys(items: Column, policy: AuditPolicy) -> Column:
    """Words of the items reduced to the keys only the dictionary can decide."""
    keyed = F.transform(items, lambda it: F.struct(
        *(it[f].alias(f) for f in ITEM_FIELDS),
        F.array_distinct(unknown_keys(it["whole"], policy)).alias("whole_keys"), it["parts"].alias("parts"),
    ))
    undecided = F.filter(keyed, lambda it: (it["kind"] >= UNDOCUMENTED) | (F.size(it["whole_keys"]) > 0))
    return F.transform(undecided, lambda it: F.struct(
        *(it[f].alias(f) for f in (*ITEM_FIELDS, "whole_keys")), unknown_lower_keys(it["parts"], policy).alias("part_keys"),
    ))


def _no_words() -> Column:
    return F.expr("cast(array() AS array<string>)")


def _docstring_items(fn: Column, fn_pos: Column, policy: AuditPolicy) -> Column:
    lines = F.transform(
        F.split(fn["docstring"], "\n", -1), lambda line, i: F.struct(strip(line).alias("text"), (i + 1).alias("no"))
    )
    checked = F.filter(
        lines,
        lambda line: (F.length(line["text"]) > policy.min_line_chars) & ~line["text"].rlike(r"^(?::|>>>|\.\.\.|#)"),
    )
    return F.transform(checked, lambda line: let(raw_words(F.lower(line["text"])), lambda words: _item(
        DOCSTRING, fn["depth"], fn_pos, fn["name"], line["no"], line["text"],
        telling_words(line["text"]), words, F.size(words),
    )))


def is_technical_param(name: Column) -> Column:
    return (
        ends_with_any(name, PARAM_SUFFIXES) | contains_any(name, PARAM_INFIXES)
        | starts_with_any(name, PARAM_PREFIXES) | (F.length(name) <= 3)
        | (F.replace(name, F.lit("_"), F.lit("")).rlike(r"^[\p{L}\p{N}]+$") & (F.length(name) > 8))
    )


def _param_items(fn: Column, fn_pos: Column, policy: AuditPolicy) -> Column:
    params = F.transform(
        fn["params"], lambda name, i: F.struct(name.alias("name"), i.alias("pos"))
    )
    return F.transform(
        F.filter(params, lambda p: ~is_technical_param(p["name"])),
        lambda p: _item(PARAMETER, fn["depth"], fn_pos, fn["name"], p["pos"], p["name"],
                        telling_words(p["name"]), _no_words(), F.lit(0)),
    )


def _drift_items(fn: Column, fn_pos: Column, policy: AuditPolicy) -> Column:
    def finding(kind: int, names: Column) -> Column:
        return _item(kind, fn["depth"], fn_pos, fn["name"], F.lit(0), F.array_join(names, ", "),
                     _no_words(), _no_words(), F.lit(0))

    def compare(lists: Column) -> Column:
        params, documented = lists["params"], lists["documented"]
        missing = F.array_sort(F.array_except(params, documented))
        extra = F.array_sort(F.array_except(documented, params))
        applies = (
            ~F.col("path").contains("tests/") & (F.length(fn["docstring"]) > policy.min_docstring_chars)
            & (F.size(params) > 0) & (F.size(documented) > 0)
        )
        too_many_missing = F.size(missing) > F.size(params) * policy.max_missing_param_ratio
        too_many_extra = F.size(extra) > policy.max_extra_params
        return F.array_compact(F.array(
            F.when(applies & too_many_missing, finding(UNDOCUMENTED, missing)),
            F.when(applies & too_many_extra, finding(UNDEFINED, extra)),
        ))

    return let(F.struct(
        fn["params"].alias("params"),
        code.documented_params(fn["docstring"]).alias("documented"),
    ), compare)


def _variable_items(fn: Column, fn_pos: Column, policy: AuditPolicy) -> Column:
    """Parts of at most three characters count as English."""
    return F.transform(
        F.filter(fn["variables"], is_telling_variable),
        lambda name, i: let(F.split(name, "_", -1), lambda parts: _item(
            VARIABLE, fn["depth"], fn_pos, fn["name"], i, name,
            telling_words(name), F.transform(F.filter(parts, lambda part: F.length(part) > 3), F.lower), F.size(parts),
        )),
    )


def language_items(files: DataFrame, kinds: tuple[int, ...], policy: AuditPolicy) -> DataFrame:
    """Rows (file, scope entry, item) of everything in the language scope that may be bad."""
    scoped = files.withColumn("entries", scopes.language_entries()).filter(F.size("entries") > 0)
    makers = []
    if DOCSTRING in kinds:
        makers.append(_docstring_items)
    if PARAMETER in kinds:
        makers.append(_param_items)
    if VARIABLE in kinds:
        makers.append(_variable_items)
    if UNDOCUMENTED in kinds or UNDEFINED in kinds:
        makers.append(_drift_items)
    scoped = with_symbols(scoped, F.lit(True))
    arrays = [F.flatten(F.transform(
        "functions", lambda fn, i: F.concat(*(make(fn, i, policy) for make in makers))
    ))] if makers else []
    if UNREADABLE in kinds:
        error = _item(UNREADABLE, F.lit(0), F.lit(0), F.lit(""), F.lit(0), F.lit(NOT_PARSED), _no_words(), _no_words(), F.lit(0))
        arrays.append(F.array_compact(F.array(F.when(F.col("broken"), error))))
    items = scoped.select(*FILE_KEY, "entries", F.inline_outer(_with_keys(F.concat(*arrays), policy)))
    return items.filter(F.col("kind").isin(*kinds)).select("*", F.inline("entries")).drop("entries")


ITEM_KEY = (*FILE_KEY, "scope_part", "scope_pos", "kind", "depth", "fn_pos", "fn_name", "item_pos")


def language_findings(files: DataFrame, dictionary: DataFrame, policy: AuditPolicy = DEFAULT_POLICY,
                      kinds: tuple[int, ...] = (DOCSTRING, PARAMETER, VARIABLE, UNDOCUMENTED, UNDEFINED, UNREADABLE)) -> DataFrame:
    """Rows (file, scope entry, function, kind, detail) that break the language rules.

    Items are exploded into the words only the dictionary can decide, looked up and folded back. An item's text has a
    row of its own, so it is not copied once per word; what to explode is built before, so no row carries all words.
    The first fold counts in hash tables, where no text may be an aggregate; the second sees two rows an item and task.
    """
    items = language_items(files, kinds, policy)
    token = lambda text, whole, key: F.struct(
        text.cast("string").alias("text"), whole.cast("boolean").alias("whole"), key.cast("string").alias("key"))
    none = F.lit(None)
    tokens = F.concat(
        F.array(token(F.col("detail"), none, none)),
        F.transform("whole_keys", lambda key: token(none, F.lit(True), key)),
        F.transform("part_keys", lambda key: token(none, F.lit(False), key)),
    )
    sizes = items.select(*ITEM_KEY, "n_parts", (F.col("n_parts") - F.size("part_keys")).alias("n_known"), tokens.alias("tokens"))
    # the outer form keeps Spark from building the tokens once more in a filter
    looked_up = look_up(sizes.select(*ITEM_KEY, "n_parts", "n_known", F.inline_outer("tokens")), dictionary, policy, FILE_KEY + ("fn_pos", "item_pos"))
    # known words of the whole-text test and unknown ones of the other change no verdict
    counted = looked_up.filter(F.col("key").isNull() | (F.col("whole") != F.col("hit"))).groupBy(*ITEM_KEY, "text").agg(
        F.max("n_parts").alias("n_parts"), F.max("n_known").alias("n_known"),
        F.count_if(~F.col("whole")).alias("n_hits"), F.bool_or("whole").alias("fails"),
    )
    folded = counted.groupBy(*ITEM_KEY).agg(
        F.max("text").alias("detail"),
        F.max("n_parts").alias("n_parts"),
        (F.max("n_known") + F.sum("n_hits")).alias("n_english"),
        F.coalesce(F.bool_or("fails"), F.lit(False)).alias("fails"),
    )
    few_words = F.col("n_english") < F.col("n_parts") * policy.min_line_ratio
    few_parts = (F.col("n_parts") == 1) | (F.col("n_english") < F.col("n_parts") * policy.min_name_ratio)
    is_bad = (
        F.when(F.col("kind") == DOCSTRING, F.col("fails") & few_words)
        .when(F.col("kind") == PARAMETER, F.col("fails"))
        .when(F.col("kind") == VARIABLE, F.col("fails") & few_parts)
        .otherwise(F.lit(True))
    )
    return folded.filter(is_bad).select(*ITEM_KEY, "detail")


def _one_kind(files: DataFrame, dictionary: DataFrame, policy: AuditPolicy, kind: int) -> DataFrame:
    return language_findings(files, dictionary, policy, (kind,))


def docstring_language(files: DataFrame, dictionary: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    return _one_kind(files, dictionary, policy, DOCSTRING).select(
        *FILE_KEY, "fn_pos", "fn_name", F.col("item_pos").alias("line_no"), F.col("detail").alias("line")
    )


def param_language(files: DataFrame, dictionary: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    return _one_kind(files, dictionary, policy, PARAMETER).select(
        *FILE_KEY, "fn_pos", "fn_name", F.col("item_pos").alias("param_pos"), F.col("detail").alias("param")
    )


def variable_language(files: DataFrame, dictionary: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    return _one_kind(files, dictionary, policy, VARIABLE).select(
        *FILE_KEY, "fn_pos", "fn_name", F.col("detail").alias("variable")
    )


def unreadable_files(files: DataFrame) -> DataFrame:
    """Files of the language scope that do not parse; they have no other finding."""
    return language_items(files, (UNREADABLE,), DEFAULT_POLICY).select(*FILE_KEY, "detail")


def docstring_param_drift(files: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """Parameters and docstring that disagree; no dictionary and no shuffle."""
    items = language_items(files, (UNDOCUMENTED, UNDEFINED), policy)
    return items.select(
        *FILE_KEY, "fn_pos", "fn_name",
        F.when(F.col("kind") == UNDOCUMENTED, "undocumented").otherwise("undefined").alias("drift"),
        F.col("detail").alias("names"),
    )


def finding_text() -> Column:
    label = F.lit("")
    for kind, text in KIND_LABELS.items():
        line = F.concat(F.lit(f"{text} "), F.col("item_pos").cast("string"), F.lit(": '"), F.col("detail"), F.lit("'"))
        plain = F.concat(F.lit(f"{text}: "), F.col("detail"))
        label = F.when(F.col("kind") == kind, line if kind == DOCSTRING else plain).otherwise(label)
    return label


def language_report(files: DataFrame, dictionary: DataFrame, policy: AuditPolicy = DEFAULT_POLICY) -> DataFrame:
    """Numbered block per file with findings, and one 'OK' row per repository without any.

    Inside a block functions stand in the order of a walk through the syntax tree.  Every finding also counts
    for its repository in the same aggregation, so findings are computed once;
    only one file's findings are ever gathered.
    """
    entry = F.struct("depth", "fn_pos", "kind", "item_pos", finding_text().alias("text"))
    place = ("path", "scope_part", "scope_pos")
    both = F.array(
        F.struct(*place, entry.alias("entry"), F.lit(0).alias("n")),
        F.struct(*(F.lit(None).alias(c) for c in place), F.lit(None).alias("entry"), F.lit(1).alias("n")),
    )
    found = language_findings(files, dictionary, policy).select(*REPO_KEY, F.inline(both))
    repos = files.select(*REPO_KEY).distinct().select(
        *REPO_KEY, *(F.lit(None).alias(c) for c in (*place, "entry")), F.lit(0).alias("n")
    )
    folded = found.unionByName(repos).groupBy(*REPO_KEY, *place).agg(
        F.array_sort(F.collect_list("entry")).alias("found"), F.sum("n").alias("n")
    )
    texts = F.transform("found", lambda f: f["text"])
    unread = F.get("found", 0)["kind"] == UNREADABLE
    block = F.concat(basename(F.col("path")), F.lit("\n"), F.when(unread, F.array_join(texts, "\n")).otherwise(numbered(texts)))
    return folded.filter(F.col("path").isNotNull() | (F.col("n") == 0)).select(
        *REPO_KEY, F.coalesce("scope_part", F.lit(0)).alias("scope_part"),
        F.coalesce("scope_pos", F.lit(0)).alias("scope_pos"), F.coalesce("path", F.lit("")).alias("path"),
        F.size("found").alias("n_findings"), F.coalesce(block, F.lit("OK")).alias("block"),
    )
