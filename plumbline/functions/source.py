"""Logical lines, block tree and symbols of one Python file, as array-valued column expressions.

1. Strings and comments are masked. Physical lines are joined to logical ones where brackets are open or a
   backslash ends a line; how deep brackets are open at a line is a running sum over the lines.
2. Bracket groups of a logical line shrink from the inside out to one sign each; groups of plain names, which
   may be targets, keep their text. What is left splits into statements at semicolons and after the
   colon of a one-line block.
3. One fold over the statements keeps a stack of open blocks, as Python's own tokenizer does. It gives each function and
   assignment its depth in the syntax tree, the range of assignments inside each function, and whether the
   indentation is sound. It runs in stretches of the square root of a file's statements, since Spark copies what a fold
   gathers at each step: n statements cost n ** 1.5 small copies.

Only the order and nesting of statements is read, not expressions: files with errors that show neither in brackets,
strings nor indentation count as sound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.code import clean_docstring, mask_literals, nesting, unquoted
from plumbline.functions.patterns import IDENT, LEXEME, UPPER_NAME
from plumbline.functions.text import let, strip

#: Signs that stand for a shrunk group, and around a group of names.
GROUP, OPEN, CLOSE = "\u0002", "\u0003", "\u0004"
#: Stands for a line break inside a logical line; a vertical tab is white space to every pattern.
BREAK = "\u000b"
_NAME_SIGNS = rf"\p{{L}}\p{{N}}_ \t{BREAK},*.{GROUP}{OPEN}{CLOSE}"
_CALLED = rf"[\p{{L}}\p{{N}}_\]}}){GROUP}{CLOSE}\"']"
_TUPLE, _LIST = (rf"(?<!{_CALLED}){a}([{_NAME_SIGNS}]*+){b}" for a, b in ((r"\(", r"\)"), (r"\[", r"\]")))
_INSIDE = r"[^\[\](){}]*+"
_ANY_GROUP = rf"\({_INSIDE}\)|\[{_INSIDE}\]|\{{{_INSIDE}\}}"
#: Groups that are called or subscripts, and groups of more than names.
_NO_TARGETS = rf"(?<={_CALLED})(?:{_ANY_GROUP})|(?:\{{|(?=[(\[][{_NAME_SIGNS}]*+[^{_NAME_SIGNS}\[\](){{}}])(?:\(|\[))(?:(?<=\(){_INSIDE}\)|(?<=\[){_INSIDE}\]|(?<=\{{){_INSIDE}\}})"
_BLOCK = (
    r"^[ \t]*(async[ \t]+)?(if|elif|else|for|while|with|try|except|finally|def|class|(?:match|case)(?=[ \t]*[^=\s.,:;\[]))\b"
    r"(?:[^:]++|:=)*+:(?!=)[ \t]*(.*)$"
)
_ASSIGNS = r"(?<![=!<>:+\-*/%&|^@])=(?!=)"
_FLAT = rf"[^{OPEN}{CLOSE}]*+"
_NESTED = rf"(?:[^{OPEN}{CLOSE}]++|{OPEN}(?:[^{OPEN}{CLOSE}]++|{OPEN}(?:[^{OPEN}{CLOSE}]++|{OPEN}{_FLAT}{CLOSE})*+{CLOSE})*+{CLOSE})*+"
_WHOLE_GROUP = rf"^{OPEN}({_NESTED}){CLOSE}$"
_INNER_GROUP = rf"{OPEN}{_NESTED}{CLOSE}"
_LONE_STRING = r"^(?:[rRuU]?[\"'][ \t]*)+$"
_HEAD_OF_DEF = rf"^[ \t]*def[ \t]+({IDENT})[ \t]*(?:\[[^\]]*\])?[ \t]*\("
_HEAD_OF_CLASS = rf"^[ \t]*class[ \t]+{IDENT}[ \t]*(?:\[[^\]]*\])?[ \t]*(?:\(.*?\))?[ \t]*:[ \t]*"
#: The targets of a chain of assignments, up to its value.
_CHAIN = rf"^[ \t]*(?:(?:\*?{IDENT}(?:\.{IDENT}|\[[^\[\]=]*\])*+|\([^()=]*\)|\[[^\[\]=]*\]|[ \t]*,[ \t]*)++[ \t]*=(?!=)[ \t]*)++"
_STACK = "array<struct<w:int,chain:int,child:int,id:int,is_class:boolean,joins:boolean,top:boolean,body:int>>"
_EVENT = "struct<kind:int,id:int,depth:int,w:int,at:int,part:int,name:string,n:int,single:boolean,in_class:boolean,constant:boolean>"
_FUNCTION, _END, _NAME = 1, 2, 3


def _long(size: Column) -> Column:
    """0, 1, ..., size - 1."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def taken(values: Column, start: Column, count: Column) -> Column:
    """`count` elements from the 0-based `start` on; unlike slice() its cost does not grow with the whole array."""
    return F.transform(F.when(count > 0, F.sequence(start, start + count - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(values, i))


def running(values: Column) -> Column:
    """Sums of an array of ints up to each place, by doubling steps."""
    def doubled(acc: Column, k: Column) -> Column:
        step = F.expr("1")
        return let(F.struct(acc.alias("a"), F.pow(F.lit(2), k).cast("int").alias("step")), lambda s: F.transform(
            s["a"], lambda x, i: x + F.coalesce(F.get(s["a"], i - s["step"]), step * 0)))

    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")
    return F.when(F.exists(values, lambda x: x != 0), F.aggregate(_long(rounds), values, doubled)).otherwise(values)


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def flattened(line: Column) -> Column:
    """A logical line without the inside of its brackets; groups of names stay, lists of names with a comma."""
    def shrunk(text: Column) -> Column:
        rounds = F.sequence(F.lit(1), F.greatest(nesting(text), F.lit(1)))

        def once(acc: Column, _: Column) -> Column:
            acc = F.regexp_replace(acc, F.lit(_NO_TARGETS), F.lit(GROUP))
            acc = F.regexp_replace(acc, F.lit(_TUPLE), F.lit(f"{OPEN}$1{CLOSE}"))
            return F.regexp_replace(acc, F.lit(_LIST), F.lit(f"{OPEN}$1,{CLOSE}"))

        return F.aggregate(rounds, text, once)

    return F.when(line.rlike(r"[(\[{]"), let(line, shrunk)).otherwise(line)


def logical_lines(masked: Column) -> Column:
    """array<struct<code, flat>> of masked text, blank lines left out; `code` is not shrunk."""
    def joined(s: Column) -> Column:
        def line(at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(s["starts"], k + 1), F.size(s["lines"]))
            return F.when(end - at == 1, F.get(s["lines"], at)).otherwise(F.array_join(taken(s["lines"], at, end - at), BREAK))

        return F.transform(s["starts"], line)

    def placed(s: Column) -> Column:
        starts = F.filter(_long(F.size(s["lines"])), lambda i: F.get(s["sums"], i) - F.get(s["deltas"], i) <= 0)
        return let(F.struct(s["lines"].alias("lines"), starts.alias("starts")), joined)

    def summed(s: Column) -> Column:
        return let(F.struct(s["lines"].alias("lines"), s["deltas"].alias("deltas"), running(s["deltas"]).alias("sums")), placed)

    def counted(lines: Column) -> Column:
        deltas = F.transform(lines, lambda x: F.when(x.rlike(r"[\[\](){}]"), _count(x, "([{") - _count(x, ")]}")).otherwise(0))
        return let(F.struct(lines.alias("lines"), deltas.alias("deltas")), summed)

    physical = F.split(F.regexp_replace(masked, F.lit(r"\\\r?\n"), F.lit(" ")), "\r\n|[\n\r]", -1)
    written = F.filter(let(physical, counted), lambda x: strip(x) != "")
    return F.transform(written, lambda x: F.struct(F.rtrim(x).alias("code"), F.rtrim(flattened(x)).alias("flat")))


def _width(line: Column) -> Column:
    """Twice the width of the indent, tabs as eight blanks, so that one-line blocks have a width of their own."""
    margin = F.replace(F.regexp_extract(line, "^([ \t\f]*)", 1), F.lit("\t"), F.lit(" " * 8))
    return F.length(margin) * 2


def statements(lines: Column) -> Column:
    """array<struct<w, at, part, head, open, code>>: `at` counts logical lines, `part` pieces between semicolons."""
    def made(w: Column, at: Column, part: Column, head: Column, is_open: Column, code: Column) -> Column:
        return F.struct(w.alias("w"), at.alias("at"), part.alias("part"), head.alias("head"), is_open.alias("open"), code.alias("code"))

    def pieces(text: Column, w: Column, at: Column) -> Column:
        every = F.transform(F.split(text, ";", -1), lambda p, k: made(w, at, k, F.lit(""), F.lit(False), strip(p)))
        return F.filter(every, lambda s: s["code"] != "")

    def of_line(line: Column, at: Column) -> Column:
        flat = line["flat"]

        def split(s: Column) -> Column:
            head = F.when(s["async"] != "", F.concat(F.lit("async "), s["head"])).otherwise(s["head"])
            block = F.array(made(s["w"], at, F.lit(0), head, s["rest"] == "", strip(flat)))
            return F.when(s["head"] == "", pieces(flat, s["w"], at)).otherwise(
                F.when(s["rest"] == "", block).otherwise(F.concat(block, pieces(s["rest"], s["w"] + 1, at))))

        parts = [F.regexp_extract(flat, _BLOCK, k) for k in (1, 2, 3)]
        return let(F.struct(_width(flat).alias("w"), parts[0].alias("async"), parts[1].alias("head"), strip(parts[2]).alias("rest")), split)

    return F.flatten(F.transform(lines, of_line))


def target_names(code: Column) -> Column:
    """array<struct<name, single>>: the names that a statement without brackets assigns to, in all its chained targets."""
    def of_target(target: Column) -> Column:
        bare = target
        for _ in range(2):
            bare = F.regexp_replace(strip(bare), F.lit(_WHOLE_GROUP), F.lit("$1"))

        def listed(text: Column) -> Column:
            names = F.transform(F.split(F.regexp_replace(text, F.lit(_INNER_GROUP), F.lit(GROUP)), ",", -1), strip)
            return F.transform(
                F.filter(names, lambda name: name.rlike(rf"^{IDENT}$") & ~name.rlike("^[0-9]")),
                lambda name: F.struct(name.alias("name"), (~text.contains(",")).alias("single")))

        return let(bare, listed)

    segments = F.split(F.regexp_replace(code, F.lit(r"\blambda\b.*$"), F.lit("0")), _ASSIGNS, -1)
    found = let(segments, lambda s: F.flatten(F.transform(F.slice(s, F.lit(1), F.size(s) - 1), of_target)))
    return F.when(code.contains("="), found).otherwise(F.array().cast("array<struct<name:string,single:boolean>>"))


def _event(kind: int, **fields: Column) -> Column:
    types = dict(f.split(":") for f in _EVENT[7:-1].split(","))
    return F.struct(*(F.lit(kind).alias("kind") if name == "kind" else fields.get(name, F.lit(None)).cast(t).alias(name) for name, t in types.items()))


def _ends(closed: Column, n: Column) -> Column:
    return F.transform(F.filter(closed, lambda x: x["id"] >= 0), lambda x: _event(_END, id=x["id"], n=n))


def block_events(steps: Column) -> Column:
    """struct<events, broken>: functions, their ends and assigned names in text order, and whether the indentation is unsound."""
    none = F.array().cast(f"array<{_EVENT}>")
    state = ("stack", "i", "n", "waiting", "broken")
    start = F.struct(F.array().cast(_STACK).alias("stack"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(False).alias("waiting"), F.lit(False).alias("broken"), none.alias("events"))

    def stretch(whole: Column, block: Column) -> Column:
        # Spark copies a fold's state at each step: events are gathered by stretch, and stretches once each
        now = F.aggregate(block, F.struct(*(whole["now"][f].alias(f) for f in state), none.alias("events")), moved)
        return F.struct(now.alias("now"), F.concat(whole["done"], F.array(whole["now"]["events"])).alias("done"))

    def moved(acc: Column, s: Column) -> Column:
        def located(b: Column) -> Column:
            return F.struct(
                b["above"].alias("above"), b["closed"].alias("closed"), F.get(b["above"], F.size(b["above"]) - 1).alias("parent"),
                F.get(F.filter(b["closed"], lambda x: x["w"] == s["w"]), 0).alias("before"),
                F.when(s["head"] == "", target_names(s["code"])).otherwise(F.array().cast("array<struct<name:string,single:boolean>>")).alias("names"))

        def advanced(b: Column) -> Column:
            parent, before, head = b["parent"], b["before"], s["head"]
            base = F.coalesce(parent["child"], F.lit(1))
            continues = head.isin("else", "elif", "except", "finally")
            chain = F.coalesce(F.when(head == "elif", before["chain"] + 1).when(continues, before["chain"]), base)
            first_in_body = F.coalesce(parent["body"] < 0, F.lit(False))
            misplaced = s["w"] != F.coalesce(F.when(first_in_body, s["w"]).otherwise(parent["body"]), F.lit(0))
            broken = acc["broken"] | misplaced | (acc["waiting"] & (F.size(b["closed"]) > 0)) | (continues & ~F.coalesce(before["joins"], F.lit(False)))

            def pushed(c: Column) -> Column:
                item = F.struct(
                    s["w"].alias("w"), c.alias("chain"), (c + F.when(head == "except", 2).otherwise(1)).alias("child"),
                    F.when(head == "def", acc["i"]).otherwise(-1).alias("id"), (head == "class").alias("is_class"),
                    head.isin("if", "elif", "else", "for", "while", "try", "except", "async for").alias("joins"),
                    parent.isNull().alias("top"), F.lit(-1).alias("body"))
                opened = F.when(first_in_body, F.concat(
                    F.slice(b["above"], F.lit(1), F.size(b["above"]) - 1),
                    F.array(F.struct(*(parent[f].alias(f) for f in ("w", "chain", "child", "id", "is_class", "joins", "top")), s["w"].alias("body"))))).otherwise(b["above"])
                stack = F.when(head != "", F.concat(opened, F.array(item))).otherwise(opened)
                depth = c + F.when(head == "except", 1).otherwise(0)
                outer = parent.isNull() | (parent["is_class"] & parent["top"])
                own = F.when(head == "def", F.array(_event(_FUNCTION, id=acc["i"], depth=depth, w=s["w"], at=s["at"], part=s["part"], n=acc["n"])))
                assigned = F.transform(b["names"], lambda t: _event(
                    _NAME, id=acc["i"], depth=depth, w=s["w"], at=s["at"], part=s["part"], name=t["name"], single=t["single"],
                    in_class=parent.isNotNull(), constant=t["single"] & outer))
                return F.struct(
                    stack.alias("stack"), (acc["i"] + 1).alias("i"), (acc["n"] + F.size(F.filter(b["names"], lambda t: t["single"]))).alias("n"), s["open"].alias("waiting"),
                    broken.alias("broken"), F.concat(acc["events"], _ends(b["closed"], acc["n"]), F.coalesce(own, none), assigned).alias("events"))

            return let(chain, pushed)

        blocks = F.struct(F.filter(acc["stack"], lambda x: x["w"] < s["w"]).alias("above"), F.filter(acc["stack"], lambda x: x["w"] >= s["w"]).alias("closed"))
        return let(let(blocks, located), advanced)

    def finished(whole: Column) -> Column:
        now = whole["now"]
        return F.struct(
            F.flatten(F.concat(whole["done"], F.array(F.concat(now["events"], _ends(now["stack"], now["n"]))))).alias("events"),
            (now["broken"] | now["waiting"]).alias("broken"))

    size = F.ceil(F.sqrt(F.size(steps))).cast("int")
    blocks = F.transform(_long(size), lambda k: F.filter(taken(steps, k * size, size), lambda x: x.isNotNull()))
    return F.aggregate(blocks, F.struct(start.alias("now"), F.array().cast(f"array<array<{_EVENT}>>").alias("done")), stretch, finished)


def _restored(masked: Column, strings: Column, first: Column) -> Column:
    """Masked text with its string literals put back; `first` literals come before it."""
    pieces = F.split(masked, "[\"']", -1)
    return let(pieces, lambda p: F.array_join(F.flatten(F.zip_with(
        p, F.concat(taken(strings, first, F.size(p) - 1), F.array(F.lit(""))), lambda a, b: F.array(a, b))), ""))


def _params(code: Column) -> Column:
    """Positional parameter names of a header, without self and cls."""
    inside = F.regexp_replace(code, F.lit(_HEAD_OF_DEF), F.lit(""))

    def shrunk(text: Column) -> Column:
        rounds = F.sequence(F.lit(1), F.greatest(nesting(text), F.lit(1)))
        return F.aggregate(rounds, text, lambda acc, _: F.regexp_replace(acc, F.lit(_ANY_GROUP), F.lit("")))

    listed = F.transform(F.split(F.regexp_replace(F.split_part(let(inside, shrunk), F.lit(")"), F.lit(1)), F.lit(r"\blambda\b[^:]*:"), F.lit("")), ",", -1), lambda part: F.regexp_extract(part, rf"^\s*([*/]|{IDENT})", 1))

    def before_star(names: Column) -> Column:
        star = F.array_position(names, "*").cast("int")
        return F.when(star > 0, F.slice(names, F.lit(1), star - 1)).otherwise(names)

    # what stands before a slash can be given by place only, and is none of the listed arguments
    def after_slash(names: Column) -> Column:
        slash = F.array_position(names, "/").cast("int")
        return F.slice(names, slash + 1, F.greatest(F.size(names) - slash, F.lit(0)))

    return F.filter(let(let(listed, before_star), after_slash), lambda name: ~name.isin("", "self", "cls"))


def _docstring(function: Column, steps: Column, lines: Column, strings: Column, quotes: Column) -> Column:
    """Text of the string that a function's body begins with; empty if it does not."""
    def text(s: Column) -> Column:
        parts = F.split(F.get(lines, s["at"])["code"], ";", -1)
        before = F.get(quotes, s["at"]) + _count(F.array_join(F.slice(parts, F.lit(1), s["part"] + 1), ""), "\"'") - _count(s["code"], "\"'")
        own = taken(strings, before, _count(s["code"], "\"'"))
        is_doc = (s["w"] > function["w"]) & s["code"].rlike(_LONE_STRING)
        return F.when(is_doc, clean_docstring(F.array_join(F.transform(own, unquoted), "")))

    return F.coalesce(let(F.get(steps, function["id"] + 1), text), F.lit(""))


def _constant(event: Column, lines: Column, strings: Column, quotes: Column) -> Column:
    """Source text of the value that a statement assigns."""
    def value(s: Column) -> Column:
        body = F.when(event["in_class"], F.regexp_replace(s["piece"], F.lit(_HEAD_OF_CLASS), F.lit(""))).otherwise(s["piece"])
        masked = strip(F.regexp_replace(body, F.lit(_CHAIN), F.lit("")))
        return _restored(F.replace(masked, F.lit(BREAK), F.lit("\n")), strings, s["before"] + _count(s["piece"], "\"'") - _count(masked, "\"'"))

    parts = F.split(F.get(lines, event["at"])["code"], ";", -1)
    return let(parts, lambda p: let(F.struct(
        F.get(p, event["part"]).alias("piece"),
        (F.get(quotes, event["at"]) + _count(F.array_join(F.slice(p, F.lit(1), event["part"]), ""), "\"'")).alias("before")), value))


def with_symbols(files: DataFrame, wanted: Column, headers_only: bool = False) -> DataFrame:
    """Adds what the rules read of a file's code, null where not wanted; a file that does not parse has none of it.

    functions: array<struct<depth, pos, indent, name, params, docstring, variables>>; assigned: array<struct<depth,
    pos, name>>; constant_values: array<struct<in_class, name, value>>, all in text order; broken: whether strings,
    brackets or indentation are unsound. headers_only: functions without params, docstring and variables, for rules that
    read none of them; a docstring may be most of a file.
    """
    literals = F.filter(F.regexp_extract_all("content", F.lit(LEXEME), F.lit(0)), lambda t: ~t.startswith("#"))
    # each helper is a projection of its own: they are indexed from inside lambdas
    staged = (
        files.withColumn("_masked", F.when(wanted, mask_literals(F.col("content"))))
        .withColumn("_strings", F.when(F.col("_masked").rlike("[\"']"), literals).otherwise(F.array().cast("array<string>")))
        .withColumn("_lines", logical_lines(F.col("_masked")))
        .withColumn("_own_quotes", F.transform("_lines", lambda x: _count(x["code"], "\"'")))
        .withColumn("_quotes", F.zip_with(running(F.col("_own_quotes")), "_own_quotes", lambda a, b: a - b))
        .withColumn("_steps", statements(F.col("_lines")))
        .withColumn("_blocks", block_events(F.col("_steps")))
    )
    unmatched = F.exists("_lines", lambda x: x["flat"].rlike(r"[\[\](){}]")) | (_count(F.col("_masked"), "\"'") != F.size("_strings"))
    staged = staged.withColumn("broken", F.when(F.col("_masked").isNotNull(), F.col("_blocks.broken") | unmatched))
    events = F.when(~F.col("broken"), F.col("_blocks.events"))
    of_kind = lambda kind: F.filter("_events", lambda e: e["kind"] == kind)
    staged = (
        staged.withColumn("_events", F.when(F.col("broken"), F.array().cast(f"array<{_EVENT}>")).otherwise(events))
        .withColumn("_single", F.transform(F.filter("_events", lambda e: (e["kind"] == _NAME) & e["single"]), lambda e: e["name"]))
        .withColumn("_ends", F.array_sort(F.transform(of_kind(_END), lambda e: F.struct(e["id"].alias("id"), e["n"].alias("n")))))
    )

    def function(e: Column, k: Column) -> Column:
        inside = taken(F.col("_single"), e["n"], F.get("_ends", k)["n"] - e["n"])
        header = F.get("_lines", e["at"])["code"]
        placed = (e["depth"].alias("depth"), k.alias("pos"), (e["w"] / 2).cast("int").alias("indent"), F.regexp_extract(header, _HEAD_OF_DEF, 1).alias("name"))
        if headers_only:
            return F.struct(*placed)
        return F.struct(
            *placed, _params(header).alias("params"), _docstring(e, F.col("_steps"), F.col("_lines"), F.col("_strings"), F.col("_quotes")).alias("docstring"),
            F.array_sort(F.array_distinct(inside)).alias("variables"))

    upper = F.filter("_events", lambda e: e["constant"] & e["name"].rlike(rf"^{UPPER_NAME}$") & e["name"].rlike(r"\p{Lu}"))
    return (
        staged.withColumn("functions", F.transform(of_kind(_FUNCTION), function))
        .withColumn("assigned", F.transform(of_kind(_NAME), lambda e, k: F.struct(e["depth"].alias("depth"), k.alias("pos"), F.lower(e["name"]).alias("name"))))
        .withColumn("constant_values", F.transform(upper, lambda e: F.struct(
            e["in_class"].alias("in_class"), e["name"].alias("name"), _constant(e, F.col("_lines"), F.col("_strings"), F.col("_quotes")).alias("value"))))
        .drop("_masked", "_strings", "_lines", "_own_quotes", "_quotes", "_steps", "_blocks", "_events", "_single", "_ends")
    )
