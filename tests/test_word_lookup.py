"""How words reach the dictionary: once a word, without the text they come from, from one count of the corpus."""

from pyspark.sql import functions as F

from plumbline.functions import words
from plumbline.operators import language


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_words_travel_without_their_text(make_files, make_dictionary):
    files = make_files({"shop": {"shop/app.py": 'def run(x):\n    """Some Text of words here."""\n'}})
    found = language.docstring_language(files, make_dictionary("some"))
    plan = plan_of(found)
    exploded = [line for line in plan.splitlines() if "Generate inline(tokens" in line]
    assert len(exploded) == 1 and "detail" not in exploded[0] and "part_keys" not in exploded[0]
    # words are counted in hash tables; only the fold of an item's few rows sorts
    above = plan[:plan.index("Generate inline(tokens")]
    assert above.rindex("HashAggregate") > above.rindex("SortAggregate")
    assert [r.line for r in found.collect()] == ["Some Text of words here."]


def test_dictionary_is_counted_once(spark):
    documents = spark.createDataFrame([(1, "One word and one more", "en"), (2, "ein wort", "de")], "doc_id long, text string, lang string")
    tokens = spark.createDataFrame([("one", 1), ("wort", 2)], "key string, at int")
    found = language.look_up(tokens, language.english_dictionary(documents), language.DEFAULT_POLICY, ("at",))
    assert sorted((r.key, r.hit) for r in found.collect()) == [("one", True), ("wort", False)]
    assert "ReusedExchange" in plan_of(found)


def test_telling_words(spark):
    texts = {
        "Some plain Words_And PARTS here": ["Some", "Words", "And"],
        "fooBar BarFoo Über naïve a.B.Cd x,Yz ab1": ["fooBar", "Über", "naïve", "ab1"],
        "abc ABC\u0085 Abc": ["Abc"],
        "": [],
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words.telling_words(F.col("t")).alias("found")).collect()
    assert {r.t: r.found for r in rows} == texts


def test_telling_words_are_found_from_where_the_last_one_ended(spark):
    """other words are passed in one go, and the words are those that tests at each sign find."""
    import random

    assert words.TELLING_WORD.startswith(r"\G")
    letter, end = words._LETTER, words._END
    tested = rf"(?<!{letter})(?![a-z]++{end})(?![A-Z]++{end})(?![A-Z][a-z]++[A-Z]){letter}{{3,}}+"
    signs, rnd = "abzABZab  \t\n_.:-*\\/'9é\u0085 ß中\U0001F600", random.Random(5)
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + [None, "plain words " * 20000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    same = words.telling_words(F.col("t")).eqNullSafe(F.regexp_extract_all("t", F.lit(tested), F.lit(0)))
    assert rows.filter(~same).collect() == []


def test_words_and_their_keys_take_one_match_each(spark):
    """a line is split once, and a key is cut out of its word instead of replaced at both ends."""
    rows = spark.createDataFrame([("a b\t\u000b(c)-d.\n!? 'e' _f_ g\u0085 ü.",), (None,)], "t string")
    found = rows.select(words.raw_words(F.col("t")).alias("words"), F.transform(words.raw_words(F.col("t")), words.bare).alias("keys"))
    plan = plan_of(found)
    assert "regexp_replace" not in plan and "regexp_extract_all" not in plan
    assert [r.words for r in found.collect()] == [["a", "b", "(c)-d.", "!?", "'e'", "_f_", "g\u0085", "ü."], None]
    assert [r["keys"] for r in found.collect()] == [["a", "b", "c)-d", "", "e", "f", "g", "ü"], None]


def test_bodies_without_the_comment_sign_are_not_split(make_files):
    """one empty line stands for such a body; null stays null."""
    from plumbline.operators import comments

    files = make_files({"R": {"a.py": "x = 1\ny = 2\n", "b.py": "x\n # note\n", "c.py": "", "d.py": None}})
    found = files.select("path", comments.comments().alias("found"))
    assert "contains(content" in plan_of(found).lower()
    rows = {r.path: r.found for r in found.collect()}
    assert rows["a.py"] == rows["c.py"] == [] and rows["d.py"] is None and [(c.line_no, c.detail) for c in rows["b.py"]] == [(2, "# note")]
