import pytest
from pyspark.sql import functions as F

from plumbline.functions import words
from plumbline.operators import language as L
from plumbline.policy import DEFAULT_POLICY, AuditPolicy


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id bigint, text string, lang string")


def test_zipf_table_counts_english_only(spark):
    table = {r.word: (r.n, r.zipf) for r in L.zipf_table(docs(spark, ("en", "The cat, the Dog."), ("fr", "le chat"))).collect()}
    assert table == {"the": (2, 8.69897), "cat": (1, 8.39794), "dog": (1, 8.39794)}


def test_english_words(spark):
    found = {r.word: r.is_english for r in L.english_words(docs(spark, ("en", "cat dataframe"), ("fr", "chat le parquet"))).collect()}
    assert found == {"cat": True, "dataframe": True, "chat": False, "le": True, "parquet": True}


@pytest.mark.parametrize("text,expected", [
    ("hola mundo", True), ("Año", False), ("", True), ("CamelCase", True), ("CONSTANT_CASE", True),
    ("Hello there", True), ("Hello Mundo", False), ("(Hello)", True), ("snake_Mundo", False), ("Utils", True)])
def test_english_texts(spark, make_dictionary, text, expected):
    row = L.english_texts(docs(spark, ("en", text)), make_dictionary("hello")).first()
    assert row.is_english is expected


def test_every_line_gets_a_verdict(spark, make_dictionary):
    rows = L.english_texts(docs(spark, ("en", "Hello\nMundo\n\nMundo Hello")), make_dictionary("hello")).collect()
    assert {r.line_no: r.is_english for r in rows} == {1: True, 2: False, 3: True, 4: False}


def run(make_files, make_dictionary, header, doc="", body="", path="R/app.py", known=("hello",)):
    text = f"def {header}:\n    '''{doc}'''\n    {body}\n"
    return make_files({"R": {path: text}}), make_dictionary(*known)


@pytest.mark.parametrize("param,bad", [
    ("año", False), ("niño_df", False), ("datos", False), ("Datos", True), ("Hello", False), ("mundo9", True), ("números9x8y", False)])
def test_parameters(make_files, make_dictionary, param, bad):
    rf, known = run(make_files, make_dictionary, f"run(self, {param})")
    assert [r.param for r in L.param_language(rf, known).collect()] == ([param] if bad else [])


@pytest.mark.parametrize("name,bad", [
    ("Mundo9", True), ("mundo", False), ("Mundo9_hello", True), ("Mundo9_a_b_c", False), ("Hello_Hello", False), ("Mun9", False)])
def test_variables(make_files, make_dictionary, name, bad):
    rf, known = run(make_files, make_dictionary, "run()", body=f"{name} = 1")
    assert [r.variable for r in L.variable_language(rf, known).collect()] == ([name] if bad else [])


def test_docstring_lines(make_files, make_dictionary):
    doc = "Hola mundo Nuevo\n    Hello hello Hello Mundo\n\n    :param x: Hola Mundo\n    # Hola Mundo x\n    Hola\n    hola Mundo, Hola."
    rf, known = run(make_files, make_dictionary, "run()", doc)
    assert [(r.line_no, r.line) for r in L.docstring_language(rf, known).orderBy("line_no").collect()] == [
        (1, "Hola mundo Nuevo"), (7, "hola Mundo, Hola.")]


def test_drift(make_files):
    filler = "A sentence that is long enough to pass the size limit."
    text = f"def run(a, b, c):\n    '''{filler}\n\n    :param a: x\n    :param q: x\n    :param r: x\n    :param s: x\n    :param t: x\n    '''\n"
    rf = make_files({"R": {"R/app.py": text, "tests/test_app.py": text}})
    assert {(r.path, r.drift, r.names) for r in L.docstring_param_drift(rf).collect()} == {
        ("R/app.py", "undocumented", "b, c"), ("R/app.py", "undefined", "q, r, s, t")}


def test_report_orders_outer_functions_first(make_files, make_dictionary):
    text = "class K:\n    def add_a(self, Uno9):\n        pass\ndef add_b(Dos9):\n    Tres9 = 1\n"
    rf = make_files({"R": {"R/app.py": text}, "S": {"S/app.py": ""}})
    assert {(r.repo, r.block) for r in L.language_report(rf, make_dictionary("hello")).collect()} == {
        ("R", "app.py\n1. parameter: Dos9\n2. variable: Tres9\n3. parameter: Uno9"), ("S", "OK")}


def test_large_dictionaries_are_joined_with_a_salt(spark, make_files, make_dictionary):
    """Beyond the proven bound nothing is broadcast by request, and results agree."""
    low = AuditPolicy(min_zipf=1.0)
    assert L.dictionary_bound(low) > L.BROADCAST_WORD_LIMIT > L.dictionary_bound(DEFAULT_POLICY)
    hot = docs(spark, *[("en", "Mundo Mundo Hello\nHello")] * 50)
    known = make_dictionary("hello")
    salted = L.english_texts(hot, known, low)
    assert "salt" in salted._jdf.queryExecution().analyzed().toString()
    assert sorted(salted.collect()) == sorted(L.english_texts(hot, known).collect())


def test_lookup_keys(spark):
    df = spark.createDataFrame([("(Hello),",), ("don't",), ("((",)], "w string")
    assert [r[0] for r in df.select(words.lookup_key(F.col("w"))).collect()] == ["hello", "don't", ""]


def test_stored_counts_merge_to_those_of_all_documents(spark, tmp_path):
    from plumbline.plans import scorecard
    from plumbline.sources import corpus

    documents = corpus.documents(spark, "/root/testdata/sf0.001")
    for k in range(2):
        L.word_counts(documents.filter(f"doc_id % 2 = {k}")).write.parquet(str(tmp_path / str(k)))
    merged = L.merged_counts(*(spark.read.parquet(str(tmp_path / str(k))) for k in range(2)))
    assert sorted(merged.collect()) == sorted(L.word_counts(documents).collect())
    merged.write.parquet(str(tmp_path / "all"))
    stored = L.stored_dictionary(spark.read.parquet(str(tmp_path / "all")))
    whole = L.english_dictionary(documents)
    assert sorted(stored.collect()) == sorted(whole.collect()) and stored.count() > 50
    files = corpus.repo_files(spark, "/root/testdata/sf0.001")
    assert sorted(scorecard.scorecard(files, stored).collect()) == sorted(scorecard.scorecard(files, whole).collect())
