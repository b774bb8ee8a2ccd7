"""Symbol extraction against CPython's own parser."""

import ast
import itertools
import pathlib

import pytest
from pyspark.sql import functions as F

from plumbline.functions import source
from plumbline.operators import symbols
from plumbline.sources import corpus

SAMPLES = {
    "nested": '''
class Job(Base):
    """Doc with def fake(a): inside."""
    LIMIT = 3

    def setUp(self):
        self.x = 1
        add_x = [1,
                 2]

        def inner(y):
            """
            Inner text.

            :param y: value
            """
            z_value = y
            return z_value

    async def skipped(self):
        hidden = 1

def outer(a, b: Dict[str, int] = {"k": (1, 2)}, c=")", *, d=None) -> int:
    \'\'\'One line.\'\'\'
    total = call(
        data=a,
        schema=[x for x in b],
    )
    first, Second = 1, 2
    [third, fourth] = 3, 4
    text = "def ghost(q): add_ghost = 1"  # note = 1
    if a == b:
        total += 1
    return total

MODULE = 1
''',
    "strings": '''
X = "it's"  # don't
def check_one(p, /, q, *args, r=1, **kw):
    "Short."
    value = 'a # b'
    other = """
def fake():
    fake_value = 1
"""
    return value
def check_two(
    first,  # a, b
    second=lambda: 0,
):
    # comment
    """Second."""
    pass
''',
    "forms": '''
def forms(c):
    left, *rest = c
    one, self.two = 1, 2
    three[0], four = 1, 2
    if c: late = 3
    a = 1; b = 2
    for i in c: seen = i
''',
    "deep": '''
def deep(a, b=f(g(h(i(j(k(l(m(1)))))))), c=2) -> Dict[
    str, List[
        int
    ]
]:
    """Deep doc."""
    x_df.select(
        add_kw=f(g(h(i(j(k(1)))))),
        b=2)
    kept_value = {"a": [[[[[[[1]]]]]]]}

DEEP = {"a": [[[[[[[(1,)]]]]]]]}
AÑO_FIELD = 1
class Two:

  # two
  TWO_FIELD = 2
  def run(self):
    INNER = 1
''',
    "empty": "",
}


CHAINS = r'''
x = y = a
(l, r) = 1, 2
def f(a): v = 1
A_FIELD = B_FIELD = 1
D_FIELD = \
3
class K: E_FIELD = 'a;b'; G = {'x': "y"}
[p] = 1,
((q, s)) = 2
(t) = 4
w, (m, n) = 1, (2, 3)
lam = lambda z=1: z
ann: int = 5
aug = 1
aug += 2
if (wal := 3) == 4: inn = 1; inm = 2
obj.attr = val2 = 3
obj[1] = val3 = {'True': True}[obj]
*st, en = 1, 2
PAIR_FIELD = ("a",  # one
    "b, c")
text = r"""one \""" two"""
def g(a, b=lambda x, y: x, *, c=1): "Doc " "two."
'''

WALK = """
if a:
  def one():
      def two(): 'Doc.'; xx = 1
  def three(): pass
elif b:
    def four(): pass
elif c:
    def five(): pass
else:
    def six(): pass
try:
\tdef seven(): pass
except E:
\tdef eight(): pass
else:
\tdef nine(): pass
finally:
\tdef ten(): pass
match a:
    case 1:
        def eleven(): pass
class A:
        def twelve(self, /, a, *, b=1): pass
async def skip():
    def thirteen(x: Dict[str, int] = {'k': ')'}) -> int:
        # c
        '''Doc

        more'''
        zz = 1
match = 3
case = lambda: 0
"""

BROKEN = {
    "bracket": "x = (1\n", "dedent": "if a:\n  x = 1\n y = 2\n", "string": "x = 'abc\n", "no body": "def f():\nx = 1\n",
    "pair": "x = (1]\n", "indent": "  x = 1\n", "else": "else:\n  x = 1\n", "deeper": "x = 1\n  y = 2\n", "end": "def f():\n",
}


@pytest.fixture(scope="module")
def facts(spark, make_files):
    here = pathlib.Path(ast.__file__).parent
    own = {path.name: path.read_text(encoding="utf-8") for path in sorted(here.glob("[a-h]*.py"))}
    samples = make_files({"R": {f"R/{name}.py": text for name, text in (SAMPLES | {"chains": CHAINS, "walk": WALK} | own).items()}})
    files = samples.repartition(16).unionByName(corpus.repo_files(spark, "/root/testdata/sf0.001")).filter("path like '%.py'")
    return source.with_symbols(files, F.lit(True)).collect()


def parsed(row):
    try:
        return ast.parse(row.content)
    except SyntaxError:
        return None


def functions(tree):
    return sorted((n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)), key=lambda n: n.lineno)


@pytest.fixture(scope="module")
def pairs(facts):
    trees = [(row, parsed(row)) for row in facts]
    assert [row.path for row, tree in trees if row.broken and tree is not None] == []
    kept = [(row, tree) for row, tree in trees if tree is not None]
    assert len(kept) > 150
    return kept


def test_function_names(pairs):
    for row, tree in pairs:
        assert [f.name for f in row.functions] == [f.name for f in functions(tree)], row.path


def test_functions_in_the_order_of_a_walk(pairs):
    for row, tree in pairs:
        walked = [n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)]
        assert [f.name for f in sorted(row.functions, key=lambda f: (f.depth, f.pos))] == walked, row.path


def test_docstrings(pairs):
    for row, tree in pairs:
        for got, node in zip(row.functions, functions(tree)):
            if "\\" not in got.docstring:  # escapes are left as written
                assert got.docstring == (ast.get_docstring(node) or "").strip(), row.path


def test_parameters(pairs):
    for row, tree in pairs:
        expected = [[a.arg for a in f.args.args if a.arg not in ("self", "cls")] for f in functions(tree)]
        assert [list(f.params) for f in row.functions] == expected, row.path


def test_local_variables(pairs):
    for row, tree in pairs:
        for got, node in zip(row.functions, functions(tree)):
            names = {t.id for n in ast.walk(node) if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
            assert list(got.variables) == sorted(names), (row.path, got.name)


def test_assignment_targets(pairs):
    for row, tree in pairs:
        expected = []
        for node in ast.walk(tree):
            for target in node.targets if isinstance(node, ast.Assign) else []:
                parts = target.elts if isinstance(target, (ast.Tuple, ast.List)) else [target]
                expected += [p.id.lower() for p in parts if isinstance(p, ast.Name)]
        assert [a.name for a in sorted(row.assigned, key=lambda a: (a.depth, a.pos))] == expected, row.path


def test_constants(pairs):
    for row, tree in pairs:
        expected = []
        for node in tree.body:
            body = node.body if isinstance(node, ast.ClassDef) else [node]
            for statement in body:
                if isinstance(statement, ast.Assign):
                    expected += [(t.id, ast.dump(statement.value)) for t in statement.targets if isinstance(t, ast.Name) and t.id.isupper()]
        assert [(c.name, ast.dump(ast.parse(f"({c.value})", mode="eval").body)) for c in row.constant_values] == expected, row.path


def test_files_that_do_not_parse_have_no_symbols(make_files, make_dictionary):
    from plumbline.operators import constants, language

    rf = make_files({"R": {f"R/transformations/transformations_{name}.py": f"def bad_name(a):\n    A = 1\n{text}" for name, text in BROKEN.items()}})
    assert {r.path for r in symbols.files_that_do_not_parse(rf).collect()} == {r.path for r in rf.collect()}
    assert symbols.extract_functions(rf).count() == symbols.extract_assignments(rf).count() == constants.extract_constants(rf).count() == 0
    report = language.language_report(rf, make_dictionary("a")).collect()
    assert len(report) == len(BROKEN) and all("ERROR: " in r.block and r.n_findings == 1 for r in report)


def test_running_sums(spark):
    values = [[], [0], [3], [1, -1, 2, 0, 5, -7, 1, 1, 1], list(range(100))]
    got = spark.createDataFrame([(v,) for v in values], "v array<int>").select("v", source.running(F.col("v")).alias("s")).collect()
    for r in got:
        assert list(r.s) == list(itertools.accumulate(r.v))


def test_locals_count_for_inner_and_outer_functions(make_files):
    rf = make_files({"R": {"R/nested.py": SAMPLES["nested"]}})
    found = {(r.fn_name, r.variable) for r in symbols.extract_local_vars(rf).collect()}
    assert found == {("setUp", "add_x"), ("setUp", "z_value"), ("inner", "z_value"), ("outer", "total")}


def test_locals_after_a_nested_function(make_files):
    text = "def outer(a):\n    def inner(b):\n        inner_value = [\n1]\n    if a: late_value = 3\n    first_value = 1; second_value = 2\n    a.b, plain_value = 1, 2\nmodule_value = 1\n"
    found = {(r.fn_name, r.variable) for r in symbols.extract_local_vars(make_files({"R": {"R/a.py": text}})).collect()}
    outer = {"inner_value", "late_value", "first_value", "second_value"}
    assert found == {("inner", "inner_value"), *(("outer", v) for v in outer)}


def test_last_constant_value_wins_in_first_place(make_files):
    from plumbline.operators import constants

    rf = make_files({"R": {"R/fields.py": 'B = 1\nA = 2\nB = ["x", 3]\n'}})
    found = [(r.pos, r.name, r.value_kind, r.n_elems) for r in constants.extract_constants(rf).orderBy("pos").collect()]
    assert found == [(0, "B", "list", 2), (1, "A", "scalar", 0)]


def test_long_bodies_do_not_overflow_the_matcher(make_files):
    big = "x = 'abc' # c\n" * 40_000
    text = f"def check_a(p, {', '.join(f'q{i}=(1, [2])' for i in range(20_000))}):\n    '''{'word ' * 50_000}'''\n" + big
    rf = make_files({"R": {"R/fields.py": text + "A = [" + "(1, 'b'), " * 20_000 + "]\n"}})
    assert symbols.extract_params(rf).count() == 20_001
    from plumbline.operators import constants

    assert constants.extract_constants(rf).first().n_elems == 20_000
    assert symbols.extract_assignments(rf).count() == 40_001


def test_headers_only_leaves_bodies_unread(spark):
    """F2 to F7: rules of files read function names only, so docstrings are not built for them."""
    files = spark.createDataFrame([("R", "develop", 0, "a.py", "def add_one(a, b):\n    '''Text.'''\n    c = 1\n\nclass X:\n    def run(self):\n        d = 2\n")],
                                  "repo string, branch string, file_ord long, path string, content string")
    whole, short = (source.with_symbols(files, F.lit(True), flag).first() for flag in (False, True))
    assert [f.asDict() for f in short.functions] == [{k: f[k] for k in ("depth", "pos", "indent", "name")} for f in whole.functions]
    assert (short.assigned, short.constant_values, short.broken) == (whole.assigned, whole.constant_values, whole.broken)
