"""Audit policy: every literal a rule depends on, as overridable parameters."""

from __future__ import annotations

from dataclasses import dataclass

# Verbs a function name may start with.
VERBS = (
    "add", "calculate", "group", "select", "join", "write", "sort",
    "drop", "extract", "check", "append", "is", "concat",
    "filter", "map", "merge", "split", "normalize", "transform",
    "validate", "load", "save", "fetch", "update", "remove",
    "create", "delete", "parse", "build", "clean", "format",
    "union", "run", "read", "get", "cast", "recover", "replace",
)

# Function names that are never checked.
IGNORED_FUNCTIONS = (
    "setUp", "tearDown", "main", "__init__", "__str__", "__repr__",
    "setUpClass", "tearDownClass",
)

# Verbs that need an infix in the function name.
REQUIRED_INFIXES = (
    ("join", "_with_"), ("group", "_by_"), ("filter", "_by_"), ("union", "_with_"),
)

# Forbidden import patterns and their labels, in report order.
UDF_IMPORTS = (
    (r"\bfrom\s+pyspark\.sql\.functions\s+import\s+udf\b",
     "from pyspark.sql.functions import udf"),
    (r"\bpyspark\.sql\.functions\.udf\b", "pyspark.sql.functions.udf"),
    (r"\bimport\s+pyspark\.sql\.functions\s+as\s+\w+\b",
     "import pyspark.sql.functions as <alias>"),
    (r"\bfrom\s+pyspark\.sql\.types\s+import\s+UserDefinedType\b",
     "from pyspark.sql.types import UserDefinedType"),
)

# Path fragments of the files the code flags look at.
FLAG_FRAGMENTS = ("/utils/", "/transformations/", "/experiment.py", "/app.py")

# Base names of the files the verb and import rules look at.
VERB_FILE_PATTERNS = (
    r"^transformations.*\.py$", r"^test_transformations.*\.py$",
    r"^utils\.py$", r"^app\.py$",
)
UDF_FILE_PATTERNS = (r"^transformations.*\.py$", r"^utils\.py$")

# Technical local names, parameter and variable exemptions.
TECHNICAL_NAMES = (
    "df", "df1", "df2", "df3", "result", "temp", "tmp",
    "i", "j", "k", "v", "x", "y", "z", "n", "idx",
    "col", "row", "val", "item", "elem", "obj",
    "lst", "dct", "arr", "res", "out", "input",
    "config", "logger", "spark", "session", "mock",
)
VARIABLE_SUFFIXES = ("_df", "_mock", "_dict", "_list", "_str")
VARIABLE_INFIXES = ("_perimeter_", "_hierarchies_", "_epigraph_")
PARAM_SUFFIXES = (
    "_df", "_mock", "_config", "_dict", "_list", "_str", "_path", "_file", "_dir",
)
PARAM_INFIXES = (
    "_perimeter_", "_hierarchies_", "_epigraph_", "_exchange_", "_currency_",
    "_catalog_", "_taxonomy_", "_rate_", "_filter_",
)
PARAM_PREFIXES = ("df_", "mock_", "config_")

# Comments an application entry file may carry.
APP_COMMENT_MARKERS = (
    "your code starts here", "your code ends here", "inicio del código",
    "fin del código", "start here", "end here",
)

# Words that count as English whatever their frequency; pass ``allowed_words`` to
# extend or replace them.
ALLOWED_WORDS = tuple("""
datetime utils concat dataframe input output output_df filters epigraphs logger config partition
result input_df df relativedelta staticmethod joined_df date_str created_df dataframes
persisted_dataframes aggregate_func unix timestamp catalog_df irregula filtered_nulls_df tbuc
disaggregate magicmock coment parquet cond guarannteect comment str bussiness ci disaggregated fxin
aggregate readed deposit emissions not nmd cts regexp replace sum amortization number param
numerator pytest coalesce timedelta function method class object variable parameter argument return
returns value values data file files directory path paths name names type types code string strings
numbers integer float boolean array list lists dict dictionary set sets tuple tuples key keys index
indexes item items element elements length size count total average minimum maximum first last next
previous current new old original copy clone deep shallow null none true false yes no ok error
errors exception exceptions warning warnings info information debug message messages log logs
logging print source target destination results process processing compute calculation transform
transformation convert conversion parse parsing validate validation check verify test testing unit
integration system acceptance quality assurance development production staging environment
configuration settings options parameters arguments default custom special general specific common
unique different similar same equal equivalent identical distinct separate combined merged joined
split divided separated connected linked related associated correlated mapped mapping relationship
connection association correlation dependency dependent independent epigraph perimeter hierarchies
taxonomy segment exchange rate currency catalog identifier identifiers merges concatenated aliased
substring predefined aliasing partitioned filtered added column offices experiment session mock
pyspark spark
""".split())


@dataclass(frozen=True)
class AuditPolicy:
    """Company-specific literals and thresholds; the defaults are neutral names."""

    default_branch: str = "develop"
    url_pattern: str = r"^https?://[A-Za-z0-9.:-]+/(?:[\w-]+/)*projects/[\w-]+/repos/[\w-]+/browse"
    sdk_package: str = "engine_sdk"
    min_sdk_version: tuple[int, ...] = (0, 4, 9)
    sanctioned_writer: str = "engine_mock.write"
    forbidden_schema_value: str = "dev-bucket"
    coverage_line: str = "sonar.python.coverage.reportPaths=coverage.xml"
    max_conf_chars: int = 2400
    build_file: str = "Buildfile"

    verbs: tuple[str, ...] = VERBS
    ignored_functions: tuple[str, ...] = IGNORED_FUNCTIONS
    required_infixes: tuple[tuple[str, str], ...] = REQUIRED_INFIXES
    udf_imports: tuple[tuple[str, str], ...] = UDF_IMPORTS

    allowed_words: tuple[str, ...] = ALLOWED_WORDS
    min_zipf: float = 2.5
    min_line_ratio: float = 0.6
    min_name_ratio: float = 0.7
    max_missing_param_ratio: float = 0.5
    max_extra_params: int = 3
    min_docstring_chars: int = 50
    min_line_chars: int = 10

    def expected_paths(self) -> tuple[tuple[str, bool], ...]:
        """(path, is_below_repo_folder) of the files every repository should have."""
        return (
            ("resources/application.conf", False),
            ("requirements.txt", False),
            ("sonar-project.properties", False),
            (self.build_file, False),
            ("setup.cfg", False),
            ("setup.py", False),
            ("__init__.py", True),
            ("app.py", True),
            ("constants.py", True),
            ("utils/utils.py", True),
            ("fields.py", True),
            ("tests/utils/test_utils.py", False),
            ("tests/test_app.py", False),
            ("tests/transformations/test_transformations.py", False),
        )


DEFAULT_POLICY = AuditPolicy()
