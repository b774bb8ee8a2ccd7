"""Seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built, planned and run in full into a sink that keeps nothing.
Every query runs once untimed and then BENCH_RUNS times (default 1); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.checks.queries import queries  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = (
    "repo_manifest", "expected_files_missing", "content_lookup", "flags_by_repo", "flag_partition_read",
    "last_wins_by_basename", "version_consistency", "extract_functions", "extract_docstrings",
    "extract_constants", "fn_verb_report", "variable_verb_violations", "comment_verdicts", "findings_text",
    "zipf_table", "english_texts", "docstring_language", "language_report", "scorecard",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "plumbline-bench", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.driver.memory": "12g",
        "plumbline.spread": cpus if cpus.isdigit() else "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    registry = queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
