"""Conversation repair against suffix recursion over whole conversations."""

import hashlib
import random

import pytest
import reference
from pyspark.sql import functions as F

from plumbline.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def expected(rows):
    found = reference.repair(reference.damage(rows))
    out = {}
    for conv in {r[0] for r in rows}:
        *numbers, audit, turns = found.get(conv, (0, 0, 0, 0, 0, 0, "", ()))
        out[conv] = (*numbers, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())
    return out


def got(frame):
    rows = [tuple(r) for r in frame.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def odd_rows(n, seed):
    pick = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(pick.choice((1, 2, 3, 5, 8, 40))):
            role = pick.choice(("system", "user", "user", "assistant", "assistant", "tool", "", None))
            text = pick.choice(("Yes.", "No!", "cut off", " \n", "", None, f"turn {turn}?", f"word {pick.random()}", "tail. \t\x0b", "a" * 5000 + "."))
            rows.append((conv if conv else None, turn * pick.choice((1, 1, 2)) if turn else None, role, text))
    # equal turns would be ordered by digests: one row a turn here
    return list({(r[0], r[1]): r for r in rows}.values())


def test_whole_tables_equal_the_recursion(spark):
    for size in ("sf0.001", "sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{size}/conversations.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()]
        assert got(queries.op13_conversation_repair(spark, f"/root/testdata/{size}")) == expected(rows)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_odd_rows_equal_the_recursion_however_they_are_dealt(spark, parts):
    rows = odd_rows(120, int(parts))
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit("x")).withColumn("_conv", F.lit(1))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert got(repair.repair_report(frame)) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_conversation_over_many_ranges(spark, monkeypatch):
    pick = random.Random(5)
    rows = [(1, t, pick.choice(("user", "assistant")), pick.choice((f"{t}.", f"{t}", "again."))) for t in range(700)] + [(2, 0, "user", "hi.")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        frame = spark.createDataFrame(rows, SCHEMA)
        assert got(repair.repair_report(frame)) == expected(rows)
        runs = repair.segments(repair.row_faults(repair.damaged(frame))).groupBy("conv_id").count().collect()
        assert {r["conv_id"]: r["count"] > 5 for r in runs}[1]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_equal_rows_are_one_fact_and_all_count(spark):
    rows = [(1, 3, "user", "Same.")] * 50 + [(1, None, "user", "Same.")] * 3
    (r,) = repair.verdicts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (r.duplicate, r.cost, r.audit, r.illegal, r.gaps) == (52, 52 * 3 + 2, "K" + "D" * 52 + "I", 52, 0)


def test_empty_and_vanished(spark):
    assert repair.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(c for c in range(10_000) if not reference.damage([(c, 0, "user", "x.")]))
    assert got(repair.repair_report(spark.createDataFrame([(gone, 0, "user", "x.")], SCHEMA))) == {gone: (0, 0, 0, 0, 0, 0, "", EMPTY)}


def test_blocks_joined_in_any_way_give_the_same_chart():
    pick = random.Random(3)
    for _ in range(60):
        rows = [(pick.choice("suat"), pick.randrange(4), pick.choice((1, 1, 2))) for _ in range(pick.randrange(1, 14))]
        rows = [(i, f, n if f in (repair.BLANK, repair.DUPLICATE) else 1) for i, f, n in rows]
        whole = repair.derive(rows, range(4))
        cut = pick.randrange(0, len(rows) + 1)
        parts = [p for p in (rows[:cut], rows[cut:]) if p]
        run = repair.Run()
        for p in parts:
            run.add(repair.derive(p, range(4)))
        assert run.chart() == whole


def test_repaired_turns_follow_the_grammar(spark):
    import re

    rows = spark.createDataFrame(odd_rows(60, 9), SCHEMA)
    turns = repair.repaired_turns(rows, repair.verdicts(rows)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("t")).collect()
    assert turns
    for r in turns:
        assert [t.position for t in r.t] == list(range(len(r.t)))
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in r.t))
