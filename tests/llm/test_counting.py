"""Scores, joins and duplicates against plain Python."""

import random

import pytest
import reference
from pyspark.sql import functions as F

from plumbline.llm import components, ctw, exact, jaccard, licenses, mixing

SCHEMA = "doc_id long, text string"
ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "É à 漢字 ZZZ"), (904, "x" * 5000), (905, "a b c d"), (906, "A B c d")]


def documents(spark, n):
    return [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(n).collect()]


def clashing(spark, rows, *names):
    """The rows with further columns of names that the operators use."""
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.select("*", *(F.lit("x").alias(n) for n in names))


@pytest.mark.parametrize("bounds", [{}, {"word_bound": 40, "gram_bound": 300}])
def test_context_tree_equals_plain_python(spark, bounds):
    rows = documents(spark, 30) + ODD
    got = {r[0]: r[1:] for r in ctw.score_texts(clashing(spark, rows, "row", "key", "score"), **bounds).collect()}
    for d, want in reference.context_tree(rows).items():
        assert got[d][:4] == want[:4]
        assert got[d][4:6] == pytest.approx(want[4:], rel=1e-9, abs=1e-9)


def test_context_tree_of_nothing(spark):
    assert ctw.score_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_context_tree_keeps_repeated_rows(spark):
    rows = documents(spark, 3)
    got = ctw.score_texts(spark.createDataFrame(rows + rows[:1] * 2, SCHEMA)).collect()
    assert len(got) == 5 and len({r for r in got if r.doc_id == rows[0][0]}) == 1


def near_copies(seed, n):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    bases = [[pick.choice(words) for _ in range(pick.randint(3, 70))] for _ in range(8)]
    rows = []
    for i in range(n):
        text = list(pick.choice(bases))
        for _ in range(pick.randint(0, 4)):
            k = pick.randrange(len(text))
            text[k : k + 1] = pick.choice([[pick.choice(words)], [], [text[k], pick.choice(words)]]) or text[k : k + 1]
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("long_list, block", [(64, 1024), (8, 32)])
def test_jaccard_equals_all_pairs(spark, monkeypatch, long_list, block):
    monkeypatch.setattr(jaccard, "LONG_LIST", long_list)
    rows = near_copies(3, 300) + ODD
    got = {r[0]: tuple(r[1:]) for r in jaccard.near_duplicates(clashing(spark, rows, "n", "cid"), block=block).collect()}
    assert got == reference.near_duplicates(rows)
    assert sum(v[2] > 0 for v in got.values()) > 100


def test_jaccard_one_of_each(spark):
    rows = [(5, "one two three four five six"), (3, "One  two three\nfour five six"), (9, "other words"), (8, None), (7, "")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, SCHEMA)).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == [3, 7, 8, 9]


def test_jaccard_repeated_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 and {r.component_id for r in got} == {1} and {r.n_links for r in got} == {2}
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_equal_texts_meet_in_one_chain_unless_one_hash_overfills(spark):
    rows = [(d, f"text {d % 400}") for d in range(1200)] + [(5000 + d, "hot text") for d in range(300)]
    texts = exact._texts(spark.createDataFrame(rows, SCHEMA))
    keys = texts.select("doc_id", "h", F.sha2("body", 256).alias("text_sha256"))
    for capacity in (3, 8, 64):
        hot = exact.hot_hashes(keys, capacity)
        assert [r.pages for r in hot.collect()] == [-(-300 // capacity)]
        depth = exact.depth_of(keys, hot, capacity)
        loads = texts.join(hot, "h", "left_anti").groupBy(exact._prefix(depth)).agg(F.count_distinct("h").alias("n")).agg(F.max("n")).first()[0]
        assert loads <= capacity and (capacity > 8 or depth > 4)
        chains = [(r.text_sha256, r.first, r.n) for r in exact._chains(texts, keys, capacity, exact.HOT_BOUND).collect()]
        assert [n for _, first, n in chains if first < 5000] == [3] * 400
        assert len({c[0] for c in chains}) == 401 and sum(n for _, first, n in chains if first >= 5000) == 300


def test_the_depth_has_no_limit(spark):
    keys = spark.range(300_000).select(F.xxhash64("id").alias("h"), F.col("id").alias("doc_id"))
    hot = exact.hot_hashes(keys, 4)
    assert hot.count() == 0 and exact.depth_of(keys, hot, 4) > 17
    # 256 keys a bucket: 15 million documents need a depth of 17, and nothing stops at it


@pytest.mark.parametrize("capacity", [1, 3, 1024])
def test_exact_groups(spark, capacity):
    rows = [(4, "a  b"), (2, "a\tb"), (9, "a b"), (7, "a b "), (8, None), (3, ""), (1, "z")] + [(100 + i, "hot\n\ntext") for i in range(40)]
    got = {r[0]: tuple(r[1:4]) for r in exact.exact_groups(clashing(spark, rows, "h", "body", "bucket"), capacity=capacity).collect()}
    want = {4: (2, 3, False), 2: (2, 3, True), 9: (2, 3, False), 7: (7, 1, True), 8: (3, 2, False), 3: (3, 2, True), 1: (1, 1, True)}
    assert got == {**want, **{100 + i: (100, 40, i == 0) for i in range(40)}}


def test_exact_repeated_rows_and_nulls(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (2, "c"), (None, None)]
    kept = exact.distinct_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, "a"), (1, "b"), (2, "c"), (None, None)], key=str)
    assert exact.exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []


MIX = "doc_id long, source string, text string"


def test_mix_targets_and_bounds(spark):
    pick = random.Random(1)
    rows = [(i, pick.choice(["a", "b", "c", "d", None]) if i % 3 else "hot", "w " * pick.randint(0, 40)) for i in range(600)]
    frame = spark.createDataFrame(rows, MIX).withColumn("size", F.lit(1)).withColumn("rank", F.lit("x"))
    got = mixing.pareto_mix(frame).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.pareto_mix(frame.repartition(7)).collect()), key=str)
    by = {}
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and v[0].target <= 3 * v[0].source_size + 1e-6
        assert abs(sum(r.taken for r in v) - v[0].target) <= 40


def test_mix_of_odd_tables(spark):
    assert mixing.pareto_mix(spark.createDataFrame([], MIX)).collect() == []
    none = mixing.pareto_mix(spark.createDataFrame([(1, "a", None), (2, None, "")], MIX)).collect()
    assert {(r.size, r.taken) for r in none} == {(0, 0)}
    one = mixing.mixed_documents(spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y")], MIX)).collect()
    assert len(one) == 2


def test_license_scan(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0. See the MIT  license; cc-by!"), (2, "LGPL-2.1 or GNU General\nPublic License v3"),
            (3, "no terms at all"), (4, "gnu general public licenses"), (5, "Released under CC BY-NC 4.0.")] + ODD
    got = {r.doc_id: r for r in licenses.scan(clashing(spark, rows, "labels", "n_words")).collect()}
    for d, text in rows:
        n, starts, labels = reference.license_places(text)
        assert (got[d].n_words, sorted(got[d].base_starts), ",".join(got[d].base_labels)) == (n, starts, labels)
        assert set(got[d].base_labels) <= set(got[d].labels) and 0 <= got[d].score <= 1
    assert got[1].labels == ["apache", "apache-2.0", "cc-by", "mit"]
    assert got[5].labels == ["cc-by", "cc-by-nc-4.0"] and got[2].labels == ["gpl", "gpl-3", "lgpl-2.1"]
    assert len(licenses.rules()) > 300
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("text, label", [
    ("gpl 3", "gpl-3"), ("GPL v3", "gpl-3"), ("gpl3", "gpl-3"), ("gpl-3.0-or-later", "gpl-3"), ("gpl, version 2", "gpl-2"), ("mpl 2.0", "mpl-2.0"), ("lgpl v2.1", "lgpl-2.1"),
    ("agpl 3", "agpl-3"), ("cc-by-sa 4.0", "cc-by-sa-4.0"), ("licensed under apache 2.0", "apache-2.0"), ("Apache-2.0", "apache-2.0"), ("apache v2.0 license", "apache-2.0"),
    ("gplfoo3", None), ("gpl-compatible-3", None), ("gpl 3.1", None), ("apache_httpd-2.0", None), ("apache_httpd-2.0 license", None), ("the apache 2.0 server", None), ("python 2.0", None)])
def test_short_license_mentions(text, label):
    found = [r.label for _, _, r in licenses.detect(text.lower().encode())]
    assert found == ([label] if label else [])


def test_context_tree_gives_code_lengths(spark):
    rows = [(1, "abc abc abc"), (2, "É à"), (3, ""), (4, None)]
    got = {r.doc_id: r for r in ctw.score_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[d].n_bytes for d in (1, 2, 3, 4)] == [11, 5, 0, 0]
    assert [got[d].bits_per_byte for d in (3, 4)] == [None, None]
    assert all(got[d].bits_per_byte * got[d].n_bytes == pytest.approx(-got[d].score / 0.30102999566398120) for d in (1, 2))


def test_jaccard_links_through_null_ids(spark):
    words = [f"w{k}" for k in range(100)]
    # the first and the last are linked only through the middle one, which has no doc_id
    rows = [(1, " ".join(words)), (None, " ".join([*words[:91], *(f"x{k}" for k in range(9))])), (2, " ".join([*words[9:91], *(f"x{k}" for k in range(9))]))]
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 1), None: (1, 2), 2: (1, 1)}


def test_written_tables_have_an_owner(spark, monkeypatch, tmp_path):
    import os

    from plumbline.llm import shared

    monkeypatch.setattr(shared, "shared_folder", lambda session: f"file://{tmp_path}")
    frame = shared.written(spark.range(5).toDF("n"), "five")
    assert frame.count() == 5 and os.listdir(tmp_path / "plumbline" / spark.sparkContext.applicationId)
    assert shared.clean_up(spark) and not os.path.exists(tmp_path / "plumbline" / spark.sparkContext.applicationId)


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from plumbline.llm import shared

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    with pytest.raises(ValueError):
        shared.shared_folder(session)
