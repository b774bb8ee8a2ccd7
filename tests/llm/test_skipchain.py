"""Personal data: base patterns against plain expressions, message passing against enumeration, held-out accuracy."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import reference
from pyspark.sql import functions as F

from plumbline.llm import queries, skipchain

SCHEMA = "doc_id long, text string"
ORDER = {"email": 0, "ip": 1, "card": 2, "phone": 3, "person": 4}


def listed(spans):
    return [(a, b, skipchain.KINDS[k]) for a, b, k in spans]


def test_base_patterns_equal_plain_expressions():
    pick = random.Random(4)
    signs = ["a", "B9", "@", "@", ".", ".", "-", "+", " ", "(", ")", "1", "22", "255", "256", "0", "4111111111111111", "é", "%", "_", "\n", "3.4.5.6", "x@y.z", "+1 (243) 555-1234"]
    for _ in range(4000):
        text = "".join(pick.choice(signs) for _ in range(pick.randrange(1, 25)))
        assert listed(skipchain.base_spans(text)) == reference.personal(text), text
    assert listed(skipchain.base_spans("1" * 5000 + "." * 3000 + "a" * 5000 + "@" * 3000 + "+1" + " " * 5000)) == []


def test_messages_are_exact_on_trees_and_agree_with_observed_words():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 6):
        edges = np.array([(rng.integers(0, k), k, rng.integers(0, 3)) for k in range(1, n)], np.int64).reshape(-1, 3)
        unary, pairs = rng.normal(size=(n, 3)), rng.normal(size=(3, 3, 3))
        pairs[1:] = (pairs[1:] + pairs[1:].transpose(0, 2, 1)) / 2
        want = np.zeros((n, 3))
        for labels in itertools.product(range(3), repeat=n):
            weight = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(pairs[t, labels[a], labels[b]] for a, b, t in edges))
            want[np.arange(n), labels] += weight
        assert skipchain.marginals(unary, edges, pairs) == pytest.approx(want / want.sum(1, keepdims=True), abs=2e-3)
    # a loop of repeated words follows the one that is observed
    unary, pairs = np.zeros((4, 2)), np.zeros((3, 2, 2))
    unary[0] = -1e3, 0
    pairs[skipchain.REPEAT] = np.eye(2) * 2
    ring = np.array([(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 0, 1)])
    assert (skipchain.marginals(unary, ring, pairs)[:, 1] > 0.8).all()


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text rlike '[0-9@]'").select("text").collect()]


@pytest.fixture(scope="module")
def model(texts):
    return skipchain.fit([skipchain.example(t) for t in texts[: len(texts) // 2]])


def found(text, model):
    base = skipchain.base_spans(text)
    return [(skipchain.KINDS[k], text[a:b]) for a, b, k in skipchain.added_spans([text], [base], model)[0]]


def test_held_out_findings_and_decoys(texts, model):
    right = wrong = missed = 0
    for text in texts[len(texts) // 2 :]:
        graph, labels = skipchain.example(text)
        if not labels:
            continue
        unary = np.array([model.unary[f].sum(0) for f in graph.features])
        share = skipchain.marginals(unary, np.array(graph.edges, np.int64).reshape(-1, 3), model.pairs)
        said = np.where(share.max(1) >= skipchain.THRESHOLD, share.argmax(1), 0)
        right += sum(s == y != 0 for s, y in zip(said, labels))
        wrong += sum(s not in (0, y) for s, y in zip(said, labels))
        missed += sum(y != 0 and s == 0 for s, y in zip(said, labels))
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.75


def test_other_spellings_and_repeats(model):
    assert found("write to bob.42 (at) mail7.example.com now", model) == [("email", "bob.42 (at) mail7.example.com")]
    assert found("card 4845.1681.1440.7329", model) == [("card", "4845.1681.1440.7329")]
    assert found("order 9807915762804490, version 2.0.1 of 2024-05-17 costs $12.50 and 20,000", model) == []
    # the same last digits as an observed phone number, far away
    assert ("phone", "243-555-1234") in found("+1 (243) 555-1234 " + "word " * 500 + "243-555-1234", model)
    names = found("Dr. Jane Smith came. " + "word " * 500 + "then Smith left, but smith stayed", model)
    assert names[0] == ("person", "Jane Smith") and ("person", "smith") not in names


def test_skip_edges_grow_with_the_text():
    graph = skipchain.Graph("555-1234 " * 3000)
    assert len(graph.spans) == 3000 and len(graph.edges) <= 3 * 3000


def test_documents_without_personal_data_stay_clean(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = {r.doc_id: r.text for r in rows.collect() if not reference.personal(r.text or "")}
    got = queries.op11_personal_data(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == rows.count() and len(clean) > 800
    assert [r.doc_id for r in got if r.doc_id in clean and r.spans] == []


def test_query_against_plain_expressions(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op11_personal_data(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        base = reference.personal(text or "")
        r = got[d]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for *_, k in base) for kind in ("email", "ip", "card", "phone"))
        said = [f"{k}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        spans = [(int(a), ORDER[k], int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans) and set(said) <= set(r.spans.split(","))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a@b.cd"), (4, "a@b.cd"), (4, "a@b.cd"), (5, "é🙂 a@b.cd " + "x1 " * 5000), (6, "9" * 100_000), (7, "(at)"), (8, "Dr."), (9, "Mr. @"), (10, "@ 1")]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in ("base", "added", "rank")))
    got = skipchain.personal_data(frame).collect()
    assert len(got) == len(rows)
    base = {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.base)) for r in got}
    assert {(None, (("email", 0, 6),)), (4, (("email", 0, 6),)), (5, (("email", 3, 9),)), (1, ()), (6, ())} <= base
    assert skipchain.personal_data(spark.createDataFrame([], SCHEMA)).collect() == []
    blank = skipchain.personal_data(spark.createDataFrame([(1, None), (2, "no numbers")], SCHEMA)).collect()
    assert [(r.base, r.added) for r in blank] == [([], []), ([], [])]
