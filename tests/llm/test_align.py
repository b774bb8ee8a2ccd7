"""Cross-tokenizer alignment against byte-by-byte plain Python."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import reference
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import align, queries

SCHEMA = "doc_id long, text string"
A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [(900, None), (901, ""), (902, " "), (903, " \n\t  x"), (904, "É à 漢字 ZZZ 🙂🙂 ﬁ"), (905, "a▁b"), (906, "<|endoftext|> <s> </s> <unk> <0x41>"), (907, "x" * 6000),
       (908, "l'été, don't   stop\n\n\n"), (909, " 　 ​\x00\x01"), (None, "no id"), (None, None), (907, "x" * 6000), (910, "नमस्ते दुनिया")]


@pytest.fixture(scope="module")
def tokenizers():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def expected(rows, tokenizers):
    return sorted(((d, *n, hashlib.sha256(g.encode()).hexdigest() if g else "") for d, *n, g in reference.alignments(rows, *tokenizers)), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("bound", [align.PAIR_BOUND, 20, 1])
def test_alignment_equals_plain_python(spark, tokenizers, bound):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()] + ODD
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in ("row", "pairs", "pair", "n_best")))
    assert got(align.cross_alignment(frame, A, B, bound)) == expected(rows, tokenizers)


def test_the_query_covers_the_whole_table(spark, tokenizers):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op12_cross_alignment(spark, "/root/testdata/sf0.001")) == expected(rows, tokenizers)


def test_groups_as_texts(spark, tokenizers):
    frame = spark.createDataFrame(ODD, SCHEMA)
    want = sorted((d, g) for d, *_, g in reference.alignments(ODD, *tokenizers) if d is not None)
    assert sorted((r.doc_id, r.groups) for r in align.token_groups(frame, A, B).collect() if r.doc_id is not None) == want


def test_pieces_of_any_size_give_the_same_links():
    pick = random.Random(7)
    for _ in range(200):
        end = pick.randrange(1, 60)
        a, b = (np.array(sorted({*pick.sample(range(1, end + 1), pick.randrange(0, end)), end})) for _ in range(2))
        links = sorted({(np.searchsorted(a, k, "right"), np.searchsorted(b, k, "right")) for k in range(end)})
        for size in (1, 2, 5, 1000):
            i, j, group_a, group_b = align.align(a, b, size)
            assert list(zip(i, j)) == links
            shared = np.intersect1d(a, b)
            assert list(group_a) == list(np.searchsorted(shared, a)) and list(group_b) == list(np.searchsorted(shared, b))
            cut_a, cut_b = align.pieces(a, b, size)
            assert set(np.diff(cut_a + cut_b)[:-1]) <= {size}


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert align.cross_alignment(empty, A, B).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, "")], SCHEMA)
    assert got(align.cross_alignment(nulls, A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_long_texts_are_cut_where_no_token_reaches(monkeypatch):
    pick = random.Random(2)
    words = ["word", "a", "I", "don't", "x1", "é", "漢字", "  ", "\n", "end.", "of"]
    for _ in range(30):
        text = " ".join(pick.choice(words) for _ in range(300))
        for side in align.sides(A, B)[:2]:
            monkeypatch.setattr(align, "PART", 1 << 20)
            whole = side.ids([text])
            monkeypatch.setattr(align, "PART", 50)
            assert [sum(side.encode(align.parts(text, 50)), [])] == whole
            assert len(align.parts(text, 50)) > 3


def test_ids_without_places_in_the_text():
    """op12: the byte-level side asks for ids alone, which are those of the whole encoding."""
    class Fast:
        def __init__(self, own):
            self.encode_batch_fast = own.encode_batch_fast

    side, texts = align.ByteSide(A), [t or "" for _, t in ODD]
    whole = [e.ids for e in side.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    side.tokenizer = Fast(side.tokenizer)
    assert side.encode(texts) == whole


def test_words_met_before_are_not_encoded_again(spark, monkeypatch):
    """op12: ids put together from those of words are those of the whole text, and a word is encoded once."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text] + [t for _, t in ODD if t]
    texts += ["A b. C, d.  E\n F é À la l'été x1 y", "a  b ​ c d é f ﬁ g", " a. b", "a b ", "don't can't. we'll go ", "a. \n b ,c . d", "x" * 100 + " " + "y" * 100]
    pair = align.sides(A, B)[:2]
    words, seen = align.Words(*pair), []
    for bound in (align.WORDS, 0):
        monkeypatch.setattr(align, "WORDS", bound)
        for some in (texts[::2], texts[1::2], texts):
            for side, (ids, first) in zip(pair, words.of_texts(some)):
                assert [list(ids[s:e]) for s, e in zip(first, first[1:])] == side.encode(some)
    monkeypatch.setattr(align, "WORDS", 1 << 18)
    words = align.Words(*pair)
    monkeypatch.setattr(align.ByteSide, "encode", lambda self, given, own=align.ByteSide.encode: seen.extend(given) or own(self, given))
    for _ in range(2):
        words.of_texts(["Alpha beta, gamma. Delta"])
    assert sorted(" ".join(seen).split()) == ["Alpha", "Delta", "beta,", "gamma."]
