"""Alignment of two tokenizers' tokens by merge-path partitioning.

Token ends of A and B over the same bytes are two sorted lists. A binary search on each diagonal of their
merge grid cuts the merge into pieces of `PIECE` ends each, which need nothing from each other: a piece
finds the overlaps whose byte range ends in it, and the ends that both sides share. Groups that reach over
the border of two pieces are stitched by adding up shared ends. Texts of a batch are merged at once, since
their own ends are shared ends.

Every overlap of an A token and a B token is a link. Links are counted by id pair over all texts. The counts of
pairs that make up at least 1 / `PAIR_BOUND` of all links (so at most `PAIR_BOUND` pairs) are broadcast;
texts keep their rarer pairs, which are joined, and no key of that join can be hot. The highest count of a B id
is one number per entry of B's vocabulary.

Token bytes: A's entries in byte-level decoding; B's pieces in UTF-8 with U+2581 as a blank, byte pieces as
their byte. A text whose tokens do not spell a blank and the text on both sides has no tokens. Texts longer than
`PART` characters are encoded in parts that begin at a single blank between letters, where neither vocabulary
has a token across; other texts of that length are encoded whole. Texts are cut at such blanks, also after a full stop or
comma, into words, and a word of letters is encoded once by a worker that still knows it: each keeps up to `WORDS` of them
and the new ones of a chunk. A side's ids of a text are those of its words.

Defined results: null and empty texts have zeros and no groups; repeated rows are aligned one by one and
each counts; a null doc_id is kept; an empty table gives an empty result; further columns are ignored. The
vocabulary files must be readable on every executor, as installed software is.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textbatch import texts_of

#: Ends merged in one piece.
PIECE = 1 << 14
PAIR_BOUND = 1 << 20
#: Characters of texts encoded together, and of a part of a long text.
CHUNK = 1 << 19
PART = 1 << 20
_BORDER = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: Words that a worker keeps the ids of, those encoded together, and the longest one.
WORDS = 1 << 18
TOGETHER = 256
LONGEST = 64
#: Letters that no normalisation changes. The blank comes first, as a literal is found faster.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD_BORDER = re.compile(f" (?<=[{_LATIN}.,] )(?=[{_LATIN}])")
_KEPT = re.compile(f"[{_LATIN}]+[.,]?")


def pieces(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of a and of b lie before each cut, first and last included; of equal ends a's comes first."""
    diagonal = np.append(np.arange(0, len(a) + len(b), size), len(a) + len(b))
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (todo := np.flatnonzero(low < high)).size:
        middle = (low[todo] + high[todo]) // 2
        right = a[middle] <= b[diagonal[todo] - 1 - middle]
        low[todo[right]] = middle[right] + 1
        high[todo[~right]] = middle[~right]
    return low, diagonal - low


def piece_overlaps(a: np.ndarray, b: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of one piece as (index in a, index in b), in order, and which of b's ends are shared.

    before: the last end of a ahead of the piece. An index may be that of the first token after the piece.
    """
    of_b = np.searchsorted(a, b, "right")
    shared = np.append(before, a)[of_b] == b
    new = np.flatnonzero(~shared)
    i = np.concatenate([np.arange(len(a)), of_b[new]])
    j = np.concatenate([np.searchsorted(b, a, "left"), new])
    order = np.argsort(i + j, kind="stable")
    return i[order], j[order], shared


def align(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (index in a, index in b) in order, and the group of every a and b token; the last ends are equal."""
    cut_a, cut_b = pieces(a, b, size)
    links_a, links_b, shared = [], [], []
    for i0, i1, j0, j1 in zip(cut_a, cut_a[1:], cut_b, cut_b[1:]):
        i, j, own = piece_overlaps(a[i0:i1], b[j0:j1], a[i0 - 1] if i0 else -1)
        links_a.append(i + i0)
        links_b.append(j + j0)
        shared.append(own)
    none = np.zeros(0, np.int64)
    shared = np.concatenate(shared) if shared else none.astype(bool)
    group_b = np.cumsum(shared) - shared  # stitched: shared ends of all pieces before
    group_a = np.searchsorted(b[shared], a, "left")
    return np.concatenate(links_a) if links_a else none, np.concatenate(links_b) if links_b else none, group_a, group_b


def byte_level() -> dict[str, int]:
    """The byte of every character of byte-level vocabularies: printable ones are their own."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts, and the bytes of its entries as an Arrow array."""

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Long texts in parts that begin at a blank."""
        if max(map(len, texts), default=0) <= PART:
            return self.encode(texts)
        return [sum(self.encode(parts(t)), []) for t in texts]


def parts(text: str, size: int = PART) -> list[str]:
    """The text without the blanks that it is cut at, for tokenizers that put one before each part."""
    out, start = [], 0
    while len(text) - start > size and (found := _BORDER.search(text, start + size)):
        out.append(text[start : found.start()])
        start = found.end()
    return [*out, text[start:]]


class ByteSide(Side):
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        entries, of = self.tokenizer.get_vocab(with_added_tokens=True), byte_level()
        table = [b""] * (max(entries.values()) + 1)
        for text, i in entries.items():
            table[i] = bytes(of[c] for c in text) if all(c in of for c in text) else text.encode()
        self.bytes = pa.array(table, pa.large_binary())

    def encode(self, texts: list[str]) -> list[list[int]]:
        # the fast form gives the same ids without the place of each token in the text
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceSide(Side):
    def __init__(self, path: str):
        import sentencepiece

        self.tokenizer = t = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = pa.array([bytes([int(t.id_to_piece(i)[3:5], 16)]) if t.is_byte(i) else t.id_to_piece(i).replace("▁", " ").encode()
                               for i in range(t.get_piece_size())], pa.large_binary())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tokenizer.encode(texts, num_threads=1)


class Words:
    """Ids of texts on both sides, put together from those of their words."""

    def __init__(self, *sides: Side):
        self.sides, self.sizes = sides, [np.diff(np.frombuffer(s.bytes.buffers()[1], np.int64)[: len(s.bytes) + 1]) for s in sides]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int64) for _ in self.sides]
        self.first = [np.zeros(1, np.int64) for _ in self.sides]

    def _encoded(self, k: int, kept: list[str], odd: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of side k of all these words, and how many each has."""
        groups = [" ".join(kept[i : i + TOGETHER]) for i in range(0, len(kept), TOGETHER)]
        ids = np.fromiter(chain.from_iterable(self.sides[k].encode(groups)), np.int64)
        ends = np.cumsum(self.sizes[k][ids])
        wanted = np.cumsum([len(w.encode()) + 1 for w in kept])
        last = np.searchsorted(ends, wanted)
        if len(kept) and not (ends[-1] == wanted[-1] and np.array_equal(ends[last], wanted)):
            kept, odd, ids, last = [], kept + odd, ids[:0], last[:0]  # not spelled by their tokens
        alone = self.sides[k].ids(odd)
        n = np.concatenate([np.diff(last, prepend=-1), np.fromiter(map(len, alone), np.int64, len(alone))])
        return np.concatenate([ids, np.fromiter(chain.from_iterable(alone), np.int64)]), n

    def of_texts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each side: the ids of all texts, and where each text's begin; the end comes last."""
        if len(self.place) > WORDS:
            self.forget()
        split = [_WORD_BORDER.split(t) for t in texts]
        words = list(chain.from_iterable(split))
        new = set(words).difference(self.place)
        kept = [w for w in new if len(w) <= LONGEST and _KEPT.fullmatch(w)]
        odd = list(new.difference(kept))
        known = len(self.place) + len(kept)
        self.place.update(zip(kept + odd, range(len(self.place), known + len(odd))))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        of_text = np.cumsum([0, *map(len, split)])
        out = []
        for k in range(len(self.sides)):
            ids, n = self._encoded(k, kept, odd)
            ids, first = np.concatenate([self.ids[k], ids]), np.concatenate([self.first[k], self.first[k][-1] + np.cumsum(n)])
            start, size = first[at], first[at + 1] - first[at]
            ends = np.concatenate([[0], np.cumsum(size)])
            out.append((ids[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends[of_text]))
            self.ids[k], self.first[k] = ids[: first[known]].copy(), first[: known + 1].copy()
        for word in odd:
            del self.place[word]
        return out


@lru_cache(maxsize=2)
def words_of(a: Side, b: Side) -> Words:
    return Words(a, b)


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[Side, Side, pa.Array]:
    """Both tokenizers, and the signs of groups: A ids before `,`, before `|`, B ids before `,`, before `;`, at the end."""
    a, b = ByteSide(a_path), PieceSide(b_path)
    signs = [f"{i}{c}" for c, n in ((",", len(a.bytes)), ("|", len(a.bytes)), (",", len(b.bytes)), (";", len(b.bytes)), ("", len(b.bytes))) for i in range(n)]
    return a, b, pa.array(signs, pa.large_string())


def _laid(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """Where each entry ends in the joined entries, and their bytes."""
    found = table.take(pa.array(ids))
    _, offsets, data = found.buffers()
    ends = np.frombuffer(offsets, np.int64)[found.offset : found.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    return ends, memoryview(data).cast("B") if data is not None else memoryview(b"")


class Aligned:
    """Texts of one chunk: tokens, links and groups of those that both sides spell."""

    def __init__(self, texts: list[str], a: Side, b: Side, signs: pa.Array):
        self.signs, self.sizes = signs, (len(a.bytes), len(b.bytes))
        full = [k for k, t in enumerate(texts) if t]
        given = [texts[k] for k in full]
        tokens = []
        right = np.ones(len(full), bool)
        for side, (every, first) in zip((a, b), words_of(a, b).of_texts(given)):
            ends, data = _laid(side.bytes, every)
            right &= np.array([data[ends[s] : ends[e]] == (" " + t).encode() for t, s, e in zip(given, first, first[1:])], bool)
            tokens.append((every, first, np.diff(ends)))
        self.n = np.zeros((2, len(texts)), np.int64)
        kept = np.array(full, np.int64)[right]
        self.id, ends = [], []
        for side, (every, first, size) in enumerate(tokens):
            use = np.repeat(right, np.diff(first))
            self.id.append(every[use])
            ends.append(np.cumsum(size[use]))
            self.n[side, kept] = np.diff(first)[right]
        self.first = [np.concatenate([[0], np.cumsum(n)]) for n in self.n]
        self.links_a, self.links_b, self.group_a, self.group_b = align(*ends)
        self.text_of_link = np.repeat(np.arange(len(texts)), self.n[0])[self.links_a]
        self.n_links = np.bincount(self.text_of_link, minlength=len(texts))
        self.n_groups = self.n[0] + self.n[1] - self.n_links  # each end but the shared ones makes a link of its own

    def groups(self) -> Iterator[memoryview]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        (na, nb), a, b = self.sizes, *self.id
        last_a, last_b = (np.append(g[1:] != g[:-1], [True] * (len(g) > 0)) for g in (self.group_a, self.group_b))
        sign_b = 2 * na + b + nb * last_b
        sign_b[self.first[1][1:][self.n[1] > 0] - 1] += nb
        out = np.empty(len(a) + len(b), np.int64)
        total = int(self.group_b[-1]) + 1 if len(b) else 0  # every group has tokens of both sides
        size_a, size_b = (np.bincount(g, minlength=total) for g in (self.group_a, self.group_b))
        out[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[self.group_a]] = a + na * last_a
        out[np.arange(len(b)) + np.cumsum(size_a)[self.group_b]] = sign_b
        ends, data = _laid(self.signs, out)
        at = ends[self.first[0] + self.first[1]]
        return (data[s:e] for s, e in zip(at, at[1:]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, pair) with counts, in order; a pair is A's id * 2 ** 32 + B's id."""
        bits = [max(n - 1, 0).bit_length() for n in self.sizes]  # vocabularies and a chunk's texts take far less than 63 bits together
        key = (self.text_of_link << bits[0] | self.id[0][self.links_a]) << bits[1] | self.id[1][self.links_b]
        key.sort()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        text, a, b = key[new] >> sum(bits), key[new] >> bits[1] & (1 << bits[0]) - 1, key[new] & (1 << bits[1]) - 1
        return text, a << 32 | b, np.diff(np.append(new, len(key)))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about CHUNK characters: first row and texts."""
    held, first, size = [], 0, 0
    for k, text in enumerate(texts_of(batch)):
        text = text.as_py() or ""
        if held and size + len(text) > CHUNK:
            yield first, held
            held, first, size = [], k, 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def token_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """`(doc_id, groups)`: ids of A and B in each group, as `a1,a2|b1;a3|b2,b3`; empty without tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _chunks(batch):
                found = [str(g, "ascii") for g in Aligned(texts, *sides(a_path, b_path)).groups()]
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), pa.array(found, pa.string())], names=["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, groups string")


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Sizes, digest of the groups, and the distinct linked id pairs with counts of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, texts in _chunks(batch):
                found, n = Aligned(texts, *sides(a_path, b_path)), len(texts)
                digests = [hashlib.sha256(g).hexdigest() if len(g) else "" for g in found.groups()]
                text, pair, times = found.pairs()
                offsets = pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32))
                yield pa.record_batch([pa.array(np.arange(row, row + n)), batch.column(0).slice(first, n), *(pa.array(c) for c in (*found.n, found.n_groups, found.n_links)), pa.array(digests, pa.string()),
                                       pa.ListArray.from_arrays(offsets, pa.array(pair)), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))], names=[f.split()[0] for f in _ALIGNED.split(", ")])
                row += n

    return docs.select("doc_id", "text").mapInArrow(run, _ALIGNED)


def pair_counts(texts: DataFrame) -> DataFrame:
    """`(pair, n, best)`: links of every id pair over all texts, and whether no pair of its B id has more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = (np.asarray(batch.column(k).flatten()) for k in (0, 1))
            pair, place = np.unique(pairs, return_inverse=True)
            yield pa.record_batch([pa.array(pair.astype(np.int64)), pa.array(np.bincount(place, times, len(pair)).astype(np.int64))], names=["pair", "n"])

    counts = written(texts.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # one row an entry of B's vocabulary
    return counts.join(F.broadcast(most), b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


_SCORED = "row long, best_often long, sum_often long, pairs array<long>, times array<int>"


def _often(texts: DataFrame, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Sums over the pairs of `table`, which is sorted, and the other pairs of every text."""
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for batch in batches:
            lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch.column(1), batch.column(2))]
            sizes = np.diff(np.asarray(lists[0].offsets))
            pairs, times = (np.asarray(c.flatten()) for c in lists)
            text = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            seen = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            at, of, n = at[seen], text[seen], times[seen].astype(np.int64)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], of, n * best[at])
            np.add.at(sums[1], of, n * counts[at])
            offsets = pa.array(np.searchsorted(text[~seen], np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.record_batch([batch.column(0), pa.array(sums[0]), pa.array(sums[1]), *(pa.ListArray.from_arrays(offsets, pa.array(v[~seen])) for v in (pairs, times))],
                                  names=[f.split()[0] for f in _SCORED.split(", ")])

    return texts.select("row", "pairs", "times").mapInArrow(run, _SCORED)


def cross_alignment(docs: DataFrame, a_path: str, b_path: str, pair_bound: int = PAIR_BOUND) -> DataFrame:
    """`(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)` for every row of `docs(doc_id, text)`.

    n_best: links whose pair has the highest count of its B id; count_sum: the counts of all links' pairs.
    """
    texts = written(aligned_texts(docs, a_path, b_path), "aligned-texts")
    counts = written(pair_counts(texts), "pair-scores")
    total = counts.agg(F.sum("n")).first()[0] or 0
    many = F.col("n") >= max(1, -(-total // pair_bound))
    often = counts.filter(many).select("pair", "n", "best").toArrow()
    keys, n, best = (often[c].to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(keys)
    scored = written(_often(texts, (keys[order], n[order], best[order].astype(np.int64))), "alignment-sums")
    asked = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = asked.join(counts.filter(~many), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_rare"), F.sum(F.col("times") * F.col("n")).alias("sum_rare"))
    sums = scored.drop("pairs", "times").join(rare, "row", "left").select(
        "row", (F.col("best_often") + F.coalesce("best_rare", F.lit(0))).alias("n_best"), (F.col("sum_often") + F.coalesce("sum_rare", F.lit(0))).alias("count_sum"))
    return texts.drop("pairs", "times").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
