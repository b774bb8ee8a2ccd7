"""SentencePiece (merge type) encoding by a table of each prefix's last token, and decoding.

For every prefix of a span the table holds the last token of the prefix's encoding, which is unique:
of the tokens that an automaton finds to end at the position, it is the one whose predecessor (the
last token of what precedes it) forms a compatible pair with it, i.e. the pair's text encodes as just
that pair. The ids of the span are then read backwards from its end. No merge is tried on the span
itself. Spans end before a space, since no token has a space after another character, and around
characters without a token, which become byte tokens.

The model file is a parameter; only its pieces, scores and flags are read. Models that normalise text
or hold user-defined pieces are refused.

Defined results: a null text is empty and has begin and end ids only; blanks, line breaks, any
Unicode text and texts of any length are encoded whole; repeated rows are encoded one by one; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import texts_of

SPACE_MARK = "▁"
#: Spans kept per generation of the cache, and their greatest length.
CACHE_SPANS = 200_000
CACHE_LENGTH = 48
#: Compatible pairs kept.
PAIR_CACHE = 1_000_000
NORMAL, BYTE = 1, 6
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


class Merges:
    """The vocabulary, and plain merging for the few short texts that a pair test needs."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        flags = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or flags.precompiled_charsmap
                or not flags.add_dummy_prefix or flags.remove_extra_whitespaces or kinds - {1, 2, 3, BYTE}):
            raise ValueError("a merge model with byte pieces, a leading space and no normaliser is needed")
        self.texts = [p.piece.replace(SPACE_MARK, " ") for p in model.pieces]
        self.ids = {self.texts[i]: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = [p.score for p in model.pieces]
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        if any(" " in t.lstrip(" ") for t in self.ids):
            raise ValueError("a token has a space after another character")

    def merge(self, text: str) -> list[str]:
        """Best score first, leftmost of equals."""
        part, after, before = list(text), [*range(1, len(text)), -1], [-1, *range(len(text) - 1)]
        queue: list = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (found := self.ids.get(part[i] + part[j])) is not None:
                heapq.heappush(queue, (-self.scores[found], i, part[i], part[j]))

        for i in range(len(part) - 1):
            offer(i)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if part[i] != left or j < 0 or part[j] != right:
                continue
            part[i], part[j], after[i] = left + right, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in part if p]


class Encoder:
    """Encodes spans by the prefix table; `span(text)` gives (ids as little-endian 32-bit, decoded text)."""

    def __init__(self, path: str):
        import ahocorasick

        self.merges = merges = Merges(path)
        self.match = ahocorasick.Automaton()
        for text, i in merges.ids.items():
            if merges.merge(text) == [text]:  # others never come out of merging
                self.match.add_word(text, (i, len(text)))
        self.match.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        self.unknown = re.compile("[^" + "".join(re.escape(c) for c in merges.ids if len(c) == 1) + "]").search
        self.id_bytes = [i.to_bytes(4, "little") for i in range(len(merges.texts))]
        # a line break without a token ends a span, and so does a letter before another sign if no token has the two
        rest = r"[^ \n]" if "\n" not in merges.ids else "[^ ]"
        odd = "".join({t[i] for t in merges.ids for i in (m.start() for m in re.finditer(r"[^\W\d_](?=[\W\d_])", t))})
        letter = rf"[^\W\d_{re.escape(odd)}]"
        other = rf"(?:(?!{letter}){rest})"
        if any(re.search(rf"{letter}(?!{letter})(?s:.)", t) for t in merges.ids):
            self.spans = re.compile(rf" *{rest}+| +|\n").findall
        else:
            self.spans = re.compile(rf" *{other}*{letter}+| *{other}+| +|\n").findall

    def compatible(self, pair: int) -> bool:
        """pair: left token * 2**32 + right token."""
        left, right = (self.merges.texts[i] for i in divmod(pair, 1 << 32))
        if len(self.pairs) >= PAIR_CACHE:
            self.pairs.clear()
        self.pairs[pair] = known = self.merges.merge(left + right) == [left, right]
        return known

    def ids(self, span: str) -> list[int]:
        # last[i]: last token of the first i characters; None: not settled, -1: the start or a character without a token
        last: list[int | None] = [None] * (len(span) + 1)
        last[0] = -1
        if self.unknown(span):
            for i, c in enumerate(span):
                if c not in self.merges.ids:
                    last[i + 1] = -1
        pairs, compatible = self.pairs, self.compatible
        for end, (token, length) in self.match.iter(span):
            if last[end + 1] is None and (before := last[end + 1 - length]) is not None:
                if before < 0:
                    last[end + 1] = token
                else:
                    pair = before << 32 | token
                    known = pairs.get(pair)
                    if known or known is None and compatible(pair):
                        last[end + 1] = token
        out: list[int] = []
        at, texts = len(span), self.merges.texts
        while at:
            token = last[at]
            if token is None:
                raise ValueError(f"no token ends at {at} of {span!r}")
            if token < 0:
                out.extend(self.merges.bytes[b] for b in reversed(span[at - 1].encode()))
                at -= 1
            else:
                out.append(token)
                at -= len(texts[token])
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> str:
        """Texts of the tokens; runs of byte tokens as UTF-8, a wrong byte as U+FFFD; control ids are empty."""
        if self.merges.byte_of.keys().isdisjoint(ids) and ids[:1] != [self.merges.begin] and ids[-1:] != [self.merges.end]:
            return "".join([self.merges.texts[i] for i in ids])
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if (byte := self.merges.byte_of.get(i)) is not None:
                run.append(byte)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in (self.merges.begin, self.merges.end):
                out.append(self.merges.texts[i])
        return "".join(out) + run.decode("utf-8", "replace")

    def span(self, text: str) -> tuple[bytes, str]:
        found = self.young.get(text) or self.old.get(text)
        if found is None:
            ids = self.ids(text)
            found = b"".join([self.id_bytes[i] for i in ids]), self.decode(ids)
        if len(text) <= CACHE_LENGTH and text not in self.young:
            if len(self.young) >= CACHE_SPANS:
                self.old, self.young = self.young, {}
            self.young[text] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """All ids with begin and end, and the decoded text without the leading space."""
        first, last = self.id_bytes[self.merges.begin], self.id_bytes[self.merges.end]
        if not text:
            return first + last, ""
        known, span = self.young, self.span
        parts = [known.get(s) or span(s) for s in self.spans(" " + text.replace(SPACE_MARK, " "))]
        return b"".join([first, *[p[0] for p in parts], last]), "".join([p[1] for p in parts])[1:]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """`(doc_id, n_tokens, ids, decoded)` for every row of `docs(doc_id, text)`; ids are 32-bit little-endian.

    `model_path` must be readable on every executor, as installed software is.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model_path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both = [encode(t or "") for t in texts_of(part).to_pylist()]
                ids = [b for b, _ in both]
                yield pa.record_batch([part.column(0), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary()),
                                       pa.array([t for _, t in both], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
