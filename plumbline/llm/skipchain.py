"""Personal data by a skip-chain conditional random field.

Nodes are the words that may be personal data: words with a digit or `@`, words beside a written-out at
or dot sign, capitalised words after a title, and every later mention of such a name. All other words are
fixed to "no entity", so that they enter as context only and a document falls into short chains. Neighbouring
nodes share a chain potential. Distant nodes share a skip potential if they repeat each other, or are similar
(the same last seven digits, or the name before an `@`); of equal nodes each is tied to the next one, so that
ties grow with the text, not with its square. Loopy message passing gives each node's marginals; spans found
by the base patterns are observed labels and send their messages along.

Weights are learned by pseudo-likelihood from at most `TRAIN_TEXTS` texts that hold a digit or `@` (those of least
hash): their own base findings and other numbers, and made-up findings and decoys in other spellings set among their words
(`insertions`), since no table marks personal data. What is learned is a table of bounded size.

A word counts as found if its marginal of one label is `THRESHOLD` at least; neighbouring words of one label are
one span. Spans overlap no base span. Kinds: email, ip, card, phone, and person, which only the method finds.

Defined results: a null or empty text has no spans; words and texts of any length are read whole; repeated
rows are read one by one; a null doc_id is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import texts_of

TRAIN_TEXTS = 2000
THRESHOLD = 0.9
BINS = 1 << 12
ROUNDS = 30
SETTLED = 1e-3
DAMPING = 0.2
STEPS = 150
RATE = 0.1
L2 = 1e-4
#: Characters of texts whose graphs are solved together.
CHUNK = 1 << 20
NONE, EMAIL, IP, CARD, PHONE, PERSON = range(6)
KINDS = ("", "email", "ip", "card", "phone", "person")
LABELS = len(KINDS)
CHAIN, REPEAT, SIMILAR = range(3)
Span = tuple[int, int, int]

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ANCHOR = re.compile(r"[0-9@]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SIGN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: An at or dot sign that is written out, as a word or inside one.
_SIGN = re.compile(r"[(\[{<](?:at|dot)[)\]}>]", re.I)
_TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Sra.", "Mme.", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "Mister", "Doctor")
_TITLE_WORDS = frozenset(_TITLES) | {t.upper() for t in _TITLES}
_NAME = re.compile(r"[^\W\d_][^\W\d_'-]*[^\W\d_]")
#: Words that announce a kind.
CUES = {
    "phone": "tel phone call fax mobile cell telefon tél téléphone teléfono llamar anrufen", "email": "mail email e-mail contact correo courriel write",
    "card": "card visa mastercard credit karte tarjeta carte", "ip": "ip host server address adresse dirección",
}
_CUE_OF = {w: kind for kind, words in CUES.items() for w in words.split()}


def luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def _n_digits(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: all fitting characters before an @ that belong to no match before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        if found := _DOMAIN.match(text, at):
            start = at
            while start > end and text[start - 1] in _LOCAL_SIGN:
                start -= 1
            if start < at:
                end = found.end()
                yield start, end, EMAIL
        at = text.find("@", max(at + 1, end))


def _addresses(text: str) -> Iterator[Span]:
    """Each four parts of a dotted run, from its left."""
    if text.count(".") < 3:
        return
    for run in _DOTTED.finditer(text):
        parts = [m.span() for m in _DIGITS.finditer(text, *run.span())]
        for k in range(0, len(parts) - 3, 4):
            if all(b - a < 4 or not text[a : b - 3].strip("0") for a, b in parts[k : k + 4]) and all(int(text[max(a, b - 3) : b]) <= 255 for a, b in parts[k : k + 4]):
                yield parts[k][0], parts[k + 3][1], IP


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, by start, then kind."""
    if not _ANCHOR.search(text):
        return []
    found = [*_emails(text), *_addresses(text)]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() < 40 else ""  # 19 digits and as many signs at most
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), CARD))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= _n_digits(m.group()) <= 15:
                found.append((*m.span(), PHONE))
    return sorted(found, key=lambda s: (s[0], s[2]))


class Graph:
    """Nodes and edges of one text: `spans` of the words' cores, `features`, `edges` (node, node, type), `words` by number."""

    def __init__(self, text: str):
        self.spans: list[tuple[int, int]] = []
        self.features: list[list[int]] = []
        self.edges: list[tuple[int, int, int]] = []
        self.words: list[int] = []
        anchors, signs = ([m.start() for m in p.finditer(text)] for p in (_ANCHOR, _SIGN))
        titled = any(t in text for t in _TITLE_WORDS)
        if not (anchors or signs or titled):
            return
        words = [m.span() for m in _WORD.finditer(text)]
        said = [text[a:b] for a, b in words]
        starts = [a for a, _ in words]
        chosen = {bisect_right(starts, a) - 1 for a in anchors}
        for k in {bisect_right(starts, a) - 1 for a in signs}:
            chosen.update(j for j in (k - 1, k, k + 1) if 0 <= j < len(said))
        names: dict[int, str] = {}
        for k, w in enumerate(said) if titled else ():
            if w in _TITLE_WORDS:
                for j in range(k + 1, min(k + 3, len(said))):
                    core = _core(said[j])
                    if not (_NAME.fullmatch(core) and core[0].isupper()):
                        break
                    names[j] = core
                    if said[j][-1] in ".,;:!?":
                        break
        if names:
            known = set(names.values())
            names |= {k: c for k, w in enumerate(said) if k not in names and (c := _core(w)) in known}
        self.words = sorted(chosen | names.keys())
        last: dict[tuple[int, str], int] = {}
        for n, k in enumerate(self.words):
            a, b = words[k]
            core = _core(said[k])
            start = text.find(core, a, b) if core else a
            self.spans.append((start, start + len(core)) if core else (a, b))
            after_title = k in names and k > 0 and (said[k - 1] in _TITLE_WORDS or k - 1 in names)
            self.features.append(_features(said, k, core, k in names, after_title))
            if n and self.words[n - 1] == k - 1:
                self.edges.append((n - 1, n, CHAIN))
            for kind, key in _keys(core):
                if (before := last.get((kind, key))) is not None and before != n:
                    self.edges.append((before, n, kind))
                last[kind, key] = n

    def observed(self, spans: list[Span]) -> list[int]:
        """Label of every node that overlaps a span, else NONE."""
        out, at = [], 0
        for a, b in self.spans:
            while at < len(spans) and max(s[1] for s in spans[at : at + 1]) <= a:
                at += 1
            hit = next((s for s in spans[at : at + 4] if s[0] < b and s[1] > a), None)
            out.append(hit[2] if hit else NONE)
        return out


def _core(word: str) -> str:
    """The word without punctuation around it; a leading plus and brackets of numbers stay."""
    word = word.rstrip(".,;:!?\"'»”%*#$&|")
    return word.lstrip("\"'«“.,;:!?*#$&|")


def _keys(core: str) -> Iterator[tuple[int, str]]:
    if len(core) > 2:
        yield REPEAT, core
    digits = re.sub("[^0-9]", "", core)
    if len(digits) >= 7 and not re.search("[A-Za-z]", core):
        yield SIMILAR, digits[-7:]
    name = core.partition("@")[0]
    if len(name) > 3 and ("@" in core or "." in core):
        yield SIMILAR, name


def _features(said: list[str], k: int, core: str, is_name: bool, titled: bool) -> list[int]:
    shape = re.sub(r"[0-9]+", lambda m: f"9{min(m.end() - m.start(), 20)}", re.sub(r"[^\W\d_]+", "a", core))
    digits = re.sub("[^0-9]", "", core)
    out = ["bias", f"s:{shape}", f"d:{min(len(digits), 20)}", f"p:{re.sub('[a0-9]+', '', shape)}"]
    if 12 <= len(digits) <= 19 and not re.search("[A-Za-z]", core):
        out.append(f"luhn:{luhn(digits)}")
    groups = re.findall("[0-9]+", core)
    if len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups):
        out.append("octets")
    for j in range(max(0, k - 2), k):
        if cue := _CUE_OF.get(said[j].lower().strip(":.,;=#")):
            out += [f"c:{cue}", f"c:{cue}:{min(len(digits), 12)}"]
    for side, j in (("l", k - 1), ("r", k + 1)):
        if 0 <= j < len(said):
            sign = _SIGN.search(said[j])
            out.append(f"{side}:{sign.group()[1:-1].lower() if sign else 'number' if _DIGITS.search(said[j]) else 'word'}")
    if sign := _SIGN.search(core):
        out.append(f"sign:{sign.group()[1:-1].lower()}")
    if is_name:
        out.append(f"name:{titled}")
    return [crc32(f.encode()) % BINS for f in out]


class Model:
    """Weights of features by label, and of label pairs by edge type."""

    def __init__(self, unary: np.ndarray, pairs: np.ndarray):
        self.unary, self.pairs = unary, pairs


def marginals(unary: np.ndarray, edges: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Loopy sum-product in logarithms; exact on trees. edges: rows (node, node, type)."""
    belief = unary
    if len(edges):
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        table = np.concatenate([pairs[edges[:, 2]], pairs[edges[:, 2]].transpose(0, 2, 1)])
        back = np.roll(np.arange(2 * len(edges)), len(edges))
        message = np.zeros((len(source), unary.shape[1]))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target, message)
            given = (belief[source] - message[back])[:, :, None] + table
            top = given.max(axis=1)
            new = top + np.log(np.exp(given - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - message).max()
            message = DAMPING * message + (1 - DAMPING) * new
            if change < SETTLED:
                break
        belief = unary.copy()
        np.add.at(belief, target, message)
    share = np.exp(belief - belief.max(axis=1, keepdims=True))
    return share / share.sum(axis=1, keepdims=True)


def fit(graphs: list[tuple[Graph, list[int]]]) -> Model:
    """Maximum pseudo-likelihood by gradient steps (Adam); each node is predicted from its features and its neighbours' labels."""
    feature, node, label, edge = [], [], [], []
    for graph, labels in graphs:
        at = len(label)
        for n, own in enumerate(graph.features):
            feature += own
            node += [at + n] * len(own)
        label += labels
        edge += [(at + a, at + b, t) for a, b, t in graph.edges]
    n = len(label)
    unary, pairs = np.zeros((BINS, LABELS)), np.zeros((3, LABELS, LABELS))
    if not n:
        unary[:, NONE] = 1.0
        return Model(unary, pairs)
    feature, node, label, edge = (np.array(x, np.int64) for x in (feature, node, label, edge))
    edge = edge.reshape(-1, 3)
    truth = np.eye(LABELS)[label]
    a, b, t = edge.T
    weights = [unary, pairs]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        score = np.zeros((n, LABELS))
        np.add.at(score, node, unary[feature])
        np.add.at(score, b, pairs[t, label[a]])
        np.add.at(score, a, pairs[t, :, label[b]])
        share = np.exp(score - score.max(axis=1, keepdims=True))
        miss = share / share.sum(axis=1, keepdims=True) - truth
        grad = [L2 * n * unary, L2 * n * pairs]
        np.add.at(grad[0], feature, miss[node])
        np.add.at(grad[1], (t, label[a]), miss[b])
        np.add.at(grad[1].transpose(0, 2, 1), (t, label[b]), miss[a])
        for k, w in enumerate(weights):
            g = grad[k] / n
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    pairs[1:] = (pairs[1:] + pairs[1:].transpose(0, 2, 1)) / 2  # repeated and similar words have no order
    return Model(unary, pairs)


def insertions(pick: random.Random, words: list[str]) -> tuple[list[str], int]:
    """Words of one made-up finding or decoy, and its label; the spellings are those the base patterns miss, and theirs."""
    number = lambda n: "".join(pick.choice("0123456789") for _ in range(n))
    plain = [w for w in words if w.isalpha()] or ["word"]
    kind = pick.choice((EMAIL, IP, CARD, PHONE, PERSON, NONE, NONE, NONE))
    if kind == EMAIL:
        user, host, end = f"{pick.choice(plain).lower()}{pick.choice(('', '.', '_'))}{number(pick.randrange(3))}", f"{pick.choice(('', f'mail{number(1)}.', 'mail.'))}{pick.choice(plain).lower()}", pick.choice(("com", "org", "net"))
        return pick.choice(([f"{user}@{host}.{end}"], [user, "(at)", f"{host}.{end}"], [user, "[at]", host, "[dot]", end], [f"{user}[at]{host}[dot]{end}"])), kind
    if kind == IP:
        parts = [str(pick.randrange(256)) for _ in range(4)]
        six = ":".join(f"{pick.randrange(16, 1 << 16):x}" for _ in range(8))
        return [pick.choice((".".join(parts), "[.]".join(parts), "(.)".join(parts), six))], kind
    if kind == CARD:
        body = number(15)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        return [pick.choice((digits, *(s.join(digits[i : i + 4] for i in range(0, 16, 4)) for s in "./_-")))], kind
    if kind == PHONE:
        a, b, c = number(3), number(3), number(4)
        return pick.choice(([f"+1 ({a}) {b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], ["001", a, b, c], ["tel:", f"0{a}/{b}{c}"])), kind
    if kind == PERSON:
        return [pick.choice(("Mr.", "Mrs.", "Dr.", "Prof.", "Herr", "Frau", "Madame", "Señor")), *((pick.choice(plain) + pick.choice(plain)).capitalize() for _ in range(2))], kind
    body = number(15)
    wrong = next(body + c for c in "0123456789" if not luhn(body + c))
    date = f"{pick.randrange(1900, 2100)}-{pick.randrange(1, 13):02d}-{pick.randrange(1, 29):02d}"
    return [pick.choice((wrong, date, ".".join(reversed(date.split("-"))), f"{pick.randrange(24)}:{number(2)}", f"{number(1)}.{number(1)}.{number(1)}", f"{number(1)}.{number(1)}.", f"v{number(1)}.{number(2)}",
                         f"${number(2)}.{number(2)}", f"{number(2)},{number(3)}", number(pick.randrange(1, 12)), f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}",
                         f"#{number(5)}", f'"{pick.getrandbits(128):032x}"', f"@{pick.choice(plain)}", f"{number(2)}%", f"{pick.choice(plain)}{number(2)}"))], kind


def example(text: str) -> tuple[Graph, list[int]]:
    """The graph of a text among whose words findings and decoys are set, with its labels; the same for the same text."""
    pick = random.Random(crc32(text.encode()))
    words = _WORD.findall(text)
    marks = [NONE] * len(words)
    for _ in range(pick.randrange(3, 8)):
        own, kind = insertions(pick, words[:1000])
        titled = kind == PERSON
        labels = [NONE if titled and k == 0 or w == "tel:" else kind for k, w in enumerate(own)]
        for again in range(pick.choice((1, 1, 2, 3))):
            at = pick.randrange(len(words) + 1)
            if 0 < at < len(words) and marks[at - 1] and marks[at]:  # not inside another one
                continue
            placed, given = (own[-1:], labels[-1:]) if again and titled else (own, labels)
            cue = [pick.choice(CUES[KINDS[kind]].split()) + pick.choice(("", ":"))] if KINDS[kind] in CUES and pick.random() < 0.4 else []
            words[at:at] = [*cue, *placed]
            marks[at:at] = [*[NONE] * len(cue), *given]
    whole = " ".join(words)
    graph = Graph(whole)
    base = graph.observed(base_spans(whole))
    # a made-up finding may hold blanks itself
    spread = [m for w, m in zip(words, marks) for _ in w.split(" ")]
    return graph, [b or spread[k] for b, k in zip(base, graph.words)]


def train(docs: DataFrame, most: int = TRAIN_TEXTS) -> Model:
    """Learns from at most `most` texts, in one task; the driver gets the weights."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs = [example(t.as_py()) for batch in batches for t in texts_of(batch)]
        model = fit(graphs)
        yield pa.record_batch([pa.array([w.astype("<f4").tobytes()], pa.binary()) for w in (model.unary, model.pairs)], names=["unary", "pairs"])

    chosen = (docs.select("text").filter(F.col("text").rlike("[0-9@]")).withColumn("rank", F.xxhash64("text")).orderBy("rank", "text").limit(most)
              .select("text").repartition(1).mapInArrow(learn, "unary binary, pairs binary").first())
    if chosen is None:
        return fit([])
    return Model(np.frombuffer(chosen["unary"], "<f4").reshape(BINS, LABELS).astype(float), np.frombuffer(chosen["pairs"], "<f4").reshape(3, LABELS, LABELS).astype(float))


def added_spans(texts: list[str], found: list[list[Span]], model: Model, threshold: float = THRESHOLD) -> list[list[Span]]:
    """Spans of each text that the field finds beside `found`, which are observed."""
    graphs = [Graph(t) for t in texts]
    at = np.cumsum([0, *(len(g.spans) for g in graphs)])
    out: list[list[Span]] = [[] for _ in texts]
    if not at[-1]:
        return out
    features = [f for g in graphs for f in g.features]
    unary = np.zeros((int(at[-1]), LABELS))
    np.add.at(unary, np.repeat(np.arange(len(features)), [len(f) for f in features]), model.unary[np.array([x for f in features for x in f], np.int64)])
    known = np.array([label for g, spans in zip(graphs, found) for label in g.observed(spans)])
    fixed = np.flatnonzero(known)
    unary[fixed] = -1e3
    unary[fixed, known[fixed]] = 0.0
    edges = np.array([(s + a, s + b, t) for s, g in zip(at, graphs) for a, b, t in g.edges], np.int64).reshape(-1, 3)
    share = marginals(unary, edges, model.pairs)
    label = np.where((share.max(axis=1) >= threshold) & (known == NONE), share.argmax(axis=1), NONE)
    for i, g in enumerate(graphs):
        own = label[at[i] : at[i + 1]].tolist()
        for k, kind in enumerate(own):
            if kind == NONE:
                continue
            a, b = g.spans[k]
            if k and own[k - 1] == kind and g.words[k - 1] == g.words[k] - 1 and not (kind == CARD and _n_digits(texts[i][out[i][-1][0] : b]) > 19):
                a = out[i].pop()[0]
            out[i].append((a, b, kind))
    return out


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
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


_SPANS = "array<struct<kind:string,start:long,end:long>>"


def personal_data(docs: DataFrame, most: int = TRAIN_TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """`(doc_id, base, added)` for every row of `docs(doc_id, text)`: spans in code points, by start, then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, most))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    listed = lambda rows: pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans] for spans in rows], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _chunks(batch):
                base = [base_spans(t) for t in texts]
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), listed(base), listed(added_spans(texts, base, shared.value, threshold))], names=["doc_id", "base", "added"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {_SPANS}, added {_SPANS}")
