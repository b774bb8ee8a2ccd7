"""License scan: ordered signature rules behind a keyword prefilter.

`rules()` derives several hundred regular expressions from families (name, identifiers, versions,
addresses) by a template for each form of mention. A rule runs on a text only if all of its keywords occur in it. Of
the hits, in rule order (priority, then length, then position), one is suppressed if its interval lies
within that of a hit already accepted; what stays names the labels. The four base phrases are found
apart from the rules, as places of consecutive words, and their labels always stay.

Defined results: a null or empty text has no words, empty labels, null places and score 0; texts are
scanned whole whatever their length; repeated rows are scanned one by one; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import chunks, texts_of, words

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, name (a pattern; a blank stands for any separators), keyword of the name,
# identifiers, versions, host or path of its address.
FAMILIES = [
    ("gpl", "gnu general public licen[cs]e", "general public", ("gpl",), ("1", "2", "3"), "gnu.org/licenses/gpl"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "general public", ("lgpl",), ("2", "2.1", "3"), "gnu.org/licenses/lgpl"),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", "affero", ("agpl",), ("1", "3"), "gnu.org/licenses/agpl"),
    ("gfdl", "gnu free documentation licen[cs]e", "free documentation", ("gfdl", "fdl"), ("1.1", "1.2", "1.3"), "gnu.org/licenses/fdl"),
    ("apache", "apache (?:software )?licen[cs]e", "apache", ("apache",), ("1.0", "1.1", "2.0"), "apache.org/licenses/license"),
    ("mit", "mit licen[cs]e", "mit", ("mit",), (), "opensource.org/licenses/mit"),
    ("mit", "expat licen[cs]e", "expat", ("expat",), (), "directory.fsf.org/wiki/license:expat"),
    ("bsd-2-clause", "(?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e", "bsd", ("bsd-2-clause",), (), "opensource.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "(?:new|modified|revised|3 clause|three clause) bsd licen[cs]e", "bsd", ("bsd-3-clause",), (), "opensource.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "(?:original|old|4 clause|four clause) bsd licen[cs]e", "bsd", ("bsd-4-clause",), (), "spdx.org/licenses/bsd-4-clause"),
    ("bsd", "bsd (?:style )?licen[cs]e", "bsd", ("bsd",), (), "opensource.org/licenses/bsd-license"),
    ("isc", "isc licen[cs]e", "isc", ("isc",), (), "opensource.org/licenses/isc"),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib", ("zlib",), (), "opensource.org/licenses/zlib"),
    ("mpl", "mozilla public licen[cs]e", "mozilla", ("mpl",), ("1.0", "1.1", "2.0"), "mozilla.org/mpl"),
    ("epl", "eclipse public licen[cs]e", "eclipse", ("epl",), ("1.0", "2.0"), "eclipse.org/legal/epl"),
    ("cpl", "common public licen[cs]e", "common public", ("cpl",), ("1.0",), "opensource.org/licenses/cpl1.0"),
    ("cddl", "common development and distribution licen[cs]e", "common development", ("cddl",), ("1.0", "1.1"), "opensource.org/licenses/cddl"),
    ("eupl", "european union public licen[cs]e", "european union", ("eupl",), ("1.0", "1.1", "1.2"), "joinup.ec.europa.eu/page/eupl"),
    ("artistic", "artistic licen[cs]e", "artistic", ("artistic",), ("1.0", "2.0"), "opensource.org/licenses/artistic"),
    ("bsl", "boost software licen[cs]e", "boost", ("bsl",), ("1.0",), "boost.org/license"),
    ("osl", "open software licen[cs]e", "open software", ("osl",), ("1.0", "1.1", "2.0", "2.1", "3.0"), "opensource.org/licenses/osl"),
    ("afl", "academic free licen[cs]e", "academic free", ("afl",), ("1.1", "1.2", "2.0", "2.1", "3.0"), "opensource.org/licenses/afl"),
    ("ms-pl", "microsoft public licen[cs]e", "microsoft", ("ms-pl",), (), "opensource.org/licenses/ms-pl"),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "microsoft", ("ms-rl",), (), "opensource.org/licenses/ms-rl"),
    ("psf", "python software foundation licen[cs]e", "python software", ("psf", "python"), ("2.0",), "docs.python.org/license"),
    ("ofl", "(?:sil )?open font licen[cs]e", "open font", ("ofl",), ("1.0", "1.1"), "scripts.sil.org/ofl"),
    ("unlicense", "unlicense", "unlicense", ("unlicense",), (), "unlicense.org"),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "want to public", ("wtfpl",), ("2",), "wtfpl.net"),
    ("public-domain", "(?:dedicated to|released into|in) the public domain", "public domain", (), (), "creativecommons.org/publicdomain/mark"),
    ("proprietary", "all rights reserved", "rights reserved", (), (), ""),
]
# Terms of the attribution licenses in long and short form, and their versions.
CC_TERMS = {"": "", "sa": "sharealike", "nd": "noderiv(?:ative)?s", "nc": "noncommercial", "nc-sa": "noncommercial sharealike", "nc-nd": "noncommercial noderiv(?:ative)?s"}
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
for _short, _long in CC_TERMS.items():
    _id, _path = f"cc-by-{_short}".strip("-"), f"creativecommons.org/licenses/by-{_short}".strip("-")
    FAMILIES.append((_id, f"creative commons attribution {_long}".strip(), "creative commons", (), CC_VERSIONS, _path))
    FAMILIES.append((_id, _id.replace("-", " "), "cc", (_id,), CC_VERSIONS, ""))
FAMILIES.append(("cc0", "creative commons zero", "creative commons", (), ("1.0",), "creativecommons.org/publicdomain/zero"))
FAMILIES.append(("cc0", "cc ?0", "cc", ("cc0",), ("1.0",), ""))
#: Identifiers that also name other things with versions: a short mention counts with "licen" within so many bytes.
AMBIGUOUS = frozenset(("apache", "python"))
CONTEXT = 40
#: Between an identifier and its version: at most one sign, or white space.
_SEPARATOR = r"(?:[-_/]|,?\s+\(?)?"
_WORD = rb"0-9a-z\x80-\xff"
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SCHEMA = "doc_id long, n_words long, base_starts array<long>, base_labels array<string>, labels array<string>, spans array<struct<label:string,start:long,end:long,rule:string>>, score double"


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    confidence: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    in_context: bool = False


def _compiled(text: str) -> re.Pattern:
    """A blank: any run of signs that are no word, also in " ?"; never write one inside brackets. The ends must not touch a word."""
    body = text.encode().replace(b" ?", b"[^" + _WORD + b"]*").replace(b" ", b"[^" + _WORD + b"]+")
    return re.compile(b"(?<![" + _WORD + b"])" + body + b"(?![" + _WORD + b"])")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """In order: address and identifier, notice with version, notice, name with version, name."""
    found: list[Rule] = []

    def add(label: str, form: str, priority: int, confidence: float, keywords: tuple[str, ...], pattern: str, in_context: bool = False) -> None:
        found.append(Rule(f"{label}:{form}:{len(found)}", label, priority, confidence, tuple(w.encode() for k in keywords for w in k.split()), _compiled(pattern), in_context))

    for label, name, keyword, identifiers, versions, address in FAMILIES:
        number = lambda v: re.escape(v) + ("" if "." in v else r"(?:\.0)?")
        under = r"(?:licen[cs]ed|distributed|released|available|provided|published) (?:\w+ ){0,3}?under (?:the (?:terms (?:and conditions )?of (?:the )?)?)?"
        said = ("licen",) if "licen" in name else ()
        if address:
            add(label, "address", 1, 1.0, (address.split("/")[0],), r"(?:https?://(?:www\.)?)?" + re.escape(address) + r"(?:[-/][0-9.]+)?")
        for v in versions:
            for i in identifiers:
                add(f"{label}-{v}", "identifier", 1, 1.0, ("spdx", i), rf"spdx licen[cs]e identifier {re.escape(i)}-{number(v)}(?:-only|-or-later|\+)?")
                after = rf"{_SEPARATOR}(?:v(?:ersion)?\.?\s*)?{number(v)}(?!\.[0-9])(?:-only|-or-later|\+)?"
                add(f"{label}-{v}", "short", 4, 0.7, (i, *(("licen",) if i in AMBIGUOUS else ())), re.escape(i) + after, i in AMBIGUOUS)
                if i == "apache":  # as SPDX writes it
                    add(f"{label}-{v}", "short", 4, 0.7, (f"{i}-{v}",), rf"{re.escape(f'{i}-{v}')}(?!\.[0-9])")
            add(f"{label}-{v}", "notice", 2, 1.0, ("under", keyword, *said), rf"{under}{name},? ?(?:v|version|v\.)? ?{number(v)}")
            add(f"{label}-{v}", "name", 3, 0.9, (keyword, *said), rf"{name},? ?(?:international|\()? ?(?:v|version|v\.)? ?{number(v)}")
        for i in identifiers:
            add(label, "identifier", 1, 1.0, ("spdx", i), rf"spdx licen[cs]e identifier {re.escape(i)}")
        add(label, "notice", 2, 0.9, ("under", keyword, *said), under + name)
        add(label, "name", 5, 0.8, (keyword, *said), name)
    return tuple(sorted(found, key=lambda r: r.priority))


@lru_cache(maxsize=1)
def _gates() -> tuple[tuple[bytes, ...], tuple[bytes, ...]]:
    """Every keyword; and the few stems of which each text with a hit of any rule holds one."""
    every = tuple(sorted({k for r in rules() for k in r.keywords}))
    return every, tuple(k for k in every if not any(o != k and o in k for o in every))


@lru_cache(maxsize=1)
def _base() -> tuple[tuple[bytes, re.Pattern, str], ...]:
    return tuple((p.split()[0].encode(), _compiled(p), label) for p, label in BASE_PHRASES.items())


def base_places(text: bytes) -> list[tuple[int, str]]:
    """(byte, label) of every base phrase in a lower-cased text."""
    return sorted((m.start(), label) for first, pattern, label in _base() if first in text for m in pattern.finditer(text))


def detect(text: bytes) -> list[tuple[int, int, Rule]]:
    """The hits that stay, of a lower-cased text, in page order."""
    every, stems = _gates()
    if not any(k in text for k in stems):
        return []
    present = {k for k in every if k in text}
    hits = [(m.start(), m.end(), r) for r in rules() if present.issuperset(r.keywords) for m in r.pattern.finditer(text)
            if not r.in_context or b"licen" in text[max(0, m.start() - CONTEXT) : m.end() + CONTEXT]]
    hits.sort(key=lambda h: (h[2].priority, h[0] - h[1], h[0], h[2].label))
    kept: list[tuple[int, int, Rule]] = []
    for start, end, rule in hits:
        if not any(s <= start and end <= e for s, e, _ in kept):
            kept.append((start, end, rule))
    return sorted(kept, key=lambda h: h[:2])


def scan(docs: DataFrame) -> DataFrame:
    """`(doc_id, n_words, base_starts, base_labels, labels, spans, score)` for every row of `docs(doc_id, text)`.

    base_starts: word numbers of the base phrases; spans: byte intervals of the accepted hits in the
    UTF-8 text; score: confidence of the best hit, 0.5 for a base phrase without one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(texts_of(batch), lower=True):
                start, _, first = words(chunk, _GAP)
                rows: list[tuple] = []
                whole = chunk.data.tobytes()
                for i in range(chunk.n):
                    at, end = chunk.at[i], chunk.at[i + 1]
                    text = whole[at:end]
                    places, hits = base_places(text), detect(text)
                    starts = (np.searchsorted(start, [at + p for p, _ in places]) - first[i]).tolist() if places else []
                    base = sorted({label for _, label in places})
                    rows.append((starts, base, sorted({*base, *(r.label for _, _, r in hits)}),
                                 [{"label": r.label, "start": s, "end": e, "rule": r.name} for s, e, r in hits],
                                 max([0.5 if base else 0.0, *(r.confidence for _, _, r in hits)])))
                kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()),
                         pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.string())])), pa.float64()]
                cells = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.record_batch([batch.column(0).slice(chunk.first, chunk.n), pa.array(np.diff(first), pa.int64()), *cells],
                                      names=["doc_id", "n_words", "base_starts", "base_labels", "labels", "spans", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
