"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read once, tag by tag, into blocks: runs of text between block-level tags, with the evidence
of the elements they stand in. A fixed linear classifier turns evidence into costs. Each block is a
node; its cost of being boilerplate is the capacity from the source, its cost of being content the
capacity to the sink. Edges of smoothness join neighbouring blocks and consecutive blocks of the same
parent. The cut of least capacity separates content (source side) from boilerplate.

Bad evidence holds for all that stands in an element, with exceptions, since wrappers of whole pages bear
names of what they hold. A layout word of a class or id counts in full where it begins or ends its name
('nav-links', 'cookie-notice'); elsewhere ('layout-sidebar-right', 'legal-text', 'header-and-content') it
counts only if the element holds little text or mostly links. No word counts for an element with most of
the page's text and few links. A nearer article, main or content element with much of the text of the
element that bears the word, and few links, ends it. Evidence of tags and roles is not ended.

Nodes whose terminal capacity exceeds all their edges are settled first, which leaves the minimum
cut unchanged; a maximum flow by shortest augmenting paths settles the rest.

Defined results: null or empty html, and pages without content, give an empty text; broken markup is
read on: unclosed elements end with the page or where a block of their kind begins, unclosed comments
and scripts reach to the end, quotes that are not a value's or not closed are plain signs of their tag; pages of any length are read whole; repeated rows are read one by one;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Kinds of elements.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video textarea select button option datalist title noembed noframes".split())
#: An opening tag ends open elements of these kinds, up to the nearest element that holds them.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
        "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
# Evidence of elements, by tag and role, and by words of class and id.
TAG_EVIDENCE = {"head": -9.0, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "dialog": -6.0, "menu": -6.0, "label": -6.0, "header": -3.0,
                "article": 3.0, "main": 2.0}
ROLE_EVIDENCE = {"navigation": -6.0, "banner": -6.0, "contentinfo": -6.0, "complementary": -6.0, "search": -6.0, "form": -6.0, "dialog": -6.0,
                 "alert": -6.0, "menu": -6.0, "menubar": -6.0, "main": 2.0, "article": 3.0}
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo promotion menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer sidebar cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist discussion disqus "
    "respond reply replies share sharing social related recommended recommendations subscribe subscription newsletter signup login search widget widgets "
    "toolbar pagination pager copyright legal disclaimer skip teaser".split())
GOOD_WORDS = frozenset("article content main post entry story text body page".split())
#: Elements of these names end the bad words around them; names with these parts are of wrappers.
CONTENT_WORDS = frozenset("article content main post entry story".split())
CONNECTING, WRAPPING = frozenset("with has no without and or for".split()), frozenset("layout template theme".split())
BAD, GOOD = -6.0, 1.5
#: Characters that are little text, share of links that is much, shares of the page's and of a bad element's text that are much.
LITTLE, MOSTLY_LINKS, OF_PAGE, OF_ELEMENT = 250, 0.4, 0.75, 0.5
BLOCK_EVIDENCE = {"p": 1.0, "h1": 1.5, "h2": 0.8, "h3": 0.8, "h4": 0.8, "h5": 0.8, "h6": 0.8, "pre": 1.0, "blockquote": 1.0, "li": -0.2}
PER_CHARACTER, MOST_LENGTH, OFFSET, LINKS, SENTENCE, RIGHTS = 1 / 80, 2.0, -0.6, -4.0, 0.5, -3.0
NEAR, NEAR_OTHER_PARENT, SIBLING = 0.8, 0.5, 0.4

# An attribute: name, then a value in quotes, which only open directly after "=" and only if they are closed, or without.
_NAME, _VALUE = r"""[^\s/>][^\s/>=]*+""", r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)?+"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|{_NAME}(?:{_VALUE})?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(rf"""({_NAME})({_VALUE})?+""")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@dataclass(slots=True)
class Element:
    tag: str
    number: int
    link: bool
    dropped: bool
    inside: bool  # of an article or main part
    up: Element | None = None
    block: Element | None = None  # the nearest block element, itself included
    own_bad: float = 0.0  # by tag and role
    own_good: float = 0.0
    word: int = 0  # of a bad word: FIRM or LOOSE
    content: bool = False
    text: int = 0  # characters, and those in links, with all elements inside
    links: int = 0
    # with the elements around: evidence by tags and roles, the outermost element whose bad word holds, good evidence
    bad: float = 0.0
    bad_word: Element | None = None
    good: float = 0.0


FIRM, LOOSE = 2, 1


@dataclass(slots=True)
class Block:
    text: str
    evidence: float
    parent: int


def _name_word(token: str) -> int:
    """FIRM, LOOSE, or 0 without a bad word."""
    if token.startswith(("has-", "with-", "no-")):
        return 0
    parts = re.split(r"[-_:.]+|(?<=[a-z])(?=\d)", token)
    if BAD_WORDS.isdisjoint(parts):
        return 0
    named = [x for x in parts if x and not x.isdigit()]
    ends = BAD_WORDS.intersection((named[0], named[-1]))
    return FIRM if ends and named[-1] not in GOOD_WORDS and (CONNECTING | WRAPPING).isdisjoint(named) else LOOSE


def _read_evidence(e: Element, attributes: str) -> bool:
    """Sets the own evidence of an element; whether it is hidden."""
    own, hidden = TAG_EVIDENCE.get(e.tag, 0.0), False
    if e.tag == "header" and e.up.inside:
        own = -1.0  # the head of an article, not of the page
    e.own_bad, e.own_good, e.content = min(0.0, own), max(0.0, own), e.tag in ("article", "main")
    if attributes and e.tag not in ("html", "body"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.lstrip()[1:].strip().lower()
            if value[:1] in ("'", '"') and value[-1:] == value[:1]:
                value = value[1:-1]
            if name in ("class", "id"):
                for token in value.split():
                    word = _name_word(token)
                    e.word = max(e.word, word)
                    parts = re.split(r"[-_:.]+|(?<=[a-z])(?=\d)", token)
                    if not word and not token.startswith(("has-", "with-", "no-")) and not GOOD_WORDS.isdisjoint(parts):
                        e.own_good = max(e.own_good, GOOD)
                        e.content = e.content or not CONTENT_WORDS.isdisjoint(parts)
            elif name == "role":
                found = ROLE_EVIDENCE.get(value.strip(), 0.0)
                e.own_bad, e.own_good, e.content = min(e.own_bad, found), max(e.own_good, found), e.content or found > 0
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    return hidden


def _settle_evidence(elements: list[Element]) -> None:
    """Text of every element, then the evidence that holds in it; elements come after those around them."""
    for e in reversed(elements[1:]):
        e.up.text += e.text
        e.up.links += e.links
    page = elements[0].text
    for e in elements[1:]:
        up, few_links = e.up, e.links <= MOSTLY_LINKS * e.text
        e.bad, e.good, e.bad_word = min(up.bad, e.own_bad), max(up.good, e.own_good), up.bad_word
        if e.bad_word and e.content and not e.word and few_links and e.text > LITTLE and e.text >= OF_ELEMENT * e.bad_word.text:
            e.bad_word = None
        if e.word and not (few_links and e.text > LITTLE and (e.word == LOOSE or e.text >= OF_PAGE * page)):
            e.bad_word = e.bad_word or e


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order."""
    stack = [Element("", 0, False, False, False)]
    stack[0].block = stack[0]
    elements = [stack[0]]
    found_blocks: list[tuple[str, float, Element]] = []
    places: dict[str, list[int]] = {}  # of the open elements of a tag
    pieces: list[str] = []
    linked = [0]
    number = 0

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                own = stack[-1].block
                found_blocks.append((text, min(1.0, linked[0] / len(text)), own))
            pieces.clear()
        linked[0] = 0

    def say(text: str) -> None:
        if text and not stack[-1].dropped:
            pieces.append(text)
            length = len(text.strip())
            stack[-1].text += length
            if stack[-1].link:
                linked[0] += length
                stack[-1].links += length

    def close(k: int) -> None:
        if any(e.tag in BLOCK_TAGS for e in stack[k:]):
            flush()
        for e in stack[k:]:
            places[e.tag].pop()
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if places.get(tag):
                close(places[tag][-1])
            elif tag in BLOCK_TAGS:
                flush()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK_TAGS:
            # an open paragraph ends at the next block, other kinds at one of their own kind
            if stack[-1].block.tag == "p":
                close(places["p"][-1])
            flush()
            if tag == "body" and places.get("head"):
                close(places["head"][0])
        if tag in ENDS:
            kinds, holders = ENDS[tag]
            inner = max((places[k][-1] for k in kinds.split() if places.get(k)), default=0)
            if inner > max((places[k][-1] for k in holders if places.get(k)), default=0):
                close(inner)
        if tag in VOID_TAGS:
            continue
        up = stack[-1]
        number += 1
        own = Element(tag, number, up.link or tag == "a", up.dropped or tag in DROPPED_TAGS, up.inside or tag in ("article", "main"), up, up.block)
        own.dropped = _read_evidence(own, found[3]) or own.dropped
        stack.append(own)
        elements.append(own)
        if tag in BLOCK_TAGS:
            stack[-1].block = stack[-1]
        places.setdefault(tag, []).append(len(stack) - 1)
        if found[3].endswith("/") and tag in ("svg", "math", "path", "use"):
            close(len(stack) - 1)
        elif tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else n
    flush()
    _settle_evidence(elements)
    return [Block(text, _score(text, links, own), own.number) for text, links, own in found_blocks]


def _score(text: str, links: float, own: Element) -> float:
    """Evidence that a block is content."""
    score = min(own.bad, BAD if own.bad_word else 0.0) + own.good + BLOCK_EVIDENCE.get(own.tag, 0.0) + OFFSET + min(MOST_LENGTH, len(text) * PER_CHARACTER) + LINKS * links * links
    if text[-1] in ".!?…:;\"»”":
        score += SENTENCE
    if "©" in text and not own.inside:
        score += RIGHTS
    return score


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges (earlier block, later block, capacity)."""
    out = [(i, i + 1, NEAR if a.parent == b.parent else NEAR_OTHER_PARENT) for i, (a, b) in enumerate(zip(found, found[1:]))]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.parent in last:
            out.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return out


def minimum_cut(evidence: list[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source. evidence: source capacity if positive, else sink capacity."""
    n = len(evidence)
    terminal = list(evidence)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in joined:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(terminal[i]) >= sum(near[i].values()):
            side[i] = terminal[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                terminal[j] += c if side[i] else -c
                todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i in _flow(rest, terminal, near):
            side[i] = True
    return [bool(x) for x in side]


def _flow(rest: list[int], terminal: list[float], near: list[dict[int, float]]) -> list[int]:
    """Nodes that the source still reaches after a maximum flow."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
    room[source] = {i: terminal[i] for i in rest if terminal[i] > 0}
    room[sink] = {}
    for i in rest:
        if terminal[i] < 0:
            room[i][sink] = -terminal[i]
    while True:
        came: dict[int, int] = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            return [i for i in came if i >= 0]
        path = [sink]
        while path[-1] != source:
            path.append(came[path[-1]])
        least = min(room[b][a] for a, b in zip(path, path[1:]))
        for a, b in zip(path, path[1:]):
            room[b][a] -= least
            room[a][b] = room[a].get(b, 0.0) + least


def main_text(page: str) -> tuple[str, int, int]:
    """The text, the number of blocks, and how many of them are content."""
    found = blocks(page)
    content = minimum_cut([b.evidence for b in found], edges(found))
    kept = [b.text for b, c in zip(found, content) if c]
    return " ".join(kept), len(found), len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """`(page_id, url, text, n_chars, n_blocks, n_content)` for every row of `pages(page_id, url, html)`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [main_text(h) if h else ("", 0, 0) for h in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()),
                                       pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                                      names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_content long")
