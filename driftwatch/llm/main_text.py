"""Main text of web pages: blocks labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import small_batches

# Elements by their role in HTML.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "select", "title")
BLOCK = frozenset(
    "address article aside blockquote body br_ caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul video audio".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT_TAGS, BOILERPLATE_TAGS = frozenset(("article", "main")), frozenset("nav footer header aside form menu dialog button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph.
ENDS_P = BLOCK - {"br_", "body", "html"}
#: Names of classes and ids, in whole or as their first or last part: places in a page's layout, which wrappers bear too;
#: those that an article has of its own as well; and parts that are never an article's.
LAYOUT_NAMES = frozenset("breadcrumb breadcrumbs footer login menu modal nav navbar navigation pagination popup sidebar signup toolbar".split())
OPEN_NAMES = frozenset("banner header masthead related teaser widget widgets".split())
PART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising comment comments commentlist consent cookie cookies disqus gdpr newsletter notice notices promo promos promotion replies respond share sharing social sponsor sponsored sponsors subscribe".split()
)
CONTENT_NAMES = frozenset("article content entry main post story text body".split())
#: Parts that say how something is, not what it is: has-sidebar, nav-open.
QUALIFIERS = frozenset("has no with without not is js open opened closed on off enabled disabled active hidden visible".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

#: Costs of labelling against the classifier, in nats; smoothness of neighbours in the text and of neighbours in one element.
WEIGHTS = {"bias": -0.6, "content": 3.0, "boilerplate": -7.0, "layout": -3.5, "name": 1.5, "words": 0.45, "links": -4.0, "heading": 0.6, "sentence": 0.8, "rights": -3.0}
ADJACENT, SIBLING = 0.6, 0.5
#: A form or an element with a layout's name is the page's wrapper if it has so much of the text, and no more of it in links.
WRAPPER_TEXT, WRAPPER_LINKS = 0.6, 0.4

#: A tag without "<" in its attributes, as nearly all are; the start of any other; what may end one or begin a value.
_TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<attrs>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>")
_START = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)")
_STOP, _ANGLE = re.compile("[>\"']"), re.compile("[<>]")
_LONG_NUMBER = re.compile(r"&#[0-9]{20,};?")
_RAW_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"']++)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: What an element says of the text in it, and its number: content, name; boilerplate; form, layout and open, which may wrap the page.
Mark = tuple[str, int]


@dataclass
class Block:
    text: str
    links: int
    #: The nearest element around it, by number; what elements around it say: content, boilerplate, layout, name.
    parent: int
    hints: frozenset[str]
    heading: bool = False
    #: The elements that say so.
    marks: tuple[Mark, ...] = ()


@dataclass
class _Open:
    tag: str
    number: int
    #: The number of the nearest element around text that isn't a paragraph, list item or heading; whether there is a heading.
    own: int = 0
    heading: bool = False
    marks: tuple[Mark, ...] = ()


@lru_cache(65_536)
def named(names: str) -> str:
    """What the names of classes and ids say: part, layout, open, content, or nothing."""
    said = set()
    for name in names.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if not parts or QUALIFIERS.intersection(parts):
            continue
        ends = {parts[0], parts[-1]}
        if ends & PART_NAMES:
            said.add("part")
        elif ends & LAYOUT_NAMES:
            said.add("layout")
        elif ends & OPEN_NAMES and not (parts[-1] == "header" and CONTENT_NAMES.intersection(parts)):
            said.add("open")
        elif CONTENT_NAMES.intersection(parts):
            said.add("content")
    return next((x for x in ("part", "layout", "open", "content") if x in said), "")


def mark_of(tag: str, attrs: str, inside: tuple[Mark, ...]) -> str:
    """What an element says of its text: one kind of mark, or nothing. Attributes are read by name: a class called hidden hides nothing."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs) if attrs else ():
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    role = found.get("role", "").lower()
    said = named(f"{found.get('class', '')} {found.get('id', '')}") if "class" in found or "id" in found else ""
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _NO_DISPLAY.search(found.get("style", "")):
        return "boilerplate"
    if tag in ("body", "html"):
        return ""
    if said == "part":
        return "boilerplate"
    if tag in CONTENT_TAGS or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        return "content"
    if tag == "form":
        return "form"
    if tag in BOILERPLATE_TAGS and not (tag == "header" and any(kind == "content" for kind, _ in inside)) or role in BOILERPLATE_ROLES:
        return "boilerplate"
    return "name" if said == "content" else said


def judged(blocks: list[Block]) -> list[Block]:
    """blocks with the hints of their marks. A form or layout's name that wraps most of the page's text says nothing of it;
    an open name within content says less than one outside."""
    size, links = Counter(), Counter()
    for b in blocks:
        for kind, number in b.marks:
            if kind in ("form", "layout", "open"):
                size[number] += len(b.text)
                links[number] += b.links
    total = sum(len(b.text) for b in blocks)
    wraps = {number for number, n in size.items() if n >= WRAPPER_TEXT * total and links[number] <= WRAPPER_LINKS * n}
    for b in blocks:
        kinds = [kind for kind, number in b.marks if number not in wraps]
        says = {"form": "boilerplate", "layout": "boilerplate", "open": "layout" if "content" in kinds else "boilerplate"}
        b.hints = frozenset(says.get(kind, kind) for kind in kinds)
    return blocks


_INNER = frozenset("p li h1 h2 h3 h4 h5 h6".split())


def _after_raw(page: str, tag: str, at: int, last: dict[str, int]) -> int:
    """Where an element of RAW ends whose start tag ends at a place. Without an end tag a script or style goes on to the
    page's end, others are their tag alone; last keeps where the last end tag of each kind starts."""
    if tag not in ("script", "style"):
        if tag not in last:
            last[tag] = max((m.start() for m in _RAW_ENDS[tag].finditer(page)), default=-1)
        if last[tag] < at:
            return at
    m = _RAW_ENDS[tag].search(page, at)
    return m.end() if m else len(page)


def _close(page: str, at: int) -> int:
    """The place of the ">" that ends a tag, from a place in it; -1 if the page ends before. Only a value that begins with a quote hides one."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        if not page[at : m.start()].rstrip().endswith("="):
            at = m.end()
        elif (at := page.find(m[0], m.end()) + 1) == 0:
            return -1
    return -1


def _pieces(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """Text and tags in order, as (text, name, whether it is an end tag, attributes); a piece of text has no name.

    Each character is looked at a bounded number of times. Comments and raw elements are left out; an element of RAW
    comes as a tag without its content. Once a tag has no end, those after it end at the next angle bracket.
    """
    at, broken, last = 0, False, {}
    while (start := page.find("<", at)) >= 0:
        if start > at:
            yield page[at:start], "", False, ""
        if m := _TAG.match(page, start):
            end, name, attrs = m.end(), m["name"], m["attrs"]
        elif page.startswith("<!--", start):
            at = page.find("-->", start + 2) + 3
            if at == 2:
                return
            continue
        elif page.startswith(("<!", "<?"), start):
            at = page.find(">", start) + 1
            if not at:
                return
            continue
        elif m := _START.match(page, start):
            close = -1 if broken else _close(page, m.end())
            if close >= 0:
                end = close + 1
            else:
                broken = True
                stop = _ANGLE.search(page, m.end())
                if stop is None:  # the page's end cuts the tag off
                    return
                close = stop.start()
                end = close + (stop[0] == ">")
            name, attrs = m["name"], page[m.end() : close]
        else:
            yield "<", "", False, ""
            at = start + 1
            continue
        name, at = name.lower(), end
        if name in _RAW_ENDS and not m["end"]:
            at = _after_raw(page, name, end, last)
        yield "", name, bool(m["end"]), attrs
    if at < len(page):
        yield page[at:], "", False, ""


def _plain(parts: list[str]) -> str:
    """Parts of a block as one text: references decoded, white space as single spaces."""
    text = "".join(parts)
    try:
        text = entities.unescape(text)
    except ValueError:  # a number of thousands of digits
        text = entities.unescape(_LONG_NUMBER.sub("\ufffd", text))
    return " ".join(text.split())


def blocks_of(page: str | None) -> list[Block]:
    """Text between the tags of block elements, in order. Unclosed elements end where their parent does."""
    out: list[Block] = []
    stack = [_Open("html", 0)]
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    in_link, number = False, 0
    head: tuple[int, int] | None = None  # lengths of parts and linked where a head starts

    def flush() -> None:
        text = _plain(parts)
        if text:
            links = len(_plain(linked))
            top = stack[-1]
            out.append(Block(text, min(links, len(text)), top.own, frozenset(), top.heading, top.marks))
        parts.clear()
        linked.clear()

    def pop() -> None:
        open_tags[stack.pop().tag] -= 1

    for text, tag, is_end, attrs in _pieces(page or ""):
        if not tag:
            parts.append(text)
            if in_link:
                linked.append(text)
            continue
        if tag in _RAW_ENDS or tag == "br":
            parts.append(" ")
        elif tag == "head":
            if not is_end:
                head = len(parts), len(linked)
            elif head is not None:  # its text is dropped; without an end tag, text ends a head
                del parts[head[0] :], linked[head[1] :]
                head = None
            parts.append(" ")
        elif tag == "a":
            in_link = not is_end
        if tag not in BLOCK and tag not in BOILERPLATE_TAGS:
            continue
        flush()
        in_link, head = False, None
        if is_end:
            if open_tags[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P and stack[-1].tag == "p":
            pop()
        if tag == "li" and stack[-1].tag == "li":
            pop()
        around = stack[-1]
        marks, kind = around.marks, mark_of(tag, attrs, around.marks)
        if kind in ("content", "name"):  # what forms and layouts' names around it said of wrappers
            marks = tuple(m for m in marks if m[0] != "form" and (m[0] not in ("layout", "open") or kind == "name"))
        if kind:
            marks = (*marks, (kind, number + 1))
        number += 1
        own = around.own if tag in _INNER else number
        stack.append(_Open(tag, number, own, around.heading or tag in HEADINGS, marks))
        open_tags[tag] += 1
    flush()
    return judged(out)


def leaning(block: Block) -> float:
    """The classifier: log odds that a block is content."""
    words = len(block.text.split())
    x = WEIGHTS["bias"] + sum(WEIGHTS[h] for h in block.hints)
    x += WEIGHTS["words"] * min(8.0, math.log1p(words)) + WEIGHTS["links"] * block.links / len(block.text)
    x += WEIGHTS["heading"] * block.heading + WEIGHTS["sentence"] * (words > 3 and block.text[-1] in ".!?…\"”'»")
    return x + WEIGHTS["rights"] * (block.text[0] in "©®" or block.text[:9].lower() == "copyright")


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut: shortest augmenting paths, level by level."""
    n = len(source)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def add(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(forth)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for k in range(n):
        if (both := min(source[k], sink[k])) < source[k]:
            add(s, k, source[k] - both, 0.0)
        elif both < sink[k]:
            add(k, t, sink[k] - both, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in graph[x]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        nth = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                keep = next(k for k, e in enumerate(path) if room[e] <= tiny)
                x = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while nth[x] < len(graph[x]):
                e = graph[x][nth[x]]
                if room[e] > tiny and level[to[e]] == level[x] + 1:
                    break
                nth[x] += 1
            if nth[x] < len(graph[x]):
                path.append(graph[x][nth[x]])
                x = to[path[-1]]
            elif path:
                x = to[path.pop() ^ 1]
                nth[x] += 1
            else:
                break


def main_text(page: str | None) -> str:
    """The blocks that the cut leaves with the content, one a line; empty if there are none."""
    blocks = blocks_of(page)
    odds = [leaning(b) for b in blocks]
    if all(x > 0 for x in odds):
        return "\n".join(b.text for b in blocks)
    edges, seen = [], {}
    for k, b in enumerate(blocks):
        if k:
            edges.append((k - 1, k, ADJACENT))
        if b.parent in seen:
            edges.append((seen[b.parent], k, SIBLING))
        seen[b.parent] = k
    kept = min_cut([max(x, 0.0) for x in odds], [max(-x, 0.0) for x in odds], edges)
    return "\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each row of pages.

    Each row is judged alone, from its whole html: repeated rows give repeated results, null ids and urls stay null, a
    null html is empty, other columns are ignored, an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
