"""Main text of web pages by two passes of block rules.

Pass one reads a page's blocks (runs of text between block-level tags) and
decides the clear ones by structure, link density, length and stop-word
density; what only a wrapper's name or a form marks as not the article is
decided so too where the wrapper holds the page's prose. Article elements decide
where they hold the page's prose; where they are but cards beside it, they go. Sections
of reader comments are known by their build: siblings of one kind, each with an author or a date. Where a
page's prose holds none of the stop words, it is in another language, and
length and link density decide alone. Pass two gives every undecided block,
short ones mostly, the label of the nearest decided neighbours.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import fresh_name, prepare_workers, text_of

#: Fixed values of HTML: elements that hold characters only, up to their end tag; elements whose content is markup but
#: not text; elements without an end tag; inline elements.
RAW = "script style noscript iframe textarea title".split()
FOREIGN = {"svg", "math"}
SKIPPED = FOREIGN | set("template object canvas audio video select".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Elements, roles and words of class or id that mark what is not the article, and those that mark the article.
ASIDE_TAGS = set("nav footer aside button dialog menu fieldset".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted nav navbar "
    "navigation menu menus breadcrumb breadcrumbs footer sidebar aside cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments commentlist disqus replies form pagination pager widget toolbar masthead "
    "skip banner copyright disclaimer".split()
)
MAIN_TAGS = {"article", "main"}
MAIN_WORDS = set("article articlebody content post entry story main maincontent body-text posttext".split())

#: Words of class, rel or itemprop that mark an author or a date.
BYLINE_WORDS = set(
    "author byline date datetime datepublished published time timestamp posted user username commenter avatar permalink".split()
)
#: Elements that may be one of several like-built ones.
REPEATED_TAGS = set("li article div section blockquote dd tr details".split())

#: Common words of the languages served; a share of them marks running prose.
STOP_WORDS = frozenset(
    (
        "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they "
        "which one you were all their there been if more when will would who so no what up out about into than them "
        "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
        "dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis "
        "le la les de des et en un une du que est pour qui dans par plus pas au sur ne se ce il sont avec son aux ou "
        "mais comme nous sa elle cette été "
        "el los las y del se por con para una su al lo como más pero sus o este ha si porque esta entre cuando muy sin "
        "sobre también hasta hay donde quien desde todo"
    ).split()
)

#: Characters under which a block is short and from which it is long; stop-word and link shares.
SHORT, LONG, STOPS_LOW, STOPS_HIGH, LINKS = 70, 200, 0.08, 0.2, 0.5

_COMMENT_END = re.compile(r"--!?>")
_RAW_START = re.compile(r"(%s)(?=[\s/>])" % "|".join(RAW), re.I)
_RAW_END = {raw: re.compile(rf"</{raw}(?=[\s/>])[^>]*>", re.I) for raw in RAW}
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: What may end a tag, or begin a quoted value that may hold the same.
_SPECIAL = re.compile(r"[>\"']")
_MARK = re.compile(r"""\b(class|id|role|itemprop|hidden|rel)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    aside: bool
    main: int  # number of the innermost article element, 0 outside
    prose: bool  # a paragraph or heading
    wrapper: int  # number of the innermost wrapper, 0 outside
    element: int  # number of the innermost element, 0 outside
    label: bool | None = None

    def __post_init__(self):
        words = _WORD.findall(self.text.lower())
        self.stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        self.worded = 2 * sum(map(len, words)) >= len(self.text.replace(" ", ""))  # letters mostly

    @property
    def prose_like(self) -> bool:
        """A long block that is not the text of links."""
        return not self.aside and len(self.text) >= SHORT and self.linked <= LINKS * len(self.text.replace(" ", ""))


@dataclass
class Element:
    """A block-level element, for finding like-built siblings."""

    parent: int
    kind: tuple[str, str]  # tag and class
    byline: bool = False  # an author or a date inside
    held: int = 0  # characters of prose inside


#: How sure a wrapper is not the article: one word of a name among others; a form; a whole name.
PART, FORM, WHOLE = 1, 2, 3


@dataclass
class Wrapper:
    """An element that is not the article by its name, or for being a form."""

    kind: int
    outer: int  # number of the wrapper around it, 0 outside
    main: int  # number of the article element around it, 0 outside
    held: int = 0  # characters of prose inside


@dataclass
class Main:
    """An article element."""

    wrapper: int  # number of the wrapper around it, 0 outside
    sure: bool  # by its own tag <main> or role, or in no wrapper
    root: bool = False  # by its own tag <main> or role
    held: int = 0  # characters of prose inside


def _kind(tag: str, marks: list[tuple[str, str]], in_main: bool) -> tuple[bool, int, bool, bool]:
    """(not the article, kind of wrapper or 0, the article, surely so) by an element's name, role and words of class or id."""
    aside = tag in ASIDE_TAGS or (tag == "header" and not in_main) or (tag == "form" and in_main)
    wrapper = FORM if tag == "form" and not in_main else 0
    main = tag in MAIN_TAGS
    sure = tag == "main"
    for name, value in marks:
        name = name.lower()
        value = value.lower()
        words = re.split(r"[^a-z0-9]+", value)
        if name == "hidden" and not value:
            aside = True
        elif name == "rel":
            continue
        elif name == "role":
            aside |= any(w in ASIDE_ROLES for w in words)
            main |= "main" in words
            sure |= "main" in words
        else:
            for whole in value.strip("\"'").split():
                marks = [w in ASIDE_WORDS for w in re.split(r"[^a-z0-9]+", whole) if w]
                if any(marks):
                    wrapper = max(wrapper, WHOLE if all(marks) else PART)
            main |= any(w in MAIN_WORDS for w in words)
    if tag in ("body", "html"):
        return False, 0, False, False
    return aside, wrapper, main and not aside and tag != "p" and (sure or not wrapper), sure


def _build(marks: list[tuple[str, str]]) -> tuple[str, bool]:
    """An element's class, without numbers, since they tell like-built elements apart; and whether class, rel or
    itemprop name an author or a date."""
    own, byline = "", False
    for name, value in marks:
        name, value = name.lower(), value.lower()
        if name == "class" and not own:
            own = re.sub(r"[0-9]+", "", value.strip("\"'"))
        if name in ("class", "rel", "itemprop"):
            byline |= not BYLINE_WORDS.isdisjoint(re.split(r"[^a-z]+", value))
    return own, byline


@dataclass
class Open:
    """An open element with what it passes on to the blocks inside."""

    tag: str
    aside: bool = False
    main: int = 0
    prose: bool = False
    link: bool = False
    wrapper: int = 0
    element: int = 0


#: Elements that end an open one of their own kind, and headings.
SIBLINGS = set("p li td th tr dt dd option".split())
HEADINGS = {f"h{k}" for k in range(1, 7)}


class _Reader:
    """Collects blocks while tags open and close; unclosed and misnested tags end with their container."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack = [Open("")]
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.mains = [Main(0, False)]
        self.wrappers = [Wrapper(0, 0, 0)]
        self.elements = [Element(0, ("", ""))]

    def text(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            self.parts.append(text)
            if self.stack[-1].link:
                self.linked += len("".join(text.split()))

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1]
            self.blocks.append(Block(text, self.linked, top.aside, top.main, top.prose, top.wrapper, top.element))
        self.parts.clear()
        self.linked = 0

    def _cut(self, k: int) -> None:
        self.open.subtract(e.tag for e in self.stack[k:])
        del self.stack[k:]

    def end(self, tag: str) -> None:
        if self.open[tag] > 0:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    return self._cut(k)
                if tag in INLINE and self.stack[k].tag not in INLINE:
                    return

    def start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:  # what it ends: an open paragraph, or one of its own kind
            k = len(self.stack) - 1
            while k and self.stack[k].tag in INLINE:
                k -= 1
            last = self.stack[k].tag
            if k and (last == "p" or last in HEADINGS and tag in HEADINGS or last == tag and tag in SIBLINGS):
                self._cut(k)
        top = self.stack[-1]
        marks = _MARK.findall(attributes) if attributes else []
        own, byline = _build(marks) if marks else ("", False)
        off, kind, on, sure = _kind(tag, marks, bool(top.main))
        main, wrapper = top.main, top.wrapper
        if on and not top.aside and not main:
            self.mains.append(Main(wrapper, sure or not wrapper, sure))
            main = len(self.mains) - 1
        elif kind and not top.aside and not off:
            self.wrappers.append(Wrapper(kind, wrapper, main))
            wrapper = len(self.wrappers) - 1
        prose = top.prose or tag == "p" or tag in HEADINGS
        element = top.element
        if tag not in INLINE:
            self.elements.append(Element(element, (tag, own)))
            element = len(self.elements) - 1
        if tag == "time" or byline:
            self.elements[element].byline = True
        self.stack.append(Open(tag, top.aside or off, main, prose, top.link or tag == "a", wrapper, element))
        self.open[tag] += 1


class _Ends:
    """Where tags of a page end. No character is gone over again after a tag that has no end: a scan that reaches a
    place from which none was found stops there, so all tags together take time in proportion to the page."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.dead: set[int] = set()

    def quoted(self, at: int) -> int:
        """The first ``>`` outside quotes from ``at`` on; -1 if there is none, or a quote has no partner."""
        page, dead, seen = self.page, self.dead, []
        while m := _SPECIAL.search(page, at):
            k = m.start()
            if page[k] == ">":
                return k
            if k in dead:
                break
            seen.append(k)
            at = page.find(page[k], k + 1) + 1
            if not at:
                break
        dead.update(seen)
        return -1

    def of(self, at: int) -> int:
        """The end of a tag whose attributes begin at ``at``: outside quotes, else the next ``>``; -1 without any."""
        if at > self.last:
            return -1
        end = self.quoted(at)
        return end if end >= 0 else self.page.find(">", at)


def _tags(page: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, "/" of an end tag, name, attributes) of what is not text, in page order; comments have neither name
    nor attributes, raw elements only their own name and stand for all they hold."""
    out = []
    foreign = 0  # svg and math elements open
    ends = _Ends(page)
    endless: set[str] = set()  # raw elements without an end tag from here on
    start = page.find("<")
    while start >= 0:
        at = start + 1  # without a tag here, what follows is looked at
        if page.startswith("<!--", start):
            short = page[start + 4 : start + 6]
            if short.startswith(">") or short == "->":
                at = start + 4 + short.index(">") + 1
            else:
                m = _COMMENT_END.search(page, start + 4)
                at = m.end() if m else len(page)
            out.append((start, at, "", "", ""))
        elif page.startswith(("!", "?"), at):
            end = page.find(">", at) if at <= ends.last else -1
            if end >= 0:
                out.append((start, end + 1, "", "", ""))
                at = end + 1
        elif (m := _RAW_START.match(page, at)) and (end := ends.of(m.end())) >= 0:
            raw = m[1].lower()
            closed = None if raw in endless else _RAW_END[raw].search(page, end + 1)
            if not closed:
                endless.add(raw)
            at = closed.end() if closed else len(page)
            if foreign and page[end - 1] == "/":  # only there a raw element can be closed so
                at = end + 1
            out.append((start, at, "", raw, ""))
        elif at <= ends.last and (m := _NAME.match(page, at)) and (end := ends.of(m.end())) >= 0:
            tag, attributes = m[2].lower(), page[m.end() : end]
            if tag in FOREIGN:
                foreign = max(0, foreign - 1) if m[1] else foreign + (not attributes.endswith("/"))
            out.append((start, end + 1, m[1], tag, attributes))
            at = end + 1
        start = page.find("<", at)
    return out


def _skips(tags: list[tuple[int, int, str, str, str]]) -> dict[int, int]:
    """The elements without text that their own end tag closes inside their container: place of start and end tag."""
    out: dict[int, int] = {}
    if not any(t[3] in SKIPPED for t in tags):
        return out
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    for k, (_, _, closing, tag, attributes) in enumerate(tags):
        if not tag or tag in INLINE or tag in VOID or tag in RAW:
            continue
        if not closing:
            if not attributes.endswith("/") or tag in SKIPPED - FOREIGN:
                stack.append((tag, k))
                opened[tag] += 1
            continue
        while opened[tag]:
            name, start = stack.pop()
            opened[name] -= 1
            if name == tag:
                if tag in SKIPPED:
                    out[start] = k
                break
    return out


def blocks(page: str) -> list[Block]:
    """The page's blocks in order."""
    reader = _Reader()
    tags = _tags(page)
    skips = _skips(tags)
    at = last = 0
    for k, (start, end, closing, tag, attributes) in enumerate(tags):
        if k < last:  # inside an element without text
            continue
        reader.text(page[at:start])
        at = end
        if not tag:
            continue
        if tag in SKIPPED or (tag in RAW and not closing):
            reader.text(" ")
            if k in skips:
                last = skips[k] + 1
                at = tags[skips[k]][1]
            continue
        if tag not in INLINE:
            reader.flush()
        if closing:
            reader.end(tag)
        elif tag not in VOID and not attributes.endswith("/"):
            reader.start(tag, attributes)
    reader.text(page[at:])
    reader.flush()
    responses(reader.blocks, reader.elements)
    settle(reader.blocks, reader.wrappers, reader.mains)
    return reader.blocks


def responses(found: list[Block], elements: list[Element]) -> None:
    """Mark sections of reader comments as not the article.

    Such a section has siblings of one tag and class, two at least, each with an author or a date inside; and
    the prose before the first of them, in the element that holds the section's parent at the latest, is longer than that of any of them. An article's parts with
    dates of their own (a log of events) have no such prose before them.
    """
    if sum(e.byline for e in elements) < 2:
        return
    for e in reversed(elements[1:]):
        elements[e.parent].byline |= e.byline
    for b in found:
        if b.prose_like:
            elements[b.element].held += len(b.text)
    for e in reversed(elements[1:]):
        elements[e.parent].held += e.held
    alike: dict[tuple, list[int]] = defaultdict(list)
    for k, e in enumerate(elements[1:], 1):
        if e.kind[0] in REPEATED_TAGS:
            alike[e.parent, e.kind].append(k)
    first_of: dict[int, int] = {}
    for (parent, _), siblings in alike.items():
        if len(siblings) > 1 and all(elements[k].byline for k in siblings):
            first_of[siblings[0]] = max(elements[k].held for k in siblings)
    if not first_of:
        return
    # prose before each first sibling, block by block: elements are numbered in page order
    before, total, at = {}, 0, 0
    for k in sorted(first_of):
        while at < len(found) and found[at].element < k:
            total += len(found[at].text) if found[at].prose_like else 0
            at += 1
        before[k] = total
    off = set()
    for (parent, _), siblings in alike.items():
        if siblings[0] in first_of and before[siblings[0]] > first_of[siblings[0]]:
            off.update(siblings)
            # what is around them goes too, with headings and forms, as far as it holds no other prose
            theirs = sum(elements[k].held for k in siblings)
            while parent and elements[parent].held == theirs:
                off.add(parent)
                parent = elements[parent].parent
    inside = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        inside[k] = k in off or inside[e.parent]
    for b in found:
        b.aside |= inside[b.element]


def settle(found: list[Block], wrappers: list[Wrapper], mains: list[Main]) -> None:
    """Decide which wrappers and which article elements count, by the prose they hold."""
    served = _served(found)
    total = 0
    for b in found:
        if b.prose_like and _reads(b, served):
            total += len(b.text)
            wrappers[b.wrapper].held += len(b.text)
            mains[b.main].held += len(b.text)
    if len(wrappers) > 1:
        _settle_wrappers(found, wrappers, mains, total)
    # article elements that are but cards beside the page's prose: several, or with a title that is a link
    outside = inside = 0
    linked = set()
    for b in found:
        if not b.aside and b.main:
            inside += len(b.text)
            if b.linked > LINKS * len(b.text.replace(" ", "")):
                linked.add(b.main)
        elif b.prose_like and not b.wrapper and _reads(b, served):
            outside += len(b.text)
    held = {b.main for b in found if b.main and not b.aside}
    if outside > inside and (len(held) > 1 or linked) and not any(m.root for m in mains):
        for b in found:
            b.aside |= bool(b.main)


def _served(found: list[Block]) -> bool:
    """Whether the stop words are those of the page's language: most of its prose, or any where there are no paragraphs, holds them."""
    long = [b for b in found if b.prose_like and b.worded]
    marked = [b for b in long if b.prose] or long
    with_stops = sum(len(b.text) for b in marked if b.stops >= STOPS_LOW)
    return not long or 2 * with_stops >= sum(len(b.text) for b in marked)


def _reads(b: Block, served: bool) -> bool:
    """Whether a long block is running prose: by its stop words, in other languages by being words."""
    return b.stops >= STOPS_LOW or (not served and b.worded)


def _settle_wrappers(found: list[Block], wrappers: list[Wrapper], mains: list[Main], total: int) -> None:
    for w in reversed(wrappers[1:]):
        wrappers[w.outer].held += w.held
    # article elements in wrappers: if there are no others, and the page's prose is theirs
    others = [m for m in mains[1:] if not m.sure]
    if not any(m.sure for m in mains) and 2 * sum(m.held for m in others) >= total:
        for m in others:
            m.sure = True
    off = [False]
    for w in wrappers[1:]:
        inside = bool(w.main) and mains[w.main].sure
        if w.kind == PART:
            stays = not w.held
        elif inside:
            stays = not w.held or w.held < mains[w.main].held
        else:
            stays = 2 * w.held <= total
        around = off[w.outer] and not (inside and not wrappers[w.outer].main)
        off.append(stays or around)
    for b in found:
        m = mains[b.main]
        if b.main and m.sure:
            b.aside |= b.wrapper != m.wrapper and off[b.wrapper]
        else:
            b.main = 0
            b.aside |= off[b.wrapper]


def classify(found: list[Block]) -> None:
    """Label every block: True for the article."""
    has_main = any(b.main and not b.aside for b in found)
    served = _served(found)
    for b in found:  # pass one: what is clear
        solid = len(b.text.replace(" ", ""))
        if b.aside or (has_main and not b.main):
            b.label = False
        elif b.linked > LINKS * max(1, solid):
            b.label = False
        elif len(b.text) >= LONG and b.stops >= STOPS_HIGH:
            b.label = True
        elif len(b.text) >= SHORT and _reads(b, served):
            b.label = True
        elif len(b.text) >= SHORT and not b.main:
            b.label = False
    decided: dict[int, list[int]] = defaultdict(list)
    for i, b in enumerate(found):
        if b.label is not None and not b.aside:
            decided[b.main].append(i)
    for i, b in enumerate(found):  # pass two: neighbours of the same article, the nearer first, ties to keeping
        if b.label is None:
            known = decided[b.main]
            k = bisect.bisect(known, i)
            near = [(abs(i - j), not found[j].label) for j in known[max(0, k - 1) : k + 1]]
            b.label = not min(near)[1] if near else bool(b.main or b.prose)


def extract(page: str) -> str:
    """The main text: the article's blocks in page order, joined by one space; empty if there are none."""
    found = blocks(page)
    classify(found)
    return " ".join(b.text for b in found if b.label)


def with_main_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> tuple[DataFrame, str]:
    """``pages`` with a column of extracted main text, and that column's name.

    Null and empty html give the empty text. Rows, repeated ones too, and all
    other columns stay as they are; if a column named ``out`` exists, the new
    one gets underscores in front. Pages are read whole, whatever their length.
    """
    prepare_workers(pages.sparkSession)
    name = fresh_name(out, pages.columns)

    @F.arrow_udf("string")
    def main_text(column: pa.Array) -> pa.Array:
        return pa.array([extract(p) for p in column.to_pylist()], pa.string())

    return pages.withColumn(name, main_text(text_of(html_col))), name
