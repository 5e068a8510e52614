"""Leaf blocks of a page: runs of text between block tags, with what encloses them."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

#: Elements whose content a page never shows as text: code, styles, inert or fallback markup, drawings, framed pages.
#: Those of ``_RUNS_ON`` run to the end of the page where nothing closes them.
_SKIPPED = frozenset("script style template svg iframe canvas".split())
_RUNS_ON = frozenset(("script", "style"))
#: What may open markup. A ``<`` before anything else is text.
_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][\w:-]*)|[!?/])")
_STOP = re.compile("[>\"']")
_END = re.compile(rf"</({'|'.join(sorted(_SKIPPED))})(?=[\s/>])", re.I)
#: A slash at the end of a bare value belongs to the value and closes nothing.
_BARE = re.compile(r"=\s*[^\s\"'>]+/\Z")
#: Tags that part blocks.
BLOCKS = frozenset("""
html head body title main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody
tfoot tr td th form fieldset legend label select option optgroup textarea button blockquote pre figure figcaption address details summary
dialog menu center hr video audio map noframes search hgroup noscript object
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of this kind ends an open one of those kinds, unless one of the walls is between.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WALLS = frozenset("ul ol dl table article section main body html div nav aside header footer form blockquote td th".split())
_ENDS_P = BLOCKS - frozenset("p li td th tr dt dd option html head body title label button noscript object".split())
#: Attributes that name the role of an element.
_ROLE = re.compile(r"\b(class|id|role|itemprop|data-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Words in names that tell what an element is for.
GOOD_NAME = re.compile(r"\b(?:article|content|entry|main|post|story|text|body|articlebody)\b")
BAD_NAME = re.compile(
    r"\b(?:ads?|advert\w*|banner|breadcrumbs?|comments?|complementary|contentinfo|cookies?|copyright|footer|header|legal|login|masthead|"
    r"menu|modal|nav|navigation|newsletter|notice|pagination|popup|promo|related|reply|search|share|sidebar|social|sponsor\w*|subscribe|tags|widget)\b"
)
_SPLIT = re.compile(r"[-_]")


@dataclass
class Block:
    """A run of text; the tag it stands in, all tags around it, and whether any of their names is good or bad."""

    text: str
    own: str
    tags: frozenset[str]
    good: bool
    bad: bool
    linked: int
    main: bool


class _Markup:
    """Pieces of markup in one pass: what is looked for in vain once is not looked for again."""

    def __init__(self, page: str):
        self.page, self.closed, self.quoted = page, True, True
        self.ends: dict[str, list[int]] | None = None

    def end(self, at: int) -> int:
        """The place of the next ``>``, or -1."""
        found = self.page.find(">", at) if self.closed else -1
        self.closed = found >= 0
        return found

    def tag_end(self, at: int) -> int:
        """The ``>`` that ends a tag, outside of quotes unless those never close."""
        first = self.end(at)
        if first < 0 or not self.quoted:
            return first
        place = at
        while m := _STOP.search(self.page, place):
            if m[0] == ">":
                return m.start()
            place = self.page.find(m[0], m.end()) + 1
            if not place:
                break
        # A quote runs to the end of the page; from here on quotes are plain characters.
        self.quoted = False
        return first

    def close(self, tag: str, at: int) -> int:
        """Where the page goes on after the next closing tag of a skipped element, or -1."""
        if self.ends is None:
            self.ends = {}
            for m in _END.finditer(self.page):
                self.ends.setdefault(m[1].lower(), []).append(m.start())
        places = self.ends.get(tag, [])
        k = bisect_left(places, at)
        found = self.end(places[k]) if k < len(places) else -1
        return found + 1 if found >= 0 else -1


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks with text, in page order. Character references are decoded, white space is one space.

    Unclosed elements end with what encloses them; a closing tag without an
    opening one is passed over. Elements without text are left out up to their
    closing tag; one that closes itself, or that nothing closes, is empty, and
    only scripts and styles run on to the end. Text of formulas, objects and
    ``noscript`` stays, drawings and framed pages go. The time is linear in the
    page, whatever its markup. ``data-label="main"`` marks the text of labelled
    pages and names no role.
    """
    blocks: list[Block] = []
    # Of every open element: its tag, whether a name up to it is good or bad, whether it is main text.
    stack: list[tuple[str, bool, bool, bool]] = []
    parts: list[str] = []
    links, linked, at = 0, 0, 0
    opened: Counter[str] = Counter()
    around: frozenset[str] | None = frozenset()
    if not page:
        return blocks
    markup = _Markup(page)

    def end_block() -> None:
        nonlocal linked, around
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            if around is None:
                around = frozenset(t for t, n in opened.items() if n)
            own, good, bad, main = stack[-1] if stack else ("none", False, False, False)
            blocks.append(Block(text, own, around, good, bad, linked, main))
        parts.clear()
        linked = 0

    def close(tags: tuple[str, ...], walls: frozenset[str]) -> None:
        nonlocal around
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                opened.subtract(entry[0] for entry in stack[k:])
                del stack[k:]
                around = None
                return
            if stack[k][0] in walls:
                return

    while m := _OPEN.search(page, at):
        closing, tag = m[2], (m[3] or "").lower()
        if m[1]:
            found = page.find("-->", m.end())
            after = found + 3 if found >= 0 else len(page)
        else:
            found = markup.tag_end(m.end()) if tag else markup.end(m.end())
            after = found + 1
        # Without an end it is text, as is all that follows up to the next piece.
        start = m.start() if after else m.end()
        if start > at:
            parts.append(page[at:start])
            if links:
                linked += start - at
        at = after or m.end()
        if not after or not tag:
            continue
        attributes = page[m.end() : found]
        if tag in _SKIPPED and not closing:
            itself = tag not in _RUNS_ON and attributes.endswith("/") and not _BARE.search(attributes)
            over = -1 if itself else markup.close(tag, at)
            at = over if over >= 0 else len(page) if tag in _RUNS_ON else at
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            continue
        end_block()
        if tag == "hr":
            continue
        if closing:
            close((tag,), frozenset())
            continue
        if tag in _ENDS_P:
            close(("p",), _WALLS)
        if tag in _CLOSES:
            close(_CLOSES[tag], _WALLS - frozenset(_CLOSES[tag]) if tag != "li" else frozenset(("ul", "ol", "menu")))
        _, good, bad, main = stack[-1] if stack else ("none", False, False, False)
        for name, value in _ROLE.findall(attributes):
            value = value.strip("\"'").lower()
            if name.lower() == "data-label":
                main = main or value == "main"
            else:
                words = _SPLIT.sub(" ", value)
                good, bad = good or bool(GOOD_NAME.search(words)), bad or bool(BAD_NAME.search(words))
        stack.append((tag, good, bad, main))
        opened[tag] += 1
        around = None
    parts.append(page[at:])
    end_block()
    return blocks
