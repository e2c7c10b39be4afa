"""Text blocks of raw HTML in page order, with what a labeller may know of each.

A block is the text between two boundaries: any tag but a text-level one.  One scan over the page finds them; it
goes on through unclosed tags, quotes and comments and takes time in proportion to the page.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple
from zlib import crc32

#: Fixed values of HTML: text-level elements, elements without content, and those whose content is no text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("canvas iframe math noscript object script select style svg template textarea title".split())
EMPHASIS = frozenset("b strong em i".split())
#: An open element of the first kind ends where one of the second begins.
ENDS_AT = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
           "th": {"td", "th", "tr"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Sizes of the hashed bags of an element's own and all surrounding elements' names.
PATH_BUCKETS, OWN_BUCKETS = 128, 64

_TAG = re.compile(r"<(?:!--|/?[a-zA-Z]|[!?])")
_NAME = re.compile(r"[^\s/>]*")
_MARK = re.compile("[\"'>]")
_NAMED = re.compile(r"""\b(class|id|role|data-main)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_LETTERS = re.compile(r"[a-z]+")


class Block(NamedTuple):
    """A block's text, hashed names around it and of its element, and plain facts."""

    text: str
    path: frozenset
    own: frozenset
    heading: bool
    linked: int
    stressed: int
    main: bool
    tags: tuple


class _Element(NamedTuple):
    tag: str
    path: frozenset
    own: frozenset
    main: bool
    tags: tuple


def _buckets(names: list[str], size: int) -> frozenset:
    return frozenset(crc32(n.encode("utf-8", "ignore")) % size for n in names)


def _names(tag: str, attributes: str) -> tuple[list[str], bool]:
    """Tag and words of class, id and role; whether the element is marked as main text."""
    names, main = [tag], False
    if "=" in attributes:
        for key, value in _NAMED.findall(attributes):
            if key.lower() == "data-main":
                main = True
            else:
                names += [f".{w}" for w in _LETTERS.findall(value.lower())]
    if "hidden" in attributes:
        names.append(".hidden")
    return names, main


class _Scan:
    """One scan over a page."""

    def __init__(self, page: str):
        self.page, self.unmatched = page, set()

    def tag_end(self, at: int) -> int:
        """Index of the ``>`` that ends the tag, outside quoted values."""
        page, k = self.page, at
        while True:
            found = _MARK.search(page, k)
            if found is None:
                return len(page)
            if found.group() == ">":
                return found.start()
            quote, k = found.group(), found.end()
            if quote not in self.unmatched and page[at:found.start()].rstrip().endswith("="):
                close = page.find(quote, k)
                if close < 0:
                    self.unmatched.add(quote)
                else:
                    k = close + 1


def blocks(page: str) -> list[Block]:
    """All blocks with text, in page order."""
    scan, out = _Scan(page), []
    root = _Element("", frozenset(), frozenset(), False, ())
    stack, counts, parts = [root], {}, []
    known: dict[tuple, _Element] = {}
    linked = stressed = 0
    in_link, in_stress, at, ended = False, 0, 0, set()

    def flush():
        nonlocal parts, linked, stressed
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                out.append(Block(text, top.path, top.own, top.tag in HEADINGS, min(linked, len(text)),
                                 min(stressed, len(text)), top.main, top.tags))
            parts = []
        linked = stressed = 0

    def put(text: str):
        nonlocal linked, stressed
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked += len(text)
            if in_stress:
                stressed += len(text)

    def pop():
        gone = stack.pop()
        counts[gone.tag] -= 1

    while True:
        found = _TAG.search(page, at)
        if found is None:
            put(page[at:])
            break
        put(page[at:found.start()])
        opening = found.group()
        if opening == "<!--":
            at = page.find("-->", found.end())
            if at < 0:
                break
            at += 3
            continue
        if opening in ("<!", "<?"):
            at = page.find(">", found.end())
            if at < 0:
                break
            at += 1
            continue
        closing = opening[1] == "/"
        begin = found.end() - 1
        tag = _NAME.match(page, begin).group().lower()
        end = scan.tag_end(begin + len(tag))
        attributes = "" if closing else page[begin + len(tag):end]
        at = end + 1
        if tag in INLINE:
            if tag == "a":
                in_link = not closing and "href" in attributes
            elif tag in EMPHASIS:
                in_stress = not closing
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        in_link = in_stress = False
        if tag in SILENT:
            if not closing and tag not in ended and not attributes.endswith("/"):
                close = re.compile(rf"</{tag}\b", re.IGNORECASE).search(page, at)
                if close is None:  # never closed: its text is taken as text, and no later one is looked for
                    ended.add(tag)
                else:
                    at = scan.tag_end(close.end()) + 1
            continue
        if closing:
            if counts.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if stack[-1].tag == "p":
            pop()
        while stack[-1].tag in ENDS_AT and tag in ENDS_AT[stack[-1].tag]:
            pop()
        if tag in VOID:
            continue
        top = stack[-1]
        key = (id(top), tag, attributes)
        element = known.get(key)
        if element is None:
            names, main = _names(tag, attributes)
            element = _Element(tag, top.path | _buckets(names, PATH_BUCKETS), _buckets(names, OWN_BUCKETS),
                               main or top.main, tuple(dict.fromkeys((*top.tags, *names)))[:40])
            known[key] = element
        stack.append(element)
        counts[tag] = counts.get(tag, 0) + 1
    flush()
    return out
