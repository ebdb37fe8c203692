"""Leaf blocks of an HTML page: their text, and the elements around them.

A tolerant reader of real markup: unclosed elements, stray signs, comments and raw-text elements.
It keeps a stack of open elements and starts a new block wherever a block-level element begins or
ends, which is all the tree that the extractor needs.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math object".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q s
samp small span strike strong sub sup time tt u var wbr""".split())
#: An element that the start of one of these closes when it is the nearest of its kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"thead", "tr"}}
FENCES = frozenset("ul ol dl table select body div section article".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>", re.S)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none", re.I)


@dataclass
class Block:
    """text: white space as in the source; linked: characters inside links; path: (tag, name words)
    of the open elements, outermost first."""

    text: str
    linked: int
    path: tuple
    inner: set = field(default_factory=set)


def name_words(attributes: str) -> tuple[str, ...]:
    """The words in an element's class, id and role."""
    found = (a or b or c for a, b, c in _NAMES.findall(attributes))
    return tuple(w.lower() for value in found for w in _WORDS.findall(value))


def blocks(page: str) -> list[Block]:
    """All blocks of a page with any text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    inner: set[str] = set()
    linked = 0
    links = 0
    at = 0
    end = len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            whole = html.unescape("".join(text))
            if whole.strip():
                out.append(Block(whole, linked, tuple(stack), set(inner)))
            text.clear()
        inner.clear()
        linked = 0

    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at:m.start()] if m else page[at:]
        if piece:
            text.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                close = re.compile(f"</{re.escape(tag)}[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
                text.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            if tag == "br":
                text.append(" ")
            elif not closing:
                inner.add(tag)
            continue
        flush()
        links = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            inner.add(tag)
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in CLOSES.get(tag, ()):
                del stack[k:]
                break
            if stack[k][0] in FENCES:
                break
        words = name_words(attributes) if attributes else ()
        if attributes and _HIDDEN.search(attributes):
            words = (*words, "hidden")
        if not attributes.endswith("/"):
            stack.append((tag, words))
    flush()
    return out
