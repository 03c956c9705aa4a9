"""Leaf blocks of an HTML page: stretches of text between block-level tags, with the path of elements above them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements that do not break a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Elements of formulas and drawings; their text stands in the block around them.
FORMULA = frozenset(
    "math mi mo mn ms mtext mrow msup msub msubsup mmultiscripts mprescripts mfrac msqrt mroot mover munder munderover mtable mtr mtd mspace mstyle mpadded mphantom "
    "menclose merror maction semantics".split()
)
DRAWING = frozenset(
    "svg g path rect circle ellipse line polyline polygon text tspan textpath image use symbol marker mask pattern clippath lineargradient radialgradient stop filter switch view animate set".split()
)
#: Elements that show what they hold where they can't show themselves; they part words, not blocks.
EMBEDDED = frozenset("object canvas audio video map text switch".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and no text of the page; without an end they run to the end of the page.
RAW = frozenset("script style iframe title textarea noembed noframes xmp".split())
#: Elements with markup inside that is no text of the page; without an end they end with the element around them.
SKIPPED = frozenset("template noscript select datalist annotation annotation-xml desc metadata defs".split())
#: An open element (key) ends when one of these begins.
ENDED_BY = {
    "p": frozenset("p div ul ol dl li table h1 h2 h3 h4 h5 h6 section article aside nav header footer form pre blockquote hr main address fieldset figure details".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option"]),
}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Block:
    """``path``: elements from the outside in, each a tag and the words of its class, id and role."""

    path: tuple[tuple[str, ...], ...]
    text: str
    link_chars: int


def element(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, then the words that its attributes hold, lower-cased."""
    if not attributes:
        return (tag,)
    found = {p.lower() for m in _ATTRIBUTE.finditer(attributes) for p in _NAME_PART.findall(m[2] or m[3] or m[4] or "")}
    if _HIDDEN.search(attributes):
        found.add("hidden")
    return (tag, *sorted(found))


def blocks(page: str | None) -> list[Block]:
    """All blocks with text, in page order. White space in a block is one space; character references are decoded."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, ...]] = []  # block-level elements that are open
    pieces: list[str] = []
    skipped: list[str] = []  # elements that are open inside one that is skipped, and that one
    links = depth_of_a = 0
    at = 0

    def text(a: int, b: int) -> None:
        nonlocal links
        if a < b and not skipped:
            piece = page[a:b]
            if "&" in piece:
                piece = html.unescape(piece)
            pieces.append(piece)
            if depth_of_a:
                links += len("".join(piece.split()))

    def flush() -> None:
        nonlocal links
        if pieces:
            joined = " ".join("".join(pieces).split())
            if joined:
                out.append(Block(tuple(stack), joined, links))
            pieces.clear()
        links = 0

    while m := _MARKUP.search(page, at):
        text(at, m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag in RAW:
            if not closing and not (m[3] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            pieces.append(" ")
            continue
        if skipped:
            if not closing:
                if tag not in VOID and not (m[3] or "").endswith("/"):
                    skipped.append(tag)
                continue
            if tag in skipped:
                del skipped[len(skipped) - 1 - skipped[::-1].index(tag) :]
                continue
            if all(e[0] != tag for e in stack):
                continue
            skipped.clear()  # it was never closed: what is around it ends, and so does it
        if tag in SKIPPED:
            if not closing and not (m[3] or "").endswith("/"):
                skipped.append(tag)
            pieces.append(" ")
        elif tag == "br" or tag in EMBEDDED:
            pieces.append(" ")
        elif tag in INLINE or tag in FORMULA or tag in DRAWING:
            if tag == "a":
                depth_of_a = 0 if closing else 1
        else:
            flush()
            depth_of_a = 0
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif tag not in VOID:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] in ENDED_BY:
                    if tag in ENDED_BY[stack[k][0]]:
                        del stack[k:]
                    k -= 1
                stack.append(element(tag, m[3] or m[6] or ""))
    text(at, len(page))
    flush()
    return out
