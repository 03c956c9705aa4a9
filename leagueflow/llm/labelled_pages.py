"""Labelled training pages for the extraction model.

:func:`layouts` writes pages from a small grammar of containers that real
sites use; the label of each block is known from the part that wrote it.
:func:`weak_labels` labels the blocks of a page that marks its article with
semantic elements.
"""

from __future__ import annotations

import random

from leagueflow.llm.dom import Block, blocks

#: Containers of the main text and of everything else, as (opening, closing) tags.
MAIN = [
    ("<article>", "</article>"),
    ("<main>", "</main>"),
    ("<main><article>", "</article></main>"),
    ('<div id="content">', "</div>"),
    ('<div class="main-content">', "</div>"),
    ('<div class="post-content">', "</div>"),
    ('<div class="entry-content" itemprop="articleBody">', "</div>"),
    ('<section class="story-body">', "</section>"),
    ('<div class="article"><div class="text">', "</div></div>"),
    ('<div class="page"><div class="body">', "</div></div>"),
    ('<table><tr><td class="content">', "</td></tr></table>"),
]
MENU = [
    ("<nav>", "</nav>"),
    ('<div class="nav">', "</div>"),
    ('<div id="menu">', "</div>"),
    ('<ul class="navbar">', "</ul>"),
    ('<div class="breadcrumbs">', "</div>"),
    ('<div role="navigation">', "</div>"),
    ('<div class="pagination">', "</div>"),
    ('<div class="tags">', "</div>"),
]
HEADER = [("<header>", "</header>"), ('<div id="header">', "</div>"), ('<div class="site-header">', "</div>"), ('<div class="masthead banner">', "</div>"), ('<div role="banner">', "</div>")]
FOOTER = [("<footer>", "</footer>"), ('<div id="footer">', "</div>"), ('<div class="site-footer">', "</div>"), ('<div class="copyright">', "</div>"), ('<div role="contentinfo">', "</div>")]
SIDE = [
    ("<aside>", "</aside>"),
    ('<aside class="sidebar">', "</aside>"),
    ('<div class="sidebar">', "</div>"),
    ('<div id="side-bar">', "</div>"),
    ('<div class="widget">', "</div>"),
    ('<div class="related">', "</div>"),
    ('<section class="related-posts recommended">', "</section>"),
    ('<div role="complementary">', "</div>"),
    ('<div class="newsletter signup">', "</div>"),
    ('<div class="share social">', "</div>"),
    ('<div class="author-bio">', "</div>"),
]
AD = [
    ('<div class="ad">', "</div>"),
    ('<div class="ads">', "</div>"),
    ('<div class="advert">', "</div>"),
    ('<div class="advertisement">', "</div>"),
    ('<div id="ad-banner">', "</div>"),
    ('<div class="sponsored promo">', "</div>"),
    ('<section class="sponsor">', "</section>"),
    ('<ins class="adsbygoogle"><div class="promoted">', "</div></ins>"),
]
NOTICE = [
    ('<div class="cookie-notice">', "</div>"),
    ('<div id="cookie-banner">', "</div>"),
    ('<div class="notice">', "</div>"),
    ('<div class="alert">', "</div>"),
    ('<div class="consent gdpr">', "</div>"),
    ('<div class="popup modal">', "</div>"),
    ('<div class="disclaimer">', "</div>"),
    ('<div role="alert">', "</div>"),
    ('<div class="subscribe paywall">', "</div>"),
]
FORM = [("<form>", "</form>"), ('<form class="search">', "</form>"), ('<div class="login"><form>', "</form></div>"), ('<form role="search">', "</form>"), ('<div class="contact-form"><form>', "</form></div>")]
COMMENTS = [
    ('<div class="comments">', "</div>"),
    ('<section id="comments">', "</section>"),
    ('<section class="reader-comments">', "</section>"),
    ('<div class="comment-list">', "</div>"),
    ('<div id="disqus" class="discussion">', "</div>"),
    ('<ol class="commentlist">', "</ol>"),
    ('<div class="responses replies">', "</div>"),
    ('<div class="user-reviews">', "</div>"),
]


class Writer:
    def __init__(self, rng: random.Random, words: list[str]):
        self.rng, self.words = rng, words
        self.html: list[str] = []
        self.labels: list[int] = []

    def sentence(self, least: int, most: int) -> str:
        n = self.rng.randint(least, most)
        text = " ".join(self.rng.choice(self.words) for _ in range(n))
        return text[:1].upper() + text[1:] + self.rng.choice([".", ".", ".", "", "?", "!"])

    def block(self, tag: str, text: str, label: int, close: bool = True) -> None:
        self.html.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if close else ""))  # only a paragraph may stay open
        self.labels.append(label)

    def prose(self, label: int, most_blocks: int) -> None:
        for _ in range(self.rng.randint(1, most_blocks)):
            text = " ".join(self.sentence(1, 25) for _ in range(self.rng.choice([1, 1, 2, 4, 8])))
            if self.rng.random() < 0.1:
                text += f' <a href="/x">{self.sentence(1, 3)}</a>'
            if self.rng.random() < 0.1:
                text = f"<b>{text}"
            tag = self.rng.choice(["p", "p", "p", "p", 'p class="lead"', "div"])
            self.block(tag, text, label, tag == "div" or self.rng.random() < 0.9)

    def links(self, n: int) -> None:
        kind = self.rng.random()
        if kind < 0.6:
            self.html.append("<ul>")
            for _ in range(n):
                self.block("li", f'<a href="/a">{self.sentence(1, 3).rstrip(".?!")}</a>', 0)
            self.html.append("</ul>")
        elif kind < 0.8:
            self.block("div", " | ".join(f'<a href="/a">{self.sentence(1, 2).rstrip(".?!")}</a>' for _ in range(n)), 0)
        else:
            for _ in range(n):
                self.block("p", f'<a href="/a">{self.sentence(2, 8)}</a>', 0)

    def part(self, kind: str) -> None:
        r = self.rng
        opening, closing = r.choice({"menu": MENU, "header": HEADER, "footer": FOOTER, "side": SIDE, "ad": AD, "notice": NOTICE, "form": FORM, "comments": COMMENTS}[kind])
        self.html.append(opening)
        if kind == "menu":
            self.links(r.randint(2, 8))
        elif kind == "header":
            self.block(r.choice(["div", "h1", "p", "h2"]), self.sentence(1, 6), 0)
            if r.random() < 0.5:
                self.links(r.randint(2, 6))
        elif kind == "footer":
            if r.random() < 0.4:
                self.links(r.randint(2, 5))
            self.block(r.choice(["p", "div"]), f"&copy; {r.randint(1999, 2030)} {self.sentence(1, 12)}", 0)
        elif kind == "side":
            self.block(r.choice(["h2", "h3", "p"]), self.sentence(1, 4), 0)
            if r.random() < 0.5:
                self.links(r.randint(2, 6))
            else:
                self.prose(0, 3)
        elif kind in ("ad", "notice"):
            self.prose(0, 2)
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                self.block("p", f"<label>{self.sentence(1, 4)}</label><input>", 0)
            self.block("button", self.sentence(1, 2), 0)
        else:
            if r.random() < 0.7:
                self.block(r.choice(["h2", "h3"]), self.sentence(1, 3), 0)
            for _ in range(r.randint(1, 6)):
                if opening.startswith("<ol") or r.random() < 0.4:
                    self.html.append("<li>" if opening.startswith("<ol") else '<div class="comment">')
                    self.prose(0, 2)
                    self.html.append("</li>" if opening.startswith("<ol") else "</div>")
                else:
                    self.prose(0, 2)
        self.html.append(closing)

    def body(self) -> None:
        r = self.rng
        opening, closing = r.choice(MAIN)
        self.html.append(opening)
        if r.random() < 0.9:
            heading = r.choice(["h1", "h1", "h2"])
            if r.random() < 0.2:
                self.html.append("<header>")
                self.block(heading, self.sentence(2, 12), 1)
                self.html.append("</header>")
            else:
                self.block(heading, self.sentence(2, 12), 1)
        for _ in range(r.randint(1, 5)):
            kind = r.random()
            if kind < 0.65:
                self.prose(1, 8)
            elif kind < 0.73:
                self.html.append(r.choice(["<ul>", "<ol>"]))
                for _ in range(r.randint(1, 5)):
                    self.block("li", self.sentence(2, 15), 1)
                self.html.append("</ul></ol>")
            elif kind < 0.8:
                self.block(r.choice(["h2", "h3", "h4"]), self.sentence(1, 8), 1)
            elif kind < 0.85:
                self.block(r.choice(["blockquote", "pre", "figcaption"]), self.sentence(3, 30), 1)
            elif kind < 0.88:
                self.html.append("<table><tr>")
                for _ in range(r.randint(1, 4)):
                    self.block("td", self.sentence(1, 6), 1)
                self.html.append("</tr></table>")
            else:
                self.part(r.choice(["ad", "side", "notice"]))
        if r.random() < 0.3:
            self.part(r.choice(["comments", "side", "ad", "form", "footer"]))
        self.html.append(closing)

    def page(self) -> tuple[str, list[int]]:
        r = self.rng
        self.html.append("<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>x='<p>'</script></head><body>")
        outer = r.random() < 0.5
        self.html.append(r.choice(['<div class="wrapper">', '<div id="page">', '<div class="container">']) if outer else "")
        for kind, chance in (("notice", 0.3), ("header", 0.6), ("menu", 0.8), ("ad", 0.4), ("form", 0.2), ("side", 0.2)):
            if r.random() < chance:
                self.part(kind)
        self.body()
        for kind, chance in (("comments", 0.4), ("side", 0.4), ("ad", 0.3), ("form", 0.2), ("menu", 0.2), ("footer", 0.8), ("notice", 0.1)):
            if r.random() < chance:
                self.part(kind)
        self.html.append("</div></body></html>" if outer else "</body></html>")
        return "".join(self.html), self.labels


def layouts(n: int, words: list[str], seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of ``n`` pages (1: main text)."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        page, labels = Writer(rng, words).page()
        found = blocks(page)
        if len(found) == len(labels):  # a grammar part that the parser joins or splits differently is no example
            out.append((found, labels))
    return out


_MAIN_TAGS = frozenset(["article", "main"])
_OTHER_TAGS = frozenset("nav header footer aside form button".split())
_OTHER_NAMES = frozenset("ad ads advert advertisement banner comment comments cookie footer menu nav notice promo related share sidebar sponsored widget".split())


def weak_labels(page: list[Block]) -> list[int] | None:
    """Labels of a page that has a semantic container for its article, else None."""
    labels, any_main = [], False
    for b in page:
        tags = [e[0] for e in b.path]
        inside = any(t in _MAIN_TAGS for t in tags)
        other = any(e[0] in _OTHER_TAGS or _OTHER_NAMES.intersection(e[1:]) for e in b.path)
        any_main |= inside
        labels.append(int(inside and not other))
    return labels if any_main else None
