"""Web pages of many layouts, made here with their main text known: what the block classifier learns from.

Sites mark their parts by elements, by class names or not at all, and nest them in wrappers whose names
mislead; every page draws each part's marking anew. Words are invented, so nothing is learnt of a language
but the short set phrases of notices and footers.
"""

from __future__ import annotations

import random
from collections.abc import Callable

_SYLLABLES = "an be co da en fi ge ho in ka le mo na or pe qui ra se ti un ve wa xi yo zu the ing tion es ar".split()
_WRAPS = ("wrap", "container", "page sidebar-right", "site", "row", "layout has-sidebar", "c12", "grid-8", "inner", "hfeed")
_POSTS = ('<article class="post-{n} post type-post category-search tag-social">', "<article>", '<div class="post-body">', '<div class="entry-content">', '<div id="content">', '<main class="has-header main-header-fixed">', "<main>", '<div itemprop="articleBody">', '<section class="story">')


class Page:
    """HTML as it grows, and the texts of the blocks that are content."""

    def __init__(self, r: random.Random):
        self.r, self.html, self.content = r, [], set()

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 3)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentence(self, lo: int = 4, hi: int = 18) -> str:
        ws = self.words(lo, hi).split(" ")
        if len(ws) > 6 and self.r.random() < 0.5:
            ws[len(ws) // 2] += ","
        return " ".join(ws).capitalize() + self.r.choice("....!?")

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 4, 6, 9))))

    def put(self, tag: str, text: str, content: bool = False, link: bool = False) -> None:
        self.html.append(f"<{tag}>{f'<a href=/x>{text}</a>' if link else text}</{tag.split(' ')[0]}>")
        if content:
            self.content.add(" ".join(text.split()))

    def inside(self, marks: tuple[str, ...], fill: Callable[[], None]) -> None:
        """fill() within one of the opening tags, drawn at random."""
        tag = self.r.choice(marks).replace("{n}", str(self.r.randint(1, 999)))
        self.html.append(tag)
        fill()
        self.html.append(f"</{tag[1:-1].split(' ')[0]}>" if tag else "")

    def links(self) -> None:
        way = self.r.choice(("li", "td", "div", "span"))
        if way == "li":
            self.html.append("<ul>")
        if way == "td":
            self.html.append("<table><tr>")
        for _ in range(self.r.randint(3, 9)):
            self.put(way, self.words(1, 4).capitalize(), link=True)
        self.html.append("</ul>" if way == "li" else "</tr></table>" if way == "td" else "")

    def article(self) -> None:
        r = self.r
        if r.random() < 0.85:
            self.put(r.choice(("h1", "h1", "h2", "div")), self.words(3, 12).capitalize(), True)
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            kind = r.random()
            if kind < 0.52:
                self.put(r.choice(("p", "p", "p", "div")), self.prose(), True)
            elif kind < 0.62:  # without marks, of one word over and over, of signs, or very long
                text = r.choice((self.words(1, 200), " ".join([self.word()] * r.randint(1, 90)), " | ".join(self.words(1, 40).split(" ")), self.words(3, 60).replace(" ", "### ").upper(), " ".join(self.prose() for _ in range(20))))
                self.put(r.choice(("p", "p", "p", "div")), text, True)
            elif kind < 0.64:  # set phrases stand in articles too
                self.put("p", r.choice(("All rights reserved.", "Copyright {w}.", "They {w} cookies and {w}.", "Licensed under the {w}.", "Subscribe and {w}.", "The privacy policy of {w} is {w}.")).format(w=self.words(1, 4)), True)
            elif kind < 0.70:
                self.put("p", self.words(1, 3).capitalize() + r.choice((".", "", ":")), True)
            elif kind < 0.76:
                self.put(r.choice(("h2", "h3")), self.words(1, 7).capitalize(), True)
            elif kind < 0.82:
                self.html.append("<ul>")
                for _ in range(r.randint(2, 6)):
                    self.put("li", self.sentence(2, 14), True, link=r.random() < 0.15)
                self.html.append("</ul>")
            elif kind < 0.86:
                self.put(r.choice(("blockquote", "pre", "figcaption")), self.prose(), True)
            elif kind < 0.89:
                self.html.append("<table>")
                for _ in range(r.randint(2, 5)):
                    self.html.append("<tr>")
                    for _ in range(3):
                        self.put("td", self.words(1, 3), True)
                    self.html.append("</tr>")
                self.html.append("</table>")
            elif kind < 0.92:
                text, more = self.sentence(), self.sentence(3, 6)
                self.html.append(f"<p>{text} <a href=/y>{more}</a></p>")
                self.content.add(f"{text} {more}")
            elif kind < 0.96:
                self.inside(('<div class="ad">', '<div class="advert-box">', '<aside class="promo">'), lambda: self.put(r.choice(("p", "div")), self.sentence()))
            else:
                self.inside(('<div class="share-buttons">', '<ul class="social">', '<div class="related-posts">', '<div class="post-meta">'), lambda: [self.put("li", self.words(1, 5), link=r.random() < 0.8) for _ in range(r.randint(1, 4))])

    def notice(self) -> None:
        r = self.r
        text = r.choice(("We use cookies to {} on this site.", "This site uses cookies. {}", "Subscribe to our newsletter for {}.", "Sign up to {} by email", "Log in or register to {}.", "Follow us on {} and {}", "Share this: {}", "Advertisement {}"))
        self.put(r.choice(("p", "div", "span", "h3")), text.format(self.words(1, 5), self.word()))

    def legal(self) -> None:
        r = self.r
        text = r.choice(("&copy; {y} {w}", "Copyright {y} {w}. All rights reserved.", "© {y} {w}", "{w} | Privacy policy | Terms of use", "Powered by {w}", "&copy; {w} &middot; {s}"))
        self.put(r.choice(("p", "div", "span", "small")), text.format(y=r.randint(1998, 2030), w=self.words(1, 3), s=self.sentence()))

    def about(self) -> None:
        """Prose that is no main text: teasers of other pages, notes on the site."""
        for _ in range(self.r.randint(1, 3)):
            self.inside(("<article>", "<div>", "<section>"), lambda: [self.put(self.r.choice(("h2", "h3", "h4")), self.words(1, 6).capitalize(), link=self.r.random() < 0.5), self.put("p", self.prose())])

    def comments(self) -> None:
        for _ in range(self.r.randint(1, 5)):
            self.inside(('<div class="comment">', "<li>", "<article>", "<div>"), lambda: [self.put("p", self.words(1, 2), link=True), self.put("p", self.prose())])


def layout(seed: int) -> tuple[str, set[str]]:
    """A page and the texts of its content blocks."""
    r = random.Random(seed)
    p = Page(r)
    p.html.append(f"<!DOCTYPE html><html><head><title>{p.words(2, 6)}</title></head><body>")
    wraps = r.randint(0, 3)
    p.html += [f'<div class="{r.choice(_WRAPS)}">' for _ in range(wraps)]
    some = lambda chance, *how: r.random() < chance and p.inside(*how)
    bare = ("<div>", "<div>", "")
    some(0.6, ("<header>", '<div class="masthead">', '<div id="header">', *bare), lambda: p.put(r.choice(("div", "p", "h1")), p.words(1, 4).capitalize(), link=r.random() < 0.6))
    some(0.8, ("<nav>", '<div class="menu">', '<div role="navigation">', *bare), p.links)
    some(0.4, ('<div class="cookie-notice">', '<div class="alert">', '<div class="popup">', *bare), p.notice)
    some(0.3, ('<div class="ad">', '<div class="banner">'), lambda: p.put(r.choice(("p", "div")), p.sentence()))
    side = lambda: some(0.5, ("<aside>", '<div class="sidebar">', '<div id="secondary" class="widget-area">', *bare), lambda: [p.put("h3", p.words(1, 3)), p.links(), r.random() < 0.4 and p.notice()])
    tell = lambda chance: some(chance, ("<aside>", '<div class="related">', '<div class="sidebar">', "<footer>", '<div class="recommended-stories">'), p.about)
    first = r.random() < 0.4
    if first:
        side()
        tell(0.2)
    p.inside((*_POSTS, *bare), p.article)
    some(0.3, ("<form>", '<div class="newsletter">', *bare), p.notice)
    some(0.35, ('<section id="comments">', '<div class="comments-area">', '<ol class="commentlist">', '<div id="disqus_thread">'), p.comments)
    tell(0.3)
    if not first:
        side()
    some(0.8, ("<footer>", '<div class="footer">', '<div id="site-footer">', *bare), lambda: [r.random() < 0.4 and p.links(), r.random() < 0.2 and p.put("p", p.prose()), p.legal()])
    p.html += ["</div>"] * wraps + ["</body></html>"]
    return "".join(p.html), p.content
