"""Labelled web pages to train the extractor on: page templates of many layouts filled with invented words.

Every leaf block is written together with its label, 1 for the article and 0 for menus, headers, footers, sidebars,
notices, adverts, forms and comments of readers.  Prose, symbols, shouting and one-word paragraphs stand in both
kinds, so that what a block says weighs less than where it stands.
"""

from __future__ import annotations

import random

_BITS = "an ba ce do el fi ga hu in jo ka le mi no or pu qua ri so te un ve wi xa yo zu sch tion ment ing".split()
MENU = ("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toolbar", "topbar", "site-nav", "main-menu")
TOP = ("header", "site-header", "masthead", "banner", "page-header", "logo", "branding")
BOTTOM = ("footer", "site-footer", "page-footer", "copyright", "colophon", "bottom", "legal")
SIDE = ("sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "more-links", "tags")
NOTICE = ("cookie", "cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "paywall")
ADVERT = ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner-ad")
FORM = ("form", "search", "search-form", "login", "signup", "contact-form", "newsletter-form")
REPLY = ("comment", "comments", "comment-list", "replies", "discussion", "responses", "disqus", "comment-body")
SHARE = ("share", "social", "share-buttons", "byline-links", "follow")
BODY = ("content", "article", "post", "entry", "entry-content", "post-content", "article-body", "story", "main-content", "text", "post-body", "main")


class Writer:
    """Writes one page and the labels of its leaf blocks."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []

    def word(self) -> str:
        return "".join(self.rng.choice(_BITS) for _ in range(self.rng.randint(1, 4)))

    def text(self, least: int, most: int) -> str:
        r = self.rng
        ws = [self.word() for _ in range(r.randint(least, most))]
        style = r.random()
        if style < 0.1:
            ws = [w + r.choice(("###", "%%%", "***", "$$$", "&amp;&amp;")) for w in ws]
        elif style < 0.15:
            ws = [w.upper() + "!!" for w in ws]
        elif style < 0.2:
            ws = [x for w in ws for x in (w, "|")]
        elif style < 0.25:
            ws = [ws[0]] * len(ws)
        s = " ".join(ws).capitalize()
        return s + "." if r.random() < 0.8 else s

    def block(self, tag: str, text: str, label: int, attrs: str = "") -> None:
        r = self.rng
        inner = text
        if label and r.random() < 0.2:
            inner = f"<b>{text}</b>" if r.random() < 0.5 else f'{text} <a href="/{self.word()}">{self.word()}</a> {self.word()}'
        self.html.append(f"<{tag}{attrs}>{inner}</{tag}>" if r.random() < 0.9 or tag not in ("p", "li") else f"<{tag}{attrs}>{inner}")
        self.labels.append(label)

    def links(self, n: int, tag: str = "li") -> None:
        for _ in range(n):
            w = self.word()
            self.block(tag, f'<a href="/{w}">{w}</a>', 0)

    def box(self, names: tuple[str, ...], tags: tuple[str, ...], fill) -> None:
        r = self.rng
        tag, name = r.choice(tags), r.choice(names)
        attr = "" if tag not in ("div", "section", "ul") and r.random() < 0.6 else f' {r.choice(("class", "class", "id"))}="{name}"'
        self.html.append(f"<{tag}{attr}>")
        fill()
        self.html.append(f"</{tag}>")

    def menu(self) -> None:
        def fill() -> None:
            kind = self.rng.random()
            if kind < 0.75:
                self.html.append("<ul>")
                self.links(self.rng.randint(3, 9))
                self.html.append("</ul>")
            elif kind < 0.85:
                self.block("span", " ".join(f'<a href="/{w}">{w}</a>' for w in [self.word() for _ in range(self.rng.randint(2, 7))]), 0)
            else:
                self.links(self.rng.randint(2, 5), "div")

        self.box(MENU, ("nav", "nav", "div"), fill)

    def some(self, names: tuple[str, ...], tags: tuple[str, ...], least: int = 3, most: int = 25, n: int = 2, parts: tuple[str, ...] = ("p", "div", "h3", "span")) -> None:
        def fill() -> None:
            r = self.rng
            for _ in range(r.randint(1, n)):
                t = r.choice(parts)
                if t == "span":
                    self.html.append(f"<div></div>{self.text(least, most)}<div></div>")
                    self.labels.append(0)
                else:
                    self.block(t, self.text(least, most), 0)

        self.box(names, tags, fill)

    def form(self) -> None:
        def fill() -> None:
            self.block("label" if self.rng.random() < 0.3 else "p", self.text(1, 8), 0)
            self.html.append('<input type="text">')
            self.block("button", self.word(), 0)

        self.box(FORM, ("form", "form", "div"), fill)

    def replies(self) -> None:
        def fill() -> None:
            if self.rng.random() < 0.5:
                self.block("h3", self.text(1, 3), 0)
            for _ in range(self.rng.randint(1, 5)):
                self.some(REPLY, ("div", "li", "article"), 3, 60, 2, ("p", "p", "div"))

        self.box(REPLY, ("section", "div", "div", "ol"), fill)

    def article(self) -> None:
        r = self.rng
        kind = r.random()
        tag = "article" if kind < 0.6 else "main" if kind < 0.7 else "div"
        attr = "" if tag != "div" and r.random() < 0.7 else f' {r.choice(("class", "class", "id"))}="{r.choice(BODY)}"'
        inner = r.random() < 0.25
        self.html.append(f"<{tag}{attr}>" + (f'<div class="{r.choice(BODY)}">' if inner else ""))
        if r.random() < 0.85:
            headed = r.random() < 0.15
            self.html.append("<header>" if headed else "")
            self.block("h1", self.text(1, 12), 1)
            self.html.append("</header>" if headed else "")
        for _ in range(r.choice((r.randint(0, 3), r.randint(1, 14)))):
            p = r.random()
            if p < 0.62:
                self.block("p", self.text(1, r.choice((3, 90))), 1)
            elif p < 0.7:
                self.html.append(r.choice(("<section>", "<section>", "<div>", "<figure>")))
                tag = self.html[-1][1:-1]
                for _ in range(r.randint(1, 3)):
                    self.block("figcaption" if tag == "figure" else "p", self.text(1, 60), 1)
                self.html.append(f"</{tag}>")
            elif p < 0.77:
                self.block("h2", self.text(1, 8), 1)
            elif p < 0.84:
                self.html.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.block("li", self.text(1, 15), 1)
                self.html.append("</ul>")
            elif p < 0.88:
                self.block("blockquote", self.text(3, 40), 1)
            elif p < 0.9:
                self.block("pre", self.text(3, 30), 1)
            elif p < 0.92:
                self.html.append("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    self.block("td", self.text(1, 4), 1)
                self.html.append("</tr></table>")
            elif p < 0.95:
                self.some(ADVERT, ("div", "aside"), 2, 25)
            elif p < 0.97:
                self.some(SHARE, ("div", "ul"), 1, 5)
            else:
                self.block("div", self.text(2, 60), 1)
        if r.random() < 0.15:
            self.replies()
        self.html.append(("</div>" if inner else "") + f"</{tag}>")

    def page(self) -> tuple[str, list[int]]:
        r = self.rng
        bare = r.random() < 0.15  # an article with next to nothing around it
        maybe = lambda p, f, *a: f(*a) if r.random() < (p / 4 if bare else p) else None
        self.html.append(f"<!DOCTYPE html><html><head><title>{self.text(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
        maybe(0.3, self.some, NOTICE, ("div", "section", "aside"), 3, 30)
        maybe(0.5, self.some, TOP, ("header", "header", "div"), 1, 10)
        maybe(0.8, self.menu)
        maybe(0.5, self.some, ADVERT, ("div", "aside"), 2, 25)
        maybe(0.15, self.form)
        maybe(0.2, self.some, SIDE, ("aside", "div"), 2, 20, 4)
        wrapped = r.random() < 0.3
        self.html.append('<div id="wrapper">' if wrapped else "")
        self.article()
        maybe(0.35, self.some, SIDE, ("aside", "div", "section"), 2, 30, 4)
        self.html.append("</div>" if wrapped else "")
        maybe(0.3, self.replies)
        maybe(0.2, self.form)
        maybe(0.15, self.some, NOTICE, ("div", "section"), 3, 30)
        maybe(0.3, self.menu)
        maybe(0.8, self.some, BOTTOM, ("footer", "footer", "div"), 2, 20)
        self.html.append("</body></html>")
        return "".join(self.html), self.labels


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, list[int]]]:
    """n pages with a label for each leaf block, the same for the same seed."""
    return [Writer(random.Random(f"{seed}/{i}")).page() for i in range(n)]
