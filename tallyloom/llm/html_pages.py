"""Labelled pages to train on: page layouts of many kinds with known main text, drawn from a seed.

The tables of pages carry no labels, so the labelled pages are made here: each is a sequence of parts (menus,
mastheads, notices, adverts, forms, sidebars, article, comments, footers), spelled in one of several idioms of
markup, with invented words and, in some parts, words that such parts use. Each text is drawn with its label. A share
of the pages are plain: no class or id says what a part is, and often no element either. Parts that nothing would then
tell from the article are left out of these.
"""

from __future__ import annotations

import random

from tallyloom.llm.html_blocks import CUES

_SYLLABLES = "ka lo mi ren tas vo und sel pra ti gor nel da ume fir ost be cha lin par se tu wen dor".split()


#: Share of plain pages.
PLAIN = 0.35
#: Share of pages that are an article and nothing else, and of others whose article is short too: a few blocks, often of few words.
ALONE, SHORT = 0.12, 0.2


class _Page:
    def __init__(self, seed: int, plain: bool | None = None):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[int] = []
        self.entity = self.r.random() < 0.2
        self.plain = self.r.random() < PLAIN if plain is None else plain

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            s = self.words(2, 16).capitalize() + self.r.choice(["."] * 5 + ["!", "?", ".&quot;" if self.entity else "."])
            out.append(s)
        return " ".join(out)

    def saying(self, cue: str, low: int, high: int) -> str:
        """Prose in which some words are a part's own."""
        words = self.prose(low, high).split(" ")
        for _ in range(self.r.randint(2, 4)):
            words.insert(self.r.randrange(len(words)), self.r.choice(CUES[cue].split()))
        return " ".join(words).capitalize()

    def add(self, markup: str, *labels: int) -> None:
        self.out.append(markup)
        self.labels += labels

    def links(self, n: int, wrap: str = "li") -> None:
        for _ in range(n):
            self.add(f'<{wrap}><a href="/{self.word()}">{self.words(1, 3)}</a></{wrap}>', 0)

    def attr(self, *names: str) -> str:
        if self.plain:
            return self.r.choice(["", "", f' class="{self.word()}"', f' class="c{self.r.randint(1, 99)}"', f' id="{self.word()}{self.r.randint(1, 9)}"'])
        name = self.r.choice(names)
        name = self.r.choice([name, name, f"{self.word()}-{name}", f"{name}-{self.word()}", f"{name}_{self.r.randint(1, 9)}"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    # parts that are not main text

    def menu(self) -> None:
        tag, a = self.r.choice([("nav", ""), ("nav", self.attr("menu", "nav")), ("div", self.attr("menu", "navbar", "navigation", "breadcrumbs"))])
        if self.plain:
            tag = self.r.choice(["div", "div", "nav"])
        self.add(f"<{tag}{a}>")
        if self.r.random() < 0.2:
            self.add(" ".join(f'<a href="/{self.word()}">{self.words(1, 2)}</a>' for _ in range(self.r.randint(2, 6))), 0)
        elif self.r.random() < 0.75:
            self.add("<ul>")
            self.links(self.r.randint(3, 8))
            self.add("</ul>")
        else:
            self.links(self.r.randint(3, 6), self.r.choice(["div", "p"]))
        self.add(f"</{tag}>")

    def masthead(self) -> None:
        tag, a = self.r.choice([("header", ""), ("header", self.attr("masthead", "topbar")), ("div", self.attr("header", "masthead", "branding"))])
        if self.plain:
            tag = "header"
        self.add(f"<{tag}{a}>")
        self.add(f"<{(h := self.r.choice(['h1', 'h2', 'div', 'p']))}>{self.words(1, 5)}</{h}>", 0)
        if self.r.random() < 0.5:
            self.add(f"<p>{self.prose(1, 1)}</p>", 0)
        if self.r.random() < 0.3:
            self.menu()
        self.add(f"</{tag}>")

    def box(self, *names: str, cue: str, low: int = 1, high: int = 3, tag: str = "div") -> None:
        self.add(f"<{tag}{self.attr(*names)}>")
        said = self.plain or self.r.random() < 0.4
        prose = lambda: self.saying(cue, low, high) if said else self.prose(low, high)
        if self.r.random() < 0.5:
            self.add(prose(), 0)
        else:
            for _ in range(self.r.randint(1, 2)):
                self.add(f"<p>{prose()}</p>", 0)
        if said and self.r.random() < 0.3:
            self.add(f"<button>{self.words(1, 2)}</button>", 0)
        self.add(f"</{tag}>")

    def advert(self) -> None:
        self.box("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", cue="ad", tag=self.r.choice(["div", "div", "aside", "section"]))

    def notice(self) -> None:
        self.box("cookie-notice", "consent", "notice", "cookie", "alert", "popup", "gdpr", cue="notice")

    def control(self) -> None:
        """Something to work with, within the article or beside it."""
        n = self.r.randint(2, 4)
        choices = "".join(f"<option>{self.words(1, 2)}{self.r.choice(['', '</option>'])}" for _ in range(n))
        markup, labels = self.r.choice([(f"<select>{choices}</select>", n), (f"<button{self.attr('share', 'button')}>{self.words(1, 3)}</button>", 1), (f"<p><button>{self.r.choice(CUES['share'].split()).capitalize()}</button></p>", 1)])
        self.add(markup, *[0] * labels)

    def enable(self) -> None:
        """What shows where scripts do not run."""
        self.add("<noscript>")
        self.add(self.r.choice([f"<p>{self.prose(1, 2)}</p>", f"<div{self.attr('notice', 'warning', 'alert')}>{self.prose(1, 2)}</div>", self.prose(1, 1)]), 0)
        self.add("</noscript>")

    def icon(self) -> str:
        """A drawing with words that are no text of the page."""
        return self.r.choice([f'<svg viewBox="0 0 9 9"><g><path d="M0 0"/><text>{self.words(1, 2)}</text></g></svg>', f"<math><mi>{self.word()}</mi></math>", f"<canvas>{self.words(1, 4)}</canvas>", f"<object><div>{self.words(1, 3)}</div></object>"])

    def sidebar(self) -> None:
        tag, a = self.r.choice([("aside", ""), ("aside", self.attr("sidebar", "related")), ("div", self.attr("sidebar", "widget", "related", "side"))])
        if self.plain:
            tag = "aside"
        self.add(f"<{tag}{a}>")
        if self.r.random() < 0.6:
            self.add(f"<h3>{self.words(1, 4)}</h3>", 0)
        for _ in range(self.r.randint(0, 2)):
            self.add(f"<p>{self.prose(1, 4)}</p>", 0)
        if self.r.random() < 0.5:
            self.add("<ul>")
            self.links(self.r.randint(2, 5))
            self.add("</ul>")
        self.add(f"</{tag}>")

    def form(self) -> None:
        a = self.r.choice(["", self.attr("search", "newsletter", "login", "subscribe")])
        self.add(f'<form{a} action="/{self.word()}">')
        if self.r.random() < 0.5:
            self.add(f"<p>{self.prose(1, 2)}</p>", 0)
        self.add(f"<label>{self.words(1, 3)}</label><input name=q><div><button>{self.words(1, 2)}</button></div>", 0, 0)
        self.add("</form>")

    def comments(self) -> None:
        tag = self.r.choice(["section", "div", "div", "ol"])
        self.add(f"<{tag}{self.attr('comments', 'comments', 'discussion', 'replies')}>")
        if self.r.random() < 0.7:
            self.add(f"<h2>{self.words(1, 3)}</h2>", 0)
        for _ in range(self.r.randint(1, 4)):
            inner = self.r.choice(["div", "li", "article"])
            self.add(f"<{inner}{self.r.choice(['', self.attr('comment', 'reply')])}><p>{self.prose(1, 5)}</p></{inner}>", 0)
        self.add(f"</{tag}>")

    def share(self) -> None:
        self.add(f"<div{self.attr('share', 'social')}>")
        self.links(self.r.randint(2, 4), self.r.choice(["div", "li"]))
        self.add("</div>")

    def footer(self) -> None:
        tag, a = self.r.choice([("footer", ""), ("footer", ""), ("div", self.attr("footer", "copyright", "legal"))])
        self.add(f"<{tag}{a}>")
        if self.plain and tag == "div":
            self.add(self.r.choice([f"&copy; {self.words(1, 3)}", f"<p>&copy; {self.words(1, 4)} {self.saying('legal', 1, 1)}</p>"]), 0)
        else:
            self.add(self.r.choice([f"&copy; {self.words(1, 3)} &middot; {self.prose(1, 2)}", f"<p>&copy; {self.words(1, 4)}</p>", f"<p>{self.prose(1, 3)}</p>"]), 0)
        if self.r.random() < 0.3:
            self.add("<ul>")
            self.links(self.r.randint(2, 4))
            self.add("</ul>")
        self.add(f"</{tag}>")

    # the article

    def article(self, short: bool = False) -> None:
        opens = self.r.choice([
            ["<article>"], ["<article>"], ["<main>"], ["<main>", "<article>"], [f"<div{self.attr('content', 'post', 'entry-content', 'article', 'story', 'article-body')}>"],
            ["<main>", f"<div{self.attr('content', 'post')}>"], [f"<article{self.attr('post', 'entry')}>"], [f"<section{self.attr('article', 'story')}>"], ["<div>"],
            [f"<div{self.attr('content', 'main')}>", "<article>"],
        ])
        for o in opens:
            self.add(o)
        if self.r.random() < 0.8:
            self.add(f"<h1>{self.words(2, 10).capitalize()}</h1>", 1)
        middle = [self.advert, self.notice, self.form, self.sidebar, self.menu, self.control]
        for _ in range(self.r.randint(1, 5) if short else self.r.randint(2, 14)):
            kind = self.r.random()
            if kind < 0.72:
                text = self.prose(1, 7) if not short or self.r.random() < 0.5 else self.words(1, 6)
                if self.r.random() < 0.08:  # an article may say such words too
                    words = text.split(" ")
                    words.insert(self.r.randrange(len(words)), self.r.choice(CUES[self.r.choice(list(CUES))].split()))
                    text = " ".join(words)
                if self.r.random() < 0.15:
                    words = text.split(" ")
                    words[len(words) // 2] = f'<a href="#">{words[len(words) // 2]}</a>'
                    text = " ".join(words)
                if self.r.random() < 0.06:
                    text = f"{text} {self.icon()}"
                self.add(self.r.choice([f"<p>{text}</p>", f"<p>{text}", f"<p>{text}</p>", f"<p><b>{text}<br>"]), 1)
            elif kind < 0.8:
                self.add(f"<{(h := self.r.choice(['h2', 'h3']))}>{self.words(1, 7).capitalize()}</{h}>", 1)
            elif kind < 0.87:
                n = self.r.randint(2, 5)
                self.add("<ul>" + "".join(f"<li>{self.words(2, 14)}</li>" for _ in range(n)) + "</ul>", *[1] * n)
            elif kind < 0.91:
                self.add(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>", 1)
            elif kind < 0.94:
                n = self.r.randint(2, 6)
                self.add("<table><tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(n)) + "</tr></table>", *[1] * n)
            elif kind < 0.955:
                self.add(f"<div>{self.prose(1, 3)}</div>", 1)
            elif kind < 0.965:
                self.add(f"<noscript><p>{self.prose(2, 5)}</p></noscript>", 1)
            else:
                self.r.choice(middle)()
        inside = not self.plain and self.r.random() < 0.3
        if inside:
            self.r.choice([self.comments, self.comments, self.share])()
        for o in reversed(opens):
            self.add(f"</{o[1:-1].split(' ')[0]}>")
        if not inside and not self.plain and self.r.random() < 0.35:
            self.comments()


def labelled_page(seed: int, plain: bool | None = None) -> tuple[str, list[int]]:
    """A page and the labels (1: main text) of its blocks in page order. plain: whether nothing but tags says what a part is (default: drawn)."""
    p = _Page(seed, plain)
    p.add(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{p.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
    wrap = p.r.random() < 0.3
    if wrap:
        p.add(f'<div id="{p.r.choice(["page", "wrapper", "container", "content"])}">')
    before = [f for f, share in ((p.masthead, 0.4), (p.menu, 0.8), (p.notice, 0.25), (p.advert, 0.4), (p.form, 0.15), (p.sidebar, 0.15), (p.enable, 0.12)) if p.r.random() < share]
    after = [f for f, share in ((p.sidebar, 0.3), (p.advert, 0.2), (p.form, 0.15), (p.notice, 0.15), (p.share, 0.1)) if p.r.random() < share]
    alone = p.r.random() < ALONE
    if alone:
        before, after = [], []
    for f in before:
        f()
    p.article(short=alone or p.r.random() < SHORT)
    for f in after:
        f()
    if not alone and p.r.random() < 0.9:
        p.footer()
    if wrap:
        p.add("</div>")
    if p.r.random() < 0.85:
        p.add("</body></html>")
    return "".join(p.out), p.labels
