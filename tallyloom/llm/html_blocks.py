"""Leaf blocks of an HTML page: text between block boundaries, with features of its ancestors, its neighbours and its own.

Pages say what a block is by tags and by names of classes, but not all do: how much of a block, of its container and of
the blocks beside it is links, controls of forms, and words that notices, adverts, forms and footers use speak where
nothing else does.

A tolerant single pass: comments, declarations, scripts, styles and the head's title are no text; inline elements
do not break a block; start tags close what cannot stay open (a paragraph, a list item, a table cell), but a start tag
within an element whose content is no text closes nothing outside of that; end tags without an open element are
ignored. An unterminated tag, comment, script or style ends the page; another element of raw text that never ends
(a title, a text area, a frame) is passed over and the page goes on. What stands in `noscript` is text as elsewhere.
Time is linear in the page.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style template title textarea iframe object svg math canvas audio video".split())
#: Silent elements whose content is not markup: it ends only at their own end tag.
RAW = frozenset("script style title textarea iframe".split())
#: What may stand in a head: any other start tag ends it.
HEAD = frozenset("base link meta noscript script style template title".split())
#: What a start tag closes, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
TAGS = frozenset("article main section nav header footer aside form ul ol li dl table td div p h1 h2 h3 h4 blockquote pre figure figcaption button select option details dialog address fieldset noscript".split())
#: Words of class, id and role attributes, by what they hint at. A word counts if it is one of these or starts with one that ends in *.
HINTS = {
    "content": "article content contents post entry story main body text prose copy paragraph blog page read",
    "nav": "nav navbar navigation menu menubar breadcrumb* crumbs pagination pager toc tabs topnav skip",
    "header": "header masthead topbar branding logo hero tagline",
    "footer": "footer copyright legal colophon bottom imprint",
    "side": "sidebar side aside widget* rail complementary secondary related recommend* popular trending more",
    "ad": "ad ads adv advert* sponsor* promo* banner* adsense commercial teaser",
    "notice": "cookie* consent notice alert popup modal overlay gdpr privacy warning disclaimer announcement message toast banner*",
    "comment": "comment* discussion disqus reply replies respond feedback review reviews reader",
    "form": "form search login signup subscribe newsletter register contact poll",
    "share": "share sharing social follow tweet like",
}
#: Words of a text that hint at what it is.
CUES = {
    "notice": "cookie cookies consent gdpr privacy accept reject agree decline preferences zustimmen akzeptieren ablehnen datenschutz accepter refuser aceptar rechazar",
    "ad": "advertisement advert sponsored sponsor promoted promotion anzeige werbung",
    "form": "subscribe newsletter password username login signup submit search email",
    "share": "share tweet facebook twitter linkedin whatsapp instagram follow",
    "comment": "reply replies comment comments commented",
    "legal": "copyright rights reserved terms imprint impressum disclaimer",
}
_CUES = {w: g for g, words in CUES.items() for w in words.split()}
_LETTERS = re.compile(r"[a-z]+")
#: Elements that are worked, not read.
CONTROLS = frozenset("select option optgroup datalist button label legend".split())
_EXACT = {w: g for g, words in reversed(HINTS.items()) for w in words.split() if not w.endswith("*")}
_STARTS = [(w[:-1], g) for g, words in HINTS.items() for w in words.split() if w.endswith("*")]
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
_SENTENCE = re.compile(r"[.!?](?:\s|$)")


@dataclass
class Block:
    text: str
    features: list[str]


def hints(attributes: str) -> list[str]:
    out: dict[str, None] = {}
    for m in _ATTR.finditer(attributes):
        for w in _SPLIT.split(m[2] or m[3] or m[4] or ""):
            w = w.lower()
            if g := _EXACT.get(w) or next((g for s, g in _STARTS if w.startswith(s)), None):
                out[g] = None
    return list(out)


@dataclass
class _Frame:
    tag: str
    seen: frozenset
    inner: str
    silent: str  # the outermost element around whose content is no text, or ''


class _Parser:
    def __init__(self, page: str):
        self.page = page
        self.stack = [_Frame("", frozenset(), "none", "")]
        self.open: dict[str, int] = {}
        self.blocks: list[tuple[str, int, _Frame, _Frame, bool]] = []  # text, linked characters, innermost element and its container, whether a control
        self.pieces: list[str] = []
        self.linked = 0
        self.home: _Frame | None = None
        self.around, self.control = self.stack[0], False

    def flush(self) -> None:
        if self.pieces:
            raw = "".join(self.pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                self.blocks.append((text, self.linked, self.home, self.around, self.control))
        self.pieces, self.linked, self.home = [], 0, None

    def text(self, a: int, b: int) -> None:
        if a < b and not self.stack[-1].silent:
            piece = self.page[a:b]
            if self.home is None:
                if not piece.strip():
                    return
                outer = (f for f in reversed(self.stack) if f.tag not in INLINE)
                self.home = next(outer)
                self.around = next(outer, self.home)
                self.control = any(map(self.open.get, CONTROLS))
            self.pieces.append(piece)
            if self.open.get("a"):
                self.linked += b - a

    def push(self, tag: str, attributes: str) -> None:
        up = self.stack[-1]
        own = hints(attributes) if attributes and tag not in INLINE else []
        new = [f"tag:{tag}"] if tag in TAGS else []
        new += [f"hint:{g}" for g in own]
        inner = own[-1] if own else tag if tag in ("nav", "header", "footer", "aside", "form", "article", "main") else up.inner
        if own and len(own) > 1 and "content" in own:
            inner = next(g for g in own if g != "content")
        seen = up.seen.union(new) if new else up.seen
        self.stack.append(_Frame(tag, seen, inner, up.silent or (tag if tag in SILENT or tag == "head" else "")))
        self.open[tag] = self.open.get(tag, 0) + 1

    def pop(self) -> None:
        f = self.stack.pop()
        self.open[f.tag] -= 1

    def close(self, tag: str) -> None:
        if self.open.get(tag):
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()

    def start(self, tag: str, attributes: str) -> None:
        silent = self.stack[-1].silent
        if silent == "head" and tag not in HEAD:
            self.close("head")
        elif silent or tag in SILENT:  # closes nothing and breaks no block
            if tag not in VOID and not (attributes.endswith("/") and (silent in ("svg", "math") or tag in ("svg", "math"))):
                self.push(tag, attributes)
            return
        if tag in INLINE:
            if tag != "wbr":
                self.push(tag, attributes)
            return
        self.flush()
        if tag in VOID:
            return
        if self.open.get("p"):
            self.close("p")
        if tag in CLOSES:
            what, until = CLOSES[tag]
            if any(self.open.get(w) for w in what):
                for i in range(len(self.stack) - 1, 0, -1):
                    t = self.stack[i].tag
                    if t in until:
                        break
                    if t in what:
                        while len(self.stack) > i:
                            self.pop()
        self.push(tag, attributes)

    def run(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        unquoted = {'"': n + 1, "'": n + 1}  # no such quote from here on
        unended: set[str] = set()  # elements of raw text that do not end from here on
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self.text(at, n)
                break
            self.text(at, lt)
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            m = _NAME.match(page, lt)
            if not m:
                if page.startswith(("<!", "<?", "</"), lt):
                    end = page.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self.text(lt, lt + 1)
                    at = lt + 1
                continue
            gt, look = page.find(">", m.end()), m.end()
            while gt >= 0:  # a > within quotes does not end the tag
                quotes = [q for c in "\"'" if look < unquoted[c] and 0 <= (q := page.find(c, look, gt))]
                if not quotes:
                    break
                q = min(quotes)
                shut = page.find(page[q], q + 1)
                if shut < 0:
                    unquoted[page[q]] = q
                    break
                look = shut + 1
                if shut > gt:
                    gt = page.find(">", shut)
            if gt < 0:
                break
            tag, at = m[1].lower(), gt + 1
            if page[lt + 1] == "/":
                if tag not in INLINE and not self.stack[-1].silent:
                    self.flush()
                self.close(tag)
                continue
            attributes = page[m.end() : gt]
            if tag in RAW:
                end = None if tag in unended else _ENDS[tag].search(page, at)
                if end:
                    gt = page.find(">", end.end())
                    at = n if gt < 0 else gt + 1
                elif tag in ("script", "style"):
                    break
                else:
                    unended.add(tag)
                continue
            self.start(tag, attributes)
        self.flush()


#: Shares of links that are told apart.
_LINKED = (0.01, 0.35, 0.8)


def _bin(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    parser = _Parser(page)
    parser.run()
    total = len(parser.blocks)
    shares: dict[int, list[int]] = {}  # of each container: characters, linked ones, blocks
    for text, linked, _, around, _ in parser.blocks:
        one = shares.setdefault(id(around), [0, 0, 0])
        one[:] = one[0] + len(text), one[1] + linked, one[2] + 1
    links = [_bin(linked / len(text), _LINKED) for text, linked, *_ in parser.blocks]
    out = []
    for i, (text, _, home, around, control) in enumerate(parser.blocks):
        n = len(text)
        chars, linked, members = shares[id(around)]
        f = ["bias", *home.seen, f"inner:{home.inner}", f"own:{home.tag if home.tag in TAGS else 'other'}"]
        f.append(f"inner+own:{home.inner}+{home.tag if home.tag in ('p', 'li', 'h1', 'h2', 'h3', 'div', 'td', 'blockquote', 'pre') else 'other'}")
        f.append(f"chars:{_bin(n, (10, 25, 60, 120, 250))}")
        f.append(f"links:{links[i]}")
        f.append(f"group:{_bin(linked / chars, _LINKED)}+{min(members, 3)}")
        f.append(f"before:{links[i - 1] if i else 0}")
        f.append(f"after:{links[i + 1] if i + 1 < total else 0}")
        f.append(f"sentences:{min(3, len(_SENTENCE.findall(text)))}")
        f.append(f"place:{5 * i // max(total, 1)}")
        if control:
            f.append("control")
        said: dict[str, set[str]] = {}
        for w in _LETTERS.findall(text.lower()):
            if g := _CUES.get(w):
                said.setdefault(g, set()).add(w)
        for g, words in said.items():
            f.append(f"says:{g}:{min(3, len(words))}")
            f.append(f"says+chars:{g}:{_bin(n, (25, 120, 250))}")
        if "©" in text or "(c)" in text.lower():
            f.append("copyright")
        if text[-1] in ".!?…»”\"":
            f.append("ends")
        out.append(Block(text, f))
    return out
