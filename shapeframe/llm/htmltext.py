"""Main text of web pages by a linear-chain conditional random field over the DOM's leaf blocks.

A page is read once: tags keep a stack of open block elements, and text between block boundaries is a leaf block. A
block's features are its ancestors' tags, roles and the words of their class and id attributes, its own tag, and its
text (length, share of linked text, closing punctuation). The field has two labels, main text and boilerplate; its
weights are trained by gradient descent on the log-likelihood of labelled pages (``train``), and Viterbi decoding picks
the labels of a page together, so that a doubtful block follows its neighbours.

The labelled pages are generated (``labelled_pages``): articles of invented words in many page designs, with menus,
headers, footers, side columns, notices, adverts, forms and reader comments. Training takes a few seconds on the driver and
is deterministic; the tests measure accuracy on held-out designs.

Text: character references are decoded, white space in a block becomes one space, a line break element counts as
white space, blocks are joined by an empty line. Scripts, styles, templates and the head's title are never text.

Edge cases: null and empty pages, and pages without main text, give the empty string; unclosed and misnested tags are
closed by what follows; an unclosed comment, script, style, title, textarea or iframe runs to the end; the content of
noscript, template, select, svg, object and canvas elements is no text, but one that is self-closed (svg) or has no end
tag in its block takes nothing away; pages of any length are read whole; repeated rows are treated alike; other columns
are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches

#: Elements whose content is not markup: without an end tag they run to the end of the page, as in browsers.
_RAW = "script|style|title|textarea|iframe"
#: Attributes take all up to the tag's end and are never gone back over, so every pass over a page is linear.
_ATTRIBUTES = "(?:[^>\"']++|\"[^\"]*+(?:\"|\\Z)|'[^']*+(?:'|\\Z))*+"
_TAG = rf"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRIBUTES})(>|\Z)"
_OTHER = r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^<>]*+>"
_TOKEN = re.compile(rf"<({_RAW})(?=[\s/>])({_ATTRIBUTES})>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|{_TAG}|{_OTHER}", re.S | re.I)
#: For what follows a tag whose quotes never close: quotes mean nothing, and a tag without an end is text.
_LOOSE = re.compile(rf"<({_RAW})(?=[\s/>])([^<>]*+)>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)(>)|{_OTHER}", re.S | re.I)
#: One tag, in the groups of _TOKEN.
_ONE = re.compile(rf"(?!)()()|{_TAG}", re.S)
#: Open elements that are told apart; elements further in are read, but don't bound or describe what they hold.
MAX_DEPTH = 64
#: Elements whose content is markup and is not text. Without an end tag they hold nothing.
_IGNORED = frozenset("noscript template select svg object canvas".split())
_ANY_IGNORED = re.compile(rf"<(?:{'|'.join(sorted(_IGNORED))})(?=[\s/>])", re.I)
#: Elements that bound blocks.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul head".split())
#: Elements that hold other blocks; a text's container is the innermost of them.
_HOLDS = frozenset("address article aside blockquote body center div dl fieldset figure footer form header li main nav ol section table td th tr ul".split())
_VOID = frozenset(("hr", "br", "img", "input", "meta", "link"))
#: What a start tag closes first, if it is open further in than the second set.
_CLOSES = {
    "li": (frozenset(("li", "p")), frozenset(("ul", "ol", "menu", "dir"))),
    "dd": (frozenset(("dd", "dt", "p")), frozenset(("dl",))),
    "dt": (frozenset(("dd", "dt", "p")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th", "p")), frozenset(("table",))),
    "td": (frozenset(("td", "th", "p")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th", "p")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset()),
}
_P = (frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6")), frozenset(("div", "section", "article", "main", "td", "th", "li", "aside", "nav", "footer", "header", "form", "body", "blockquote", "button")))
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[a-z]+")
_END = frozenset(".!?:;\"')»…”")

Path = tuple[tuple[str, frozenset[str]], ...]
Block = tuple[Path, str, int]


def _words_of(attributes: str) -> frozenset[str]:
    out = set()
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()
        out.update(("role=" if m[1].lower() == "role" else "") + w for w in _PART.findall(value))
    return frozenset(out)


def _scan(page: str) -> Iterator[re.Match[str]]:
    """The tokens of a page. From a tag on whose quotes never close, tags are read without regard to quotes."""
    for m in _TOKEN.finditer(page):
        if m[4] and not m[6]:
            yield from _LOOSE.finditer(page, m.start())
            return
        yield m


def _ignored(page: str) -> tuple[list[re.Match[str]], dict[int, int]]:
    """The page's tokens, and where each ignored element that has an end tag starts and ends.

    An element ends with the block around it; then, as at the end of the page, its start tag alone is passed over.
    """
    tokens: list[re.Match[str]] = []
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    inside: Counter[str] = Counter()
    scan = _TOKEN.finditer(page)
    while m := next(scan, None):
        if m[1] and inside["svg"] and m[2].endswith("/"):  # in a drawing a tag like <title/> has no content
            m = _ONE.match(page, m.start())
            scan = _TOKEN.finditer(page, m.end())
        if m[4] and not m[6]:
            scan = _LOOSE.finditer(page, m.start())
            continue
        tokens.append(m)
        tag = (m[4] or "").lower()
        if (tag not in _IGNORED and tag not in BLOCKS) or m[5][:1] not in " \t\n\r\f/":
            continue
        if not m[3]:
            if tag not in _VOID and not (m[5].endswith("/") and (tag == "svg" or tag in BLOCKS)):
                stack.append((tag, m.start()))
                inside[tag] += 1
        elif inside[tag]:
            while True:
                name, start = stack.pop()
                inside[name] -= 1
                if name == tag:
                    break
            if tag in _IGNORED:
                ends[start] = m.end()
    return tokens, ends


def blocks(page: str) -> list[Block]:
    """(open block elements, text, characters inside links) of each leaf block that has text."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    path: Path = ()
    text: list[str] = []
    linked, links, at, beyond = 0, 0, 0, 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((path, joined, linked))
            text, linked = [], 0

    tokens, ends = _ignored(page) if _ANY_IGNORED.search(page) else (_scan(page), {})
    for m in tokens:
        if m.start() < at:
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            linked += len(piece) if links else 0
        at = ends.get(m.start(), m.end())
        tag = m[4]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append("\n")
        elif tag == "a":
            links = 0 if m[3] else 1
        elif tag in BLOCKS:
            flush()
            links = 0
            if beyond and m[3]:
                beyond -= 1
            elif m[3]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            else:
                closes, inside = _CLOSES.get(tag, _P)
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        del stack[i:]
                        beyond = 0
                    if i < len(stack) and stack[i][0] in inside:
                        break
                if tag in _VOID or m[0].endswith("/>"):
                    pass
                elif len(stack) >= MAX_DEPTH:
                    beyond += 1
                else:
                    stack.append((tag, _words_of(m[5]) if "=" in m[5] else frozenset()))
            path = tuple(stack)
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


@lru_cache(100_000)
def path_features(path: Path) -> tuple[str, ...]:
    own = path[-1][0] if path else "none"
    found = {f"own={own}"}
    for tag, words in path:
        found.add(f"in={tag}")
        found.update(f"word={w}" for w in words)
    if path:
        found.update(f"own_word={w}" for w in path[-1][1])
    return tuple(sorted(found))


def text_features(text: str, linked: int) -> tuple[str, ...]:
    size = _size(text.count(" ") + 1)
    share = linked / max(1, len(text))
    link = "none" if share == 0 else "some" if share < 0.4 else "most" if share < 0.9 else "all"
    return (f"size={size}", f"link={link}", f"end={text[-1] in _END}", f"link={link},size={size}", *(("sign",) if "©" in text or "®" in text or "·" in text else ()))


def _size(n: int) -> str:
    return "1" if n < 3 else "3" if n < 8 else "8" if n < 20 else "20" if n < 50 else "50"


def place_features(page: list[Block]) -> list[tuple[str, ...]]:
    """What a block's neighbours and its container tell: for pages whose tags and names tell nothing."""
    words = [t.count(" ") + 1 for _, t, _ in page]
    plain = [max(0, len(t) - k) for _, t, k in page]
    full = [len(t) for _, t, _ in page]
    inside: Counter[Path] = Counter()
    holders = [path if path and path[-1][0] in _HOLDS else path[:-1] for path, _, _ in page]
    for h, n in zip(holders, plain, strict=True):
        inside[h] += n
    whole, out = max(1, sum(plain)), []
    for i in range(len(page)):
        a, z = max(0, i - 2), min(len(page), i + 3)
        share = 1 - sum(plain[a:z]) / max(1, sum(full[a:z]))
        link = "none" if share < 0.05 else "some" if share < 0.4 else "most"
        held = inside[holders[i]] / whole
        holder = "half" if held >= 0.5 else "fifth" if held >= 0.2 else "bit" if held >= 0.05 else "none"
        before, after = (_size(words[i - 1]) if i else "edge"), (_size(words[i + 1]) if i + 1 < len(page) else "edge")
        out.append((f"near_link={link}", f"holder={holder}", f"before={before}", f"after={after}", f"holder={holder},size={_size(words[i])}", f"near_link={link},holder={holder}"))
    return out


class Field:
    """Weights of the chain: by feature and label, by label pair, and by first and last label. Label 1 is main text."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: np.ndarray, ends: np.ndarray):
        self.weights, self.moves, self.ends = weights, moves, ends
        self.paths: dict[Path, tuple[float, float]] = {}

    def emission(self, block: Block, place: tuple[str, ...]) -> tuple[float, float]:
        path, text, linked = block
        known = self.paths.get(path)
        if known is None:
            found = [self.weights[f] for f in path_features(path) if f in self.weights]
            known = (sum(w[0] for w in found), sum(w[1] for w in found))
            if len(self.paths) < 100_000:
                self.paths[path] = known
        a, b = known
        for f in (*text_features(text, linked), *place):
            w = self.weights.get(f)
            if w:
                a, b = a + w[0], b + w[1]
        return a, b

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi: the likeliest labels of a page's blocks."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        (s0, s1), (e0, e1) = self.ends.tolist()
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for i, (block, place) in enumerate(zip(page, place_features(page), strict=True)):
            x, y = self.emission(block, place)
            if not i:
                a, b = s0 + x, s1 + y
                continue
            to0 = (0, a + m00) if a + m00 >= b + m10 else (1, b + m10)
            to1 = (0, a + m01) if a + m01 > b + m11 else (1, b + m11)
            back.append((to0[0], to1[0]))
            a, b = to0[1] + x, to1[1] + y
        if not page:
            return []
        labels = [0 if a + e0 >= b + e1 else 1]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def _either(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 25, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Maximum likelihood by stochastic gradients with per-weight step sizes; forward and backward sums give the expectations."""
    pages = [p for p in pages if p[0]]
    told = [[(*path_features(p), *text_features(t, k), *place) for (p, t, k), place in zip(bs, place_features(bs), strict=True)] for bs, _ in pages]
    names = {f: i for i, f in enumerate(sorted({f for page in told for found in page for f in found}))}
    coded = [([np.array([names[f] for f in found]) for found in page], np.array(ys)) for page, (_, ys) in zip(told, pages, strict=True)]
    w, moves, ends = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros((2, 2))
    gw, gm, ge = np.full_like(w, 1e-2), np.full_like(moves, 1e-2), np.full_like(ends, 1e-2)
    order = random.Random(11)
    for _ in range(rounds):
        order.shuffle(coded)
        for xs, ys in coded:
            n = len(xs)
            emit = np.array([w[x].sum(0) for x in xs])
            (m00, m01), (m10, m11) = moves.tolist()
            scores = emit.tolist()
            forward, backward = [(ends[0, 0] + scores[0][0], ends[0, 1] + scores[0][1])], [(ends[1, 0], ends[1, 1])]
            for x, y in scores[1:]:
                p, q = forward[-1]
                forward.append((x + _either(p + m00, q + m10), y + _either(p + m01, q + m11)))
            for x, y in scores[:0:-1]:
                p, q = backward[-1][0] + x, backward[-1][1] + y
                backward.append((_either(m00 + p, m01 + q), _either(m10 + p, m11 + q)))
            alpha, beta = np.array(forward), np.array(backward[::-1])
            total = np.logaddexp.reduce(alpha[-1] + beta[-1])
            error = -np.exp(alpha + beta - total)
            error[np.arange(n), ys] += 1
            d_moves, d_ends = np.zeros((2, 2)), np.zeros((2, 2))
            if n > 1:
                pair = np.exp(alpha[:-1, :, None] + moves[None] + (emit[1:] + beta[1:])[:, None, :] - total)
                d_moves -= pair.sum(0)
                np.add.at(d_moves, (ys[:-1], ys[1:]), 1)
            d_ends[0], d_ends[1] = error[0], error[-1]
            at = np.concatenate(xs)
            d = np.zeros_like(w)
            np.add.at(d, at, np.repeat(error, [len(x) for x in xs], axis=0))
            at = np.unique(at)
            d = d[at] - decay * w[at]
            gw[at] += d * d
            w[at] += rate * d / np.sqrt(gw[at])
            for v, g, dv in ((moves, gm, d_moves), (ends, ge, d_ends)):
                g += dv * dv
                v += rate * dv / np.sqrt(g)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, moves, ends)


# Labelled pages -----------------------------------------------------------------------------------------------------

MAIN, OFF = "\u0001", "\u0002"  # marks in front of generated texts; removed after labelling


class _Writer:
    """Writes one random page. Every text is marked with its label."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        # Some designs tell nothing by tags or names, some are laid out in tables.
        self.telling, self.table = self.r.random() < 0.65, self.r.random() < 0.1
        self.parts = ["".join(self.r.choice("bcdfglmnprstvz") + self.r.choice("aeiou") for _ in range(self.r.randint(1, 3))) for _ in range(200)]

    def say(self, low: int, high: int, mark: str, stop: str = ".") -> str:
        words = [self.r.choice(self.parts) for _ in range(self.r.randint(low, high))]
        words = [f"<b>{x}</b>" if self.r.random() < 0.02 else f'<a href="/x">{x}</a>' if self.r.random() < 0.02 and mark == MAIN else x for x in words]
        return mark + " ".join(words).capitalize() + stop

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def maybe(self, p: float, text: str) -> str:
        return text if self.r.random() < p else ""

    def box(self, tags: tuple[str, ...], names: tuple[str, ...], inner: str, plain: float = 0.15) -> str:
        if not self.telling:
            tag = self.r.choice(("div", "div", "div", "section", "center"))
            return f"<{tag}{self.maybe(0.5, ' class=' + chr(34) + self.pick('row', 'c1', 'col', 'inner', 'css-x1', 'block', 'wrap', 'box') + chr(34))}>{inner}</{tag}>"
        tag = self.r.choice(tags)
        name = self.r.choice(names) if names else ""
        if tag in ("div", "section", "ul", "td", "p", "ol", "span") or self.r.random() > 0.5:
            attribute = f' {self.r.choice(("class", "id"))}="{name}{self.maybe(0.2, "-" + str(self.r.randint(1, 9)))}"' if name and self.r.random() > (0 if tag in ("div", "section", "td") else plain) else ""
        else:
            attribute = ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<li><a href="/y">{self.say(1, 4, OFF, "")}</a></li>' for _ in range(self.r.randint(low, high))]
        return "<ul>" + "".join(items) + "</ul>" if self.r.random() < 0.8 else self.pick(" ", "<br>", " | ").join(re.sub("</?li>", "", x) for x in items) if self.r.random() < 0.7 else "".join(x.replace("li>", "div>") for x in items)

    def menu(self) -> str:
        return self.box(("nav", "div", "header"), ("nav", "menu", "main-menu", "navbar", "navigation", "topnav", "breadcrumbs"), self.links(3, 9))

    def header(self) -> str:
        return self.box(("header", "div"), ("header", "site-header", "masthead", "top", "banner", "branding"), self.pick(f"<h1>{self.say(1, 4, OFF, '')}</h1>", f"<a href='/'>{self.say(1, 3, OFF, '')}</a>", "") + f"<p>{self.say(3, 10, OFF)}</p>" + self.maybe(0.4, self.menu()))

    def footer(self) -> str:
        return self.box(("footer", "div"), ("footer", "site-footer", "bottom", "copyright", "colophon"), self.pick(f"{OFF}&copy; {self.say(2, 8, '', '')} &middot; {self.say(2, 14, '')}", f"<p>{self.say(4, 25, OFF)}</p>" + self.links(2, 5), f"<p>{OFF}&copy; 2020 {self.say(1, 5, '', '')}</p>"))

    def aside(self) -> str:
        inner = f"<h3>{self.say(1, 4, OFF, '')}</h3>" + self.pick(self.links(3, 8), f"<p>{self.say(5, 40, OFF)}</p>", f"<p>{self.say(5, 20, OFF)}</p>" + self.links(2, 5))
        return self.box(("aside", "div", "section", "td"), ("sidebar", "side", "widget", "related", "recent-posts", "popular", "left-column", "tags", "share", "social", "author-box", "recommended"), inner)

    def notice(self) -> str:
        inner = self.pick(self.say(5, 30, OFF), f"<p>{self.say(5, 30, OFF)}</p>") + self.maybe(0.5, f"<button>{self.say(1, 2, OFF, '')}</button>")
        return self.box(("div", "section", "aside", "dialog", "p"), ("notice", "cookie-notice", "cookie-banner", "cookies", "consent", "gdpr", "alert", "popup", "modal", "warning", "paywall", "site-notice", "message-bar", "info-banner"), inner, 0)

    def advert(self) -> str:
        inner = self.pick(self.say(3, 20, OFF), f"<p>{self.say(3, 25, OFF)}</p>", f'<a href="/z">{self.say(2, 10, OFF)}</a>')
        return self.box(("div", "aside", "section", "ins"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-box", "banner-ad", "adsbygoogle", "sponsor", "promotion"), inner, 0)

    def form(self) -> str:
        inner = f"<label>{self.say(1, 3, OFF, '')}</label><input name='q'><button>{self.say(1, 2, OFF, '')}</button>" + self.maybe(0.5, f"<p>{self.say(4, 20, OFF)}</p>")
        return self.maybe(0.3, "<div class='newsletter'>") + f"<form{self.maybe(0.5, ' class=' + chr(34) + self.pick('search', 'login', 'subscribe', 'newsletter', 'signup', 'contact-form') + chr(34))}>{inner}</form>"

    def comments(self) -> str:
        one = lambda: self.box(("div", "li", "article", "p"), ("comment", "comment-body", "reply", "comment-text", "response"), self.pick(self.say(4, 60, OFF), f"<p>{self.say(4, 60, OFF)}</p>", f"<b>{self.say(1, 2, OFF, '')}</b><p>{self.say(5, 60, OFF)}</p>"))
        return self.box(("section", "div", "ol", "ul"), ("comments", "comment-list", "responses", "discussion", "disqus-thread", "reader-comments", "replies", "user-comments"), self.maybe(0.6, f"<h2>{self.say(1, 3, OFF, '')}</h2>") + "".join(one() for _ in range(self.r.randint(1, 6))), 0)

    def article(self) -> str:
        part = "div" if not self.telling and self.r.random() < 0.5 else "p"
        close = f"</{part}>" if part == "div" else self.maybe(0.9, "</p>")
        out = []
        for i in range(self.r.randint(1, 10)):
            kind = self.r.random()
            if kind < 0.75:
                out.append(f"<{part}>{self.maybe(0.1, '<b>')}{self.say(1, self.pick_size(), MAIN)}{self.maybe(0.1, '<br>')}{close}")
            elif kind < 0.85:
                out.append(f"<{self.pick('h2', 'h3')}>{self.say(1, 7, MAIN, '')}</h2>".replace("</h2>", f"</{'h2'}>"))
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{self.say(2, 20, MAIN)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif kind < 0.93:
                out.append(f"<blockquote><p>{self.say(5, 40, MAIN)}</p></blockquote>")
            elif kind < 0.96:
                out.append(f"<pre>{self.say(4, 20, MAIN, '')}</pre>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{self.say(1, 4, MAIN, '')}</td><td>{self.say(1, 6, MAIN, '')}</td></tr>" for _ in range(self.r.randint(1, 4))) + "</table>")
            if i and self.r.random() < 0.12:
                out.append(self.pick(self.advert(), self.notice(), self.form(), self.aside()))
        title = "div" if part == "div" and self.r.random() < 0.5 else "h1"
        head = self.maybe(0.85, f"<{title}>{self.say(2, 10, MAIN, self.pick('', '.'))}</{title}>")
        head = f"<header>{head}</header>" if head and self.r.random() < 0.15 else head
        contents = f"<{self.pick('p', 'h2', 'b')}>{self.say(1, 2, OFF, '')}</p>" + "<ul>" + "".join(f'<li><a href="#{i}">{self.say(1, 5, OFF, "")}</a></li>' for i in range(self.r.randint(3, 9))) + "</ul>"
        contents = self.box(("div", "nav"), ("toc", "contents", "table-of-contents"), contents)
        body = head + self.maybe(0.12, contents) + "".join(out) + self.maybe(0.15, self.comments())
        body = self.box(("article", "article", "main", "div", "section"), ("content", "article", "post", "post-content", "entry-content", "article-body", "story", "main", "text", "body-text", "main-content"), body)
        return self.box(("main", "div"), ("main", "content", "container", "wrapper", "page"), body) if self.r.random() < 0.4 else body

    def pick_size(self) -> int:
        return self.r.choice((4, 12, 30, 80, 120))

    def page(self) -> str:
        before = [f() for f in (self.header, self.menu, self.notice, self.advert, self.form, self.aside) if self.r.random() < 0.45]
        after = [f() for f in (self.comments, self.aside, self.advert, self.form, self.notice, self.menu, self.footer) if self.r.random() < 0.4]
        self.r.shuffle(before)
        if self.table:
            cells = [*before[:2], self.article(), *after[:1]]
            row = "<table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table>"
            return "<html><body>" + "".join(before[2:]) + row + self.maybe(0.7, f"<{self.pick('div', 'p', 'center')}>{OFF}&copy; 2019 {self.say(1, 6, '', '')}</div>") + "</body></html>"
        return "<html><head><title>t</title></head><body>" + "".join(before) + self.article() + "".join(after) + self.maybe(0.9, "</body></html>")


def labelled_pages(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    out = []
    for i in range(n):
        bs = blocks(_Writer(seed + i).page())
        out.append(([(p, t.replace(MAIN, "").replace(OFF, ""), k) for p, t, k in bs if t.strip(MAIN + OFF)], [int(MAIN in t) for p, t, k in bs if t.strip(MAIN + OFF)]))
    return out


@lru_cache(1)
def trained(pages: int = 500, seed: int = 1) -> Field:
    return train(labelled_pages(pages, seed))


def main_text(field: Field, page: str) -> str:
    bs = blocks(page)
    return "\n\n".join(b[1] for b, y in zip(bs, field.decode(bs), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, a row for each page."""
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(field, page.as_py() or "") for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col)).transform(over_batches, run, "page_id long, url string, text string, n_chars long")
