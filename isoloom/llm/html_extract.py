"""Main text of web pages: a recurrent labeller over the sequence of a page's leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, with the path of open
elements, their class and id words, and the share of link text. Each block is a vector of hashed
path words, hashed text words and a few sizes. A bidirectional LSTM in numpy reads the whole
sequence both ways, so every block is judged in the light of all others, and says which belong to
the article. It is trained when first needed, from a fixed seed, on pages composed here, whose
labels are known by construction: articles in many containers between menus, headers, notices,
adverts, sidebars, forms, reader comments and footers.

Defined results: a null or empty page, or one without text, gives an empty text; unclosed and
misnested tags are closed as they are met; text outside any element is a block like others;
scripts, styles, comments and the head never give blocks; pages of any length are read whole;
equal pages get equal texts; a null page_id or url is kept; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import html
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.runtime import prepare

# ---- pages to blocks ----

#: Elements that begin and end a block. Fixed values.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is never shown as text of the page. Fixed values.
HIDDEN = frozenset("script style noscript template iframe svg math object head title select textarea button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is raw until their end tag.
RAW = frozenset("script style textarea title noscript iframe".split())
_ENDS = {tag: re.compile(rf"</{tag}", re.I) for tag in RAW}
#: What closes an open paragraph or item of the same kind.
KEEPS = frozenset(("ul", "ol", "dl", "table", "div", "article"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}

#: A tag: closing stroke, name, attributes. A bare '<' ends the attempt, so scanning is linear in the page.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:[^>"'<]++|"[^"]*+"|'[^']*+')*+)>""")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^\W_]+")
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Path:
    """The open elements above a block, each (tag, name words...), sharing what is above with its neighbours."""

    __slots__ = ("above", "depth", "element", "slots", "words")

    def __init__(self, above: Path | None, element: tuple[str, ...]):
        self.above, self.element = above, element
        self.depth = above.depth + 1 if above else 1
        new = {f"<{element[0]}", *element[1:]}
        self.words = above.words | new if above and not new <= above.words else above.words if above else frozenset(new)
        inner = {f"in<{element[0]}", *(f"in.{w}" for w in element[1:])}
        self.slots = tuple({_slot(w, PATH_SIZE, salt) for w in self.words | inner for salt in (7, 77)})


def path_of(elements: list[tuple[str, ...]]) -> Path | None:
    out = None
    for e in elements:
        out = Path(out, e)
    return out


def _tokens(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """(start, end, tag or None) of each piece of markup; a raw element's content is skipped by the caller through send()."""
    at, n = 0, len(page)
    while (at := page.find("<", at)) >= 0:
        start, m = at, None
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at + 2)
            if end < 0:
                return
            at = end + 1
        elif m := _TAG.match(page, at):
            at = m.end()
        else:
            at += 1
            continue
        at = (yield start, at, m) or at


def blocks(page: str) -> list[tuple[str, Path | None, float]]:
    """(text, path, share of link text) of each leaf block."""
    out: list[tuple[str, Path | None, float]] = []
    top: Path | None = None
    parts: list[str] = []
    opened: dict[str, int] = {}
    linked, in_link, hidden = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, top, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def pop() -> str:
        nonlocal top, hidden
        tag = top.element[0]
        opened[tag] -= 1
        hidden -= tag in HIDDEN
        top = top.above
        return tag

    def said(start: int, end: int) -> None:
        nonlocal linked
        if end > start and not hidden:
            parts.append(page[start:end])
            linked += (end - start) * in_link

    tokens, at = _tokens(page), 0
    token = next(tokens, None)
    while token:
        start, end, m = token
        said(at, start)
        at = end
        if m is None:
            token = next(tokens, None)
            continue
        tag, resume = m[2].lower(), None
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag in BLOCKS or tag in HIDDEN:
                flush()
                while opened.get(tag) and pop() != tag:
                    pass
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in BLOCKS or tag in HIDDEN:
            flush()
            if tag in BLOCKS and top and top.element[0] == "p":
                pop()
            ends = CLOSES.get(tag, ())
            if any(opened.get(x) for x in ends):
                place, passed = top, 0
                while place and place.element[0] not in ends and place.element[0] not in KEEPS:
                    place, passed = place.above, passed + 1
                if place and place.element[0] in ends:
                    for _ in range(passed + 1):
                        pop()
            if not (m[3].endswith("/") and tag in HIDDEN):
                names = [w.lower() for x in _NAMED.finditer(m[3]) for w in _WORD.findall(_CASE.sub(" ", x[2] or x[3] or x[4] or ""))] if m[3] else []
                while tag == "body" and top:
                    pop()
                top = Path(top, (tag, *names))
                opened[tag] = opened.get(tag, 0) + 1
                hidden += tag in HIDDEN
                if tag in RAW:
                    stop = _ENDS[tag].search(page, at)
                    resume = at = stop.start() if stop else len(page)
        try:
            token = tokens.send(resume) if resume is not None else next(tokens)
        except StopIteration:
            token = None
    said(at, len(page))
    flush()
    return out


# ---- blocks to vectors ----

PATH_SIZE, WORD_SIZE, LEAD_SIZE, SIZES = 96, 24, 24, 8
SIZE = PATH_SIZE + WORD_SIZE + LEAD_SIZE + SIZES
#: First words of a block that are hashed once more by themselves: parts of pages often show at their beginning what they are.
LEAD = 8


@lru_cache(maxsize=1 << 16)
def _slot(word: str, size: int, salt: int) -> int:
    return zlib.crc32(word.encode(), salt) % size


def vectors(found: list[tuple[str, Path | None, float]]) -> np.ndarray:
    """One row per block: a path's words (tags, names, the innermost ones by themselves), text words, sizes."""
    x = np.zeros((len(found), SIZE), np.float32)
    at, rows = [], []
    for i, (text, path, linked) in enumerate(found):
        slots = path.slots if path else ()
        at.extend(slots)
        rows.extend([i] * len(slots))
        words = text.lower().split()
        for part, start, width in ((words, PATH_SIZE, WORD_SIZE), (words[:LEAD], PATH_SIZE + WORD_SIZE, LEAD_SIZE)):
            share = 1 / max(3, len(part))
            for w in part:
                x[i, start + _slot(w, width, 3)] += share
        size = len(text)
        x[i, PATH_SIZE + WORD_SIZE + LEAD_SIZE :] = (min(1.0, size / 400), min(1.0, size / 60), linked, text[-1] in ".!?", i / len(found), i == 0, (path.depth if path else 0) / 10, "\u00a9" in text)
    x[rows, at] = 1
    return x


# ---- the network ----


class Lstm:
    """Two LSTM layers side by side, one for each direction, and a logistic unit over both states."""

    def __init__(self, size: int, hidden: int, seed: int):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        make = lambda *s: (r.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"c{d}"] = make(size, 4 * hidden), make(hidden, 4 * hidden), np.zeros(4 * hidden, np.float32)
            self.p[f"c{d}"][hidden : 2 * hidden] = 1
        self.p["o"], self.p["b"] = make(2 * hidden), np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """x: (steps, batch, size). States of every step, and what going back needs."""
        h = self.hidden
        steps, batch, _ = x.shape
        pre = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        u = self.p[f"u{d}"]
        state = cell = np.zeros((batch, h), np.float32)
        states, tape = np.zeros((steps, batch, h), np.float32), []
        for t in range(steps):
            z = pre[t] + state @ u
            s = 1 / (1 + np.exp(-z[:, : 3 * h]))
            g = np.tanh(z[:, 3 * h :])
            i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            before, cell = cell, f * cell + i * g
            tc = np.tanh(cell)
            if keep:
                tape.append((state, before, i, f, o, g, tc))
            state = o * tc
            states[t] = state
        return states, tape

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """x: (batch, steps, size), rows beyond `lengths` zero. Logits (batch, steps)."""
        steps = x.shape[1]
        turn = np.where(np.arange(steps) < lengths[:, None], lengths[:, None] - 1 - np.arange(steps), np.arange(steps))
        xf = x.transpose(1, 0, 2)
        xb = np.take_along_axis(x, turn[:, :, None], 1).transpose(1, 0, 2)
        sf, tf = self._run(xf, "f", keep)
        sb, tb = self._run(xb, "b", keep)
        back = np.take_along_axis(sb.transpose(1, 0, 2), turn[:, :, None], 1)
        both = np.concatenate([sf.transpose(1, 0, 2), back], axis=2)
        logits = both @ self.p["o"] + self.p["b"]
        return logits, (xf, xb, turn, both, tf, tb)

    def _back(self, x: np.ndarray, ds: np.ndarray, tape: list, d: str, grads: dict) -> None:
        h = self.hidden
        dz = np.zeros((len(tape), ds.shape[1], 4 * h), np.float32)
        dh = dc = np.zeros(ds.shape[1:], np.float32)
        gu = np.zeros_like(self.p[f"u{d}"])
        for t in range(len(tape) - 1, -1, -1):
            state, before, i, f, o, g, tc = tape[t]
            dh = dh + ds[t]
            dc = dc + dh * o * (1 - tc * tc)
            z = dz[t]
            z[:, :h] = dc * g * i * (1 - i)
            z[:, h : 2 * h] = dc * before * f * (1 - f)
            z[:, 2 * h : 3 * h] = dh * tc * o * (1 - o)
            z[:, 3 * h :] = dc * i * (1 - g * g)
            gu += state.T @ z
            dh = z @ self.p[f"u{d}"].T
            dc = dc * f
        grads[f"u{d}"] = gu
        grads[f"w{d}"] = np.tensordot(x, dz, ((0, 1), (0, 1)))
        grads[f"c{d}"] = dz.sum(axis=(0, 1))

    def gradients(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> dict:
        logits, (xf, xb, turn, both, tf, tb) = self.forward(x, lengths, keep=True)
        inside = np.arange(x.shape[1]) < lengths[:, None]
        d = np.where(inside, 1 / (1 + np.exp(-logits)) - y, 0).astype(np.float32) / inside.sum()
        grads = {"o": np.tensordot(d, both, ((0, 1), (0, 1))), "b": np.array([d.sum()], np.float32)}
        ds = d[:, :, None] * self.p["o"]
        self._back(xf, ds[:, :, : self.hidden].transpose(1, 0, 2), tf, "f", grads)
        back = np.take_along_axis(ds[:, :, self.hidden :], turn[:, :, None], 1)
        self._back(xb, back.transpose(1, 0, 2), tb, "b", grads)
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), max(1, lengths.max()), SIZE), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
    return x, lengths


# ---- pages to train on ----

#: Names that authors give to parts of pages. Fixed values.
NAMES = {
    "menu": "nav menu navbar navigation main-menu breadcrumb breadcrumbs topnav links skip mw-navigation toc",
    "head": "header site-header masthead topbar logo branding banner tagline",
    "ad": "ad ads advert advertisement sponsored promo adsense banner-ad dfp ad-slot",
    "side": "sidebar side widget related related-posts recommended popular trending aside recent tags",
    "notice": "cookie cookies cookie-banner notice consent gdpr alert privacy-notice popup modal",
    "form": "form search search-form newsletter subscribe signup login contact-form",
    "comments": "comments comment comment-list reader-comments discussion responses replies disqus",
    "foot": "footer site-footer copyright colophon bottom legal credits",
    "share": "share social sharing share-buttons follow pagination pager",
    "body": "content article post entry entry-content post-content article-body main-content story text body-text page-content bodyContent mw-content-text parser-output",
}
#: Words that such parts often hold. Fixed values.
PHRASES = {
    "menu": "Home About Contact News Products Services Blog Archive Login",
    "head": "Welcome Search Menu Subscribe Today",
    "ad": "Advertisement Sponsored Buy now Sale Offer Free shipping Click here",
    "side": "Related articles Most read Popular Recent posts Tags Categories Trending",
    "notice": "We use cookies to improve this site Accept Decline Privacy policy consent",
    "form": "Name Email Send Submit Search Subscribe to our newsletter Password Your message",
    "comments": "Comments Reply says wrote ago Posted by Great post thanks Like Report",
    "foot": "Copyright © All rights reserved Terms Privacy Imprint Contact ·",
    "share": "Share Tweet Facebook Print Email Next Previous Page",
}
#: What words are made of: any beginning, middle and end of a syllable.
ONSETS, NUCLEI, CODAS = "b c d f g h j k l m n p r s t v w br ch cl dr fl gr pl pr sh st th tr".split(), "a e i o u ai au ea ei ie oo ou".split(), ["", "", "", "l", "m", "n", "r", "s", "t", "nd", "ng", "st"]


class Composer:
    """Random pages with known labels."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def one(self, values):
        return values[int(self.r.integers(len(values)))]

    def words(self, low: int, high: int) -> str:
        n = int(self.r.integers(low, high + 1))
        made = ["".join(self.one(ONSETS) + self.one(NUCLEI) + self.one(CODAS) for _ in range(int(self.r.integers(1, 4)))) for _ in range(n)]
        roll = self.r.random()
        if roll < 0.06:  # odd writing occurs inside and outside of articles: marks after words, capitals, numbers, words said again
            mark = "".join(self.one(list(string.punctuation)) for _ in range(int(self.r.integers(1, 4))))
            made = [w + self.one(["", " "]) + mark for w in made]
        elif roll < 0.08:
            made = [w.upper() for w in made]
        elif roll < 0.10:
            made = [w if self.r.random() < 0.6 else str(int(self.r.integers(10**6))) for w in made]
        elif roll < 0.12:
            made = [w for w in made[: max(1, n // 3)] for _ in range(3)]
        text = " ".join(made)
        return (text.capitalize() + self.one([".", ".", ".", "!", "?", ""])) if n > 3 else text

    def phrase(self, kind: str, low: int = 2, high: int = 8) -> str:
        known = PHRASES[kind].split()
        return " ".join(self.one(known) if self.r.random() < 0.5 else self.words(1, 1) for _ in range(int(self.r.integers(low, high + 1))))

    def box(self, tag: str, name: str | None, inner: list) -> list:
        attr = ""
        if name:
            attr = self.one([f' class="{name}"', f' id="{name}"', f' class="{name} x{int(self.r.integers(9))}"', f" class='{name}'"])
        return [f"<{tag}{attr}>", *inner, f"</{tag}>" if self.r.random() > 0.03 or tag not in ("p", "li") else ""]

    def part(self, kind: str, native: str) -> list:
        """A boilerplate part: its native element, or a named one, or both."""
        name = self.one(NAMES[kind].split())
        tag, named = self.one([(native, None), (native, name), ("div", name), ("section", name), ("div", name)])
        if native == "div" and not named:
            named = name
        say = lambda *a: (self.words(4, 60) if self.r.random() < 0.5 else self.phrase(kind, *a), 0)
        if kind in ("menu", "side", "share"):
            items = [x for _ in range(int(self.r.integers(2, 9))) for x in self.box("li", None, ['<a href="/x">', (self.words(1, 4) if self.r.random() < 0.6 else self.phrase(kind, 1, 3), 0), "</a>"])]
            inner = self.box("ul", None, items) if self.r.random() < 0.8 else ['<a href="/y">', (self.phrase(kind), 0), "</a>"]
            if kind == "side":
                inner = [*self.box(self.one(["h2", "h3", "div"]), None, [self.phrase(kind, 1, 3) and (self.phrase(kind, 1, 3), 0)]), *inner, *(self.box("p", None, [say()]) if self.r.random() < 0.5 else [])]
        elif kind == "comments":
            each = lambda: self.box(self.one(["div", "li", "article", "section"]), self.one(["comment", "reply", "comment-body", None]), [*self.box(self.one(["p", "div"]), None, [(self.words(5, 60), 0)])])
            inner = [*self.box(self.one(["h2", "h3"]), None, [(self.phrase(kind, 1, 3), 0)]), *(x for _ in range(int(self.r.integers(1, 6))) for x in each())]
        elif kind == "form":
            inner = [*self.box("label", None, [(self.phrase(kind, 1, 3), 0)]), '<input name="q">', *self.box("p", None, [say()])]
            if tag != "form":
                inner = self.box("form", None, inner)
        else:
            inner = self.box("p", None, [say()]) if self.r.random() < 0.5 else [say()]
        return self.box(tag, named, inner)

    def table(self) -> list:
        """A table of the article: a caption at times, a row of heads, rows of cells."""
        wide, row = int(self.r.integers(2, 5)), lambda tag, n: self.box("tr", None, [x for _ in range(n) for x in self.box(tag, None, [(self.words(1, 6), 1)])])
        inner = self.box("caption", None, [(self.words(2, 8), 1)]) if self.r.random() < 0.3 else []
        rows = [*(row("th", wide) if self.r.random() < 0.6 else []), *(x for _ in range(int(self.r.integers(1, 5))) for x in row("td", wide))]
        return self.box("table", self.one([None, None, "data", "infobox", "table"]), [*inner, *(self.box("tbody", None, rows) if self.r.random() < 0.5 else rows)])

    def article(self, plain: bool = False) -> list:
        """A title and what follows it; `plain` without boilerplate in between."""
        out = []
        if self.r.random() < 0.9:
            out += self.box(self.one(["h1", "h1", "h1", "h2"]), self.one([None, None, "title", "headline", "firstHeading"]), [(self.words(2, 18), 1)])
            if self.r.random() < 0.12 and not plain:
                out = self.box("header", self.one([None, "entry-header", "article-header"]), out)
        for _ in range(int(self.r.integers(1, 14))):
            roll = self.r.random()
            if roll < 0.12:
                kind = self.one(["table", "figure", "dl", "pre", "code"])
                if kind == "table":
                    out += self.table()
                elif kind == "figure":
                    out += self.box("figure", self.one([None, "image", "thumb"]), ['<img src="/i.png">', *self.box("figcaption", None, [(self.words(2, 20), 1)])])
                elif kind == "dl":
                    out += self.box("dl", None, [x for _ in range(int(self.r.integers(1, 5))) for x in [*self.box("dt", None, [(self.words(1, 3), 1)]), *self.box("dd", None, [(self.words(3, 20), 1)])]])
                else:
                    out += self.box("pre", None, [*(["<code>"] if kind == "code" else []), (self.words(1, 12), 1), *(["</code>"] if kind == "code" else [])])
            elif roll < 0.75 or plain:
                out += self.box("p", None, [(self.words(2, 120), 1)])
            elif roll < 0.82:
                out += self.box(self.one(["h2", "h3"]), None, [(self.words(1, 8), 1)])
            elif roll < 0.88:
                out += self.box(self.one(["ul", "ol"]), None, [x for _ in range(int(self.r.integers(1, 5))) for x in self.box("li", None, [(self.words(1, 20), 1)])])
            elif roll < 0.92:
                out += self.box("blockquote", None, self.box("p", None, [(self.words(5, 40), 1)]))
            elif roll < 0.94:
                out += self.box("pre", None, [(self.words(3, 30), 1)])
            else:
                out += self.part(*self.one([("ad", "div"), ("side", "aside"), ("share", "div"), ("form", "form"), ("notice", "div")]))
        return out

    def page(self) -> tuple[list, list[int]]:
        """The blocks of a page and their labels."""
        tag, name = self.one([("article", None), ("article", None), ("article", self.one(NAMES["body"].split())), ("main", None), ("div", self.one(NAMES["body"].split())), ("div", self.one(NAMES["body"].split())), ("section", self.one(NAMES["body"].split()))])
        bare = self.r.random() < 0.08
        core = self.article(plain=True) if bare else self.box(tag, name, self.article())
        if bare:
            core = core if self.r.random() < 0.5 else self.box("div", None, core)
        elif self.r.random() < 0.2:  # containers within containers
            for _ in range(int(self.r.integers(1, 3))):
                core = self.box("div", self.one(NAMES["body"].split()), core)
        elif self.r.random() < 0.3:
            core = self.box(self.one(["main", "div"]), self.one([None, "main", "wrapper", "container"]), [*core, *(self.part("comments", "section") if self.r.random() < 0.4 else [])])
        before = [("menu", "nav"), ("head", "header"), ("ad", "div"), ("notice", "div"), ("form", "form"), ("side", "aside"), ("share", "div")]
        after = [("foot", "footer"), ("comments", "section"), ("side", "aside"), ("ad", "div"), ("form", "form"), ("notice", "div"), ("share", "div")]
        top = [x for p in before if self.r.random() < 0.45 for x in self.part(*p)]
        end = [x for i in self.r.permutation(len(after)) if self.r.random() < 0.45 for x in self.part(*after[i])]
        items = ["<html><body>", *top, *core, *end, "</body></html>"]
        marks = {0: "\ue000", 1: "\ue001"}
        page = "".join(x if isinstance(x, str) else html.escape(x[0]) + marks[x[1]] for x in items)
        found, labels = [], []
        for text, path, linked in blocks(page):
            labels.append(int("\ue001" in text))
            found.append((text.replace("\ue000", "").replace("\ue001", "").strip() or "x", path, linked))
        return found, labels


HIDDEN_UNITS, TRAIN_PAGES, EPOCHS, BATCH = 24, 900, 8, 24


@lru_cache(maxsize=1)
def model(pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Lstm:
    """The labeller, trained by Adam on composed pages. Deterministic."""
    composer = Composer(5)
    made = [composer.page() for _ in range(pages)]
    made = sorted((p for p in made if p[0]), key=lambda p: len(p[0]))
    x, y = [vectors(f) for f, _ in made], [np.array(v, np.float32) for _, v in made]
    net, r = Lstm(SIZE, HIDDEN_UNITS, 3), np.random.default_rng(4)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    starts, step = np.arange(0, len(x), BATCH), 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for s in r.permutation(starts):
            xs, lengths = padded(x[s : s + BATCH])
            ys = np.zeros(xs.shape[:2], np.float32)
            for i, v in enumerate(y[s : s + BATCH]):
                ys[i, : len(v)] = v
            step += 1
            for k, g in net.gradients(xs, ys, lengths).items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.995 * m2[k] + 0.005 * g * g
                net.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.995**step)) + 1e-6)
    return net


def labelled(net: Lstm, pages: list[np.ndarray], together: int = 2048) -> list[np.ndarray]:
    """For each page's vectors, which blocks are of the article; pages of similar length are read together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
    while order:
        take, longest = [], len(pages[order[-1]])
        while order and (not take or (len(take) + 1) * longest <= together):
            take.append(order.pop())
        x, lengths = padded([pages[i] for i in take])
        logits, _ = net.forward(x, lengths)
        for k, i in enumerate(take):
            out[i] = logits[k, : lengths[k]] > 0
    return out


def texts(net: Lstm, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    found = [blocks(p) if p else [] for p in pages]
    chosen = labelled(net, [vectors(f) for f in found])
    return ["\n\n".join(b[0] for b, ok in zip(f, c, strict=True) if ok) for f, c in zip(found, chosen, strict=True)]


def extracted(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep`, text, n_chars of every page."""
    spark = prepare(pages.sparkSession)
    shipped = spark.sparkContext.broadcast(model().p)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Lstm.__new__(Lstm)
        net.p, net.hidden = shipped.value, HIDDEN_UNITS
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = texts(net, part.column("_html").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*names, "text", "n_chars"])

    schema = ", ".join([*(f"`{n}` {pages.schema[n].dataType.simpleString()}" for n in names), "text string, n_chars long"])
    return pages.select(*names, F.col("html").alias("_html")).mapInArrow(run, schema)
