"""Main text of web pages: a recurrent labeller reads a page's blocks in order and says which belong to the article.

A page is cut into leaf blocks: text between the starts and ends of block-level
elements; inline elements and line breaks stay inside a block; scripts, styles, comments, titles and choice lists give none. A block's
input is the sum of learned vectors of its tag path (tags, and the words in their classes, ids and roles, hashed),
the mean of learned vectors of its hashed words, and a few measures. A bidirectional LSTM in numpy reads all
blocks of the page from both ends, so each is judged by the whole document.

The tables carry no labels for pages, so the labeller is trained here, on pages written by ``training_pages``
with known blocks: articles of many shapes between menus, headers, footers, sidebars, notices, adverts, forms and
reader comments, under names common on the web, with unclosed tags as they occur. Training takes
seconds, always gives the same weights and is done once for each driver.

Defined results: null or empty html gives an empty text; broken markup is read as far as it goes (an unclosed tag at the end is text, an unclosed
script or style goes to the end of the page, other unclosed elements are read as they stand); reading takes time in proportion to the page, so very long pages
need no limit; a block at exactly 0.5 belongs to the article; rows are
independent, so repeated rows agree; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Names of elements, by how they are read. RAW ones hold no text of the page; everything else that is not INLINE starts a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title iframe select textarea template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo q s samp small span strike strong sub sup time tt u var wbr img input".split())
CLOSED_BY_START = {"p": frozenset("p"), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
HOLDERS = frozenset("html body table ul ol dl div section article main nav aside header footer form blockquote figure".split())
LANDMARKS = frozenset("article main nav aside header footer form section".split())

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
# a quoted value stands after = only; a tag cut short by the end of the page does not match
_REST = re.compile(r"(?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+>")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_NAMES = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
_PARTS = re.compile(r"[a-z]+")
_SENTENCES = re.compile(r"[.!?…](?=\s|$)")

PATHS, WORDS, DIM, HIDDEN, MEASURES = 16384, 4096, 16, 16, 9
#: What the labeller sees of a path: the innermost elements, and the innermost ones above them that are landmarks or carry names. Names of one element.
DEPTH, ABOVE, NAMED = 8, 8, 12


class Block:
    """Text of one block, its path, and how much of it stands in links."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: float):
        self.text, self.path, self.linked = text, path, linked


class _Reader:
    """The state of reading one page. Every character is looked at a bounded number of times, whatever the markup."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[tuple[str, str, tuple[str, ...]]] = []  # tag, tag with names, landmarks above
        self.open: Counter = Counter()
        self.held: list[str] = []
        self.linked = self.anchors = 0

    def text(self, piece: str) -> None:
        if piece:
            self.held.append(piece)
            if self.anchors:
                self.linked += len(piece)

    def flush(self) -> None:
        if self.held:
            text = " ".join(html.unescape("".join(self.held)).split())
            if text:
                inner = [n for _, n, _ in self.stack[-DEPTH:]]
                above = self.stack[-DEPTH][2] if len(self.stack) >= DEPTH else ()
                self.out.append(Block(text, (*above, *inner), min(1.0, self.linked / max(sum(map(len, self.held)), 1))))
            self.held.clear()
        self.linked = 0

    def pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1

    def start(self, tag: str, attributes: str) -> None:
        self.flush()
        while self.stack and self.stack[-1][0] in CLOSED_BY_START.get(tag, ()):
            self.pop()
        if tag in HOLDERS or tag[0] == "h":
            while self.stack and self.stack[-1][0] == "p":
                self.pop()
        names = [p for a in _NAMES.finditer(attributes) for p in _PARTS.findall((a[2] or a[3] or a[4] or "").lower())] if "=" in attributes else []
        above: tuple[str, ...] = ()
        if self.stack:
            last = self.stack[-1]
            above = (*last[2], last[1])[-ABOVE:] if last[0] in LANDMARKS or " " in last[1] else last[2]
        self.stack.append((tag, " ".join([tag, *(f".{n}" for n in names[:NAMED])]), above))
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        self.flush()
        self.anchors = 0
        if self.open[tag]:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == tag:
                    while len(self.stack) > k:
                        self.pop()
                    return
                if self.stack[k][0] in HOLDERS and tag not in HOLDERS:
                    return


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; character references decoded, white space made one space, no empty ones."""
    read, at, strict = _Reader(), 0, True
    endless: set[str] = set()  # RAW elements whose end does not come any more
    while True:
        mark = page.find("<", at)
        if mark < 0:
            break
        after = page[mark + 1 : mark + 2]
        if page.startswith("<!--", mark):
            read.text(page[at:mark])
            end = page.find("-->", mark + 4)
            at = len(page) if end < 0 else end + 3
            continue
        name = _NAME.match(page, mark + 1) if after == "/" or after.isascii() and after.isalpha() else None
        if name is None and after not in ("!", "?"):
            read.text(page[at : mark + 1])
            at = mark + 1
            continue
        whole = _REST.match(page, name.end()) if name and strict else None
        strict &= whole is not None or name is None  # one tag that never ends well, and the rest is cut at the next >
        end = whole.end() if whole else page.find(">", mark) + 1
        if not end:
            break
        read.text(page[at:mark])
        at = end
        if name is None:
            continue
        tag, ends, attributes = name[1].lower(), after == "/", page[name.end() : end - 1]
        if tag in RAW:
            if not ends and not attributes.endswith("/") and tag not in endless:
                close = _ENDS[tag].search(page, at)
                end = page.find(">", close.end()) + 1 if close else 0
                if end:
                    at = end
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    endless.add(tag)
        elif tag == "br":
            read.text(" ")
        elif tag in INLINE:
            if tag == "a":
                read.anchors = 0 if ends else 1
        elif tag == "hr":
            read.flush()
        elif tag not in VOID:
            if ends:
                read.end(tag)
            elif not (read.open["svg"] and attributes.endswith("/")):
                read.start(tag, attributes)
    read.text(page[at:])
    read.flush()
    return read.out


# ------------------------------------------------------------------ inputs


def path_ids(path: tuple[str, ...]) -> list[int]:
    """Hashed tokens of a path: each tag and name, and each with its neighbour above."""
    tokens, above = [], ""
    for k, names in enumerate(path):
        for n in names.split():
            tokens += [n, f"{above}>{n}"]
        if k == len(path) - 1:
            tokens.append("last:" + names.split()[0])
        above = names.split()[0]
    return [zlib.crc32(t.encode()) % PATHS for t in tokens]


def measured(b: Block, words: int, place: float) -> tuple[float, ...]:
    """What is measured of a block: its length, links, place on the page, and signs of prose."""
    text, n = b.text, max(words, 1)
    return (
        min(words, 400) ** 0.5 / 10,
        b.linked,
        place,
        text[-1] in ".!?…\"'”",
        min(len(_SENTENCES.findall(text)), 8) / 8,
        min(text.count(",") / n, 0.3),
        sum(map(str.isdigit, text)) / len(text),
        words < 4,
        "©" in text,
    )


class Inputs:
    """What the labeller reads of many pages: flat arrays over all blocks."""

    def __init__(self, pages: list[list[Block]], known: dict[tuple[str, ...], list[int]]):
        self.lengths = np.array([len(p) for p in pages], np.int64)
        paths, words, measures, path_n, word_n = [], [], [], [], []
        for page in pages:
            for k, b in enumerate(page):
                ids = known.get(b.path)
                if ids is None:
                    ids = path_ids(b.path)
                    if len(known) < 20_000:
                        known[b.path] = ids
                own = [zlib.crc32(w) % WORDS for w in b.text.lower().encode().split()]
                paths += ids
                words += own
                path_n.append(len(ids))
                word_n.append(len(own))
                measures.append(measured(b, len(own), k / max(1, len(page) - 1)))
        self.paths, self.words = np.array(paths, np.int32), np.array(words, np.int32)
        self.path_n, self.word_n = np.array(path_n, np.int64), np.array(word_n, np.int64)
        self.measures = np.array(measures, np.float32).reshape(-1, MEASURES)


def summed(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``rows``; every count is positive but may be missing altogether."""
    out = np.zeros((len(counts), rows.shape[1]), np.float32)
    on = counts > 0
    if on.any():
        starts = np.concatenate([[0], np.cumsum(counts[on])[:-1]])
        out[on] = np.add.reduceat(rows, starts, axis=0)
    return out


# ------------------------------------------------------------------ the labeller


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """Bidirectional LSTM over blocks with a logistic output."""

    SHAPES = {"path": (PATHS, DIM), "word": (WORDS, DIM), "fx": (2 * DIM + MEASURES, 4 * HIDDEN), "fh": (HIDDEN, 4 * HIDDEN), "fb": (4 * HIDDEN,), "bx": (2 * DIM + MEASURES, 4 * HIDDEN), "bh": (HIDDEN, 4 * HIDDEN), "bb": (4 * HIDDEN,), "out": (2 * HIDDEN + 2 * DIM + MEASURES,), "bias": (1,)}

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = {k: rng.normal(0, 0.3 / np.sqrt(s[0]), s).astype(np.float32) for k, s in self.SHAPES.items()}
        for k in ("path", "word"):
            self.w[k][:] = 0  # names and words that no training page holds say nothing
        for k in ("fb", "bb"):
            self.w[k][HIDDEN : 2 * HIDDEN] = 1.0

    def vectors(self, x: Inputs) -> np.ndarray:
        p = summed(self.w["path"][x.paths], x.path_n)
        v = summed(self.w["word"][x.words], x.word_n) / np.maximum(x.word_n, 1)[:, None]
        return np.concatenate([p, v.astype(np.float32), x.measures], axis=1)

    @staticmethod
    def places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each page's blocks, forwards and backwards, as steps x pages; -1 beyond the end."""
        top = int(lengths.max(initial=0))
        starts = np.cumsum(lengths) - lengths
        t = np.arange(top)[:, None]
        on = t < lengths[None, :]
        return np.where(on, starts + t, -1), np.where(on, starts + lengths - 1 - t, -1)

    def lstm(self, v: np.ndarray, at: np.ndarray, way: str, tape: list | None = None) -> np.ndarray:
        """States of one direction for every block."""
        wx, wh, b = self.w[way + "x"], self.w[way + "h"], self.w[way + "b"]
        gates = v @ wx + b
        out = np.zeros((len(v), HIDDEN), np.float32)
        h = c = np.zeros((at.shape[1], HIDDEN), np.float32)
        for t in range(len(at)):
            on = np.flatnonzero(at[t] >= 0)
            k = at[t, on]
            g = gates[k] + h[on] @ wh
            i, f, o, n = sigmoid(g[:, :HIDDEN]), sigmoid(g[:, HIDDEN : 2 * HIDDEN]), sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
            before_h, before_c = h[on], c[on]
            now = f * before_c + i * n
            s = np.tanh(now)
            h, c = h.copy(), c.copy()
            h[on], c[on] = o * s, now
            out[k] = h[on]
            if tape is not None:
                tape.append((on, k, i, f, o, n, before_h, before_c, s))
        return out

    def lstm_back(self, v: np.ndarray, dout: np.ndarray, way: str, tape: list, pages: int, grad: dict) -> np.ndarray:
        wx, wh = self.w[way + "x"], self.w[way + "h"]
        dgates = np.zeros((len(v), 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        for on, k, i, f, o, n, before_h, before_c, s in reversed(tape):
            a = dh[on] + dout[k]
            ds = dc[on] + a * o * (1 - s * s)
            g = np.concatenate([ds * n * i * (1 - i), ds * before_c * f * (1 - f), a * s * o * (1 - o), ds * i * (1 - n * n)], axis=1)
            dgates[k] = g
            grad[way + "h"] += before_h.T @ g
            dh[on], dc[on] = g @ wh.T, ds * f
        grad[way + "x"] += v.T @ dgates
        grad[way + "b"] += dgates.sum(axis=0)
        return dgates @ wx.T

    def predict(self, x: Inputs) -> np.ndarray:
        """P(in the article) of every block."""
        if not len(x.measures):
            return np.zeros(0)
        v = self.vectors(x)
        ahead, back = self.places(x.lengths)
        return sigmoid(np.concatenate([self.lstm(v, ahead, "f"), self.lstm(v, back, "b"), v], axis=1) @ self.w["out"] + self.w["bias"])

    def step(self, x: Inputs, y: np.ndarray, grad: dict) -> float:
        """Adds the gradients of the mean cross-entropy; returns it."""
        v = self.vectors(x)
        ahead, back = self.places(x.lengths)
        tf, tb = [], []
        joint = np.concatenate([self.lstm(v, ahead, "f", tf), self.lstm(v, back, "b", tb), v], axis=1)
        p = sigmoid(joint @ self.w["out"] + self.w["bias"])
        d = ((p - y) / len(y)).astype(np.float32)
        grad["out"] += joint.T @ d
        grad["bias"] += d.sum()
        dj = d[:, None] * self.w["out"][None, :]
        dv = dj[:, 2 * HIDDEN :].copy()
        dv += self.lstm_back(v, dj[:, :HIDDEN], "f", tf, len(x.lengths), grad)
        dv += self.lstm_back(v, dj[:, HIDDEN : 2 * HIDDEN], "b", tb, len(x.lengths), grad)
        np.add.at(grad["path"], x.paths, np.repeat(dv[:, :DIM], x.path_n, axis=0))
        np.add.at(grad["word"], x.words, np.repeat(dv[:, DIM : 2 * DIM] / np.maximum(x.word_n, 1)[:, None], x.word_n, axis=0))
        return float(-np.mean(np.where(y > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))))

    def fit(self, pages: list[tuple[list[Block], np.ndarray]], passes: int = 5, batch: int = 20, rate: float = 0.01, seed: int = 11) -> Labeller:
        rng, known = np.random.default_rng(seed), {}
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        n = 0
        for _ in range(passes):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                part = [pages[k] for k in order[at : at + batch]]
                grad = {k: np.zeros_like(v) for k, v in self.w.items()}
                self.step(Inputs([b for b, _ in part], known), np.concatenate([y for _, y in part]), grad)
                n += 1
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.01 * (g * g - s[k])
                    self.w[k] -= rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.99**n)) + 1e-7)
        return self


# ------------------------------------------------------------------ training pages

#: Names of containers as they are common on the web.
ARTICLE = ["article", "main", "main>article", "div.content", "div#content", "div.post", "div.entry-content", "div.article-body", "div.story", "section.post-content", "div#main>article", "body>article", "div.main-content", "article.post"]
OTHER = {
    "menu": ["nav", "div.menu", "div#nav", "ul.navbar", "nav.main-nav", "div.breadcrumb", "div.navigation", "nav.pagination", "ul.menu"],
    "header": ["header", "div.header", "div#header", "header.site-header", "div.masthead", "div.topbar", "div.site-title"],
    "footer": ["footer", "div.footer", "div#footer", "footer.site-footer", "div.colophon", "div.copyright"],
    "sidebar": ["aside", "div.sidebar", "div#sidebar", "aside.widget", "div.related", "div.widget", "section.related-posts", "div.recommended", "aside.sidebar"],
    "notice": ["div.cookie-notice", "div.notice", "div#cookie-banner", "div.consent", "div.alert", "div.newsletter", "div.subscribe", "div.banner", "div.gdpr", "section.notice", "div.popup", "noscript"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "div#ad", "aside.ad", "section.sponsor"],
    "form": ["form", "form.search", "form.login", "div.form", "form.subscribe", "form#comment-form"],
    "comments": ["div.comments", "section.comments", "div#comments", "ol.comment-list", "div.comment", "section#respond", "div.responses", "ul.comments", "div.reader-comments", "aside.comments"],
    "share": ["div.share", "ul.social", "div.social-links", "div.tags", "div.meta", "div.byline"],
}
#: Containers that name nothing; a question mark becomes an invented name. What stands in them is told from its text alone.
PLAIN = ["", "", "div", "div", "div>div", "div>div>div", "section", "td", "div.?", "div#?", "div.?>div.?", "section.?", "center", "?-?", "font>div", "table>tr>td"]
PLAIN_OTHER = ["div", "div", "div>div", "section", "div.?", "div#?", "p", "td", ""]
TELLING = {
    "menu": "home about contact news products blog services login startseite kontakt accueil inicio contacto noticias aktuelles über produits servicios archiv".split(),
    "header": "welcome menu search sign in willkommen bienvenue bienvenido suche".split(),
    "footer": "&copy; copyright all rights reserved privacy terms imprint &middot; contact impressum datenschutz mentions légales derechos reservados alle rechte vorbehalten".split(),
    "sidebar": "related popular recent posts more read also archives verwandte artikel articles liés artículos relacionados".split(),
    "notice": "cookies we use accept privacy policy agree subscribe newsletter javascript enable akzeptieren accepter aceptar browser".split(),
    "advert": "sponsored advertisement buy now offer sale discount anzeige publicité publicidad angebot".split(),
    "form": "name email password submit search send login absenden envoyer enviar".split(),
    "comments": "reply says comment wrote posted thanks great kommentar antworten commentaire répondre comentario responder".split(),
    "share": "share tweet tags posted by teilen partager compartir".split(),
}


class _Writer:
    """Writes pieces of pages by a fixed random recipe."""

    SYLLABLES = [a + b for a in "b c d f g k l m n p r s t v w z th sh st".split() for b in "a e i o u an en er on ie au el".split()]

    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        return "".join(self.rng.choices(self.SYLLABLES, k=self.rng.choice((1, 1, 2, 2, 3))))

    def sentence(self, k: int) -> str:
        words = [self.word() + ("," if self.rng.random() < 0.06 else "") for _ in range(k)]
        if self.rng.random() < 0.1:
            words[self.rng.randrange(k)] = str(self.rng.randint(1, 2100))
        if self.rng.random() < 0.08:
            words[-1] = f"<a href='/x'>{words[-1].rstrip(',')}</a>"
        out = " ".join(words).rstrip(",")
        return out[:1].upper() + out[1:] + self.rng.choice((".", ".", ".", "!", "?"))

    def heading(self) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(1, 9))).capitalize() + self.rng.choice(("", "", ".", "?"))

    def prose(self, short: bool = False) -> str:
        if short or self.rng.random() < 0.2:
            return self.sentence(self.rng.randint(1, 9))
        return " ".join(self.sentence(self.rng.randint(3, 16)) for _ in range(self.rng.randint(1, 5)))

    def wrap(self, spec: str, inner: str) -> str:
        for one in reversed(spec.split(">")):
            while "?" in one:
                one = one.replace("?", self.word() + self.word(), 1)
            if one in ("", "body"):
                continue
            tag, _, name = one.replace("#", ".#").partition(".")
            label = "" if not name else f' id="{name[1:]}"' if name[0] == "#" else f' class="{name}"'
            inner = f"<{tag}{label}>{inner}</{tag}>"
        return inner

    def paragraph(self, text: str) -> str:
        r = self.rng.random()
        if r < 0.12:
            return f"<p><b>{text}<br>"
        if r < 0.2:
            return f"<p>{text}"
        if r < 0.3:
            return f"<p>{self.sentence(2)} <a href='/x'>{self.word()}</a> {text}</p>"
        return f"<p>{text}</p>"

    def article(self) -> str:
        rng = self.rng
        out = [f"<h1>{self.sentence(rng.randint(3, 10)) if rng.random() < 0.5 else self.heading()}</h1>"] if rng.random() < 0.85 else []
        style = rng.choice(("p", "p", "p", "p", "p", "p", "div", "br", "section"))
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 6, 9, 14))):
            r = rng.random()
            if r < 0.72:
                text = self.prose()
                out.append({"p": self.paragraph(text), "div": f"<div>{text}</div>", "br": f"{text}<br><br>{self.prose()}<p>", "section": f"<section><h2>{self.heading()}</h2><p>{text}</p></section>"}[style])
            elif r < 0.79:
                k = rng.choice("23")
                out.append(f"<h{k}>{self.heading()}</h{k}>")
            elif r < 0.85:
                out.append("<ul>" + "".join(f"<li>{self.prose(True)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.89:
                out.append(f"<blockquote><p>{self.prose()}</p></blockquote>")
            elif r < 0.91:
                out.append(f"<dl><dt>{self.word()}</dt><dd>{self.prose(True)}</dd><dt>{self.word()}</dt><dd>{self.prose()}</dd></dl>")
            elif r < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.word()}</td>" for _ in range(4)) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>")
            elif r < 0.97:
                out.append(f"<pre>{self.prose(True)}</pre>")
            else:
                out.append(f"<figure><img src='x'><figcaption>{self.prose(True)}</figcaption></figure>")
        return "".join(out) or self.paragraph(self.prose(True))

    def disguised(self, body: str) -> str:
        """The same page with invented names on its elements, or with invented elements."""
        rng, named = self.rng, {}
        if rng.random() < 0.6:
            share = rng.choice((0.3, 1.0))

            def name(m: re.Match) -> str:
                return f"<{m[1]} class='{' '.join(self.word() + rng.choice(('', '-x', '9')) for _ in range(rng.randint(1, 3)))}'" if rng.random() < share else m[0]

            return re.sub(r"<(div|p|h[1-6]|section|li|ul|td)(?=>)", name, body)
        for tag in rng.sample(("div", "p", "h1", "section", "center"), rng.randint(1, 4)):
            named[tag] = f"{self.word()}-{self.word()}"
        return re.sub(r"(</?)(div|p|h1|section|center)(?=[ >])", lambda m: m[1] + named.get(m[2], m[2]), body)

    def told(self, kind: str, k: int, share: float = 0.3) -> str:
        return " ".join(self.rng.choice(TELLING[kind]) if self.rng.random() < share else self.word() for _ in range(k))

    def links(self, kind: str) -> str:
        rng = self.rng
        n, most = rng.randint(2, 8), 2 if kind == "menu" else 6
        one = [f"<a href='/{k}'>{self.told(kind, rng.randint(1, most)).capitalize()}</a>" for k in range(n)]
        return rng.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>", rng.choice((" | ", " ", " &middot; ", " &raquo; ")).join(one), "".join(f"<div>{x}</div>" for x in one), "<br>".join(one)))

    def other(self, kind: str) -> str:
        """Something that is not the article, in a container that says so."""
        rng = self.rng
        if kind == "menu":
            inner = self.links(kind)
        elif kind == "form":
            inner = f"<label>{self.told(kind, 1)}</label><input type=text><p>{self.told(kind, 4)}</p><button>{self.told(kind, 1)}</button>"
        elif kind == "comments":
            one = rng.choice(("<div class='comment'><p>{}</p></div>", "<li><b>{}</b></li>", "<p>{}</p>", "<article class='comment'><header>{}</header><p>{}</p></article>"))
            inner = rng.choice(("", f"<h3>{self.told(kind, 2)}</h3>")) + "".join(one.replace("{}", self.prose(rng.random() < 0.5)) for _ in range(rng.randint(1, 6)))
        elif kind == "sidebar":
            inner = rng.choice((f"<h3>{self.told(kind, 2)}</h3>", "")) + rng.choice((self.links(kind), f"<p>{self.prose()}</p>", f"<div>{self.prose(True)}</div>"))
        elif kind == "header":
            inner = rng.choice((f"<h1>{self.told(kind, 2)}</h1>", f"<div>{self.told(kind, 3)}</div>", f"<p>{self.prose(True)}</p>", f"<a href='/'>{self.told(kind, 2)}</a>", self.heading()))
        elif kind == "footer":
            inner = rng.choice((f"&copy; {self.word()} &middot; {self.prose(True)}", f"<p>{self.told(kind, 6)}</p>", f"<p>{self.prose()}</p>", f"&copy; {self.word()}.example &middot; {self.prose()}", self.links(kind), self.heading()))
        else:
            inner = rng.choice((self.prose(), self.prose(True), f"<p>{self.told(kind, 8)}</p>", f"<p>{self.prose()}</p>", f"<h4>{self.told(kind, 2)}</h4><p>{self.prose(True)}</p>"))
        return self.wrap(rng.choice(OTHER[kind]), inner)

    def plain_other(self, kind: str) -> str:
        """The same where only the text tells: lists of links, legal lines, forms."""
        rng = self.rng
        inner = {
            "menu": lambda: self.links(kind),
            "header": lambda: f"<a href='/'>{self.told(kind, rng.randint(1, 4)).title()}</a>",
            "footer": lambda: rng.choice((f"&copy; {rng.randint(1999, 2030)} {self.told(kind, rng.randint(2, 8), 0.6)}", self.links(kind))),
            "sidebar": lambda: rng.choice((f"<h4>{self.told(kind, 2, 0.8)}</h4>", f"<b>{self.told(kind, 2, 0.8)}</b>")) + self.links(kind),
            "notice": lambda: f"{self.told(kind, rng.randint(6, 20), 0.6).capitalize()}. <button>{self.told(kind, 1, 0.8)}</button>",
            "advert": lambda: f"{rng.choice(('Sponsored', 'Advertisement', 'Anzeige', 'Publicité', 'Publicidad'))}{rng.choice((': ', ' ', ' - '))}{self.told(kind, rng.randint(3, 12), 0.5)}",
            "share": lambda: " ".join(f"<a href='#'>{x}</a>" for x in rng.sample(("Share", "Tweet", "Email", "Teilen", "Partager", "Print"), 3)),
        }
        if kind in inner:
            return self.wrap(rng.choice(PLAIN_OTHER), inner[kind]())
        return self.wrap("form", f"{self.told('form', 2, 0.8)} <input type=text> <button>{self.told('form', 1, 0.8)}</button>")


def training_pages(n: int = 1400, seed: int = 17) -> list[tuple[list[Block], np.ndarray]]:
    """Pages with a label for each block (1: in the article), written by a fixed random recipe.

    Half of the pages name all their containers; in a quarter the article's has no name or an invented one; in a quarter no
    container has, and what is not article tells by its text. Some pages are tables with the article in one cell, some hold the article alone.
    """
    rng = random.Random(seed)
    w, mark = _Writer(rng), {0: "\u0001", 1: "\u0002"}

    def marked(piece: tuple[str, int]) -> str:
        text = piece[0] if piece[0].startswith("<") else "<!>" + piece[0]
        return re.sub(r">([^<]*\w[^<]*)(?=<|$)", lambda m: ">" + mark[piece[1]] + m[1], text)

    out = []
    for _ in range(n):
        r, parts, tail = rng.random(), [], []
        other = w.plain_other if r > 0.75 else w.other if r < 0.6 else lambda kind: rng.choice((w.other, w.plain_other))(kind)
        spec = rng.choice(ARTICLE) if r < 0.5 else rng.choice(PLAIN)
        alone = rng.random() < 0.08
        for kind in ("notice", "header", "menu", "advert", "notice", "share"):
            if not alone and rng.random() < (0.7 if kind in ("menu", "header") else 0.3):
                parts.append((other(kind), 0))
        inner: list[tuple[str, int]] = [(w.article(), 1)]
        if rng.random() < 0.25 and not alone:  # something foreign inside the article's container
            kind = rng.choice(("advert", "comments", "share", "sidebar", "notice", "form"))
            inner.insert(rng.randint(0, 1), (w.other(kind) if kind == "comments" else other(kind), 0))
            inner.append((w.article().replace("h1>", "h2>"), 1))
        for kind in ("share", "comments", "sidebar", "advert", "form", "footer"):
            if not alone and rng.random() < (0.85 if kind == "footer" else 0.35) * (0.7 if r > 0.75 else 1):
                tail.append((w.other(kind) if kind == "comments" else other(kind), 0))
        if rng.random() < 0.3:
            k = next((k for k, p in enumerate(tail) if "aside" in p[0] or "sidebar" in p[0]), None)
            if k is not None:
                parts.append(tail.pop(k))
        main = w.wrap(spec, "".join(map(marked, inner)))
        if rng.random() < (0.08 if r < 0.5 else 0.4):  # cells side by side, what is above and below in rows of their own or outside
            left, right = "".join(map(marked, parts[1:])), "".join(map(marked, tail[:-1]))
            cells = [f"<td>{x}</td>" for x in (left, main, right) if x]
            top, end = "".join(map(marked, parts[:1])), "".join(map(marked, tail[-1:]))
            if rng.random() < 0.6:
                top, end = ("<table>" + (f"<tr><td colspan=3>{x}</td></tr>" if x else "") for x in (top, end))
                body = f"{top}<tr>{''.join(cells)}</tr>{end.removeprefix('<table>')}</table>"
            else:
                body = f"{top}<table><tr>{''.join(cells)}</tr></table>{end}"
        else:
            body = "".join(map(marked, parts)) + main + "".join(map(marked, tail))
        if rng.random() < 0.25:
            body = w.wrap(rng.choice(("div", "div.?", "div#wrapper", "div.container", "div.page", "div>div", "center")), body)
        if r > 0.75 and rng.random() < 0.5:
            body = w.disguised(body)
        page = f"<!DOCTYPE html><html><head><title>{w.heading()}</title><style>p{{margin:0}}</style></head><body>{body}" + rng.choice(("</body></html>", ""))
        blocks, labels = [], []
        for b in blocks_of(page):
            label = b.text.count(mark[1]) >= b.text.count(mark[0])
            text = " ".join(b.text.replace(mark[0], "").replace(mark[1], "").split())
            if text:
                blocks.append(Block(text, b.path, b.linked))
                labels.append(label)
        if blocks:
            out.append((blocks, np.array(labels, np.float32)))
    return out


_FITTED: list[Labeller] = []


def fitted() -> Labeller:
    """The trained labeller, made once for each process that asks."""
    if not _FITTED:
        _FITTED.append(Labeller().fit(training_pages()))
    return _FITTED[0]


def extract(pages: list[str], labeller: Labeller, known: dict | None = None) -> list[str]:
    """The main text of each page."""
    cut = [blocks_of(p) for p in pages]
    p = labeller.predict(Inputs(cut, {} if known is None else known))
    out, at = [], 0
    for blocks in cut:
        out.append("\n\n".join([b.text for b, on in zip(blocks, p[at : at + len(blocks)] >= 0.5, strict=True) if on]))
        at += len(blocks)
    return out


def main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per row: ``id_col``, the columns ``keep``, text and n_chars (its code points)."""
    model = df.sparkSession.sparkContext.broadcast(fitted())
    inner = [f"k{n}" for n in range(len(keep))]
    source = df.select(F.col(id_col).alias("id"), *[F.col(k).alias(n) for k, n in zip(keep, inner, strict=True)], F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in common.sliced(batches, 128):
            found = extract(common.texts(b, "html"), model.value, known)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(n) for n in inner), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["id", *inner, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in ("id", *inner)) + ", text string, n_chars long"
    return source.mapInArrow(run, schema).toDF(id_col, *keep, "text", "n_chars")
