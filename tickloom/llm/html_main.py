"""Main text of HTML pages: a recurrent labeller of blocks.

A page is read into its leaf blocks, runs of text between block-level tags, each with its tag path. A block's vector
holds the hashed tag, class, id and role words of its path, hashed words, and a few measures (length, share of link
text, punctuation). A bidirectional LSTM in numpy reads the sequence of vectors and labels every block with the whole
page as context; blocks labelled as main text are joined in page order.

Training pages are built, with labels, by `training_pages`: usual arrangements of articles, menus, headers, footers,
sidebars, notices, adverts, forms and comments under many usual names, filled with words from a bounded sample of the
pages at hand: `vocabulary` of the words of the whole pages under `sample` ids, both in the order of a hash.

Work and memory are in proportion to a page whatever its markup: tags are looked for up to the last `>` only, path
features are carried along the stack, and pages are labelled in batches of a bounded number of blocks.

Defined cases: null and empty html, and pages without main text, give an empty text; unclosed and stray tags are
accepted; script, style and other unseen contents and comments are no blocks; only raw text (script, style and their
like) runs to the page's end if it is not closed, other unseen elements end with the element around them or, as in
browsers, where HTML breaks out of them; math and an object's fallback are text of their line; repeated rows are read
each; an empty table gives no rows.
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

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")
PLAIN_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>()()()", re.S)
SELECT_END = re.compile(r"<(/?)select(?=[\s/>])[^>]*>", re.I)
UNQUOTED = re.compile(r"=\s*[^\s\"'>]+\Z")
# Elements of raw text, others whose content is not shown, elements that have none, that stand inside a line,
# and that end others; in svg and math, tags that leave them, and elements that hold HTML.
RAW = set("script style textarea title iframe noembed noframes".split())
HIDDEN = set("template select svg math:annotation math:annotation-xml".split())
BREAKS_OUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = {f"{k}:{n}" for k, names in (("svg", "foreignobject desc title"), ("math", "mi mo mn ms mtext annotation-xml")) for n in names.split()}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img ins kbd label mark math object param q s samp small span strike strong sub sup svg time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CONTAINERS = set("ul ol dl table article section div body td th object template".split())
PATHS, WORDS, MEASURES = 128, 48, 8
HIDDEN_SIZE = 16
CELLS = 1 << 14  # blocks that are labelled at once, padding included; a longer page is labelled alone
ODD_QUOTES = 64  # how many page lengths may be spent on tags whose quotes do not close


class Path:
    """What a block's vector tells of the elements around it, carried along as they open and close."""

    def __init__(self) -> None:
        self.counts = np.zeros(PATHS, np.float32)
        self.last: list[int] = []

    def push(self, words: list[str]) -> None:
        places = [zlib.crc32(w.encode()) % PATHS for w in words]
        self.last += places
        for k in places:
            self.counts[k] += 1

    def pop(self, words: int) -> None:
        for k in self.last[len(self.last) - words :]:
            self.counts[k] -= 1
        del self.last[len(self.last) - words :]

    def features(self) -> np.ndarray:
        """Half of each word, and as much again for the three innermost."""
        x = self.counts * 0.5
        for k in self.last[-3:]:
            x[k] += 0.5
        return x


def blocks(page: str | None) -> list[tuple[str, np.ndarray, int, int]]:
    """(text, path features, path words, characters inside links) of each leaf block."""
    page = page or ""
    out: list = []
    stack: list[tuple[str, int]] = []  # open elements, with the number of their path words
    path, open_now = Path(), Counter()
    text: list[str] = []
    linked = 0
    foreign = hidden = None  # places in the stack of the svg or math element, and of the element that is not shown

    def flush() -> None:
        nonlocal linked
        clean = " ".join("".join(text).split())
        if clean:
            out.append((clean, path.features(), len(path.last), linked))
        text.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal foreign, hidden
        if any(name not in INLINE and not name.startswith(("svg:", "math:")) for name, _ in stack[to:]):
            flush()
        for name, words in stack[to:]:
            open_now[name] -= 1
            path.pop(words) if words else None
        del stack[to:]
        foreign, hidden = (None if k is None or k >= to else k for k in (foreign, hidden))

    def push(name: str, words: list[str]) -> None:
        stack.append((name, len(words)))
        open_now[name] += 1
        path.push(words)

    def said(raw: str) -> None:
        nonlocal linked
        if raw and hidden is None:
            raw = html.unescape(raw)
            text.append(raw)
            if open_now["a"]:
                linked += len(raw.strip())

    at, last, odd = 0, page.rfind(">") + 1, 0
    while at < last and (m := (TOKEN if odd <= ODD_QUOTES * len(page) else PLAIN_TOKEN).search(page, at, last)):
        said(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):  # a comment that is never closed
                at = len(page)
            continue
        if m[5]:
            odd += last - m.start()
        own = name if foreign is None else f"{stack[foreign][0]}:{name}"
        if m[1] or m[4]:
            found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in (name, own)), None) if open_now[name] or open_now[own] else None
            if found is not None:
                pop(found)
            elif name not in INLINE and foreign is None:
                flush()
            continue
        attributes = m[3] or m[6] or ""
        if foreign is not None:
            if name not in BREAKS_OUT or any(n in HOLDS_HTML for n, _ in stack[foreign + 1 :]):
                if not (name in VOID or attributes.endswith("/") and not UNQUOTED.search(attributes)):
                    if hidden is None and own in HIDDEN:
                        hidden = len(stack)
                    push(own, [])
                continue
            pop(foreign)
        if name in ("svg", "math"):
            if not attributes.endswith("/") or UNQUOTED.search(attributes):
                foreign = len(stack)
        elif name in RAW or name == "select" and (end := SELECT_END.search(page, at, last)) and end[1]:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            flush()
            continue
        elif name in ENDS_P and hidden is not None and stack[hidden][0] == "select":  # it was never closed
            pop(hidden)
        closed = CLOSES.get(name, {"p"} if name in ENDS_P else set())
        for k in range(len(stack) - 1, -1, -1) if any(open_now[n] for n in closed) else ():
            if stack[k][0] in closed:
                pop(k)
                break
            if stack[k][0] in CONTAINERS:
                break
        if name == "br":
            text.append(" ")
        elif name not in INLINE:
            flush()
        if name not in VOID and (name not in ("svg", "math") or foreign is not None):
            if hidden is None and name in HIDDEN:
                hidden = len(stack)
            words = [] if name in ("svg", "math", "object") else [f"<{name}>"]  # these do not frame a text
            for a, b, c in NAMED.findall(attributes):
                words += PART.findall((a or b or c).lower())
            push(name, words)
    said(page[at:].partition("<!--")[0])
    flush()
    return out


TABLE = np.random.default_rng(7).integers(1, 2**62, 256, dtype=np.int64)


def vectors(found: list[tuple[str, np.ndarray, int, int]], first: int = 0, total: int | None = None) -> np.ndarray:
    """One row per block: path features, words, measures; `found` are the blocks from `first` on of a page of `total`."""
    n, total = len(found), total or len(found)
    x = np.zeros((n, PATHS + WORDS + MEASURES), np.float32)
    if not n:
        return x
    x[:, :PATHS] = [path for _, path, _, _ in found]
    texts = [t.lower().encode() for t, *_ in found]
    data = np.frombuffer(b" ".join(texts), np.uint8)
    begin = np.r_[0, np.flatnonzero(data == 32) + 1]
    hashed = np.add.reduceat(np.where(data == 32, 0, TABLE[data]), begin) * 0x9E3779B1
    owner = np.repeat(np.arange(n), [t.count(b" ") + 1 for t in texts])
    place = (hashed >> 20) % WORDS
    counts = np.bincount(owner * WORDS + place, minlength=n * WORDS).reshape(n, WORDS)
    x[:, PATHS : PATHS + WORDS] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    size = np.array([len(t) for t, *_ in found])
    link = np.array([k for *_, k in found])
    stops = np.array([sum(map(t.count, ".,;:!?")) for t, *_ in found])
    x[:, -MEASURES:] = np.column_stack([
        np.log1p(size) / 5, np.minimum(link / size, 1), np.minimum(stops / size * 20, 2), [t[-1] in ".!?\"'" for t, *_ in found],
        size > 80, size < 25, np.arange(first, first + n) / total, [p / 10 for _, _, p, _ in found]])
    return x


class Labeller:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, seed: int = 0):
        rnd, d, h = np.random.default_rng(seed), PATHS + WORDS + MEASURES, HIDDEN_SIZE
        self.w = {}
        for side in "fb":
            self.w["x" + side] = rnd.normal(0, 0.1, (d, 4 * h)).astype(np.float32)
            self.w["h" + side] = rnd.normal(0, 0.2, (h, 4 * h)).astype(np.float32)
            self.w["c" + side] = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)].astype(np.float32)
        self.w["o"], self.w["b"] = rnd.normal(0, 0.1, 2 * h).astype(np.float32), np.zeros(1, np.float32)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """x (steps, pages, features), read in order for f and backwards for b."""
        steps, pages, _ = x.shape
        h = c = np.zeros((pages, HIDDEN_SIZE), np.float32)
        z = x.reshape(steps * pages, -1) @ self.w["x" + side] + self.w["c" + side]
        z = z.reshape(steps, pages, -1)
        out, tape = np.zeros((steps, pages, HIDDEN_SIZE), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g = z[t] + h @ self.w["h" + side]
            i, f, o = np.split(1 / (1 + np.exp(-g[:, : 3 * HIDDEN_SIZE])), 3, axis=1)
            u, m = np.tanh(g[:, 3 * HIDDEN_SIZE :]), mask[t][:, None]
            c_new = f * c + i * u
            tape.append((t, h, c, i, f, o, u, c_new))
            c = m * c_new + (1 - m) * c
            h = m * (o * np.tanh(c_new)) + (1 - m) * h
            out[t] = h
        return out, tape

    def scores(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        (hf, tf), (hb, tb) = self._run("f", x, mask), self._run("b", x, mask)
        both = np.concatenate([hf, hb], axis=2)
        return 1 / (1 + np.exp(-(both @ self.w["o"] + self.w["b"]))), (both, tf, tb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (both, *tapes) = self.scores(x, mask)
        d = (p - y) * mask / mask.sum()
        g = {"o": np.einsum("tp,tph->h", d, both), "b": d.sum(keepdims=True).reshape(1)}
        for k, (side, tape) in enumerate(zip("fb", tapes, strict=True)):
            into = d[:, :, None] * self.w["o"][k * HIDDEN_SIZE : (k + 1) * HIDDEN_SIZE]
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN_SIZE), np.float32)
            g["h" + side] = np.zeros_like(self.w["h" + side])
            dh = dc = np.zeros((x.shape[1], HIDDEN_SIZE), np.float32)
            for t, h, c, i, f, o, u, c_new in reversed(tape):
                m = mask[t][:, None]
                dh = dh + into[t]
                th = np.tanh(c_new)
                dcn = m * (dc + dh * o * (1 - th * th))
                dz[t] = np.concatenate([dcn * u * i * (1 - i), dcn * c * f * (1 - f), m * dh * th * o * (1 - o), dcn * i * (1 - u * u)], axis=1)
                g["h" + side] += h.T @ dz[t]
                dh = dz[t] @ self.w["h" + side].T + (1 - m) * dh
                dc = dcn * f + (1 - m) * dc
            flat = dz.reshape(-1, 4 * HIDDEN_SIZE)
            g["x" + side], g["c" + side] = x.reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 32, rate: float = 0.015, seed: int = 0) -> None:
        """Adam over padded batches of pages of like length, at a rate that falls to a tenth."""
        first, second, step = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        pages = sorted(pages, key=lambda p: len(p[0]))
        groups = [pages[a : a + batch] for a in range(0, len(pages), batch)]
        rnd = random.Random(seed)
        for epoch in range(epochs):
            now = rate * 0.1 ** (epoch / max(epochs - 1, 1))
            rnd.shuffle(groups)
            for group in groups:
                x, mask = padded([p[0] for p in group])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, label) in enumerate(group):
                    y[: len(label), k] = label
                step += 1
                for k, d in self.gradients(x, mask, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.999 * second[k] + 0.001 * d * d
                    self.w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """For each page's blocks, which are main text. Features meet the weights piece by piece, before any padding."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
        into, add = np.hstack([self.w["xf"], self.w["xb"]]), np.concatenate([self.w["cf"], self.w["cb"]])
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * len(pages[order[b]]) <= CELLS:
                b += 1
            own, a = order[a:b], b
            size = np.array([len(pages[k]) for k in own])
            z = np.zeros((size.max(), len(own), 2, 4 * HIDDEN_SIZE), np.float32)
            for j, k in enumerate(own):
                for at in range(0, len(pages[k]), 4096):
                    piece = pages[k][at : at + 4096]
                    z[at : at + len(piece), j] = (vectors(piece, at, len(pages[k])) @ into + add).reshape(len(piece), 2, -1)
            p = self._both_ways(z, size)
            for j, k in enumerate(own):
                out[k] = p[: size[j], j] >= 0.5
        return out

    def _both_ways(self, z: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Scores (steps, pages) from what the features bring; both directions take their steps together and keep no tape."""
        steps, pages = z.shape[:2]
        turn = np.stack([self.w["hf"], self.w["hb"]])
        h, c = (np.zeros((2, pages, HIDDEN_SIZE), np.float32) for _ in range(2))
        out, each = np.zeros((steps, pages), np.float32), np.stack([self.w["o"][:HIDDEN_SIZE], self.w["o"][HIDDEN_SIZE:]])
        g = np.empty((2, pages, 4 * HIDDEN_SIZE), np.float32)
        for t in range(steps):
            back = steps - 1 - t
            g[0], g[1] = z[t, :, 0], z[back, :, 1]
            g += h @ turn
            gate = 1 / (1 + np.exp(np.minimum(-g[:, :, : 3 * HIDDEN_SIZE], 80)))
            c_new = gate[:, :, HIDDEN_SIZE : 2 * HIDDEN_SIZE] * c + gate[:, :, :HIDDEN_SIZE] * np.tanh(g[:, :, 3 * HIDDEN_SIZE :])
            live = np.stack([t < size, back < size])[:, :, None]
            c = np.where(live, c_new, c)
            h = np.where(live, gate[:, :, 2 * HIDDEN_SIZE :] * np.tanh(c_new), h)
            out[t] += h[0] @ each[0]
            out[back] += h[1] @ each[1]
        return 1 / (1 + np.exp(-(out + self.w["b"])))


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), PATHS + WORDS + MEASURES), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


# Usual names of the parts of a page, as (tag, class or id words).
PLACES = {
    "article": [("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "main-content"), ("div", "post-body"), ("div", "entry-content"),
                ("section", "article"), ("div", "article-body"), ("div", "story"), ("div", "text"), ("main", "main"), ("div", "")],
    "menu": [("nav", ""), ("nav", "menu"), ("div", "menu"), ("div", "navbar"), ("ul", "nav"), ("div", "breadcrumb"), ("div", "navigation"), ("nav", "toc")],
    "header": [("header", ""), ("div", "header"), ("div", "masthead"), ("header", "site-header"), ("div", "top-bar"), ("div", "banner")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "copyright"), ("footer", "site-footer"), ("div", "bottom"), ("div", "legal")],
    "sidebar": [("aside", ""), ("div", "sidebar"), ("aside", "sidebar"), ("div", "related"), ("div", "widget"), ("div", "right-column"), ("section", "recommended")],
    "notice": [("div", "notice"), ("div", "cookie-notice"), ("div", "cookie-banner"), ("div", "alert"), ("div", "consent"), ("section", "notice"), ("noscript", ""), ("p", "notice"), ("div", "popup")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("div", "promo"), ("aside", "ad"), ("section", "advert"), ("p", "ad")],
    "form": [("form", ""), ("form", "search"), ("div", "newsletter"), ("div", "subscribe"), ("form", "login"), ("fieldset", ""), ("div", "signup")],
    "comments": [("section", "comments"), ("div", "comments"), ("ol", "comment-list"), ("div", "comment"), ("div", "reader-comments"), ("div", "discussion"), ("ul", "replies"), ("section", "responses")],
}


def training_pages(words: list[str], pages: int = 1500, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vectors, labels) of built pages; marks around the texts tell their labels and are taken out again."""
    rnd = random.Random(seed)

    def sentence(low: int, high: int) -> str:
        return " ".join(rnd.choices(words, k=rnd.randint(low, high))).capitalize() + rnd.choice([".", ".", ".", "", "!", "?"])

    def place(kind: str, inner: str) -> str:
        tag, name = rnd.choice(PLACES[kind])
        attribute = f' {rnd.choice(["class", "id"])}="{name}"' if name else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def text(label: int, low: int, high: int) -> str:
        return f"{label}\x01{sentence(low, high)}"

    def paragraph(label: int, low: int, high: int) -> str:
        return rnd.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}<br>"]).format(text(label, low, high))

    def other(kind: str) -> str:
        if kind == "menu":
            items = "".join(f'<li><a href="/x">{text(0, 1, 3)}</a></li>' for _ in range(rnd.randint(1, 8)))
            inner = f"<ul>{items}</ul>" if rnd.random() < 0.8 else "".join(f'<div><a href="/x">{text(0, 1, 3)}</a></div>' for _ in range(4))
        elif kind == "comments":
            inner = (f"<h3>{text(0, 1, 3)}</h3>" if rnd.random() < 0.6 else "") + "".join(
                rnd.choice(["<div>{}</div>", "<li>{}</li>", "<article>{}</article>", "<p>{}</p>"]).format(text(0, 2, 40)) for _ in range(rnd.randint(1, 6)))
        elif kind == "form":
            inner = f"<label>{text(0, 1, 4)}</label><input><button>{text(0, 1, 2)}</button>" + (paragraph(0, 2, 20) if rnd.random() < 0.3 else "")
        elif kind == "sidebar":
            inner = f"<h3>{text(0, 1, 4)}</h3>" + "".join(
                rnd.choice(['<li><a href="/x">{}</a></li>', "<p>{}</p>", "<div>{}</div>"]).format(text(0, 2, 25)) for _ in range(rnd.randint(1, 5)))
        else:
            inner = "".join(rnd.choice(["{}", "<p>{}</p>", "<div>{}</div>"]).format(text(0, 1, rnd.choice([6, 15, 40]))) for _ in range(rnd.randint(1, 2)))
        return place(kind, inner)

    def article() -> str:
        body = [rnd.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>"]).format(text(1, 1, 10))] if rnd.random() < 0.85 else []
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 9, 14])):
            body.append(paragraph(1, 1, rnd.choice([6, 30, 120])))
            kind = rnd.random()
            if kind < 0.06:
                body.append(f"<h2>{text(1, 1, 6)}</h2>")
            elif kind < 0.1:
                body.append("<ul>" + "".join(f"<li>{text(1, 2, 15)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.14:
                body.append(f"<blockquote>{paragraph(1, 4, 30)}</blockquote>")
            elif kind < 0.22:
                body.append(other(rnd.choice(["advert", "sidebar", "form", "notice"])))
        body = body or [paragraph(1, 1, 60)]
        if rnd.random() < 0.15:
            body.append(other("comments"))
        return place("article", "".join(body))

    out = []
    for _ in range(pages):
        before = [other(k) for k in ("header", "notice", "menu", "advert", "sidebar", "form") if rnd.random() < {"menu": 0.7, "advert": 0.4}.get(k, 0.3)]
        after = [other(k) for k in ("comments", "advert", "sidebar", "form", "menu", "notice") if rnd.random() < 0.25]
        rnd.shuffle(before)
        page = "".join(before) + (article() if rnd.random() < 0.97 else "") + "".join(after) + (other("footer") if rnd.random() < 0.8 else "")
        if rnd.random() < 0.3:
            page = f'<div class="{rnd.choice(["wrapper", "page", "container", "site"])}">{page}</div>'
        found = blocks(f"<html><body>{page}")
        if found:
            label = np.array([t.split("\x01")[0][-1] == "1" for t, *_ in found], np.float32)
            out.append((vectors([(re.sub(r"[01]\x01", "", t) or "-", *rest) for t, *rest in found]), label))
    return out


def fitted(pages: DataFrame, sample: int = 200, vocabulary: int = 20000, key: str = "page_id", column: str = "html", seed: int = 0) -> Labeller:
    """A labeller trained on built pages with at most `vocabulary` words of the pages of `sample` ids."""
    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0):
                words = {w for t, *_ in blocks(page.as_py()) for w in t.split(" ") if len(w) < 40 and "\x01" not in w}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], ["word"])

    ids = pages.select(key).distinct().orderBy(F.xxhash64(key), key).limit(sample)
    words = pages.select(key, column).join(F.broadcast(ids), key).select(column).mapInArrow(words_of, "word string").distinct()
    words = sorted(r["word"] for r in words.orderBy(F.xxhash64("word"), "word").limit(vocabulary).collect())
    random.Random(seed).shuffle(words)
    model = Labeller(seed)
    model.fit(training_pages(words or ["text", "word", "page", "and", "more"], seed=seed), seed=seed)
    return model


def main_text(pages: DataFrame, model: Labeller, column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 64):
                part = batch.slice(a, 64)
                found = [blocks(t.as_py()) for t in part.column(2)]
                labels = model.label(found)
                texts = ["\n\n".join(t for (t, *_), keep in zip(b, on, strict=True) if keep) for b, on in zip(found, labels, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", column).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
