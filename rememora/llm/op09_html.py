"""HTML extraction: a bidirectional LSTM labels every block of a page as main text or not.

A page is read as leaf blocks: text between block-level tags, with the path of open elements. Each
block is a vector of hashed path parts (tags, class and id words), hashed words and a few ratios; the
network, written in numpy, reads a page's blocks in both directions, so each is judged in the context
of the whole document. Pages of like length run as one padded batch.

The network is trained when the operator runs, from a sample of about ``sample_pages`` pages drawn by
hash (pages above ``sample_bytes`` are not drawn): their blocks labelled by what their elements mean in
HTML, and made-up layouts filled with their text, in which the same kinds of block (menus, headers,
footers, sidebars, notices, adverts, forms, comments, articles) take other tags and names. The seed is
fixed. Every page is extracted whole.

White space inside a block becomes one space, blocks are joined by a line feed, character references
are decoded, tags cut off by the end of the page are dropped. Nulls and odd input: a null or empty
html, or a page without main text, gives an empty text. Equal rows are extracted each. An empty table
gives no rows.
"""

from __future__ import annotations

import functools
import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rememora.llm.common import drawn_share, filled, no_cycles, slices, table, type_of

SAMPLE_PAGES = 200
SAMPLE_BYTES = 100_000
LAYOUTS = 500
EPOCHS = 6
HIDDEN = 16
PATH_BUCKETS, WORD_BUCKETS, RATIOS = 160, 32, 8
WIDTH = PATH_BUCKETS + WORD_BUCKETS + RATIOS

# Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img ins del kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr br object math svg noscript select datalist option optgroup".split())
EMBEDDED = frozenset("math svg".split())  # their elements are inline and may close themselves; those of BREAKS end them
BREAKS = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr li menu ol p pre table ul".split())
SECTIONS = frozenset("article aside footer form header main nav section td th tr".split())
# raw text up to the closing tag; an iframe that is never closed is empty
RAW = frozenset("script style title textarea iframe".split())
DROPPED = frozenset("select datalist template".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S)
_RARE = re.compile(r"<(?:math|svg|select|datalist|template)\b", re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")


class Buckets(dict):
    """Hashed bucket of a word, kept once computed."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = zlib.crc32(word.encode()) % self.size
        return out


_path_bucket, _word_bucket = Buckets(PATH_BUCKETS), Buckets(WORD_BUCKETS)


@functools.lru_cache(10_000)
def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """An element's path parts: its tag, and the words of its class, id and role."""
    found = [tag]
    if "=" in attributes:
        for m in _NAMES.finditer(attributes):
            found += [f".{x}" for x in _PART.findall(entities.unescape(m[1] or m[2] or m[3] or "").lower())]
    return tuple(found)


@functools.lru_cache(100)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I)


@functools.lru_cache(20_000)
def _path_places(path: tuple[str, ...]) -> np.ndarray:
    parts = [*path, "leaf:" + path[-1]] if path else []
    return np.array(sorted({_path_bucket[x] for x in parts}), np.int64)


def blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """Leaf blocks in page order: text, path parts, characters inside links."""
    out: list[tuple[str, tuple[str, ...], int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    path: tuple[str, ...] = ()
    linked = at = 0
    rare = bool(_RARE.search(page))

    def embedded() -> bool:
        """Inside mathematics or drawings, but not in a drawing's HTML."""
        inner = next((t for t, _ in reversed(stack) if t in EMBEDDED or t == "foreignobject"), "") if rare else ""
        return inner in EMBEDDED

    def flush():
        nonlocal text, linked
        if text:
            joined = "".join(text)
            joined = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
            if joined:
                out.append((joined, path, linked))
        text, linked = [], 0

    def add(piece: str):
        nonlocal path, linked
        if not piece or rare and any(tag in DROPPED for tag, _ in stack):
            return
        if not text:
            path = tuple(x for _, parts in stack for x in parts)
        text.append(piece)
        if any(tag == "a" for tag, _ in stack[-4:]):
            linked += len(piece)

    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        inline = tag in INLINE or embedded()
        if rare and tag in BREAKS | SECTIONS and embedded():
            while not closing and embedded():
                stack.pop()
            inline = False
        if tag == "br" or tag == "hr":
            text.append(" ") if tag == "br" and text else flush()
            continue
        if closing:
            if any(t == tag for t, _ in stack):
                if not inline:
                    flush()
                while stack.pop()[0] != tag:
                    pass
            elif not inline:
                flush()
            continue
        if tag in RAW:
            end = _closing(tag).search(page, at)
            if not attributes.rstrip().endswith("/"):
                at = end.end() if end else at if tag == "iframe" else len(page)
            continue
        if rare and attributes.rstrip().endswith("/") and (tag in EMBEDDED or embedded()):
            continue
        if not inline:
            flush()
            shut = CLOSES.get(tag)
            if shut is None and any(t == "p" for t, _ in stack):
                shut = {"p"}
            if shut:
                scope = SCOPES.get(tag, {"article", "section", "div", "aside", "nav", "footer", "header", "main", "form", "td", "blockquote", "li"})
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in shut:
                        del stack[k:]
                        break
                    if stack[k][0] in scope:
                        break
        if tag not in VOID:
            stack.append((tag, _names(tag, attributes)))
    flush()
    return out


def vectors(page_blocks: list[tuple[str, tuple[str, ...], int]]) -> np.ndarray:
    """One row per block."""
    n = len(page_blocks)
    x = np.zeros((n, WIDTH), np.float32)
    for k, (text, path, linked) in enumerate(page_blocks):
        x[k, _path_places(path)] = 1
        words = text.lower().split()
        counts = np.bincount(np.fromiter(map(_word_bucket.__getitem__, words), np.int64, len(words)), minlength=WORD_BUCKETS)
        x[k, PATH_BUCKETS:PATH_BUCKETS + WORD_BUCKETS] = np.sqrt(counts / len(words))
        size = len(text)
        x[k, PATH_BUCKETS + WORD_BUCKETS:] = (
            np.log1p(len(words)) / 4, min(linked / size, 1.0), text.count(",") / len(words), (text[-1] in ".!?…\"") * 1.0,
            k / n, len(path) / 10, np.log1p(n) / 5, sum(map(text.count, "|©·»")) / len(words))
    return x


class Network:
    """Two LSTMs over a page's blocks, one in each direction, and a logistic layer on both states."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, seed: int = 9):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"ox": make(2 * hidden, 1), "ob": np.zeros(1, np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden:2 * hidden] = 1
            self.p |= {d + "x": make(width, 4 * hidden), d + "h": make(hidden, 4 * hidden), d + "b": bias}

    @staticmethod
    def _sigmoid(z):
        return 0.5 * (1 + np.tanh(0.5 * z))

    def _run(self, d: str, x: np.ndarray, turn: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
        """States over (batch, time, width), in the order of ``turn``."""
        b, steps, _ = x.shape
        n = self.hidden
        gates = (x.reshape(b * steps, -1) @ self.p[d + "x"] + self.p[d + "b"]).reshape(b, steps, 4 * n)
        if turn is not None:
            gates = np.take_along_axis(gates, turn, 1)
        h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
        out = np.zeros((b, steps, n), np.float32)
        for t in range(steps):
            z = gates[:, t] + h @ self.p[d + "h"]
            s = self._sigmoid(z[:, :3 * n])
            g = np.tanh(z[:, 3 * n:])
            i, f, o = s[:, :n], s[:, n:2 * n], s[:, 2 * n:]
            before = c
            c = f * c + i * g
            th = np.tanh(c)
            if keep is not None:
                keep.append((h, before, i, f, o, g, th))
            h = o * th
            out[:, t] = h
        return out

    def _back(self, d: str, x: np.ndarray, keep: list, dout: np.ndarray, grad: dict) -> None:
        b, steps, _ = x.shape
        n = self.hidden
        dz_all = np.zeros((b, steps, 4 * n), np.float32)
        dh, dc = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
        gh = np.zeros_like(self.p[d + "h"])
        for t in range(steps - 1, -1, -1):
            h0, c0, i, f, o, g, th = keep[t]
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz_all[:, t] = dz
            gh += h0.T @ dz
            dh, dc = dz @ self.p[d + "h"].T, dc * f
        flat = dz_all.reshape(b * steps, -1)
        grad[d + "x"], grad[d + "h"], grad[d + "b"] = x.reshape(b * steps, -1).T @ flat, gh, flat.sum(axis=0)

    @staticmethod
    def _turned(sizes: np.ndarray, steps: int) -> np.ndarray:
        """Time steps of each row from its last block to its first; padding stays behind."""
        t = np.arange(steps)[None]
        return np.where(t < sizes[:, None], sizes[:, None] - 1 - t, t)

    def forward(self, x: np.ndarray, sizes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        turn = self._turned(sizes, x.shape[1])[:, :, None]
        if keep is not None:
            keep |= {"f": [], "b": [], "back": np.take_along_axis(x, turn, 1), "turn": turn}
        hf = self._run("f", x, None, None if keep is None else keep["f"])
        hb = np.take_along_axis(self._run("b", x, turn, None if keep is None else keep["b"]), turn, 1)
        both = np.concatenate([hf, hb], axis=2)
        if keep is not None:
            keep["both"] = both
        return self._sigmoid(both @ self.p["ox"] + self.p["ob"])[:, :, 0]

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 32,
              rate: float = 0.01, seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        order = np.argsort([len(p) for p in pages], kind="stable")
        parts = [order[k:k + batch] for k in range(0, len(order), batch)]
        step = 0
        for _ in range(epochs):
            for which in rng.permutation(len(parts)):
                x, sizes = padded([pages[i] for i in parts[which]])
                y = np.zeros(x.shape[:2], np.float32)
                for r, i in enumerate(parts[which]):
                    y[r, :len(labels[i])] = labels[i]
                real = np.arange(x.shape[1])[None] < sizes[:, None]
                keep: dict = {}
                p = self.forward(x, sizes, keep)
                dz = (np.where(real, p - y, 0) / real.sum()).astype(np.float32)[:, :, None]
                grad = {"ox": keep["both"].reshape(-1, 2 * self.hidden).T @ dz.reshape(-1, 1), "ob": dz.sum(axis=(0, 1))}
                dboth = dz @ self.p["ox"].T
                self._back("f", x, keep["f"], dboth[:, :, :self.hidden], grad)
                self._back("b", keep["back"], keep["b"], np.take_along_axis(dboth[:, :, self.hidden:], keep["turn"], 1), grad)
                step += 1
                for k, g in grad.items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)

    def main(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each block of each page; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            last = at
            while last < len(order) and (last - at + 1) * len(pages[order[last]]) <= 12_000:
                last += 1
            part = order[at:max(last, at + 1)]
            x, sizes = padded([pages[i] for i in part])
            for row, i in zip(self.forward(x, sizes), part):
                out[i] = row[:len(pages[i])]
            at += len(part)
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), sizes.max(), WIDTH), np.float32)
    for k, p in enumerate(pages):
        x[k, :len(p)] = p
    return x, sizes


# What elements and names say about a block when training labels are made.
BESIDE_TAGS = frozenset("nav footer aside form header menu dialog button fieldset".split())
BESIDE_NAMES = frozenset("ad ads advert banner promo sponsored sidebar menu nav navigation navbar breadcrumb footer header cookie consent notice "
                         "comment comments reply replies share social related widget newsletter subscribe login popup modal disclaimer".split())
MAIN_TAGS = frozenset("article main".split())


def taught(path: tuple[str, ...]) -> float:
    """Training label of a sampled page's block: inside an article or main element and nothing set beside it."""
    inside = False
    for part in path:
        if part in MAIN_TAGS:
            inside = True
        elif part in BESIDE_TAGS or part.startswith(".") and part[1:] in BESIDE_NAMES:
            return 0.0
    return float(inside)


# Tags and names of made-up layouts, by the kind of block.
MENU = ["<nav>|</nav>", "<nav class='navbar'>|</nav>", "<div class='menu'>|</div>", "<div id='nav'>|</div>", "<ul class='navigation'>|</ul>",
        "<div class='breadcrumb'>|</div>", "<menu>|</menu>", "<div role='navigation'>|</div>", "<header>|</header>", "<nav class='toc'>|</nav>"]
HEAD = ["<header>|</header>", "<div class='header'>|</div>", "<div id='masthead'>|</div>", "<header class='site-header'>|</header>",
        "<div class='top-bar'>|</div>", "<div class='branding logo'>|</div>"]
FOOT = ["<footer>|</footer>", "<div class='footer'>|</div>", "<div id='footer'>|</div>", "<footer class='site-footer'>|</footer>",
        "<div class='copyright'>|</div>", "<div class='legal'>|</div>"]
SIDE = ["<aside>|</aside>", "<div class='sidebar'>|</div>", "<aside class='related'>|</aside>", "<div id='sidebar'>|</div>",
        "<section class='related-posts'>|</section>", "<div class='widget'>|</div>", "<aside class='promo'>|</aside>", "<div class='share social'>|</div>"]
NOTICE = ["<div class='cookie'>|</div>", "<div class='cookie-notice'>|</div>", "<div id='consent'>|</div>", "<div class='notice'>|</div>",
          "<div class='banner'>|</div>", "<div class='newsletter'>|</div>", "<div class='popup modal'>|</div>", "<div role='dialog'>|</div>",
          "<div role='alert'>|</div>", "<div class='alert'>|</div>", "<section class='disclaimer'>|</section>", "<p class='notice'>|</p>"]
ADVERT = ["<div class='ad'>|</div>", "<div class='ads'>|</div>", "<div class='advert'>|</div>", "<div class='advertisement'>|</div>",
          "<section class='sponsored'>|</section>", "<div id='ad-slot'>|</div>", "<p class='ad'>|</p>", "<div class='promo'>|</div>",
          "<aside class='ad'>|</aside>", "<div class='sponsor'>|</div>"]
FORM = ["<form><label>|</label><button>Send</button></form>", "<form class='search'>|</form>", "<form><p>|</p></form>",
        "<form class='login'><label>|</label></form>", "<div class='subscribe'><form>|</form></div>", "<form class='newsletter'><fieldset>|</fieldset></form>"]
REPLY = ["<section class='comments'>|</section>", "<div id='comments'>|</div>", "<div class='comment-list'>|</div>", "<ol class='comments'>|</ol>",
         "<div class='reader-comments'>|</div>", "<ul class='replies'>|</ul>", "<div class='disqus responses'>|</div>", "<section id='discussion'>|</section>"]
ONE_REPLY = ["<p>|</p>", "<div class='comment'>|</div>", "<div class='comment'><p>|</p></div>", "<li class='comment'>|</li>", "<li><p>|</p></li>",
             "<article class='comment'><p>|</p></article>", "<blockquote>|</blockquote>", "<div class='reply'><b>name</b> |</div>"]
BODY = ["<article>|</article>", "<main>|</main>", "<main><article>|</article></main>", "<div class='content'>|</div>", "<div id='content'>|</div>",
        "<div class='article-body'>|</div>", "<div class='post'>|</div>", "<div class='entry-content'>|</div>", "<section class='story'>|</section>",
        "<div class='main'><div class='text'>|</div></div>", "<article class='post'>|</article>", "<article><section>|</section></article>",
        "<article><div class='body'>|</div></article>", "<div role='main'>|</div>", "<div>|</div>"]
PART = ["<p>|</p>", "<p>|", "<p><b>|</b></p>", "<p><b>|<br>", "<div>|</div>", "<h2>|</h2>", "<h3>|</h3>", "<ul><li>|</li></ul>", "<ol><li>|</li></ol>",
        "<blockquote>|</blockquote>", "<blockquote><p>|</p></blockquote>", "<table><tr><td>|</td></tr></table>", "<pre>|</pre>",
        "<p><a href='/x'>|</a></p>", "<figure><figcaption>|</figcaption></figure>", "<p>|</p>", "<p>|</p>", "<p>|</p>", "<dl><dd>|</dd></dl>"]


def made_up(texts: list[str], rng: np.random.Generator) -> tuple[str, list[float]]:
    """A page of a random layout and the label of each of its blocks, marked in its text."""
    labels: list[float] = []

    def some(items):
        return items[int(rng.integers(len(items)))]

    def fill(frame: str, inner: str) -> str:
        return frame.replace("|", inner)

    def leaf(label: float, words: tuple[int, int] | None = None) -> str:
        pick = some(texts).split() or ["text"]
        if words:
            begin = int(rng.integers(len(pick)))
            pick = pick[begin:begin + int(rng.integers(*words))] or pick[:1]
        labels.append(label)
        return entities.escape(" ".join(pick), quote=False)

    def menu():
        items = range(int(rng.integers(2, 8)))
        style = int(rng.integers(3))
        if style == 0:
            return fill(some(MENU), "<ul>" + "".join(f"<li><a href='/x'>{leaf(0, (1, 3))}</a></li>" for _ in items) + "</ul>")
        if style == 1:
            return fill(some(MENU), "".join(f"<div><a href='/x'>{leaf(0, (1, 3))}</a></div>" for _ in items))
        return fill(some(MENU), "<p>" + leaf(0, (2, 8)) + "</p>")

    def beside(frames, words=(2, 40)):
        def make():
            return fill(some(frames), fill(some(["|", "<p>|</p>", "<div>|</div>", "<h3>|</h3>", "<ul><li>|</li></ul>", "<span>|</span>"]), leaf(0, words)))
        return make

    def replies():
        return fill(some(REPLY), "".join(fill(some(ONE_REPLY), leaf(0, (3, 80) if rng.random() < 0.7 else None)) for _ in range(int(rng.integers(1, 6)))))

    def form():
        frame = some(FORM)
        before, after = frame.split("|")
        out = before + leaf(0, (1, 12)) + after
        if "<button>" in after:
            labels.append(0.0)
        return out

    kinds = [menu, beside(HEAD, (1, 12)), beside(SIDE), beside(NOTICE), beside(ADVERT), form]
    ends = [beside(FOOT), beside(FOOT), menu, beside(SIDE), beside(ADVERT), form, beside(NOTICE), replies, replies]
    page = "".join(some(kinds)() for _ in range(int(rng.integers(0, 5))))
    frame = some(BODY).split("|")
    page += frame[0]
    if rng.random() < 0.7:
        page += f"<h1>{leaf(1, (2, 14))}</h1>"
    for _ in range(int(rng.integers(0, 14)) if rng.random() < 0.95 else 0):
        if rng.random() < 0.12:
            page += some([beside(ADVERT), beside(SIDE), beside(NOTICE), form, replies])()
        page += fill(some(PART), leaf(1, (1, 30) if rng.random() < 0.4 else None))
    page += frame[1] + "".join(some(ends)() for _ in range(int(rng.integers(0, 5))))
    return f"<html><body>{page}</body></html>", labels


def train(sample: list[str], layouts: int = LAYOUTS, epochs: int = EPOCHS, seed: int = 9) -> Network:
    """A network from sampled pages and made-up layouts; without a sample, layouts hold a few plain words."""
    rng = np.random.default_rng(seed)
    pages, labels, texts = [], [], []
    for page in sample:
        found = blocks(page)
        if found:
            pages.append(vectors(found))
            labels.append(np.array([taught(path) for _, path, _ in found]))
            texts += [t for t, _, _ in found if len(t.split()) > 3]
    texts = texts or ["words of a page that nobody wrote, one after another."]
    for _ in range(layouts):
        page, marks = made_up(texts, rng)
        found = blocks(page)
        if found and len(found) == len(marks):
            pages.append(vectors(found))
            labels.append(np.array(marks))
    net = Network(seed=seed)
    net.train(pages, labels, epochs)
    return net


def fit(df: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_bytes: int = SAMPLE_BYTES, **options) -> Network:
    rows = df.where(F.octet_length(html_col).between(1, sample_bytes)).select(html_col, F.xxhash64(html_col).alias("h"))
    # about twice as many are drawn, each text once, before the least hashes are taken: tasks send few pages however many there are
    drawn = drawn_share(rows, F.col("h"), 2 * sample_pages, df.count()).dropDuplicates(["h"])
    return train([r[0] for r in drawn.orderBy("h").limit(sample_pages).select(html_col).collect()], **options)


def extract(df: DataFrame, net: Network, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), certainty: float = 0.5) -> DataFrame:
    """``(keep..., text, n_chars)``."""
    def run(batches):
        with no_cycles():
            for batch in batches:
                for part in slices(batch, html_col):
                    found = [blocks(p) for p in filled(part, html_col).to_pylist()]
                    main = net.main([vectors(f) for f in found])
                    texts = ["\n".join(b[0] for b, p in zip(f, m) if p >= certainty) for f, m in zip(found, main)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()),
                                                      pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kinds = "".join(f"{c} {type_of(df, c)}, " for c in keep)
    return df.select(*keep, html_col).mapInArrow(run, f"{kinds}text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
