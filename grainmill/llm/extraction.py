"""Main text of web pages by a recurrent block labeller.

A page is cut at block-level tags into leaf blocks. Each block has a vector:
hashed words of its tag path (tag names, and words of class, id and role),
hashed words of its text, and a few densities. A bidirectional LSTM, in numpy,
reads the sequence of a page's blocks, so that a block is judged with the whole
page in view, and gives each a probability of being main text. Those of THRESHOLD
or more are the result, in page order.

No page is labelled, so the network is taught by a bounded sample of MAX_PAGES
pages: blocks whose path says what they are (``article``, ``nav`` and the like)
are given, others are not judged; and each sampled page is laid out anew several
times, its main and other texts dealt to random layouts with menus, sidebars,
notices, forms, adverts and comments, with and without telling names. Shards of
the sample train at the same time, and their weights are averaged every round.

Character references are decoded, white space inside a block becomes one space,
and empty blocks vanish. Scripts, styles, comments, controls and the head give
no block; ``br`` is white space. Broken markup is taken as it comes: an unclosed
element ends with the one around it, a cut tag at the end is dropped. A missing
html is a page without blocks, whose text is ''. Repeated rows are pages each.
An empty table gives no rows. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.session import Scratch

MAX_PAGES = 400
SHARDS = 8
ROUNDS = 6
EPOCHS = 2
EXAMPLES = 180  # of a shard in a round, pages and made layouts
BATCH = 12
HIDDEN = 16
PATH_DIM, WORD_DIM, DENSE_DIM = 128, 64, 14
WIDTH = PATH_DIM + WORD_DIM + DENSE_DIM
THRESHOLD = 0.5
BLOCKS_AT_ONCE = 16_384

TAG = re.compile(
    r"<!--.*?-->|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s>]++)", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|§")
CUT = re.compile(r"<(?:!|/?[A-Za-z]|!--).*\Z", re.S)

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html ins legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
HIDDEN_TAGS = frozenset(
    "script style noscript template head title iframe object svg math select textarea button canvas audio video datalist".split()
)
VOID_TAGS = frozenset(["hr", "br", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"])
# An opening tag ends one of the second kind, unless one of the third is nearer.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
MARK = "§"  # a class word that marks the main blocks of made layouts


@dataclass
class Block:
    """Text of a leaf, the elements around it, outermost first, and its characters in links."""

    text: str
    path: tuple[str, ...]
    linked: int
    depth: int


def _names(tag: str, attributes: str) -> str:
    """The tag and the words of its class, id and role."""
    words = [f"<{tag}>"]
    if "=" in attributes:
        for value in ATTRIBUTE.findall(attributes):
            words += [w.lower() for w in NAME.findall(value)]
    return " ".join(words)


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page with any text."""
    page = page or ""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, in_link = 0, False
    path: tuple[str, ...] | None = ()
    hidden_until, end = -1, page.rfind(">") + 1

    def close() -> None:
        nonlocal linked, path
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            if path is None:
                path = tuple(names for _, names in stack)
            found.append(Block(text, path, min(linked, len(text)), len(stack)))
        parts.clear()
        linked = 0

    at = 0
    for m in TAG.finditer(page, 0, end):
        if m.start() < hidden_until:
            continue
        text = page[max(at, hidden_until) : m.start()] if at < m.start() else ""
        at = m.end()
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if tag in BLOCK_TAGS:
            close()
            path = None
            if closing:
                in_link = False
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in ENDS:
                ended, stops = ENDS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in stops:
                        break
                    if stack[k][0] in ended:
                        del stack[k:]
                        break
            attributes = m[3] if m[2] else m[6]
            if tag not in VOID_TAGS and not (attributes or "").endswith("/"):
                stack.append((tag, _names(tag, attributes or "")))
        elif tag in HIDDEN_TAGS:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                stop = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
                if stop is None and tag == "head":  # never closed: the body ends it
                    stop = re.compile(r"(?=<body)", re.I).search(page, at)
                hidden_until = stop.end() if stop else len(page)
                at = max(at, hidden_until)
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            parts.append(" ")
    rest = page[max(at, hidden_until) :]
    if rest:
        parts.append(CUT.sub("", rest))
    close()
    return found


# Words of paths that tell what a sampled block is.
MAIN_WORDS = frozenset(["<article>", "<main>", "article", "articlebody", "main", "content", "post", "entry", "story"])
OTHER_WORDS = frozenset(
    "<nav> <aside> <footer> <form> nav navbar menu sidebar footer ad ads advert advertisement sponsored promo cookie consent notice "
    "banner breadcrumb breadcrumbs related share social comment comments reply newsletter subscribe widget popup modal login search".split()
)


def told_label(path: tuple[str, ...]) -> float:
    """1 for main text, 0 for other text, NaN if the path does not tell."""
    words = [set(names.split()) for names in path]
    if any(w & OTHER_WORDS for w in words):
        return 0.0
    for k, w in enumerate(words):
        if w & MAIN_WORDS:
            return 1.0
        if ({"<header>", "header"} & w) and not any(v & MAIN_WORDS for v in words[:k]):
            return 0.0
    return float("nan")


def _hashed(word: str, size: int) -> tuple[int, float]:
    code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return code % size, 1.0 if code >> 31 else -1.0


class Vectors:
    """Block vectors; paths and words met before are remembered, up to a bound."""

    def __init__(self, bound: int = 50_000):
        self.bound = bound
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, tuple[int, float]] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        found = self.paths.get(path)
        if found is None:
            found = np.zeros(PATH_DIM, np.float32)
            inner = path[-1].split() if path else []
            words = {w for names in path for w in names.split()} | {f"last {w}" for w in inner}
            for word in words:
                if MARK not in word:
                    place, sign = _hashed(word, PATH_DIM)
                    found[place] += sign
            if len(self.paths) >= self.bound:
                self.paths.clear()
            self.paths[path] = found
        return found

    def __call__(self, pages: list[list[Block]]) -> np.ndarray:
        """blocks x WIDTH of all pages, one after the other."""
        flat = [block for page in pages for block in page]
        out = np.zeros((len(flat), WIDTH), np.float32)
        if not flat:
            return out
        out[:, :PATH_DIM] = np.stack([self.path(b.path) for b in flat])
        places, signs, counts = [], [], []
        for b in flat:
            words = b.text.lower().split()
            counts.append(len(words))
            for word in words:
                known = self.words.get(word)
                if known is None:
                    if len(self.words) >= self.bound:
                        self.words.clear()
                    known = self.words[word] = _hashed(word.strip(".,;:!?()\"'"), WORD_DIM)
                places.append(known[0])
                signs.append(known[1])
        n = np.array(counts, np.int64)
        row = np.repeat(np.arange(len(flat)), n)
        bag = np.bincount(row * WORD_DIM + np.array(places, np.int64), np.array(signs), len(flat) * WORD_DIM)
        bag = bag.reshape(-1, WORD_DIM) / np.sqrt(np.maximum(n, 1))[:, None]
        out[:, PATH_DIM : PATH_DIM + WORD_DIM] = np.clip(bag, -2, 2)
        size = np.array([len(b.text) for b in flat], np.float64)

        def share(characters: str) -> np.ndarray:
            return np.array([sum(map(b.text.count, characters)) for b in flat]) / size

        at = np.concatenate([np.arange(len(page)) for page in pages])
        of = np.repeat([len(page) for page in pages], [len(page) for page in pages])
        linked = np.array([b.linked for b in flat]) / size
        last = np.array([b.text[-1] in ".!?\"”»…" for b in flat])
        heading = np.array([bool(b.path) and b.path[-1][:2] == "<h" and b.path[-1][2:3].isdigit() for b in flat])
        around = np.convolve(linked, np.ones(5) / 5, "same") if len(flat) >= 5 else linked
        dense = [
            np.log1p(size) / 8, np.log1p(n) / 6, size / np.maximum(n, 1) / 10, linked, share(".!?") * 20, share(",;:") * 20,
            share("0123456789") * 4, share("|/©»›") * 10, last, heading, at / np.maximum(of, 1), np.log1p(of) / 6,
            np.array([b.depth for b in flat]) / 10, around,
        ]
        out[:, PATH_DIM + WORD_DIM :] = np.stack(dense, axis=1)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _steps(sizes: np.ndarray, backward: bool) -> list[np.ndarray]:
    """Rows of the first blocks of all pages, the second ones, and so on, longest page first."""
    firsts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    sorted_sizes = sizes[order]
    starts = firsts[order] + (sorted_sizes - 1 if backward else 0)
    move = -1 if backward else 1
    longest = int(sorted_sizes[0]) if len(sizes) else 0
    left = np.searchsorted(-sorted_sizes, -np.arange(longest), "left")
    return [starts[: left[t]] + move * t for t in range(longest)]


class Labeller:
    """A bidirectional LSTM with one output per block; its weights are one flat array."""

    def __init__(self, weights: np.ndarray | None = None, hidden: int = HIDDEN, width: int = WIDTH):
        self.hidden, self.width = hidden, width
        self.shapes = {"out": (2 * hidden, 1), "out_shift": (1,)}
        for side in ("ahead", "back"):
            self.shapes |= {f"{side}_in": (width, 4 * hidden), f"{side}_h": (hidden, 4 * hidden), f"{side}_shift": (4 * hidden,)}
        if weights is None:
            draw = np.random.default_rng(12)
            parts = [draw.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in self.shapes.values()]
            weights = np.concatenate([p.ravel() for p in parts])
        self.weights = weights.astype(np.float64)

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        found, at = {}, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            found[name] = flat[at : at + size].reshape(shape)
            at += size
        return found

    def _run(self, x: np.ndarray, steps: list[np.ndarray], w: dict, side: str) -> dict:
        n, h = len(x), self.hidden
        z = x @ w[f"{side}_in"] + w[f"{side}_shift"]
        state, cell, gates = np.zeros((n, h)), np.zeros((n, h)), np.zeros((n, 4 * h))
        for t, rows in enumerate(steps):
            now = z[rows]
            if t:
                before = steps[t - 1][: len(rows)]
                now = now + state[before] @ w[f"{side}_h"]
            gate = np.concatenate([_sigmoid(now[:, : 3 * h]), np.tanh(now[:, 3 * h :])], axis=1)
            value = gate[:, :h] * gate[:, 3 * h :]
            if t:
                value += gate[:, h : 2 * h] * cell[before]
            cell[rows], gates[rows] = value, gate
            state[rows] = gate[:, 2 * h : 3 * h] * np.tanh(value)
        return {"state": state, "cell": cell, "gates": gates, "steps": steps}

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, dict]:
        """Log odds of all blocks, and what the gradient needs."""
        w = self.parts(self.weights)
        sizes = sizes[sizes > 0]
        runs = {side: self._run(x, _steps(sizes, side == "back"), w, side) for side in ("ahead", "back")}
        both = np.concatenate([runs["ahead"]["state"], runs["back"]["state"]], axis=1)
        return (both @ w["out"] + w["out_shift"]).ravel(), runs | {"both": both}

    def gradient(self, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Of the mean log loss over the blocks with a label, by backpropagation through time."""
        odds, kept = self.forward(x, sizes)
        known = ~np.isnan(labels)
        error = np.where(known, _sigmoid(odds) - np.nan_to_num(labels), 0)[:, None] / max(1, known.sum())
        w, h = self.parts(self.weights), self.hidden
        flat = np.zeros_like(self.weights)
        g = self.parts(flat)
        g["out"][:] = kept["both"].T @ error
        g["out_shift"][:] = error.sum()
        spread = error @ w["out"].T
        for k, side in enumerate(("ahead", "back")):
            run = kept[side]
            steps, gates, cell = run["steps"], run["gates"], run["cell"]
            to_state, to_cell = spread[:, k * h : (k + 1) * h].copy(), np.zeros_like(cell)
            moved, earlier = np.zeros_like(gates), np.zeros_like(cell)
            for t in range(len(steps) - 1, -1, -1):
                rows = steps[t]
                i, f, o, c = (gates[rows, j * h : (j + 1) * h] for j in range(4))
                curve = np.tanh(cell[rows])
                d_state = to_state[rows]
                d_cell = to_cell[rows] + d_state * o * (1 - curve**2)
                before = steps[t - 1][: len(rows)] if t else None
                old = cell[before] if t else np.zeros_like(d_cell)
                dz = np.concatenate(
                    [d_cell * c * i * (1 - i), d_cell * old * f * (1 - f), d_state * curve * o * (1 - o), d_cell * i * (1 - c**2)], axis=1
                )
                moved[rows] = dz
                if t:
                    earlier[rows] = run["state"][before]
                    to_state[before] += dz @ w[f"{side}_h"].T
                    to_cell[before] += d_cell * f
            g[f"{side}_in"][:] = x.T @ moved
            g[f"{side}_h"][:] = earlier.T @ moved
            g[f"{side}_shift"][:] = moved.sum(0)
        return flat

    def scores(self, pages: list[list[Block]], vectors: Vectors) -> list[np.ndarray]:
        """Probability of each block of each page, in bounded portions."""
        found: list[np.ndarray] = []
        at = 0
        while at < len(pages):
            stop, size = at, 0
            while stop < len(pages) and (stop == at or size + len(pages[stop]) <= BLOCKS_AT_ONCE):
                size += len(pages[stop])
                stop += 1
            sizes = np.array([len(p) for p in pages[at:stop]], np.int64)
            values = _sigmoid(self.forward(vectors(pages[at:stop]), sizes)[0]) if size else np.zeros(0)
            found += np.split(values, np.cumsum(sizes)[:-1])
            at = stop
        return found


SENTENCES = ["it was said that this would go on", "no more of it came in time", "in the end all of them went there", "some had seen it before"]
NOTICES = [
    "We use cookies to improve your experience. Accept all", "Subscribe to our newsletter", "Sign in or register", "Skip to content",
    "This site uses cookies and similar technologies.", "Please enable JavaScript", "Sign up for updates",
]
LEGAL = ["© 2024 All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Contact us", "Copyright notice", "About"]
TALK = ["Reply", "Great post, thanks!", "I disagree with this.", "Posted by guest", "3 comments", "Leave a comment", "Log in to comment"]
LINKS = ["Home", "News", "Contact", "Archive", "Next", "Login", "Sports", "Shop", "Help", "Menu"]


def made_layout(draw: random.Random, main: list[str], other: list[str]) -> str:
    """A page with the texts in a random layout; main blocks carry MARK in their class."""
    opaque = lambda: f'div class="{draw.choice("bcdfgkmqxyz")}{draw.choice("aeiou")}{draw.randrange(99)}"'
    safe = entities.escape
    telling = draw.random() < 0.7

    def wrap(opening: str, inner: str) -> str:
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def pick(*ways: str) -> str:
        return draw.choice(ways) if telling or draw.random() < 0.3 else opaque()

    def some(texts: list[str], low: int, high: int) -> list[str]:
        return [draw.choice(texts) for _ in range(draw.randint(low, high))]

    def words(low: int, high: int) -> str:
        source = draw.choice(main + other + SENTENCES).split()
        begin = draw.randrange(max(1, len(source) - high))
        return " ".join(source[begin : begin + draw.randint(low, high)]) or "more"

    def links(low: int, high: int) -> str:
        items = [draw.choice([*LINKS, words(1, 2), words(2, 7)]) for _ in range(draw.randint(low, high))]
        if draw.random() < 0.75:
            return "<ul>" + "".join(f'<li><a href="/{k}">{safe(i)}</a></li>' for k, i in enumerate(items)) + "</ul>"
        return " | ".join(f'<a href="/{k}">{safe(i)}</a>' for k, i in enumerate(items))

    def advert() -> str:
        return wrap(
            pick('div class="ad"', 'div class="advert"', 'div id="ad-top"', 'div class="sponsored"', 'p class="promo"', "ins", 'div class="banner"'),
            safe(draw.choice([*other, words(4, 14), "Buy now", "Advertisement"])),
        )

    def article() -> str:
        parts = []
        if draw.random() < 0.7:
            head = f'<h1 class="{MARK}">{safe(words(2, 9))}</h1>'
            parts.append(wrap("header", head) if draw.random() < 0.25 else head)
        for text in main:
            kind = draw.random()
            if kind < 0.06:
                items = "".join(f'<li class="{MARK}">{safe(words(2, 9))}</li>' for _ in range(draw.randint(2, 5)))
                parts.append(f"<ul>{items}</ul>")
            elif kind < 0.12:
                parts.append(f'<h2 class="{MARK}">{safe(words(1, 6))}</h2>')
            elif kind < 0.16:
                parts.append(f'<blockquote class="{MARK}">{safe(words(4, 20))}</blockquote>')
            elif kind < 0.2:
                parts.append(f'<p class="{MARK}">See <a href="/x">{safe(words(2, 6))}</a></p>')
            style = draw.choice(["p", "p", "p", "p", "div"])
            words_of = text.split()
            if draw.random() < 0.2 and len(words_of) > 6:
                text = " ".join(words_of[: draw.randint(1, 6)])
            parts.append(f'<{style} class="{MARK}">{"<b>" if draw.random() < 0.1 else ""}{safe(text)}</{style}>')
            if draw.random() < 0.05:
                parts.append(advert())
        return wrap(
            pick("article", "article", "main", 'div class="content"', 'div id="main"', 'div class="post-body"', 'section class="story"', 'div class="entry"'),
            "".join(parts),
        )

    def sidebar() -> str:
        inner = "".join(draw.choice([wrap("h3", safe(words(1, 3))), links(2, 6), wrap("p", safe(words(3, 12))), advert()]) for _ in range(draw.randint(1, 4)))
        return wrap(pick("aside", 'div class="sidebar"', 'div id="sidebar-right"', 'div class="widget"', 'div class="related"'), inner)

    def comments() -> str:
        inner = "".join(
            wrap(draw.choice(['div class="comment"', "li", "p"]), wrap("p", safe(draw.choice([*TALK, words(5, 30)]))))
            for _ in range(draw.randint(1, 5))
        )
        return wrap(draw.choice(['section id="comments"', 'div class="comments"', 'ol class="commentlist"', 'div id="respond"']), wrap("h3", "Comments") + inner)

    def form() -> str:
        return wrap(draw.choice(["form", 'form class="search"', 'div class="newsletter"']), f"<label>{safe(draw.choice(NOTICES))}</label><input name=q><p>{safe(words(1, 6))}</p>")

    def notice() -> str:
        return wrap(pick('div class="cookie-notice"', 'div id="consent"', 'div class="notice"', 'div class="alert"', 'div role="dialog"'), safe(draw.choice([*NOTICES, words(4, 15)])))

    def top() -> str:
        inner = (wrap(draw.choice(["p", "h2", "div"]), safe(words(1, 4))) if draw.random() < 0.5 else "") + links(3, 9)
        return wrap(pick("header", "nav", "nav", 'div class="header"', 'div id="top-menu"', 'div class="navbar"'), inner)

    def bottom() -> str:
        inner = safe(draw.choice([*LEGAL, *other, words(4, 14)])) + (links(1, 5) if draw.random() < 0.4 else "")
        return wrap(pick("footer", "footer", 'div class="footer"', 'div id="bottom"'), inner)

    before = [part() for part in (top, notice, advert, form, sidebar) if draw.random() < (0.8 if part is top else 0.3)]
    after = [part() for part in (comments, sidebar, advert, form, notice) if draw.random() < 0.35]
    after += [bottom()] if draw.random() < 0.85 else []
    return f"<html><body>{''.join(before)}{article()}{''.join(after)}</body></html>"


def examples(pages: list[str | None], layouts: int = 2, seed: int = 12) -> Iterator[tuple[list[Block], np.ndarray]]:
    """Blocks and labels of the pages as they are, and of made layouts of their texts."""
    for k, page in enumerate(pages):
        draw = random.Random(seed * 1_000_003 + k)
        blocks = blocks_of(page)
        labels = np.array([told_label(b.path) for b in blocks])
        if len(blocks) and not np.isnan(labels).all():
            yield blocks, labels
        main = [b.text for b, v in zip(blocks, labels, strict=True) if v == 1][:40]
        other = [b.text for b, v in zip(blocks, labels, strict=True) if v == 0][:40]
        main = main or [" ".join(draw.choice(SENTENCES) for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(2, 9))]
        for _ in range(layouts):
            draw.shuffle(main)
            made = blocks_of(made_layout(draw, main[: draw.randint(1, 25)], other or LINKS))
            yield made, np.array([float(any(MARK in names for names in b.path)) for b in made])


def trained(labeller: Labeller, data: list[tuple[list[Block], np.ndarray]], epochs: int, rate: float, seed: int) -> Labeller:
    """A few epochs of Adam over batches of pages."""
    vectors = Vectors()
    x = [vectors([blocks]) for blocks, _ in data]
    weights = labeller.weights.copy()
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    turn, draw = 0, np.random.default_rng(seed)
    for _ in range(epochs):
        order = draw.permutation(len(data))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            sizes = np.array([len(x[k]) for k in rows], np.int64)
            now = Labeller(weights, labeller.hidden, labeller.width)
            grad = now.gradient(np.concatenate([x[k] for k in rows]), sizes, np.concatenate([data[k][1] for k in rows]))
            grad += 1e-5 * weights
            turn += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad**2
            weights -= rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    return Labeller(weights, labeller.hidden, labeller.width)


def _training_task(weights: np.ndarray, rate: float, turn: int):
    """Weights after a few epochs over the pages of a shard."""

    def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        texts = list(rows.sort_values(["mark", "html"])["html"])
        layouts = max(2, EXAMPLES // len(texts) - 1)
        data = list(examples(texts, layouts, 100 * turn + int(key[0])))
        done = trained(Labeller(weights), data, EPOCHS, rate, turn)
        return pd.DataFrame({"shard": [key[0]], "pages": [len(texts)], "weights": [done.weights.tobytes()]})

    return train


def fit_labeller(pages: DataFrame, max_pages: int = MAX_PAGES, shards: int = SHARDS, rounds: int = ROUNDS) -> Labeller:
    """Teach the network by at most ``max_pages`` pages, those of the least hashed ids.

    Each round every shard goes on from the averaged weights, as one task; only
    the weights of the shards reach the driver.
    """
    mark = F.xxhash64("page_id", F.lit(12))
    part = 1_000_000
    # Most pages are ruled out where they are read, before any are ordered.
    limit = min(part, 1 + 4 * max_pages * part // max(1, pages.count()))
    sample = pages.select("page_id", "html").where("html IS NOT NULL").where(F.pmod(mark, F.lit(part)) < limit)
    sample = sample.orderBy(mark, F.xxhash64("html"), "html").limit(max_pages)
    labeller = Labeller()
    with Scratch(pages.sparkSession) as scratch:
        kept = sample.withColumn("mark", mark).withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(shards)))
        kept = scratch.settle(kept.select("shard", "mark", "html").repartition(shards, "shard"))
        for turn in range(rounds):
            task = _training_task(labeller.weights, 0.01 if turn < rounds - 2 else 0.003, turn)
            dealt = kept.repartition(shards, "shard").groupBy("shard")
            done = dealt.applyInPandas(task, "shard long, pages long, weights binary").collect()
            if not done:
                break
            total = sum(r["pages"] for r in done)
            done.sort(key=lambda r: r["shard"])
            labeller = Labeller(sum(r["pages"] / total * np.frombuffer(r["weights"], np.float64) for r in done))
    return labeller


def label_blocks(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url and blocks: text, path and score of every leaf block."""
    kind = pages.schema["page_id"].dataType.simpleString()
    fields = pa.list_(pa.struct([("text", pa.string()), ("path", pa.string()), ("score", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [blocks_of(page) for page in part.column(2).to_pylist()]
                scores = labeller.scores(found, vectors)
                rows = [
                    [{"text": b.text, "path": " ".join(b.path), "score": float(s)} for b, s in zip(blocks, values, strict=True)]
                    for blocks, values in zip(found, scores, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, fields)], names=["page_id", "url", "blocks"])

    schema = f"page_id {kind}, url string, blocks array<struct<text:string,path:string,score:double>>"
    return pages.select("page_id", "url", "html").mapInArrow(each, schema)


def extract_text(pages: DataFrame, labeller: Labeller, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text (main blocks with an empty line between them), n_chars and n_blocks."""
    main = F.transform(F.filter("blocks", lambda b: b["score"] >= threshold), lambda b: b["text"])
    rows = label_blocks(pages, labeller).select("page_id", "url", F.array_join(main, "\n\n").alias("text"), F.size("blocks").alias("n_blocks"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks")
