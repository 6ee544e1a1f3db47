"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks, each with its tag path, words and shape. A
bidirectional LSTM in numpy reads the whole sequence, so every block is judged with the
page around it. The model is trained here: on a bounded sample of the pages themselves,
labelled by their semantic containers, and on page layouts composed from the sample's sentences.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscout.llm.common import id_of, text_of

# HTML's element kinds.
RAW = ("script", "style", "template", "textarea", "title", "svg", "iframe", "select", "audio", "video")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
                   "math semantics annotation mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mtable mtr mtd".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: A list item, cell or term closes only within its own list or table.
SCOPES = frozenset("ul ol dl table body article section main aside nav header footer div form blockquote datalist".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/>])[^>]*/>|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME = re.compile(r"[a-z]+")

PATH, WORDS, SHAPE = 128, 32, 6
FEATURES = PATH + WORDS + SHAPE


@dataclass
class Block:
    path: list[str]
    text: str
    link_chars: int
    label: int | None = None


def blocks(page: str, labelled: bool = True) -> list[Block]:
    """Leaf blocks in page order: references decoded, white space runs one blank, trimmed; without scripts, styles and comments.

    ``labelled``: data-y is a label, as in composed pages; in given pages it says nothing.
    """
    stack: list[tuple[str, list[str], int | None]] = []
    parts: list[str] = []
    links: list[int] = [0, 0]  # open links, characters inside
    out: list[Block] = []

    def label() -> int | None:
        return next((y for _, _, y in reversed(stack) if y is not None), None)

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block([n for tag, names, _ in stack if tag not in INLINE for n in names], text, links[1], label()))
        parts.clear()
        links[1] = 0

    def pop_to(index: int) -> None:
        for tag, _, _ in stack[index:]:
            links[0] -= tag == "a"
        del stack[index:]

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if links[0] > 0:
                links[1] += len(piece)
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag not in INLINE
        if block:
            flush()
        if m["end"]:
            index = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            # An inline end tag does not close the block around it.
            if index is not None and (block or all(t in INLINE for t, _, _ in stack[index:])):
                pop_to(index)
            continue
        if block and "p" in (open_tags := [t for t, _, _ in stack]):
            index = len(open_tags) - 1 - open_tags[::-1].index("p")
            if not SCOPES.intersection(open_tags[index + 1 :]):
                pop_to(index)
        for closed in CLOSES.get(tag, ()):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == closed:
                    pop_to(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        if tag in VOID or m["attrs"].rstrip().endswith("/"):
            continue
        names, y = [tag], None
        if "=" in m["attrs"]:
            for key, *values in ATTRIBUTE.findall(m["attrs"]):
                value = next((v for v in values if v), "").lower()
                if key.lower() == "data-y":
                    y = int(value) if labelled else None
                else:
                    names.extend(NAME.findall(value))
        links[0] += tag == "a"
        stack.append((tag, names, y))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def features(sequence: list[Block]) -> np.ndarray:
    """A row a block: hashed names of its path, hashed words, shape and place."""
    x = np.zeros((len(sequence), FEATURES), np.float32)
    n = len(sequence)
    for i, b in enumerate(sequence):
        for name in b.path:
            x[i, zlib.crc32(name.encode()) % PATH] = 1
        words = b.text.lower().split()
        hashed = np.bincount([zlib.crc32(w.encode()) % WORDS for w in words], minlength=WORDS)
        x[i, PATH : PATH + WORDS] = hashed / np.sqrt((hashed**2).sum())
        size = len(b.text)
        x[i, PATH + WORDS :] = (np.log1p(size) / 8, min(1.0, b.link_chars / size), sum(b.text.count(c) for c in ".,;!?") / size * 10,
                                bool(b.path) and b.path[-1] in HEADINGS, i / n, 1.0)
    return x


def _gates(z: np.ndarray, h: int) -> tuple[np.ndarray, ...]:
    s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
    return s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(z[:, 3 * h :])


@dataclass
class Labeller:
    """One LSTM in each direction and a logistic output over both states."""

    hidden: int = 16
    seed: int = 9
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.w:
            rng = np.random.default_rng(self.seed)
            h = self.hidden
            for d in ("f", "b"):
                self.w[f"x{d}"] = (rng.standard_normal((FEATURES, 4 * h)) / np.sqrt(12)).astype(np.float32)
                self.w[f"h{d}"] = (rng.standard_normal((h, 4 * h)) / np.sqrt(h) / 2).astype(np.float32)
            self.w["o"] = (rng.standard_normal((2 * h, 1)) / np.sqrt(h)).astype(np.float32)
            self.w["c"] = np.zeros((1, 1), np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (page, step, hidden) of one direction; ``x`` (page, step, features), 0 beyond a page's end."""
        n, steps, _ = x.shape
        h = self.hidden
        z = (x.reshape(n * steps, -1) @ self.w[f"x{d}"]).reshape(n, steps, 4 * h)
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out = np.zeros((n, steps, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            i, f, o, g = _gates(z[:, t] + state @ self.w[f"h{d}"], h)
            live = mask[:, t, None]
            new = (f * cell + i * g) * live + cell * (1 - live)
            if keep is not None:
                keep.append((t, i, f, o, g, cell, new, state, live))
            cell = new
            state = o * np.tanh(cell) * live + state * (1 - live)
            out[:, t] = state
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._pass(x, mask, "f"), self._pass(x, mask, "b")], 2)
        return (both @ self.w["o"])[:, :, 0] + self.w["c"][0, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, (n, steps, _) = self.hidden, x.shape
        kept = {"f": [], "b": []}
        both = np.concatenate([self._pass(x, mask, d, kept[d]) for d in "fb"], 2)
        p = 1 / (1 + np.exp(-np.clip((both @ self.w["o"])[:, :, 0] + self.w["c"][0, 0], -30, 30)))
        e = ((p - y) * mask / mask.sum())[:, :, None]
        grads = {"o": (both * e).sum((0, 1))[:, None], "c": e.sum().reshape(1, 1)}
        for j, d in enumerate("fb"):
            to_state = e * self.w["o"][j * h : (j + 1) * h, 0]
            dz_all = np.zeros((n, steps, 4 * h), np.float32)
            dh_w, dstate, dcell = np.zeros_like(self.w[f"h{d}"]), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, i, f, o, g, before, cell, state, live in reversed(kept[d]):
                dstate = dstate + to_state[:, t]
                tanh = np.tanh(cell)
                dc = dstate * live * o * (1 - tanh**2) + dcell
                gate = dc * live
                dz = np.concatenate([gate * g * i * (1 - i), gate * before * f * (1 - f), dstate * live * tanh * o * (1 - o), gate * i * (1 - g**2)], 1)
                dz_all[:, t] = dz
                dh_w += state.T @ dz
                dcell = gate * f + dc * (1 - live)
                dstate = dz @ self.w[f"h{d}"].T + dstate * (1 - live)
            grads[f"h{d}"] = dh_w
            grads[f"x{d}"] = x.reshape(n * steps, -1).T @ dz_all.reshape(n * steps, -1)
        return grads

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 14, size: int = 32, rate: float = 0.02) -> Labeller:
        """Adam over batches of pages of like length, in an order that the seed fixes."""
        rng = np.random.default_rng(self.seed)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        batches = [padded([pages[i] for i in order[a : a + size]]) for a in range(0, len(order), size)]
        mean, square, step = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        for epoch in range(epochs):
            for b in rng.permutation(len(batches)):
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, g in self.gradients(*batches[b]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x, _ in pages)
    x, mask, y = np.zeros((len(pages), steps, FEATURES), np.float32), np.zeros((len(pages), steps), np.float32), np.zeros((len(pages), steps), np.float32)
    for i, (own, label) in enumerate(pages):
        x[i, : len(own)], mask[i, : len(own)], y[i, : len(own)] = own, 1, label
    return x, mask, y


# Names that layouts use for each part of a page, and phrases of page furniture.
MAIN = ('<article{y}>', '<main{y}>', '<div class="content"{y}>', '<div class="post-content entry"{y}>', '<section id="content"{y}>', '<div class="article-body"{y}>',
        '<div id="main-text"{y}>', '<div role="main"{y}>', '<div class="story"{y}>', '<article class="post"{y}>', '<div{y}>')
FURNITURE = {
    "menu": ('<nav>', '<div class="menu">', '<ul id="navigation">', '<div class="navbar">', '<div id="breadcrumbs">', '<header>', '<div role="navigation">'),
    "side": ('<aside>', '<div class="sidebar">', '<div id="related">', '<div class="widget">', '<section class="related-posts">', '<div class="recommended">'),
    "ad": ('<div class="ad">', '<div class="ads banner">', '<div id="sponsor">', '<div class="promo">', '<aside class="advert">', '<div class="advertisement">'),
    "notice": ('<div class="notice">', '<div class="cookie-banner">', '<div id="cookies">', '<div class="alert">', '<div class="consent" role="dialog">', '<div class="newsletter">'),
    "form": ('<form>', '<form class="search">', '<div class="subscribe">', '<form id="login">', '<form class="comment-form">'),
    "comments": ('<section class="comments">', '<div id="comments">', '<ol class="commentlist">', '<div class="comment">', '<div class="discussion replies">'),
    "foot": ('<footer>', '<div class="footer">', '<div id="copyright">', '<div class="site-footer">'),
}
PHRASES = ("Home", "About us", "Contact", "Subscribe to our newsletter", "We use cookies to improve your visit.", "Accept all", "All rights reserved.", "Privacy policy", "Terms of use",
           "Log in", "Sign up", "Share this", "Related articles", "Read more", "Advertisement", "Sponsored", "Leave a comment", "Reply", "Search", "Menu", "© 2024")


def layout(rng: random.Random, sentences: list[str]) -> str:
    """A page of parts in a likely order, its main container marked data-y=1; tags are sometimes left open."""
    said = lambda lo=1, hi=6: " ".join(rng.choice(sentences) for _ in range(rng.randint(lo, hi)))
    esc = lambda t: entities.escape(t, quote=False)

    def close(tag: str) -> str:
        return f"</{re.match(r'<([a-z0-9]+)', tag)[1]}>"

    def part(kind: str) -> str:
        tag = rng.choice(FURNITURE[kind])
        words = lambda: rng.choice(PHRASES) if rng.random() < 0.4 else " ".join(rng.choice(sentences).split()[: rng.randint(1, 4)])
        if kind == "menu" or kind == "side" and rng.random() < 0.6:
            body = "<ul>" + "".join(f'<li><a href="#">{esc(words())}</a></li>' for _ in range(rng.randint(2, 9))) + "</ul>"
        elif kind == "form":
            body = f"<label>{esc(words())}</label><input name=q><button>{esc(words())}</button>"
        elif kind == "comments":
            body = "".join(f'<{t} class="comment"><p>{esc(said(1, 4))}</p></{t}>' for t in rng.choices(["div", "li"], k=rng.randint(1, 5)))
            body = f"<h3>{esc(rng.choice(PHRASES))}</h3>" + body
        else:
            body = esc(rng.choice([words(), said(1, 3)]))
            if rng.random() < 0.4:
                body = f"<p>{body}</p>"
        return tag + body + close(tag)

    def main() -> str:
        tag = rng.choice(MAIN)
        shut = rng.random() < 0.75
        title = said(1, 1)
        body = [f"<h1>{esc(title)}</h1>"] if rng.random() < 0.85 else []
        if rng.random() < 0.3:
            body.append(f"<p><b>{esc(title)}<br>")
        for _ in range(rng.choice([1, 2, 4, 8, 14, 24])):
            r = rng.random()
            if r < 0.72:
                body.append(f"<p>{esc(said(1, 8))}" + "</p>" * shut)
            elif r < 0.78:
                body.append(f"<h2>{esc(said(1, 1))}</h2>")
            elif r < 0.84:
                body.append("<ul>" + "".join(f"<li>{esc(said(1, 1))}" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif r < 0.88:
                body.append(f"<blockquote><p>{esc(said(1, 3))}</p></blockquote>")
            elif r < 0.90:
                body.append(f"<table><tr><td>{esc(said(1, 1))}<td>{esc(said(1, 1))}</table>")
            else:
                kind = rng.choice(["ad", "side", "notice", "form"])
                body.append(part(kind).replace(">", ' data-y="0">', 1))
        end = part("comments").replace(">", ' data-y="0">', 1) if rng.random() < 0.2 else ""
        return tag.format(y=' data-y="1"') + "".join(body) + end + close(tag)

    before = [part(k) for k in ("menu", "notice", "ad", "side", "form") if rng.random() < 0.45]
    after = [part(k) for k in ("side", "ad", "comments", "form", "notice", "foot") if rng.random() < 0.45]
    rng.shuffle(before)
    inside = "".join(before) + main() + "".join(after)
    if rng.random() < 0.3:
        inside = f'<div class="wrapper">{inside}</div>'
    return f'<html><body data-y="0">{inside}</body></html>'


#: Pages that give sentences and weak labels, and composed pages, for training.
SAMPLE, COMPOSED = 200, 400


def train(pages: list[str], seed: int = 9, composed: int = COMPOSED) -> Labeller:
    """A labeller from sample pages (labelled by article and main elements where they have one) and composed layouts."""
    rng = random.Random(seed)
    data, sentences = [], []
    for page in pages:
        own = blocks(page, labelled=False)
        sentences.extend(s for b in own for s in re.split(r"(?<=[.!?])\s+", b.text) if s)
        inside = np.array([bool({"article", "main"} & set(b.path)) and not {"nav", "footer", "aside", "form"} & set(b.path) for b in own], np.float32)
        if inside.any():
            data.append((features(own), inside))
    sentences = sentences or list(PHRASES)
    for _ in range(composed):
        own = blocks(layout(rng, sentences))
        if own:
            data.append((features(own), np.array([b.label or 0 for b in own], np.float32)))
    return Labeller(seed=seed).train(data)


def extract(pages: list[str], model: Labeller, at_once: int = 128) -> list[str]:
    """The main text of each page: its main blocks in order, joined by an empty line."""
    parsed = [blocks(p, labelled=False) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if parsed[i]), key=lambda i: len(parsed[i]))
    for first in range(0, len(order), at_once):
        part = order[first : first + at_once]
        x, mask, _ = padded([(features(parsed[i]), np.zeros(len(parsed[i]), np.float32)) for i in part])
        for i, score in zip(part, model.scores(x, mask)):
            out[i] = "\n\n".join(b.text for b, s in zip(parsed[i], score.tolist()) if s > 0)
    return out


def fit(pages: DataFrame, html: str = "html", page: str = "page_id", sample: int = SAMPLE, seed: int = 9) -> Labeller:
    """A labeller trained on the ``sample`` different pages that come first by hash of id and html, so reruns agree.

    Only a share of the hashes, enough for about eight samples, is looked at, so what
    tasks send on does not grow with the table.
    """
    body = text_of(html)
    key = F.xxhash64(F.lit(seed), id_of(page), body)
    share = min(1.0, 8 * sample / max(pages.count(), 1))
    few = pages.select(key.alias("r"), body.alias("body")).where(F.pmod("r", F.lit(1 << 32)) < int(share * (1 << 32)))
    rows = few.distinct().orderBy("r", "body").limit(sample).collect()
    return train([r["body"] for r in rows], seed)


def main_text(pages: DataFrame, model: Labeller, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of their whole html in ``into``; empty where there is none.

    Null and empty html have empty text. Each page is read by itself, so repeated rows agree
    and order does not matter. A column called ``into`` is replaced. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = extract(part.column(1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], names=["row", "text"])

    packed = pages.drop(into).select(F.struct("*").alias("row"), text_of(html).alias("body"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, text string").select("row.*", F.col("text").alias(into))
