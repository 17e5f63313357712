"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks (text between block-level tags). Each block is
read as the vector of its tag path (tags, classes, ids and roles, hashed), the
vector of its hashed words and a few lengths; a bidirectional LSTM over the
whole sequence labels every block as main text or not, so a block is judged by
what stands around it. The network is numpy throughout and is trained, from a
fixed seed, on pages that this module composes: many layouts of menus,
headers, sidebars, notices, adverts, forms, footers and reader comments around
articles of made-up words.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from munjang.llm import shared
from munjang.llm.kernels import U64, Words, slices, string_buffers

PATH_SLOTS, WORD_SLOTS, HIDDEN, PAGES, EPOCHS, SEED = 512, 64, 24, 1400, 12, 7
#: Elements that are passed over up to their end tag.
_RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style title noscript template textarea iframe svg".split()}
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ENDS = re.compile(r"[>\"']")
_NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LETTERS = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements whose text is never part of an article.
_DROPPED = frozenset("head select option button datalist object canvas audio video map".split())
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_SCOPES = {"ul", "ol", "table", "dl", "select", "body", "article", "section", "div"}


class Node:
    """An open element: its names, the hash slots of the words of it and all its ancestors, and whether its text is dropped."""

    __slots__ = ("parent", "tag", "token", "slots", "dropped", "stop")

    def __init__(self, parent: Node | None, tag: str, token: str, stop: int):
        self.parent, self.tag, self.token, self.stop = parent, tag, token, stop
        self.slots = under(parent.slots, token) if parent else frozenset()
        self.dropped = parent is not None and (parent.dropped or tag in _DROPPED)


class Block:
    """A leaf block: its element, its text, and how many characters of that are linked."""

    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked

    @property
    def path(self) -> tuple[str, ...]:
        """All ancestors, innermost last."""
        out, node = [], self.node
        while node.parent:
            out.append(node.token)
            node = node.parent
        return tuple(reversed(out))

    @property
    def slots(self) -> frozenset[int]:
        """Slots of the path: its words anywhere, and those of the innermost element once more by themselves."""
        return self.node.slots | own_slots(self.node.token)[1]


def _tokens(tag: str, rest: str) -> str:
    names = ""
    if rest and "=" in rest:
        names = " ".join(next(filter(None, m), "") for m in _NAMED.findall(rest)).lower()
    return f"{tag} {names}" if names else tag


def _slot(word: str) -> int:
    out = 17
    for c in word.encode():
        out = (out * 257 + c) % 2_147_483_647
    return out % PATH_SLOTS


@lru_cache(maxsize=20_000)
def own_slots(token: str) -> tuple[frozenset[int], frozenset[int]]:
    """Slots of an element's words, and of the same words as those of an innermost element."""
    words = _LETTERS.findall(token)
    return frozenset(map(_slot, words)), frozenset(_slot(f"^{x}") for x in words)


@lru_cache(maxsize=5_000)
def under(slots: frozenset[int], token: str) -> frozenset[int]:
    more = own_slots(token)[0]
    return slots if more <= slots else slots | more


def pieces(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag in lower case, whether it is an end tag, its attributes); comments and raw elements are passed over and have the tag "".

    Every character is looked at a bounded number of times. A quoted ``>`` ends
    no tag; from the first tag on whose quotes do not close before the page
    ends, quotes mean nothing. Where no ``>`` follows, the rest is text.
    """
    at, look, quotes = 0, 0, True
    last = page.rfind(">")
    while (i := page.find("<", look)) >= 0:
        if i > last:
            break
        look = i + 1
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = len(page) if end < 0 else end + 3
            yield page[at:i], "", False, ""
        elif page[i + 1] in "!?":
            end = page.find(">", i) + 1
            yield page[at:i], "", False, ""
        elif name := _NAME.match(page, i + 1):
            tag, closing = name[1].lower(), page[i + 1] == "/"
            end = j = name.end()
            while quotes:
                found = _ENDS.search(page, j)
                if found and found[0] == ">":
                    end = found.start()
                    break
                j = page.find(found[0], found.end()) + 1 if found else 0
                quotes = j > 0
            if not quotes:
                end = page.find(">", name.end())
            rest, end = page[name.end() : end], end + 1
            if tag in _RAW and not closing:
                if not (tag == "svg" and rest.endswith("/")):
                    close = _RAW[tag].search(page, end)
                    end = close.end() if close else len(page)
                yield page[at:i], "", False, ""
            else:
                yield page[at:i], tag, closing, rest
        else:
            continue
        at = look = end
    yield page[at:], "", False, ""


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, their text decoded and white space as single spaces. The work is linear in the page."""
    out: list[Block] = []
    stack = [Node(None, "", "", 0)]
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if held:
            if not stack[-1].dropped:
                text = " ".join(html.unescape("".join(held)).split())
                if text:
                    out.append(Block(stack[-1], text, min(linked, len(text))))
            held.clear()
        linked = 0

    def close(n: int) -> None:
        for node in stack[n:]:
            opened[node.tag] -= 1
        del stack[n:]

    for text, tag, ending, rest in pieces(page):
        if text:
            held.append(text)
            if in_link:
                linked += len(text)
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = not ending
            continue
        if tag in _VOID:
            if tag in ("br", "wbr"):
                held.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        in_link = 0
        if ending:
            if opened[tag]:
                n = len(stack) - 1
                while stack[n].tag != tag:
                    n -= 1
                close(n)
            continue
        if stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag == "body":
            whole = [x for x in stack[1:] if x.tag == "html"]
            close(1)
            for x in whole:
                stack.append(Node(stack[-1], x.tag, x.token, 0))
                opened[x.tag] += 1
        elif tag in _CLOSES:
            n = stack[-1].stop
            while n > 0 and stack[n].tag not in _SCOPES:
                if stack[n].tag in _CLOSES[tag]:
                    close(n)
                    break
                n = stack[n - 1].stop
        stop = len(stack) if tag in _CLOSES or tag in _SCOPES else stack[-1].stop
        stack.append(Node(stack[-1], tag, _tokens(tag, rest), stop))
        opened[tag] += 1
    flush()
    return out


def features(page_blocks: list[list[Block]]) -> tuple[np.ndarray, np.ndarray]:
    """(paths, values) of the blocks of some pages, one after another: path slots as 0/1, word slots and lengths."""
    flat = [b for page in page_blocks for b in page]
    paths = np.zeros((len(flat), PATH_SLOTS), np.float32)
    for i, b in enumerate(flat):
        paths[i, list(b.slots)] = 1
    return paths, features_of_text(page_blocks)


def features_of_text(page_blocks: list[list[Block]]) -> np.ndarray:
    flat = [b for page in page_blocks for b in page]
    if not flat:
        return np.zeros((0, WORD_SLOTS + 6), np.float32)
    values = np.zeros((len(flat), WORD_SLOTS + 6), np.float32)
    data, offsets = string_buffers(pa.array([b.text for b in flat], pa.large_string()))
    for lo, hi in slices(offsets):
        words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        slot = (words.hashes(True) >> U64(40)).astype(np.int64) % WORD_SLOTS
        doc = np.repeat(np.arange(hi - lo), words.counts)
        count = np.bincount(doc * WORD_SLOTS + slot, minlength=(hi - lo) * WORD_SLOTS).reshape(hi - lo, WORD_SLOTS)
        values[lo:hi, :WORD_SLOTS] = count / np.maximum(np.sqrt((count**2).sum(1, keepdims=True)), 1)
        values[lo:hi, WORD_SLOTS] = np.log1p(words.counts) / 4
    size = np.array([len(b.text) for b in flat], np.float32)
    values[:, WORD_SLOTS + 1] = np.log1p(size) / 6
    values[:, WORD_SLOTS + 2] = np.array([b.linked for b in flat], np.float32) / np.maximum(size, 1)
    values[:, WORD_SLOTS + 3] = [b.text[-1] in ".!?。" for b in flat]
    lengths = [len(p) for p in page_blocks]
    values[:, WORD_SLOTS + 4] = np.concatenate([np.arange(n) / max(1, n - 1) for n in lengths])
    values[:, WORD_SLOTS + 5] = 1
    return values


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        size = PATH_SLOTS + WORD_SLOTS + 6
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p["x" + d] = (r.normal(0, 0.15, (size, 4 * h))).astype(np.float32)
            self.p["h" + d] = (r.normal(0, 1 / np.sqrt(h), (h, 4 * h))).astype(np.float32)
            self.p["c" + d] = np.repeat(np.array([0, 1, 0, 0], np.float32), h)
        self.p["o"] = (r.normal(0, 0.2, 2 * h)).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)

    @staticmethod
    def _step(z: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        h = HIDDEN
        i, f, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h])
        g = np.tanh(z[:, 3 * h :])
        c = f * c + i * g
        t = np.tanh(c)
        return i, f, o, g, c, t, o * t

    def forward(self, gates: dict[str, np.ndarray], mask: np.ndarray, keep: bool) -> tuple[np.ndarray, dict]:
        """gates: (steps, pages, 4h) for both directions; mask: (steps, pages). Returns logits (steps, pages)."""
        steps, n = mask.shape
        hidden, trace = {}, {}
        for d in "fb":
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            out, kept = np.zeros((steps, n, HIDDEN), np.float32), {}
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                i, f, o, g, c2, tc, h2 = self._step(gates[d][t] + h @ self.p["h" + d] + self.p["c" + d], c)
                m = mask[t][:, None]
                if keep:
                    kept[t] = (i, f, o, g, c, tc, h)
                h, c = np.where(m, h2, 0), np.where(m, c2, 0)
                out[t] = h
            hidden[d], trace[d] = out, kept
        z = hidden["f"] @ self.p["o"][:HIDDEN] + hidden["b"] @ self.p["o"][HIDDEN:] + self.p["ob"]
        return z, {"hidden": hidden, "trace": trace}

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """x: (steps, pages, inputs). Gradient of the mean cross entropy."""
        z, kept = self.forward({d: x @ self.p["x" + d] for d in "fb"}, mask, True)
        dz = np.where(mask, _sigmoid(z) - y, 0).astype(np.float32) / max(1, int(mask.sum()))
        grads = {"o": np.concatenate([(kept["hidden"][d] * dz[..., None]).sum((0, 1)) for d in "fb"]), "ob": np.array([dz.sum()])}
        steps, n = mask.shape
        for k, d in enumerate("fb"):
            own = self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            dgates = np.zeros((steps, n, 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.p["h" + d])
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                i, f, o, g, c, tc, h = kept["trace"][d][t]
                m = mask[t][:, None]
                dh = np.where(m, dh + dz[t][:, None] * own, 0)
                dct = np.where(m, dc, 0) + dh * o * (1 - tc * tc)
                dg = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dh * tc * o * (1 - o), dct * i * (1 - g * g)], 1)
                dgates[t] = dg
                gh += h.T @ dg
                dh, dc = dg @ self.p["h" + d].T, dct * f
            grads["x" + d] = np.tensordot(x, dgates, ([0, 1], [0, 1]))
            grads["h" + d], grads["c" + d] = gh, dgates.sum((0, 1))
        return grads

    def train(self, pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
        r = random.Random(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        t, seen, mean = 0, 0, {k: np.zeros_like(v) for k, v in self.p.items()}
        ready = [np.concatenate(features([p[0]]), 1) for p in pages]
        for epoch in range(epochs):
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i][0]) // 8, r.random()))
            batches = [order[i : i + 16] for i in range(0, len(order), 16)]
            r.shuffle(batches)
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for batch in batches:
                lengths = [len(pages[i][0]) for i in batch]
                # Some path words are hidden at times, so no one clue is relied on.
                hidden = np.random.default_rng(seed + t).random(PATH_SLOTS) < 0.08
                x = np.zeros((max(lengths), len(batch), PATH_SLOTS + WORD_SLOTS + 6), np.float32)
                y, mask = np.zeros(x.shape[:2], np.float32), np.zeros(x.shape[:2], bool)
                for k, n in enumerate(lengths):
                    x[:n, k], y[:n, k], mask[:n, k] = ready[batch[k]], pages[batch[k]][1], True
                x[:, :, :PATH_SLOTS][:, :, hidden] = 0
                t += 1
                for k, g in self.gradients(x, mask, y).items():
                    m = 0.9 * moments[k][0] + 0.1 * g
                    v = 0.99 * moments[k][1] + 0.01 * g * g
                    moments[k] = (m, v)
                    self.p[k] = (self.p[k] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
                if epoch >= epochs - 4:  # the mean of the last epochs' weights is steadier than any of them
                    seen += 1
                    mean = {k: mean[k] + (self.p[k] - mean[k]) / seen for k in mean}
        self.p = mean if seen else self.p
        return self

    def label(self, page_blocks: list[list[Block]]) -> list[np.ndarray]:
        """P(main text) of each block of each page. Pages of similar length go together; a long page is padded by no one."""
        out: list[np.ndarray] = [np.zeros(0)] * len(page_blocks)
        order = sorted((i for i, p in enumerate(page_blocks) if p), key=lambda i: len(page_blocks[i]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and b - a < 256 and (b - a + 1) * len(page_blocks[order[b]]) <= 16_384:
                b += 1
            group = [page_blocks[i] for i in order[a:b]]
            distinct: dict[frozenset[int], int] = {}
            which = np.array([distinct.setdefault(x.slots, len(distinct)) for page in group for x in page])
            values = features_of_text(group)
            lengths = np.array([len(p) for p in group])
            mask = np.arange(lengths.max())[:, None] < lengths
            gates = {}
            for d in "fb":
                of_path = np.stack([self.p["x" + d][sorted(x)].sum(0) for x in distinct])
                flat = of_path[which] + values @ self.p["x" + d][PATH_SLOTS:]
                z = np.zeros((len(lengths), lengths.max(), 4 * HIDDEN), np.float32)
                z[mask.T] = flat
                gates[d] = z.transpose(1, 0, 2)
            p = _sigmoid(self.forward(gates, mask, False)[0])
            for k, i in enumerate(order[a:b]):
                out[i] = p[: lengths[k], k]
            a = b
        return out


# Pages to train on. Each element below is (path pieces, what it holds): lists of names that sites give such parts.
_MENU = ["nav", 'ul class="menu"', 'div class="navbar"', 'div id="navigation"', 'div class="breadcrumbs"', 'ul class="nav links"', 'div class="topbar menu"', 'div role="navigation"', 'div class="pagination"', 'div class="tags"', 'div class="toc"']
_HEAD = ["header", 'div class="header"', 'div id="masthead"', 'div class="site-header banner"', 'div class="logo brand"', 'div role="banner"']
_FOOT = ["footer", 'div class="footer"', 'div id="site-footer"', 'div class="copyright legal"', 'div class="colophon"', 'div role="contentinfo"']
_SIDE = ["aside", "aside", "aside", 'div class="sidebar"', 'div id="secondary"', 'div class="widget related"', 'section class="related-posts"', 'div class="recommended popular"', 'div class="trending more"', 'div role="complementary"', 'div class="author-bio"', 'div class="share social"', 'div class="rail"']
_NOTE = ['div class="cookie-notice"', 'div class="consent banner"', 'div class="alert notice"', 'div id="gdpr"', 'div class="newsletter subscribe signup"', 'div class="popup modal overlay"', 'div class="paywall"', 'div class="notification message"', 'div class="disclaimer"', 'div class="notice"', 'div class="cookies"']
_AD = ['div class="ad"', 'div class="ads advert"', 'div id="advertisement"', 'div class="sponsored promo"', 'div class="ad-slot banner"', 'aside class="promotion"', 'ins class="adsbygoogle"', 'div class="sponsor"']
_FORM = ["form", 'form class="search"', 'form id="login"', 'div class="search-form"', 'form class="contact"']
_TALK = ['section id="comments"', 'div class="comments"', 'div id="disqus_thread"', 'ol class="comment-list"', 'section class="reader-comments discussion"', 'div class="replies responses"', 'section class="comments"', 'div class="reader-comments"', 'div class="feedback"']
_BODY = ["article", "main", 'div class="content"', 'div class="post"', 'div class="entry-content"', 'div id="article-body"', 'div class="story text"', 'section class="article"', 'div role="main"', 'div itemprop="articleBody"', 'div class="main"', 'div id="content"', 'div class="page"', "section", "div"]
_WRAP = ['div class="container"', 'div class="wrapper"', 'div id="page"', "div", 'div class="row layout"', "main", "section", 'div id="main"']
_SAID = {
    "menu": ["Home", "About", "News", "Contact", "Archive", "Products", "Blog", "Login", "More", "Next", "Previous"],
    "foot": ["Copyright 2024", "All rights reserved.", "Privacy policy", "Terms of use", "© 2024 &middot;", "&copy;", "Imprint", "Contact us"],
    "note": ["We use cookies to improve your experience.", "Accept all cookies", "Subscribe to our newsletter", "Please enable JavaScript.", "Sign up today", "This site uses cookies."],
    "ad": ["Advertisement", "Sponsored", "Buy now and save", "Limited offer", "Promoted"],
    "form": ["Search", "Your name", "Your email", "Send", "Password", "Submit"],
    "talk": ["Reply", "Leave a comment", "3 comments", "Posted by", "2 days ago", "Like"],
    "side": ["Related articles", "Most read", "Share this", "Follow us", "You may also like", "Tags"],
}


def compose(seed: int) -> tuple[list[Block], list[int]]:
    """A page of a random layout, cut into blocks, and which of these are main text. Text of the article carries a mark that is taken off again."""
    r = random.Random(seed)
    deep = random.Random(-1 - seed)  # a stream of its own: now and then plain elements lie between a telling one and its blocks
    syllables = [a + b for a in "b d f g k l m n p r s t v th sh ç ñ ß".split() for b in "a e i o u é ü ai on er en".split()]
    common = ["".join(r.choices(syllables, k=r.randint(1, 2))) for _ in range(30)]
    word = lambda: r.choice(common) if r.random() < 0.5 else "".join(r.choices(syllables, k=r.randint(1, 4)))

    def sentence(n: int) -> str:
        s = " ".join(word() + ("," if r.random() < 0.1 else "") for _ in range(n))
        return s.capitalize() + r.choice([".", ".", ".", "!", "?"])

    noise = deep.choice([" | ", "!! ", "### ", " $$$ ", " / "]) if deep.random() < 0.2 else ""  # signs between all words of a page tell nothing

    def paragraph() -> str:
        kind = r.random()
        n = 1 if kind < 0.3 else r.randint(2, 8) if kind < 0.9 else r.randint(10, 40)
        text = " ".join(sentence(r.randint(1, 16)) for _ in range(n))
        if r.random() < 0.08:
            text = text.upper()
        if r.random() < 0.1:
            text = r.choice([" | ", "!! ", "### "]).join(text.split())
        if noise and deep.random() < 0.8:
            text = noise.join(text.split())
        if r.random() < 0.1:
            text = r.choice(["Licensed under", "Contact", "Copyright", "Call +1 (555) 010 2000"]) + " " + text
        if r.random() < 0.2:
            text = text.replace(" ", " <a href='/x'>", 1) + "</a>"
        return text

    def inside(kind: str) -> str:
        out = []
        for _ in range(r.randint(1, 5)):
            text = r.choice(_SAID[kind]) if r.random() < 0.5 else sentence(r.randint(1, 8)) if r.random() < 0.7 else word()
            if kind in ("talk", "side", "ad", "note", "foot") and r.random() < 0.4:
                text = paragraph()
            if kind in ("menu", "side") and r.random() < 0.8:
                text = f'<a href="/{word()}">{text}</a>'
            tag = r.choice({"menu": ["li", "li", "a-div"], "talk": ["p", 'div class="comment"', 'li class="comment"'], "form": ["label", "p", "div"]}.get(kind, ["p", "div", "li", "h3", ""]))
            tag = "div" if tag == "a-div" else tag
            out.append(f"<{tag}>{text}</{tag.split()[0]}>" if tag else text + (" " if r.random() < 0.5 else "<div></div>"))
        if kind == "form":
            out.append("<input type=text><select><option>1</option></select><button>Go</button>")
        return "".join(out)

    def part(kinds: list[str], kind: str) -> str:
        tag = r.choice(kinds)
        body = inside(kind)
        if tag == "nav" or tag.startswith("ul"):
            body = f"<ul>{body}</ul>" if tag == "nav" and r.random() < 0.7 else body
        end = f"</{tag.split()[0]}>" if r.random() < 0.97 else ""
        if end and deep.random() < 0.2:
            n = deep.randint(5, 25)
            body = "<div>" * n + body + "</div>" * n
        return f"<{tag}>{body}{end}"

    mark = "\x01"
    inner = []
    if r.random() < 0.8:
        inner.append(f"<h1>{mark}{sentence(r.randint(3, 10))}</h1>")
    for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14, 30])):
        kind = r.random()
        close = "</p>" if r.random() < 0.85 else ""
        if kind < 0.78:
            inner.append(f"<p>{'<b>' if r.random() < 0.2 else ''}{mark}{paragraph()}{'<br>' if r.random() < 0.2 else ''}{close}")
        elif kind < 0.85:
            inner.append(f"<h2>{mark}{sentence(r.randint(1, 6))}</h2>")
        elif kind < 0.92:
            inner.append("<ul>" + "".join(f"<li>{mark}{sentence(r.randint(1, 10))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind < 0.96:
            inner.append(f"<blockquote>{mark}{paragraph()}</blockquote>")
        else:
            inner.append("<table>" + "".join(f"<tr><td>{mark}{word()}</td><td>{mark}{word()}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
        if r.random() < 0.07:
            inner.append(part(*r.choice([(_AD, "ad"), (_SIDE, "side"), (_NOTE, "note")])))
    tag = r.choice(_BODY) if r.random() < 0.6 else "article"
    if r.random() < 0.15:
        inner.append(part(_TALK, "talk"))
    if deep.random() < 0.15:
        n = deep.randint(5, 25)
        inner = ["<div>" * n, *inner, "</div>" * n]
    article = f"<{tag}>{''.join(inner)}</{tag.split()[0]}>"
    before = [part(k, v) for k, v, p in ((_HEAD, "side", 0.4), (_MENU, "menu", 0.8), (_NOTE, "note", 0.35), (_AD, "ad", 0.5), (_SIDE, "side", 0.25), (_FORM, "form", 0.25)) if r.random() < p]
    after = [part(k, v) for k, v, p in ((_AD, "ad", 0.25), (_TALK, "talk", 0.45), (_SIDE, "side", 0.4), (_FORM, "form", 0.25), (_NOTE, "note", 0.25), (_MENU, "menu", 0.2), (_FOOT, "foot", 0.85)) if r.random() < p]
    if r.random() < 0.5:
        r.shuffle(before)
    page = "".join(before) + article + "".join(after)
    for _ in range(r.choice([0, 0, 1, 2])):
        wrap = r.choice(_WRAP)
        page = f"<{wrap}>{page}</{wrap.split()[0]}>"
    found = blocks(f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>")
    labels = [int(mark in b.text) for b in found]
    for b in found:
        b.text = b.text.replace(mark, "").strip() or "x"
    return found, labels


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, epochs: int = EPOCHS) -> Labeller:
    return Labeller().train([x for x in map(compose, range(pages)) if x[0]], epochs)


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    cut = [blocks(p or "") for p in pages]
    return ["\n\n".join(b.text for b, q in zip(page, p, strict=True) if q >= 0.5) for page, p in zip(cut, model.label(cut), strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (main blocks joined by an empty line), n_chars.

    Null and empty pages, and pages without main text, give an empty text.
    Null ids and urls stay null; repeated rows are alike; other columns are not
    read. Unclosed tags, comments and scripts end with the page.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                texts = main_texts(part.column("html").to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return shared.texts(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
