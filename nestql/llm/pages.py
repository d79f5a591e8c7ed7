"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks in page order. Each has a tag-path vector (its open
elements with their classes and ids, hashed), a hashed-word vector, and a few
measures of shape. A bidirectional LSTM in numpy reads the sequence, so that every
block is classified with the whole page as context; the main blocks are kept.

The model is trained here, on pages that a seeded generator lays out and labels
(``TRAIN_PAGES``, a fixed number), in a few seconds on the driver; its size is
fixed, so it can be broadcast.

Defined results
---------------
* null or empty html, or no main block: an empty text of 0 code points;
* character references are decoded; white space in a block becomes one space;
  ``br`` is white space; blocks are joined by two line feeds;
* scripts, styles, comments and form controls are never text;
* repeated rows: answered row by row; null ids and urls: kept;
* empty table: no rows; extra columns: ignored;
* very long pages: one pass over the text, blocks of a page in one sequence.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestql.llm.common import beside

PATH_DIM = 512
WORD_DIM = 128
SHAPE_DIM = 8
HIDDEN = 20
TRAIN_PAGES = 480
EPOCHS = 10
BATCH = 24
SEED = 7

# Element names, as HTML defines them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead"
    " title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object select svg math button canvas audio video xmp".split())
# An element that ends when one of the others begins beside it.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
LIMITS = frozenset("ul ol dl table".split())

TAG = re.compile(r"<!--(?:>|.*?(?:-->|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?/][^>]*>", re.S)
LOOSE = re.compile(r"(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        if text:
            words = "".join(text).split()
            if words:
                out.append(Block(tuple(s for _, s in stack), " ".join(words), linked))
            text.clear()
        linked = 0

    def close(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                if any(n in BLOCKS for n, _ in stack[i:]):
                    end()
                del stack[i:]
                return

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            part = page[at:lt]
            if "&" in part:
                part = unescape(part)
            text.append(part)
            if any(name == "a" for name, _ in stack):
                linked += len(part)
        if lt == n:
            break
        m = TAG.match(page, lt) or LOOSE.match(page, lt + 1)
        if m is None:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        name, rest = m[2].lower(), m[3] or ""
        if m[1]:
            if name == "p" and not any(x == "p" for x, _ in stack):
                end()
            close(name)
            continue
        if name in RAW and not rest.endswith("/"):
            if name in BLOCKS:
                end()
            stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if stop is None:
                at = n if name in ("script", "style", "title", "textarea") else at
            else:
                gt = page.find(">", stop.start())
                at = n if gt < 0 else gt + 1
            text.append(" ")
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS:
            end()
            if any(x == "p" for x, _ in stack):
                close("p")
            for i in range(len(stack) - 1, -1, -1):
                if name in ENDED_BY.get(stack[i][0], ()):
                    del stack[i:]
                    break
                if stack[i][0] in LIMITS:
                    break
        if name not in VOID:
            label = name
            for a in NAMES.finditer(rest):
                label += f" {a[1].lower()}={(a[2] or a[3] or a[4] or '').lower()}"
            stack.append((name, label))
    end()
    return out


def _h(s: str, size: int) -> int:
    return zlib.crc32(s.encode()) % size


@lru_cache(maxsize=65536)
def path_features(path: tuple[str, ...]) -> tuple[int, ...]:
    """Hashed elements of a path: tags, their names, and the last two tags together."""
    out = set()
    tags = [p.split(" ", 1)[0] for p in path]
    for tag, label in zip(tags, path, strict=True):
        out.add(_h(f"t:{tag}", PATH_DIM))
        for part in PARTS.findall(label[len(tag) :]):
            if part not in ("class", "id", "role"):
                out.add(_h(f"n:{part}", PATH_DIM))
    out.add(_h("l:" + ">".join(tags[-2:]), PATH_DIM))
    out.add(_h("d:" + tags[-1] if tags else "d:", PATH_DIM))
    return tuple(sorted(out))


def features(blocks: list[Block]) -> np.ndarray:
    """Vectors of all blocks of a page."""
    x = np.zeros((len(blocks), PATH_DIM + WORD_DIM + SHAPE_DIM), np.float32)
    for i, b in enumerate(blocks):
        x[i, list(path_features(b.path))] = 1.0
    x[:, PATH_DIM:] = content_features(blocks)
    return x


def content_features(blocks: list[Block]) -> np.ndarray:
    """The hashed words and the shape of all blocks of a page."""
    x = np.zeros((len(blocks), WORD_DIM + SHAPE_DIM), np.float32)
    for i, b in enumerate(blocks):
        words = b.text.encode("utf-8", "surrogatepass").lower().split(b" ")
        h = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORD_DIM
        x[i, :WORD_DIM] = np.bincount(h, minlength=WORD_DIM) / len(words) ** 0.5 * 0.3
        n = len(b.text)
        marks = sum(b.text.count(c) for c in ".,;:!?")
        x[i, -SHAPE_DIM:] = (
            1.0, min(1.0, np.log1p(len(words)) / 5), min(1.0, b.linked / n), min(1.0, 8 * marks / n),
            float(b.text[-1] in ".!?"), i / len(blocks), float(i == 0), float(len(words) < 4),
        )
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Lstm:
    """A bidirectional LSTM over batches of sequences, with a logistic output."""

    def __init__(self, inputs: int, hidden: int, seed: int):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.p = {}
        for d in "fb":
            self.p[f"wx{d}"] = (r.standard_normal((inputs, 4 * hidden)) * 0.08).astype(np.float32)
            self.p[f"wh{d}"] = (r.standard_normal((hidden, 4 * hidden)) * 0.1).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1.0
            self.p[f"b{d}"] = bias
        self.p["wo"] = (r.standard_normal((2 * hidden, 1)) * 0.1).astype(np.float32)
        self.p["bo"] = np.zeros(1, np.float32)

    def _run(self, z: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States for each step. Padding leaves the state as it is."""
        n, steps, k = z.shape[0], z.shape[1], self.hidden
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, tape = np.zeros((n, steps, k), np.float32), []
        wh = self.p[f"wh{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[:, t] + h @ wh
            i, f, o = sigmoid(g[:, :k]), sigmoid(g[:, k : 2 * k]), sigmoid(g[:, 2 * k : 3 * k])
            u, m = np.tanh(g[:, 3 * k :]), mask[:, t : t + 1]
            c1 = f * c + i * u
            th = np.tanh(c1)
            h1 = o * th
            if keep:
                tape.append((t, h, c, i, f, o, u, th, m))
            h, c = m * h1 + (1 - m) * h, m * c1 + (1 - m) * c
            out[:, t] = h
        return out, tape

    def label(self, cut: list[list[Block]]) -> np.ndarray:
        """Probabilities for pages of blocks. A path's share of the input is added up once."""
        wide = 8 * self.hidden
        weights = np.concatenate([self.p["wxf"], self.p["wxb"]], axis=1)
        bias = np.r_[self.p["bf"], self.p["bb"]]
        z = np.zeros((len(cut), max(map(len, cut)), wide), np.float32)
        mask = np.zeros(z.shape[:2], np.float32)
        for i, blocks in enumerate(cut):
            for b in blocks:
                if b.path not in self.paths:
                    if len(self.paths) > 50_000:
                        self.paths.clear()
                    self.paths[b.path] = weights[list(path_features(b.path))].sum(axis=0) + bias
            z[i, : len(blocks)] = content_features(blocks) @ weights[PATH_DIM:] + np.stack([self.paths[b.path] for b in blocks])
            mask[i, : len(blocks)] = 1.0
        half = wide // 2
        both = np.concatenate([self._run(z[..., :half], mask, "f", False)[0], self._run(z[..., half:], mask, "b", False)[0]], axis=2)
        return sigmoid((both @ self.p["wo"])[..., 0] + self.p["bo"])

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        states, tapes = [], []
        for d in "fb":
            s, tape = self._run(x @ self.p[f"wx{d}"] + self.p[f"b{d}"], mask, d, keep)
            states.append(s)
            tapes.append(tape)
        both = np.concatenate(states, axis=2)
        return sigmoid((both @ self.p["wo"])[..., 0] + self.p["bo"]), both, tapes

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        prob, both, tapes = self.forward(x, mask, keep=True)
        count, k = mask.sum(), self.hidden
        loss = -(mask * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / count
        dlogit = (mask * (prob - y) / count)[..., None]
        g = {"wo": np.einsum("ntk,nto->ko", both, dlogit), "bo": dlogit.sum(axis=(0, 1))}
        dboth = dlogit @ self.p["wo"].T
        for j, d in enumerate("fb"):
            dz = np.zeros((*x.shape[:2], 4 * k), np.float32)
            dh, dc = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.float32)
            dwh = np.zeros_like(self.p[f"wh{d}"])
            for t, h0, c0, i, f, o, u, th, m in reversed(tapes[j]):
                dh = dh + dboth[:, t, j * k : (j + 1) * k]
                dh1, dc1 = m * dh, m * dc
                dc1 = dc1 + dh1 * o * (1 - th**2)
                step = np.concatenate([dc1 * u * i * (1 - i), dc1 * c0 * f * (1 - f), dh1 * th * o * (1 - o), dc1 * i * (1 - u**2)], axis=1)
                dz[:, t] = step
                dwh += h0.T @ step
                dh = (1 - m) * dh + step @ self.p[f"wh{d}"].T
                dc = (1 - m) * dc + dc1 * f
            g[f"wx{d}"] = x.reshape(-1, x.shape[2]).T @ dz.reshape(-1, 4 * k)
            g[f"wh{d}"], g[f"b{d}"] = dwh, dz.sum(axis=(0, 1))
        return float(loss), g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), steps), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1.0
    return x, mask


# Names that sites give to what is not the article, by what it is, and to the article.
AROUND = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav links toc pagination pager tabs",
    "header": "header masthead banner top branding logo site-header page-header",
    "aside": "sidebar aside side rail widget related recommended more-stories popular trending tags",
    "footer": "footer bottom copyright legal site-footer colophon credits",
    "notice": "notice cookie cookies consent gdpr alert warning disclaimer message popup modal paywall newsletter",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense",
    "form": "form search login signup subscribe contact feedback register poll",
    "comments": "comments comment reader-comments discussion replies reply respond disqus thread",
    "share": "share social sharing follow buttons author-box meta byline",
}
MAIN = "content main article post entry story body text article-body post-content entry-content main-content story-body page-content"
TAGS = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "aside": ("aside", "div", "section"), "footer": ("footer", "div"), "notice": ("div", "section", "p"), "ad": ("div", "aside", "section"), "form": ("form", "div"), "comments": ("section", "div", "ol"), "share": ("div", "p")}


def made_page(r: random.Random) -> str:
    """A page of invented words. Blocks of the article carry the mark ``\\x02``."""
    syllables = ["".join(r.choice("bcdfghlmnprstvaeiou") for _ in range(r.randint(2, 3))) for _ in range(40)]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def prose(lo: int = 4, hi: int = 60) -> str:
        words = [word() for _ in range(r.randint(lo, hi) if r.random() < 0.8 else r.randint(1, 5))]
        for i in range(0, len(words), r.randint(4, 12)):
            words[i] = words[i].capitalize()
            words[i - 1] += "."
        return " ".join(words) + r.choice([".", ".", ".", "", "!", "?"])

    def name(kind: str) -> str:
        tag = r.choice(TAGS[kind])
        if tag in ("div", "section", "p", "ul", "ol") or r.random() < 0.3:
            return f'{tag} {r.choice(["class", "class", "id"])}="{r.choice(AROUND[kind].split())}"'
        return tag

    def around(kind: str) -> str:
        opened = name(kind)
        tag = opened.split()[0]
        if kind == "nav" or (kind in ("footer", "header", "aside") and r.random() < 0.4):
            items = "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(r.randint(2, 9)))
            inner = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
        elif kind == "form":
            inner = f'<label>{prose(1, 4)}</label><input name="q"><button>{word()}</button>' + (f"<p>{prose(2, 12)}</p>" if r.random() < 0.5 else "")
        elif kind == "comments":
            one = r.choice(["div", "li", "article"])
            inner = f"<h3>{prose(1, 3)}</h3>" * r.randint(0, 1) + "".join(f'<{one} class="comment">' * 1 + f"<b>{word()}</b><p>{prose()}</p></{one}>" for _ in range(r.randint(1, 5)))
        elif tag == "p":
            inner = prose(3, 25)
        else:
            inner = "".join(r.choice([f"<p>{prose()}</p>", f"<h3>{prose(1, 5)}</h3><p>{prose()}</p>", prose(2, 30), f'<a href="#">{prose(1, 6)}</a>']) for _ in range(r.randint(1, 3)))
        if kind == "footer" and r.random() < 0.6:
            inner = f"&copy; {word()}.example.com &middot; {prose(2, 10)}" + inner * r.randint(0, 1)
        return f"<{opened}>{inner}</{tag}>"

    style = r.random()
    main = ["<article>", f'<div class="{r.choice(MAIN.split())}">', f'<div id="{r.choice(MAIN.split())}">', "<main>", f'<article class="{r.choice(MAIN.split())}">', f'<section class="{r.choice(MAIN.split())}">', "<div>"]
    opened = r.choices(main, [6, 4, 2, 3, 3, 2, 0.5])[0]
    parts = [f"<h1>\x02{prose(2, 9)}</h1>" if r.random() < 0.85 else ""]
    for _ in range(r.randint(1, 22)):
        kind = r.random()
        if kind < 0.72:
            parts.append(f"<p>\x02{prose()}" + ("</p>" if style < 0.8 else ""))
        elif kind < 0.8:
            parts.append(f"<h{(k := r.randint(2, 4))}>\x02{prose(1, 6)}</h{k}>")
        elif kind < 0.86:
            parts.append("<ul>" + "".join(f"<li>\x02{prose(1, 12)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
        elif kind < 0.9:
            parts.append(f"<p><b>\x02{prose(1, 9)}<br>")
        elif kind < 0.93:
            parts.append(f"<blockquote>\x02{prose()}</blockquote>")
        elif kind < 0.95:
            parts.append("<table><tr>" + "".join(f"<td>\x02{prose(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
        else:
            parts.append(around(r.choice(["ad", "share", "form", "notice", "aside"])))
    article = opened + "".join(parts) + f"</{opened[1:-1].split()[0]}>"
    kinds = list(AROUND)
    before = [around(k) for k in r.sample(["nav", "header", "notice", "ad", "form", "aside"], r.randint(0, 4))]
    after = [around(k) for k in r.sample(kinds, r.randint(0, 5))] + ([around("footer")] if r.random() < 0.7 else [])
    middle = "".join(before) + article + "".join(after)
    for _ in range(r.randint(0, 2)):
        middle = f'<div class="{r.choice(["wrap", "container", "page", "row", "col", "site", word()])}">{middle}</div>'
    return f"<!DOCTYPE html><html><head><title>{word()}</title><script>x()</script></head><body>{middle}</body></html>"


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    blocks = blocks_of(page)
    y = np.array([float("\x02" in b.text) for b in blocks], np.float32)
    return [Block(b.path, b.text.replace("\x02", ""), b.linked) for b in blocks], y


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Lstm:
    r = random.Random(seed)
    data = [(features(b), y) for b, y in (labelled(made_page(r)) for _ in range(pages)) if len(b)]
    model = Lstm(PATH_DIM + WORD_DIM + SHAPE_DIM, HIDDEN, seed)
    first, second, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    for epoch in range(epochs):
        # Pages of like length together waste little padding.
        order = sorted(range(len(data)), key=lambda i: (len(data[i][1]) // 6, r.random()))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        r.shuffle(batches)
        for batch in batches:
            x, mask = padded([data[i][0] for i in batch])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(batch):
                y[j, : len(data[i][1])] = data[i][1]
            _, g = model.gradients(x, mask, y)
            step += 1
            rate = 0.015 * (1 - epoch / epochs) + 0.001
            for k, v in model.p.items():
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                v -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def main_texts(pages: list[str | None], model: Lstm) -> list[list[str]]:
    """The main blocks of each page."""
    cut = [blocks_of(p) for p in pages]
    out: list[list[str]] = [[] for _ in pages]
    order = sorted((i for i, b in enumerate(cut) if b), key=lambda i: len(cut[i]))
    for a in range(0, len(order), 32):
        batch = order[a : a + 32]
        prob = model.label([cut[i] for i in batch])
        for j, i in enumerate(batch):
            out[i] = [b.text for b, p in zip(cut[i], prob[j], strict=False) if p >= 0.5]
    return out


def extract_main(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``blocks`` (the main blocks in order) of each page."""
    held = pages.sparkSession.sparkContext.broadcast(trained())
    rows = pages.select(*keep, F.col(html_col).alias("_html"))

    def start():
        def make(html: list[str | None]) -> list[list]:
            blocks = main_texts(html, held.value)
            return [["\n\n".join(b) for b in blocks], blocks]

        return make

    return beside(rows, list(keep), ["_html"], "text string, blocks array<string>", start, 256)


def pages_digest(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extract_main(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
