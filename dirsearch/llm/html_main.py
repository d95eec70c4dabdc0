"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks: runs of text between block-level tags, with the path of open elements.  A
block's input is the mean of learned vectors of its path (tags, classes, ids, roles; hashed), the mean of learned vectors
of its hashed words, and a few numbers (length, link share, place).  A bidirectional LSTM in numpy reads the sequence of
the page, so that each block is classified with the whole page as context.  Blocks classified as main text are joined.

The labeller is trained here, in one task, on at most ``SAMPLE`` pages of the table, chosen by hash.  Their labels come
from rules on element names (``teacher``).  Training pages are varied: containers are renamed, and menus, notices, forms,
sidebars and comments are added, so that the model meets other layouts than those of the sample.

Defined results: null and empty pages, and pages without main text, give an empty string; text outside any tag is a
block; unclosed elements end with what holds them; rows that are equal give equal texts; null ids and urls stay; extra
columns are ignored.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirsearch.llm.registry import register, table

# Fixed values of HTML: elements that do not end a block, that hold no text, that hold raw text, and that end a paragraph.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BREAKS = {"br", "wbr", "img"}  # white space or nothing, within a block
ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS_SAME = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# The teacher's names: what holds the article, and what is no main text wherever it stands.
MAIN = set("article main post entry content story body-text article-body post-body post-content entry-content main-content blog-post".split())
OTHER = set("""head nav menu navbar navigation breadcrumb breadcrumbs footer site-footer page-footer aside sidebar side-bar widget related
recommended notice notices cookie cookies cookie-banner consent banner alert gdpr ad ads advert adverts advertisement ad-slot promo
sponsored sponsor form newsletter subscribe signup login search noscript template button select textarea iframe svg comments comment
comment-list reader-comments replies discussion disqus share social social-share toolbar pagination pager topbar masthead site-header
page-header skip-link copyright legal tags popup modal overlay""".split())
TAILS = [tuple(x.split()) for x in ("ul li", "ol li", "h2", "h3", "h4", "pre", "table tr td", "table tbody tr td", "table tr th", "blockquote p",
         "blockquote", "dl dt", "dl dd", "figure figcaption", "div", "section p", "div p", "header h1", "section h2", "ul li p", "address")]
PAGE_HEADER = {"header"}  # a header within the article belongs to it

SAMPLE = 300  # pages that the labeller is trained on
PATHS, WORDS = 1 << 12, 1 << 12
PATH_WIDTH, WORD_WIDTH, NUMBERS, HIDDEN = 16, 8, 5, 16
EPOCHS, BATCH, RATE = 18, 16, 0.01

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(script|style)\b.*?(?:</\1\s*>|\Z)|"""
                    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[^\s]+")


class Block:
    __slots__ = ("path", "text", "links", "main")

    def __init__(self, path: tuple[str, ...], text: str, links: int):
        self.path, self.text, self.links, self.main = path, text, links, False


@lru_cache(maxsize=1 << 14)
def _names(attributes: str) -> tuple[str, ...]:
    """Class, id and role names of a tag, in lower case."""
    return tuple(n for _, v in _ATTR.findall(attributes) for n in v.strip("\"'").lower().split())


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = in_link = at = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(tuple(n for tag, names in stack for n in (tag, *names)), text, links))
        parts.clear()
        links = 0

    def close(tags: set[str], within: set[str]) -> None:
        """Ends the innermost element of tags, unless one of within holds it."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    for m in _TOKEN.finditer(page):
        data = page[at : m.start()]
        at = m.end()
        if data:
            data = html.unescape(data) if "&" in data else data
            parts.append(data)
            links += len(data) if in_link else 0
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BREAKS:
            parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = 0 if m[2] else 1
        elif m[2]:
            flush()
            in_link = 0
            close({tag}, set())
        else:
            flush()
            in_link = 0
            if tag in ENDS_P:
                close({"p"}, {"td", "th", "li", "table", "blockquote", "div", "article", "section"})
            if tag in ENDS_SAME:
                close(ENDS_SAME[tag], {"ul", "ol", "dl", "table", "select"})
            if tag not in VOID:
                stack.append((tag, _names(m[4]) if m[4] else ()))
    data = page[at:]
    if data:
        parts.append(html.unescape(data))
    flush()
    return found


def teacher(path: tuple[str, ...], held: bool) -> bool:
    """Whether element names make a block main text; held: whether the page has a container of an article at all."""
    inside = not held
    for name in path:
        if name in OTHER or (name in PAGE_HEADER and not (inside and held)):
            return False
        inside = inside or name in MAIN
    return inside


def label(page: list[Block]) -> None:
    held = any(n in MAIN for b in page for n in b.path)
    for b in page:
        b.main = teacher(b.path, held)


def varied(page: list[Block], words: list[str], rng: np.random.Generator) -> list[Block]:
    """A page of another layout: other containers, and parts around and within the article."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    main, other = sorted(MAIN), sorted(OTHER - {"head"})
    holder = ("html", "body", *pick([("article",), ("main",), ("main", "article"), ("div", pick(main)), ("section", pick(main)), ("div", "container", "div", pick(main))]))

    def extra(base: tuple[str, ...]) -> list[Block]:
        name = pick(other)
        path = (*base, *((name,) if name in ("nav", "aside", "footer", "form") else (pick(["div", "section", "ul", "p"]), name)))
        out = []
        for _ in range(rng.integers(1, 5)):
            text = " ".join(pick(words) for _ in range(int(rng.choice([1, 2, 5, 15, 40]))))
            out.append(Block((*path, *pick([("li",), ("p",), ("ul", "li"), ("div",), ()])), text, len(text) if rng.random() < 0.4 else 0))
        return out

    out, old = [], [b for b in page if b.main]
    for b in page:
        if not b.main and (rng.random() < 0.7 or "head" in b.path):
            out.append(b)
        elif b.main and old and b is old[0]:
            for _ in range(rng.integers(0, 3)):
                out += extra(("html", "body"))
            for x in old:
                tail = (x.path[-1],) if x.path and x.path[-1] not in MAIN else ()
                if rng.random() < 0.35:
                    tail = pick(TAILS)
                y = Block((*holder, *tail), x.text, len(x.text) if rng.random() < 0.05 else 0)
                y.main = True
                out.append(y)
                if rng.random() < 0.08:
                    out += extra(holder)
            for _ in range(rng.integers(0, 3)):
                out += extra(("html", "body") if rng.random() < 0.7 else holder)
    return out


# -- inputs -----------------------------------------------------------------------------------------------------------
@lru_cache(maxsize=1 << 15)
def _path_ids(path: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(sorted({zlib.crc32(n.encode()) % PATHS for n in path} | {zlib.crc32(("own " + (path[-1] if path else "")).encode()) % PATHS}))


class Inputs:
    """The blocks of some pages as flat arrays."""

    def __init__(self, pages: list[list[Block]]):
        flat = [b for p in pages for b in p]
        paths = [_path_ids(b.path) for b in flat]
        self.path_at = np.repeat(np.arange(len(flat)), [len(x) for x in paths])
        self.paths = np.fromiter((i for x in paths for i in x), np.int64, len(self.path_at))
        tokens = [b.text.split() for b in flat]
        n = np.array([len(x) for x in tokens], np.int64)
        self.word_at = np.repeat(np.arange(len(flat)), n)
        self.words = np.fromiter((zlib.crc32(w.encode()) % WORDS for x in tokens for w in x), np.int64, len(self.word_at))
        size = np.array([len(b.text) for b in flat], np.float32)
        place = np.concatenate([np.linspace(0, 1, len(p)) for p in pages]) if flat else np.zeros(0)
        self.numbers = np.stack([np.log1p(size) / 5, np.log1p(n) / 4, np.array([b.links for b in flat]) / np.maximum(size, 1),
                                 np.array([b.text[-1] in ".!?…\"”»" for b in flat], float), place], axis=1).astype(np.float32) if flat else np.zeros((0, NUMBERS), np.float32)
        self.size = len(flat)
        self.y = np.array([b.main for b in flat], np.float32)
        # time steps: pages as columns, padded at the end
        longest = max((len(p) for p in pages), default=0)
        self.grid = np.full((longest, len(pages)), -1, np.int64)
        at = 0
        for k, p in enumerate(pages):
            self.grid[: len(p), k] = np.arange(at, at + len(p))
            at += len(p)


def _mean(vectors: np.ndarray, ids: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((n, vectors.shape[1]), np.float32)
    count = np.bincount(at, minlength=n).astype(np.float32)
    if len(ids):
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[starts]] = np.add.reduceat(vectors[ids], starts, axis=0)
    return out / np.maximum(count, 1)[:, None], count


def initial(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    width = PATH_WIDTH + WORD_WIDTH + NUMBERS
    p = {"paths": rng.normal(0, 0.3, (PATHS, PATH_WIDTH)), "words": rng.normal(0, 0.1, (WORDS, WORD_WIDTH)),
         "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
    for d in ("ahead", "back"):
        p[d] = rng.normal(0, 1 / np.sqrt(width + HIDDEN), (width + HIDDEN, 4 * HIDDEN))
        p[d + "_bias"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])  # remember at first
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states of the steps of x (steps, pages, width); masked steps leave the state as it is."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out, tape = np.zeros((steps, pages, HIDDEN), np.float32), []
    wx = x @ w[: x.shape[2]] + b
    for t in range(steps):
        z = wx[t] + h @ w[x.shape[2] :]
        gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        m = mask[t][:, None]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        if keep:
            tape.append((h, c, i, f, o, g, tc, m))
        h, c = np.where(m, o * tc, h), np.where(m, c2, c)
        out[t] = h
    return out, tape


def _lstm_back(x: np.ndarray, tape: list, w: np.ndarray, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = x.shape[2]
    dw, db, dx = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32), np.zeros_like(x)
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(len(tape) - 1, -1, -1):
        h, c, i, f, o, g, tc, m = tape[t]
        dh = dh + dout[t]
        live = np.where(m, dh, 0)
        dct = np.where(m, dc, 0) + live * o * (1 - tc * tc)
        dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
        dw[:width] += x[t].T @ dz
        dw[width:] += h.T @ dz
        db += dz.sum(0)
        dx[t] = dz @ w[:width].T
        dh = dz @ w[width:].T + np.where(m, 0, dh)
        dc = dct * f + np.where(m, 0, dc)
    return dw, db, dx


def forward(p: dict[str, np.ndarray], batch: Inputs, drop: np.ndarray | None = None, keep: bool = False):
    """Logits of the blocks; with keep, what the way back needs."""
    path, path_n = _mean(p["paths"], batch.paths, batch.path_at, batch.size)
    word, word_n = _mean(p["words"], batch.words, batch.word_at, batch.size)
    if drop is not None:
        word = word * drop[:, None]
    inputs = np.concatenate([path, word, batch.numbers], axis=1)
    mask = batch.grid >= 0
    x = np.where(mask[:, :, None], inputs[np.maximum(batch.grid, 0)], 0).astype(np.float32)
    ahead, tape1 = _lstm(x, mask, p["ahead"], p["ahead_bias"], keep)
    back, tape2 = _lstm(x[::-1], mask[::-1], p["back"], p["back_bias"], keep)
    hidden = np.concatenate([ahead, back[::-1]], axis=2)
    z = np.zeros(batch.size, np.float32)
    z[batch.grid[mask]] = (hidden @ p["out"] + p["bias"])[mask]
    return z, (x, mask, hidden, tape1, tape2, path_n, word_n)


def gradients(p: dict[str, np.ndarray], batch: Inputs, drop: np.ndarray) -> dict[str, np.ndarray]:
    z, (x, mask, hidden, tape1, tape2, path_n, word_n) = forward(p, batch, drop, keep=True)
    dz = np.zeros(mask.shape, np.float32)
    dz[mask] = ((_sigmoid(z) - batch.y) / batch.size)[batch.grid[mask]]
    grad = {"out": (hidden * dz[:, :, None]).sum((0, 1)), "bias": np.array([dz.sum()], np.float32)}
    dh = dz[:, :, None] * p["out"]
    grad["ahead"], grad["ahead_bias"], dx1 = _lstm_back(x, tape1, p["ahead"], dh[:, :, :HIDDEN])
    grad["back"], grad["back_bias"], dx2 = _lstm_back(x[::-1], tape2, p["back"], dh[::-1, :, HIDDEN:])
    dx = np.zeros((batch.size, x.shape[2]), np.float32)
    dx[batch.grid[mask]] = (dx1 + dx2[::-1])[mask]
    grad["paths"], grad["words"] = np.zeros_like(p["paths"]), np.zeros_like(p["words"])
    np.add.at(grad["paths"], batch.paths, (dx[:, :PATH_WIDTH] / np.maximum(path_n, 1)[:, None])[batch.path_at])
    dword = dx[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] * drop[:, None] / np.maximum(word_n, 1)[:, None]
    np.add.at(grad["words"], batch.words, dword[batch.word_at])
    return grad


def fit(pages: list[list[Block]], seed: int = 5) -> dict[str, np.ndarray]:
    """Trains the labeller by Adam on the pages and on variations of them."""
    rng, p = np.random.default_rng(seed), initial(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for q in pages:
        label(q)
    words = sorted({w for q in pages for b in q for w in b.text.split()[:20]}) or ["word"]
    for _ in range(EPOCHS):
        order = rng.permutation(len(pages))
        for lo in range(0, len(order), BATCH):
            some = [pages[i] for i in order[lo : lo + BATCH]]
            batch = Inputs([*some, *(varied(q, words, rng) for q in some)])
            if not batch.size:
                continue
            drop = (rng.random(batch.size) < 0.5).astype(np.float32)
            step += 1
            for k, g in gradients(p, batch, drop).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return p


def main_texts(pages: list[str], model: dict[str, np.ndarray], lanes: int = 128) -> list[str]:
    """The main text of each page."""
    parsed = [blocks(x or "") for x in pages]
    order = sorted(range(len(pages)), key=lambda i: len(parsed[i]))  # pages of like length share a batch
    out = [""] * len(pages)
    for lo in range(0, len(order), lanes):
        some = [i for i in order[lo : lo + lanes] if parsed[i]]
        batch = Inputs([parsed[i] for i in some])
        main = forward(model, batch)[0] > 0 if some else []
        at = 0
        for i in some:
            out[i] = "\n\n".join(b.text for b, m in zip(parsed[i], main[at : at + len(parsed[i])]) if m)
            at += len(parsed[i])
    return out


def trained(pages: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The labeller of a bounded sample of pages."""
    mixed = F.xxhash64(F.lit(11), "page_id")
    chosen = pages.where("html is not null").select(mixed.alias("m"), "page_id").orderBy("m", "page_id").limit(sample)
    ids = F.broadcast(chosen.select("page_id").distinct())  # at most sample ids
    rows = pages.where("html is not null").select("page_id", "html").join(ids, "page_id").repartition(1).sortWithinPartitions(mixed, "page_id", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [x for b in batches for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([blocks(x) for x in texts]))], pa.binary())], names=["model"])

    made = rows.mapInArrow(run, T.StructType([T.StructField("model", T.BinaryType())])).first()
    return pickle.loads(made[0]) if made else fit([])  # no row: nothing to learn from


def extracted(pages: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """page_id, url and the main text of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some 400 KB
    source = pages.select("page_id", "url", F.col("html").cast("string"))
    schema = T.StructType([source.schema["page_id"], source.schema["url"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = main_texts(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


@register("op9_html_main")
def op9_html_main(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, trained(pages)).withColumn("n_chars", F.length("text").cast("long"))
