"""Main text of web pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks: runs of text between block tags,
each with its path of tags, classes and ids. A bidirectional LSTM in numpy reads
one vector per block (hashed path, hashed words, a few figures) and labels every
block with the whole page as context, in both directions. The blocks labelled as
main text are joined.

The tables have no labelled pages, so the labeller learns from the table's own
markup: on at most about `TRAIN_PAGES` pages (by a hash of page_id, of at most
`TRAIN_CHARS` characters each) the semantic tags tell which blocks are the
article. Each page is then seen in several disguises: the article's container is
renamed or hidden, and menus, notices, sidebars, forms, adverts and comments made
of the sample's own texts are put around and into it. So the labeller cannot lean
on one tag.

Scoring reads every whole page once and shuffles nothing.

Edge cases: a null or empty page, and one without any text, has empty text; tags
that are not closed, or closed out of order, end where their parent does; a page
without an article may have no main text; without a page to learn from, the
semantic tags alone decide; repeated rows are read one by one.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.rows import with_texts

TRAIN_PAGES = 400
TRAIN_CHARS = 100_000
SHOWN = 1200
STEPS = 180
HIDDEN = 20
PATH_CELLS, WORD_CELLS, FIGURES = 256, 64, 6
WIDTH = PATH_CELLS + WORD_CELLS + FIGURES
BATCH = 64
BATCH_BLOCKS = 16_384

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr "
    # parts of a phrase that show no text of their own, and formulas
    "script style noscript template svg iframe object textarea select optgroup option "
    "math mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg iframe object textarea select option annotation".split())
SELF_CLOSING = frozenset("p li dt dd tr td th".split())
ARTICLE = frozenset("article main".split())
ASIDE = frozenset("nav header footer aside form menu title dialog button .ad .ads .comments .sidebar".split())


@dataclass(frozen=True)
class Block:
    """Text between block tags; path as tokens from the outermost tag."""

    path: tuple[str, ...]
    text: str
    linked: int


class _Reader(HTMLParser):
    """Collects the blocks of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.found: list[Block] = []
        self.parts: list[str] = []
        self.silent = self.links = self.linked = 0

    def _close_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = tuple(x for tag, tokens in self.stack if tag not in INLINE for x in tokens)
            self.found.append(Block(path, text, self.linked))
        self.parts, self.linked = [], 0

    def _pop(self, size: int) -> None:
        for tag, _ in self.stack[size:]:
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        del self.stack[size:]

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE and not self.silent:
            self._close_block()
            # an open paragraph ends at any block; an item at the next one
            for at in range(len(self.stack) - 1, -1, -1):
                open_tag = self.stack[at][0]
                if open_tag == "p" or (open_tag == tag and tag in SELF_CLOSING):
                    self._pop(at)
                    break
                if open_tag not in INLINE:
                    break
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        named = dict(attrs)
        marks = [f".{x}" for x in (named.get("class") or "").lower().split()]
        marks += [f"#{x}" for x in (named.get("id") or "").lower().split()]
        marks += [f"@{x}" for x in (named.get("role") or "").lower().split()]
        self.stack.append((tag, (tag, *marks)))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_endtag(self, tag):
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                shown = not any(x in SILENT for x, _ in self.stack[: at + 1])
                if tag not in INLINE and shown:
                    self._close_block()
                self._pop(at)
                return

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None) -> list[Block]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._close_block()
    return reader.found


def vectors(page: list[Block]) -> np.ndarray:
    """One row per block: hashed path, hashed words, figures."""
    out = np.zeros((len(page), WIDTH), np.float32)
    for number, block in enumerate(page):
        row = out[number]
        for token in {*block.path, "last " + " ".join(block.path[-1:])}:
            row[zlib.crc32(token.encode("utf-8", "surrogatepass")) % PATH_CELLS] = 1.0
        words = block.text.lower().split()
        for word in words:
            row[PATH_CELLS + zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_CELLS] += 1.0
        row[PATH_CELLS : PATH_CELLS + WORD_CELLS] /= max(1, len(words))
        row[PATH_CELLS + WORD_CELLS :] = (
            np.log1p(len(words)) / 4,
            block.linked / max(1, len(block.text)),
            number / max(1, len(page) - 1),
            number == 0,
            block.text[-1] in ".!?",
            len(block.path) / 8,
        )
    return out


def teacher(page: list[Block]) -> list[bool]:
    """What semantic tags say: inside the article and in no part that is not."""
    return [bool(ARTICLE.intersection(x.path)) and not ASIDE.intersection(x.path) for x in page]


_CONTAINERS = (("article",), ("main",), ("div", ".content"), ("div", ".post"), ("section", ".entry"), ("div", "#main"))
_INTRUDERS = (
    ("aside",), ("aside", ".sidebar"), ("div", ".sidebar"), ("div", ".comments"), ("section", "#comments"),
    ("div", ".comment"), ("form",), ("div", ".newsletter"), ("div", ".cookie"), ("div", ".notice"), ("div", ".ad"),
    ("div", ".ads"), ("div", ".advert"), ("header",), ("nav",), ("div", ".menu"), ("div", ".related"),
    ("div", ".share"), ("footer",), ("div", ".footer"), ("div", ".banner"), ("div", ".breadcrumb"),
)


def _disguised(page, labels, texts: list[str], rng) -> tuple[list[Block], list[bool]]:
    """The page with its container renamed and other parts put in."""
    container = _CONTAINERS[rng.integers(len(_CONTAINERS))] if rng.random() < 0.5 else ("article",)
    page = [
        Block(tuple(y for x in b.path for y in (container if x in ARTICLE else (x,)) if rng.random() > 0.03), b.text, b.linked)
        for b in page
    ]
    for _ in range(rng.integers(0, 4)):
        at = int(rng.integers(0, len(page) + 1))
        near = page[min(at, len(page) - 1)].path if page else ("html", "body")
        inside = rng.random() < 0.4
        path = (*(near[:-1] if inside else ("html", "body")), *_INTRUDERS[rng.integers(len(_INTRUDERS))])
        tails = (("p",), ("ul", "li"), ("div",), ("h3",), ())
        tail = tails[rng.integers(len(tails))]
        new = []
        for _ in range(rng.integers(1, 5)):
            text = texts[rng.integers(len(texts))]
            new.append(Block((*path, *tail), text, len(text) if rng.random() < 0.3 else 0))
        page = page[:at] + new + page[at:]
        labels = labels[:at] + [False] * len(new) + labels[at:]
    return page, labels


class Labeller:
    """The bidirectional LSTM. Parameters by name; sequences are padded at the
    end, and a mask holds the state where a page has ended."""

    def __init__(self, parameters: dict[str, np.ndarray] | None = None, seed: int = 11):
        if parameters is None:
            rng = np.random.default_rng(seed)
            parameters = {}
            for way in ("f", "b"):
                parameters["x" + way] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)).astype(np.float32)
                parameters["h" + way] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
                bias = np.zeros(4 * HIDDEN, np.float32)
                bias[HIDDEN : 2 * HIDDEN] = 1.0
                parameters["c" + way] = bias
            parameters["out"] = rng.normal(0, 0.1, 2 * HIDDEN + 1).astype(np.float32)
        self.parameters = parameters

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States of one direction, (steps, pages, HIDDEN)."""
        steps, size, _ = x.shape
        given = x @ self.parameters["x" + way] + self.parameters["c" + way]
        h, c = np.zeros((size, HIDDEN), np.float32), np.zeros((size, HIDDEN), np.float32)
        states = np.zeros((steps, size, HIDDEN), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.parameters["h" + way]
            i, f, o = (1 / (1 + np.exp(-z[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            live = mask[t][:, None]
            new_c = f * c + i * g
            top = np.tanh(new_c)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, top, live))
            h, c = live * (o * top) + (1 - live) * h, live * new_c + (1 - live) * c
            states[t] = h
        return states

    def _joined(self, x, mask, keeps=(None, None)) -> np.ndarray:
        both = [self._run(x, mask, way, keep) for way, keep in zip("fb", keeps, strict=True)]
        ones = np.ones((*both[0].shape[:2], 1), np.float32)
        return np.concatenate([*both, ones], axis=2)

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For every block the log odds of being main text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            x, mask = _padded([pages[k] for k in some])
            found = self._joined(x, mask) @ self.parameters["out"]
            for place, k in enumerate(some):
                out[k] = found[: len(pages[k]), place]
        return out

    def gradients(self, x, mask, y) -> dict[str, np.ndarray]:
        keeps = ([], [])
        joined = self._joined(x, mask, keeps)
        p = 1 / (1 + np.exp(-(joined @ self.parameters["out"])))
        error = (p - y) * mask / mask.sum()
        grad = {"out": np.einsum("tb,tbh->h", error, joined)}
        back = error[:, :, None] * self.parameters["out"]
        for number, way in enumerate("fb"):
            own = back[:, :, number * HIDDEN : (number + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            grad["h" + way] = np.zeros_like(self.parameters["h" + way])
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, top, live in reversed(keeps[number]):
                dh = dh + own[t]
                new_dh, new_dc = dh * live, dc * live
                do, dc_in = new_dh * top, new_dc + new_dh * o * (1 - top * top)
                dz = np.concatenate(
                    [dc_in * g * i * (1 - i), dc_in * c * f * (1 - f), do * o * (1 - o), dc_in * i * (1 - g * g)], axis=1
                )
                dz_all[t] = dz
                grad["h" + way] += h.T @ dz
                dh = dz @ self.parameters["h" + way].T + dh * (1 - live)
                dc = dc_in * f + dc * (1 - live)
            grad["x" + way] = x.reshape(-1, WIDTH).T @ dz_all.reshape(-1, 4 * HIDDEN)
            grad["c" + way] = dz_all.sum((0, 1))
        return grad

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], seed: int = 5) -> None:
        """Adam on batches of whole pages of like length, fewer where they are long."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.parameters.items()}
        second = {k: np.zeros_like(v) for k, v in self.parameters.items()}
        step = 0
        while step < STEPS:
            order = sorted(range(len(pages)), key=lambda k: (len(pages[k]), rng.random()))
            batches = [[]]
            for k in order:
                # padded to the longest, which comes last
                if len(batches[-1]) == BATCH or (batches[-1] and len(pages[k]) * (len(batches[-1]) + 1) > BATCH_BLOCKS):
                    batches.append([])
                batches[-1].append(k)
            for some in (batches[k] for k in rng.permutation(len(batches))):
                x, mask = _padded([pages[k] for k in some])
                y = _padded([labels[k][:, None] for k in some])[0][:, :, 0]
                step += 1
                for name, g in self.gradients(x, mask, y).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    fixed = first[name] / (1 - 0.9**step), second[name] / (1 - 0.999**step)
                    self.parameters[name] -= np.float32(0.01) * fixed[0] / (np.sqrt(fixed[1]) + 1e-8)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in pages)
    out = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for place, x in enumerate(pages):
        out[: len(x), place] = x
        mask[: len(x), place] = 1.0
    return out, mask


def learn(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Labeller | None:
    """A labeller from a bounded sample of pages (page_id, html)."""
    some = pages.select("page_id", "html").filter(F.length("html").between(1, TRAIN_CHARS))
    count = some.count()
    if not count:
        return None
    # of the page and its text, so neither a null or repeated id nor a repeated page fills the sample
    order = F.xxhash64("page_id", "html")
    if count > train_pages:
        some = some.filter(F.pmod(order, F.lit(1_000_000)) < int(1_000_000 * train_pages / count)).distinct()
    some = some.orderBy(order, "page_id", "html").limit(2 * train_pages)
    read = [blocks(r["html"]) for r in some.collect()]
    known = [(x, teacher(x)) for x in read if any(teacher(x))]
    if not known:
        return None
    rng = np.random.default_rng(3)
    texts = [b.text for page, _ in known for b in page]
    # short texts stand where menus and notices do
    texts += [" ".join(x.split()[:4]) for x in texts]
    shown = list(known)
    while len(shown) < SHOWN:
        shown += [_disguised(page, labels, texts, rng) for page, labels in known]
    labeller = Labeller()
    labeller.fit([vectors(x) for x, _ in shown], [np.array(y, np.float32) for _, y in shown])
    return labeller


def extract(pages: DataFrame, labeller: Labeller | None) -> DataFrame:
    """pages without html, with text and n_chars."""

    def compute():
        model = labeller

        def of(html: pa.Array) -> list:
            read = [blocks(x) for x in html.to_pylist()]
            if model is None:
                main = [teacher(x) for x in read]
            else:
                main = [s > 0 for s in model.scores([vectors(x) for x in read])]
            texts = ["\n".join(b.text for b, m in zip(x, y, strict=True) if m) for x, y in zip(read, main, strict=True)]
            return [texts, [len(x) for x in texts]]

        return of

    return with_texts(pages, [x for x in pages.columns if x != "html"], "text string, n_chars long", compute, "html")
