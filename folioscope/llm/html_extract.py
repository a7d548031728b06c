"""Main text of web pages by a recurrent labeller of their blocks.

A page is the sequence of its leaf blocks. Each block has a vector from the hashed
names along its tag path, its hashed words and a few numbers; a bidirectional
LSTM in numpy reads the sequence both ways, and so classifies every block knowing the whole
document. It is trained here, on pages of the table whose tags say what their article
is and on random layouts of the same texts, whose blocks are known.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import SMALL_MEMO_BYTES, Memo, few, slices
from folioscope.llm.html_blocks import Block, layout, leaf_blocks, within

#: Bounds of the fitting: pages (the first by hash) of at most so many characters, layouts made of their texts, and blocks of a training sequence.
SAMPLE, SAMPLE_CHARS, LAYOUTS, WINDOW = 256, 100_000, 1_200, 96
#: Hashed names of paths, hashed words, numbers of a block, and cells of the LSTM in each direction.
PATHS, WORDS, NUMBERS, CELLS = 2_048, 512, 6, 16
EPOCHS, PAGES_AT_ONCE, RATE = 5, 24, 0.01
#: Blocks that are read at once.
BLOCKS = 8_192

_paths = Memo(lambda token: zlib.crc32(token.encode()) % PATHS, SMALL_MEMO_BYTES, "html")
_words = Memo(lambda word: zlib.crc32(word.lower().encode()) % WORDS, SMALL_MEMO_BYTES, "html")


class Features:
    """Of a run of blocks: hashed names and words as flat numbers with their starts, and numbers."""

    def __init__(self, blocks: list[Block]):
        paths = [list(map(_paths.__getitem__, set(b.path))) or [0] for b in blocks]
        words = [b.text.split() for b in blocks]
        self.n = len(blocks)
        self.path = np.fromiter((x for p in paths for x in p), np.int32)
        self.path_of = np.repeat(np.arange(self.n), [len(p) for p in paths])
        self.word = np.fromiter(map(_words.__getitem__, (x for w in words for x in w)), np.int32)
        counts = np.array([len(w) for w in words], np.int64)
        self.word_of = np.repeat(np.arange(self.n), counts)
        chars = np.array([len(b.text) for b in blocks], np.float64)
        linked = np.array([b.linked for b in blocks], np.float64)
        ends = np.array([b.text[-1] in ".!?。…\"'»”" for b in blocks], np.float64)
        self.numbers = np.stack([np.ones(self.n), np.log1p(counts) / 4, linked / np.maximum(chars, 1), ends, counts < 4, counts > 25], 1).astype(np.float32)

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Path counts and word shares, blocks by buckets."""
        paths = np.bincount(self.path_of * PATHS + self.path, minlength=self.n * PATHS).reshape(self.n, PATHS).astype(np.float32)
        words = np.bincount(self.word_of * WORDS + self.word, minlength=self.n * WORDS).reshape(self.n, WORDS).astype(np.float32)
        return paths, words / np.maximum(words.sum(1, keepdims=True), 1)

    def project(self, p: dict[str, np.ndarray]) -> np.ndarray:
        """Inputs of both directions' gates and, last, of the answer itself."""
        starts = np.flatnonzero(np.diff(self.path_of, prepend=-1))
        out = np.add.reduceat(p["paths"][self.path], starts, axis=0)
        words = np.bincount(self.word_of * WORDS + self.word, minlength=self.n * WORDS).reshape(self.n, WORDS).astype(np.float32)
        return out + (words / np.maximum(words.sum(1, keepdims=True), 1)) @ p["words"] + self.numbers @ p["numbers"]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
    """Input, forget and output gate, and the candidate."""
    h = CELLS
    s = sigmoid(z[:, : 3 * h])
    return s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(z[:, 3 * h :])


def scan(x: np.ndarray, mask: np.ndarray, u: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None, kept: list | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Hidden states of steps x pages x 4 cells of gate inputs, in the order given; ``mask`` is 0 where a page has no block."""
    steps, pages = x.shape[:2]
    h, c = state or (np.zeros((pages, CELLS), np.float32), np.zeros((pages, CELLS), np.float32))
    out = np.empty((steps, pages, CELLS), np.float32)
    for t in range(steps):
        i, f, o, g = gates(x[t] + h @ u)
        m = mask[t][:, None]
        new = (f * c + i * g) * m
        tanh = np.tanh(new)
        if kept is not None:
            kept.append((h, c, i, f, o, g, tanh, m))
        c, h = new, o * tanh * m
        out[t] = h
    return out, (h, c)


def scan_back(dh: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of ``u`` from those of the hidden states."""
    steps, pages = dh.shape[:2]
    dx, du = np.empty((steps, pages, 4 * CELLS), np.float32), np.zeros_like(u)
    next_h = next_c = np.zeros((pages, CELLS), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tanh, m = kept[t]
        d = (dh[t] + next_h) * m
        dc = (next_c + d * o * (1 - tanh * tanh)) * m
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), d * tanh * o * (1 - o), dc * i * (1 - g * g)], 1)
        dx[t], next_h, next_c = dz, dz @ u.T, dc * f
        du += h.T @ dz
    return dx, du


def padded(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of successive pages as steps x pages, with the mask, and the step and page of each block."""
    page = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    x = np.zeros((int(lengths.max()), len(lengths), flat.shape[1]), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    x[step, page], mask[step, page] = flat, 1
    return x, mask, step, page


def new_model(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
    wide = 8 * CELLS + 1
    # names and words that no training page has say nothing
    return {"paths": np.zeros((PATHS, wide), np.float32), "words": np.zeros((WORDS, wide), np.float32), "numbers": small(NUMBERS, wide), "ahead": small(CELLS, 4 * CELLS), "back": small(CELLS, 4 * CELLS), "out": small(2 * CELLS)}


def learn(p: dict[str, np.ndarray], blocks: list[Block], truth: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross entropy over the blocks of some pages, by back-propagation through both scans."""
    f = Features(blocks)
    paths, words = f.dense()
    flat = paths @ p["paths"] + words @ p["words"] + f.numbers @ p["numbers"]
    x, mask, step, page = padded(flat, lengths)
    a, b = [], []
    ahead, _ = scan(x[:, :, : 4 * CELLS], mask, p["ahead"], kept=a)
    back, _ = scan(x[::-1, :, 4 * CELLS : -1], mask[::-1], p["back"], kept=b)
    hidden = np.concatenate([ahead, back[::-1]], 2)[step, page]
    answer = sigmoid(hidden @ p["out"] + flat[:, -1])
    d = ((answer - truth) / len(truth)).astype(np.float32)
    g = {"out": hidden.T @ d}
    dh = np.zeros((*mask.shape, 2 * CELLS), np.float32)
    dh[step, page] = d[:, None] * p["out"]
    da, g["ahead"] = scan_back(dh[:, :, :CELLS], a, p["ahead"])
    db, g["back"] = scan_back(np.ascontiguousarray(dh[::-1, :, CELLS:]), b, p["back"])
    dflat = np.concatenate([da[step, page], db[::-1][step, page], d[:, None]], 1)
    return g | {"paths": paths.T @ dflat, "words": words.T @ dflat, "numbers": f.numbers.T @ dflat}


def train(pages: list[list[tuple[Block, bool]]], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Adam over the pages; the same pages give the same model."""
    p, rng = new_model(), random.Random(5)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step, pages = 0, [page[at : at + WINDOW] for page in pages for at in range(0, len(page), WINDOW)]
    for epoch in range(epochs):
        rng.shuffle(pages)
        for at in range(0, len(pages), PAGES_AT_ONCE):
            part = pages[at : at + PAGES_AT_ONCE]
            g = learn(p, [b for page in part for b, _ in page], np.array([y for page in part for _, y in page], np.float32), np.array([len(x) for x in part]))
            step += 1
            rate = RATE * (1 - epoch / (epochs + 1))
            for k in p:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] * g[k] - second[k])
                p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def classify(p: dict[str, np.ndarray], pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, whether each of its blocks is of the article. A page of many blocks is read in pieces."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        n = 0  # pages of similar length, so many that they fill the bound
        while n < len(order) and (n + 1) * len(pages[order[n]]) <= BLOCKS:
            n += 1
        if not n:
            i = order.pop(0)
            out[i] = classify_long(p, pages[i])
            continue
        part, order = order[:n], order[n:]
        lengths = np.array([len(pages[i]) for i in part])
        flat = Features([b for i in part for b in pages[i]]).project(p)
        x, mask, step, page = padded(flat, lengths)
        ahead, _ = scan(x[:, :, : 4 * CELLS], mask, p["ahead"])
        back, _ = scan(x[::-1, :, 4 * CELLS : -1], mask[::-1], p["back"])
        yes = np.concatenate([ahead, back[::-1]], 2)[step, page] @ p["out"] + flat[:, -1] > 0
        for i, y in zip(part, np.split(yes, np.cumsum(lengths)[:-1])):
            out[i] = y
    return out


def classify_long(p: dict[str, np.ndarray], blocks: list[Block]) -> np.ndarray:
    """The same for one page, whose hidden states pass from piece to piece."""
    answer, mask = np.zeros(len(blocks)), np.ones((BLOCKS, 1), np.float32)
    starts = range(0, len(blocks), BLOCKS)
    for name, pieces, at in (("ahead", starts, slice(0, 4 * CELLS)), ("back", reversed(starts), slice(4 * CELLS, -1))):
        state, turn = None, 1 if name == "ahead" else -1
        weights = p["out"][:CELLS] if name == "ahead" else p["out"][CELLS:]
        for begin in pieces:
            flat = Features(blocks[begin : begin + BLOCKS]).project(p)
            h, state = scan(flat[::turn, None, at], mask[: len(flat)], p[name], state)
            answer[begin : begin + len(flat)] += h[::turn, 0] @ weights + (flat[:, -1] if name == "ahead" else 0)
    return answer > 0


def training_pages(pages: list[str], seed: int = 7, layouts: int = LAYOUTS) -> list[list[tuple[Block, bool]]]:
    """What to learn from: the given pages as far as their tags say which blocks are of the article, and layouts of their texts."""
    read = [leaf_blocks(x) for x in pages]
    told = [[(b, within(b)) for b in page] for page in read]
    real = [[(b, bool(y)) for b, y in page] for page in told if any(y for _, y in page)]
    rng = random.Random(seed)
    invented = [" ".join("".join(rng.choice("aeiourstlnmdcp") for _ in range(rng.randint(2, 9))) for _ in range(n)) + "." for n in (3, 5, 8, 13, 21, 34, 55) for _ in range(8)]
    paragraphs = [b.text for page in real for b, y in page if y and len(b.text) < 5_000] or invented
    short = [b.text for page in real for b, y in page if not y and len(b.text) < 5_000] or invented
    return real + [layout(rng, paragraphs, short) for _ in range(layouts)]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict[str, np.ndarray]:
    """The labeller, trained on at most ``SAMPLE`` different pages (by hash) of at most ``SAMPLE_CHARS`` characters and ``LAYOUTS`` layouts.

    Only about four times as many rows as the sample has leave their tasks.
    """
    html = F.col(f"`{html_col}`")
    share = few(pages.count(), SAMPLE)
    chosen = pages.where((F.length(html) <= SAMPLE_CHARS) & (F.pmod(F.xxhash64(F.col(f"`{id_col}`"), html), F.lit(1 << 20)) < share))
    sample = chosen.select(html.alias("html")).distinct().orderBy(F.xxhash64("html"), "html").limit(SAMPLE)
    return train(training_pages([r.html for r in sample.collect()]))


def extract(pages: DataFrame, model: dict[str, np.ndarray], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``: the blocks that ``model`` takes for the article's, in page order, with two line feeds between them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch, 2):
                blocks = [leaf_blocks(html) for html in x.column(2).to_pylist()]
                texts = ["\n\n".join(b.text for b, y in zip(page, taken) if y) for page, taken in zip(blocks, classify(model, blocks))]
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}
    return picked.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page, by a labeller fitted on a bounded sample of them.

    Null and empty html give an empty text; repeated rows and null ids are kept; an empty table gives no rows.
    """
    return extract(pages, fit(pages))
