"""HTML extraction by a recurrent block labeller.

A page is read to leaf blocks of text. Each block is a vector of its hashed tag path (tags, and the words of classes,
ids and roles), its hashed words and a few figures; a bidirectional LSTM in numpy reads the whole sequence, so each
block is judged in the context of the page. Blocks labelled as main text are joined by line ends in page order.

The labeller is trained by fit() on pages that html_training makes by rule, with a fixed seed. That takes some four
minutes, so its weights (some 150 kB) lie beside this module; `python -m leafmill.llm.html_extract` makes them anew.
They go to the workers with the job.

Defined results: null and empty pages give an empty text, as do pages without main text. Repeated rows each give
their row, an empty table gives none. Pages are read whole, whatever their length. Columns beside the three are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import small_batches, table
from leafmill.llm.html_blocks import Block, blocks
from leafmill.llm.html_blocks import Path as Element
from leafmill.llm.html_training import Maker

PATH, WORDS, FIGURES, HIDDEN = 384, 32, 8, 24
TRAINING_PAGES = 10_000
EPOCHS = 10
#: What a page's texts weigh against its tags: words of pages to come are mostly unknown.
TEXT_WEIGHT = 0.12
#: What a block's share of linked characters weighs among its figures.
LINK_WEIGHT = 6
WEIGHTS = Path(__file__).with_name("html_weights.npz")
MARKS = b".,:;!?*%$&|"


@lru_cache(maxsize=200_000)
def slot(token: str) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "replace"))
    return h % PATH, 1.0 if h >> 31 else -1.0


def path_vector(path: Element) -> np.ndarray:
    """The summed tokens of an element and all around it, and its last tags."""
    todo = []
    while path.vector is None:
        todo.append(path)
        if path.above is None:
            path.vector = np.zeros(PATH, dtype=np.float32)
        else:
            path = path.above
    for p in reversed(todo):
        v = p.vector = (p.above.vector if p.above else p.vector).copy()
        for sign, tokens in ((-1, () if p.above is None else last_tags(p.above)), (1, (*p.tokens, *last_tags(p)))):
            for t in tokens:
                k, way = slot(t)
                v[k] += sign * way
    return path.vector if not todo else todo[0].vector


def last_tags(path: Element) -> tuple[str, str]:
    return f"l:{''.join(path.tags[-1:])}", f"p:{'/'.join(path.tags)}"


def vectors(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), PATH + WORDS + FIGURES), dtype=np.float32)
    hashes, sizes, figures = [], [], []
    for k, b in enumerate(page):
        x[k, :PATH] = b.path.vector if b.path.vector is not None else path_vector(b.path)
        # Distinct words of the whole block.
        words = set(b.text.lower().encode("utf-8", "replace").translate(None, MARKS).split())
        hashes += map(zlib.crc32, words)
        sizes.append(len(words))
        n = len(b.text)
        figures.append((n, b.text.count(" "), min(1.0, b.linked / n), b.text[-1] in ".!?", min(50, b.path.depth) / 10, k / len(page), "©" in b.text, 1))
    if not page:
        return x
    h = np.array(hashes, dtype=np.int64)
    count = np.array(sizes)
    at = np.repeat(np.arange(len(page)) * WORDS, count) + h % WORDS
    words = np.bincount(at, np.where(h >> 31, 1.0, -1.0), len(page) * WORDS).reshape(-1, WORDS)
    x[:, PATH : PATH + WORDS] = TEXT_WEIGHT * words / np.sqrt(np.maximum(1, count))[:, None]
    f = np.array(figures, dtype=np.float32)
    f[:, 0], f[:, 1], f[:, 2] = np.log1p(f[:, 0]) / 8, np.log1p(f[:, 1]) / 5, LINK_WEIGHT * f[:, 2]
    x[:, PATH + WORDS :] = TEXT_WEIGHT * f
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Weights by name: for each direction input, recurrent and bias; and the output layer."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        d, h = PATH + WORDS + FIGURES, HIDDEN
        self.w: dict[str, np.ndarray] = {"out": rng.normal(0, 0.1, (2 * h, 1)), "out_b": np.zeros(1)}
        for k in "fb":
            bias = np.zeros(4 * h)
            bias[h : 2 * h] = 1  # remember at first
            self.w |= {f"{k}x": rng.normal(0, 1 / np.sqrt(d), (d, 4 * h)), f"{k}h": rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)), f"{k}_b": bias}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """x: time x pages x inputs; states beyond a page's end stay as they are. keep: gates too, for gradients."""
        t, b, _ = x.shape
        z = (x.reshape(t * b, -1) @ self.w[f"{side}x"] + self.w[f"{side}_b"]).reshape(t, b, -1)
        h = c = np.zeros((b, HIDDEN), dtype=np.float32)
        out, kept = np.zeros((t, b, HIDDEN), dtype=np.float32), []
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            a = z[k] + h @ self.w[f"{side}h"]
            i, f, o, g = sigmoid(a[:, :HIDDEN]), sigmoid(a[:, HIDDEN : 2 * HIDDEN]), sigmoid(a[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
            m = mask[k][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                kept.append((k, h, c, i, f, o, g, tc, m))
            c, h = np.where(m, c_new, c), np.where(m, o * tc, h)
            out[k] = h
        return out, kept

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log odds of main text, time x pages."""
        both = np.concatenate([self._run("f", x, mask)[0], self._run("b", x, mask)[0]], axis=2)
        return (both @ self.w["out"] + self.w["out_b"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        runs = {k: self._run(k, x, mask, keep=True) for k in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = sigmoid((both @ self.w["out"] + self.w["out_b"])[:, :, 0])
        n = mask.sum()
        d = np.where(mask, p - y, 0).astype(np.float32) / n
        loss = -np.where(mask, np.log(np.where(y > 0, p, 1 - p) + 1e-9), 0).sum() / n
        g = {"out": (both * d[:, :, None]).sum(axis=(0, 1))[:, None], "out_b": d.sum(keepdims=True)[0]}
        d_both = d[:, :, None] * self.w["out"][:, 0]
        for s, side in enumerate("fb"):
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
            dh = dc = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
            g_h = np.zeros_like(self.w[f"{side}h"])
            for k, h0, c0, i, f, o, gg, tc, m in reversed(runs[side][1]):
                dh = dh + d_both[k][:, s * HIDDEN : (s + 1) * HIDDEN]
                dhm, dcm = np.where(m, dh, 0), np.where(m, dc, 0)
                dct = dcm + dhm * o * (1 - tc * tc)
                dz[k] = np.concatenate([dct * gg * i * (1 - i), dct * c0 * f * (1 - f), dhm * tc * o * (1 - o), dct * i * (1 - gg * gg)], axis=1)
                g_h += h0.T @ dz[k]
                dh, dc = np.where(m, 0, dh) + dz[k] @ self.w[f"{side}h"].T, np.where(m, 0, dc) + dct * f
            flat = dz.reshape(-1, 4 * HIDDEN)
            g |= {f"{side}x": x.reshape(-1, x.shape[2]).T @ flat, f"{side}h": g_h, f"{side}_b": flat.sum(axis=0)}
        return g, float(loss)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """time x pages x inputs and the mask of what is there."""
    t = max(len(p) for p in pages)
    x, mask = np.zeros((t, len(pages), PATH + WORDS + FIGURES), dtype=np.float32), np.zeros((t, len(pages)), dtype=bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def labelled(seed: int, pages: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of made pages: a block is main text if its place in the page lies in the article's own parts."""
    make, out = Maker(seed), []
    for _ in range(pages):
        page, article = make.page()
        read, own = blocks(page), [b.text for b in blocks(article)]
        y, k = np.zeros(len(read), dtype=np.float32), 0
        for n, b in enumerate(read):
            if k < len(own) and b.text == own[k]:
                y[n], k = 1, k + 1
        if read and k == len(own):
            out.append((vectors(read), y))
    return out


def fit(seed: int = 3, pages: int = TRAINING_PAGES, epochs: int = EPOCHS) -> Labeller:
    """The labeller, trained by Adam on made pages of like length together."""
    data = sorted(labelled(seed, pages), key=lambda d: len(d[0]))
    groups = [data[k : k + 48] for k in range(0, len(data), 48)]
    model, rng = Labeller(seed), np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in model.w.items()}, {k: np.zeros_like(v) for k, v in model.w.items()}, 0
    for epoch in range(epochs):
        for n in rng.permutation(len(groups)):
            x, mask = padded([v for v, _ in groups[n]])
            y = np.zeros(mask.shape, dtype=np.float32)
            for k, (_, labels) in enumerate(groups[n]):
                y[: len(labels), k] = labels
            g, _ = model.gradients(x, mask, y)
            step += 1
            rate = 0.012 * (1 - (step - 1) / (epochs * len(groups)))
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                model.w[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


@cache
def shipped() -> Labeller:
    """The labeller with the weights beside this module."""
    model = Labeller()
    with np.load(WEIGHTS) as held:
        model.w = {k: held[k].astype(np.float32) for k in model.w}
    return model


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    """The main text of each page. Pages of like length are labelled together, up to some 50,000 blocks at once."""
    read = [blocks(p) for p in pages]
    out = [""] * len(pages)
    todo = sorted((k for k, b in enumerate(read) if b), key=lambda k: len(read[k]))
    while todo:
        t = len(read[todo[-1]])
        group = [todo.pop() for _ in range(min(len(todo), max(1, min(128, 50_000 // t))))]
        scores = model.scores(*padded([vectors(read[k]) for k in group]))
        for n, k in enumerate(group):
            out[k] = "\n".join(b.text for b, s in zip(read[k], scores[:, n]) if s > 0)
    return out


def extract(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and text (the main text), for each row."""
    small_batches(pages.sparkSession)
    shared = model or shipped()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(main_texts(b.column(2).to_pylist(), shared), pa.string())], names=["id", "url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    said = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return said.mapInArrow(rows, f"id {kinds[0]}, url {kinds[1]}, text string").withColumnsRenamed({"id": id_col, "url": url_col})


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in fit().w.items()})
