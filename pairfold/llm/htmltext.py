"""Main text of web pages by a recurrent block labeller.

A page is its sequence of leaf blocks. A block's input is the mean embedding of its tag path (tags, and parts of class, id
and role), the mean embedding of its hashed words, and a few numbers (length, links, punctuation, place). A bidirectional
LSTM reads the whole sequence, so every block is judged in the context of the document, however long; the blocks it calls
main text are joined in page order. The network is trained here, in numpy, on invented pages whose main text is known, from
a fixed seed; nothing is learned from the pages themselves, so a page's text does not depend on which others there are.

Defined results: a null or empty page, or one without main text, has an empty text of 0 characters; a page cut anywhere is
read as far as it goes; repeated rows are read one by one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .htmlblocks import Block, blocks_of
from .htmlgen import Writer

PATHS, WORDS, NUMBERS = 1024, 1024, 9
MARKS = re.compile(r"[.,;:!?]")
_hash: dict[str, int] = {}


def hashed(word: str, size: int) -> int:
    k = _hash.get(word)
    if k is None:
        if len(_hash) > 200_000:
            _hash.clear()
        k = _hash[word] = zlib.crc32(word.encode("utf-8", "replace"))
    return k % size


class Inputs:
    """The inputs of some pages' blocks, laid end to end; elements are laid once, however many blocks are in them."""

    def __init__(self, pages: list[list[Block]]):
        self.count = np.array([len(p) for p in pages], int)
        word, self.word_n, numbers, nodes, node, depth = [], [], [], [], [], []
        for p in pages:
            for b in p:
                line, at = [], b.node
                while at and not (0 <= at.place < len(nodes) and nodes[at.place] is at):
                    line.append(at)
                    at = at.parent
                level = depth[at.place] if at else -1
                for k, x in enumerate(reversed(line)):
                    x.place = len(nodes)
                    nodes.append(x)
                    depth.append(level + 1 + k)
                node.append(b.node.place if b.node else -1)
            for i, b in enumerate(p):
                words = b.text.lower().split()
                word += [hashed(x, WORDS) for x in words]
                self.word_n.append(len(words))
                n = len(b.text)
                numbers.append((np.log1p(n) / 6, b.link, b.form, len(MARKS.findall(b.text)) / len(words), (b.node.size if b.node else 0) / 10, i / len(p), 1 / (i + 1), 1 / (len(p) - i), np.log1p(len(p)) / 4))
        self.word = np.array(word, int)
        self.numbers = np.array(numbers, np.float32).reshape(-1, NUMBERS)
        self.word_n = np.array(self.word_n, int)
        self.node, self.size = np.array(node, int), np.array([x.size for x in nodes], np.float32)
        self.own = np.array([hashed(x, PATHS) for e in nodes for x in e.own], int)
        self.own_n = np.array([len(e.own) for e in nodes], int)
        self.parent = np.array([e.parent.place if e.parent else -1 for e in nodes], int)
        order = np.argsort(np.array(depth, int), kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(np.array(depth, int)))[:-1]) if nodes else []

    def paths(self, table: np.ndarray) -> np.ndarray:
        """Mean rows of ``table`` along each block's tag path, from sums that elements hand down to those in them."""
        out = np.zeros((len(self.node), table.shape[1]), np.float32)
        if len(self.parent):
            sums = np.add.reduceat(table[self.own], np.cumsum(self.own_n) - self.own_n, axis=0)
            for at in self.levels[1:]:
                sums[at] += sums[self.parent[at]]
            some = self.node >= 0
            out[some] = (sums / self.size[:, None])[self.node[some]]
        return out

    def spread_paths(self, grad: np.ndarray) -> np.ndarray:
        """The gradient of ``paths`` for its table."""
        sums = np.zeros((len(self.parent), grad.shape[1]), np.float32)
        some = self.node >= 0
        np.add.at(sums, self.node[some], grad[some] / self.size[self.node[some], None])
        for at in reversed(self.levels[1:]):
            np.add.at(sums, self.parent[at], sums[at])
        each = np.repeat(sums, self.own_n, axis=0)
        return np.stack([np.bincount(self.own, each[:, j], PATHS) for j in range(each.shape[1])], 1).astype(np.float32)


def bag(table: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean rows of ``table`` for runs of ``n`` indices."""
    out = np.zeros((len(n), table.shape[1]), np.float32)
    some = n > 0
    if some.any():
        heads = np.cumsum(n) - n
        out[some] = np.add.reduceat(table[at], heads[some], axis=0) / n[some, None]
    return out


def spread(grad: np.ndarray, at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The gradient of ``bag`` for its table."""
    each = np.repeat(grad / np.maximum(n, 1)[:, None], n, axis=0)
    return np.stack([np.bincount(at, each[:, j], size) for j in range(each.shape[1])], 1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """An LSTM over x (time, page, input)."""
    t, n, _ = x.shape
    k = u.shape[0]
    h, c, out = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32), np.zeros((t, n, k), np.float32)
    pre = x @ w + b
    for i in range(t):
        z = pre[i] + h @ u
        s = sigmoid(z[:, : 3 * k])
        g = np.tanh(z[:, 3 * k :])
        before, c = c, s[:, k : 2 * k] * c + s[:, :k] * g
        tc = np.tanh(c)
        if keep is not None:
            keep.append((h, before, s, g, tc))
        h = out[i] = s[:, 2 * k :] * tc
    return out


def backward(x: np.ndarray, w: np.ndarray, u: np.ndarray, keep: list, grad: np.ndarray) -> tuple[np.ndarray, ...]:
    k = u.shape[0]
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * k, np.float32), np.zeros_like(x)
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for i in range(len(x) - 1, -1, -1):
        h, before, s, g, tc = keep[i]
        dh = dh + grad[i]
        si, sf, so = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :]
        dc = dc + dh * so * (1 - tc * tc)
        dz = np.hstack((dc * g * si * (1 - si), dc * before * sf * (1 - sf), dh * tc * so * (1 - so), dc * si * (1 - g * g)))
        dw += x[i].T @ dz
        du += h.T @ dz
        db += dz.sum(0)
        dx[i] = dz @ w.T
        dh, dc = dz @ u.T, dc * sf
    return dw, du, db, dx


class Labeller:
    """Embeddings, two LSTMs and a logistic output."""

    def __init__(self, hidden: int = 16, path: int = 16, word: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden, width = hidden, path + word + NUMBERS
        self.p = {"path": draw(PATHS, path) * 16, "word": draw(WORDS, word) * 4, "out": draw(2 * hidden, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1
            self.p |= {f"w{d}": draw(width, 4 * hidden), f"u{d}": draw(hidden, 4 * hidden), f"b{d}": b}

    def layout(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Time (forward and backward) and page of each block."""
        page = np.repeat(np.arange(len(count)), count)
        t = np.arange(len(page)) - np.repeat(np.cumsum(count) - count, count)
        return t, count[page] - 1 - t, page, int(count.max(initial=0))

    def run(self, x: Inputs, learn: np.ndarray | None = None) -> np.ndarray | dict[str, np.ndarray]:
        """Each block's probability; or with labels in ``learn``, the gradients of the mean log loss."""
        p = self.p
        flat = np.hstack((x.paths(p["path"]), bag(p["word"], x.word, x.word_n), x.numbers))
        fore, back, page, longest = self.layout(x.count)
        state, seq, keeps = [], [], []
        for d, t in (("f", fore), ("b", back)):
            s = np.zeros((longest, len(x.count), flat.shape[1]), np.float32)
            s[t, page] = flat
            keep: list | None = None if learn is None else []
            state.append(forward(s, p[f"w{d}"], p[f"u{d}"], p[f"b{d}"], keep)[t, page])
            seq.append(s)
            keeps.append(keep)
        both = np.hstack(state)
        prob = sigmoid(both @ p["out"] + p["bias"])[:, 0]
        if learn is None:
            return prob
        dz = ((prob - learn) / len(learn)).astype(np.float32)[:, None]
        grads = {"out": both.T @ dz, "bias": dz.sum(0)}
        dboth, dflat = dz @ p["out"].T, np.zeros_like(flat)
        for k, (d, t) in enumerate((("f", fore), ("b", back))):
            g = np.zeros((longest, len(x.count), self.hidden), np.float32)
            g[t, page] = dboth[:, k * self.hidden : (k + 1) * self.hidden]
            grads[f"w{d}"], grads[f"u{d}"], grads[f"b{d}"], dx = backward(seq[k], p[f"w{d}"], p[f"u{d}"], keeps[k], g)
            dflat += dx[t, page]
        a, b = p["path"].shape[1], p["path"].shape[1] + p["word"].shape[1]
        grads["path"], grads["word"] = x.spread_paths(dflat[:, :a]), spread(dflat[:, a:b], x.word, x.word_n, WORDS)
        return grads


def labelled_page(pieces: list[tuple[str, bool]]) -> tuple[list[Block], list[bool]]:
    """Blocks of an invented page with their labels; marks that no text holds tell the pieces apart."""
    blocks = blocks_of("".join(re.sub(r"(?<=>)([^<>]+)|\A([^<>]+)", lambda m: "\x01" + m[0], x) if main else x for x, main in pieces))
    label = ["\x01" in b.text for b in blocks]
    for b in blocks:
        b.text = " ".join(b.text.replace("\x01", "").split()) or "."
    return blocks, label


def train(pages: int = 900, rounds: int = 8, batch: int = 30, rate: float = 0.01, seed: int = 3) -> Labeller:
    """A labeller trained on invented pages; the same for equal arguments."""
    made = [labelled_page(Writer(seed * 1_000_003 + i).page()) for i in range(pages)]
    made = [m for m in made if m[0]]
    net, rng = Labeller(seed=seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, total = 0, rounds * -(-len(made) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(made))
        for at in range(0, len(order), batch):
            some = [made[i] for i in order[at : at + batch]]
            grads = net.run(Inputs([b for b, _ in some]), np.array([y for _, ys in some for y in ys], np.float32))
            step += 1
            lr = rate * (1 - step / (total + 1))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] = net.p[k] - (lr / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    net.p = {k: x.astype(np.float32) for k, x in net.p.items()}
    return net


def main_texts(net: Labeller, pages: list[str | None], cells: int = 1 << 15) -> list[str]:
    """The main text of each page; pages run side by side with others of like length."""
    blocks = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
    at = 0
    while at < len(order):  # as many pages at once as hold, padded to the longest, a bounded number of blocks
        end = at + 1
        while end < len(order) and end - at < 64 and (end - at + 1) * len(blocks[order[end]]) <= cells:
            end += 1
        some, at = order[at:end], end
        prob = net.run(Inputs([blocks[i] for i in some]))
        lo = 0
        for i in some:
            hi = lo + len(blocks[i])
            out[i] = " ".join(b.text for b, p in zip(blocks[i], prob[lo:hi]) if p >= 0.5)
            lo = hi
    return out


_trained: dict[tuple, Labeller] = {}


def trained(**options) -> Labeller:
    key = tuple(sorted(options.items()))
    if key not in _trained:
        _trained[key] = train(**options)
    return _trained[key]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", net: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(net or trained())  # a network of fixed size
    rows = df.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"), F.col(url_col).alias("url"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1, 1 << 20):
            texts = main_texts(shared.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
