"""A small causal self-attention language model over classes of subword ids, in numpy.

A frequent id is a class of its own, rare ids share classes. A token's probability is P(group | context) * P(class | group,
context) * P(token | class): the first two, a softmax in two levels, come from one causal attention layer with a feed-forward
layer over class embeddings; the last from the counts of all training text. Texts are cut into windows that overlap by half: a
window's first ``overlap`` tokens are context only (before a text's first token stand marks of its beginning), so each token is
scored once, and each sees at least ``overlap`` tokens before it where the text has them.

Beside the attention stands a table of the classes that follow frequent pairs of classes (or, after other pairs, the last
class alone), counted in all training text; a class's probability is a fixed mixture of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

LN10 = np.log(10.0)


@dataclass
class Shape:
    groups: int = 32
    members: int = 32
    width: int = 16
    hidden: int = 24
    window: int = 32
    overlap: int = 16

    @property
    def classes(self) -> int:
        """Class c is member c % members of group c // members."""
        return self.groups * self.members


@dataclass
class Model:
    shape: Shape
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, shape: Shape, mass: np.ndarray, seed: int = 7) -> Model:
        """An untrained model that gives each class its share of ``mass`` (positive)."""
        rng, d = np.random.default_rng(seed), shape.width
        draw = lambda a, b, s=1.0: (rng.standard_normal((a, b)) * s / np.sqrt(a)).astype(np.float32)
        by = mass.reshape(shape.groups, shape.members)
        return cls(shape, {
            "e": draw(shape.classes + 1, d, np.sqrt(shape.classes + 1) * 0.3), "pos": draw(shape.window, d, 0.3), "qkv": draw(d, 3 * d), "o": draw(d, d, 0.5),
            "w1": draw(d, shape.hidden), "b1": np.zeros(shape.hidden, np.float32), "w2": draw(shape.hidden, d, 0.5),
            "out": draw(d, shape.groups, 0.3), "b": np.log(by.sum(1) / mass.sum()).astype(np.float32),
            "in": draw(d, shape.classes, 0.3).reshape(d, shape.groups, shape.members).transpose(1, 0, 2).copy(), "bi": np.log(by / by.sum(1, keepdims=True)).astype(np.float32),
        })

    def levels(self) -> np.ndarray:
        """For each group the weights (the last row is of a constant input) before both softmaxes: that over groups, and that over its members."""
        p, groups = self.p, self.shape.groups
        top = np.vstack((p["out"], p["b"]))
        return np.concatenate((np.broadcast_to(top, (groups, *top.shape)), np.concatenate((p["in"], p["bi"][:, None, :]), 1)), 2)

    def scorer(self) -> Scorer:
        return Scorer(self)

    def gradients(self, x: np.ndarray, y: np.ndarray, use: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over the used positions (``weight``: one for each window), and its gradients.

        As in ``Scorer``, classes and places are multiplied by the weights once each, not once a token. A constant input 1
        stands for biases and for the sums of attention weights; so rows are one wider than the model. Where a window begins
        with what the one before it ends with, what both add to the gradients of these classes is put together first.
        """
        p, d, shape = self.p, self.shape.width, self.shape
        n, t = x.shape
        o = int(use.any(0).argmax())  # nothing is asked before
        s, m, scale = t - o, len(p["e"]), np.float32(d**-0.5)
        wider = lambda w, last=0.0: np.hstack((w, np.full((len(w), 1), last, np.float32)))
        w_q = p["qkv"][:, :d] * scale
        w_k, w_v = p["qkv"][:, d : 2 * d], p["qkv"][:, 2 * d :] @ p["o"]  # the attention's output weights are folded into the values
        place = p["pos"][:t]
        x = x.astype(np.intp)
        k, v = (p["e"] @ w_k).take(x, 0), wider(p["e"] @ w_v, 1).take(x, 0)
        k += place @ w_k
        v += wider(place @ w_v)
        q, h = (p["e"] @ w_q).take(x[:, o:], 0), wider(p["e"]).take(x[:, o:], 0)
        q += place[o:] @ w_q
        h += wider(place[o:])
        a = k @ q.transpose(0, 2, 1).copy()  # by the place seen, then the place that asks
        if a.size and a.max() > 60:
            np.minimum(a, np.float32(60), out=a)
        np.exp(a, out=a)
        a[:, o:] *= np.tri(s, dtype=np.float32).T.copy()  # what is before is seen by all
        c = (a.transpose(0, 2, 1) @ v).reshape(-1, d + 1)
        per = (1 / c[:, d]).repeat(d + 1).reshape(c.shape)  # as wide as what it scales, which takes less time than to scale row by row
        c *= per
        h = h.reshape(-1, d + 1)
        h += c
        flat, used = y[:, o:].ravel(), np.flatnonzero(use[:, o:])
        group = flat // shape.members
        order = used[np.argsort(group[used], kind="stable")]  # tokens of a group stand together from here on
        h, group, member = h.take(order, 0), group[order], flat[order] % shape.members
        share = np.ones(len(order), np.float32) if weight is None else weight.astype(np.float32)[order // s]
        share /= np.float32(float(share.sum(dtype=np.float64)) or 1.0)
        f = h @ np.vstack((p["w1"], p["b1"]))
        np.maximum(f, 0, out=f)
        out = f @ wider(p["w2"])
        out += h
        cut, levels = np.searchsorted(group, np.arange(shape.groups + 1)).tolist(), self.levels()
        z = level_logits(out, cut, levels, shape)
        at = np.arange(0, z.size, z.shape[1])
        at = np.concatenate((at + group, at + shape.groups + member))
        nats = z.reshape(-1).take(at)
        np.exp(z, out=z)
        whole = level_sums(z, shape)
        nats -= np.log(whole.T.ravel())
        z *= (share[:, None] / whole).ravel().repeat(np.tile((shape.groups, shape.members), len(z)) if shape.groups != shape.members else shape.groups).reshape(z.shape)
        share = np.concatenate((share, share))
        z.reshape(-1)[at] -= share
        up, dout, turned = np.zeros_like(levels), np.zeros((len(order) + 1, d + 1), np.float32), levels.transpose(0, 2, 1).copy()
        turned[:, :, d] = 0
        for i, (lo, hi) in enumerate(zip(cut, cut[1:])):
            if lo < hi:
                np.matmul(out[lo:hi].T, z[lo:hi], out=up[i])
                np.matmul(z[lo:hi], turned[i], out=dout[lo:hi])
        dh = dout[:-1]  # the last row is for what is not asked
        df = dh @ wider(p["w2"]).T
        df *= f > 0
        low, top, deep = h.T @ df, up[:, :, : shape.groups].sum(0), up[:, :, shape.groups :]
        g = {"out": top[:d], "b": top[d], "in": deep[:, :d], "bi": deep[:, d], "w2": f.T @ dh[:, :d], "w1": low[:d], "b1": low[d]}
        dh += df @ wider(p["w1"].T)
        at = np.full(n * s, len(order))
        at[order] = np.arange(len(order))
        dh = dout.take(at, 0)
        per *= dh
        c *= per
        per[:, d] = c @ np.full(d + 1, -1, np.float32)
        back = per.reshape(n, s, d + 1)
        ds = v @ back.transpose(0, 2, 1).copy()
        ds *= a
        dkv = np.empty((n, t, 2 * d), np.float32)
        np.matmul(ds, q, out=dkv[:, :, :d])
        np.matmul(a, back[:, :, :d], out=dkv[:, :, d:])
        dq = (ds.transpose(0, 2, 1) @ k).reshape(-1, d)
        by_place = lambda rows: (np.ones(n, np.float32) @ rows.reshape(n, -1)).reshape(-1, rows.shape[-1])
        dkv_place, dq_place, dh_place = by_place(dkv), by_place(dq), by_place(dh)[:, :d]
        goes_on = np.zeros(n, bool)
        if t == 2 * o:
            goes_on[1:] = (x[1:, :o] == x[:-1, o:]).all(1)
            nexts = np.flatnonzero(goes_on)
            dkv[nexts - 1, o:] += dkv[nexts, :o]
        each = np.concatenate((x[:, o:].ravel(), x[~goes_on, :o].ravel()))
        dkv = np.concatenate((dkv[:, o:].reshape(-1, 2 * d), dkv[~goes_on, :o].reshape(-1, 2 * d)))
        w_kv, e = np.hstack((w_k, w_v)), p["e"].take(each, 0)
        de = dkv @ w_kv.T
        de[: n * s] += dq @ w_q.T
        de[: n * s] += dh[:, :d]
        dkv = e.T @ dkv + place.T @ dkv_place
        dq = (e[: n * s].T @ dq + place[o:].T @ dq_place) * scale
        g["qkv"], g["o"] = np.hstack((dq, dkv[:, :d], dkv[:, d:] @ p["o"].T)), p["qkv"][:, 2 * d :].T @ dkv[:, d:]
        at = np.arange(m * d).reshape(m, d).take(each, 0)
        g["e"] = np.bincount(at.ravel(), de.ravel(), m * d).reshape(m, d).astype(np.float32)
        g["pos"] = np.zeros_like(p["pos"])
        g["pos"][:t] = dkv_place @ w_kv.T
        g["pos"][o:t] += dh_place + dq_place @ w_q.T
        return -float((nats * share).sum(dtype=np.float64)), g


class Scorer:
    """The forward pass alone, with weights and scratch laid out for speed; its mean is the loss of ``Model.gradients``."""

    def __init__(self, model: Model):
        p, self.shape = model.p, model.shape
        d, o = self.shape.width, self.shape.overlap
        q, k, v = (p["qkv"][:, i * d : (i + 1) * d] for i in range(3))
        q, v = q * np.float32(d**-0.5), v @ p["o"]  # the attention's output weights are folded into the values
        # What a position adds up from its class and its place, so that no product is taken of each token; a constant input 1
        # stands for biases and for the sums of attention weights.
        wider = lambda w, last=0.0: np.hstack((w, np.full((len(w), 1), last, np.float32)))
        self.q, self.q_pos, self.own, self.own_pos = p["e"] @ q, (p["pos"] @ q)[o:], wider(p["e"]), wider(p["pos"])[o:]
        self.k, self.k_pos, self.v, self.v_pos = p["e"] @ k, p["pos"] @ k, wider(p["e"] @ v, 1), wider(p["pos"] @ v)
        self.w1, self.w2 = np.vstack((p["w1"], p["b1"])), wider(p["w2"])
        self.levels = model.levels()
        self.group, self.member = (x.astype(np.uint8 if max(self.shape.groups, self.shape.members) <= 256 else np.int32) for x in np.divmod(np.arange(self.shape.classes), self.shape.members))
        self.mask = np.tri(self.shape.window - o, dtype=np.float32).T.copy()
        longest = lambda x: np.sqrt((x**2).sum(1).max())
        self.mild = (longest(self.q) + longest(self.q_pos)) * (longest(self.k) + longest(self.k_pos)) < 80  # no attention weight can overflow

    def log_probability(self, x: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(y | x so far) at the used ones of the positions after the overlap (indices into these, flattened)."""
        shape = self.shape
        d, o = shape.width, shape.overlap
        x = x.astype(np.intp)
        k, v, q, h = self.k.take(x, 0), self.v.take(x, 0), self.q.take(x[:, o:], 0), self.own.take(x[:, o:], 0)
        k += self.k_pos
        v += self.v_pos
        q += self.q_pos
        h += self.own_pos
        a = k @ q.transpose(0, 2, 1).copy()  # by the place seen, then the place that asks
        if not self.mild:
            np.minimum(a, np.float32(60), out=a)
        np.exp(a, out=a)
        a[:, o:] *= self.mask  # what is before is seen by all
        c, h = (a.transpose(0, 2, 1) @ v).reshape(-1, d + 1), h.reshape(-1, d + 1)
        c *= (1 / c[:, d]).repeat(d + 1).reshape(c.shape)
        h += c
        group = self.group.take(y)
        order = np.argsort(group, kind="stable")  # tokens of a group stand together from here on
        cut = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=shape.groups)))).tolist()
        h = h.take(use.take(order), 0)
        f = h @ self.w1
        np.maximum(f, 0, out=f)
        h += f @ self.w2
        z = level_logits(h, cut, self.levels, shape)
        at = np.arange(0, z.size, z.shape[1])
        own = z.reshape(-1).take(at + group.take(order)) + z.reshape(-1).take(at + shape.groups + self.member.take(y.take(order)))
        np.exp(z, out=z)
        out = np.empty(len(order), np.float32)
        out[order] = own - np.log(level_sums(z, shape)).sum(1)
        return out


def level_logits(h: np.ndarray, cut: list[int], levels: np.ndarray, shape: Shape) -> np.ndarray:
    """What stands before both softmaxes, side by side; ``cut`` is where the rows of each group begin."""
    z = np.empty((len(h), levels.shape[2]), np.float32)
    for i, (lo, hi) in enumerate(zip(cut, cut[1:])):
        if lo < hi:
            np.matmul(h[lo:hi], levels[i], out=z[lo:hi])
    if z.size and (z.max() > 80 or z.min() < -80):  # an exponential could overflow, or all of a row vanish
        for part in (z[:, : shape.groups], z[:, shape.groups :]):
            part -= part.max(1, keepdims=True)
    return z


def level_sums(z: np.ndarray, shape: Shape) -> np.ndarray:
    """The sums of each row over groups and over members."""
    return z @ np.repeat(np.eye(2, dtype=np.float32), (shape.groups, shape.members), 0)


def windows(count: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Of texts of ``count`` tokens laid end to end: each window's text, and its first token's place in it (less than 0 before the text)."""
    stride = shape.window - shape.overlap
    n = -(-count // stride)
    text = np.repeat(np.arange(len(count)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * stride - shape.overlap


def cut_windows(cls: np.ndarray, count: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets, the positions to score and their indices in ``cls``, for all windows of some texts."""
    text, first = windows(count, shape)
    t = np.arange(shape.window)
    place = first[:, None] + t
    live = (place >= 0) & (place < count[text][:, None])
    at = np.where(live, (np.cumsum(count) - count)[text][:, None] + place, 0)
    return inputs(cls, count, shape), cls[at], live & (t >= shape.overlap), at


def inputs(cls: np.ndarray, count: np.ndarray, shape: Shape) -> np.ndarray:
    """The classes before each position of all windows; the class after the last one stands for what is before a text."""
    text, first = windows(count, shape)
    lead = shape.overlap + 1
    room = lead + shape.window  # marks before each text, and any classes after it, which no scored position sees
    head = np.cumsum(count) - count
    laid = np.full(len(cls) + room * len(count), shape.classes, cls.dtype)
    laid[np.arange(len(cls)) + np.repeat(room * np.arange(len(count)) + lead, count)] = cls
    start = (head + room * np.arange(len(count)))[text] + first + shape.overlap
    return laid[start[:, None] + np.arange(shape.window)]


def segments(classes: bytes, shape: Shape, kind: np.dtype, most: int) -> Iterator[bytes]:
    """A text's classes in parts of at most ``most`` (a multiple of a window's new tokens), each after the ``overlap`` + 1 classes or marks before it."""
    lead = (shape.overlap + 1) * kind.itemsize
    laid = np.full(shape.overlap + 1, shape.classes, kind).tobytes() + classes
    for lo in range(0, len(classes), most * kind.itemsize):
        yield laid[lo : lo + lead + most * kind.itemsize]


def segment_windows(laid: np.ndarray, lens: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of segments laid end to end: inputs, targets and the positions to score of all windows, and each window's segment.

    The segments of a text have the windows that ``cut_windows`` cuts of the whole text.
    """
    stride, lead = shape.window - shape.overlap, shape.overlap + 1
    n = -(-(lens - lead) // stride)
    own = np.repeat(np.arange(len(lens)), n)
    first = (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * stride
    at = first[:, None] + np.arange(shape.window + 1)
    live = at < lens[own][:, None]
    whole = laid[np.where(live, at, 0) + (np.cumsum(lens) - lens)[own][:, None]]
    return whole[:, :-1], whole[:, 1:], live[:, 1:] & (np.arange(shape.window) >= shape.overlap), own


def score_texts(model: Model | Scorer, cls: np.ndarray, count: np.ndarray, batch: int = 256) -> np.ndarray:
    """log10 P(class | context) of each token; each is scored in exactly one window."""
    return nat_scores(model if isinstance(model, Scorer) else model.scorer(), cls, count, batch) / LN10


def nat_scores(scorer: Scorer, cls: np.ndarray, count: np.ndarray, batch: int = 256) -> np.ndarray:
    """Natural log probabilities; windows in order hold the tokens in order."""
    out = np.zeros(len(cls))
    if not len(cls):
        return out
    shape = scorer.shape
    stride = shape.window - shape.overlap
    x = inputs(cls, count, shape)
    text, first = windows(count, shape)
    live = np.minimum(count[text] - first - shape.overlap, stride)
    ends = np.concatenate(([0], np.cumsum(live)))
    for lo in range(0, len(x), batch):
        hi = min(lo + batch, len(x))
        use = np.flatnonzero((np.arange(stride) < live[lo:hi, None]).ravel())
        a, b = ends[lo], ends[hi]
        out[a:b] = scorer.log_probability(x[lo:hi], cls[a:b], use)
    return out


class Contexts:
    """Codes of the two classes before a token: frequent pairs have codes of their own, others that of the last class."""

    def __init__(self, classes: int, pairs: np.ndarray):
        """``pairs``: second last class * (classes + 1) + last class; the class after the last stands for what is before a text."""
        self.classes, self.pairs = classes, pairs
        self.code = np.tile(np.arange(classes + 1, dtype=np.int32), classes + 1)
        self.code[pairs] = classes + 1 + np.arange(len(pairs))
        self.rows = classes + 1 + len(pairs)

    @classmethod
    def frequent(cls, classes: int, flat: np.ndarray, count: np.ndarray, most: int) -> Contexts:
        """The ``most`` most frequent pairs of some texts; of equally frequent ones the smaller."""
        n = np.bincount(pair_codes(flat, count, classes), minlength=(classes + 1) ** 2)
        order = np.argsort(-n, kind="stable")[:most]
        return cls(classes, order[n[order] > 1])

    def codes(self, flat: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.code[pair_codes(flat, count, self.classes)]

    def cells(self, laid: np.ndarray, lens: np.ndarray, lead: int) -> np.ndarray:
        """Code * classes + class, for each token of segments but the ``lead`` before them."""
        pair = laid[:-2].astype(np.int32) * np.int32(self.classes + 1) + laid[1:-1]
        inner = np.arange(len(laid)) - np.repeat(np.cumsum(lens) - lens, lens) >= lead
        return self.code[pair[inner[2:]]] * np.int32(self.classes) + laid[inner]

    def shares(self, n: np.ndarray, after_class: float = 50.0, after_pair: float = 20.0) -> np.ndarray:
        """P(class | code) from counts (code, class): pairs lean on the last class, and that on all classes."""
        k = self.classes + 1
        row = n[:k].astype(np.float32)
        np.add.at(row, self.pairs % k, n[k:])
        whole = row.sum(0) + np.float32(0.5)
        row = (row + after_class * (whole / whole.sum())) / (row.sum(1, keepdims=True) + after_class)
        pair = n[k:].astype(np.float32)
        pair = (pair + after_pair * row[self.pairs % k]) / (pair.sum(1, keepdims=True) + after_pair)
        return np.concatenate((row, pair)).astype(np.float32)


def pair_codes(flat: np.ndarray, count: np.ndarray, classes: int) -> np.ndarray:
    one, two = befores(flat, count, classes)
    return two * np.int32(classes + 1) + one


def befores(flat: np.ndarray, count: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The last and the second last class before each token of texts laid end to end."""
    heads = (np.cumsum(count) - count)[count > 0]
    one = np.empty(len(flat), np.int32)
    one[1:] = flat[:-1]
    one[heads] = classes
    two = np.empty(len(flat), np.int32)
    two[1:] = one[:-1]
    two[heads] = classes
    return one, two


def train(model: Model, x: np.ndarray, y: np.ndarray, use: np.ndarray, rate: float, batch: int = 32, rounds: int = 1, seed: int = 1, weight: np.ndarray | None = None, run: int = 1) -> float:
    """Adam over the given windows (``weight``: one for each), dealt to batches in runs of ``run``; returns the last mean loss."""
    rng = np.random.default_rng(seed)
    keys, ends = [*model.p], np.cumsum([v.size for v in model.p.values()])
    flat = np.concatenate([v.ravel() for v in model.p.values()])  # all parameters are moved at once
    model.p.update((k, v.reshape(model.p[k].shape)) for k, v in zip(keys, np.split(flat, ends[:-1])))
    m, v, g, move = (np.zeros_like(flat) for _ in range(4))
    step, total, loss = 0, max(1, rounds * -(-len(x) // batch)), 0.0
    for _ in range(rounds):
        order = (rng.permutation(-(-len(x) // run))[:, None] * run + np.arange(run)).ravel()
        order = order[order < len(x)]
        for lo in range(0, len(x), batch):
            s = order[lo : lo + batch]
            one, grads = model.gradients(x[s], y[s], use[s], None if weight is None else weight[s])
            loss = 0.95 * loss + 0.05 * one if step else one
            step += 1
            lr = rate * (1 - 0.9 * step / total)
            np.concatenate([grads[k].ravel() for k in keys], out=g)
            m += np.float32(0.1) * (g - m)
            g *= g
            v += np.float32(0.01) * (g - v)
            np.sqrt(v / np.float32(1 - 0.99**step), out=move)
            move += np.float32(1e-8)
            np.divide(m, move, out=move)
            move *= np.float32(lr / (1 - 0.9**step))
            flat -= move
    return loss
