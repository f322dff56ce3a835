"""Word shingles of whole texts as 64-bit hashes, made with numpy over a slice of documents at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import WORD_BYTES

PRIME = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(PRIME, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    hashes: np.ndarray  # of each word
    head: np.ndarray  # each document's first word
    count: np.ndarray  # each document's words


#: Bytes hashed at once, so that scratch stays small whatever the texts' lengths (a longer word is hashed whole).
BLOCK = 1 << 18


def word_hashes(texts: list[bytes | None]) -> Words:
    """Hashes of the words (as in decontamination) of some texts."""
    joined = b" ".join([*((t or b"") for t in texts), b""]).translate(WORD_BYTES)
    hashes, starts, at = [], [], 0
    while at < len(joined):
        end = min(at + BLOCK, len(joined))
        if end < len(joined):  # at a space, before or else after
            end = joined.rfind(b" ", at, end) + 1 or joined.find(b" ", end) + 1 or len(joined)
        h, start = _block_hashes(np.frombuffer(joined, np.uint8, end - at, at))
        hashes.append(h)
        starts.append(start + at)
        at = end
    h, start = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (starts, np.int64)))
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    last = np.searchsorted(start, ends)
    head = np.concatenate(([0], last[:-1])).astype(np.int64)
    return Words(h, head, (last - head).astype(np.int64))


def _block_hashes(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of some translated text."""
    inside = by != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(by) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    if len(start) > len(end):
        end = np.append(end, len(by))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((by.astype(np.uint64) + np.uint64(1)) * powers(PRIME, len(by)), dtype=np.uint64)))
    return mixed((sums[end] - sums[start]) * powers(INVERSE, len(by) + 1)[start] + (end - start).astype(np.uint64)), start


def text_keys(w: Words) -> np.ndarray:
    """Two 64-bit hashes of each document's sequence of words; both 0 without words."""
    pos = np.arange(len(w.hashes)) - np.repeat(w.head, w.count)
    out = np.zeros((len(w.count), 2), np.uint64)
    some = w.count > 0
    if some.any():
        for k, base in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
            sums = np.add.reduceat(mixed(w.hashes + np.uint64(k)) * powers(base, int(w.count.max()))[pos], w.head[some])
            out[some, k] = mixed(sums + w.count[some].astype(np.uint64))
    return out


def shingle_counts(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's different shingles in order, how often it has them, and where each document's begin.

    A document of fewer words, but not none, has one shingle of all its words; one without words has none.
    """
    factors = [np.uint64(pow(0xE7037ED1A0B428DB, k + 1, 1 << 64)) for k in range(size)]
    n = len(w.hashes)
    h = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        h[: n - k] += w.hashes[k:] * factors[k]
    h = mixed(h)
    many = np.where(w.count >= size, w.count - size + 1, np.minimum(w.count, 1))
    for d in np.flatnonzero((w.count > 0) & (w.count < size)):
        a = w.head[d]
        h[a] = mixed((w.hashes[a : a + w.count[d]] * np.array(factors[: w.count[d]], np.uint64)).sum(keepdims=True, dtype=np.uint64) + np.uint64(w.count[d]))[0]
    own = np.repeat(w.head - (np.cumsum(many) - many), many) + np.arange(many.sum())
    flat = h[own]
    heads = np.concatenate(([0], np.cumsum(many)))
    for d in range(len(many)):
        flat[heads[d] : heads[d + 1]].sort()
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    first[heads[:-1][many > 0]] = True
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(flat)))
    return flat[at], times, np.searchsorted(at, heads)
