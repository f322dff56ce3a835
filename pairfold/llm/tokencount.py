"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton over the vocabulary lists, for each end position of a segment, the pieces that end there, longest
first. Dynamic programming keeps the best score and the number of pieces of each prefix; nothing is traced back. The rules
are those of the ``tokenizers`` library's unigram model with byte fallback: among pieces that reach a position with equal
scores the one that starts first stays; a character that is no piece by itself may be unknown at the lowest score less 10,
and an unknown character counts its UTF-8 bytes. As in its metaspace step, spaces become U+2581, one is put in front
unless the text begins with one, and each begins a segment; so counts of segments add up, and a bounded cache of segments
saves most of the work.

No unigram vocabulary is at hand and tokenizers are never trained, so the pieces of a public vocabulary file get scores
by Zipf's law from their rank; any list of (piece, score) may be given instead.

Defined results: null and empty texts have 0 tokens; repeated rows are counted one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

SPACE = "▁"
PENALTY = 10.0


def zipf_vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file with log probabilities by rank; bytes, controls and the unknown mark rank last."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = [i for i in range(sp.vocab_size()) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)]
    ranked = sorted(set(range(sp.vocab_size())) - set(special), key=lambda i: (-sp.get_score(i), i))
    total = sum(1 / (r + 10) for r in range(len(ranked)))
    scores = {i: -math.log((r + 10) * total) for r, i in enumerate(ranked)}
    least = min(scores.values(), default=0.0)
    return [(sp.id_to_piece(i), scores.get(i, least)) for i in range(sp.vocab_size())]


class Counter:
    """Counts the pieces of texts."""

    def __init__(self, vocabulary: list[tuple[str, float]], cache: int = 1_000_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.ring = max((len(p) for p, _ in vocabulary), default=0) + 2
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - PENALTY
        self.seen: dict[str, int] = {}
        self.cache = cache

    def segment(self, text: str) -> int:
        """The number of pieces of the best path; scores and counts are kept for as many positions as the longest piece spans."""
        n, ring = len(text), self.ring
        best, count = [-math.inf] * ring, [0] * ring
        best[0] = 0.0
        at, single, unknown = 1, False, self.unknown

        def close() -> None:
            """Ends position ``at``, where the character before it may be unknown, and opens the next."""
            nonlocal at, single
            if not single:
                score, here = best[(at - 1) % ring] + unknown, at % ring
                if score > best[here]:
                    best[here], count[here] = score, count[(at - 1) % ring] + len(text[at - 1].encode("utf-8", "replace"))
            at, single = at + 1, False
            best[at % ring] = -math.inf

        for end, (size, score) in self.automaton.iter(text) if len(self.automaton) else ():
            end += 1
            while at < end:
                close()
            total, here = best[(end - size) % ring] + score, end % ring
            if total > best[here]:
                best[here], count[here] = total, count[(end - size) % ring] + 1
            if size == 1:
                single = True
        while at <= n:
            close()
        return count[n % ring]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        parts = text.replace(SPACE, " ").split(" ")
        if not parts[0]:
            parts = parts[1:]
        seen, total = self.seen, 0
        for part in parts:
            k = seen.get(part)
            if k is None:
                k = self.segment(SPACE + part)
                if len(part) <= 64:
                    if len(seen) >= self.cache:
                        seen.clear()
                    seen[part] = k
            total += k
        return total


_kept: dict[str, Counter] = {}


def kept_counter(name: str, vocabulary: list[tuple[str, float]]) -> Counter:
    """One counter in a worker for each call of ``count_tokens``, so that later tasks find its cache filled."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = Counter(vocabulary)
    return _kept[name]


def count_tokens(df: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens for each row of ``df``."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    name = uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # a tokenizer's vocabulary, not corpus data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pairfold.llm.tokencount import kept_counter

        counter = kept_counter(name, shared.value)
        for b in text_slices(batches, 1, 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([counter.text(t.as_py()) for t in b.column(1)], pa.int64())], names=["doc_id", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long")
