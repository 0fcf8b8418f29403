"""Main text of web pages with a linear-chain conditional random field over their blocks."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import on_workers
from tracklens.llm.html_blocks import blocks_of, describe
from tracklens.llm.labelled_pages import labelled_page

#: Labelled pages that the field is fitted on, and passes over them.
FIT_PAGES, EPOCHS = 700, 8
RATE, DECAY, SEED = 0.3, 2e-4, 5


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class BlockField:
    """A linear chain over two labels (0 other, 1 main)."""

    names: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def scores(self, described: list[set[str]]) -> np.ndarray:
        out = np.zeros((len(described), 2))
        for i, held in enumerate(described):
            at = [self.names[n] for n in held if n in self.names]
            out[i] = self.emit[at].sum(axis=0)
        return out

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label and transition probabilities by the forward and backward passes."""
        n = len(scores)
        forward, backward = np.empty((n, 2)), np.zeros((n, 2))
        forward[0] = self.start + scores[0]
        for i in range(1, n):
            forward[i] = scores[i] + _log_sum(forward[i - 1][:, None] + self.move, 0)
        for i in range(n - 2, -1, -1):
            backward[i] = _log_sum(self.move + (scores[i + 1] + backward[i + 1])[None, :], 1)
        whole = _log_sum(forward[-1], 0)
        pairs = np.exp(forward[:-1, :, None] + self.move + (scores[1:] + backward[1:])[:, None, :] - whole)
        return np.exp(forward + backward - whole), pairs

    def decode(self, scores: np.ndarray) -> list[int]:
        """The likeliest label sequence (Viterbi); ties go to ``other``."""
        if not len(scores):
            return []
        move = self.move.tolist()
        rows = scores.tolist()
        best = [self.start[0] + rows[0][0], self.start[1] + rows[0][1]]
        back = []
        for row in rows[1:]:
            came = [0 if best[0] + move[0][y] >= best[1] + move[1][y] else 1 for y in (0, 1)]
            best = [best[came[y]] + move[came[y]][y] + row[y] for y in (0, 1)]
            back.append(came)
        label = 0 if best[0] >= best[1] else 1
        out = [label]
        for came in reversed(back):
            label = came[label]
            out.append(label)
        return out[::-1]

    @classmethod
    def fit(cls, pages: list[tuple[list[set[str]], list[int]]], epochs: int = EPOCHS) -> "BlockField":
        """Maximises the conditional likelihood by stochastic gradient with per-weight rates."""
        seen: dict[str, int] = {}
        for described, _ in pages:
            for held in described:
                for name in held:
                    seen[name] = seen.get(name, 0) + 1
        names = {n: i for i, n in enumerate(sorted(n for n, c in seen.items() if c >= 3))}
        self = cls(names, np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2))
        coded = [([np.array([names[n] for n in sorted(h) if n in names], dtype=np.int64) for h in d], np.array(y)) for d, y in pages]
        square = [np.full_like(w, 1e-6) for w in (self.emit, self.move, self.start)]
        order = np.random.default_rng(SEED)
        for _ in range(epochs):
            for p in order.permutation(len(coded)):
                at, y = coded[p]
                if not at:
                    continue
                node, pair = self.marginals(np.stack([self.emit[a].sum(axis=0) for a in at]))
                wrong = -node
                wrong[np.arange(len(y)), y] += 1
                emit = np.zeros_like(self.emit)
                for a, g in zip(at, wrong):
                    emit[a] += g
                move = -pair.sum(axis=0)
                np.add.at(move, (y[:-1], y[1:]), 1)
                for w, g, s in zip((self.emit, self.move, self.start), (emit, move, wrong[0]), square):
                    g = g - DECAY * w
                    s += g * g
                    w += RATE * g / np.sqrt(s)
        return self


def _coded(page: tuple[str, list[str]]) -> tuple[list[set[str]], list[int]]:
    html, main = page
    blocks = blocks_of(html)
    rest = [" ".join(t.split()) for t in main]
    labels = []
    for b in blocks:
        # main texts come in page order; the title in the head repeats the heading and is not one
        hit = bool(rest) and b.text == rest[0] and "tag:title" not in b.place.names
        labels.append(int(hit))
        if hit:
            rest.pop(0)
    return describe(blocks), labels


@lru_cache(maxsize=4)
def fit_block_field(pages: int = FIT_PAGES, seed: int = SEED) -> BlockField:
    """The field fitted on ``pages`` labelled pages of :mod:`tracklens.llm.labelled_pages`."""
    rng = random.Random(seed)
    return BlockField.fit([_coded(labelled_page(rng)) for _ in range(pages)])


def main_text(html: str, field: BlockField) -> str:
    blocks = blocks_of(html, field.names.keys())
    labels = field.decode(field.scores(describe(blocks)))
    return "\n".join(b.text for b, y in zip(blocks, labels) if y)


def extract_main_text(pages: DataFrame, html: str = "html", field: BlockField | None = None) -> DataFrame:
    """``pages`` without the raw page but with ``text`` and ``n_chars`` (its code points).

    Blocks are runs of text between block-level tags; the field labels them from their ancestors'
    tags and class or id words and from their text, and the main ones are joined by line feeds. Nothing
    inside a block is dropped; character references are decoded.

    Null and empty pages, and pages without a main block, have the empty text. Columns called
    ``text`` or ``n_chars`` are replaced; an empty table gives an empty result.
    """
    on_workers(pages.sparkSession)
    field = field or fit_block_field()

    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(h, field) if h else "" for h in batch.to_pylist()], pa.string())

    out = pages.withColumn("text", F.arrow_udf("string")(extract)(F.col(html)))
    out = out.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return out if html == "text" else out.drop(html)
