"""Quality: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of ``PASSAGE`` tokens. Each passage is described by rates over its tokens (letters, capitals,
signs, shapes, repeats) and encoded by a learned layer; a gated attention, learned from the labels of whole documents
only, weighs the passages, and the weighted sum of their encodings is scored. Texts of any length are read piece by
piece: the softmax over passages is kept as a running maximum and running sums, so nothing but the pieces is held.
"""

from __future__ import annotations

import dataclasses
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.common import labelled_sample, map_columns, ship

#: Tokens of a passage; characters read at a time; tokens described at a time.
PASSAGE, PIECE, TOKENS = 80, 1_000_000, 100_000
SPACE = re.compile(r"\s")
RUN = re.compile(r"(\W)\1")
#: Buckets for the shape of a token (its letters, digits and signs, runs reduced to one).
SHAPES = 32
STATS = 12
WIDTH = STATS + SHAPES + 5


def _shape(token: str) -> str:
    out = []
    for c in token[:64]:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def _describe(token: str) -> np.ndarray:
    """What one token adds to its passage."""
    row = np.zeros(STATS + SHAPES, np.float32)
    size = len(token)
    letters = sum(map(str.isalpha, token))
    upper, digits = sum(map(str.isupper, token)), sum(map(str.isdigit, token))
    signs = size - letters - digits
    row[:STATS] = [size, letters, upper, digits, signs, letters > 1 and upper == letters, size == signs, bool(RUN.search(token)), letters <= 3, letters > 12, min(signs, 1), token[-1] in ".,;:!?"]
    row[STATS + zlib.crc32(_shape(token).encode()) % SHAPES] = 1
    return row


class Passages:
    """Feature rows of passages. What a token adds is worked out once and kept in a table bounded in entries and characters."""

    def __init__(self, entries: int = 150_000, chars: int = 4_000_000):
        self.entries, self.chars = entries, chars
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, STATS + SHAPES), np.float32)
        self.held = 0

    def number(self, token: str) -> int:
        found = len(self.known)
        if found == len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[found] = _describe(token)
        self.known[token] = found
        self.held += len(token)
        return found

    def rows(self, bags: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Features of the passages of each list of tokens, one after the other, and the list each passage is of.

        A list without tokens has one passage of zeros.
        """
        if len(self.known) > self.entries or self.held > self.chars:
            self.clear()
        get, add = self.known.get, self.number
        sizes = np.array([len(bag) for bag in bags])
        counts = np.maximum(1, -(-sizes // PASSAGE))
        bag_of = np.repeat(np.arange(len(bags)), counts)
        made = np.zeros((len(bag_of), WIDTH), np.float64)
        tokens = np.array([n if (n := get(t)) is not None else add(t) for bag in bags for t in bag], np.int64)
        if not len(tokens):
            return made, bag_of
        first = np.cumsum(counts) - counts
        inside = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        passage = np.repeat(first, sizes) + inside // PASSAGE
        starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        at = passage[starts]
        length = np.diff(np.r_[starts, len(tokens)]).astype(np.float64)
        sums = np.add.reduceat(self.table[tokens], starts, axis=0, dtype=np.float64)
        size = sums[:, 0]
        made[at, 0] = np.log1p(size / length)
        made[at, 1:5] = sums[:, 1:5] / size[:, None]
        made[at, 5 : STATS + SHAPES] = sums[:, 5:] / length[:, None]
        extra = made[:, STATS + SHAPES :]
        extra[at, 0] = np.log1p(length)
        extra[at, 1] = self._distinct(passage, tokens)[at] / length
        same = passage[1:] == passage[:-1]
        pairs = np.maximum(length - 1, 1)
        extra[at, 2] = np.where(length > 1, self._distinct(passage[1:][same], tokens[1:][same] * (len(self.known) + 1) + tokens[:-1][same], len(made))[at] / pairs, 1)
        extra[at, 3] = np.bincount(passage[1:][same], tokens[1:][same] == tokens[:-1][same], len(made))[at] / pairs
        extra[at, 4] = 1
        return made, bag_of

    @staticmethod
    def _distinct(passage: np.ndarray, value: np.ndarray, most: int = 0) -> np.ndarray:
        """Distinct values of each passage."""
        order = np.lexsort((value, passage))
        p, v = passage[order], value[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1])
        return np.bincount(p, new, max(most, int(passage.max()) + 1 if len(passage) else 0))


def pieces(text: str | None) -> Iterator[list[str]]:
    """Tokens of a whole text in lists that end where a passage ends; at least one list, if only an empty one.

    A text is cut at white space only: a token of any length is whole.
    """
    text, at, left, given = text or "", 0, [], False
    while len(text) - at > PIECE:
        cut = SPACE.search(text, at + PIECE)
        if not cut:
            break
        left += text[at : cut.start()].split()
        at = cut.end()
        whole = len(left) // PASSAGE * PASSAGE
        if whole:
            yield left[:whole]
            left, given = left[whole:], True
    left += text[at:].split()
    if left or not given:
        yield left


@dataclasses.dataclass
class Attention:
    """Encoder, gated attention and score; ``mean`` and ``scale`` bring features to one size."""

    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    tan: np.ndarray
    gate: np.ndarray
    weigh: np.ndarray
    judge: np.ndarray
    flat: float | None = None  # a constant probability, where labels did not allow to learn

    def encoded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings (with a constant one) and attention logits of passages."""
        x = np.clip((rows - self.mean) / self.scale, -6, 6)
        h = np.c_[np.tanh(np.c_[x, np.ones(len(x))] @ self.encode), np.ones(len(x))]
        return h, (np.tanh(h @ self.tan) * _sigmoid(h @ self.gate)) @ self.weigh


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: np.ndarray, bag: np.ndarray, label: np.ndarray, hidden: int = 16, attend: int = 8, epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 1) -> Attention:
    """Adam on the logistic loss of bags in small batches. No label, or one kind only: a constant score."""
    draw = np.random.default_rng(seed)
    mean, scale = (rows.mean(axis=0), rows.std(axis=0) + 1e-3) if len(rows) else (np.zeros(WIDTH), np.ones(WIDTH))
    shapes = [(WIDTH + 1, hidden), (hidden + 1, attend), (hidden + 1, attend), (attend,), (hidden + 1,)]
    theta = [draw.normal(0, 1 / np.sqrt(shape[0]), shape) for shape in shapes]
    model = Attention(mean, scale, *theta)
    if not len(label) or label.min() == label.max():
        model.flat = float((label.sum() + 0.5) / (len(label) + 1))
        return model
    x = np.c_[np.clip((rows - mean) / scale, -6, 6), np.ones(len(rows))]
    starts = np.searchsorted(bag, np.arange(len(label) + 1))
    first, second, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for epoch in range(epochs):
        order = draw.permutation(len(label))
        pace = rate * (1 - epoch / epochs) + 1e-4
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            take = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in chosen])
            sizes = starts[chosen + 1] - starts[chosen]
            grads = _gradients(theta, x[take], np.repeat(np.arange(len(chosen)), sizes), np.cumsum(sizes) - sizes, label[chosen])
            step += 1
            for i, grad in enumerate(grads):
                grad = grad + decay * theta[i]
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                theta[i] -= pace * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Attention(mean, scale, *theta)


def _gradients(theta: list[np.ndarray], x: np.ndarray, bag: np.ndarray, starts: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean logistic loss over one batch of bags (passages of a bag stand together)."""
    encode, tan, gate, weigh, judge = theta
    raw = np.tanh(x @ encode)
    h = np.c_[raw, np.ones(len(x))]
    t, g = np.tanh(h @ tan), _sigmoid(h @ gate)
    logit = (t * g) @ weigh
    power = np.exp(logit - np.maximum.reduceat(logit, starts)[bag])
    weight = power / np.add.reduceat(power, starts)[bag]
    pooled = np.add.reduceat(weight[:, None] * h, starts, axis=0)
    error = (_sigmoid(pooled @ judge) - label) / len(label)
    d_pooled = error[:, None] * judge
    d_weight = (d_pooled[bag] * h).sum(axis=1)
    d_logit = weight * (d_weight - np.add.reduceat(weight * d_weight, starts)[bag])
    d_tg = d_logit[:, None] * weigh
    d_t, d_g = d_tg * g * (1 - t**2), d_tg * t * g * (1 - g)
    d_h = weight[:, None] * d_pooled[bag] + d_t @ tan.T + d_g @ gate.T
    return [x.T @ (d_h[:, :-1] * (1 - raw**2)), h.T @ d_t, h.T @ d_g, (t * g).T @ d_logit, pooled.T @ error]


def score_bags(model: Attention, read: Passages, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 of each whole text."""
    if model.flat is not None:
        return np.full(len(texts), model.flat)
    top, total, pooled = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros((len(texts), len(model.judge)))

    def add(group: list[tuple[int, list[str]]]) -> None:
        rows, bag = read.rows([tokens for _, tokens in group])
        owner = np.array([n for n, _ in group])[bag]
        h, logit = model.encoded(rows)
        high = top.copy()
        np.maximum.at(high, owner, logit)
        shrink = np.where(np.isfinite(top), np.exp(top - np.where(np.isfinite(high), high, 0)), 0)
        np.multiply(total, shrink, out=total)
        np.multiply(pooled, shrink[:, None], out=pooled)
        power = np.exp(logit - high[owner])
        np.add.at(total, owner, power)
        np.add.at(pooled, owner, power[:, None] * h)
        top[:] = high

    group, size = [], 0
    for number, text in enumerate(texts):
        for tokens in pieces(text):
            group.append((number, tokens))
            size += len(tokens)
            if size >= TOKENS:
                add(group)
                group, size = [], 0
    if group:
        add(group)
    return _sigmoid((pooled / total[:, None]) @ model.judge)


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = 12_000, sample: int = 3000, most_chars: int = 8_000, label: str = "quality", epochs: int = 60) -> Attention:
    """Learn from the labelled documents that ``usable`` (a condition on the document id) allows.

    At most ``rows`` labelled documents are looked at and at most ``sample`` distinct texts of up to ``most_chars`` characters
    learned from (``labelled_sample``). No labelled document: every score is one half.
    """
    _, chosen = labelled_sample(docs, labels, usable, label, rows, sample, most_chars)
    read, found, bags = Passages(), [np.zeros((0, WIDTH))], [np.zeros(0, int)]
    for first in range(0, len(chosen), 64):  # the table of tokens is bounded between calls only
        part, bag = read.rows([text.split() for text, _, _ in chosen[first : first + 64]])
        found.append(part)
        bags.append(bag + first)
    return fit(np.concatenate(found), np.concatenate(bags), np.array([y for _, y, _ in chosen], float), epochs=epochs)


def score_texts(docs: DataFrame, model: Attention, keys: dict[str, str], text: str = "text", least: float = 0.3) -> DataFrame:
    """score (0 to 1, higher: label 1 likelier) and predicted (score at least ``least``) of every whole text, beside the keys.

    NULL and empty texts, and texts of white space, are one passage without tokens and all get the same score. Repeated rows
    get equal scores; other columns are not read.
    """
    shipped = ship(docs.sparkSession, model)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in keys.items()) + ", score double, predicted int"

    def make():
        own, read = shipped(), Passages()

        def step(*columns):
            # rounded, so that the order in which numpy adds up a batch cannot show
            p = np.round(score_bags(own, read, columns[-1]), 9)
            return [*columns[:-1], p.tolist(), (p >= least).astype(int).tolist()]

        return step

    return map_columns(docs, [*[F.col(f"`{name}`").cast(kind) for name, kind in keys.items()], F.col(text)], schema, make)
