"""A quality classifier: supervised subword embeddings.

Words and character n-grams of a whole text are hashed to rows of an embedding table, the rows
are averaged, and a softmax layer reads the average; both are learned by stochastic gradient
descent in numpy on a bounded sample of labelled documents. Since all after the table is linear
up to the softmax, a row's contribution to the two logits is known in advance, and scoring
averages one number an n-gram.

Defined results: a null or empty text has the features of an empty text and is scored like any
other; without labels of both classes every score is the labels' share of 1 (0.5 without labels);
repeated rows are scored alike; texts of any length are scored whole; further columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from stillwater.llm import labelled
from stillwater.llm.common import id_type, map_texts, texts_of

BITS = 15
PAD = b"\n\n\n\n"
FAMILIES = 4  # words, pairs of neighbouring words, character 3-grams, character 4-grams


def features(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each family the rows of the table, all texts' end to end, and where each text's begin."""
    raw = [t.encode() for t in texts]
    starts = np.cumsum([0, *(len(r) + len(PAD) for r in raw)])[:-1]
    byte = np.frombuffer(PAD.join([*raw, b""]) + PAD, np.uint8)
    b = byte.astype(np.uint32)
    n = len(b) - len(PAD)
    three = (b[:n] << 16) | (b[1 : n + 1] << 8) | b[2 : n + 2]
    four = (three << 8) | b[3 : n + 3]
    # multiply-shift hashing; each family has a part of the table for itself
    three = ((three * np.uint32(2654435761)) >> np.uint32(32 - BITS)) + np.uint32(2 << BITS)
    four = ((four * np.uint32(2246822519)) >> np.uint32(32 - BITS)) + np.uint32(3 << BITS)
    # grams that would reach into the next text are one and the same gram
    ends = starts + np.array([len(r) for r in raw], np.int64)
    beyond = (ends[:, None] + np.arange(1, len(PAD))).ravel()
    three[beyond], four[beyond] = (3 << BITS) - 1, (4 << BITS) - 1
    solid = byte[:n] > 32
    begin = solid & ~np.r_[False, solid[:-1]]
    first = np.flatnonzero(begin)
    if len(first):
        since = np.arange(n, dtype=np.uint32) - np.repeat(np.r_[0, first].astype(np.uint32), np.diff(np.r_[0, first, n]))
        power = np.cumprod(np.full(64, 2654435769, np.uint32), dtype=np.uint32)
        mixed = np.where(solid, (b[:n] + np.uint32(1)) * power[since & 63], np.uint32(0))
        word = np.add.reduceat(mixed, first, dtype=np.uint32)
        word = (word ^ (word >> np.uint32(15))) * np.uint32(2246822507)
    else:
        word = np.zeros(0, np.uint32)
    # an empty family has one row, so that every text has something of each
    order = np.searchsorted(first, starts)
    empty = np.diff(np.r_[order, len(first)]) == 0
    word = np.insert(word, order[empty], np.uint32(0xFFFFFFFF)) if empty.any() else word
    word_starts = order + np.cumsum(empty) - empty
    # a pair is known by what its words' hashes differ in: a word said twice is one pair, whichever word it is
    pair = np.zeros_like(word)
    pair[1:] = word[1:] ^ word[:-1]
    pair = (pair * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    pair[word_starts] = (1 << BITS) - 1
    word = word >> np.uint32(32 - BITS)
    return [word, pair + np.uint32(1 << BITS), three, four], [word_starts, word_starts, starts, starts]


class Model:
    """Embedding table and softmax layer, kept as each row's difference of logits."""

    def __init__(self, gain: np.ndarray, bias: float):
        self.gain, self.bias = gain.astype(np.float32), bias

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        families, starts = features(texts)
        total = np.full(len(texts), self.bias)
        for rows, at in zip(families, starts, strict=True):
            total += np.add.reduceat(self.gain[rows].astype(np.float64), at) / np.diff(np.r_[at, len(rows)]) / FAMILIES
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train(rows: list[tuple[str, int]], share: list[float], dim: int = 10, epochs: int = 8, batch: int = 32, rate: float = 0.4, seed: int = 5) -> Model:
    """Adaptive stochastic gradient descent on the softmax loss, classes weighted to their shares."""
    size = FAMILIES << BITS
    y = np.array([label for _, label in rows], np.int64)
    if len(set(y.tolist())) < 2:
        p = np.clip(share[1] if sum(share) else 0.5, 1e-3, 1 - 1e-3)
        return Model(np.zeros(size), float(np.log(p / (1 - p))))
    bags = []
    for i in range(0, len(rows), 64):
        families, starts = features([t for t, _ in rows[i : i + 64]])
        for k in range(len(rows[i : i + 64])):
            ids, weight = [], []
            for f, at in zip(families, starts, strict=True):
                own = f[at[k] : at[k + 1] if k + 1 < len(at) else len(f)]
                u, n = np.unique(own, return_counts=True)
                ids.append(u.astype(np.int32))
                weight.append((n / (len(own) * FAMILIES)).astype(np.float32))
            bags.append((np.concatenate(ids), np.concatenate(weight)))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (size, dim)).astype(np.float32)
    seen = np.full(size, 1e-6, np.float32)
    layer, bias = rng.normal(0, 0.3, (dim, 2)), np.zeros(2)
    per = np.array([share[c] / max(1, (y == c).sum()) for c in (0, 1)]) * len(y)
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        step = rate * (1 - epoch / epochs)
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            ids = np.concatenate([bags[k][0] for k in pick])
            weight = np.concatenate([bags[k][1] for k in pick])
            sizes = [len(bags[k][0]) for k in pick]
            at = np.cumsum([0, *sizes[:-1]])
            hidden = np.add.reduceat(table[ids] * weight[:, None], at, axis=0)
            logit = hidden @ layer + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= per[y[pick], None] / len(pick)
            back = p @ layer.T
            layer -= step * (hidden.T @ p + 1e-4 * layer)
            bias -= step * p.sum(0)
            move = weight[:, None] * np.repeat(back, sizes, axis=0)
            u, where = np.unique(ids, return_inverse=True)
            total = np.stack([np.bincount(where, move[:, d], len(u)) for d in range(dim)], 1)
            seen[u] += (total * total).mean(1)
            table[u] -= (step * total / np.sqrt(seen[u])[:, None]).astype(np.float32)
    return Model(table @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", per_class: int = 2500) -> Model:
    return train(*labelled.sample(docs, labels, label, learn, per_class))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (the probability of label 1) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = held.value

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(own.score(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

        return work

    return map_texts(texts_of(docs, id_col, text_col), make, f"doc_id {id_type(docs, id_col)}, score double", 2_000_000)
