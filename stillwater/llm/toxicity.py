"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel counts common subsequences of ``K`` letters within ``SPAN`` positions, each skipped
position costing a factor ``DECAY``: an insult with a letter put in, or spaced out, still shares most of
its subsequences. Landmarks are short strings over-represented in labelled toxic sentences, and common
ones beside them; the Nystroem map K_mm^(-1/2) k_m(x) feeds a linear support vector machine
trained on sentence windows. Only documents carry labels, so a toxic document's most toxic
window stands for it, chosen anew in each round, against the strongest windows of clean ones.

The decision is linear in k_m(x), and k_m(x) in x's subsequences, so that scoring looks each
subsequence of a text up in one table of 2^20 weights and takes the largest sum over the windows of the whole text;
a logistic fit on documents turns it into a probability.

Characters beyond Latin-1 have symbols as well (``Spelling``): no letter of any script is lost.

Defined results: a null or empty text has no subsequence and is scored like one without any
known subsequence; without labels of both classes every score is the labels' share of 1 (0.5
without labels); repeated rows are scored alike; texts of any length are scored whole, and of equally strong windows the
first counts; further columns are kept by ``clean`` and never read; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from stillwater.llm import labelled
from stillwater.llm.common import filter_texts, id_type, map_texts, texts_of

K, SPAN, DECAY, WINDOW = 4, 7, 0.7, 8
COMMON = 24
BLOCK = 1 << 15
PAD = WINDOW + SPAN
#: Offsets of the subsequences that start at a position, with their weights.
PATTERNS = [(p, DECAY ** (p[-1] - K + 1)) for p in itertools.combinations(range(1, SPAN), K - 1)]
#: Digits and signs that stand in for letters.
STANDS_FOR = dict(zip("013457@$", "oieastas", strict=True))


def symbols() -> np.ndarray:
    """Each Latin-1 character's symbol: 0 white space and signs, 1 to 26 letters, 27 to 31 accented letters by base."""
    table = np.zeros(256, np.uint8)
    for i in range(256):
        c = STANDS_FOR.get(chr(i), chr(i).lower())
        if "a" <= c <= "z":
            table[i] = ord(c) - 96
        elif c.isalpha():
            base = unicodedata.normalize("NFD", c)[0]
            table[i] = 27 + "aeiou".find(base) if base in "aeiou" else 31 if base == "n" else 3 if base == "c" else 19
    return table


SYMBOLS = symbols()


class Spelling(dict):
    """For ``str.translate``: a Latin-1 character with the symbol of any other one, made when first met.

    A letter with a Latin base, also full-width or with marks, has the symbol of its base; letters of other
    scripts are dealt out over all symbols, alike in upper and lower case; marks and invisible characters go; others are blanks.
    """

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        if code < 256:
            made: str | None = c
        elif unicodedata.category(c) in {"Mn", "Me", "Cf"}:
            made = None
        elif not c.isalnum():
            made = " "
        else:
            base = unicodedata.normalize("NFKD", c.casefold())[:1]
            made = base if base and ord(base) < 256 else DEALT[ord(base or c) * 2654435761 % 2**32 % 31]
        self[code] = made
        return made


#: A character of each symbol but the blank.
DEALT = "abcdefghijklmnopqrstuvwxyzáéíóñ"
SPELLING = Spelling()


def latin(text: str) -> bytes:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return text.translate(SPELLING).encode("latin-1", "replace")


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, a blank before and ``PAD`` blanks after each, and where each text begins."""
    raw = [b" " + latin(t) for t in texts]
    starts = np.cumsum([0, *(len(r) + PAD for r in raw)])[:-1]
    joined = (b"\0" * PAD).join([*raw, b""])
    return SYMBOLS[np.frombuffer(joined, np.uint8)], starts


def subsequences(s: np.ndarray):
    """For each pattern the code of the subsequence at each position, and the weight. Codes with a blank after the first place weigh nothing."""
    s = np.concatenate([s, np.zeros(SPAN, np.uint8)]).astype(np.int32)
    n = len(s) - SPAN
    shifted = [s[i : n + i] for i in range(SPAN)]
    first = shifted[0] << 15
    for (a, b, c), weight in PATTERNS:
        yield first | (shifted[a] << 10) | (shifted[b] << 5) | shifted[c], weight


def contributions(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What the subsequences that start at each position add, in blocks that stay in the processor's cache."""
    s = np.concatenate([s, np.zeros(SPAN, np.uint8)]).astype(np.int32)
    out = np.empty(len(s) - SPAN, np.float32)
    by_weight: dict[float, list[tuple[int, ...]]] = {}
    for pattern, weight in PATTERNS:
        by_weight.setdefault(weight, []).append(pattern)
    code, got = np.empty(BLOCK, np.int32), np.empty(BLOCK, np.float32)
    for start in range(0, len(out), BLOCK):
        n = min(BLOCK, len(out) - start)
        part = s[start : start + n + SPAN]
        first = part[:n] << 15
        second = [first | (part[i : n + i] << 10) for i in range(SPAN)]
        third = [part[i : n + i] << 5 for i in range(SPAN)]
        total = np.zeros(n, np.float32)
        for weight, patterns in by_weight.items():
            same = np.zeros(n, np.float32)
            for a, b, c in patterns:
                np.bitwise_or(second[a], third[b], out=code[:n])
                np.bitwise_or(code[:n], part[c : n + c], out=code[:n])
                np.take(table, code[:n], out=got[:n], mode="clip")
                same += got[:n]
            total += np.float32(weight) * same
        out[start : start + n] = total
    return out


def window_sums(each: np.ndarray) -> np.ndarray:
    """Sums over ``WINDOW`` positions from each on, added in the same order wherever a text stands."""
    x = np.concatenate([each, np.zeros(WINDOW, each.dtype)])
    step = 1
    while step < WINDOW:
        x = x[:-step] + x[step:]
        step *= 2
    return x[: len(each)]


def strengths(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The largest window sum of each text and where it lies; the symbols and where texts begin."""
    s, starts = folded(texts)
    each = contributions(s, table)
    sums = window_sums(each)
    top = np.maximum.reduceat(sums, starts)
    at = np.flatnonzero(sums == np.repeat(top, np.diff(np.r_[starts, len(s)])))
    return top, at[np.searchsorted(at, starts)], s, starts


class Model:
    def __init__(self, table: np.ndarray, slope: float, bias: float):
        self.table, self.slope, self.bias = table.astype(np.float32), slope, bias

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * strengths(texts, self.table)[0] + self.bias, -40, 40)))


def grams(texts: list[str], n: int) -> list[np.ndarray]:
    """The distinct n-symbol strings of each text, as numbers; a blank may stand at the start alone."""
    s, starts = folded(texts)
    s = s.astype(np.int64)
    code = np.zeros(len(s), np.int64)
    whole = np.ones(len(s), bool)
    for i in range(n):
        shifted = np.concatenate([s[i:], np.zeros(i, np.int64)])
        code = code << 5 | shifted
        whole &= (shifted > 0) | (i == 0)
    ends = np.r_[starts[1:], len(s)]
    return [np.unique(code[a:b][whole[a:b]]) for a, b in zip(starts, ends, strict=True)]


def unpack(code: int, n: int) -> list[int]:
    return [code >> 5 * i & 31 for i in reversed(range(n))]


def landmarks(rows: list[tuple[str, int]], toxic: int = 120, common: int = COMMON, n: int = 6) -> list[list[int]]:
    """Strings of ``n`` symbols: those that toxic documents have most beyond their share, and the commonest.

    Chosen one by one; a toxic document that holds one already counts half as much for the next, so
    that rarer insults, and those of other languages, get landmarks too.
    """
    y = np.array([label for _, label in rows])
    every = [g for i in range(0, len(rows), 64) for g in grams([t for t, _ in rows[i : i + 64]], n)]
    pos = np.concatenate([g for g, label in zip(every, y, strict=True) if label == 1])
    neg = np.concatenate([g for g, label in zip(every, y, strict=True) if label == 0])
    owner = np.repeat(np.arange((y == 1).sum()), [len(g) for g, label in zip(every, y, strict=True) if label == 1])
    code, where = np.unique(np.concatenate([pos, neg]), return_inverse=True)
    of_pos = np.bincount(where[: len(pos)], minlength=len(code)) / (y == 1).sum()
    of_neg = np.bincount(where[len(pos) :], minlength=len(code)) / (y == 0).sum()
    z = (of_pos - of_neg) / np.sqrt((of_pos + of_neg + 1e-3) / 2 / min((y == 1).sum(), (y == 0).sum()))
    pool = np.argsort(-z, kind="stable")[:3000]
    place = np.full(len(code), -1)
    place[pool] = np.arange(len(pool))
    inside = place[where[: len(pos)]]
    inside, owner = inside[inside >= 0], owner[inside >= 0]
    order = np.argsort(inside, kind="stable")
    held = np.split(owner[order], np.searchsorted(inside[order], np.arange(1, len(pool))))
    need = np.ones((y == 1).sum())
    best: list[int] = []
    for _ in range(min(toxic, len(pool))):
        gain = np.bincount(inside, need[owner], len(pool)) / len(need)
        gain = (gain - of_neg[pool]) / np.sqrt(gain + of_neg[pool] + 1e-3)
        gain[best] = -np.inf
        best.append(int(np.argmax(gain)))
        need[held[best[-1]]] *= 0.5
    usual = code[np.argsort(-of_neg, kind="stable")[:common]]
    return [unpack(int(c), n) for c in dict.fromkeys([*code[pool[best]].tolist(), *usual.tolist()])]


def profile(s: np.ndarray) -> dict[int, float]:
    """Weights of the subsequences of a short string; a blank may come first, as the start of a word."""
    total: dict[int, float] = {}
    for code, weight in subsequences(s):
        for c in code.tolist():
            if c >> 10 & 31 and c >> 5 & 31 and c & 31:
                total[c] = total.get(c, 0) + weight
    return total


def train(rows: list[tuple[str, int]], share: list[float], rounds: int = 4, seed: int = 3) -> Model:
    y = np.array([label for _, label in rows], np.int64)
    if len(set(y.tolist())) < 2:
        p = np.clip(share[1] if sum(share) else 0.5, 1e-3, 1 - 1e-3)
        return Model(np.zeros(1 << 20), 0.0, float(np.log(p / (1 - p))))
    marks = landmarks(rows)
    profiles = [profile(np.array(m, np.uint8)) for m in marks]
    known = np.array(sorted({c for p in profiles for c in p}), np.int64)
    z = np.zeros((len(known), len(marks)))
    for j, p in enumerate(profiles):
        z[np.searchsorted(known, list(p)), j] = list(p.values())
    z /= np.linalg.norm(z, axis=0)
    value, vector = np.linalg.eigh(z.T @ z)
    good = value > 1e-6
    root = vector[:, good] / np.sqrt(value[good])  # the Nystroem map of k_m(x) is root.T @ k_m(x)
    index = np.full(1 << 20, -1, np.int64)
    index[known] = np.arange(len(known))
    texts = [t for t, _ in rows]

    def mapped(windows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(windows), len(known)))
        for i, s in enumerate(windows):
            for code, weight in subsequences(s):
                at = index[code[:WINDOW]]
                np.add.at(out[i], at[at >= 0], weight)
        return out @ z @ root

    def disguised(windows: np.ndarray) -> np.ndarray:
        """Copies of windows with a symbol put in, one symbol doubled, or blanks between the symbols."""
        rng = np.random.default_rng(seed)
        out = [np.zeros_like(windows) for _ in range(2)]
        for i, s in enumerate(windows):
            at = int(rng.integers(2, WINDOW))
            out[0][i] = np.r_[s[:at], rng.choice([0, int(s[at]), int(rng.integers(1, 27))]), s[at:-1]]
            spaced = np.zeros(2 * len(s), s.dtype)
            spaced[::2] = s
            out[1][i] = spaced[: len(s)] if i % 4 == 0 else out[0][i]
        return np.concatenate(out)

    def tops(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top, windows = [], []
        for i in range(0, len(texts), 64):
            best, at, s, _ = strengths(texts[i : i + 64], table)
            s = np.concatenate([s, np.zeros(PAD, np.uint8)])
            top.append(best)
            windows.append(s[at[:, None] + np.arange(PAD)])
        return np.concatenate(top), np.concatenate(windows)

    def machine(x: np.ndarray, label: np.ndarray, decay: float = 2e-4, epochs: int = 30) -> tuple[np.ndarray, float]:
        """A linear support vector machine by averaged stochastic subgradients, classes weighted alike."""
        rng = np.random.default_rng(seed)
        sign = np.where(label == 1, 1.0, -1.0)
        weight = len(label) / 2 / np.where(label == 1, max(1, (label == 1).sum()), max(1, (label == 0).sum()))
        x = np.c_[x, np.ones(len(x))]
        w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
        for epoch in range(epochs):
            for pick in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
                t += 1
                inside = sign[pick] * (x[pick] @ w) < 1
                step = 1 / (decay * (t + 200)) / 50
                w -= step * (decay * np.r_[w[:-1], 0] - (x[pick] * (sign[pick] * weight[pick] * inside)[:, None]).mean(0))
                if epoch >= epochs // 2:
                    mean += w
        return mean[:-1] / max(1, np.linalg.norm(mean[:-1])), float(mean[-1])

    def table_of(w: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << 20)
        table[known] = z @ (root @ w)
        return table

    toxic = np.arange(len(marks)) < len(marks) - COMMON
    start = np.zeros(1 << 20)
    start[known] = z @ toxic.astype(float) / toxic.sum()
    table, tried_x, tried_y = start.astype(np.float32), [], []
    for _ in range(rounds):
        top, windows = tops(table)
        x = mapped(windows)
        tried_x.append(x[y == 0])  # strong windows of clean documents stay in
        tried_y.append(np.zeros((y == 0).sum()))
        toxic_x = np.concatenate([x[y == 1], mapped(disguised(windows[y == 1]))])
        w, _ = machine(np.concatenate([toxic_x, *tried_x]), np.concatenate([np.ones(len(toxic_x)), *tried_y]))
        table = table_of(w).astype(np.float32)
    top, _ = tops(table)
    scale = np.abs(top).max() or 1.0
    slope, bias = logistic(top / scale, y, share)
    return Model(table, slope / scale, bias)


def logistic(x: np.ndarray, y: np.ndarray, share: list[float], steps: int = 60) -> tuple[float, float]:
    """Slope and bias by Newton's method with a little decay, classes weighted to their shares."""
    weight = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum()))
    design, w = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        ridge = np.diag([1e-4, 1e-6])
        w -= np.linalg.solve((design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + ridge, design.T @ (weight * (p - y)) + ridge @ w)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_class: int = 1500) -> Model:
    return train(*labelled.sample(docs, labels, label, learn, per_class))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (the probability of label 1) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = held.value

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(own.score(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

        return work

    return map_texts(texts_of(docs, id_col, text_col), make, f"doc_id {id_type(docs, id_col)}, score double", 1_000_000)


def clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = held.value
        return lambda texts: (own.score(texts) < threshold).tolist()

    return filter_texts(docs, make, text_col)
