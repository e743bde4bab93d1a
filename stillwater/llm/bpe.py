"""Byte-level BPE, encoded by batched numpy merge rounds and decoded again.

A text is cut into words; the distinct words of a batch lie end to end in one flat array of
symbols. A round looks every neighbouring pair up by binary search over the sorted pair keys,
finds each word's lowest rank, and merges all pairs of that rank in all words at once. Words
without a known pair left leave the array. A merged symbol's own pairs rank after the pair that
made it, so merging all pairs of a word's lowest rank together equals merging them one by one.

A word over ``LONG`` bytes goes through rounds of its own, which look only at the pairs that the last merge changed:
its work grows with its length, not with the length times the ranks. Short words seen before in a
task are kept in a memo of two generations, each of at most ``MEMO`` words and those of one batch. Defined results: a null or empty text has
no ids and decodes to an empty text; special tokens spelled out in a text become their ids;
of pairs of one rank that overlap, the left one is merged; texts and words of any length are encoded whole;
repeated rows are encoded alike; further columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stillwater.llm.common import id_type, map_texts, texts_of

#: The pattern that cuts texts into words before merging, and its form for texts of
#: ASCII and Latin-1 letters alone, where Python's faster matcher has the same classes.
WORD = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
LATIN_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^ \n\t\r0-9{LATIN}]+|[ \n\t\r]+(?![^ \n\t\r])|[ \n\t\r]+")
NOT_LATIN = re.compile(rf"[^\x20-\x7e\n\t\r{LATIN}]")
MEMO = 100_000
LONG = 256


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))})
    return letters


class Vocabulary:
    """Merges as sorted pair keys with ranks and results, and each id's bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)  # by rank
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None


@functools.lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> Vocabulary:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Vocabulary(path)


def ranks_of(left: np.ndarray, right: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The rank of each pair of symbols, by binary search; the number of merges for an unknown pair."""
    key = left << 32 | right
    at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
    return np.where(v.keys[at] == key, v.ranks[at], np.int32(len(v.made)))


def every_second(where: np.ndarray, chained: np.ndarray) -> np.ndarray:
    """Of ascending places, every second one of each run in which ``chained`` links a place to the one before."""
    run = np.flatnonzero(np.r_[True, ~chained])
    nth = np.arange(len(where)) - np.repeat(run, np.diff(np.r_[run, len(where)]))
    return where[nth % 2 == 0]


def merge_long(word: bytes, v: Vocabulary) -> bytes:
    """The ids of one word: all pairs of the lowest rank a round, then new ranks for the pairs that they changed."""
    n, none = len(word), len(v.made)
    sym = v.byte_id[np.frombuffer(word, np.uint8)]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.full(n, none, np.int32)
    rank[:-1] = ranks_of(sym[:-1], sym[1:], v)
    places: dict[int, list[int]] = {}
    for i, r in enumerate(rank.tolist()):
        if r < none:
            places.setdefault(r, []).append(i)
    queue = list(places)
    heapq.heapify(queue)
    while queue:
        r = heapq.heappop(queue)
        at = np.unique(np.array(places.pop(r), np.int64))
        at = at[rank[at] == r]
        if not len(at):
            continue
        at = every_second(at, at[1:] == after[at[:-1]])
        gone = after[at]
        sym[at] = v.made[r]
        rank[gone] = none
        after[at] = after[gone]
        before[after[at][after[at] < n]] = at[after[at] < n]
        changed = np.unique(np.concatenate([at, before[at]]))
        changed = changed[changed >= 0]
        follows = after[changed]
        rank[changed] = np.where(follows < n, ranks_of(sym[changed], sym[np.minimum(follows, n - 1)], v), none)
        for i, q in zip(changed.tolist(), rank[changed].tolist(), strict=True):
            if q < none:
                if q not in places:
                    places[q] = []
                    heapq.heappush(queue, q)
                places[q].append(i)
    kept, i = [], 0
    follow = after.tolist()
    while i < n:
        kept.append(i)
        i = follow[i]
    return sym[kept].astype("<u4").tobytes()


def merge_words(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers."""
    if not words:
        return []
    none = np.int32(len(v.made))
    sym = v.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    done_sym, done_word = [], []
    while len(sym):
        rank = np.full(len(sym), none, np.int32)
        rank[:-1] = np.where(word[:-1] == word[1:], ranks_of(sym[:-1], sym[1:], v), none)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lengths = np.diff(np.r_[starts, len(word)])
        least = np.minimum.reduceat(rank, starts)
        over = least == none
        if over.any():
            out = np.repeat(over, lengths)
            done_sym.append(sym[out])
            done_word.append(word[out])
            sym, word, rank = sym[~out], word[~out], rank[~out]
            least, lengths = least[~over], lengths[~over]
        if not len(sym):
            break
        hit = rank == np.repeat(least, lengths)
        where = np.flatnonzero(hit)
        # pairs of one rank overlap only in runs of a single symbol: every second one is merged
        where = every_second(where, np.diff(where) == 1)
        sym[where] = v.made[rank[where]]
        keep = np.ones(len(sym), bool)
        keep[where + 1] = False
        sym, word = sym[keep], word[keep]
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    flat = sym[order].astype("<u4").tobytes()
    ends = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def cut_words(text: str) -> list[str]:
    return (WORD if NOT_LATIN.search(text) else LATIN_WORD).findall(text)


class Encoder:
    """Encodes and decodes batches of texts, with a bounded memo of words."""

    def __init__(self, path: str | None = None):
        self.v = vocabulary(path)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.special = {w: np.array([i], "<u4").tobytes() for w, i in self.v.special.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        special = self.special
        cut: list[list[str]] = []
        for text in texts:
            if self.v.splitter and any(w in text for w in special):
                cut.append([w for part in self.v.splitter.split(text) for w in ([part] if part in special else cut_words(part))])
            else:
                cut.append(cut_words(text))
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        memo.update(special)
        new, long = [], {}
        for w in {w for words in cut for w in words}:
            if w in memo:
                continue
            if w in older:
                memo[w] = older[w]
            elif len(raw := w.encode("utf-8", "replace")) > LONG:
                long[w] = merge_long(raw, self.v)
            else:
                new.append((w, raw))
        memo.update(zip((w for w, _ in new), merge_words([raw for _, raw in new], self.v), strict=True))
        if long:
            return [b"".join([long.get(w) or memo[w] for w in words]) for words in cut]
        return [b"".join([memo[w] for w in words]) for words in cut]

    def decode(self, ids: bytes) -> str:
        of = self.v.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every whole text."""

    def make():
        encoder = Encoder(path)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoder.encode(part.column(1).to_pylist())
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            return pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), pa.array([encoder.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

        return work

    return map_texts(texts_of(docs, id_col, text_col), make, f"doc_id {id_type(docs, id_col)}, ids array<int>, decoded string", 1_000_000)


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as ``encoded``, digested where it was made; and the ids, if wanted."""

    def make():
        encoder = Encoder(path)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoder.encode(part.column(1).to_pylist())
            offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32())
            flat = [pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))] if with_ids else []
            return pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                    *flat,
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids],
            )

        return work

    return map_texts(texts_of(docs, id_col, text_col), make, f"doc_id {id_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, 1_000_000)
