"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

Documents are dealt by identifier to shards of bounded size. In a shard the suffixes are sorted by
Larsson-Sadakane refinement (sort by eight bytes, then double the depth, re-sorting only groups still
tied), neighbours' common prefixes come from Kasai's recurrence, and runs of neighbours with
``LENGTH`` bytes in common are the shard's repeats: all but the earliest start are covered.

Across shards, every string of ``LENGTH`` bytes has an anchor: its least-hashed part of ``GRAM``
bytes. Equal strings have equal anchors, so only strings whose anchor occurs twice need sorting at all
(the filter loses nothing), and earliest starts of different shards meet by anchor. There the runs of
strings around an anchor are merged: equal runs at once, others string by string, the sorted strings of one shard
found by binary search among those of another until all shards are one list. What a shard sends of a hot passage is its earliest copy alone.

Defined results: a null text is an empty text; a text shorter than ``LENGTH`` bytes is kept whole;
a null identifier comes before all others; rows that repeat an identifier are separate
documents in the order of their texts; a text of any length is one document of one shard (below 2^28 bytes: positions have 28 bits);
further columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm.common import texts_of

LENGTH, GRAM = 100, 16
DEPTH = 128
SHARD = 4_000_000
BUCKET = 3_000_000
NO_ID = -(2**63)

U = np.uint64
_table = np.random.default_rng(20240307).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def eights(byte: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each position on as one number (zeros past the end), without copying."""
    padded = np.concatenate([byte, np.zeros(16, np.uint8)])
    return np.ndarray((len(byte) + 8,), kind, padded, strides=(1,))


def gram_hashes(byte: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each position on (fewer at the end), in blocks that stay in the processor's cache."""
    e, n = eights(byte), len(byte)
    out = np.empty(n, U)
    for a in range(0, n, 1 << 15):
        b = min(n, a + (1 << 15))
        x, y = e[a:b] * U(0x9E3779B97F4A7C15), e[a + 8 : b + 8] * U(0xC2B2AE3D27D4EB4F)
        x ^= x >> U(32)
        y ^= y >> U(29)
        x *= U(0xBF58476D1CE4E5B9)
        x += y * U(0x94D049BB133111EB)
        x ^= x >> U(31)
        x *= U(0xD6E8FEB86659FD93)
        out[a:b] = x ^ (x >> U(32))
    return out


def anchors(byte: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of all strings of ``length`` bytes within documents, the anchor of each, and the hashes by position."""
    n = len(byte)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, U)
    h = gram_hashes(byte)
    last = n - length + 1
    at = np.empty(last, np.int64)
    span, low = length - GRAM + 1, U((1 << 28) - 1)
    for a in range(0, last, 1 << 15):
        b = min(last, a + (1 << 15))
        v = (h[a : b + span - 1] & ~low) | np.arange(a, b + span - 1, dtype=U)  # ties go to the left
        width = 1
        while 2 * width <= span:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        at[a:b] = np.minimum(v[: b - a], v[span - width : span - width + b - a]) & low
    start_of = np.r_[0, ends[:-1]]
    ok = np.zeros(n + 1, np.int8)
    long = ends - start_of >= length
    ok[start_of[long]] += 1
    ok[ends[long] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(ok[:last], dtype=np.int8))
    return starts, at[starts], h


def suffix_order(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The suffix array of ``text``, sorted to ``depth`` bytes; ties by position. The text is seen as ending in zeros."""
    n = len(text)
    key = eights(text, ">u8")[:n].astype(U)
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]][:n]
    del key
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's number is its first place
    tied = np.flatnonzero(~(new & np.r_[new[1:], True]))  # places in groups of two and more
    h = 8
    while h < depth and len(tied):
        own = order[tied]
        after = own + h
        beyond = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + beyond
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[tied] = own
        fresh = np.r_[True, key[1:] != key[:-1]]
        rank[own] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        tied = tied[~(fresh & np.r_[fresh[1:], True])]
        h *= 2
    own = order[tied]
    order[tied] = own[np.argsort(rank[own] * n + own)]
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int = LENGTH, depth: int = DEPTH) -> np.ndarray:
    """For each place of the suffix array the bytes shared with the place before it, at ``depth`` at most.

    Kasai's recurrence: a suffix shares one byte fewer than its left neighbour in the text if their
    predecessors are neighbours as well and that neighbour shares a byte at all. Other suffixes are compared, and so is every one
    after ``depth - length`` steps, lest a value cut at ``depth`` run down below ``length``.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = np.r_[False, (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (text[:-1] == text[before[:-1]])]
    place = np.arange(n)
    begins = (place - np.maximum.accumulate(np.where(follows, 0, place))) % (depth - length) == 0
    alive = np.flatnonzero(begins & (before >= 0))
    words = eights(np.concatenate([text, np.zeros(depth, np.uint8)]))
    value = np.zeros(n, np.int64)
    for step in range(0, depth, 8):
        off = words[alive + step] ^ words[before[alive] + step]
        whole = off == 0
        value[alive[whole]] += 8
        some = off[~whole]
        value[alive[~whole]] += np.bitwise_count((some & (~some + U(1))) - U(1)) >> 3
        alive = alive[whole]
        if not len(alive):
            break
    # values do not run on past a place where the chain begins anew
    base = np.cumsum(begins) * (n + depth + 1)
    run = np.maximum.accumulate(np.where(begins, base + value + place, 0)) - base - place
    shared = np.clip(np.minimum(run, n - place), 0, depth)
    shared[before < 0] = 0
    out = shared[order]
    return np.minimum(out, n - np.maximum(order, before[order]))


def first_starts(text: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each valid start the earliest valid start of an equal string of ``length`` bytes, else -1."""
    order = suffix_order(text)
    shared = common_prefixes(text, order, length)
    order_ok = valid[order]
    group = np.cumsum(shared < length)
    order, group = order[order_ok], group[order_ok]
    first = np.full(len(text), -1, np.int64)
    if len(order):
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        first[order] = np.repeat(np.minimum.reduceat(order, head), np.diff(np.r_[head, len(order)]))
    return first


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join([np.array([a.nbytes for a in arrays], "<u8").tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]), 1)


def unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    out, at = [], 8 * len(kinds)
    for kind, size in zip(kinds, np.frombuffer(raw, "<u8", len(kinds)).tolist(), strict=True):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


class Shard:
    """The documents of a shard in the order of their identifiers, end to end."""

    def __init__(self, table: pa.Table):
        ids = [NO_ID if i is None else i for i in table.column("id").to_pylist()]
        texts = [t.encode("utf-8", "replace") for t in table.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.texts = [texts[i] for i in order]
        self.ends = np.cumsum([len(t) for t in self.texts]) if order else np.zeros(0, np.int64)
        self.begins = np.r_[0, self.ends[:-1]].astype(np.int64)
        self.byte = np.frombuffer(b"".join(self.texts), np.uint8)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, side="right")


def marked(at: np.ndarray, n: int) -> np.ndarray:
    """The distinct positions among many, in order."""
    flag = np.zeros(n, bool)
    flag[at] = True
    return np.flatnonzero(flag)


def tell_anchors(buckets: int):
    """A shard's distinct anchors: rows (bucket, shard, blob)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = Shard(table)
        _, at, h = anchors(shard.byte, shard.ends)
        hashes = np.unique(h[marked(at, len(h))])
        bucket = ((hashes >> U(8)) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(edges))
        return pa.table({"bucket": pa.array(used, pa.int32()), "shard": pa.array([key[0].as_py()] * len(used), pa.int32()), "blob": pa.array([pack(hashes[order[edges[b] : edges[b + 1]]]) for b in used], pa.binary())})

    return run


def shared_anchors(table: pa.Table) -> pa.Table:
    """The anchors that several shards have: rows (shard, blob) for each of them."""
    shards = table.column("shard").to_numpy()
    hashes = [unpack(b, [U])[0] for b in table.column("blob").to_pylist()]
    flat = np.sort(np.concatenate(hashes))
    twice = np.unique(flat[1:][flat[1:] == flat[:-1]])
    rows, blobs = [], []
    for s, own in zip(shards.tolist(), hashes, strict=True):
        at = np.minimum(np.searchsorted(twice, own), max(0, len(twice) - 1))
        hit = own[twice[at] == own] if len(twice) else own[:0]
        if len(hit):
            rows.append(s)
            blobs.append(pack(hit))
    return pa.table({"shard": pa.array(rows, pa.int32()), "blob": pa.array(blobs, pa.binary())})


PIECES = [U, np.int64, np.int64, np.uint8, np.uint8, np.uint8]


def within_shard(buckets: int):
    """Repeats of a shard, and its earliest starts that other shards may have: rows (bucket, shard, kind, blob).

    kind 0: covered intervals (identifier, row among its repeats, begin, end). kind 1: runs of starts with one anchor.
    """

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, shared: pa.Table) -> pa.Table:
        shard = Shard(docs)
        rows = {"bucket": [], "shard": [], "kind": [], "blob": []}

        def give(bucket: int, kind: int, blob: bytes) -> None:
            for k, v in zip(rows, (bucket, key[0].as_py(), kind, blob), strict=True):
                rows[k].append(v)

        start, at, h = anchors(shard.byte, shard.ends)
        if len(start):
            elsewhere = np.unique(np.concatenate([np.zeros(0, U), *(unpack(b, [U])[0] for b in shared.column("blob").to_pylist())]))
            own = marked(at, len(h))
            hashes = h[own]
            _, where, times = np.unique(hashes, return_inverse=True, return_counts=True)
            abroad = np.isin(hashes, elsewhere)
            flag = np.zeros(len(h), np.int8)  # by position: 1 twice in this shard, 2 in others
            flag[own] = (times[where] > 1) + 2 * abroad
            flag = flag[at]
            active, abroad = flag > 0, flag > 1
            start, at, abroad = start[active], at[active], abroad[active]
        if len(start):
            # the bytes of active strings alone, end to end; strings are compared over ``LENGTH`` bytes, all theirs
            mark = np.zeros(len(shard.byte) + 1, np.int32)
            mark[start] += 1  # starts are distinct
            mark[start + LENGTH] -= 1
            held = np.cumsum(mark[:-1]) > 0
            place = np.cumsum(held) - 1
            text = shard.byte[held]
            valid = np.zeros(len(text), bool)
            valid[place[start]] = True
            first = first_starts(text, valid)[place[start]]
            again = first != place[start]
            begin, end = intervals_of(start[again])
            doc = shard.document(begin)
            give(key[0].as_py() % buckets, 0, pack(doc.astype(np.int64), begin - shard.begins[doc], end - shard.begins[doc]))
            lone = ~again & abroad
            start, at = start[lone], at[lone]
        if len(start):
            head = np.flatnonzero(np.r_[True, (np.diff(start) != 1) | (np.diff(at) != 0)])
            size = np.diff(np.r_[head, len(start)])
            begin, anchor = start[head], at[head]
            mark = h[anchor]
            doc = shard.document(begin)
            bucket = ((mark >> U(8)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            total = size + LENGTH - 1
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[b] : edges[b + 1]]
                flat = shard.byte[np.repeat(begin[own] - (np.cumsum(total[own]) - total[own]), total[own]) + np.arange(int(total[own].sum()))]
                give(b, 1, pack(mark[own], shard.ids[doc[own]], ranked(shard, doc[own], begin[own]), (anchor - begin)[own].astype(np.uint8), size[own].astype(np.uint8), flat))
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "shard": pa.array(rows["shard"], pa.int32()), "kind": pa.array(rows["kind"], pa.int32()), "blob": pa.array(rows["blob"], pa.binary())})

    return run


def intervals_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive starts as byte intervals. Starts of different documents are never consecutive: their strings end with the document."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.flatnonzero(np.r_[True, np.diff(starts) != 1])
    return starts[head], starts[np.r_[head[1:], len(starts)] - 1] + LENGTH


ROW = 1 << 44


def ranked(shard: Shard, doc: np.ndarray, position: np.ndarray) -> np.ndarray:
    """A start within its document; rows that repeat an identifier follow each other."""
    first_row = np.searchsorted(shard.ids, shard.ids[doc], side="left")
    return (doc - first_row) * ROW + position - shard.begins[doc]


def merge(table: pa.Table) -> pa.Table:
    """One bucket: the covered intervals among the earliest starts of several shards, and those passed on: rows (shard, kind, blob)."""
    kinds, shards, blobs = table.column("kind").to_pylist(), table.column("shard").to_pylist(), table.column("blob").to_pylist()
    out = {"shard": [s for s, k in zip(shards, kinds, strict=True) if k == 0], "kind": [0 for k in kinds if k == 0], "blob": [b for b, k in zip(blobs, kinds, strict=True) if k == 0]}
    got = [(s, unpack(b, PIECES)) for s, k, b in zip(shards, kinds, blobs, strict=True) if k == 1]
    if got:
        mark, doc, begin, offset, size = (np.concatenate([g[i] for _, g in got]) for i in range(5))
        owner = np.concatenate([np.full(len(g[0]), s) for s, g in got])
        flat = np.concatenate([g[5] for _, g in got])
        total = size.astype(np.int64) + LENGTH - 1
        at = np.cumsum(total) - total
        # runs of one anchor and equal bytes together, in the order of their starts; a hash of the bytes sorts them, the bytes decide
        inside = np.arange(len(flat)) - np.repeat(at, total)
        content = np.add.reduceat((_table[flat] ^ (_places[inside] * U(0x9E3779B97F4A7C15))) * (_places[inside] | U(1)), at, dtype=U)
        content ^= (size.astype(U) << U(8)) | offset
        order = np.lexsort((begin, doc, content, mark))
        mark_, content_ = mark[order], content[order]
        new_anchor = np.r_[True, mark_[1:] != mark_[:-1]]
        new = new_anchor | np.r_[True, content_[1:] != content_[:-1]]
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        equal = same_bytes(flat, at, total, order, head)
        again = order[~new & equal]
        found_run, found_begin, found_end = again.tolist(), [0] * len(again), total[again].tolist()
        # the other runs of an anchor that has several are merged string by string
        rest = new | ~equal
        anchor = np.cumsum(new_anchor)
        several = rest & (np.bincount(anchor, rest)[anchor] > 1)
        mixed = np.split(order[several], np.flatnonzero(np.diff(anchor[several])) + 1) if several.any() else []
        if mixed:
            for runs in grouped(mixed, size):
                own = np.array(runs)
                n = size[own].astype(np.int64)
                run = np.repeat(own, n)
                inside = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                strings = np.ndarray((len(flat) - LENGTH + 1,), f"S{LENGTH}", flat, strides=(1,))[at[run] + inside]
                origin = np.empty(len(run), np.int64)
                origin[np.lexsort((begin[run] + inside, doc[run]))] = np.arange(len(run))
                late = np.flatnonzero(starts_earlier(strings, origin, owner[run]))
                if len(late):
                    cut = np.flatnonzero(np.r_[True, (np.diff(run[late]) != 0) | (np.diff(inside[late]) != 1)])
                    last = np.r_[cut[1:], len(late)] - 1
                    found_run += run[late[cut]].tolist()
                    found_begin += inside[late[cut]].tolist()
                    found_end += (inside[late[last]] + LENGTH).tolist()
        if found_run:
            i, x, y = np.array(found_run), np.array(found_begin), np.array(found_end)
            by = np.argsort(owner[i], kind="stable")
            i, x, y = i[by], x[by], y[by]
            cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(owner[i]) != 0]), len(i)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out["shard"].append(int(owner[i[a]]))
                out["kind"].append(1)
                out["blob"].append(pack(doc[i[a:b]], begin[i[a:b]] + x[a:b], begin[i[a:b]] + y[a:b]))
    return pa.table({"shard": pa.array(out["shard"], pa.int32()), "kind": pa.array(out["kind"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())})


_places = np.random.default_rng(20240311).integers(1, 2**63, 256, dtype=np.uint64)


def starts_earlier(strings: np.ndarray, origin: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which strings also occur in another shard with a smaller ``origin``; those of one shard are distinct.

    Each shard's strings are sorted; two sorted lists at a time become one by binary search of the shorter in the longer, which
    keeps the earlier of equals, until one list is left.
    """
    late = np.zeros(len(strings), bool)
    by = np.argsort(owner, kind="stable")
    lists = [own[np.argsort(strings[own])] for own in np.split(by, np.flatnonzero(np.diff(owner[by])) + 1)]
    while len(lists) > 1:
        lists.sort(key=len)  # lists of about one length meet
        merged = lists[len(lists) & ~1 :]
        for few, many in zip(lists[0 : len(lists) & ~1 : 2], lists[1::2], strict=True):
            sorted_, sought = strings[many], strings[few]
            at = np.searchsorted(sorted_, sought)
            met = np.minimum(at, len(many) - 1)
            same = sorted_[met] == sought
            one, other = many[met[same]], few[same]
            earlier = origin[one] < origin[other]
            late[np.where(earlier, other, one)] = True
            many[met[same]] = np.where(earlier, one, other)
            merged.append(np.insert(many, at[~same], few[~same]))
        lists = merged
    return late


def same_bytes(flat: np.ndarray, at: np.ndarray, total: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the bytes of runs equal those of other runs of the same length."""
    out = total[one] == total[other]
    words = eights(np.concatenate([flat, np.zeros(8, np.uint8)]))
    alive = np.flatnonzero(out & (one != other))
    for step in range(0, 256, 8):
        left = total[one[alive]] - step
        alive, left = alive[left > 0], left[left > 0]
        if not len(alive):
            break
        off = words[at[one[alive]] + step] ^ words[at[other[alive]] + step]
        off &= np.where(left >= 8, U(0xFFFFFFFFFFFFFFFF), (U(1) << (U(8) * np.minimum(left, 7).astype(U))) - U(1))
        out[alive[off != 0]] = False
        alive = alive[off == 0]
    return out


def grouped(mixed: list[np.ndarray], size: np.ndarray, most: int = 200_000):
    """Anchors' runs together in batches of about ``most`` strings; one anchor's runs are never parted."""
    batch, held = [], 0
    for runs in mixed:
        n = int(size[runs].sum())
        if batch and held + n > most:
            yield batch
            batch, held = [], 0
        batch += runs.tolist()
        held += n
    if batch:
        yield batch


def covered(shard: Shard, found: pa.Table) -> np.ndarray:
    """Which bytes of the shard are covered."""
    mark = np.zeros(len(shard.byte) + 1, np.int32)
    for kind, blob in zip(found.column("kind").to_pylist(), found.column("blob").to_pylist(), strict=True):
        doc, begin, end = unpack(blob, [np.int64] * 3)
        if kind == 1:
            row, begin = np.divmod(begin, ROW)
            end = end - row * ROW
            doc = np.searchsorted(shard.ids, doc, side="left") + row
        np.add.at(mark, shard.begins[doc] + begin, 1)
        np.add.at(mark, shard.begins[doc] + end, -1)
    return np.cumsum(mark[:-1]) > 0


def left_over(digest: bool):
    """Rows for each document of a shard: what is left, or its digest."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, found: pa.Table) -> pa.Table:
        shard = Shard(docs)
        gone = covered(shard, found)
        head = gone & ~np.r_[False, gone[:-1]]
        head[shard.begins[shard.begins < len(gone)]] = gone[shard.begins[shard.begins < len(gone)]]
        removed, spans = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(head)]
        kept = [shard.byte[a:b][~gone[a:b]].tobytes() for a, b in zip(shard.begins, shard.ends, strict=True)]
        out = {
            "doc_id": pa.array([None if i == NO_ID else i for i in shard.ids.tolist()], pa.int64()),
            "n_bytes": pa.array(shard.ends - shard.begins, pa.int64()),
            "n_removed": pa.array(removed[shard.ends] - removed[shard.begins], pa.int64()),
            "n_spans": pa.array(spans[shard.ends] - spans[shard.begins], pa.int64()),
        }
        out["kept_sha256" if digest else "kept"] = pa.array([hashlib.sha256(k).hexdigest() if digest else k for k in kept], pa.string() if digest else pa.binary())
        return pa.table(out)

    return run


def deduplicated(docs: DataFrame, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD, bucket_bytes: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) or, as a digest, kept_sha256, of every row."""
    rows = texts_of(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards, buckets = max(1, math.ceil(size / shard_bytes)), max(1, math.ceil(size / bucket_bytes / 2))
    parts = rows.select(F.col("doc_id").cast("long").alias("id"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    told = parts.groupBy("shard").applyInArrow(tell_anchors(buckets), "bucket int, shard int, blob binary")
    shared = told.groupBy("bucket").applyInArrow(shared_anchors, "shard int, blob binary")
    runs = parts.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(within_shard(buckets), "bucket int, shard int, kind int, blob binary")
    found = runs.groupBy("bucket").applyInArrow(merge, "shard int, kind int, blob binary")
    return parts.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(left_over(digest), "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary"))
