"""N-gram Jaccard join: universe-partition pigeonhole with cost-based allocation, verified exactly.

Sets of word shingles link when 100 * intersection >= 75 * union, that is when they differ in at most
(|r| + |s|) / 7 elements. Equal sets are one class first. The shingle universe is cut by hash into
segments, as many as the size band needs; a set's part in a segment is its subset there. If two sets
differ in at most H elements, at most H of their segments differ, so with units allotted to
segments that add up to H + 1 one allotted segment agrees (1 unit), or differs by one deletion (2 units).

First pass, over all classes: a class allots 1 unit to each of its first H + 1 non-empty segments and to
``slack`` more, 0 to the rest. Subsets held by over ``FREQUENT`` classes are costly and are not joined:
the slack makes up for them. Two classes that share a rare subset are candidates if they share as
many subsets as the pigeonhole bound asks of a linked pair.

Second pass, over the classes whose slack the frequent subsets used up (only pairs of two such classes can have
been missed). Classes that share least hashes are verified first, each against a leader a key; members of one
component are not compared again, so that a large group of near copies costs few pairs. Then each class allots its units to its cheapest shingles, those with
the fewest holders, wherever they are; where none of these is held by another component it is done. Of those
left, pairs that share rare shingles are tried, and the others only where their rare shingles, all different, leave room for a
link: larger segments, with all subsets and one-deletion neighbourhoods indexed, and units where the posting lists of
other components are shortest.

All candidates are verified on whole sets. Sets are of 64-bit hashes: two distinct shingles or
two distinct sets are taken for one with a probability of about 2^-64 a pair.

Defined results: a text without words, an empty or a null text has no shingles and is a component by
itself; with one to four words the whole sequence is the one shingle; a null identifier is smaller than all others;
repeated rows link to each other; texts of any length have all their shingles; further columns are kept by
``keep_one`` and not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwater.llm.common import cut, forget, give_back, id_type, settled, slices, texts_of, tidy, with_ids
from stillwater.llm.components import roots

FREQUENT = 32
SINGLES = 64  # sets below this size have a segment for each shingle
BAND = 4  # ratio of the sizes of a band in the first pass
FINE = 4 / 3  # and in the second: linked sets are in one band or in neighbouring ones
SALTS = 32

U = np.uint64
_table = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_table[65:91] = _table[97:123]  # A-Z count as a-z
_solid = np.ones(256, bool)
_solid[[9, 10, 11, 12, 13, 32]] = False
_places = np.random.default_rng(20240301).integers(1, 2**63, 5, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: list[str], size: int = 5, most: int = 1_000_000) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, made from about ``most`` characters at a time."""
    out: list[np.ndarray] = []
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            out += _shingle_sets(texts[start:i], size)
            start, held = i, 0
        held += len(t)
    return out + _shingle_sets(texts[start:], size)


def _shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    byte = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    solid = _solid[byte]
    begin = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
    if not len(begin):
        return [np.zeros(0, U) for _ in texts]
    end = np.flatnonzero(solid & ~np.r_[solid[1:], False]) + 1
    length = end - begin
    power = np.cumprod(np.full(int(length.max()) + 1, 0x9E3779B97F4A7C15, U), dtype=U)
    kept = np.flatnonzero(solid)
    offset = np.cumsum(length) - length
    since = np.arange(len(kept)) - np.repeat(offset, length)
    word = mix(np.add.reduceat(_table[byte[kept]] * power[since], offset) + length.astype(U))
    n = len(word)
    padded = np.r_[word, np.zeros(size, U)]
    shingle = np.zeros(n, U)
    for i in range(size):
        shingle += padded[i : n + i] * _places[i]
    shingle = mix(shingle)
    bounds = np.searchsorted(begin, starts)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(shingle[a : b - size + 1]))
        elif b > a:
            out.append(mix((word[a:b] * _places[: b - a]).sum(dtype=U, keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def class_of(s: np.ndarray) -> int:
    """A set's class: a hash of all its elements, as a signed integer."""
    return int(mix(mix(s * U(0xD6E8FEB86659FD93)).sum(dtype=U)[None] + U(len(s)))[0].astype(np.int64))


def slack(n: int) -> int:
    """Segments allotted beyond those that the bound asks for."""
    return n // 12 + 4


def spare(n: int) -> int:
    """How many of a set's subsets may be frequent before a link with it can be missed."""
    return max(0, min(slack(n), n - n // 3 - 1))


def band_of(n: int) -> int:
    return 0 if n < SINGLES else 1 + int(math.log(n / SINGLES, BAND) + 1e-9)


def band_low(b: int) -> int:
    return 0 if b == 0 else SINGLES * BAND ** (b - 1)


def subsets(s: np.ndarray, b: int, most: int) -> np.ndarray:
    """The keys of a set's first ``most`` non-empty segments in band ``b``."""
    if b == 0:
        return mix(s[:most] ^ U(0xA5A5A5A5))
    seg = mix(s + U(b)) % U(2 * SINGLES * BAND**b)
    order = np.argsort(seg, kind="stable")
    seg = seg[order]
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    total = np.add.reduceat(s[order], first, dtype=U)[:most]
    return mix(total ^ mix((seg[first][:most] << U(8)) | U(b)))


def allotted(n: int, upper: bool) -> int:
    return min(n, (2 * n // 7 if upper else n // 3) + 1 + slack(n))


def keys_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's keys as one of its band, and as a larger partner of sets in the band below (or none)."""
    n = len(s)
    b = band_of(n)
    own = subsets(s, b, allotted(n, False))
    above = b > 0 and 3 * n <= 4 * (band_low(b) - 1)
    return own, subsets(s, b - 1, allotted(n, True)) if above else np.zeros(0, U)


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join([np.array([len(a) for a in arrays], "<u4").tobytes(), *(a.tobytes() for a in arrays)]), 1)


def unpacked(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, "<u4", len(kinds))
    out, at = [], 4 * len(kinds)
    for kind, n in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


BLOB = [np.uint64, np.int64, np.uint32, np.uint8, np.int64, np.uint32, np.uint8]


def emit(buckets: int, most: int):
    """Rows (bucket, blob) of a task's keys: keys, classes, sizes, roles; and counts of subsets known to be frequent here."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = {class_of(s): s for s in shingle_sets(part.column(1).to_pylist()) if len(s)}
                if not sets:
                    continue
                key, cls, size, role = [], [], [], []
                for c, s in sets.items():
                    for r, k in enumerate(keys_of(s)):
                        key.append(k)
                        cls.append(np.full(len(k), c, np.int64))
                        size.append(np.full(len(k), len(s), np.uint32))
                        role.append(np.full(len(k), r, np.uint8))
                key, cls, size, role = map(np.concatenate, (key, cls, size, role))
                order = np.argsort(key, kind="stable")
                key, cls, size, role = key[order], cls[order], size[order], role[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                count = np.diff(np.r_[first, len(key)])
                # a subset frequent in this slice alone needs no rows elsewhere: one marks it, its holders count it here
                hot = np.repeat(count > most, count)
                lone = np.zeros(len(key), bool)
                lone[first[count > most]] = True
                hot_cls, hot_role = cls[hot], role[hot]
                pair, times = np.unique(np.stack([hot_cls, hot_role.astype(np.int64)]), axis=1, return_counts=True) if len(hot_cls) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                role = np.where(lone, np.uint8(2), role)
                keep = ~hot | lone
                key, cls, size, role = key[keep], cls[keep], size[keep], role[keep]
                bucket = (key >> U(20)) % U(buckets)
                home = (pair[0].astype(U) >> U(20)) % U(buckets)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U))
                rows, blobs = [], []
                for b in np.union1d(bucket, home).tolist():
                    own = order[edges[int(b)] : edges[int(b) + 1]]
                    by_class = own[np.argsort(cls[own], kind="stable")]
                    mine = home == b
                    rows.append(int(b))
                    blobs.append(packed(key[by_class], cls[by_class], size[by_class], role[by_class], pair[0][mine], times[mine].astype(np.uint32), pair[1][mine].astype(np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return run


PAIR_SCHEMA = "a long, b long, na int, nb int, n int"


def tallied(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(code, return_inverse=True)
    return code, np.bincount(at, n, len(code)).astype(np.int64)


def shared_keys(key: np.ndarray, who: np.ndarray, role: np.ndarray, size_of: np.ndarray, most: int, room: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes (x << 32 | y, x < y) of sizes that may link, and how many keys they share.

    Keys are sorted, each with up to ``most`` holders in order. Keys with about ``room`` pairs are paired at a time
    and tallied, so that memory follows the distinct pairs, not the shared keys.
    """
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    edge = np.r_[first, len(key)]
    held = np.diff(edge)
    ends = np.cumsum(held * (held - 1) // 2)
    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh: list[tuple[np.ndarray, np.ndarray]] = []
    start = 0
    while start < len(first):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + room, "right")))
        k, w, r = (x[edge[start] : edge[stop]] for x in (key, who, role))
        found, at = [], np.arange(len(k))
        for d in range(1, most):
            at = at[at + d < len(k)]
            at = at[k[at] == k[at + d]]
            if not len(at):
                break
            x, y = w[at], w[at + d]
            good = (x != y) & ((r[at] == 0) | (r[at + d] == 0))
            x, y = x[good], y[good]
            good = 4 * np.minimum(size_of[x], size_of[y]) >= 3 * np.maximum(size_of[x], size_of[y])
            found.append(x[good] << 32 | y[good])
        if found:
            fresh.append(np.unique(np.concatenate(found), return_counts=True))
        start = stop
        if start >= len(first) or sum(len(c) for c, _ in fresh) > max(4 * room, len(code)):
            code, n = tallied(np.concatenate([code, *(c for c, _ in fresh)]), np.concatenate([n, *(m for _, m in fresh)]))
            fresh = []
    return code, n


def meet(table: pa.Table, most: int) -> pa.Table:
    """One bucket: candidate pairs by rare subsets (a < b, with sizes and the number shared), and (class, null, role, ..., n) for n frequent subsets."""
    key, cls, size, role, hot, times, hot_role = (np.concatenate(x) for x in zip(*(unpacked(b, BLOB) for b in table.column("blob").to_pylist()), strict=True))
    order = np.lexsort((role, cls, key))
    key, cls, size, role = key[order], cls[order], size[order], role[order]
    same = np.r_[False, (key[1:] == key[:-1]) & (cls[1:] == cls[:-1]) & (role[1:] == role[:-1])] & (role != 2)
    key, cls, size, role = key[~same], cls[~same], size[~same], role[~same]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    marked = np.maximum.reduceat(role, first) == 2 if len(key) else np.zeros(0, bool)
    often = np.repeat((count > most) | marked, count)
    many = often & (role != 2)
    hot = np.r_[hot, cls[many]]
    hot_role = np.r_[hot_role, role[many]]
    times = np.r_[times, np.ones(int(many.sum()), np.uint32)]
    key, cls, size, role = key[~often], cls[~often], size[~often], role[~often]
    names, who = np.unique(cls, return_inverse=True)
    size_of = np.zeros(len(names), np.int64)
    size_of[who] = size
    code, n = shared_keys(key, who, role, size_of, most)
    x, y = code >> 32, code & 0xFFFFFFFF
    pairs = pa.table({"a": pa.array(names[x], pa.int64()), "b": pa.array(names[y], pa.int64()), "na": pa.array(size_of[x], pa.int32()), "nb": pa.array(size_of[y], pa.int32()), "n": pa.array(n, pa.int32())})
    frequent = pa.table({"a": pa.array(hot, pa.int64()), "b": pa.nulls(len(hot), pa.int64()), "na": pa.array(hot_role.astype(np.int32), pa.int32()), "nb": pa.nulls(len(hot), pa.int32()), "n": pa.array(times.astype(np.int32), pa.int32())})
    give_back()
    return pa.concat_tables([pairs, frequent])


def sets_of(rows: DataFrame) -> DataFrame:
    """cls, n, sh (the whole set) of texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = {class_of(s): s for s in shingle_sets(part.column(1).to_pylist()) if len(s)}
                offsets = np.cumsum([0, *(len(s) for s in sets.values())])
                flat = np.concatenate([*sets.values(), np.zeros(0, U)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(np.diff(offsets), pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["cls", "n", "sh"])

    return rows.mapInArrow(tidy(run), "cls long, n int, sh array<long>")


def texts_for(rows: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of one member of each wanted class (and others that bear that member's identifier)."""
    return with_ids(rows, members.join(wanted, "cls", "left_semi").select("doc_id"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("size_a"), F.col("sh").alias("sh_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("size_b"), F.col("sh").alias("sh_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sh_a", "sh_b"))
    return both.filter(100 * shared >= 75 * (F.col("size_a") + F.col("size_b") - shared)).select("a", "b")


def linked(pairs: DataFrame, sets: DataFrame, partners: tuple[int, ...] = ()) -> DataFrame:
    """Links enough for the components of all verified pairs: first some ``partners`` of each class, at last all pairs still apart."""
    links = None
    for n in (*partners, None):
        some = pairs
        if n is not None:
            order = Window.partitionBy("b").orderBy(F.xxhash64("a", "b"), "a")
            some = pairs.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n).drop("nth")
        more = settled(verified(some, sets))
        links = more if links is None else links.unionByName(more)
        if n is not None:
            pairs = settled(foreign(pairs, roots(links)).join(some, ["a", "b"], "left_anti"))
            if pairs.isEmpty():
                break
        forget(sets.sparkSession)
    return links


def foreign(pairs: DataFrame, root: DataFrame) -> DataFrame:
    return with_root(with_root(pairs, root, "a"), root, "b").filter("root_a != root_b").select("a", "b")


def with_root(rows: DataFrame, root: DataFrame, col: str) -> DataFrame:
    named = root.select(F.col("node").alias(col), F.col("root").alias(f"root_{col}"))
    return rows.join(named, col, "left").withColumn(f"root_{col}", F.coalesce(f"root_{col}", col))


def fine_band(n: int) -> int:
    return int(math.log(n, FINE) + 1e-9)


def index_second():
    """Second pass, one class: rows (cls, n, rare, band, seg, kind, key, units, need).

    kind 0 and 1 are indexed: subsets, and subsets less one shingle. kind 2, 3 and 4 are probes: the subset
    among subsets (1 unit), the subset among subsets less one, a subset less one among subsets (2 units).
    """

    def run(batches):
        for batch in batches:
            for cls, n, sh, rare in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                s = sh.values.to_numpy().astype(np.int64).view(U)
                out = {k: [] for k in ("band", "seg", "kind", "key", "units", "need")}
                own, low = fine_band(n), fine_band(-(-3 * n // 4))
                for b in range(low, own + 1):
                    m = math.ceil(FINE ** (b + 1) / 3) + 1
                    need = (n // 3 if b == own else 2 * n // 7) + 1
                    seg = (mix(s + U(1000 + b)) % U(m)).astype(np.int64)
                    total = np.zeros(m, U)
                    np.add.at(total, seg, s)
                    place = mix(np.arange(m, dtype=U) * U(4096) + U(b))
                    whole = mix(total ^ place)
                    less = mix((total[seg] - s) ^ place[seg])
                    rows = [(2, np.arange(m), whole, 1), (3, np.arange(m), whole, 2), (4, seg, less, 2)]
                    if b == own:
                        rows += [(0, np.arange(m), whole, 0), (1, seg, less, 0)]
                    for kind, at, key, units in rows:
                        out["band"].append(np.full(len(at), b, np.int32))
                        out["seg"].append(at.astype(np.int32))
                        out["kind"].append(np.full(len(at), kind, np.int32))
                        out["key"].append(key.view(np.int64))
                        out["units"].append(np.full(len(at), units, np.int32))
                        out["need"].append(np.full(len(at), need, np.int32))
                columns = {k: np.concatenate(v) for k, v in out.items()}
                size = len(columns["key"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, cls, np.int64)), pa.array(np.full(size, n, np.int32)), pa.array(np.full(size, rare, np.int32)), *(pa.array(columns[k]) for k in ("band", "seg", "kind", "key", "units", "need"))], names=["cls", "n", "rare", "band", "seg", "kind", "key", "units", "need"])

    return run


BINS, BAND_BINS = 64, 4


def band_keys(seed: int):
    """Rows (cls, n, key, salt): a class's least hashes in ``BINS`` bins, ``BAND_BINS`` to a key; an empty bin has the next one's."""

    def run(batches):
        step = mix(np.full(1, seed + 1, U))[0]
        for batch in batches:
            names, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys = np.zeros((len(names), BINS // BAND_BINS), U)
            for i, sh in enumerate(batch.column(2)):
                h = mix(sh.values.to_numpy().astype(np.int64).view(U) + step)
                least = np.full(BINS, ~U(0))
                np.minimum.at(least, (h & U(BINS - 1)).astype(np.int64), h)
                full = np.flatnonzero(least != ~U(0))
                least = least[full[np.searchsorted(full, np.arange(BINS)) % len(full)]]
                keys[i] = mix(least.reshape(-1, BAND_BINS) * _places[:BAND_BINS]).sum(1, dtype=U) + np.arange(BINS // BAND_BINS, dtype=U)
            each = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, each)), pa.array(np.repeat(sizes, each).astype(np.int32)), pa.array(keys.ravel().view(np.int64))], names=["cls", "n", "key"])

    return run


def likely(sets: DataFrame, root: DataFrame, seed: int, salts: int = 16) -> DataFrame:
    """Pairs of different components that probably link: a class and the least of its salt under a key, and these leaders among themselves."""
    rows = with_root(sets.select("cls", "n", "sh").mapInArrow(tidy(band_keys(seed)), "cls long, n int, key long"), root, "cls")
    rows = cut(rows.withColumn("salt", F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(salts)).cast("int")))
    who = F.struct("cls", "n", "root_cls")
    first = rows.groupBy("key", "salt").agg(F.min(who).alias("l"), F.min("root_cls").alias("low"), F.max("root_cls").alias("high"))
    whole = first.groupBy("key").agg(F.min("l").alias("m"), F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("key", "m")
    near = rows.join(first.filter("low <> high").select("key", "salt", "l"), ["key", "salt"]).select(who.alias("x"), F.col("l").alias("y"))
    far = first.join(whole, "key").select(F.col("l").alias("x"), F.col("m").alias("y"))
    apart = "x.cls <> y.cls AND x.root_cls <> y.root_cls AND 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n)"
    return settled(near.unionByName(far).filter(apart).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct())


def contested(sets: DataFrame, root: DataFrame) -> DataFrame:
    """The classes among whose cheapest shingles one is held by another component; no other class can have a missing link.

    Shingles are segments of their own here, in one order for all classes: fewest holders first. A class
    allots a unit to each of its first H + 1; two linked classes of the set share one of these.
    """
    rows = with_root(sets.select("cls", "n", F.explode("sh").alias("key")), root, "cls")
    held = rows.groupBy("key", "root_cls").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.sum("k").alias("holders"), F.count(F.lit(1)).alias("parts"))
    cheapest = Window.partitionBy("cls").orderBy("holders", "key")
    # a shingle held once needs no name to be ranked: those of a class are counted, the others ranked behind them
    shared = rows.join(held.filter("holders > 1"), "key")
    lone = rows.groupBy("cls", "n").agg(F.count(F.lit(1)).alias("all")).join(shared.groupBy("cls").agg(F.count(F.lit(1)).alias("some")), "cls").select("cls", (F.col("all") - F.col("some")).alias("lone"))
    ranked = shared.withColumn("rank", F.row_number().over(cheapest)).join(lone, "cls")
    return ranked.filter((F.col("rank") + F.col("lone") <= F.floor(F.col("n") / 3) + 1) & (F.col("parts") > 1)).select("cls").distinct()


def foreign_pairs(sent: pa.Table, held: pa.Table, most: int = 1_000_000) -> pa.Table:
    """One bucket: pairs of classes, once each, of a probe and a holder of its key in another component, whose sizes and rare shingles allow a link.

    Pairs that share rare shingles were joined by those: here none is taken to be shared."""
    x = {c: sent.column(c).to_numpy() for c in sent.column_names}
    y = {c: held.column(c).to_numpy() for c in held.column_names}
    mark = lambda t: mix(t["key"].astype(np.int64).view(U) ^ mix(t["kind"].astype(U) + U(7)))
    kx, ky = mark(x), mark(y)
    order = np.argsort(ky, kind="stable")
    ky = ky[order]
    first, last = np.searchsorted(ky, kx, "left"), np.searchsorted(ky, kx, "right")
    count = last - first
    ends = np.cumsum(count)
    names, who = np.unique(np.concatenate([x["cls"], y["other"]]), return_inverse=True)
    asks, holds = who[: len(kx)], who[len(kx) :]
    code, fresh = np.zeros(0, np.int64), []
    start = 0
    while start < len(kx):
        # probes whose holders add up to about ``most``
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        n = count[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        j = order[np.repeat(first[start:stop] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        good = x["root_cls"][i] != y["root_other"][j]
        i, j = i[good], j[good]
        na, nb = x["n_cls"][i].astype(np.int64), y["n_other"][j].astype(np.int64)
        least = np.maximum.reduce(apart(na, nb, x["rare"][i].astype(np.int64), y["rare_other"][j].astype(np.int64), 0))
        good = (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (7 * least <= na + nb)
        a, b = asks[i[good]], holds[j[good]]
        fresh.append(np.unique(np.minimum(a, b) << 32 | np.maximum(a, b)))
        start = stop
        if start >= len(kx) or sum(map(len, fresh)) > max(most, len(code)):
            code, fresh = np.unique(np.concatenate([code, *fresh])), []
    give_back()
    return pa.table({"a": pa.array(names[code >> 32], pa.int64()), "b": pa.array(names[code & 0xFFFFFFFF], pa.int64())})


def allotments(rows: pa.Table) -> pa.Table:
    """The probes of one class that it allots its units to: in each band, ``need`` units where they cost least, and none that cost nothing."""
    x = {c: rows.column(c).to_numpy() for c in rows.column_names}
    place = x["band"].astype(np.int64) << 32 | x["seg"]
    segment, at = np.unique(place, return_inverse=True)
    one = np.bincount(at, x["price"] * (x["units"] == 1), len(segment))
    two = np.bincount(at, x["price"], len(segment))
    band = np.tile(segment >> 32, 2)
    price = np.r_[one, np.maximum(one, two - one)]
    level = np.repeat([1, 2], len(segment))
    order = np.lexsort((np.tile(segment, 2), level, price, band))
    first = np.flatnonzero(np.r_[True, band[order][1:] != band[order][:-1]])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    need = np.zeros(len(segment), np.int64)
    need[at] = x["need"]
    taken = order[rank < np.tile(need, 2)[order]]
    units = np.bincount(taken % len(segment), minlength=len(segment))
    kept = (x["units"] <= units[at]) & (x["price"] > 0)
    out = rows.filter(pa.array(kept))
    return out.select(["kind", "key", "cls", "n", "rare", "root_cls"]).rename_columns(["kind", "key", "cls", "n_cls", "rare", "root_cls"])


def rare_counts(sets: DataFrame, most: int = FREQUENT) -> DataFrame:
    """cls, n, sh and rare: how many of a class's shingles at most ``most`` classes of ``sets`` hold."""
    each = sets.select("cls", F.explode("sh").alias("key"))
    few = each.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") <= most).select("key")
    rare = each.join(few, "key").groupBy("cls").agg(F.count(F.lit(1)).cast("int").alias("rare"))
    return cut(sets.join(rare, "cls", "left").withColumn("rare", F.coalesce("rare", F.lit(0))))


def apart(na, nb, rare_a, rare_b, shared):
    """At least how many elements two sets differ in, of which ``shared`` rare ones are common.

    A rare element of one that the other lacks is in the difference, and each side's part of it is the other's plus the difference in size.
    """
    return (2 * (rare_a - shared) + nb - na), (2 * (rare_b - shared) + na - nb), (rare_a + rare_b - 2 * shared)


def rare_prefixes(sets: DataFrame, root: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The rows (cls, n, key, root_cls, rank) of each class's first floor(n / 4) + 1 shingles, fewest holders first, that several components and at most ``most`` classes hold.

    Two linked classes share all but a quarter of either. So the first shingle they share has at most floor(n / 4) others
    before it in either class, and it is rare if they share any rare one.
    """
    rows = with_root(sets.select("cls", "n", F.explode("sh").alias("key")), root, "cls")
    few = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("root_cls").alias("low"), F.max("root_cls").alias("high")).filter(F.col("k") <= most).select("key", "k", (F.col("low") != F.col("high")).alias("shared"))
    ranked = rows.join(few, "key").withColumn("rank", F.row_number().over(Window.partitionBy("cls").orderBy("k", "key")))
    return cut(ranked.filter(F.col("shared") & (F.col("rank") <= F.floor(F.col("n") / 4) + 1)).select("cls", "n", "key", "root_cls", "rank"))


def rare_pairs(sets: DataFrame, root: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The pairs of classes of different components that share rare shingles and may link."""
    rows = rare_prefixes(sets, root, most)
    side = lambda x: rows.select("key", F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("root_cls").alias(f"root_{x}"), (F.col("rank") - 1).alias(f"before_{x}"))
    near = "a < b AND root_a <> root_b AND 4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)"
    pairs = side("a").join(side("b"), "key").filter(near).groupBy("a", "b", "n_a", "n_b").agg(F.min("before_a").alias("before_a"), F.min("before_b").alias("before_b"))
    # what comes before the first shared one is in one of the two alone
    least = F.greatest(*apart(*map(F.col, ("n_a", "n_b", "before_a", "before_b")), 0))
    return settled(pairs.filter(7 * least <= F.col("n_a") + F.col("n_b")).select("a", "b"))


def second_pass(sets: DataFrame, links: DataFrame, rounds: int = 3) -> DataFrame:
    """Links among the classes of ``sets`` that, with ``links``, give the components of all their pairs."""
    for seed in range(rounds):
        links = links.unionByName(linked(likely(sets, roots(links), seed), sets))
    root = roots(links)
    sets = settled(sets.join(contested(sets, root), "cls", "left_semi"), 2_000)
    if sets.isEmpty():
        return links
    forget(sets.sparkSession)
    sets = rare_counts(sets)
    links = links.unionByName(linked(rare_pairs(sets, root), sets))
    root = roots(links)
    rows = cut(with_root(sets.select("cls", "n", "sh", "rare").mapInArrow(tidy(index_second()), "cls long, n int, rare int, band int, seg int, kind int, key long, units int, need int"), root, "cls"))
    held = rows.filter("kind <= 1").select("kind", "key", F.col("cls").alias("other"), F.col("n").alias("n_other"), F.col("rare").alias("rare_other"), F.col("root_cls").alias("root_other"))
    by_key = held.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("holders"), F.min("root_other").alias("low"), F.max("root_other").alias("high"))
    probe = rows.filter("kind >= 2").withColumn("kind", F.when(F.col("kind") == 3, 1).otherwise(0))
    # a key that only the class's own component holds costs nothing, and need not be sent where it costs nothing;
    # one other component that holds it alone is priced, for a class does not hold all the keys that it asks for
    own = (F.col("low") == F.col("root_cls")) & (F.col("high") == F.col("root_cls"))
    priced = probe.join(by_key, ["kind", "key"], "left").withColumn("price", F.when(own, 0).otherwise(F.coalesce("holders", F.lit(0)))).select("cls", "n", "rare", "root_cls", "band", "seg", "need", "kind", "key", "units", "price")
    sent = settled(priced.groupBy("cls").applyInArrow(allotments, "kind int, key long, cls long, n_cls int, rare int, root_cls long"))
    forget(sets.sparkSession)
    buckets = max(1, math.ceil(held.count() / 1_000_000))
    bucket = F.pmod(F.xxhash64("kind", "key"), F.lit(buckets)).cast("int").alias("bucket")
    # cut, for a cogroup wants sides of lineages of their own
    asked = settled(sent.select(bucket, "kind", "key", "cls", "n_cls", "rare", "root_cls"))
    listed = settled(held.select(bucket, "kind", "key", "other", "n_other", "rare_other", "root_other"))
    pairs = asked.groupBy("bucket").cogroup(listed.groupBy("bucket")).applyInArrow(lambda x, y: foreign_pairs(x, y), "a long, b long").distinct()
    return links.unionByName(linked(settled(pairs), sets))


def classes(rows: DataFrame, kind: str) -> DataFrame:
    """doc_id, n, cls of every text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64())], names=["doc_id", "n", "cls"])

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n long, cls long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = texts_of(docs, id_col, text_col)
    every = cut(classes(rows, id_type(docs, id_col)))
    runs = every.filter("n > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).groupBy("cls", "salt").agg(F.min(F.struct("doc_id")).alias("least"), F.max("n").alias("n"))
    runs = cut(runs)
    members = cut(runs.groupBy("cls").agg(F.min("least").alias("least"), F.max("n").alias("n")).select("cls", "n", F.col("least.doc_id").alias("doc_id")))
    total = members.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, math.ceil(0.45 * total / 750_000))
    found = cut(rows.mapInArrow(tidy(emit(buckets, most)), "bucket int, blob binary").groupBy("bucket").applyInArrow(lambda table: meet(table, most), PAIR_SCHEMA))
    frequent = cut(found.filter("b IS NULL").groupBy(F.col("a").alias("cls"), F.col("na").alias("role")).agg(F.sum("n").alias("f")))
    sized = frequent.join(members.select("cls", "n"), "cls")
    short = F.floor(3 * F.col("n") / 4)
    spared = F.greatest(F.lit(0), F.least(F.floor(short / 12) + 4, short - F.floor(short / 3) - 1))
    deficient = cut(sized.filter(F.col("f") > spared).select("cls").distinct())
    worst = frequent.groupBy("cls").agg(F.max("f").alias("f"))
    pairs = found.filter("b IS NOT NULL").groupBy("a", "b", "na", "nb").agg(F.sum("n").alias("n"))
    pairs = pairs.join(worst.select(F.col("cls").alias("a"), F.col("f").alias("f_a")), "a", "left").join(worst.select(F.col("cls").alias("b"), F.col("f").alias("f_b")), "b", "left")
    n_small = F.least("na", "nb")
    bound = F.floor((F.col("na") + F.col("nb")) / 7)
    least_allotted = F.least(n_small, F.floor(2 * n_small / 7) + 1 + F.floor(n_small / 12) + 4)
    missing = F.least(F.coalesce("f_a", F.lit(0)), F.coalesce("f_b", F.lit(0)))
    pairs = settled(pairs.filter(F.col("n") >= least_allotted - bound - missing).select("a", "b"))
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(deficient).distinct()
    sets = sets_of(texts_for(rows, members, wanted))
    if not every.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():  # one identifier, several texts
        sets = sets.join(wanted, "cls", "left_semi").dropDuplicates(["cls"])
    sets = cut(sets)
    links = linked(pairs, sets, (4,))
    if not deficient.isEmpty():
        links = second_pass(settled(sets.join(deficient, "cls", "left_semi"), 2_000), links)
    root = roots(links)
    placed = with_root(members, root, "cls")
    least = placed.groupBy("root_cls").agg(F.min(F.struct("doc_id")).alias("component"))
    of_class = placed.join(least, "root_cls").select("cls", "component")
    of_run = runs.select("cls", "salt").join(of_class, "cls")
    salted = every.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    linked_rows = salted.filter("n > 0").join(of_run, ["cls", "salt"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component.doc_id").alias("component_id"))
    return linked_rows.unionByName(every.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document stays: the smallest identifier of each component, all columns kept."""
    kept = cut(groups(docs, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    out = with_ids(docs, kept.select("doc_id"), id_col)
    return out if kept.filter("n > 1").isEmpty() else out.dropDuplicates([id_col])  # only rows that repeat an identifier need that shuffle
