import collections
import hashlib
import re

import numpy as np
import pytest

import cases
from stillwater.llm import exact_dedup, jaccard, suffix
from stillwater.llm.components import roots

SPACE = re.compile(r"[\x20\x09-\x0D]")


def key(i):
    return -1 if i is None else i


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(cases.documents(spark), salts=3).collect()
    groups = collections.defaultdict(list)
    for i, t in cases.clean():
        groups[SPACE.sub("", t)].append((-len(t), key(i), i))
    want = []
    for norm, rows in groups.items():
        keep = min(rows, key=lambda r: r[:2])
        want += [(key(i), key(keep[2]), len(rows), hashlib.sha256(norm.encode()).hexdigest()) for _, _, i in rows]
    assert sorted((key(r["doc_id"]), key(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == sorted(want)
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup.exact_groups(cases.empty(spark)).count() == 0


def test_exact_dedup_keeps_columns_and_one_of_each(spark):
    docs = cases.documents(spark)
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    texts = [SPACE.sub("", r["text"] or "") for r in out.collect()]
    assert sorted(texts) == sorted({SPACE.sub("", t) for _, t in cases.clean()})
    assert exact_dedup.dedup(cases.documents(spark, [(1, "a b"), (2, "ab"), (3, "c")])).count() == 2


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return {tuple(w)} if 0 < len(w) < 5 else set(zip(*(w[i:] for i in range(5))))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(key(d))
    return sorted((key(d), len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows))


def near_copies(base, n, changes, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        w = cases.words(base, 120).split()
        for at in rng.integers(0, len(w), changes):
            w[at] = f"z{rng.integers(1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("most", [2, 32])
def test_components_equal_brute_force(spark, most):
    passage = cases.words(50, 30)
    rows = [r for r in cases.TEXTS if r[0] not in (7, 8)]
    rows += [(100 + i, t) for i, t in enumerate(near_copies(7, 25, 4, 1))]
    rows += [(200 + i, t) for i, t in enumerate(near_copies(8, 12, 6, 2))]
    rows += [(300 + i, cases.words(60 + i, 25) + " " + passage) for i in range(20)]
    rows += [(400 + i, " ".join(cases.words(9, 8 + i % 3).split())) for i in range(6)]
    got = jaccard.groups(cases.documents(spark, rows), most=most).collect()
    assert sorted((key(r["doc_id"]), r["n_shingles"], key(r["component_id"])) for r in got) == brute_components([(i, t or "") for i, t in rows])


def test_components_of_an_empty_table_and_the_kept_rows(spark):
    assert jaccard.groups(cases.empty(spark)).count() == 0
    docs = cases.documents(spark, [(1, cases.words(1, 50)), (2, cases.words(1, 50)), (3, None), (4, cases.words(2, 50))])
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]


def test_shingle_hashes_do_not_depend_on_neighbours():
    a = jaccard.shingle_sets(["Ein Wort und noch eins mehr", "", "x"])
    b = jaccard.shingle_sets(["ein  wort\tund noch\neins mehr"])
    assert np.array_equal(a[0], b[0]) and [len(s) for s in a] == [2, 0, 1]


def test_star_contraction(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (500, 500)]
    got = {r["node"]: r["root"] for r in roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 200: 100, 300: 100}


@pytest.mark.parametrize("forest", [3, 7, 1000])
def test_components_of_links_in_many_partitions(spark, forest):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))]
    root = list(range(60))
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in roots(spark.createDataFrame(edges, "a long, b long"), forest=forest).collect()}
    assert got == {i: r for i, r in enumerate(root) if i != r}
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("room", [1, 50, 10**6])
def test_shared_keys_are_tallied_whole_whatever_the_room(room):
    rng = np.random.default_rng(7)
    rows = sorted({(int(k), int(w)) for k, w in rng.integers(0, 25, (300, 2))})
    key, who = (np.array(x) for x in zip(*rows))
    size_of = rng.integers(30, 40, 25)
    code, n = jaccard.shared_keys(key.astype(np.uint64), who, np.zeros(len(key), np.uint8), size_of, 25, room)
    want = collections.Counter((a, b) for k, a in rows for j, b in rows if j == k and a < b and 4 * min(size_of[a], size_of[b]) >= 3 * max(size_of[a], size_of[b]))
    assert {(c >> 32, c & 0xFFFFFFFF): m for c, m in zip(code.tolist(), n.tolist())} == want


def test_a_family_of_distant_copies_equals_brute_force(spark):
    """Many texts of one base, most of them apart by a little more than the threshold: all steps of the second pass have work."""
    rng = np.random.default_rng(8)
    base, rows = cases.words(77, 150).split(), []
    for i in range(160):
        w = list(base)
        for at in rng.choice(len(w), int(rng.integers(2, 9)), replace=False):
            w[at] = f"y{rng.integers(12)}"
        rows.append((i, " ".join(w)))
    for most in (2, 32):
        got = jaccard.groups(cases.documents(spark, rows), most=most).collect()
        assert sorted((key(r["doc_id"]), r["n_shingles"], key(r["component_id"])) for r in got) == brute_components(rows)


def tables_of_sets(spark, sets, links=()):
    rows = [(c, len(s), sorted(s)) for c, s in sets.items()]
    return spark.createDataFrame(rows, "cls long, n int, sh array<long>"), spark.createDataFrame(list(links), "a long, b long")


def linked_sets(sets):
    return {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}


def test_a_link_whose_keys_one_other_component_holds_alone(spark):
    """Every shingle is frequent, and the larger set's keys in the smaller one's band are the smaller one's alone."""
    rng = np.random.default_rng(12)
    keys = rng.integers(-(2**62), 2**62, 64).tolist()
    sets = {1: set(keys[:48]), 2: set(keys)} | {3 + i: set(rng.choice(keys, 32, replace=False).tolist()) for i in range(120)}
    assert min(sum(k in s for s in sets.values()) for k in keys) > jaccard.FREQUENT and linked_sets(sets) == {(1, 2)}
    got = jaccard.second_pass(*tables_of_sets(spark, sets), rounds=0).collect()
    assert {(r["a"], r["b"]) for r in got} == {(1, 2)}


def test_rare_prefixes_meet_every_link_and_little_else(spark):
    """Copies of a base that differ in three tenths or less: all links are met by the prefixes, by less than a quarter of the shared shingles."""
    rng = np.random.default_rng(13)
    keys = rng.integers(-(2**62), 2**62, 2000).tolist()
    sets = {}
    for i in range(60):
        own = keys[100 * (i % 3) : 100 * (i % 3) + 100]
        gone = set(rng.choice(100, int(rng.integers(2, 30)), replace=False).tolist())
        sets[i + 1] = {k for at, k in enumerate(own) if at not in gone} | set(rng.choice(keys[300:], len(gone) // 2, replace=False).tolist())
    table, links = tables_of_sets(spark, sets)
    rows = jaccard.rare_prefixes(table, jaccard.roots(links)).collect()
    joined = [(x["cls"], y["cls"]) for x in rows for y in rows if x["key"] == y["key"] and x["cls"] < y["cls"]]
    met = set(joined)
    assert linked_sets(sets) <= met and len(joined) < sum(len(sets[a] & sets[b]) for a in sets for b in sets if a < b) / 4
    pairs = {(r["a"], r["b"]) for r in jaccard.rare_pairs(jaccard.rare_counts(table), jaccard.roots(links)).collect()}
    assert linked_sets(sets) <= pairs <= met


def test_differences_are_never_overrated():
    rng = np.random.default_rng(9)
    for _ in range(300):
        a, b = (set(rng.choice(40, rng.integers(5, 30), replace=False).tolist()) for _ in range(2))
        rare = set(rng.choice(40, 15, replace=False).tolist())
        least = max(jaccard.apart(len(a), len(b), len(a & rare), len(b & rare), len(a & b & rare)))
        assert least <= len(a ^ b)


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, key(r[0]), r[1].encode())):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        head = gone & ~np.r_[False, gone[:-1]]
        out.append((key(i), len(b), int(gone.sum()), int(head.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard", [2_000, 30_000, 10_000_000])
def test_repeats_equal_brute_force(spark, shard):
    rows = [r for r in cases.TEXTS if r[0] not in (7, 8)] + [(50, cases.words(70, 800)), (51, "x" + cases.words(70, 800)[40:900] + "é" * 120), (52, "é" * 200), (53, "\0" * 300), (54, "\0" * 150 + cases.words(1, 60))]
    got = suffix.deduplicated(cases.documents(spark, rows), digest=True, shard_bytes=shard, bucket_bytes=shard).collect()
    assert sorted((key(r["doc_id"]), *tuple(r)[1:]) for r in got) == brute_repeats([(i, t or "") for i, t in rows])


def test_a_passage_in_every_shard(spark):
    """Cut differently in each text, so that its runs are not equal and their strings are merged; rows without identifier are one shard."""
    passage = cases.words(71, 120)
    rows = [(i, cases.words(200 + i, 25) + " " + passage[7 * i % 90 : 260 + 11 * i % 140] + " " + cases.words(400 + i, 10)) for i in range(40)]
    rows += [(None, passage[i : 150 + i]) for i in range(0, 60, 3)]
    got = suffix.deduplicated(cases.documents(spark, rows), digest=True, shard_bytes=600, bucket_bytes=2000).collect()
    assert sorted((key(r["doc_id"]), *tuple(r)[1:]) for r in got) == brute_repeats(rows)


@pytest.mark.parametrize("seed", range(4))
def test_merging_of_sorted_strings(seed):
    rng = np.random.default_rng(seed)
    every = [bytes(r) for r in rng.integers(0, 3, (60, suffix.LENGTH)).astype(np.uint8)] + [b"a" * (suffix.LENGTH - k) + b"\0" * k for k in range(4)]
    held = [(s, o) for o in range([1, 2, 5, 8][seed]) for s in rng.permutation(len(every))[: rng.integers(1, len(every))].tolist()]
    origin = rng.permutation(len(held))
    first = {}
    for (s, _), at in zip(held, origin, strict=True):
        first[s] = min(first.get(s, at), at)
    strings = np.frombuffer(b"".join(every[s] for s, _ in held), f"S{suffix.LENGTH}")
    got = suffix.starts_earlier(strings, origin, np.array([o for _, o in held]))
    assert got.tolist() == [at != first[s] for (s, _), at in zip(held, origin, strict=True)]


def test_repeats_of_an_empty_table_and_the_bytes_left(spark):
    assert suffix.deduplicated(cases.empty(spark), digest=True).count() == 0
    text = cases.words(3, 60)
    rows = suffix.deduplicated(cases.documents(spark, [(1, text), (2, "AB" + text)])).orderBy("doc_id").collect()
    assert bytes(rows[0]["kept"]).decode() == text and bytes(rows[1]["kept"]) == b"AB"


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + [1, 2, 4, 26, 2, 3][seed], 700).astype(np.uint8)
    text[400:600] = text[50:250]
    order = suffix.suffix_order(text)
    raw = text.tobytes()
    cut = [raw[i : i + 128] for i in order]
    assert sorted(order.tolist()) == list(range(700)) and all(a <= b for a, b in zip(cut, cut[1:], strict=False))
    got = suffix.common_prefixes(text, order)
    for k in range(1, 700):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert (got[k] >= 100) == (n >= 100)


def test_repeats_after_neighbours_that_share_nothing(spark):
    """'Q' and 'R' are neighbours in the order without a common byte, and so are the equal texts after them."""
    text = "".join(np.random.default_rng(4).choice(list("abcdefghij "), 300))
    rows = [(1, "Q" + text), (2, "R" + text)]
    got = suffix.deduplicated(cases.documents(spark, rows), digest=True).collect()
    assert sorted((key(r["doc_id"]), *tuple(r)[1:]) for r in got) == brute_repeats(rows)
    raw = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    order = suffix.suffix_order(raw)
    assert suffix.common_prefixes(raw, order)[order.tolist().index(302)] >= 100
