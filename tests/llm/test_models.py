import os
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import cases
from stillwater.llm import labelled, neighbours, pii, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def test_fixed_patterns():
    text = "mail a.b@c-d.example.org, x@y, @z.com a@b.c@d.e 1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 card 4111 1111-1111 1111 and 4111111111111112 call +1 (555) 010-9999 or +12 3."
    import re

    want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            want.append(("card", m.start(), m.end()))
    want += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    assert pii.base_spans(text) == want and len(want) == 7


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 100_000, "@" * 100_000, "a@" * 50_000, "1 " * 100_000, "=" * 100_000])
def test_long_runs_stay_linear(text):
    import time

    began = time.time()
    pii.proposed(text, pii.base_spans(text))
    assert time.time() - began < 5


def test_expectation_maximisation_finds_the_reliable_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    votes = np.zeros((4000, pii.LABELERS), np.int64)
    for i, accuracy in enumerate((0.95, 0.9, 0.85, 0.6)):
        right = rng.random(4000) < accuracy
        votes[:, i] = np.where(truth == right, pii.YES, pii.NO)
    found, p = pii.reliabilities(votes, np.ones(4000))
    assert ((found > 0.5) == truth).mean() > 0.95 and p[0, 1, pii.YES] > p[3, 1, pii.YES]


def test_spans_are_added_and_none_taken(spark):
    rows = [(i, f'word {i} token = "{i:040x}deadbeef" and {i}') for i in range(30)] + [(100, None), (101, ""), (102, "plain words only"), (103, "write to me[at]host.example.org")]
    got = {r["doc_id"]: r for r in pii.report(cases.documents(spark, rows)).collect()}
    assert all(got[i]["spans"].startswith("secret:") for i in range(30)) and got[100]["spans"] == got[102]["spans"] == ""
    assert got[100]["base_sha256"] == pii.sha_of([]) and pii.report(cases.empty(spark)).count() == 0
    assert pii.report(cases.documents(spark)).count() == len(cases.TEXTS)


@pytest.mark.parametrize("span,kind", [("AKIA" + "ABCDEFGH12345678", "secret"), ("ab1" * 150, "secret"), ("DE89 3704 0044 0532 0130 00", "number"), ("GB29 NWBK 6016 1331 9268 19", "number"), ("030 12 34 56 78 90 12 34", "number"), ("someone.with.a.very.long.name.of.more.than.forty.letters (at) example (dot) org", "contact")])
def test_spans_of_any_length_are_proposed_whole(span, kind):
    text = f"write to: {span} now"
    assert [(k, text[a:b]) for k, a, b, _ in pii.proposed(text, [])] == [(kind, span)]


def test_proposals_keep_clear_of_fixed_spans_and_stay_linear():
    assert pii.disjoint([(5, 9), (0, 3), (2, 4), (9, 12)]) == ([0, 5, 9], [4, 9, 12])
    text = "mail a@b.co and 123 45 67 89 and key abcdefghij0123456789abcd " * 20_000
    began = time.time()
    base = pii.base_spans(text)
    more = pii.proposed(text, base)
    assert len(base) == 20_000 and len(more) == 40_000 and time.time() - began < 15
    held = sorted((a, b) for _, a, b, *_ in [*base, *more])
    assert all(b <= c for (_, b), (c, _) in zip(held, held[1:], strict=False))
    for run in ("a" * 400_000, "1 " * 200_000, "A1/" * 150_000, "a.b-" * 100_000):
        began = time.time()
        pii.proposed(run, pii.base_spans(run))
        assert time.time() - began < 5


def test_letters_of_every_script_have_symbols():
    fold = lambda t: toxicity.folded([t])[0][1 : 1 + len(t)].tolist()
    assert all(x > 0 for x in fold("идиотκακός笨蛋")) and fold("ИДИОТ") == fold("идиот") and fold("ｒｏｔｚ") == fold("rotz") and fold("rōtz") == fold("rotz")
    assert fold("“—”") == [0, 0, 0] and toxicity.latin("ro\u200btz") == b"rotz"


def test_insults_of_another_script_are_learnt():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("абвгдежзиклмнопрст"), 6))
    rows = [(" ".join([*(word() for _ in range(20)), *(["дурачина"] if i % 2 else []), word()]), i % 2) for i in range(200)]
    model = toxicity.train(rows, [0.5, 0.5])
    scores = model.score([f"{word()} {word()} дурачина {word()}", f"{word()} {word()} {word()}"])
    assert scores[0] > 0.5 > scores[1]


def test_queries_return_the_columns_of_their_contract(spark):
    """Types, held-out rows and the rule for ``predicted`` of the thin queries, on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    score = [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    want = {
        "op1_pii": [("doc_id", "bigint"), ("n_email", "bigint"), ("n_ip", "bigint"), ("n_card", "bigint"), ("n_phone", "bigint"), ("base_sha256", "string"), ("spans", "string")],
        "op2_quality": score,
        "op4_html_text": [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")],
        "op10_toxicity": score,
    }
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, sf)
        assert df.dtypes[: len(columns)] == columns
        rows = df.collect()
        if columns is score:
            n, left = (5, 0) if name == "op2_quality" else (4, 2)
            assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == left) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
        if name == "op1_pii":
            for r in rows:
                base = pii.base_spans(texts[r["doc_id"]])
                assert r["base_sha256"] == pii.sha_of(base) and r["spans"].startswith(pii.spelled(base))
                assert r["n_email"] == sum(k == "email" for k, _, _ in base)
        if "doc_id" in df.columns:
            assert sorted(r["doc_id"] for r in rows) == sorted(texts)


def test_toxic_documents_held_out_are_caught_and_clean_ones_left(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    scores = queries.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    caught = scores[scores.toxic == 1].predicted.mean()
    right = scores[scores.predicted == 1].toxic.mean()
    assert caught > 0.7 and right > 0.75


def test_remainder_is_of_the_identifier_as_text(spark):
    rows = spark.range(50).select("id", labelled.remainder("id", 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_scores_without_labels_and_of_awkward_texts(spark, operator):
    docs = cases.documents(spark)
    for labels in ([], [(1, 1, 1), (None, 0, 0), (2, None, None)]):
        model = operator.fit(docs, spark.createDataFrame(labels, LABELS), F.lit(True))
        got = [r["score"] for r in operator.scored(docs, model).collect()]
        assert len(got) == len(cases.TEXTS) and all(0 <= s <= 1 for s in got) and len(set(got)) == 1
        assert operator.scored(cases.empty(spark), model).count() == 0


def test_scores_do_not_depend_on_neighbours():
    rows = [(cases.words(i, 40) + (" %%% $$$" * 5 if i % 2 else ""), i % 2) for i in range(60)]
    model = quality.train(rows, [0.5, 0.5], epochs=3)
    texts = ["", "x", rows[0][0], rows[1][0], "é" * 50]
    together, alone = model.score(texts), [model.score([t])[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-9) and model.score([rows[3][0]])[0] > 0.5 > model.score([rows[2][0]])[0]


def test_gapped_insults_are_found():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        w = cases.words(1000 + i, 40).split()
        if i % 2:
            for _ in range(2):
                w.insert(int(rng.integers(len(w))), ["rotzlump", "quwazzok"][int(rng.integers(2))])
        rows.append((" ".join(w), i % 2))
    model = toxicity.train(rows, [0.5, 0.5])
    clean = " ".join(cases.words(5000, 60).split())
    score = lambda insult: model.score([clean + f" {insult} " + clean])[0]
    base = model.score([clean])[0]
    assert base < 0.3 < score("rotzlump") and score("rotzxlump") > 0.3 and score("quwazz-ok") > 0.3 and score("rotz_lump") > 0.3
    texts = ["", clean, "rotzlump", "x"]
    assert np.array_equal(model.score(texts), np.concatenate([model.score([t]) for t in texts]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("operator,label,modulus,rest,least", [(quality, "quality", 5, 0, 0.97), (toxicity, "toxic", 4, 2, 0.9)])
def test_held_out_accuracy(spark, operator, label, modulus, rest, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = labelled.remainder("doc_id", modulus)
    model = operator.fit(docs, labels, held != rest, per_class=800)
    some = docs.join(F.broadcast(labels.filter(held == rest)), "doc_id")
    scores = operator.scored(some, model).toPandas().merge(labels.toPandas(), on="doc_id")
    assert ((scores.score >= 0.3) == (scores[label] == 1)).mean() >= least


VECTORS = "vec_id long, embedding array<float>, label int, score double, rank int, leaf long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0, 0, 0) for i, v in rows], VECTORS)


def brute(rows, k=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % 20 == 0:
            near = sorted(((-float((b * a).sum()), i) for i, b in good if i != q))[:k]
            out[q] = [i for _, i in near]
    return out


def found(spark, rows):
    got = {}
    for r in neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def test_neighbours_recall_and_order(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.3 * rng.normal(size=16)]) for i in range(3000)]
    want, got = brute(rows), found(spark, rows)
    recall = np.mean([len(set(want[q]) & set(got[q])) / 20 for q in want])
    assert recall >= 0.95


def test_recall_on_the_embeddings_table(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(table.embedding.to_numpy()).astype(float), table.vec_id.to_numpy()
    got = queries.op8_neighbours(spark, sf).toPandas()
    assert list(got.columns[:4]) == ["query_id", "rank", "vec_id", "score"]
    recall = []
    for q, rows in got.groupby("query_id"):
        score = x @ x[ids == q][0]
        best = [ids[i] for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        recall.append(len(set(best) & set(rows.vec_id)) / 20)
    assert len(recall) == (ids % 20 == 0).sum() and np.mean(recall) >= 0.9


def test_repeated_rows_take_no_neighbours_place(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.3 * rng.normal(size=16)]) for i in range(3000)]
    want, got = brute(rows), found(spark, rows * 2)
    assert got == found(spark, rows) and all(len(got[q]) == 20 for q in want)
    assert np.mean([len(set(want[q]) & set(got[q])) / 20 for q in want]) >= 0.95


def test_neighbours_of_equal_and_unusable_vectors(spark):
    same = [1.0] + [0.0] * 15
    rows = [(i, same) for i in range(60)] + [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [float("inf")] + [1.0] * 15), (104, [1.0] * 3), (105, [None] + [1.0] * 15), (120, [0.5] * 16)]
    assert found(spark, rows) == brute(rows)
    few = [(0, same), (1, [0.5] * 16), (2, same)]
    assert found(spark, few) == {0: [2, 1]}
    assert neighbours.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_of_queries_and_bounded_output(spark, monkeypatch):
    """Several blocks of queries give what one gives, and no batch is a row a query and leaf with its vector."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(3000)]
    want = found(spark, rows)
    monkeypatch.setattr(neighbours, "QUERIES", 40)
    assert found(spark, rows) == want and len(want) == 150
    x = np.array([v for _, v in rows])
    index = neighbours.Index(16, float(np.sqrt((x * x).sum(1)).max()), x, 200_000, 0.99)
    block = neighbours.Block(index, np.arange(3000), x)
    leaves = index.tree.leaf(index.project(x))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(list(x)), pa.array(leaves)], names=["vec_id", "v", "leaf"])
    out = list(neighbours.search(index, block, [batch], 20, False))
    assert sum(b.num_rows for b in out) == 60_000 and max(b.nbytes for b in out) <= 2_400_000 and len(index.tree.low) >= 128


def test_chi_square_quantile():
    assert neighbours.chi_square_quantile(0.95, 6) == pytest.approx(12.5916, abs=1e-3)
