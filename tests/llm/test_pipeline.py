import hashlib
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import cases
import corpus_pipeline

FULL = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Documents with planted copies, near copies and insults, and their labels."""
    d = tmp_path_factory.mktemp("corpus")
    rows, labels = [], []
    for i in range(240):
        w = cases.words(i, 60).split()
        if i % 6 == 0:
            for at in (5, 25, 45):
                w.insert(at, "rotzlump")
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(300 + i, cases.words(i, 60).replace(" ", "  ")) for i in (1, 2, 3)]  # exact copies, longer in white space
    rows += [(400 + i, cases.words(i, 60) + " tail") for i in (7, 8, 9)]  # near copies
    rows += [(500, None), (501, "")]
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "text": t, "lang": "en", "source": f"s{i % 3}", "n_chars": len(t or "")} for i, t in rows], pa.schema(FULL)), d / "documents.parquet")
    pq.write_table(pa.Table.from_pylist([dict(zip(("doc_id", "quality", "toxic"), x, strict=True)) for x in labels], pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])), d / "labels.parquet")
    return str(d), dict(rows)


def test_stages_take_effect(spark, folder, tmp_path):
    sf, texts = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [set(texts)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == [c for c, _ in FULL]
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    toxic = {i for i in range(240) if i % 6 == 0}
    assert len(kept[1] & toxic) <= 2 and len((kept[0] - toxic) - kept[1]) <= 3
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in texts.items()}
    want = set()
    for n in {norm[i] for i in kept[1]}:
        want.add(min((i for i in kept[1] if norm[i] == n), key=lambda i: (-len(texts[i] or ""), i)))
    assert kept[2] == want
    assert not kept[3] & {407, 408, 409} & {400 + i for i in (7, 8, 9) if i in kept[2]}
    assert kept[2] - kept[3] <= {407, 408, 409}
    assert kept[4] <= kept[3] and len(kept[4]) > 0.3 * len(kept[3])
    last = {r["doc_id"]: r for r in docs.collect()}
    assert set(last) == kept[4] and all(r["decoded_sha256"] == hashlib.sha256((texts[i] or "").encode()).hexdigest() and len(r["ids"]) == r["n_tokens"] for i, r in last.items())


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 50


CLASHES = ("__id", "__sha", "__n", "__row", "__tokens", "__topic", "__weight", "__sampled", "__salt", "whole", "own", "sha", "n", "t", "nth", "cls", "salt", "root")


@pytest.mark.parametrize("stage", [1, 2, 3])
@pytest.mark.parametrize("repeated", [False, True])
def test_stages_keep_columns_of_any_name(spark, stage, repeated):
    rows = [(i, t) for i, t in cases.TEXTS if i not in (7, 8)]
    rows = rows if repeated else list({i: (i, t) for i, t in rows}.values())
    docs = cases.documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", *(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES))
    got = corpus_pipeline.STAGES[stage][1](spark, docs, "").collect()
    assert got and got[0].__fields__ == docs.columns
    assert all(r[c] == (None if r["doc_id"] is None else f"{c}:{r['doc_id']}") for r in got for c in CLASHES)


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None)], [(1, "")], [(1, "a b"), (1, "a b")]])
def test_stages_of_hardly_any_rows(spark, rows, tmp_path):
    docs = cases.documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())}), tmp_path / "labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() <= len(rows)
