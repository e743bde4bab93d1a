import collections
import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import cases
from stillwater.llm import bpe, html_text, mixing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = bpe.Encoder()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aab 'stll\n\t1é中 <|endoftext|>", max_size=80)))
def test_ids_equal_the_library(text):
    ids = ENCODER.encode([text])[0]
    want = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want and ENCODER.decode(ids) == TOKENIZER.decode(want, skip_special_tokens=False)


def test_digests_of_awkward_rows(spark):
    got = collections.Counter(tuple(r) for r in bpe.digests(cases.documents(spark)).collect())
    want = collections.Counter()
    for i, t in cases.clean():
        ids = TOKENIZER.encode(t, add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert got == want
    assert bpe.digests(cases.empty(spark)).count() == 0
    rows = bpe.encoded(cases.documents(spark, [(1, "some text"), (2, None)])).orderBy("doc_id").collect()
    assert rows[0]["decoded"] == "some text" and rows[1]["ids"] == [] and rows[1]["decoded"] == ""


def test_repeated_symbols_merge_from_the_left():
    words = [b"a" * n for n in range(1, 40)]
    got = bpe.merge_words(words, ENCODER.v)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [TOKENIZER.encode(w.decode()).ids for w in words]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "中文字汉语", "aA1"])
def test_long_words_equal_the_library_in_linear_time(letters):
    rng = np.random.default_rng(5)
    for n in (bpe.LONG - 1, bpe.LONG + 1, 3_000, 60_000):
        word = "".join(rng.choice(list(letters), n))
        assert np.frombuffer(ENCODER.encode(["x " + word])[0], "<u4").tolist() == TOKENIZER.encode("x " + word, add_special_tokens=False).ids
    began = time.time()
    ENCODER.encode(["".join(rng.choice(list(letters), 400_000))])
    assert time.time() - began < 20


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aab 'thein\n1é中", min_size=1, max_size=80))
def test_rounds_of_one_word_equal_rounds_of_many(text):
    raw = text.encode()
    assert bpe.merge_long(raw, ENCODER.v) == bpe.merge_words([raw], ENCODER.v)[0]


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    encoder = bpe.Encoder()
    texts = [cases.words(i % 7, 30) for i in range(40)]
    assert [encoder.encode([t])[0] for t in texts] == [ENCODER.encode([t])[0] for t in texts] and len(encoder.memo) < 60


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body class="has-sidebar"><nav><a href="/">menu</a></nav>
<div class="cookie-notice">A long notice about cookies that goes on and on so that it looks like a paragraph of the text itself, which it is not.</div>
<div class="content-with-sidebar">%s</div><aside>%s</aside><div id="comments"><div class="comment"><p>%s</p></div></div><form><p>Your name <input> and address, please, and more</p></form><footer>&copy; me</footer></body></html>"""


def test_article_is_found_with_and_without_its_mark():
    long = " ".join(["word"] * 60)
    body = f"<h2>Title &amp; more</h2><p>{long}</p><p>Short&nbsp;one.</p><p><b>{long} &eacute;\n  end<br>line"
    want = f"Title & more\n\n{long}\n\nShort one.\n\n{long} é end line"
    assert html_text.extract(PAGE % (f"<article>{body}</article>", long, long)) == want
    assert html_text.extract(PAGE % (body, long, long)) == want


def test_line_lengths_decide_on_marked_pages_too():
    long = " ".join(["word"] * 60)
    few = "<p>Share</p><p>Print</p><p>3 min</p><p>Save</p>"
    assert html_text.extract(f"<article>{few}<p>{long}</p><p>Short.</p></article>") == f"{long}\n\nShort."
    assert html_text.extract(f"<article>{few}</article><p>{long}</p>") == f"Share\n\nPrint\n\n3 min\n\nSave\n\n{long}"
    assert html_text.extract(f"<article><p>{long}</p></article><p>{'word ' * 30}</p>") == long


@pytest.mark.parametrize("many", ["<table>" + "<tr><td>a<td>b" * 200 + "</table>", "<table>" + "<tr><th>a<td><b>b" * 200, "<dl>" + "<dt>a<dd>b" * 200 + "</dl>", "<div>" * 200, "<div><span>" * 200])
def test_end_tags_are_found_at_any_depth(many):
    long, after = " ".join(["word"] * 60), "<p>" + "after " * 25
    for tag in ("aside", "nav", "form"):
        assert html_text.extract(f"<{tag}>{many}</{tag}><p>{long}</p>") == long
    assert html_text.extract(f"<article><p>{long}</p><aside>{many}</aside></article>{after}") == long


def test_cells_rows_and_terms_end_with_the_next():
    rows = "<tr><td class=ad>ad<td>cell<tr><td>" + "word " * 30
    assert html_text.extract(f"<article><table>{rows}</table></article>").split("\n\n")[0].startswith(("cell", "word"))
    inner = "<table><tr><td>a<table><tr><td>b</table>c<td>" + "word " * 30 + "</table>"
    assert html_text.extract(f"<article>{inner}</article>").endswith("word")
    long = " ".join(["word"] * 60)
    assert html_text.extract(f"<dl><dt class=ad>x<dd>{long}<dt class=ad><b>y<dd>{long}</dl>") == f"{long}\n\n{long}"
    assert html_text.extract(f"<ul><li class=ad><b>x<li>{long}</ul>") == long


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>", ""), ("plain text " * 20, ("plain text " * 20).strip()), ("<article>x</article>", "x"), ("<article><p>a < b &am", "a < b &am"), ("<article>a<!-- b", "a"), ("<article>a<script>b", "a"), ("<article><p title='>'>a</p></article><p", "a"), ("<article><p>a</article></p></div>", "a")])
def test_odd_pages(page, text):
    assert html_text.extract(page) == text


@pytest.mark.parametrize("name", ["share-of-market", "search-engines-history", "social-science", "related-work", "discussion", "header-compression"])
def test_names_of_content_are_kept(name):
    long = " ".join(["word"] * 60)
    assert html_text.extract(f'<article><div class="{name}"><p>{long}</p></div></article>') == long


@pytest.mark.parametrize("name", ["ad", "share-buttons", "social-links", "search-form", "related-posts", "cookie-banner", "site-footer", "comment-list", "user-comments"])
def test_names_of_boxes_are_not(name):
    long = " ".join(["word"] * 60)
    assert html_text.extract(f'<article><p>{long}</p><div class="{name}"><p>{long} no</p></div></article>') == long


def test_short_pages_without_a_mark_are_kept():
    assert html_text.extract("<nav>menu</nav><p>One short paragraph.</p><footer>f</footer>") == "One short paragraph."
    assert html_text.extract(f"<nav>{'<span>' * 70}menu</nav><p>short</p>") == "short"


def test_pages_table(spark):
    rows = [(1, "u", "<article>x &amp; y</article>", 5), (2, None, None, 6), (2, None, None, 6), (None, "v", "<p>" * 5000, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(map(tuple, html_text.extracted(df).collect()), key=str)
    assert got == sorted([(1, "u", "x & y", 5), (2, None, "", 0), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert html_text.extracted(df.limit(0)).count() == 0


def brute_raking(cells, targets, rounds=200):
    w = {k: float(n) for k, n in cells.items()}
    total = sum(w.values())
    for _ in range(rounds):
        for d in range(3):
            sums = collections.defaultdict(float)
            for k, v in w.items():
                sums[k[d]] += v
            w = {k: v * targets[d][k[d]] * total / sums[k[d]] for k, v in w.items()}
    return {k: w[k] / cells[k] for k in cells}


def test_raking_equals_brute_force_and_meets_its_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 30)), ["en", "de"][int(rng.integers(2))], f"s{int(rng.integers(3))}", 1, "", 0.0, True, 0, 0, "", ["a", "b"][int(rng.integers(2))]) for i in range(400)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    targets = {"source": {"s0": 0.5, "s1": 0.3, "s2": 0.2}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"a": 0.7, "b": 0.3}}
    got = mixing.mixed(docs, targets, topic=docs["topic"]).collect()
    cells = collections.Counter()
    for r in rows:
        cells[(r[3], r[2], r[11])] += len(r[1].split())
    want = brute_raking(cells, [targets[d] for d in ("source", "lang", "topic")])
    for r in got:
        assert r["__weight"] == pytest.approx(want[(r["source"], r["lang"], r["topic"])], rel=1e-6)
        assert 0 < r["__probability"] <= 1
    assert max(r["__probability"] for r in got) == pytest.approx(1)


def test_sampling_is_by_identifier_and_awkward_rows_pass(spark):
    docs = cases.documents(spark)
    once, again = (sorted(map(str, mixing.sample(docs).collect())) for _ in range(2))
    assert once == again and mixing.sample(docs).columns == docs.columns
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(cases.TEXTS) and all(r["__weight"] is not None for r in rows)
    assert {r["__lang"] for r in rows if r["doc_id"] == 9} == {"(null)"}
    assert mixing.mixed(cases.empty(spark)).count() == 0
