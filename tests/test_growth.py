"""Queries over many images keep an image as one row: no pixel is sent or sorted, and odd arrays give what the SQL gives."""

import os

import duckdb
import numpy as np
import pytest
from helpers import array_of, image_table, structured

from stillwater.operators import convolve, estimate, gather, pixel, spectral
from stillwater.plans import catalog

SF = "/root/testdata/sf0.001"
WHOLE = ["affine_sample", "const_warp", "resize_align_corners"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def assert_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{t}/*.parquet')")
    want = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, str(folder)).select(*names).collect()
    text = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert text(got) == text(want.fetchall())


@pytest.mark.parametrize("name", [*WHOLE, "resize_pixel_centre", "airy_blur_whole", "airy_blur"])
def test_no_pixel_is_sent(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize(("name", "generated"), [("registration_grid", 1), ("false_detail", 2), ("false_detail_map", 3)])  # the high-passed stack is made of pixels again, and so is a map
def test_only_the_stack_is_made_of_pixels(spark, name, generated):
    assert plan_of(catalog.QUERIES[name](spark, SF)).count("Generate ") <= generated


@pytest.mark.parametrize("name", WHOLE)
def test_odd_images_equal_sql(spark, tmp_path, name):
    full = [((7 * i) % 11) / 16 - 0.25 for i in range(64)]
    hole = [None if i == 20 else v for i, v in enumerate(full)]
    rows = [(1, full, 0), (2, full[::-1], 0), (3, full[:60], 1), (4, hole, 1), (5, full, None), (None, full, 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert_equals_sql(spark, tmp_path, name)


@pytest.mark.parametrize("shape", [(2, 2), (5, 6), (9, 3)])
def test_resizing_stacks_is_the_same(spark, shape):
    a = structured(6)
    a[0, :4] = a[3, 2] = np.nan
    t = image_table(spark, a=a)
    assert np.allclose(array_of(gather.resized_centres(t, ["image_id"], *shape)), gather.resized_centres_stack(a[None], *shape)[0], equal_nan=True)
    t = image_table(spark, a=structured(6))
    assert np.allclose(array_of(gather.resized(t, ["image_id"], *shape)), gather.resized_stack(structured(6)[None], *shape)[0])


@pytest.mark.parametrize("shape", [(6, 9), (1, 5), (2, 1)])
def test_convolving_stacks_is_the_same(spark, shape):
    a = structured(9)[: shape[0], : shape[1]]
    got = convolve.convolve_stack(a[None], convolve.airy_array(2.0, 0.0, 3.0))[0]
    assert np.allclose(array_of(convolve.convolved(image_table(spark, a=a), convolve.airy_kernel(spark, 2.0, 0.0, 3.0), ["image_id"])), got)


def test_registration_over_whole_images_is_the_same(spark):
    a = structured(12)
    reference, moving = image_table(spark, a=a, b=a.T), image_table(spark, a=np.roll(a, 1, 0), b=a)
    search = (["image_id"], (-5.0, 0.0), (1.0, 1.1), (0.0, 0.05))
    rows = pixel.imploded(moving, ["image_id"])
    got, want = (f.orderBy("image_id").toPandas() for f in (estimate.registration_whole(reference, rows, *search), estimate.registration(reference, moving, *search)))
    assert got.drop(columns="mse").equals(want[got.columns].drop(columns="mse")) and np.allclose(got.mse, want.mse)


def test_unknown_products_may_have_keys_of_customers(spark, tmp_path):
    spark.range(99998, 100004).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(3, 99999), (4, 99998), (6, 100001), (9, 100001), (12, 5)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    assert_equals_sql(spark, tmp_path, "semi_anti_products")


def test_keys_and_values_of_odd_lines_equal_sql(spark, tmp_path):
    letters = "".join(chr(i) for i in range(0x20, 0x20000) if chr(i) != "=" and not 0xD800 <= i < 0xE000)
    texts = ["straße = ß", "a /* b = c */ = d /* e */", "a = 1\r\nb = 2\rc = 3\n= \n=", "\u00a0ﬁn\u3000=\u2003x\t", "ŉ=a=b\n\nno", "", "ß", None]
    texts += [f"x{c}{letters[i:i + 50]}{c}x={c}" for i, c in enumerate(letters) if i % 50 == 0]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert_equals_sql(spark, tmp_path, "label_parse_kv")


def test_false_detail_over_whole_images_is_the_same(spark):
    a, keys = structured(12), ["image_id"]
    reference, made = image_table(spark, a=a, b=a.T), image_table(spark, a=1.6 * a - a**2, b=np.roll(a, 2, 0))
    pairs = pixel.paired(spectral.high_pass(reference, keys), spectral.high_pass(made, keys), keys)
    whole = spectral.high_joined(reference, pixel.imploded(made, keys), keys)
    for got, want in ((spectral.false_detail_whole(whole, keys), spectral.false_detail(pairs, keys)), (spectral.false_detail_map_whole(whole, keys), spectral.false_detail_map(pairs, keys))):
        by = [c for c in ("image_id", "y", "x") if c in want.columns]
        got, want = got.toPandas().sort_values(by), want.toPandas().sort_values(by)
        assert list(got[by].itertuples(index=False)) == list(want[by].itertuples(index=False)) and np.allclose(got.drop(columns=by), want[got.columns].drop(columns=by))
