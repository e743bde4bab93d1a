import numpy as np
import pandas as pd


def image_table(spark, **images):
    """image_id, y, x, v of named arrays."""
    rows = [(k, y, x, float(a[y, x])) for k, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "y", "x", "v"])).selectExpr("image_id", "cast(y as int) y", "cast(x as int) x", "v")


def array_of(df, **where):
    pdf = df.toPandas()
    for k, v in where.items():
        pdf = pdf[pdf[k] == v]
    out = np.full((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1), np.nan)
    out[pdf.y.astype(int), pdf.x.astype(int)] = pdf.v.astype(float)
    return out


def structured(n=16):
    y, x = np.mgrid[:n, :n]
    a = 0.5 + 0.18 * np.sin(2 * np.pi * x / 13) + 0.14 * np.cos(2 * np.pi * y / 9) + 0.08 * np.sin(2 * np.pi * (x + y) / 5)
    return (a - a.min()) / (a.max() - a.min())
