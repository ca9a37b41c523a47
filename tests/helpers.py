"""Small frames for the tests."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

START = datetime(2008, 1, 1)


def series(spark, values, step=timedelta(hours=1), start=START, name="a", column="y"):
    rows = [(name, start + i * step, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"series_id string, ts timestamp_ntz, {column} double")


def union(*frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def column(df, name, order="ts"):
    return [r[name] for r in df.orderBy("series_id", order).select(name).collect()]


def seasonal_values(n, seed=42, noise=0.1):
    """A daily cycle with noise, floored at 0.05."""
    rng = random.Random(seed)
    return [max(0.05, 1 + 0.8 * math.sin(2 * math.pi * (i % 24 - 6) / 24) + rng.gauss(0, noise)) for i in range(n)]


def holes(values, share, seed):
    """Some values replaced by null, in runs of random length."""
    rng = random.Random(seed)
    out, i = list(values), 0
    while i < len(out):
        if rng.random() < share:
            for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 9, 30])):
                if i < len(out):
                    out[i] = None
                    i += 1
        i += 1
    return out


def same(a, b, on=("series_id", "ts"), tol=1e-9):
    """Two frames hold the same rows; doubles within a tolerance."""
    assert sorted(a.columns) == sorted(b.columns)
    names = list(a.columns)
    ra, rb = a.orderBy(*on).select(*names).collect(), b.orderBy(*on).select(*names).collect()
    assert len(ra) == len(rb)
    for x, y in zip(ra, rb):
        for n in names:
            u, v = x[n], y[n]
            if isinstance(u, float) and isinstance(v, float):
                assert abs(u - v) <= tol * max(1.0, abs(u)), (n, x, y)
            else:
                assert u == v, (n, x, y)


def all_null(df, name):
    return df.filter(F.col(name).isNotNull()).count() == 0
