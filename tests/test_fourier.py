"""Transforms of long lines, which no task holds whole."""

import numpy as np
import pytest
from helpers import array_of, grid_of
from pyspark.sql import functions as F

from latticework.operators import fourier


@pytest.mark.parametrize("shape, line", [((60,), 4), ((7,), 4), ((12, 10), 5), ((64, 9), 16), ((30, 1), 8)])
@pytest.mark.parametrize("inverse", [False, True])
def test_split_lines(spark, shape, line, inverse):
    r = np.random.default_rng(line)
    x = r.normal(size=shape) + 1j * r.normal(size=shape)
    axes = [f"i{k}" for k in range(len(shape))]
    rows = [(*map(int, c), float(x[c].real), float(x[c].imag)) for c in np.ndindex(*shape)]
    df = spark.createDataFrame(rows, ", ".join([*[f"{a} int" for a in axes], "re double", "im double"]))
    want = np.fft.ifftn(x) if inverse else np.fft.fftn(x)
    got = fourier.fft(df, axes, inverse=inverse, extent=shape, line=line).collect()
    assert len(got) == x.size
    assert max(abs(complex(q["re"], q["im"]) - want[tuple(q[a] for a in axes)]) for q in got) < 1e-9


def test_a_line_of_a_million(spark):
    n = 1 << 20
    at = F.col("id")
    line = spark.range(n).select(at.cast("int").alias("i0"), ((at * at + 3 * at) % 1009 - 500).cast("double").alias("re"), F.lit(0.0).alias("im"))
    longest = []
    real = fourier.along

    def along(df, axis, rest, inverse):
        longest.append(df.groupBy(*rest).count().agg(F.max("count")).first()[0])
        return real(df, axis, rest, inverse)

    fourier.along = along
    try:
        got = fourier.fft(line, ["i0"], extent=(n,)).where("i0 % 65537 < 3").collect()
    finally:
        fourier.along = real
    k = np.arange(n, dtype=np.int64)
    want = np.fft.fft(((k * k + 3 * k) % 1009 - 500).astype(float))
    assert longest == [1024, 1024] and len(got) == 48
    assert max(abs(complex(q["re"], q["im"]) - want[q["i0"]]) for q in got) < 1e-5 * np.abs(want).max() * 1e-3


def test_back_and_forth_keyed(spark):
    a = np.random.default_rng(3).integers(0, 9, (18, 5))
    g = grid_of(spark, a)
    both = g.df.selectExpr("'a' as name", "*").union(g.df.selectExpr("'b' as name", "i0", "i1", "v * 2"))
    there = fourier.fft(both.selectExpr("name", "i0", "i1", "cast(v as double) re", "0.0D im"), ["i0", "i1"], ["name"], extent=(18, 5), line=6)
    back = fourier.fft(there, ["i0", "i1"], ["name"], True, (18, 5), 6)
    for name, times in (("a", 1), ("b", 2)):
        got = array_of(type(g)(back.where(F.col("name") == name).select("i0", "i1", F.col("re").alias("v")), g.axes, g.extent))
        assert np.abs(got - times * a).max() < 1e-9
