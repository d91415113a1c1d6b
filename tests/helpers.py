import numpy as np

from latticework.grid import Grid


def grid_of(spark, array, kind="bigint"):
    """Grid of a numpy array whose first axis is axis 0."""
    a = np.asarray(array)
    axes = [f"i{k}" for k in range(a.ndim)]
    rows = [(*map(int, c), a[c].item()) for c in np.ndindex(*a.shape)]
    cols = ", ".join([f"{x} int" for x in axes] + [f"v {kind}"])
    return Grid(spark.createDataFrame(rows, cols), tuple(axes), a.shape)


def array_of(g):
    out = np.empty(g.extent, object)
    rows = g.df.select(*g.axes, g.value).collect()
    assert len(rows) == g.size
    for r in rows:
        out[tuple(r[: g.dims])] = r[g.dims]
    return np.array(out.tolist())


def filled(*extent):
    """1, 2, 3, ... with axis 0 fastest."""
    return np.arange(1, np.prod(extent) + 1).reshape(extent[::-1]).T
