"""Grid queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import math
from dataclasses import replace
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as fn
from ..grid import Grid, raster
from ..operators import arith, distance, fit, flow, fourier, histogram, interp, linalg, prefix, reduce, render, stencil, tiles, tomography
from ..streaming import ring

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            here, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
            paths["PYTHONPATH"] = ":".join(dict.fromkeys([here, *filter(None, paths.get("PYTHONPATH", "").split(":"))]))
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def qd(s: SparkSession, d: str) -> Grid:
    """Line items by quantity (50) and discount in percent (11)."""
    return raster(table(s, d, "lineitem").select("l_quantity", "l_discount"), {"i0": (F.col("l_quantity").cast("int") - 1, 50), "i1": (F.round(F.col("l_discount") * 100).cast("int"), 11)})


def qdt(s: SparkSession, d: str) -> Grid:
    """Line items by quantity, discount and tax (9)."""
    pct = lambda c: F.round(F.col(c) * 100).cast("int")
    return raster(table(s, d, "lineitem").select("l_quantity", "l_discount", "l_tax"), {"i0": (F.col("l_quantity").cast("int") - 1, 50), "i1": (pct("l_discount"), 11), "i2": (pct("l_tax"), 9)})


def _day(c: str):
    return F.datediff(F.to_date(c), F.lit("2024-01-01").cast("date"))


def ev(s: SparkSession, d: str) -> Grid:
    """Events by hour (24) and day (30)."""
    return raster(table(s, d, "events").select("ts"), {"i0": (F.hour("ts"), 24), "i1": (_day("ts"), 30)})


def evch(s: SparkSession, d: str) -> Grid:
    """Events by type in alphabetical order (5), hour and day."""
    rows = table(s, d, "events").select("ts", "event_type")
    kinds = rows.groupBy("event_type").agg(F.count(F.lit(1))).select("event_type")  # a handful of types
    number = kinds.join(kinds.withColumnRenamed("event_type", "other"), F.col("other") < F.col("event_type"), "left").groupBy("event_type").agg(F.count("other").cast("int").alias("c"))
    return raster(rows.join(number, "event_type").drop("event_type"), {"c": (F.col("c"), 5), "i0": (F.hour("ts"), 24), "i1": (_day("ts"), 30)})


def frames(s: SparkSession, d: str) -> tuple[Grid, Grid]:
    """The first and the second 15 days of the events."""
    g = ev(s, d)
    return g.view((0, 0), (23, 14)), g.view((0, 15), (23, 29))


QD = "qd AS (SELECT CAST(l_quantity AS INT) - 1 AS i0, CAST(round(l_discount * 100) AS INT) AS i1, count(*) AS v FROM lineitem GROUP BY 1, 2)"
QDT = """l3 AS (SELECT CAST(range AS INT) AS i0 FROM range(50)), l4 AS (SELECT CAST(range AS INT) AS i1 FROM range(11)), l5 AS (SELECT CAST(range AS INT) AS i2 FROM range(9)),
q0 AS (SELECT CAST(l_quantity AS INT) - 1 AS i0, CAST(round(l_discount * 100) AS INT) AS i1, CAST(round(l_tax * 100) AS INT) AS i2, count(*) AS v FROM lineitem GROUP BY 1, 2, 3),
qdt AS (SELECT i0, i1, i2, coalesce(v, 0) AS v FROM l3 CROSS JOIN l4 CROSS JOIN l5 LEFT JOIN q0 USING (i0, i1, i2))"""
LAT = "lx AS (SELECT CAST(range AS INT) AS i0 FROM range(24)), ly AS (SELECT CAST(range AS INT) AS i1 FROM range(30))"
EV = LAT + """, e0 AS (SELECT CAST(hour(ts) AS INT) AS i0, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS i1, count(*) AS v FROM events GROUP BY 1, 2),
ev AS (SELECT i0, i1, coalesce(v, 0) AS v FROM lx CROSS JOIN ly LEFT JOIN e0 USING (i0, i1))"""
EVCH = LAT + """, kinds AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS c FROM (SELECT DISTINCT event_type FROM events)),
e1 AS (SELECT c, CAST(hour(ts) AS INT) AS i0, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS i1, count(*) AS v FROM events JOIN kinds USING (event_type) GROUP BY 1, 2, 3),
lc AS (SELECT CAST(range AS INT) AS c FROM range(5)),
evch AS (SELECT c, i0, i1, coalesce(v, 0) AS v FROM lc CROSS JOIN lx CROSS JOIN ly LEFT JOIN e1 USING (c, i0, i1))"""
MASK = QD + ", m AS (SELECT i0, i1, v > (SELECT avg(v) FROM qd) AS fg FROM qd)"


def mask(s: SparkSession, d: str) -> Grid:
    g = qd(s, d)
    mean = g.df.agg(F.avg("v").alias("mean"))
    return replace(g, df=g.df.join(F.broadcast(mean)).select("i0", "i1", (F.col("v") > F.col("mean")).cast("int").alias("v")))


def taps_sql(src: str, n0: int, n1: int, border: str, value: str, r0: int = 1, r1: int | None = None, w: str = "1", group: str = "") -> str:
    """Gather form of a stencil over ``src``: the sum of w over offsets dx, dy."""
    r1 = r0 if r1 is None else r1

    def f(x: str, n: int) -> str:
        if border == "clamp":
            return f"greatest(0, least({n - 1}, {x}))"
        if border == "wrap":
            return f"CASE WHEN {x} < 0 THEN {x} + {n} WHEN {x} >= {n} THEN {x} - {n} ELSE {x} END"
        return f"CASE WHEN {x} < 0 THEN -({x}) - 1 WHEN {x} >= {n} THEN {2 * n} - ({x}) - 1 ELSE {x} END"

    x, y = "(c.i0 + t.dx)", "(c.i1 + t.dy)"
    return f"""(SELECT o0 AS i0, o1 AS i1{group}, {value} AS v FROM (SELECT c.i0 AS o0, c.i1 AS o1, t.dx, t.dy, {f(x, n0)} AS i0, {f(y, n1)} AS i1 FROM {src} c,
 (SELECT a AS dx, b AS dy FROM range({-r0}, {r0 + 1}) x(a), range({-r1}, {r1 + 1}) y(b)) t) g JOIN {src} USING (i0, i1) GROUP BY o0, o1{group})"""


def big(c: str) -> str:
    return f"CAST({c} AS BIGINT)"


def i(c) -> F:
    return F.col(c)


# ---- rasters and views


@query(f"WITH {QD} SELECT * FROM qd")
def raster_qd(s, d):
    return qd(s, d).df


@query(f"WITH {EVCH} SELECT * FROM evch")
def raster_evch_dense(s, d):
    return evch(s, d).df


@query(f"WITH {QD} SELECT CAST((i0 - 3) // 2 AS INT) AS i0, CAST(i1 // 5 AS INT) AS i1, v FROM qd WHERE i0 BETWEEN 3 AND 40 AND (i0 - 3) % 2 = 0 AND i1 % 5 = 0")
def view_decimate(s, d):
    return qd(s, d).view((3, 0), (40, -1), (2, 5)).df


@query(f"WITH {QD} SELECT 49 - i0 AS i0, i1, v FROM qd")
def view_mirror(s, d):
    return qd(s, d).mirror(0).df


@query(f"WITH {QD} SELECT CAST((46 - i0) // 3 AS INT) AS i0, i1 - 2 AS i1, v FROM qd WHERE i0 BETWEEN 5 AND 46 AND (46 - i0) % 3 = 0 AND i1 BETWEEN 2 AND 9")
def view_negstep(s, d):
    return qd(s, d).view((5, 2), (-4, -2), (-3, 1)).df


@query(f"WITH {EVCH} SELECT i0, i1, v FROM evch WHERE c = 2")
def slice_channel(s, d):
    return evch(s, d).slice(0, 2).df


@query(f"WITH {QD} SELECT i1 AS i0, i0 AS i1, v FROM qd")
def swap_axes(s, d):
    return qd(s, d).swap_axes(0, 1).df


@query(f"WITH {EVCH} SELECT 0 AS a, 1 AS b, c AS x, i0 AS y, v FROM evch WHERE i1 = 4 UNION ALL SELECT 0, 2, c, i1, v FROM evch WHERE i0 = 9 UNION ALL SELECT 1, 2, i0, i1, v FROM evch WHERE c = 1")
def pairwise_planes(s, d):
    return evch(s, d).planes((1, 9, 4))


@query(f"WITH {QD} SELECT (i0 + 25) % 50 AS i0, (i1 + 5) % 11 AS i1, v FROM qd")
def fftshift(s, d):
    return qd(s, d).shift().df


@query(f"WITH {QD} SELECT v FROM qd WHERE i0 = 7 AND i1 = 3")
def element_at(s, d):
    return qd(s, d).at(7, 3).select("v")


@query(f"WITH {QD} SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY i1, i0) AS cells FROM qd")
def text_dump(s, d):
    return qd(s, d).blocks().select(F.array_join("payload", ",").alias("cells"))


# ---- elementwise


@query(f"""WITH {QD}, m AS (SELECT 49 - i0 AS i0, i1, v AS w FROM qd) SELECT i0, i1, v + w AS add_v, v - w AS sub_v, v * w AS mul_v, v // w AS div_v, v % w AS mod_v FROM qd JOIN m USING (i0, i1)""")
def arith_all(s, d):
    a, b = qd(s, d), qd(s, d).mirror(0)
    ops = {"add_v": "+", "sub_v": "-", "mul_v": "*", "div_v": "/", "mod_v": "%"}
    both = arith.combined(a, b, lambda x, y: F.struct(*[arith._apply("bigint", op)(x, y).alias(n) for n, op in ops.items()]))
    return both.df.select("i0", "i1", "v.*")


@query(f"WITH {QD} SELECT i0, i1, v & 21 AS and_v, v | 21 AS or_v, xor(v, 21) AS xor_v, -v AS neg_v, CASE WHEN v = 0 THEN 1 ELSE 0 END AS not_v FROM qd")
def bitwise_ops(s, d):
    g = qd(s, d)
    v = F.col("v")
    return g.df.select("i0", "i1", v.bitwiseAND(21).alias("and_v"), v.bitwiseOR(21).alias("or_v"), v.bitwiseXOR(21).alias("xor_v"), (-v).alias("neg_v"), (v == 0).cast("int").alias("not_v"))


@query(f"WITH {QD}, m AS (SELECT 49 - i0 AS i0, i1, v AS w FROM qd), j AS (SELECT * FROM qd JOIN m USING (i0, i1)) SELECT '==' AS op, bool_and(v = w) AS holds FROM j UNION ALL SELECT '!=', bool_or(v <> w) FROM j UNION ALL SELECT '<', bool_and(v < w) FROM j UNION ALL SELECT '<=', bool_and(v <= w) FROM j UNION ALL SELECT '>', bool_and(v > w) FROM j UNION ALL SELECT '>=', bool_and(v >= 0) FROM j")
def compare_all(s, d):
    a, b = qd(s, d), qd(s, d).mirror(0)
    out = None
    for op in ("==", "!=", "<", "<=", ">", ">="):
        part = arith.holds(a, op, 0 if op == ">=" else b).select(F.lit(op).alias("op"), "holds")
        out = part if out is None else out.union(part)
    return out


@query(f"WITH {QD} SELECT i0, i1, CASE WHEN v > 100 THEN 1 ELSE 0 END AS v FROM qd")
def threshold_mask(s, d):
    return qd(s, d).mapped(lambda v: fn.threshold(v, 100)).df


@query(f"WITH {MASK} SELECT i0, i1, CASE WHEN fg THEN 0 ELSE 1 END AS v FROM m")
def invert_mask(s, d):
    return mask(s, d).mapped(fn.invert).df


@query(f"WITH {QD} SELECT i0, i1, CAST(floor(greatest(0.0, least(1.0, (v - 90.0::DOUBLE) / 40.0::DOUBLE)) * 255 + 0.5) AS INT) AS v FROM qd")
def normalize_u8(s, d):
    return qd(s, d).mapped(lambda v: fn.normalize_u8(v, 90, 130)).df


@query(f"WITH {QD} SELECT i0, i1, CAST(trunc(greatest(0.0, least(255.0, v * 2.5::DOUBLE - 100))) AS INT) AS v FROM qd")
def to_displayable(s, d):
    return qd(s, d).mapped(lambda v: fn.to_displayable(v * F.lit(2.5), -100.0)).df


@query(f"WITH {QD}, m AS (SELECT 49 - i0 AS i0, i1, v AS w FROM qd) SELECT round(sqrt(avg((CAST(v AS DOUBLE) - w) * (CAST(v AS DOUBLE) - w))), 6) AS rmse FROM qd JOIN m USING (i0, i1)")
def rmse(s, d):
    g = qd(s, d)
    return arith.rmse(g, g.mirror(0)).select(F.round("rmse", 6).alias("rmse"))


@query(f"WITH {QD}, m AS (SELECT 49 - i0 AS i0, i1, v AS w FROM qd) SELECT CAST(count(*) FILTER (WHERE v <> w) AS BIGINT) AS n, max(abs(v - w)) AS largest FROM qd JOIN m USING (i0, i1)")
def mismatches(s, d):
    g = qd(s, d)
    return arith.mismatches(g, g.mirror(0))


@query(f"WITH {MASK} SELECT CAST(count(*) FILTER (WHERE fg) AS BIGINT) AS n, bool_or(fg) AS any, bool_and(fg) AS all FROM m")
def packed_count(s, d):
    g = mask(s, d)
    return arith.bit_summary(arith.packed(g), g.size)


@query(f"WITH {MASK} SELECT i0, i1, CASE WHEN fg THEN 255 ELSE 3 END AS v FROM m")
def packed_roundtrip(s, d):
    g = mask(s, d)
    return arith.unpacked(arith.packed(g), g.extent, 255, 3).df


YUV = "CAST(greatest(0, least(255, (({a} * r + {b} * g + {c} * b + 128) >> 8) + {o})) AS INT)"


@query(f"WITH {QD}, c AS (SELECT i0, i1, v % 256 AS r, (v * 3) % 256 AS g, (v * 7) % 256 AS b FROM qd) SELECT i0, i1, {YUV.format(a=66, b=129, c=25, o=16)} AS y, {YUV.format(a=-38, b=-74, c=112, o=128)} AS u, {YUV.format(a=112, b=-94, c=-18, o=128)} AS w FROM c")
def rgb_to_yuv(s, d):
    g = qd(s, d)
    c = [(F.col("v") * k % 256).cast("int") for k in (1, 3, 7)]
    return g.df.select("i0", "i1", *[x.cast("int").alias(n) for x, n in zip(fn.rgb_to_yuv(*c), "yuw", strict=True)])


# ---- reductions


@query(f"WITH {QD} SELECT CAST(sum(v) AS BIGINT) AS sum, min(v) AS min, max(v) AS max, avg(v) AS mean FROM qd")
def reduce_all(s, d):
    return reduce.total(qd(s, d), "sum", "min", "max", "mean")


@query(f"WITH {QD} SELECT 0 AS i0, i1, CAST(sum(v) AS BIGINT) AS s, min(v) AS lo, max(v) AS hi, CAST(trunc(avg(v)) AS BIGINT) AS m FROM qd GROUP BY i1")
def reduce_axis_keepdims(s, d):
    g = qd(s, d)
    out = None
    for name, column in (("sum", "s"), ("min", "lo"), ("max", "hi"), ("mean", "m")):
        part = reduce.along(g, name, 0).df.withColumnRenamed("v", column)
        out = part if out is None else out.join(part, ["i0", "i1"])
    return out


for _mode, _sql in (("sum", "CAST(sum(v) AS BIGINT)"), ("mean", "avg(v)"), ("max", "max(v)"), ("magnitude", "round(sqrt(sum(CAST(v AS DOUBLE) * v)), 9)")):

    def _channel(s, d, mode=_mode):
        out = reduce.channels(evch(s, d), 0, mode)
        return out.mapped(lambda v: F.round(v, 9)).df if mode == "magnitude" else out.df

    _channel.__name__ = f"channel_reduce_{_mode}"
    query(f"WITH {EVCH} SELECT i0, i1, {_sql} AS v FROM evch GROUP BY i0, i1")(_channel)


@query(f"WITH {EVCH} SELECT i0, i1, round(atan2(max(v) FILTER (WHERE c = 1), max(v) FILTER (WHERE c = 0)), 9) + 0.0 AS v FROM evch WHERE c < 2 GROUP BY i0, i1")
def channel_reduce_phase(s, d):
    g = evch(s, d).view((0, 0, 0), (1, 23, 29))
    return reduce.channels(g, 0, "phase").mapped(lambda v: F.round(v, 9) + 0.0).df


@query(f"WITH {EVCH} SELECT c, i0, i1, CAST(CASE WHEN v * 2 > m THEN 1 ELSE 0 END AS INT) AS v FROM (SELECT *, max(v) OVER (PARTITION BY c) AS m FROM evch)")
def per_channel(s, d):
    def half(g: Grid) -> Grid:
        top = g.df.groupBy(*g.keys).agg(F.max("v").alias("m"))
        return replace(g, df=g.df.join(top, list(g.keys)).select(*g.keys, *g.axes, fn.threshold(F.col("v") * 2, F.col("m")).alias("v")))

    return arith.per_channel(evch(s, d), 0, half).df


# ---- stencils

SUM3 = "CAST(sum(v) AS BIGINT)"
for _border in ("clamp", "wrap", "reflect"):

    def _convolve(s, d, border=_border):
        return stencil.convolve(qd(s, d), stencil.box_kernel(2, 3), border).df

    _convolve.__name__ = f"convolve_{_border}"
    query(f"WITH {QD} SELECT * FROM {taps_sql('qd', 50, 11, _border, SUM3)}")(_convolve)


def gauss_sql(src: str, sigma: float) -> str:
    w = fn.gaussian_weights(sigma)
    r = len(w) // 2
    case = lambda c: "CASE " + " ".join(f"WHEN {c} = {k - r} THEN {x!r}::DOUBLE" for k, x in enumerate(w)) + " END"
    first = taps_sql(src, 50, 11, "clamp", f"sum(v * {case('dx')})", r, 0)
    return f"g1 AS (SELECT * FROM {first}), g2 AS (SELECT * FROM {taps_sql('g1', 50, 11, 'clamp', f'sum(v * {case("dy")})', 0, r)})"


@query(f"WITH {QD}, {gauss_sql('qd', 1.0)} SELECT i0, i1, CAST(round(v) AS BIGINT) AS v FROM g2")
def gaussian_blur(s, d):
    return stencil.gaussian_blur(qd(s, d), 1.0).df


@query(f"WITH {QD} SELECT a.i0, a.i1, a.v AS g0, b.v AS g1 FROM {taps_sql('qd', 50, 11, 'reflect', 'sum(v * dx * 0.5::DOUBLE)', 1, 0)} a JOIN {taps_sql('qd', 50, 11, 'reflect', 'sum(v * dy * 0.5::DOUBLE)', 0, 1)} b USING (i0, i1)")
def gradient(s, d):
    return stencil.gradient(qd(s, d))


@query(f"WITH {QD} SELECT CAST(i0 // 2 AS INT) AS i0, CAST(i1 // 2 AS INT) AS i1, CAST(round(avg(v)) AS BIGINT) AS v FROM qd GROUP BY 1, 2")
def downsample2(s, d):
    return stencil.downsample(qd(s, d), 2).df


@query(f"WITH {QD} SELECT * FROM {taps_sql('qd', 50, 11, 'clamp', 'CAST(trunc(sum(v) / 49.0::DOUBLE) AS BIGINT)', 3)}")
def box_blur3(s, d):
    return stencil.box_blur(qd(s, d), 3).df


@query(f"WITH {QD} SELECT * FROM {taps_sql('qd', 50, 11, 'clamp', 'min(v)')}")
def erode_box(s, d):
    return stencil.erode(qd(s, d), stencil.box_kernel(2, 3)).df


CROSS = "max(CASE WHEN dx = 0 OR dy = 0 THEN v END)"
CROSS_MIN = "min(CASE WHEN dx = 0 OR dy = 0 THEN v END)"


@query(f"WITH {QD} SELECT * FROM {taps_sql('qd', 50, 11, 'clamp', CROSS)}")
def dilate_cross(s, d):
    return stencil.dilate(qd(s, d), stencil.cross_kernel(2, 3)).df


@query(f"WITH {QD}, m AS (SELECT * FROM {taps_sql('qd', 50, 11, 'clamp', 'min(v)')}) SELECT * FROM {taps_sql('m', 50, 11, 'clamp', 'max(v)')}")
def morphological_open(s, d):
    return stencil.opened(qd(s, d), stencil.box_kernel(2, 3)).df


@query(f"WITH {QD}, m AS (SELECT * FROM {taps_sql('qd', 50, 11, 'clamp', CROSS)}) SELECT * FROM {taps_sql('m', 50, 11, 'clamp', CROSS_MIN)}")
def morphological_close(s, d):
    return stencil.closed(qd(s, d), stencil.cross_kernel(2, 3)).df


@query(f"WITH {QD} SELECT * FROM {taps_sql('qd', 50, 11, 'clamp', 'list_sort(list(v))[5]')}")
def median3(s, d):
    return stencil.median_filter(qd(s, d), stencil.box_kernel(2, 3)).df


@query(f"WITH {QD} SELECT * FROM {taps_sql('qd', 50, 11, 'clamp', 'list_sort(list(v))[8]')}")
def percentile90(s, d):
    return stencil.percentile_filter(qd(s, d), stencil.box_kernel(2, 3), 90).df


def od(s: SparkSession, d: str) -> Grid:
    """Orders by customer (96 bins) and day of the year (96 bins)."""
    rows = table(s, d, "orders").select((F.col("o_custkey") % 96).alias("a"), (F.dayofyear("o_orderdate") % 96).alias("b"))
    return raster(rows, {"i0": (F.col("a"), 96), "i1": (F.col("b"), 96)})


OD = """ox AS (SELECT CAST(range AS INT) AS i0 FROM range(96)), oy AS (SELECT CAST(range AS INT) AS i1 FROM range(96)),
o0 AS (SELECT CAST(o_custkey % 96 AS INT) AS i0, CAST(dayofyear(CAST(o_orderdate AS DATE)) % 96 AS INT) AS i1, count(*) AS v FROM orders GROUP BY 1, 2),
od AS (SELECT i0, i1, coalesce(v, 0) AS v FROM ox CROSS JOIN oy LEFT JOIN o0 USING (i0, i1))"""
DISC = {(x, y): 1.0 for x in range(-8, 9) for y in range(-8, 9) if x * x + y * y <= 64}


@query(f"WITH {OD} SELECT * FROM {taps_sql('od', 96, 96, 'reflect', 'CAST(sum(v * (17 + dx * 2 + dy)) AS DOUBLE)', 8)}")
def wide_weights(s, d):
    """17 x 17 weights on tiles of 40 cells."""
    kernel = {(x, y): 17.0 + 2 * x + y for x in range(-8, 9) for y in range(-8, 9)}
    return tiles.weighted(od(s, d), kernel, "reflect", 40).df


@query(f"WITH {OD} SELECT * FROM {taps_sql('od', 96, 96, 'clamp', 'CAST(trunc(sum(v)) AS BIGINT)', 8)}")
def wide_convolve(s, d):
    return stencil.convolve(od(s, d), stencil.box_kernel(2, 17)).df


@query(f"WITH {OD} SELECT * FROM {taps_sql('od', 96, 96, 'wrap', 'max(CASE WHEN dx * dx + dy * dy <= 64 THEN v END)', 8)}")
def wide_dilate(s, d):
    """A disc of radius 8 on tiles of 32 cells."""
    return tiles.extreme(od(s, d), DISC, "wrap", True, 32).df


@query(f"WITH {OD}, m AS (SELECT * FROM {taps_sql('od', 96, 96, 'clamp', 'min(v)', 5)}) SELECT * FROM {taps_sql('m', 96, 96, 'clamp', 'max(v)', 5)}")
def wide_open(s, d):
    return stencil.opened(od(s, d), stencil.box_kernel(2, 11)).df


@query(f"WITH {OD} SELECT * FROM {taps_sql('od', 96, 96, 'clamp', 'list_sort(list(v))[481]', 15)}")
def wide_median(s, d):
    """The middle of 31 x 31 cells."""
    return stencil.median_filter(od(s, d), stencil.box_kernel(2, 31)).df


@query(f"WITH {OD} SELECT * FROM {taps_sql('od', 96, 96, 'reflect', 'list_sort(list(v) FILTER (WHERE dx * dx + dy * dy <= 64))[177]', 8)}")
def wide_rank(s, d):
    """Nine tenths of the 197 cells of a disc, on tiles of 20 cells."""
    return tiles.ranked(od(s, d), DISC, 90, "reflect", 20).df


# ---- histograms


def bin_sql(bins: int) -> str:
    return f"CASE WHEN hi <= lo THEN 0 ELSE greatest(0, least({bins - 1}, CAST(trunc((v - lo) / (hi - lo) * {bins}) AS INT))) END"


RANGE = "r AS (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM qd)"


@query(f"WITH {QD}, {RANGE} SELECT {bin_sql(16)} AS bin, lo, hi, count(*) AS n FROM qd, r GROUP BY ALL")
def histogram16(s, d):
    return histogram.histogram(qd(s, d), 16)


@query(f"WITH {QD}, b AS (SELECT greatest(0, least(7, CAST(trunc((v - 90.0::DOUBLE) / 24.0 * 8) AS INT))) AS bin FROM qd) SELECT bin, 90.0::DOUBLE AS lo, 114.0::DOUBLE AS hi, count(*) AS n FROM b GROUP BY bin")
def histogram_given_range(s, d):
    """Counts over the range from 90 to 114 in eight bins; the rest goes to the first and last one."""
    return histogram.histogram(qd(s, d), 8, (90.0, 114.0))


@query(f"""WITH {EV}, r AS (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM ev), b AS (SELECT greatest(0, least(9, CAST(trunc((v - lo) / (hi - lo) * 10) AS INT))) AS bin FROM ev, r),
h AS (SELECT bin, count(*) AS n FROM b GROUP BY bin) SELECT CAST(k.range AS INT) AS bin,
 printf('%10.1f - %10.1f | %s %d', lo + (hi - lo) * k.range / 10, lo + (hi - lo) * (k.range + 1) / 10, repeat('#', CAST(floor(coalesce(n, 0) / CAST((SELECT max(n) FROM h) AS DOUBLE) * 50) AS INT)), coalesce(n, 0)) AS line
 FROM range(10) k CROSS JOIN r LEFT JOIN h ON h.bin = k.range""")
def histogram_bars(s, d):
    return histogram.text_bars(histogram.histogram(ev(s, d), 10), 10)


@query("""WITH x AS (SELECT CAST(trunc(greatest(0, least(5, (l_quantity - 1) / 49.0 * 6))) AS INT) AS b0, CAST(trunc(greatest(0, least(3, l_discount / 0.1 * 4))) AS INT) AS b1 FROM lineitem),
h AS (SELECT b0, b1, count(*) AS n FROM x GROUP BY 1, 2), w AS (SELECT length(CAST(max(n) AS VARCHAR)) AS w FROM h)
SELECT CAST(y.range AS INT) AS b1, string_agg(lpad(CAST(coalesce(n, 0) AS VARCHAR), CAST(w AS INT), '0'), ' ' ORDER BY q.range) AS line FROM range(6) q CROSS JOIN range(4) y CROSS JOIN w LEFT JOIN h ON h.b0 = q.range AND h.b1 = y.range GROUP BY y.range""")
def histogram_table(s, d):
    items = table(s, d, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("x"))
    return histogram.text_table(histogram.joint_histogram(items, ["q", "x"], [6, 4], [(1.0, 50.0), (0.0, 0.1)]), (6, 4))


@query(f"WITH {QD}, {RANGE}, a AS (SELECT i0, i1, v, {bin_sql(8)} AS b0 FROM qd, r), b AS (SELECT 49 - i0 AS i0, i1, b0 AS b1 FROM a) SELECT b0, b1, count(*) AS n FROM a JOIN b USING (i0, i1) GROUP BY ALL")
def joint_histogram(s, d):
    g = qd(s, d)
    both = arith.combined(g, g.mirror(0), lambda x, y: F.struct(x.alias("x"), y.alias("y"))).df.select("v.*")
    return histogram.joint_histogram(both, ["x", "y"], [8, 8])


@query(f"WITH {QD}, {RANGE}, b AS (SELECT i0, i1, v, lo, hi, {bin_sql(64)} AS bin FROM qd, r), c AS (SELECT bin, sum(count(*)) OVER (ORDER BY bin) AS c, sum(count(*)) OVER () AS t FROM b GROUP BY bin) SELECT i0, i1, CAST(trunc(lo + (hi - lo) * c / t) AS BIGINT) AS v FROM b JOIN c USING (bin)")
def equalize(s, d):
    return histogram.equalize(qd(s, d), 64).df


@query(f"""WITH {QD}, {RANGE}, h AS (SELECT {bin_sql(256)} AS b, count(*) AS n FROM qd, r GROUP BY 1),
a AS (SELECT b, n, sum(n) OVER (ORDER BY b) AS wb, sum(b * n) OVER (ORDER BY b) AS sb, sum(n) OVER () AS t, sum(b * n) OVER () AS st FROM h),
x AS (SELECT b, CAST(wb AS DOUBLE) * (t - wb) * pow(CAST(sb AS DOUBLE) / wb - CAST(st - sb AS DOUBLE) / (t - wb), 2) AS var FROM a WHERE t > wb)
SELECT CAST(trunc(lo + (hi - lo) * (b + 1) / 256.0) AS BIGINT) AS threshold FROM (SELECT b FROM x ORDER BY var DESC, b LIMIT 1), r""")
def otsu_value(s, d):
    return histogram.otsu(qd(s, d))


@query(f"""WITH RECURSIVE {QD}, r AS (SELECT min(v) AS lo, max(v) AS hi FROM qd),
b AS (SELECT lo + (hi - lo) * (least(255, CAST(floor((v - lo) / CAST(hi - lo AS DOUBLE) * 256) AS INT)) + 0.5) / 256.0 AS x FROM qd, r),
t(k, t) AS (SELECT 0, (lo + hi) / 2.0::DOUBLE FROM r UNION ALL SELECT k + 1, (SELECT (avg(x) FILTER (WHERE x <= t.t) + avg(x) FILTER (WHERE x > t.t)) / 2 FROM b) FROM t WHERE k < 40)
SELECT trunc(t) AS threshold FROM t WHERE k = 40""")
def two_means(s, d):
    return s.createDataFrame([(float(histogram.two_means(qd(s, d))),)], "threshold double")


@query(f"WITH {QD} SELECT round(quantile_cont(v, 0.05), 9) AS p0, round(quantile_cont(v, 0.95), 9) AS p1 FROM qd")
def percentile_range(s, d):
    return histogram.percentiles(qd(s, d), 5, 95).select(F.round("p0", 9).alias("p0"), F.round("p1", 9).alias("p1"))


@query(f"""WITH RECURSIVE {QD}, r AS (SELECT min(v) AS lo, (max(v) - min(v)) / 6.0::DOUBLE AS h FROM qd),
t(k, a, b, c) AS (SELECT 0, lo + h, lo + 3 * h, lo + 5 * h FROM r UNION ALL SELECT k + 1,
 coalesce((SELECT avg(v) FROM qd WHERE abs(v - t.a) <= least(abs(v - t.b), abs(v - t.c))), a),
 coalesce((SELECT avg(v) FROM qd WHERE abs(v - t.b) < abs(v - t.a) AND abs(v - t.b) <= abs(v - t.c)), b),
 coalesce((SELECT avg(v) FROM qd WHERE abs(v - t.c) < least(abs(v - t.a), abs(v - t.b))), c) FROM t WHERE k < 30)
SELECT CAST(j AS INT) AS level, round(CASE j WHEN 0 THEN a WHEN 1 THEN b ELSE c END, 6) AS v FROM t, range(3) x(j) WHERE k = 30""")
def k_means_levels(s, d):
    return s.createDataFrame([(k, round(x, 6)) for k, x in enumerate(histogram.k_means(qd(s, d), 3))], "level int, v double")


# ---- prefix sums and distances


@query(f"WITH {QD} SELECT i0, i1, CAST(sum(r) OVER (PARTITION BY i0 ORDER BY i1) AS BIGINT) AS v FROM (SELECT i0, i1, sum(v) OVER (PARTITION BY i1 ORDER BY i0) AS r FROM qd)")
def integral_image(s, d):
    return prefix.integral(qd(s, d)).df


BOXES = "b AS (SELECT CAST(o_orderkey AS BIGINT) AS box, CAST(o_custkey % 40 AS INT) AS lo0, CAST(o_custkey % 40 + o_orderkey % 10 AS INT) AS hi0, CAST(o_custkey % 7 AS INT) AS lo1, CAST(o_custkey % 7 + o_orderkey % 4 AS INT) AS hi1 FROM orders)"


def boxes(s, d) -> DataFrame:
    a, b = F.col("o_custkey"), F.col("o_orderkey")
    return table(s, d, "orders").select(b.alias("box"), (a % 40).cast("int").alias("lo0"), (a % 40 + b % 10).cast("int").alias("hi0"), (a % 7).cast("int").alias("lo1"), (a % 7 + b % 4).cast("int").alias("hi1"))


@query(f"WITH {QD}, {BOXES} SELECT box, CAST(sum(v) AS BIGINT) AS total FROM b JOIN qd ON i0 BETWEEN lo0 AND hi0 AND i1 BETWEEN lo1 AND hi1 GROUP BY box")
def rect_sum_queries(s, d):
    return prefix.rectangle_sums(prefix.integral(qd(s, d)), boxes(s, d))


@query(f"WITH {QD}, p AS (SELECT CAST(p_partkey AS BIGINT) AS box, p_partkey % 50 + 0.25 AS c0, p_partkey % 11 - 0.5 AS c1 FROM part) SELECT box, round(sum(v) / count(*), 9) AS mean FROM p JOIN qd ON i0 BETWEEN floor(c0 - 2.5) AND ceil(c0 + 2.5) AND i1 BETWEEN floor(c1 - 1.0) AND ceil(c1 + 1.0) GROUP BY box")
def box_query(s, d):
    k = F.col("p_partkey")
    points = table(s, d, "part").select(k.alias("box"), (k % 50 + 0.25).alias("c0"), (k % 11 - 0.5).alias("c1"))
    return prefix.box_means(prefix.integral(qd(s, d)), points, (2.5, 1.0)).select("box", F.round("mean", 9).alias("mean"))


@query(f"WITH {QD}, {BOXES} SELECT i0, i1, CAST(coalesce(sum(box % 5), 0) AS BIGINT) AS v FROM qd LEFT JOIN b ON i0 BETWEEN lo0 AND hi0 AND i1 BETWEEN lo1 AND hi1 GROUP BY i0, i1")
def rect_scatter_add(s, d):
    return prefix.scatter_boxes(boxes(s, d).withColumn("v", F.col("box") % 5), (50, 11)).df


EDT = "min(CASE WHEN {own} THEN (a.i0 - b.i0) * (a.i0 - b.i0) + (a.i1 - b.i1) * (a.i1 - b.i1) ELSE 0 END)"


@query(f"WITH {MASK} SELECT a.i0, a.i1, CAST({EDT.format(own='a.fg')} AS DOUBLE) AS v FROM m a, m b WHERE NOT b.fg GROUP BY 1, 2")
def edt_squared(s, d):
    return distance.squared(mask(s, d)).df


@query(f"WITH {MASK} SELECT a.i0, a.i1, round(sqrt({EDT.format(own='a.fg')}), 9) AS v FROM m a, m b WHERE NOT b.fg GROUP BY 1, 2")
def edt(s, d):
    return distance.distance(mask(s, d)).mapped(lambda v: F.round(v, 9)).df


@query(f"WITH {MASK} SELECT a.i0, a.i1, round(CASE WHEN a.fg THEN 1 ELSE -1 END * sqrt(min((a.i0 - b.i0) * (a.i0 - b.i0) + (a.i1 - b.i1) * (a.i1 - b.i1))), 9) AS v FROM m a JOIN m b ON a.fg <> b.fg GROUP BY a.i0, a.i1, a.fg")
def edt_signed(s, d):
    return distance.signed(mask(s, d)).mapped(lambda v: F.round(v, 9)).df


# ---- interpolation

POINTS = "p AS (SELECT CAST(p_partkey AS BIGINT) AS point, (p_partkey * 37 % 4900) / 100.0::DOUBLE AS c0, (p_partkey * 53 % 1000) / 100.0::DOUBLE AS c1 FROM part), t AS (SELECT point, CAST(floor(c0) AS INT) AS b0, CAST(floor(c1) AS INT) AS b1, c0 - floor(c0) AS f0, c1 - floor(c1) AS f1 FROM p)"
LINEAR = "(CASE WHEN x.a = 0 THEN 1 - f0 ELSE f0 END) * (CASE WHEN y.b = 0 THEN 1 - f1 ELSE f1 END)"


def points(s, d) -> DataFrame:
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.alias("point"), (k * 37 % 4900 / 100.0).alias("c0"), (k * 53 % 1000 / 100.0).alias("c1"))


@query(f"WITH {QD}, {POINTS} SELECT point, round(sum(v * {LINEAR}), 6) AS v FROM t, range(2) x(a), range(2) y(b), qd WHERE i0 = least(49, b0 + x.a) AND i1 = least(10, b1 + y.b) GROUP BY point")
def sample_linear(s, d):
    return interp.sample(qd(s, d), points(s, d)).select("point", F.round("v", 6).alias("v"))


SPLINE = "(CASE WHEN {0} < 1 THEN (4 - 6 * {0} * {0} + 3 * {0} * {0} * {0}) / 6 ELSE (2 - {0}) * (2 - {0}) * (2 - {0}) / 6 END)"


@query(f"""WITH {QD}, {POINTS}, n AS (SELECT point, b0 + x.a - 1 AS j0, b1 + y.b - 1 AS j1, abs(f0 - (x.a - 1)) AS d0, abs(f1 - (y.b - 1)) AS d1 FROM t, range(4) x(a), range(4) y(b)),
m AS (SELECT point, CASE WHEN j0 < 0 THEN -j0 - 1 WHEN j0 > 49 THEN 99 - j0 ELSE j0 END AS i0, CASE WHEN j1 < 0 THEN -j1 - 1 WHEN j1 > 10 THEN 21 - j1 ELSE j1 END AS i1, {SPLINE.format("d0")} * {SPLINE.format("d1")} AS w FROM n)
SELECT point, round(sum(w * v), 9) AS v FROM m JOIN qd USING (i0, i1) GROUP BY point""")
def sample_cubic(s, d):
    return interp.sample(qd(s, d), points(s, d), "cubic", "reflect").select("point", F.round("v", 9).alias("v"))  # v has ties at six digits


@query(f"WITH {QD}, {POINTS}, w AS (SELECT least(49, b0 + x.a) AS i0, least(10, b1 + y.b) AS i1, sum((point % 7) * {LINEAR}) AS v FROM t, range(2) x(a), range(2) y(b) GROUP BY 1, 2) SELECT qd.i0, qd.i1, round(coalesce(w.v, 0), 6) AS v FROM qd LEFT JOIN w USING (i0, i1)")
def scatter_add(s, d):
    return interp.scatter_add(points(s, d).withColumn("v", F.col("point") % 7), (50, 11)).mapped(lambda v: F.round(v, 6)).df


@query(f"WITH {QD} SELECT a.i0, a.i1, round(0.25 * b.v + 0.75 * c.v, 6) AS v FROM qd a JOIN qd b ON b.i0 = least(49, a.i0 + 2) AND b.i1 = least(10, a.i1 + 1) JOIN qd c ON c.i0 = least(49, a.i0 + 3) AND c.i1 = least(10, a.i1 + 1)")
def resample_translate(s, d):
    return interp.resample(qd(s, d), (50, 11), linalg.translate(2.75, 1)).mapped(lambda v: F.round(v, 6)).df


@query(f"WITH {QD}, o AS (SELECT CAST(a AS INT) AS o0, CAST(b AS INT) AS o1 FROM range(25) x(a), range(5) y(b)) SELECT o0 AS i0, o1 AS i1, round(avg(v), 6) AS v FROM o JOIN qd ON i0 BETWEEN 2 * o0 - 1 AND 2 * o0 + 1 AND i1 BETWEEN 2 * o1 - 1 AND 2 * o1 + 1 GROUP BY o0, o1")
def resample_scale2_aa(s, d):
    return interp.resample(qd(s, d), (25, 5), linalg.scale(2, 2)).mapped(lambda v: F.round(v, 6)).df


# ---- Fourier

DFT = "2 * pi() * (CAST(k.i0 * x.i0 AS DOUBLE) / 50 + CAST(k.i1 * x.i1 AS DOUBLE) / 11)"


@query(f"WITH {QD} SELECT k.i0, k.i1, round(sqrt(pow(sum(x.v * cos({DFT})), 2) + pow(sum(x.v * sin({DFT})), 2)), 3) AS magnitude FROM qd k, qd x GROUP BY 1, 2")
def fft2_magnitude(s, d):
    return fourier.fftn(qd(s, d)).select("i0", "i1", F.round(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 3).alias("magnitude"))


@query(f"WITH {QD} SELECT i0, i1, CAST(v AS DOUBLE) AS v FROM qd")
def ifft_roundtrip(s, d):
    g = qd(s, d)
    return fourier.ifftn(fourier.fftn(g), g.axes, g.extent).mapped(lambda v: F.round(v, 6) + 0.0).df


@query(f"WITH {QD} SELECT i0, i1, CAST(v AS DOUBLE) AS v FROM {taps_sql('qd', 50, 11, 'wrap', SUM3)}")
def fft_correlation(s, d):
    return fourier.correlate(qd(s, d), stencil.box_kernel(2, 3)).mapped(lambda v: F.round(v, 6)).df


# ---- fits and small matrices

MONTHS = "o AS (SELECT CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS DOUBLE) AS x, o_totalprice AS y FROM orders)"


def months(s, d) -> DataFrame:
    return table(s, d, "orders").select(((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1).cast("double").alias("x"), F.col("o_totalprice").alias("y"))


@query(f"WITH {MONTHS} SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept, round(sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2)), 2) AS sigma FROM o")
def linear_fit(s, d):
    return fit.linear_fit(months(s, d), "x", "y").select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("sigma", 2).alias("sigma"))


@query(f"""WITH {MONTHS}, b AS (SELECT avg(x) AS m, stddev_pop(x) AS q, avg(y) AS my FROM o), z AS (SELECT (x - m) / q AS u, y - my AS y FROM o, b),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(u) AS s1, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(y) AS t0, sum(u * y) AS t1, sum(u * u * y) AS t2 FROM z),
e AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM s),
c AS (SELECT (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det AS c0, (n * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det AS c1, (n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det AS c2 FROM e)
SELECT round(my + c0 - c1 * m / q + c2 * m * m / (q * q), 1) AS a, round(c1 / q - 2 * c2 * m / (q * q), 2) AS b, round(c2 / (q * q), 3) + 0.0 AS c FROM c, b""")
def parabolic_fit(s, d):
    return fit.parabolic_fit(months(s, d), "x", "y").select(F.round("a", 1).alias("a"), F.round("b", 2).alias("b"), (F.round("c", 3) + 0.0).alias("c"))


MATRIX = "m AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 5 + 1 AS a, n_nationkey % 3 AS b, n_nationkey % 7 AS c, n_nationkey % 4 + 2 AS e FROM nation)"


@query(f"WITH {MATRIX} SELECT id, CAST(a * e - b * c AS DOUBLE) AS det FROM m")
def matrix_determinant(s, d):
    k = F.col("n_nationkey")
    m = table(s, d, "nation").select(k.cast("long").alias("id"), F.array(k % 5 + 1, k % 3, k % 7, k % 4 + 2).cast("array<double>").alias("m"))
    return m.select("id", linalg.determinant(F.col("m"), 2).alias("det"))


@query(f"WITH {MATRIX} SELECT id, CASE WHEN greatest(abs(a), abs(c)) >= 1e-10 AND abs(a * e - b * c) >= 1e-10 * greatest(abs(a), abs(c)) THEN round((5.0 * e - b * 7) / (a * e - b * c), 9) + 0.0 END AS x, CASE WHEN greatest(abs(a), abs(c)) >= 1e-10 AND abs(a * e - b * c) >= 1e-10 * greatest(abs(a), abs(c)) THEN round((a * 7.0 - c * 5) / (a * e - b * c), 9) + 0.0 END AS y FROM m")
def solve_2x2(s, d):
    k = F.col("n_nationkey").cast("double")
    x, y = linalg.solve2(k % 5 + 1, k % 3, k % 7, k % 4 + 2, F.lit(5.0), F.lit(7.0))
    return table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.round(x, 9) + 0.0).alias("x"), (F.round(y, 9) + 0.0).alias("y"))


# ---- motion and features


def lk_sql() -> str:
    w = lambda src, e: taps_sql(src, 24, 15, "reflect", e, 2)
    return f"""WITH {EV}, f0 AS (SELECT i0, i1, v FROM ev WHERE i1 < 15), f1 AS (SELECT i0, i1 - 15 AS i1, v FROM ev WHERE i1 >= 15),
p AS (SELECT a.i0, a.i1, a.v AS g0, b.v AS g1, CAST(f1.v - f0.v AS DOUBLE) AS dt FROM {taps_sql('f0', 24, 15, 'reflect', 'sum(v * dx * 0.5::DOUBLE)', 1, 0)} a JOIN {taps_sql('f0', 24, 15, 'reflect', 'sum(v * dy * 0.5::DOUBLE)', 0, 1)} b USING (i0, i1) JOIN f0 USING (i0, i1) JOIN f1 USING (i0, i1)),
s AS (SELECT i0, i1, v.a / 25.0::DOUBLE AS a, v.b / 25.0::DOUBLE AS b, v.c / 25.0::DOUBLE AS c, v.d / 25.0::DOUBLE AS d, v.e / 25.0::DOUBLE AS e FROM {w('p', "{'a': sum(g0 * g0), 'b': sum(g0 * g1), 'c': sum(g1 * g1), 'd': sum(g0 * dt), 'e': sum(g1 * dt)}")}),
u AS (SELECT *, a * c - b * b AS det, greatest(abs(a), abs(b)) AS piv FROM s)
SELECT i0, i1, CASE WHEN piv >= 1e-10 AND abs(det) >= 1e-10 * piv THEN (-d * c + b * e) / det ELSE 0.0 END AS u0, CASE WHEN piv >= 1e-10 AND abs(det) >= 1e-10 * piv THEN (-a * e + b * d) / det ELSE 0.0 END AS u1 FROM u"""


@query(f"WITH f AS ({lk_sql()}) SELECT i0, i1, round(u0, 6) + 0.0 AS u0, round(u1, 6) + 0.0 AS u1 FROM f")
def lk_flow(s, d):
    a, b = frames(s, d)
    return flow.lucas_kanade(a, b, 2).select("i0", "i1", (F.round("u0", 6) + 0.0).alias("u0"), (F.round("u1", 6) + 0.0).alias("u1"))


@query(f"WITH f AS ({lk_sql()}) SELECT i0, i1, round(sqrt(u0 * u0 + u1 * u1), 6) AS magnitude FROM f")
def flow_magnitude(s, d):
    a, b = frames(s, d)
    return render.flow_magnitude(flow.lucas_kanade(a, b, 2)).select("i0", "i1", F.round("magnitude", 6).alias("magnitude"))


SHADE = "CAST(trunc(255 * (bright - bright * greatest(0, least(fmod({0} + turn, 6), 4 - fmod({0} + turn, 6), 1)))) AS INT)"


@query(f"""WITH f AS ({lk_sql()}), m AS (SELECT *, sqrt(u0 * u0 + u1 * u1) AS long FROM f),
c AS (SELECT i0, i1, long / max(long) OVER () AS bright, 6 * (atan2(u1, u0) + pi()) / (2 * pi()) AS turn FROM m)
SELECT i0, i1, {SHADE.format(5)} AS r, {SHADE.format(3)} AS g, {SHADE.format(1)} AS b FROM c""")
def flow_to_color(s, d):
    a, b = frames(s, d)
    return render.flow_to_color(flow.lucas_kanade(a, b, 2), ("i0", "i1"))


@query()
def flow_to_arrows(s, d):
    a, b = frames(s, d)
    return render.flow_to_arrows(flow.lucas_kanade(a, b, 2), (24, 15), 6).df


@query("""WITH d AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(CAST(a.embedding[k] AS DOUBLE) - CAST(b.embedding[k] AS DOUBLE), 2)))) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn, lead(d) OVER (PARTITION BY i ORDER BY d, j) AS d2 FROM d)
SELECT i AS index0, j AS index1, round(d, 6) AS distance FROM r WHERE rn = 1 AND (d2 IS NULL OR d2 = 0 OR d / d2 < 0.95)""")
def match_ratio_test(s, d):
    e = table(s, d, "embeddings")
    even, odd = e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")
    return flow.match(even, odd, 0.95, "vec_id", "embedding").select("index0", "index1", F.round("distance", 6).alias("distance"))


SMALL = "m AS (SELECT o_orderkey AS id, CAST(o_orderkey % 7 + 3 AS DOUBLE) AS a, CAST(o_custkey % 5 AS DOUBLE) AS b, CAST(o_orderkey % 3 - 1 AS DOUBLE) AS c, CAST(o_custkey % 11 - 4 AS DOUBLE) AS d, CAST(o_orderkey % 13 AS DOUBLE) AS e, CAST(o_custkey % 4 AS DOUBLE) AS f FROM orders)"


def small(s, d) -> tuple[DataFrame, list]:
    """Six numbers for each order, the entries of a symmetric 3 x 3 matrix by rows."""
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(s, d, "orders").select(k.alias("id"), (k % 7 + 3).alias("a"), (u % 5).alias("b"), (k % 3 - 1).alias("c"), (u % 11 - 4).alias("d"), (k % 13).alias("e"), (u % 4).alias("f"))
    at = {n: F.col(n).cast("double") for n in "abcdef"}
    return rows, [at[n] for n in "abcbdecef"]


DET3 = "a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c)"


@query(f"""WITH {SMALL}, x AS (SELECT *, {DET3} AS det FROM m)
SELECT id, round(det, 3) AS det, round(1 * (d * f - e * e) - b * (2 * f - e * 3) + c * (2 * e - d * 3), 3) AS x0, round(a * (2 * f - e * 3) - 1 * (b * f - e * c) + c * (b * 3 - 2 * c), 3) AS x1,
 round(a * (d * 3 - 2 * e) - b * (b * 3 - 2 * c) + 1 * (b * e - d * c), 3) AS x2 FROM x WHERE abs(det) > 0.5""")
def solve_three(s, d):
    """Systems of three equations, one for each order, as whole numbers over the determinant; singular ones have no row."""
    rows, m = small(s, d)
    x = linalg.solve(F.array(*m), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 3)
    rows = rows.select("id", x.alias("x"), linalg.determinant(F.array(*m), 3).alias("det")).where("x is not null")
    # + 0.0 turns -0.0 into 0.0
    return rows.select("id", F.round("det", 3).alias("det"), *[(F.round(F.col("x")[k] * F.col("det"), 3) + F.lit(0.0)).alias(f"x{k}") for k in range(3)])


@query(f"""WITH {SMALL}, e AS (SELECT id, a, b, d, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS l0, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) AS l1 FROM m WHERE b <> 0)
SELECT id, round(l0, 6) AS l0, round(l1, 6) AS l1, round(b * b / (b * b + (l0 - a) * (l0 - a)), 6) AS v FROM e""")
def eigen_two(s, d):
    """Eigenvalues of symmetric 2 x 2 matrices, and the squared first entry of the first eigenvector."""
    rows, m = small(s, d)
    e = rows.where("b <> 0").select("id", linalg.eigen(F.array(m[0], m[1], m[1], m[4]), 2).alias("e"))
    v = F.col("e.vectors")[0]
    return e.select("id", *[(F.round(F.col("e.values")[k], 6) + F.lit(0.0)).alias(f"l{k}") for k in range(2)], F.round(v * v, 6).alias("v"))


@query(f"""WITH {SMALL}, t AS (SELECT id, a * a + b * b + b * b + d * d AS t, (a * d - b * b) * (a * d - b * b) AS q FROM m),
s AS (SELECT id, sqrt((t + sqrt(greatest(0, t * t - 4 * q))) / 2) AS s0, q FROM t)
SELECT id, round(s0, 6) AS s0, round(sqrt(q) / s0, 6) AS s1, CAST(CASE WHEN q > 0.5 THEN 2 ELSE 1 END AS INT) AS rank, CASE WHEN q > 0.5 THEN round(s0 * s0 / sqrt(q), 5) END AS cond FROM s""")
def singular_two(s, d):
    """Singular values, rank and condition of 2 x 2 matrices; the condition of singular ones is null."""
    rows, m = small(s, d)
    e = rows.select("id", linalg.decomposition(F.array(m[0], m[1], m[1], m[4]), 2).alias("e"))
    return e.select("id", *[(F.round(F.col("e.s")[k], 6) + F.lit(0.0)).alias(f"s{k}") for k in range(2)], "e.rank", F.when(F.col("e.rank") == 2, F.round("e.cond", 5)).alias("cond"))


def blobs(s, d, shift: int = 0) -> Grid:
    """Orders binned by customer and date on 64 x 64 cells, as blurred shares of a fixed total; another frame shifts them."""
    # 16 spots, wide enough for the middle scales and far enough apart to stay single
    rows = table(s, d, "orders").select((F.col("o_custkey") % 4 * 15 + 9 + shift).alias("a"), (F.dayofyear("o_orderdate") % 4 * 15 + 9 + shift).alias("b"))
    spots = raster(rows, {"i0": (F.col("a"), 64), "i1": (F.col("b"), 64)})
    total = spots.df.agg(F.sum("v").alias("total"))  # one row
    shares = spots.df.join(F.broadcast(total)).select("i0", "i1", (F.col("v") / F.col("total") * 400_000.0).alias("v"))
    return stencil.gaussian_blur(replace(spots, df=shares), 3.0)


@query()
def keypoints(s, d):
    return flow.keypoints(blobs(s, d)).select("i0", "i1", F.round("scale", 6).alias("scale"), F.round("response", 6).alias("response"))


@query()
def descriptors(s, d):
    g = blobs(s, d)
    found = flow.keypoints(g).withColumn("point", (F.col("i0") + F.col("i1") * 64).cast("long"))
    return flow.descriptors(g, found.groupBy("point", "i0", "i1").agg(F.max("scale").alias("scale")))


@query()
def sift_flow(s, d):
    return flow.sift_flow(blobs(s, d), blobs(s, d, 3), 5.0, 0.95).select("i0", "i1", F.round("u0", 6).alias("u0"), F.round("u1", 6).alias("u1"))


@query(f"WITH {QD} SELECT i0, i1, v FROM qd a WHERE NOT EXISTS (SELECT 1 FROM qd b WHERE abs(a.i0 - b.i0) <= 1 AND abs(a.i1 - b.i1) <= 1 AND b.v > a.v)")
def local_maxima(s, d):
    return flow.neighbours_above(qd(s, d)).select("i0", "i1", "v")


@query(f"""WITH {EV}, x AS (SELECT i0 + 24 * i1 AS j, v FROM ev) SELECT CAST(k.range AS INT) AS i0, round(sqrt(pow(sum(v * cos(-2 * pi() * ((k.range * j) % 720) / 720)), 2) + pow(sum(v * sin(-2 * pi() * ((k.range * j) % 720) / 720)), 2)), 5) AS magnitude
 FROM range(720) k, x GROUP BY k.range""")
def fft_long_line(s, d):
    """Events by hour as one line of 720 cells, which is not gathered: 24 x 30."""
    line = ev(s, d).df.select((F.col("i0") + 24 * F.col("i1")).cast("int").alias("i0"), F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    out = fourier.fft(line, ["i0"], extent=(720,), line=64)
    return out.select("i0", F.round(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 5).alias("magnitude"))


# ---- tomography

VIEWS, DETECTORS = 8, 55


def parallel_views(size: float = 1.0) -> tuple[list[np.ndarray], int]:
    """Views of the quantity-discount grid; a detector cell spans ``size`` cells of it."""
    n = math.ceil(DETECTORS / size)
    views = [linalg.parallel_view(math.pi * k / VIEWS, n, (50, 11)) for k in range(VIEWS)]
    for m in views:
        m[0] = (m[0] - [0, 0, (n - 1) / 2]) / size + [0, 0, (n - 1) / 2]
    return views, n


def scan(s, size: float = 1.0) -> tuple[list[np.ndarray], DataFrame, int]:
    views, n = parallel_views(size)
    return views, tomography.rays(s, views, (n,)), n


def rays_sql(size: float) -> str:
    """ent: the weight of each cell for each ray, with boxes written out cell by cell; back: the system's adjoint needs no more."""
    views, n = parallel_views(size)
    rows = []
    for k, m in enumerate(views):
        way = linalg.camera_centre(m)[0]
        pin = np.linalg.pinv(m[:, :2])
        half = 0.5 * np.abs(np.linalg.inv(np.stack([m[0, :2], way]))[:, 0])
        norm = math.sqrt(way[0] * way[0] + way[1] * way[1])
        start = pin[:, 1] - pin @ m[:, 2]
        num = lambda *x: ", ".join(f"{float(y)!r}::DOUBLE" for y in x)
        rows.append(f"({k}, {num(pin[0, 0], start[0], pin[1, 0], start[1], way[0] / norm, way[1] / norm, half[0], half[1])})")
    ends = lambda o, d, e: f"CASE WHEN abs({d}) < 1e-12 THEN CASE WHEN {o} < 0 OR {o} > {e} THEN {{0}} ELSE {{1}} END ELSE {{2}}(-{o} / {d}, ({e}.0::DOUBLE - {o}) / {d}) END"
    low = [ends(o, d, e).format("1e30", "-1e30", "least") for o, d, e in (("o0", "d0", 49), ("o1", "d1", 10))]
    high = [ends(o, d, e).format("-1e30", "1e30", "greatest") for o, d, e in (("o0", "d0", 49), ("o1", "d1", 10))]
    return f"""vw(view, a0, b0, a1, b1, d0, d1, h0, h1) AS (VALUES {', '.join(rows)}),
ry AS (SELECT view, CAST(u.range AS INT) AS u0, a0 * u.range + b0 AS o0, a1 * u.range + b1 AS o1, d0, d1, h0, h1 FROM vw, range({n}) u),
rt AS (SELECT *, greatest(-1e30, {low[0]}, {low[1]}) AS t0, least(1e30, {high[0]}, {high[1]}) AS t1 FROM ry),
rs AS (SELECT *, greatest(1, CAST(ceil(round(t1 - t0, 9)) AS INT)) AS steps FROM rt WHERE t1 > t0),
sm AS (SELECT view, u0, h0, h1, o0 + (t0 + k.range * ((t1 - t0) / steps)) * d0 AS c0, o1 + (t0 + k.range * ((t1 - t0) / steps)) * d1 AS c1,
  (t1 - t0) / steps * CASE WHEN k.range IN (0, steps) THEN 0.5 ELSE 1.0 END AS ds FROM rs, range(1000) k WHERE k.range <= steps),
wb AS (SELECT view, u0, ds, greatest(0, CAST(floor(c0 - h0) AS INT)) AS l0, least(49, CAST(ceil(c0 + h0) AS INT)) AS r0, greatest(0, CAST(floor(c1 - h1) AS INT)) AS l1, least(10, CAST(ceil(c1 + h1) AS INT)) AS r1
  FROM sm WHERE greatest(h0, h1) > 0.5),
nt AS (SELECT view, u0, ds, least(49, greatest(0, CAST(floor(c0) AS INT) + p.range)) AS i0, least(10, greatest(0, CAST(floor(c1) AS INT) + q.range)) AS i1,
  CASE WHEN p.range = 0 THEN 1 - (c0 - floor(c0)) ELSE c0 - floor(c0) END * CASE WHEN q.range = 0 THEN 1 - (c1 - floor(c1)) ELSE c1 - floor(c1) END AS w FROM sm, range(2) p, range(2) q WHERE greatest(h0, h1) <= 0.5),
ent AS (SELECT view, u0, i0, i1, sum(a) AS a FROM (SELECT view, u0, CAST(x.range AS INT) AS i0, CAST(y.range AS INT) AS i1, ds / ((r0 - l0 + 1) * (r1 - l1 + 1)) AS a FROM wb, range(50) x, range(11) y WHERE x.range BETWEEN l0 AND r0 AND y.range BETWEEN l1 AND r1
  UNION ALL SELECT view, u0, CAST(i0 AS INT), CAST(i1 AS INT), w * ds FROM nt) GROUP BY view, u0, i0, i1),
fw AS (SELECT ry.view, ry.u0, coalesce(sum(a * v), 0) AS v FROM ry LEFT JOIN ent USING (view, u0) LEFT JOIN qd USING (i0, i1) GROUP BY ry.view, ry.u0)"""


FORWARD_SQL = "SELECT CAST(view AS INT) AS view, u0, round(v, 6) AS v FROM fw"
BACK_SQL = "SELECT i0, i1, round(coalesce(sum(a * f.v), 0), 4) AS v FROM qd LEFT JOIN ent USING (i0, i1) LEFT JOIN fw f USING (view, u0) GROUP BY i0, i1"


@query(f"WITH {QD}, {rays_sql(1.0)} {FORWARD_SQL}")
def forward_project(s, d):
    _, table_, _ = scan(s)
    g = qd(s, d)
    return tomography.forward(g, tomography.system(table_, g.extent), table_).select("view", "u0", F.round("v", 6).alias("v"))


@query(f"WITH {QD}, {rays_sql(1.0)} {BACK_SQL}")
def back_project(s, d):
    _, table_, _ = scan(s)
    g = qd(s, d)
    entries = tomography.system(table_, g.extent)
    return tomography.back(tomography.forward(g, entries, table_), entries, g.extent).mapped(lambda v: F.round(v, 4)).df


@query(f"WITH {QD}, {rays_sql(3.0)} {FORWARD_SQL}")
def forward_project_coarse(s, d):
    """Detector cells of three grid cells: all samples are box means."""
    _, table_, _ = scan(s, 3.0)
    g = qd(s, d)
    return tomography.forward(g, tomography.system(table_, g.extent), table_).select("view", "u0", F.round("v", 6).alias("v"))


@query(f"WITH {QD}, {rays_sql(3.0)} {BACK_SQL}")
def back_project_coarse(s, d):
    _, table_, _ = scan(s, 3.0)
    g = qd(s, d)
    entries = tomography.system(table_, g.extent)
    return tomography.back(tomography.forward(g, entries, table_), entries, g.extent).mapped(lambda v: F.round(v, 4)).df


BOUND_ROWS = ", ".join(f"({k}, {', '.join(f'{float(x)!r}::DOUBLE' for x in m[0])})" for k, m in enumerate(parallel_views()[0]))


@query(
    f"WITH {QD}, {rays_sql(1.0)}, vm(view, m0, m1, m2) AS (VALUES {BOUND_ROWS}) SELECT i0, i1, round(min(greatest(0, f.v)), 6) AS v FROM "
    "(SELECT i0, i1, view, CAST(round(m0 * i0 + m1 * i1 + m2) AS INT) AS u0 FROM qd, vm) c LEFT JOIN fw f USING (view, u0) GROUP BY i0, i1"
)
def density_bound(s, d):
    views, table_, n = scan(s)
    g = qd(s, d)
    readings = tomography.forward(g, tomography.system(table_, g.extent), table_)
    return tomography.density_bound(readings, views, (n,), g.extent).mapped(lambda v: F.round(v, 6)).df


@query("WITH p AS (SELECT CAST(o_orderkey AS INT) AS k, CAST(o_custkey % 7 AS BIGINT) AS x FROM orders WHERE o_orderkey >= 0) SELECT k AS i0, CAST(sum(x) OVER (ORDER BY k) AS BIGINT) AS v FROM p")
def running_orders(s, d):
    """One line with as many cells as the largest order key, scanned in blocks; only its filled cells come back."""
    rows = table(s, d, "orders").where("o_orderkey >= 0").select(F.col("o_orderkey").cast("int").alias("i0"), (F.col("o_custkey") % 7).cast("long").alias("v"))
    n = rows.agg(F.max("i0")).first()[0] + 1
    return prefix.integral(Grid(rows, ("i0",), (n,)), block=1 << 12).df


# ---- pictures and point queries


@query(f"WITH {EV}, b AS (SELECT i0, sum(v) AS v FROM ev GROUP BY i0), t AS (SELECT i0, CAST(trunc(v / CAST((SELECT max(v) FROM b) AS DOUBLE) * 20) AS INT) AS tall FROM b) SELECT CAST(x.a AS INT) AS x, CAST(y.b AS INT) AS y, CASE WHEN 20 - y.b <= tall THEN 1 ELSE 0 END AS v FROM range(48) x(a), range(20) y(b) JOIN t ON i0 = x.a // 2")
def bar_chart(s, d):
    bars = reduce.along(ev(s, d), "sum", 1).slice(1, 0)
    return render.bar_chart(bars, 48, 20).df


@query(f"WITH {EV} SELECT i0, i1, CAST(trunc(v / CAST((SELECT max(v) FROM ev) AS DOUBLE) * 255) AS INT) AS v FROM ev")
def heatmap(s, d):
    return render.heatmap(ev(s, d)).df


@query(f"WITH {QD}, p AS (SELECT quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM qd) SELECT i0, i1, CAST(trunc((greatest(a, least(b, v)) - a) / (b - a) * 255) AS INT) AS v FROM qd, p")
def windowed_heatmap(s, d):
    return render.windowed_heatmap(qd(s, d)).df


@query(f"WITH {EVCH}, c AS (SELECT i0 - 2 AS i0, i1 - 1 AS i1, round((greatest(0.0, least(10.0, CAST(v AS DOUBLE)))) / 10.0 * 255) AS v FROM evch WHERE c = 1 AND i0 BETWEEN 2 AND 21 AND i1 BETWEEN 1 AND 28) SELECT CAST(i0 // 2 AS INT) AS i0, CAST(i1 // 2 AS INT) AS i1, CAST(round(avg(v)) AS INT) AS v FROM c GROUP BY 1, 2")
def render_slice(s, d):
    return render.render_slice(evch(s, d), (2, 1), (21, 28), 0.0, 10.0, (5, 14), {0: 1}).df


@query(f"""WITH {EVCH}, c AS (SELECT c, i1 - 3 AS i1, i0 - 1 AS i0, round((greatest(0.0, least(9.0, CAST(v AS DOUBLE)))) / 9.0 * 255) AS v FROM evch WHERE c < 3 AND i1 >= 3 AND i0 BETWEEN 1 AND 20)
SELECT c, CAST(i1 // 3 AS INT) AS i1, CAST(i0 // 3 AS INT) AS i0, CAST(round(avg(v)) AS INT) AS v FROM c GROUP BY 1, 2, 3""")
def render_slice_color(s, d):
    """The first three event types as red, green and blue, days across and hours down; the window reaches beyond the last day."""
    return render.render_slice(evch(s, d).view((0, 0, 0), (2, 23, 29)), (3, 1), (99, 20), 0.0, 9.0, (9, 6), axes=("i1", "i0"), color="c").df


@query(f"""WITH {EVCH}, m AS (SELECT i0, i1, sqrt(sum(CAST(v * v AS DOUBLE))) AS v FROM evch GROUP BY 1, 2)
SELECT CAST(0 AS INT) AS c, i0, i1, CAST(round((greatest(1.0, least(21.0, v)) - 1.0) / 20.0 * 255) AS INT) AS v FROM m""")
def render_slice_magnitude(s, d):
    return render.render_slice(evch(s, d), (-5, -5), (99, 99), 1.0, 21.0, axes=("i0", "i1"), color="c", reduction="magnitude").df


@query(f"WITH {QD} SELECT CAST(p_partkey AS BIGINT) AS point, v FROM part JOIN qd ON i0 = least(49, p_partkey % 60) AND i1 = least(10, p_partkey % 13)")
def query_value(s, d):
    k = F.col("p_partkey")
    return render.query_values(qd(s, d), table(s, d, "part").select(k.alias("point"), (k % 60).alias("c0"), (k % 13).alias("c1")))


@query()
def render_volume(s, d):
    g = qdt(s, d).mapped(lambda v: v.cast("double"))
    rays = render.camera_rays(s, g.extent, 40, 22, ((1, 0, 0), (0, 0.8, 0.6), (0, -0.6, 0.8)))
    return render.render_volume(rays, g, 0.6, low=0.0, high=40.0).select("pixel0", "pixel1", F.round("color", 6).alias("color"), F.round("alpha", 6).alias("alpha"))


# ---- the ring buffer, as a table


RING = "r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS total FROM events)"


@query(f"WITH {RING} SELECT user_id, total - back AS seq, event_id FROM r WHERE back <= 4")
def ring_last_n(s, d):
    return ring.last_n(table(s, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 4).select("user_id", "seq", "event_id")


@query("SELECT user_id, least(4, count(*)) AS n, count(*) AS total, greatest(0, count(*) - 4) AS oldest FROM events GROUP BY user_id")
def ring_stats(s, d):
    return ring.stats(table(s, d, "events"), ["user_id"], 4)


NOISY = QD + """, noisy AS (SELECT i0, i1, CASE WHEN h1 < CAST(0.05 * 4294967296 AS BIGINT) THEN CASE WHEN h2 % 2 = 0 THEN 0 ELSE 255 END ELSE v END AS v FROM (
SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2 FROM (SELECT *, md5('7,' || i0 || ',' || i1) AS h FROM qd)))"""


@query(f"WITH {NOISY} SELECT * FROM noisy")
def salt_and_pepper(s, d):
    return arith.salt_and_pepper(qd(s, d), 0.05, 0, 255, seed=7).df


@query(f"WITH {NOISY} SELECT * FROM {taps_sql('noisy', 50, 11, 'clamp', 'list_sort(list(v))[5]')}")
def median_of_noise(s, d):
    """Noise of single cells, taken out again by a median."""
    return stencil.median_filter(arith.salt_and_pepper(qd(s, d), 0.05, 0, 255, seed=7), stencil.box_kernel(2, 3)).df
