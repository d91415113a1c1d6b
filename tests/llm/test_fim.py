"""Fill-in-the-middle against its contract written out plainly, and exact round trips."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from latticework.llm import fim, queries

FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc, text):
    """(n, form, prefix_chars, middle_chars, output) with the list of units that the operator never makes."""
    text = text or ""
    units = list(text)
    name = sha(f"1:{'' if doc is None else doc}")
    h = [int(name[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_whole_table(spark):
    rows = duckdb.sql(f"select doc_id, coalesce(text, '') from '{FOLDER}/documents.parquet'").fetchall()
    df = queries.QUERIES["op13_fim"](spark, FOLDER)
    assert df.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    want = [(doc, *(x := plainly(doc, text))[:4], sha(x[4]), sha(text)) for doc, text in rows]
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(want)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.sql(f"create view documents as from '{FOLDER}/documents.parquet'")
    assert sorted(con.sql(fim.ORACLE).select(*df.columns).fetchall()) == got


TEXTS = [None, "", "a", "ab", "é中🎉\r\n x", "x<P>y", "<M>", "<S", "<", "<P<P", "P><S", "\n\n\n", "a\x00b", "é" * 20, "< P > <p> <<", "🎉" * 200_000, "word " * 300_000]


def test_odd_rows(spark):
    rows = [(k, t, 1, "f", 2, "r") for k in range(40) for t in TEXTS]
    rows += [(None, "null id", 1, "f", 2, "r")] * 2 + [(3, "twice", 1, "f", 2, "r")] * 2 + [(-7, "below nought", 1, "f", 2, "r")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int, form string, middle_chars int, output string")
    out = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted([tuple(r) for r in out.collect()], key=repr)
    assert got == sorted([(doc, *plainly(doc, text), text or "") for doc, text, *_ in rows], key=repr)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert fim.fill_in_middle(df).collect() == []


@pytest.mark.parametrize("unit", [r"\w+", r"(?s:.{1,3})", r"[^\n]*\n", r"zzz"])
def test_other_units_come_back(spark, unit):
    rnd = random.Random(4)
    rows = [(k, "".join(rnd.choice("ab \n.é") for _ in range(rnd.randrange(80)))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = fim.fill_in_middle(df, unit=unit, fim_percent=100, spm_percent=50)
    got = {r.doc_id: r for r in out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()}
    pattern = re.compile(unit)
    for doc, text in rows:
        r, places = got[doc], [0] + [m.end() for m in pattern.finditer(text)]
        assert r.back == text and r.n == len(places) - 1
        if text:
            h1, h2, *_ = fim.draws(doc, 1)
            a, b = sorted(places[h % len(places)] for h in (h1, h2))
            assert (r.prefix_chars, r.middle_chars) == (a, b - a)
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_empty_units_are_refused(spark):
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), unit=r"a*")


def test_matches_are_not_kept():
    """Two passes over a text of two million units take no memory that grows with their number."""
    import tracemalloc

    text, unit = "a b" * 700_000, re.compile(fim.CODE_POINT)
    tracemalloc.start()
    n = fim.count_units(unit, text)
    assert fim.ends_of(unit, text, n // 3, n) == (n // 3, n)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(text) and most < 20_000
