"""The pipeline against its stages done by brute force."""

import hashlib

import duckdb
import pandas as pd
import pytest
from test_operators import SCHEMA, TEXTS, brute_lines, brute_near, rows

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from latticework.llm import mixing  # noqa: E402


def write(spark, tmp_path, data):
    spark.createDataFrame(data, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_run(spark, tmp_path):
    from tokenizers import Tokenizer

    data = rows()[:-1]  # ids are unique here
    got = corpus_pipeline.run(spark, write(spark, tmp_path, data)).toPandas()
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = {r[0]: (r[1], r[3]) for r in data if any(c.isalpha() for c in r[1] or "")}
    dropped = {k: "\n".join(x) for (k, _), x in brute_lines([(k, t) for k, (t, _) in docs.items()]).items()}
    dropped = {k: t for k, t in dropped.items() if t.strip(" \t\n\x0b\f\r") or t == docs[k][0]}
    near = brute_near(dropped, 5, 80)
    kept = {k: t for k, t in dropped.items() if near[k][1] == k}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(k, t, docs[k][1]) for k, t in kept.items()], columns=["doc_id", "text", "source"]))
    want = sorted(con.sql(mixing.oracle()).df()["doc_id"].tolist())
    assert sorted(got["doc_id"].tolist()) == want
    for r in got.itertuples():
        ids = lib.encode(kept[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [])).count() == 0


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    folder = write(spark, tmp_path, [*rows(), (None, None, None, None, None, None, None, None, None, None), (None, TEXTS[6], "en", "a", 1, "", 1, "", "", 1)])
    docs = spark.read.parquet(folder + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == corpus_pipeline.COLUMNS and out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
