"""License scans against brute force over all places of all templates."""

import random
import re
from math import ceil

import numpy as np
import pytest

from latticework.llm import licenses, queries
from latticework.llm.licenses import Template

FOLDER = "/root/testdata/sf0.001"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for k, y in enumerate(b):
            row[k + 1] = before[k] + 1 if x == y else max(row[k], before[k + 1])
    return row[-1]


def brute(text, templates=licenses.PHRASES + licenses.NOTICES, k=3):
    """The contract's columns but for the id, by looking at every place for every template."""
    words = words_of(text)
    base, labels, score = [], set(), 0.0
    for t in templates:
        own = words_of(t.text)
        if t.exact:
            places = [p for p in range(len(words)) if words[p : p + len(own)] == own]
            base += [(p, t.label) for p in places]
            continue
        lines = {}
        for p in range(len(words) - k + 1):
            for q in range(len(own) - k + 1):
                if words[p : p + k] == own[q : q + k]:
                    lines.setdefault(p - q, set()).add(q)
        groups = []
        for d in sorted(lines):
            if groups and d - groups[-1][-1] <= t.slack:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            if len(set().union(*(lines[d] for d in g))) < max(1, ceil((len(own) - k + 1) / 4)):
                continue
            start = max(g, key=lambda d: (len(lines[d]), -d))
            window = words[max(0, start - t.slack) : max(0, start + len(own) + t.slack)]
            share = longest_common(own, window) / len(own)
            if share >= t.share and {*t.needed} <= {*window}:
                labels.add(t.label)
                score = max(score, share)
    at = [p for p, _ in base]
    named = {name for _, name in base}
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(named)), ",".join(sorted(labels | named)), 1.0 if base else score


MIT = licenses.NOTICES[0].text
COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_whole_table(spark):
    import duckdb

    rows = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    df = queries.QUERIES["op12_licenses"](spark, FOLDER)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in ["doc_id", *COLUMNS]} == dict(zip(["doc_id", *COLUMNS], ["bigint"] * 5 + ["string"] * 2 + ["double"], strict=True))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}
    assert got == {doc: brute(text) for doc, text in rows}
    assert sum(g[1] for g in got.values()) > 0


def odd_texts():
    rnd = random.Random(3)
    some = [
        None, "", " ,.; ", "mit", "cc by", "CC-BY-NC", "cc by nc by nc cc by nc", "under the MIT license " * 3, "Under, the\nMIT\tLicense", "under the mïT license", "xunder the mit license",
        "Apache License, Version 2.0 apache license version 2", "apache license version 20", MIT, MIT.upper().replace(",", "\n#"), "pre " * 40 + MIT + " post" * 40, MIT.replace("obtaining", "who obtains"),
        MIT.replace("free of charge", "").replace("copy", "copy or two"), "GNU General Public License version 2 GNU General Public License, version 3", "gnu general public license version 4",
        "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "é" * 50 + " cc by nc ü", "a" * 3_000_000 + " cc by nc",
    ]
    pool = words_of(MIT) + words_of(licenses.NOTICES[1].text) + ["under", "the", "mit", "license", "cc", "by", "nc", "x"]
    some += [" ".join(rnd.choice(pool) for _ in range(rnd.randrange(200))) for _ in range(20)]
    for _ in range(30):  # notices with words lost, changed and put in
        own = words_of(rnd.choice(licenses.NOTICES).text)
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(own))
            own[k : k + rnd.randrange(2)] = [rnd.choice(pool)] * rnd.randrange(2)
        some.append(" ".join(["x", *own, "y"] * rnd.randrange(1, 3)))
    return some


def test_odd_rows(spark):
    texts = odd_texts()
    rows = [(k, t, 1, "m", "z", 0) for k, t in enumerate(texts)]
    rows += [(None, "cc by nc", 1, "m", "z", 0), (None, "cc by nc", 1, "m", "z", 0), (None, None, 1, "m", "z", 0), (5, texts[5], 2, "m", "z", 0), (5, MIT, 2, "m", "z", 0)]  # null and repeated ids
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, labels string, h string, template int")
    out = licenses.license_labels(df)
    assert out.columns == ["doc_id", *COLUMNS]
    got = sorted([tuple(r) for r in out.collect()], key=repr)
    assert got == sorted([(doc, *brute(text)) for doc, text, *_ in rows], key=repr)


def test_no_rows(spark):
    assert licenses.license_labels(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    found = [r[0] for r in licenses.license_labels(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).select("labels").collect()]
    assert found == [""]


def test_own_templates_and_spans(spark):
    mine = [Template("two", "alpha beta", exact=True), Template("long", "one two three four five six seven eight nine ten", share=0.7)]
    text = "alpha beta x one two three four drop five six eight nine ten alpha beta"
    texts, spans = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), mine)
    assert [r.n_words for r in texts.collect()] == [15]
    assert sorted((r.label, r.exact, r.first_word, r.share) for r in spans.collect()) == [("long", False, 3, 0.9), ("two", True, 0, 1.0), ("two", True, 13, 1.0)]
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), [Template("none", " ,", exact=True)])


@pytest.mark.parametrize("size", [1, 2, 5, 1 << 20])
def test_hashes_do_not_depend_on_parts(size):
    rnd = random.Random(size)
    seen = {}
    for _ in range(100):
        data = "".join(rnd.choice("aB1 ,é-z\n") for _ in range(rnd.randrange(60))).encode()
        words = licenses.WORD.findall(data.lower())
        hashes = np.concatenate([*licenses.word_hashes(data, size), np.empty(0, np.uint64)]).tolist()
        assert len(hashes) == len(words)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes, strict=True))
    assert len({*seen.values()}) == len(seen)


def test_in_order_against_the_table():
    rnd = random.Random(8)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(1, 12))] for _ in range(2))
        assert licenses.in_order(a, b) == longest_common(a, b)
