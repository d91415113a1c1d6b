"""The trie of rebuilt conversations against its contract written out plainly, and against its SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from latticework.llm import queries, trie

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, len string, k1 int"


def remainder(c, n):
    return abs(c) % n * (1 if c >= 0 else -1)


def plainly(rows):
    """The contract, with every prefix of every conversation as a tuple."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(found)] for c, found in own.items()}
    members = defaultdict(list)
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = (*turns.get(c - remainder(c, 20), [])[:h], *mine[h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = defaultdict(list)
    for name in members:
        if name:
            children[name[:-1]].append(name)
    leaves, saved = {}, {}
    for name in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", name[-1][1])) if name else 0
        leaves[name] = sum(leaves[x] for x in children[name]) or 1
        saved[name] = (len(members[name]) - 1) * words + sum(saved[x] for x in children[name])
    out = []
    for name, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == name)))
        up = min(members[name[:-1]]) if name else None
        out.append((min(convs), len(name), up, len(convs), len(children[name]), leaves[name], saved[name], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(spark, rows, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = trie.prefix_trie(*trie.rebuilt(trie.numbered(df)))
    assert out.columns == COLUMNS
    return sorted(tuple(r) for r in out.collect())


def test_whole_table(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{FOLDER}/conversations.parquet'").fetchall()
    df = queries.QUERIES["op11_conversations"](spark, FOLDER)
    assert df.dtypes == [(c, "string" if c == "ends_sha256" else "bigint") for c in COLUMNS]
    got = sorted(tuple(r) for r in df.collect())
    assert got == plainly(rows)
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{FOLDER}/conversations.parquet'")
    assert sorted(con.sql(trie.ORACLE).select(*COLUMNS).fetchall()) == got


def odd_rows():
    rnd = random.Random(2)
    rows = []
    for c in [*range(70), -3, -20, -21, 1000, 10**15, 2**62]:
        for turn in range(rnd.randrange(1, 7)):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["a b", "c", "", " \t", "wéll über"]), 1, "n", 2))
    rows += [(c, None, None, None, 1, "n", 2) for c in (3, 4, 200, None, None)]  # null turns stand first; rows without an id are left out
    rows += [(5, 2, None, "x", 1, "n", 2), (5, 2, "", "y", 1, "n", 2), (5, 2, "", "y", 1, "n", 2)][1:]  # repeated rows
    rows += [(6, 3, "user", "tie", 1, "n", 2), (6, 3, "a", "tie", 1, "n", 2), (None, 1, "user", "lost", 1, "n", 2)]
    rows += [(7, k, "user", "long " * 400_000, 1, "n", 2) for k in range(2)]
    rows += [(300 + c, t, "user", f"same {t}", 1, "n", 2) for c in range(60) for t in range(6)]  # a group of copies
    rows += [(400 + c, 0, "user", "chain", 1, "n", 2) for c in range(30)] + [(400 + c, t, "user", f"link {min(c, 30 - t)}", 1, "n", 2) for c in range(30) for t in range(1, 25)]
    return rows


@pytest.mark.parametrize("block, chunk", [(1024, 1 << 20), (3, 40)])
def test_odd_rows(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = odd_rows()
    assert found(spark, rows) == plainly(rows)


def test_one_conversation_has_most_rows(spark):
    """It is numbered in several ranges, named and summed in several blocks."""
    rows = [(40, k % 3000 if k else None, "user", f"t {k}", 1, "n", 2) for k in range(3000)] + [(40 + c, k, "user", f"t {k}", 1, "n", 2) for c in range(1, 20) for k in range(5)]
    assert found(spark, rows) == plainly(rows)


def test_order_of_rows_does_not_matter(spark):
    rows = [(c, turn, "user", f"{turn} {k}", 1, "n", 2) for c in range(25) for turn in range(3) for k in range(2)]  # ties by turn and role
    assert found(spark, rows) == found(spark, rows[::-1], 2)


def test_turnless_and_none(spark):
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    assert found(spark, [(lone, 0, "user", "taken by a family that is absent", 1, "n", 2)]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert found(spark, []) == []


def test_rounds_grow_with_light_edges_only(spark, monkeypatch):
    """A path of 200 turns has one round, a full binary trie of depth 5 as many as its light edges and one more."""
    rounds = []
    real = trie.written
    monkeypatch.setattr(trie, "written", lambda df, label: rounds.append(label) or real(df, label))
    rows = [(20 * c, k, "user", f"t {k}", 1, "n", 2) for c in range(1, 4) for k in range(200)]
    assert found(spark, rows) == plainly(rows)
    assert rounds.count("sums") == 1
    rounds.clear()
    rows = [(20 * c, k, "user", str(c >> k & 1), 1, "n", 2) for c in range(32) for k in range(5)]
    assert found(spark, rows) == plainly(rows)
    assert rounds.count("sums") == 6
