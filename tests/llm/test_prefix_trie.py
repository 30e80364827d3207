"""The prefix trie against a plain program and its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from skein.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def told(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def talks_of(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn, role or "", text or ""))
    return {c: [(r, x) for _, r, x in sorted(t, key=lambda v: (v[0] is not None, v[0] or 0, told(v[1], v[2])))] for c, t in talks.items()}


def rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c - (abs(c) % 100) * (1 if c >= 0 else -1))
        out[c] = talks.get(base, [])[:h] + own[h:]
    return out


def plain_trie(talks):
    members = defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, rows = defaultdict(list), []
    for prefix in members:
        if prefix:
            kids[prefix[:-1]].append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        leaves[prefix] = sum(leaves[k] for k in kids[prefix]) or 1
        last = len(prefix[-1][1]) if prefix else 0
        saved[prefix] = (len(members[prefix]) - 1) * last + sum(saved[k] for k in kids[prefix])
    for prefix, convs in members.items():
        ends = sorted(c for c in convs if len(talks[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        rows.append((min(convs), len(prefix), parent, len(convs), len(kids[prefix]), leaves[prefix], saved[prefix], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=lambda r: r[:2])


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: r[:2])


def random_talks(n, seed, ids=None):
    rng, rows = random.Random(seed), []
    for conv in ids or range(n):
        for turn in range(rng.choice((1, 2, 3, 4, 6, 9))):
            rows.append((conv, rng.choice((turn, turn, turn, None)), rng.choice(("user", "assistant", None)), rng.choice(("a", "b", "", None, "long text ü"))))
    rng.shuffle(rows)
    return rows


def test_op12_equals_plain_program(spark, tmp_path):
    ids = [*range(0, 260), -7, -100, -250, 5000, 5001, 10**12 + 3]
    rows = random_talks(0, 5, ids) + [(None, 1, "user", "lost"), (270, 0, "user", "x"), (270, 0, "user", "x")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert collected(prefix_trie.op12_prefix_trie(spark, str(tmp_path))) == plain_trie(rebuilt(talks_of(rows)))


def test_op12_on_the_test_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = collected(prefix_trie.op12_prefix_trie(spark, sf))
    assert got == plain_trie(rebuilt(talks_of(rows)))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    sql = con.sql(prefix_trie.ORACLE)
    at = [sql.columns.index(c) for c in COLUMNS]
    assert sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=lambda r: r[:2]) == got


@pytest.mark.parametrize("bits", [0, 2, 5])
def test_collisions_are_split(spark, bits):
    rows = random_talks(60, 11)
    turns = prefix_trie.turn_digests(spark.createDataFrame(rows, SCHEMA))
    assert collected(prefix_trie.trie(turns, bits=bits)) == plain_trie(talks_of(rows))


def test_empty_and_other_columns(spark, tmp_path):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(3, 1, "user", "Hi", "x"), (4, 1, "user", "Hi", "y")], "depth long, print long, who string, said string, before string")
    got = collected(prefix_trie.prefix_trie(df, "depth", turn_col="print", role_col="who", text_col="said"))
    assert got == plain_trie({3: [("user", "Hi")], 4: [("user", "Hi")]})


def test_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIST", 7)
    rows = [(c, t, "user", f"t{t}") for c in range(40) for t in range(5)] + [(99, t, "user", f"t{t}") for t in range(25_000)] + [(100, 0, "user", "ü" * 2_000_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    talks = talks_of(rows)
    got = collected(prefix_trie.prefix_trie(df))
    assert len(got) == 25_002
    deep = {r[1]: r for r in got if r[0] in (0, 99)}
    assert deep[5][:6] == (0, 5, 0, 41, 1, 1) and deep[5][7] == hashlib.sha256(",".join(map(str, range(40))).encode()).hexdigest()
    assert deep[6][:6] == (99, 6, 0, 1, 1, 1) and deep[25_000][3:7] == (1, 0, 1, 0)
    assert deep[0][3:7] == (42, 2, 2, 40 * 2 * 5)
    assert len(talks) == 42


def test_rolling_equals_horner():
    rng = np.random.default_rng(1)
    values, first = rng.integers(0, 2**48, 500).astype(np.uint64), rng.random(500) < 0.1
    for lead in (True, False):
        first[0] = lead
        for prime in prefix_trie.PRIMES:
            got, f, want = prefix_trie.rolling(values, first, 12345, 98765, prime), 12345, []
            for v, new in zip(values.tolist(), first):
                f = ((0 if new else f) * 98765 + v) % prime
                want.append(f)
            assert got.tolist() == want
