import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import entries, oracles, prefix_trie

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, place int, depth string"


def said(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()


def plain(rows):
    """Nodes as tuples in the order of their values, from nested prefixes."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", said(role, text), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c > 0 else -1)
        built[c] = own.get(c - rest, [])[:h] + own[c][h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, m in sorted(members.items(), key=lambda x: -len(x[0])):
        leaves[node] += node not in kids
        saved[node] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), parent, len(m), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str)


EDGES = [
    (None, 1, "user", "of no conversation"),
    (3, None, "user", "first"),
    (3, 2, None, "third"),
    (3, -70, "user", None),
    (3, 2, None, "third"),
    (3, 2, "", "tie"),
    (5, 0, "user", "a"),
    (5, 1, "b", ""),
    (6, 0, "user", "é" * 3000),
    (-3, 0, "user", "first"),
    (-10, 9, "user", "a"),
    (-11, 9, "user", "a"),
    (4001, 0, "us", "era"),
    (8002, 0, "user", "a"),
    (9003, 0, "user", "a"),
]


def test_edges_against_plain_version(spark):
    assert trie(spark, EDGES) == plain(EDGES)
    assert trie(spark, EDGES[:1]) == trie(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_long_and_shared_conversations(spark, seed):
    """Beginnings that many share, lengths around the ends of blocks, and conversations that part in any block."""
    rng = random.Random(seed)
    stem = [("user" if i % 2 else "assistant", f"turn {i} " * (i % 3)) for i in range(140)]
    rows = []
    for c in rng.sample(range(-40, 400), 90):
        n = rng.choice([1, 2, 5, 31, 32, 33, 63, 64, 65, 96, 97, 130])
        cut = rng.choice([n, rng.randint(0, n)])
        turns = stem[:cut] + [("user", f"own {rng.randint(0, 1)} {i}") for i in range(n - cut)]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    found = trie(spark, rows)
    assert found == plain(rows) and max(r[1] for r in found) > 96


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = sorted(con.execute(oracles.SQL["op13_prefix_trie"]).fetchall(), key=str)
    found = sorted((tuple(r) for r in entries.op13_prefix_trie(spark, DATA).collect()), key=str)
    assert found == want
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert found == plain(rows)


def test_sums_of_a_long_conversation_climb_in_two_strides(spark):
    """4,000 turns explode to less than a tenth of their ancestors."""
    turns = spark.range(4000).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    placed = prefix_trie.placed_turns(turns).cache()
    rows, convs = prefix_trie.rebuilt_turns(placed)
    prefixes = prefix_trie.prefix_rows(prefix_trie.blocks(rows), convs)
    assert prefixes.agg(F.sum(F.size("chain") + F.greatest(F.size("tops"), F.lit(0)))).first()[0] < 4000 * 4001 // 20
    found = prefix_trie.trie(turns).orderBy("depth").collect()
    assert [r.depth for r in found] == list(range(4001)) and {(r.n_convs, r.n_leaves, r.saved_tokens) for r in found} == {(1, 1, 0)}
