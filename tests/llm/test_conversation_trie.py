import hashlib
import random
import zlib

import duckdb
import pytest

from taleframe.llm import conversation_trie as trie


def plain(rows):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in said.items()}
    paths = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        paths[c] = tuple(said.get(base, [])[:h] + said[c][h:])
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = own + sum(saved[k] for k in kids.get(p, []))
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(11)
    openings = ["hi", "hello", "", None, "é😀", "x" * 3000]
    rows = []
    for c in [*range(-12, 90), 1000, 2**40 + 3, 2**40]:
        if c % 5 == 0 and rng.random() < 0.2:
            continue  # a base may be absent
        n = rng.choice([1, 1, 2, 3, 5, 9, 14])
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(openings)) for t in range(n)]
    rows += [(c, t, "user", "copy") for c in range(200, 260) for t in range(3)]
    rows += [(300, t, "user", f"long {t}") for t in range(40)] + [(305, t, "user", f"long {t}") for t in range(40)] + [(310, t, "user", f"long {t if t < 25 else -t}") for t in range(33)]
    rows += [(301, t, "user", f"own {t}") for t in range(20)] + [(302, t, "user", f"own {t}") for t in range(20)]
    rows += [(400, None, "user", "no turn"), (400, 1, "b", "same turn"), (400, 1, "a", "same turn"), (400, 1, "a", "same"), (400, 1, "a", "same"), (None, 1, "user", "nobody's"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 9, 13])
def test_equals_a_plain_trie(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = fixture()
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth int, members string")
    frame.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in trie.op12_conversation_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.sql(trie.OP12_SQL).fetchall(), key=str) == got


def test_one_conversation_over_many_parts(spark):
    rows = [(7, t, "user", f"turn {t}") for t in range(500)] + [(5, t, "user", f"base {t}") for t in range(4)] + [(12, 0, "user", "other")]
    got = sorted((tuple(r) for r in trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    assert got == plain(rows)


def test_ids_of_a_node_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "NEAR_IDS", 3)
    rows = [(1, 1, c) for c in range(-40, 200, 3)] + [(2, 5, 9)]
    got = {tuple(r) for r in trie.end_digests(spark.createDataFrame(rows, "a long, b long, conv_id long")).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 1, sha(range(-40, 200, 3))), (2, 5, sha([9]))}


def test_empty(spark):
    assert trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
