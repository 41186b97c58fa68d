"""The conversation trie against a dictionary of all prefixes."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomspan.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = collections.defaultdict(list)
    dg = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", dg(role or "", text or ""), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items() if c is not None}
    members = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -(10**9), len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in list(members.items()))


def got(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("path", "part", "seq", "depth", "n", "size")})
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = C.prefix_trie(df, "conv_id", "turn", "role", "text").drop("prefix").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    return sorted(tuple(-(10**9) if x is None else x for x in r) for r in found)


def conversations():
    pick = random.Random(5)
    rows = [(None, 0, "user", "nobody's"), (2, None, None, None), (2, None, None, None), (2, 0, "user", ""), (3, 1, "user", "é漢"), (3, 1, "user", "tie"), (4, 9, "assistant", "x")]
    for c in range(10, 160):
        for t in range(pick.randrange(1, 14)):
            rows.append((c, t, ["user", "assistant"][t % 2], ["hello", "é" * 3, f"{t}"][pick.randrange(100) // 45]))
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]  # copies
    rows += [(-7, 0, "user", "minus"), (-5, 0, "user", "five")]
    return rows


@pytest.mark.parametrize("parts,block,batch,piece", [(1, 256, 1 << 18, 1 << 16), (4, 3, 40, 5), (40, 2, 7, 1 << 16)])
def test_equals_brute_force(spark, monkeypatch, parts, block, batch, piece):
    """Also with tiny blocks, batches and pieces, and more partitions than conversations fill."""
    monkeypatch.setattr(C, "BLOCK_TURNS", block)
    rows = conversations()
    pick = random.Random(9)
    pick.shuffle(rows)
    if block < 256:  # functions go to Python workers with the module's values
        monkeypatch.setattr(C, "BATCH_TURNS", batch)
        monkeypatch.setattr(C, "PIECE_BYTES", piece)
    assert got(spark, rows, parts) == brute(rows)


def test_one_conversation_with_most_turns(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_TURNS", 16)
    rows = [(11, t, "user", f"{t % 7}") for t in range(160)] + [(10, t, "user", f"{t % 7}") for t in range(60)] + [(c, t, "user", "a") for c in range(20, 40) for t in range(5)]
    assert got(spark, rows, 8) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []


def test_two_fattest():
    for a in range(60):
        for b in range(a + 1, 64):
            assert C.two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_exit_nodes_and_sums_of_a_trie():
    """Small blocks and batches, in this process: splits, ends inside edges, and the sums of expanded edges."""
    pick = random.Random(1)
    key = lambda p: hashlib.md5(repr(p).encode()).digest()
    for _ in range(60):
        paths = [tuple(pick.choice("ab") if pick.random() < 0.2 else "a" for _ in range(pick.randrange(0, 40))) for _ in range(40)]
        trie = C.ZFastTrie(key(()), 0, 1)
        want = collections.Counter()
        least = {}
        for i, p in enumerate(paths):
            trie.add([key(p[:d]) for d in range(len(p) + 1)], len(p), i, (1,))
            for d in range(len(p) + 1):
                want[key(p[:d])] += 1
                least.setdefault(key(p[:d]), i)
        for p in paths:
            passed, leaves = trie.exit([key(p[:d]) for d in range(len(p) + 1)], len(p))
            assert passed is leaves and passed.depth == len(p)
        rows = [(n.prefix(d), n.sums[0], n.least) for n, d, _ in trie.rows(True)]
        assert {k: c for k, c, _ in rows} == dict(want) and len(rows) == len(want)
        assert {k: m for k, _, m in rows} == least


def test_batches_and_blocks_in_process(monkeypatch):
    monkeypatch.setattr(C, "BATCH_TURNS", 5)
    rows = [(c, 0, C.ROOT, bytes([1]) * 16 + bytes([2 + c % 2]) * 16, 0, [1, 3], True) for c in range(10)]
    found = list(C._count(iter(rows)))
    assert sum(n for d, _, _, _, n, *_ in found if d == 1) == 10 and sum(1 for x in found if x[0] == 1) > 1
    assert {x[3] for x in found if x[0] == 2} == {2}
