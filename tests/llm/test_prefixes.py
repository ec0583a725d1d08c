import hashlib
import random
import zlib

import numpy as np
import pytest

from flowguard.llm import prefixes as p


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(role, text) for *_, role, text in sorted(x)] for c, x in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    nodes = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            nodes.setdefault(tuple(x[:d]), []).append(c)
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(k))))
        parent = min(nodes[k[:-1]]) if k else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(k), parent, len(members), len(children.get(k, [])), leaves[k], saved[k], digest))
    return sorted(out, key=repr)


def rows_of(seed, convs=260, longest=9, texts="abc"):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        if c % 100 == 0 and c // 100 == 2:
            continue  # a base that is absent
        for turn in range(r.randint(0, longest)):
            rows.append((c, r.choice([turn, turn, None]), r.choice(["user", "assistant", None]), r.choice([*texts, None, "é🙂", "long " * 20])))
    copy = [("user", "hello"), ("assistant", "é"), ("user", "bye")]
    for c in range(1000, 1150):  # a group of copies
        rows += [(c, k, *t) for k, t in enumerate(copy)]
    return rows + rows[:7]  # repeated rows


def frame(spark, rows):
    extra = [(c, t, r, x, 1, "y") for c, t, r, x in rows]
    return spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, depth int, parent_conv_id string").repartition(5)


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_nodes(spark):
    rows = rows_of(1) + [(None, 0, "user", "of nobody")]
    assert found(p.trie(frame(spark, rows))) == brute(rows)


def test_small_shards_bands_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(p, "BLOCK", 7)
    rows = rows_of(2, longest=14, texts="ab")
    # one conversation with most of the turns, and a copy of half of it
    rows += [(4000, k, "user", str(k % 3)) for k in range(900)] + [(4001, k, "user", str(k % 3)) for k in range(450)]
    want = brute(rows)
    assert found(p.trie(frame(spark, rows), shard=50, band=3)) == want
    assert found(p.trie(frame(spark, rows))) == want


def test_negative_ids_and_empty(spark):
    rows = [(1, None, None, None), (1, None, None, None), (5, 3, "a", "b")]
    assert found(p.trie(frame(spark, rows))) == brute(rows)
    assert p.trie(frame(spark, rows).where("conv_id < 0")).count() == 0
    assert p.trie(frame(spark, [(-7, 0, "a", "b"), (-205, 0, "a", "b")])).count() >= 1


def test_slots_have_no_gaps_and_no_strangers():
    r = np.random.default_rng(3)
    a, b = (r.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    a[10:20] = a[9]  # equal in one lane only
    table = p.SlotTable(a, b)
    slot = table.find(a, b)
    assert sorted(slot.tolist()) == list(range(5000))
    assert (table.find(a, b ^ np.uint64(1)) == -1).all()
    assert len(p.SlotTable(a[:0], b[:0]).find(a[:2], b[:2])) == 2


def test_sums_go_up_level_by_level():
    # 0 - 1 - 2, 0 - 3; 4 stands alone
    parent, depth = np.array([-1, 0, 1, 0, -1]), np.array([0, 1, 2, 1, 5])
    got = p.accumulate(np.array([[1, 0], [10, 0], [100, 1], [1000, 1], [7, 7]]), parent, depth)
    assert got.tolist() == [[1111, 2], [110, 1], [100, 1], [1000, 1], [7, 7]]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(p.query(spark, sf)) == brute(rows)
