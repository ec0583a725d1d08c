import random
import re

import xxhash
from pyspark.sql import functions as F

from flowguard.llm import simhash as s
from flowguard.llm.components import components


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints):
    at = {i: i for i in prints}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return {i: root(i) for i in prints}


def test_groups_equal_brute_force(docs, plain):
    got = {r.doc_id: (int(r.h, 16), r.component_id) for r in s.groups(docs).withColumn("h", s.as_hex(F.col("fingerprint"))).collect()}
    prints = {k: fingerprint(t) for k, t in plain.items()}
    want = roots(prints)
    assert got == {k: (prints[k], want[k]) for k in plain}


def test_large_buckets_lose_no_link(spark):
    r = random.Random(2)
    center = r.getrandbits(64)
    near = {center ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)} | {r.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    links = s.links(spark.createDataFrame([(x,) for x in signed], "f long"))
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    label = {r.node: r.root for r in components(links).collect()}
    got = {}
    for x in signed:
        got.setdefault(label.get(x, x), set()).add(x)
    want = {}
    for i, k in roots(dict(enumerate(x & (1 << 64) - 1 for x in signed))).items():
        want.setdefault(k, set()).add(signed[i])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_chain_is_one_component(spark):
    chain = [(k, k + 1) for k in range(70)] + [(100, 101), (101, 101)]
    label = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert label == {**{k: 0 for k in range(71)}, 100: 100, 101: 100}


def test_empty_table(none):
    assert s.groups(none).count() == 0
