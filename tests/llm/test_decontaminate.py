import re

import pytest
from pyspark.sql import functions as F

from flowguard.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(texts, items, window=13):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    wins = {}
    for name, t in items:
        w = WORD.findall((t or "").translate(low))
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[i : i + n]), set()).add(name)
    sizes = {len(k) for k in wins}
    out = {}
    for key, t in texts.items():
        w, hit, names = WORD.findall((t or "").translate(low)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = wins.get(tuple(w[i : i + n]))
                if found is not None:
                    hit |= set(range(i, i + n))
                    names |= found
        out[key] = (len(w), len(hit), sorted(str(n) for n in names if n is not None), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_equals_brute_force(spark, docs, plain, block):
    words = plain[max(k for k, t in plain.items() if t and len(t) > 9000)].split()
    items = [(1, " ".join(words[5:40])), (2, "one"), (3, None), (4, ""), (5, " ".join(words[100:113]).upper()), (6, " ".join(words[5:40])), (10, "a a a a a a a a a a a a a a a"), (None, " ".join(words[300:330])), (None, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = d.mark(docs, bench, "hits", block_bytes=block).collect()
    want = brute(plain, items)
    assert {r.doc_id: (r.hits.n_words, r.hits.n_hit, r.hits["items"], r.hits.contaminated) for r in rows} == want
    assert all(r.found == "x" and r.n_words == 1 for r in rows)


def test_empty_tables(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.mark(docs, bench, "hits").where(F.col("hits").contaminated).count() == 0
    assert d.mark(none, bench, "hits").count() == 0
