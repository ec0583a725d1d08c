import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from flowguard.llm import substrings as s
from flowguard.llm.fmindex import FMIndex


def brute(texts, window):
    seen, out = set(), {}
    for key in sorted(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[key] or "")
        gone = set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone |= set(range(i, i + window))
            seen.add(k)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[key] = (len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window,gram", [(20, 8), (5, 3)])
def test_equals_brute_force(docs, plain, window, gram):
    rows = s.deduplicate(docs, window=window, gram=gram).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in rows} == brute(plain, window)


@pytest.mark.parametrize("shard", [30, 200, 2000])
def test_small_shards_and_heavy_minimisers_give_the_same(docs, plain, monkeypatch, shard):
    monkeypatch.setattr(s, "SHARD_WORDS", shard)
    monkeypatch.setattr(s, "HEAVY_WORDS", shard)
    rows = s.deduplicate(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in rows} == brute(plain, 20)


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(map(str, range(30)))
    rows = spark.createDataFrame([(3, t), (3, t), (None, t), (4, t)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in s.deduplicate(rows).collect()) == [(0, 0), (3, 30), (3, 30), (4, 30)]


def test_empty_table(none):
    assert s.deduplicate(none).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(0, 5), min_size=1, max_size=25), st.integers(1, 6))
def test_matching_statistics(text, query, depth):
    t, q = np.array(text), np.array(query)
    index = FMIndex(t, depth)
    for at, long, lo, hi in index.stream(q, np.array([len(q)]), len(q)):
        i, m = int(at[0]), int(long[0])
        fits = [n for n in range(1, depth + 1) if i + n <= len(q) and any(text[k : k + n] == query[i : i + n] for k in range(len(text) - n + 1))]
        assert m == max(fits, default=0)
        if m:
            assert sorted(index.suffix[lo[0] : hi[0]]) == [k for k in range(len(text) - m + 1) if text[k : k + m] == query[i : i + m]]


@pytest.mark.parametrize("shard", [30, 1 << 18])
def test_texts_under_one_id_keep_their_own_spans(spark, monkeypatch, shard):
    monkeypatch.setattr(s, "SHARD_WORDS", shard)
    monkeypatch.setattr(s, "HEAVY_WORDS", shard)
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(50)) for x in "abcd")
    rows = [(None, a), (None, f"{b} {c}"), (None, d), (1, f"x {a} y"), (1, f"{d} z"), (1, "own " + b), (1, "own " + b), (2, f"{c[:100]} tail")]
    kept = sorted(((r.doc_id, r.kept) for r in s.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept == sorted([(None, a), (None, f"{b} {c}"), (None, d), (1, "x y"), (1, "z"), (1, "own"), (1, "own"), (2, "c2 tail")], key=str)


def test_repeated_rows_reach_the_index_once(spark):
    import pyarrow as pa

    text = " ".join(f"w{k}" for k in range(40))
    asked = [{"m": 1, "start": 0, "n": 3, "heavy": False}]
    rows = pa.RecordBatch.from_pydict({"doc": [1] * 300 + [2], "sub": [9] * 301, "text": [text] * 301, "asked": [asked] * 301})
    fetched = [r for b in s._fetch(20)(iter([rows.slice(0, 150), rows.slice(150)])) for r in b.to_pylist()]
    assert [(r["doc"], r["text"]) for r in fetched] == [(k, " ".join(text.split()[:22])) for k in (1, 2)]
    same = spark.createDataFrame([(1, text)] * 300 + [(2, text + " end")], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed) for r in s.deduplicate(same).collect()}
    assert got == {(1, 0), (2, 40)}


def test_ids_of_any_type(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(50)) for x in "ab")
    rows = [("10", "x " + a), ("9", a), (None, b), ("", b + " tail"), ("z", "short")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.kept for r in s.deduplicate(df).collect()}
    assert got == {"10": rows[0][1], "9": "", None: b, "": "tail", "z": "short"}
    assert s.deduplicate(df).schema["doc_id"].dataType.simpleString() == "string"
    assert s.deduplicate(df.where("false")).count() == 0
    small = spark.createDataFrame([(2, a), (1, a)], "doc_id int, text string")
    assert {(r.doc_id, r.n_removed) for r in s.deduplicate(small).collect()} == {(1, 0), (2, 50)}
