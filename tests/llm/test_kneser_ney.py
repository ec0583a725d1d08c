import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.llm import hashstore, kneser_ney as lm
from flowguard.llm.hashstore import Store


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + [0]


class Brute:
    def __init__(self, texts):
        rows = [tokens(t) for t in texts]
        self.c = collections.Counter(w for r in rows for w in r)
        self.pairs = collections.Counter(p for r in rows for p in zip([1, *r[:-1]], r))
        self.h, self.before = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
        for (v, w), n in self.pairs.items():
            self.h[v][0] += n
            self.h[v][min(n, 3)] += 1
            self.before[w] += 1
        self.d2, self.d1 = (lm.discounts(*[collections.Counter(x.values())[k] for k in (1, 2, 3, 4)]) for x in (self.pairs, self.before))
        self.n, self.words = sum(self.c.values()), len(self.c)
        of = collections.Counter(min(n, 3) for n in self.before.values())
        self.lower = sum(self.d1[k - 1] * of[k] for k in (1, 2, 3)) / sum(self.before.values())

    def p1(self, w):
        n = self.before[w]
        return max(n - (self.d1[min(n, 3) - 1] if n else 0), 0) / sum(self.before.values()) + self.lower / (self.words + 1)

    def p(self, v, w):
        if v not in self.h:
            return self.p1(w)
        total, *of = self.h[v]
        n = self.pairs[v, w]
        return max(n - (self.d2[min(n, 3) - 1] if n else 0), 0) / total + sum(a * b for a, b in zip(self.d2, of)) / total * self.p1(w)

    def score(self, text):
        k = tokens(text)
        base = sum(math.log10((self.c[w] + 0.5) / (self.n + 0.5 * (self.words + 1))) for w in k)
        return len(k), sum(self.c[w] > 0 for w in k), base, sum(math.log10(self.p(v, w)) for v, w in zip([1, *k[:-1]], k))


@pytest.mark.parametrize("part", [1 << 24, 300])
def test_equals_brute_force(docs, plain, monkeypatch, part):
    monkeypatch.setattr(lm, "PART_BYTES", part)
    train = docs.where(~lm.held_out(F.col("doc_id")))
    model = lm.fit(train)
    brute = Brute([t for k, t in plain.items() if zlib.crc32(str(k).encode()) % 5 != 1])
    assert (model.tokens, model.words) == (brute.n, brute.words)
    for r in lm.score(docs, model).collect():
        n, known, base, score = brute.score(plain[r.doc_id])
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    total = sum(brute.p("alpha1", w) for w in brute.c) + brute.p("alpha1", "not a word")
    assert total == pytest.approx(1)


def test_no_training_rows(docs, none):
    model = lm.fit(none)
    assert {r.score for r in lm.score(docs, model).collect()} == {0.0}
    assert lm.score(none, model).count() == 0


def test_store(tmp_path):
    store = Store(str(tmp_path), "t", 3, 64)
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    part = store.part(keys)
    for p in range(6):  # the last files are missing
        store.write(p, keys[part == p], np.arange(len(keys))[part == p])
    asked = np.concatenate([keys[::-1], keys[:5] + np.uint64(1)])
    want = [k if p < 6 else 0 for k, p in zip(range(len(keys)), part)][::-1] + [0] * 5
    assert store.look_up_all(asked)[:, 0].tolist() == want


def test_shared_folder_must_be_mounted(spark, monkeypatch):
    monkeypatch.setattr(hashstore, "work_folder", lambda *_: "hdfs://nowhere/x")
    with pytest.raises(ValueError):
        hashstore.mounted_folder(spark, "lm")


def test_frequent_first_words_are_spread_over_as_many_parts_as_they_fill():
    rng = np.random.default_rng(3)
    v = np.sort(rng.integers(0, 2**lm.SHORT, 50).astype(np.uint64))
    hot, spread, bits = v[[3, 20, 49]], np.array([2, 16, 5], np.uint64), 4
    own = np.repeat(v, 4000)
    home = lm._home(own, lm.pair_key(own, np.arange(len(own)).astype(np.uint64)), bits, hot, spread)
    for k, word in enumerate(v):
        parts, n = np.unique(home[own == word], return_counts=True)
        wanted = int(spread[np.searchsorted(hot, word)]) if word in hot else 1
        assert len(parts) == wanted and n.max() < 1.3 * 4000 / wanted
        first = int(word >> np.uint64(lm.SHORT - bits))
        assert {(first + j) % 16 for j in range(wanted)} == set(parts.tolist())
