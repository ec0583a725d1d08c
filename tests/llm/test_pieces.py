import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.llm import pieces as p

pytestmark = pytest.mark.skipif(not os.path.exists(p.MODEL), reason="needs the vocabulary file")


@pytest.fixture(scope="module")
def coder():
    return p.Encoder(p.read_vocabulary())


def test_equals_the_library(coder):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=p.MODEL)
    r = random.Random(4)
    letters = "ab thé \n\t  ▁日本ﬁ\x00🙂123.-="
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(500)]
    texts += [" " * n for n in range(40)] + ["-" * n + " " * n for n in range(40)] + ["x" * 6000]
    coded = coder.encode(texts)
    assert [c.tolist() for c in coded] == library.encode(texts)
    assert [coder.decode(c) for c in coded] == [t.replace(p.MARK, " ") for t in texts]


def test_unigram_path_is_the_best(coder):
    scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.1, "aba": -5.6, "bb": -9.0, p.MARK: -1.0, p.MARK + "a": -2.2}
    names = [f"<{b}>" for b in range(256)] + list(scores)
    v = p.Vocabulary(names, [0.0] * 256 + list(scores.values()), list(range(256)), set(), merging=False)
    own = p.Encoder(v)
    for word in map("".join, itertools.product("ab", repeat=6)):
        marked = p.MARK + word

        def best(i):
            if i == 0:
                return 0.0
            return max(best(j) + scores[marked[j:i]] for j in range(i) if marked[j:i] in scores)

        ids = own.encode([word])[0]
        assert sum(v.scores[i] for i in ids) == pytest.approx(best(len(marked)))
        assert own.decode(ids) == word


def test_common_prefixes_share_states(coder, monkeypatch):
    steps = []
    forward = p.Encoder._forward
    monkeypatch.setattr(p.Encoder, "_forward", lambda self, w, s: (steps.append(len(w) + 1 - len(s)), forward(self, w, s)))
    coder.encode_words({"▁shared" + x for x in ("", "s", "st", "sto")})
    assert sum(steps) == len("▁sharedsto")


def test_spark_round_trip(docs, plain, none):
    coded = p.encode(docs, "coded")
    back = p.decode(coded.select("doc_id", "coded.ids", "coded.round_trip"), "back").collect()
    assert {r.doc_id: r.back for r in back} == {k: t or "" for k, t in plain.items()}
    assert all(r.round_trip for r in back)
    assert p.encode(none, "coded").count() == 0
    assert p.decode(coded.select(F.lit(None).cast("array<int>").alias("ids")), "text").where("text IS NOT NULL").count() == 0
    assert np.array_equal(p.Encoder(p.read_vocabulary()).encode([None, ""])[1], [])
