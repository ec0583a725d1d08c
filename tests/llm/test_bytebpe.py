import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.llm import bytebpe as b

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(b.RANKS, "rb") as f:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=b.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return b.Coder(b.read_vocabulary())


def odd_texts():
    r = random.Random(7)
    letters = "aab  e1é\n\t'sdl.,-日本🙂ñ́ \r\x85\x1c "
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(r.choice(["ab", "a", "ba", " ", "  "]) for _ in range(r.randint(0, 40))) for _ in range(1000)]
    return texts + ["", " ", "<|endoftext|>", "x" * 30000, " " * 5000, "\n" * 999 + "a", "don't I'LL we've"]


def test_equals_the_library(coder, library):
    texts = odd_texts()
    coded = coder.encode([None, *texts])[1:]
    assert [x.tolist() for x in coded] == [library.encode_ordinary(t) for t in texts]
    assert [coder.decode(x) for x in coded] == [t.encode() for t in texts]


def test_characters_of_all_kinds(coder, library):
    assert coder.vocabulary.agreed
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 37 == 0)]
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    assert [x.tolist() for x in coder.encode(texts)] == library.encode_ordinary_batch(texts, num_threads=4)
    whole = [t for t in texts if not b.OTHER.search(t)]
    assert whole and [coder.words(t) for t in whole] == [coder.split(t) for t in whole]


def test_cut_texts_have_the_same_ids(coder, library, monkeypatch):
    assert coder.encode(["\u1c89a ﳉ"])[0].tolist() == library.encode_ordinary("\u1c89a ﳉ")
    for text in odd_texts()[:800]:
        pieces = list(b.cuts(text, 5))
        assert "".join(pieces) == text
        assert sum(map(library.encode_ordinary, pieces), []) == library.encode_ordinary(text)
    monkeypatch.setattr(b, "SLICE", 40)
    monkeypatch.setattr(b, "cuts", lambda t, n=7, cut=b.cuts: cut(t, n))
    text = "ab cd\nef  gh " * 40
    assert coder.encode([text, "", None])[0].tolist() == library.encode_ordinary(text)


def test_places_name_the_characters_of_each_token(coder):
    for text in odd_texts()[:300]:
        data = np.frombuffer(text.encode(), np.uint8)
        ids = coder.encode([text])[0]
        at, of = 0, np.array([k for k, c in enumerate(text) for _ in c.encode()], int)
        for i, start, stop in zip(ids.tolist(), *(x.tolist() for x in coder.places(ids, data))):
            own = of[at : (at := at + len(coder.vocabulary.raw[i]))]
            assert (start, stop) == (own[0], own[-1] + 1)


def test_split_characters(spark, coder):
    ids = coder.encode(["🙂"])[0].tolist()
    whole = spark.createDataFrame([(ids,), (ids[:1],), (ids + [None, -1, 10**6],), ([],), (None,)], "ids array<int>")
    got = [r.back for r in b.decode(whole, "back").collect()]
    assert [r.text for r in got] == ["🙂", "�", "🙂", "", None]
    assert len(ids) > 1 and got[1].raw == coder.vocabulary.raw[ids[0]] and got[4].raw is None


def test_spark(spark, docs, plain, none, library):
    coded = b.encode(docs, "coded", offsets=True)
    assert coded.columns == [*docs.columns, "coded"]
    for r in coded.select("doc_id", "coded.*").collect():
        text = plain[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text) and r.n_tokens == len(r.ids) == len(r.start) == len(r.stop)
        assert not r.ids or (r.start[0] == 0 and r.stop[-1] == len(text))
    packed = b.encode(docs, "coded", packed=True).select("doc_id", F.col("coded").ids.alias("ids"))
    back = {r.doc_id: r.back for r in b.decode(packed, "back").collect()}
    assert {k: v.text for k, v in back.items()} == {k: t or "" for k, t in plain.items()}
    assert b.encode(none, "coded").count() == 0
    twice = b.encode(docs.union(docs), "coded").groupBy("doc_id").agg(F.count("*").alias("n"), F.size(F.collect_set("coded.ids")).alias("d"))
    assert {(r.n, r.d) for r in twice.collect()} == {(2, 1)}


def test_query(spark, tmp_path, docs, plain, library):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in b.query(spark, str(tmp_path)).collect():
        ids = library.encode_ordinary(plain[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((plain[r.doc_id] or "").encode()).hexdigest()


def test_files_that_are_no_vocabulary(tmp_path):
    lines = [base64.b64encode(bytes([k])) + b" %d\n" % k for k in range(256)]
    (tmp_path / "few").write_bytes(b"".join(lines[:-1]))
    with pytest.raises(ValueError, match="no token for"):
        b.read_vocabulary(str(tmp_path / "few"))
    (tmp_path / "gap").write_bytes(b"".join(lines) + base64.b64encode(b"abc") + b" 256\n")
    with pytest.raises(ValueError, match="no merge"):
        b.read_vocabulary(str(tmp_path / "gap"))
