import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from flowguard.llm import variants as v


def one_edit(a, b):
    """Whether two different words are at one edit: what is left between common ends is one character at most."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def brute(count):
    out = {}
    near = {w: [x for x in count if one_edit(w, x)] for w in count}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 5 * n else None
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), count[form[w]] if form[w] else None)
    return out


def words_of(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def vocabulary(seed, letters, n):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randint(6, 11))) for _ in range(n)}
    for w in list(words)[: n // 2]:
        k = r.randrange(len(w))
        words |= {w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :], w[:k] + w[k + 1 :]}
    return {w: r.choice([5, 6, 7, 30, 30, 200, 1300]) for w in words if len(w) >= 6}


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def table(spark, count):
    return spark.createDataFrame(list(count.items()), "word string, n long").repartition(3)


def test_scan_equals_brute_force():
    for seed, letters in enumerate(["ab", "abc", "abcdeé", "aÿ"]):
        words = sorted(set(vocabulary(seed, letters, 120)) | {"", "a", "b", "ab", "ba", "aa"})
        found = sorted(v.near_in(words, list(range(len(words)))))
        assert found == [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)]


def test_ranges_beyond_one_edit_are_skipped():
    words = sorted(["aaaaaa", "aaaaab"] + [f"zzzz{a}{b}" for a in "abcdefgh" for b in "abcdefgh"])
    seen = []

    class Word(str):
        def __getitem__(self, k):
            if isinstance(k, int):
                seen.append(str(self))
            return str.__getitem__(self, k)

    assert list(v.near_in([Word(w) for w in words], [0], v.prefixes(words))) == [(0, 1)]
    assert len({w for w in seen if w.startswith("z")}) == 1


def test_groups_of_any_size(spark):
    count = vocabulary(9, "abcé", 150) | vocabulary(10, "xy", 60)
    # a third under one half, and words that differ in one place only
    count |= {"commonhalf" + w: n for w, n in vocabulary(11, "pq", 40).items()}
    count |= {f"same{c}ending": 7 for c in "abcdefghijklmnopqrstuvwxyzéèê"}
    want = brute(count)
    for most in (3, 40, v.GROUP):
        assert got(v.group(table(spark, count), most=most)) == want
    assert any(root != form and form for form, root, *_ in want.values())  # chains of forms occur


def test_ties_and_empty(spark):
    count = {"letter": 5, "lettes": 25, "lettet": 25, "letteé": 25}
    assert got(v.group(table(spark, count))) == brute(count)
    assert brute(count)["letter"][0] == "lettes"
    assert v.group(table(spark, count).where("n < 0")).count() == 0


def test_words_of_texts(spark, docs, plain, none):
    r = random.Random(2)
    base = [w for w in vocabulary(4, "abcdÉß", 40)]
    texts = [" ".join(r.choice(base).title() for _ in range(300)) + "x1y" for _ in range(40)]
    texts += [None, "", "KKİİstanbul ÀÉÎÕÜß×÷ÿ " * 9, "z" * 30000 + " " + "longword" * 6, "a" * 5 + " " + "b" * 6]
    rows = list(enumerate(texts)) + [(None, "nullid " * 600), (3, texts[3]), (3, texts[3])]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string").repartition(4)
    want = words_of(rows)
    assert {x.word: x.n for x in v.vocabulary(frame).collect()} == want
    assert any(len(w) == 5 for w in {"nulli"}) and got(v.group(v.vocabulary(frame))) == brute(want)
    assert {x.word: x.n for x in v.vocabulary(docs).collect()} == words_of(plain.items())
    assert v.vocabulary(none).count() == 0
    assert v.vocabulary(frame.where(F.col("text").isNull())).count() == 0
