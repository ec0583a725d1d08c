import random

import pytest

LETTERS = "abcde fgé\n"


@pytest.fixture(scope="session")
def texts():
    """Edge cases and texts that share passages, copies and near copies among them."""
    r = random.Random(5)
    words = ["alpha", "beta", "Gamma", "délta", "eps", "zeta", "eta", "theta", "iota", "kappa"]

    def prose(n):
        return " ".join(r.choice(words) + str(r.randint(0, 40)) for _ in range(n))

    passage = prose(60)
    made = [None, "", "   \n\t", "one", "two words", "a " * 400, "x" * 5000, prose(30) + " " + passage, passage + " " + prose(5)]
    made += [passage, passage, prose(25) + " " + passage + " " + prose(25), "🙂 é ﬁ \x00 " + prose(20)]
    long = prose(3000)
    made += [long, long + " " + prose(10), long[: len(long) // 2], prose(200), prose(200), "line of twenty words " * 80]
    return made


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with ids out of order and extra columns whose names clash with results."""
    rows = [((k * 7) % len(texts), t, "en", "src", len(t or ""), "x", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, found string, n_words int").repartition(3)


@pytest.fixture(scope="session")
def plain(texts):
    return {(k * 7) % len(texts): t for k, t in enumerate(texts)}


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
