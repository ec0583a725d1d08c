"""Web-shell detection in uploaded text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowguard.functions import text as tx
from flowguard.functions.once import once
from flowguard.operators import perceptron
from flowguard.operators.events import packet_event, packet_key
from flowguard.operators.scoring import Scorer, top_class
from flowguard.schemas import WEBSHELL
from flowguard.session import materialize

BUCKETS = 1 << 14  # places of hashed words
KNOWN_TERMS = 1 << 18  # terms that are broadcast, at most


def payloads(packets: DataFrame) -> DataFrame:
    """Add ``payload``, the decoded upload: a multipart body wins over plain form data.

    Packets without data, or whose data is not hex of valid UTF-8, are left out.
    """
    data = F.coalesce(F.col("mime_multipart.data"), F.col("http.data"))
    return once(packets, payload=tx.hex_text(data)).where(F.length("payload") > 0)


def term_counts(df: DataFrame, key: str = "pkt_no", text: str = "payload", keys: DataFrame | None = None) -> DataFrame:
    """One row per text and term, with the number of times it occurs; texts of one key are one text.

    ``keys`` are rows with the keys of all texts, for where they are read with less work than the texts.
    """
    return _counted(df, key, tx.tokens(F.col(text)), keys)


def _counted(texts: DataFrame, key: str, words: Column, keys: DataFrame | None) -> DataFrame:
    """A text's words are counted in its row and dealt as one string by the key, a fraction of what rows of terms take.

    Whatever reads the counts starts from that exchange, so texts are read, decoded and cut once. Only terms of
    keys that come more than once are added up as rows; which keys these are is looked up first.
    """
    twice = (texts if keys is None else keys).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    twice = materialize(twice, "repeated-keys")
    cut = once(texts, _all=F.sort_array(words)).select(key, "_all").where(F.size("_all") > 0)
    cut = once(cut, _words=F.array_distinct("_all"))
    starts = F.transform("_all", lambda _, i: F.when((i == 0) | (F.col("_all")[i] != F.col("_all")[i - 1]), i))
    cut = once(cut, _starts=F.array_compact(starts))
    tfs = F.transform("_starts", lambda at, i: F.coalesce(F.get("_starts", i + 1), F.size("_all")) - at)
    dealt = cut.select(key, F.array_join("_words", " ").alias("_words"), tfs.alias("_tfs")).repartition(F.col(key))

    def rows(df: DataFrame) -> DataFrame:
        terms = F.arrays_zip(F.split("_words", " ").alias("term"), F.col("_tfs").alias("tf"))
        return df.select(key, F.inline(terms)).where("term IS NOT NULL").withColumn("tf", F.col("tf").cast("long"))

    if twice.isEmpty():
        return rows(dealt)
    again = twice.withColumnRenamed(key, "_again")
    same = F.col(key).eqNullSafe(F.col("_again"))
    alone, others = dealt.join(again, same, "left_anti"), dealt.join(again, same, "left_semi")
    return rows(alone).unionByName(rows(others).groupBy(key, "term").agg(F.sum("tf").alias("tf")))


def fit_idf(counts: DataFrame, n_texts: DataFrame) -> DataFrame:
    """Smoothed inverse document frequency of every term: ``ln((1 + n) / (1 + df)) + 1``.

    ``n_texts`` is a one-row table with the number of texts.
    """
    # Reading ``tf`` here keeps the plan equal to the one that ``tfidf`` weighs, so that Spark
    # tokenises and counts once and reuses the exchange.
    df = counts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    return _with_idf(df, n_texts)


def _with_idf(df: DataFrame, n_texts: DataFrame) -> DataFrame:
    # joined, as the optimizer fails on a scalar subquery in the constraints of a union above
    n = F.broadcast(n_texts.toDF("_texts"))
    idf = F.log((F.col("_texts") + 1) / (F.col("df") + 1)) + 1
    return df.crossJoin(n).select("term", "df", idf.alias("idf"))


def _weighed(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """``counts`` with the ``idf`` of each term; terms without one, and the empty one, are left out.

    Few terms make up most of all texts. Up to ``KNOWN_TERMS`` of the most frequent are broadcast, so that their
    rows stay where the text is; only the rows of the others are dealt by term, and back by key.
    """
    idf = idf.select("term", "idf").where("idf IS NOT NULL")
    bar = F.floor(F.col("idf") * 16)
    bars = idf.groupBy(bar.alias("bar")).agg(F.count("*").alias("n"))
    last = F.aggregate(
        F.array_sort(F.collect_list(F.struct("bar", "n"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("bar")),
        lambda seen, b: F.struct(
            (seen["n"] + b["n"]).alias("n"), F.when(seen["n"] + b["n"] <= KNOWN_TERMS, b["bar"]).otherwise(seen["bar"]).alias("bar")
        ),
    )["bar"]
    idf = idf.crossJoin(F.broadcast(bars.agg(last.alias("_last"))))
    known = F.coalesce(bar <= F.col("_last"), F.lit(False))
    often, seldom = (idf.where(k).drop("_last") for k in (known, ~known))
    often = F.broadcast(often)
    # a filter on the term alone would be inferred for ``idf`` as well, and part the plans that share its exchange
    rest = counts.where(F.length("term") * F.col("tf") > 0)
    rest = rest.join(often, "term", "left").where("idf IS NULL").drop("idf").join(seldom, "term")
    columns = [*counts.columns, "idf"]
    return counts.join(often, "term").select(*columns).unionByName(rest.select(*columns).repartition(F.col(key)))


def tfidf(counts: DataFrame, idf: DataFrame, key: str = "pkt_no") -> DataFrame:
    """L2-normalised tf-idf weight of every term of every text."""
    weighted = _weighed(counts, idf, key).withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", "tf", (F.col("w") / norm).alias("tfidf"))


def corpus(
    texts: DataFrame, key: str = "pkt_no", text: str = "payload", keys: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``term_counts`` and ``fit_idf`` of texts that are their own corpus; ``text`` is not null.

    Every text gets one more word, the empty one, which no token is: its count over all texts is their
    number, so terms, frequencies and number come out of one exchange, and the texts are read and decoded once.
    """
    counts = _counted(texts, key, F.concat(tx.tokens(F.col(text)), F.array(F.lit(""))), keys)
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("_n"))
    # both uses read both sums and filter on none but them, which keeps them on one exchange
    n = terms.agg(F.max(F.when((F.col("term") == "") & (F.col("df") > 0), F.col("_n"))))
    terms = terms.where(F.length("term") * F.col("df") * F.col("_n") > 0)
    return counts, _with_idf(terms, n)


def corpus_tfidf(
    texts: DataFrame, key: str = "pkt_no", text: str = "payload", keys: DataFrame | None = None
) -> DataFrame:
    """``tfidf`` of texts that are their own corpus; ``text`` is not null."""
    return tfidf(*corpus(texts, key, text, keys), key)


def linear_classes(weights: DataFrame, terms: Mapping[str, float], bias: float, key: str = "pkt_no") -> DataFrame:
    """Class probabilities of a linear text model given as a few term weights.

    The stand-in for a trained classifier: two classes, the higher probability wins.
    """
    score = F.lit(float(bias)) + F.sum(
        F.col("tfidf") * F.coalesce(
            F.element_at(F.create_map(*[F.lit(x) for kv in terms.items() for x in kv]), F.col("term")),
            F.lit(0.0),
        )
    )
    p = 1 / (1 + F.exp(-F.col("score")))
    return (
        weights.where(F.col("term").isin(*terms))
        .groupBy(key)
        .agg(score.alias("score"))
        .withColumn("probability", F.array(1 - p, p))
        .withColumn("prediction", top_class(F.col("probability")))
    )


def linear_hits(counts: DataFrame, idf: DataFrame, terms: Mapping[str, float], bias: float, key: str = "pkt_no") -> DataFrame:
    """Keys of the texts that ``linear_classes`` on ``tfidf`` calls hostile, by sums alone.

    The norm is a factor of all weights of a text, so norm and score are two sums of one grouping, and
    no text's terms are dealt, sorted or kept together.
    """
    known = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv])
    w = F.col("tf") * F.col("idf")
    sums = _weighed(counts, idf, key).groupBy(key).agg(
        F.sum(w * w).alias("_squares"),
        F.sum(w * F.coalesce(F.try_element_at(known, F.col("term")), F.lit(0.0))).alias("_sum"),
    )
    return sums.where(F.lit(float(bias)) + F.col("_sum") / F.sqrt("_squares") > 0).select(key)


def linear_events(
    packets: DataFrame,
    terms: Mapping[str, float],
    bias: float,
    detail: list[str],
    idf: DataFrame | None = None,
) -> DataFrame:
    """Events of the linear text model.

    ``idf`` is a fitted table, as a stream needs one; without it, these packets are the corpus.  A
    text with none of the terms scores ``bias``, which has to be the harmless side.
    """
    if bias > 0:
        raise ValueError("a text without any known term must not alarm: bias has to be <= 0")
    keyed = packets.withColumn("_key", packet_key(packets))
    shells = payloads(keyed)
    if idf is None:
        counts, idf = corpus(shells, "_key", keys=keyed)
    else:
        counts = term_counts(shells, "_key", keys=keyed)
    hits = linear_hits(counts, idf, terms, bias, "_key")
    # null-safe, as a filter for nulls would go below the exchange of the texts on one of its uses
    hit = F.col("_key").eqNullSafe(F.col("_hit"))
    return packet_event(keyed.join(hits.withColumnRenamed("_key", "_hit"), hit, "left_semi"), WEBSHELL, detail)


def text_pipeline(buckets: int = BUCKETS) -> Pipeline:
    """Bag of hashed words and tf-idf of ``payload``; no word is left out and no vocabulary is gathered.

    MLlib's IDF has no ``+ 1``, so its weights differ from ``tfidf`` above.
    """
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="payload", outputCol="_words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=buckets),
            IDF(inputCol="_counts", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_x"),
        ]
    )


def train(labelled: DataFrame, buckets: int = BUCKETS, rounds: int = 60, seed: int = 1) -> PipelineModel:
    """Fit the text classifier on rows with ``payload`` and ``label`` (0 or 1): a small perceptron
    with hidden layers of 5 and 2 on the tf-idf vectors.

    A model is always fitted before it scores; an untrained one is never used.
    """
    features = text_pipeline(buckets).fit(labelled)
    fitted = perceptron.fit(features.transform(labelled), "_x", [buckets, 5, 2, 2], rounds, seed)
    return PipelineModel(stages=[*features.stages, fitted])


def events(packets: DataFrame, scorer: Scorer, detail: list[str] | None = None) -> DataFrame:
    hits = scorer(payloads(packets)).where("prediction = 1")
    return packet_event(hits, WEBSHELL, detail or packets.columns)
