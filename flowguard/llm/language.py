"""Language identification by fusing evidence the Bayesian way.

For each language the log posterior of a row adds up

* the likelihood of its whole text under a model of three-byte grams, scaled to ``EVIDENCE`` grams, as
  the grams of a long text are far from independent;
* the likelihood of the language that its markup declares;
* the likelihood of its address suffix (the top-level domain);
* the prior of its host: shares of the languages among the host's rows by text alone, smoothed towards
  those of its domain, these towards those of all rows; all from grouped sums over every row.

``und`` is a language of its own in which all grams are as likely: text that no language explains
better, and rows without any letter, end there and are rejected.

The gram model is fitted on a bounded sample of labelled rows (``SAMPLE`` of each run, dealt by the
hash of the text): a table of fixed size that is broadcast. Priors are broadcast
while the hosts are counted to be few; otherwise they are joined by host and left to adaptive execution,
which splits a host of very many rows.

Defined results: null or empty text has no text evidence; unknown or missing declarations, suffixes and
hosts are no evidence either; equal rows get equal results; ties go to the first language by name.
Extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from flowguard.llm.common import add_struct, materialize, spare
from flowguard.llm.words import LOWER, slices, text_column

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
BITS = 15
#: Labelled rows on which the gram model is fitted, about.
SAMPLE = 4000
EVIDENCE = 120.0
DECLARED, SUFFIXED = 0.9, 0.7
#: Hosts up to which their priors, some fifty bytes each, are broadcast instead of joined by a shuffle.
FEW_HOSTS = 50_000
#: Rows that a smoothed prior weighs.
PRIOR = 10.0
#: Languages of address suffixes.
SUFFIX = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}

#: Letters stay, everything else is a space; bytes above ASCII are letters.
_LETTER = np.where((np.arange(256) >= 128) | (np.arange(256) >= 97) & (np.arange(256) < 123), LOWER, 32).astype(np.uint8)
_LETTER[65:91] = LOWER[65:91]
#: Searched up to the last ">" only, so that each "<" finds its end and the search stays linear; an open script or comment runs to the end.
HIDDEN = re.compile(r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|(?P<script>\Z))|<!--.*?(?:-->|(?P<comment>\Z))|<[^>]*>|&[a-z0-9#]{1,10};")
#: After the last ">" there are no tags.
REST = re.compile(r"(?is)<!--.*|&[a-z0-9#]{1,10};")
HTML_TAG = re.compile(r"(?i)<html\b[^>]*")
LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})")

_EVIDENCE = StructType().add("ll", ArrayType(DoubleType())).add("declared", StringType())


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each three-byte gram that has a letter in it; a text has a space before and after it."""
    n = len(offsets) - 1
    # two spaces stand between rows: no gram has letters of two, and each belongs to the row of its middle
    b = np.insert(_LETTER[data], np.repeat(offsets, 2), 32).astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets) + 2)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    keep = code != 0x202020
    return row[keep], ((code[keep] * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)


@dataclass
class Model:
    """Log probabilities of the buckets, a column for each language and one for ``und``."""

    languages: tuple[str, ...]
    table: np.ndarray

    @property
    def names(self) -> list[str]:
        return [*self.languages, UNKNOWN]

    def likelihoods(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, bucket = _grams(data, offsets)
        n = len(offsets) - 1
        count = np.bincount(row, minlength=n)
        scale = np.minimum(1.0, EVIDENCE / np.maximum(count, 1))
        return np.stack([np.bincount(row, self.table[:, k][bucket], n) * scale for k in range(self.table.shape[1])], axis=1)


def fit(rows: DataFrame, text: str = "text", label: str = "lang", languages: Sequence[str] = LANGUAGES, sample: int = SAMPLE) -> Model:
    """The gram model of about ``sample`` rows that are labelled with one of the languages."""
    place = {name: k for k, name in enumerate(languages)}
    rows = rows.where(F.col(label).isin(*languages) & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    deal = 1_000_003
    share = int(min(1.0, sample / max(1, rows.count())) * deal)

    def run(batches):
        counts = np.zeros((len(place), 1 << BITS), np.int64)
        for part in slices(batches, 1):
            row, bucket = _grams(*text_column(part.column(1)))
            own = np.array([place[x] for x in part.column(0).to_pylist()])[row]
            np.add.at(counts, (own, bucket), 1)
        for k, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["k", "bucket", "n"])

    taken = rows.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(deal)) < share)
    sums = taken.mapInArrow(run, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(place), 1 << BITS))
    for r in sums.collect():  # a table of fixed size: languages x buckets
        counts[r.k, r.bucket] = r.n
    smooth = (counts + 0.05) / (counts.sum(axis=1, keepdims=True) + 0.05 * (1 << BITS))
    flat = np.full((1, 1 << BITS), 1.0 / (1 << BITS))
    return Model(tuple(languages), np.log(np.concatenate([smooth, flat])).T.astype(np.float32))


def visible(html: str | None) -> str:
    """The text of a page without markup, comments, scripts and styles."""
    page = html or ""
    last = page.rfind(">") + 1
    unclosed = False

    def blank(m: re.Match) -> str:
        nonlocal unclosed
        unclosed |= m["script"] is not None or m["comment"] is not None
        return " "

    head = HIDDEN.sub(blank, page[:last])
    return head if unclosed else head + REST.sub(" ", page[last:])


def declared_language(html: str | None) -> str | None:
    """What the first html tag with a language declares."""
    for tag in HTML_TAG.finditer(html or ""):
        if found := LANG.search(tag[0]):
            return found[1].lower()
    return None


def evidence(rows: DataFrame, into: str, model: Model, text: str, markup: bool) -> DataFrame:
    """``rows`` with a struct ``into``: log likelihoods of the text, and the language its markup declares."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index(text)

    def judge(part: pa.RecordBatch) -> pa.StructArray:
        column, declared = part.column(at), [None] * part.num_rows
        if markup:
            pages = column.to_pylist()
            declared = [declared_language(p) for p in pages]
            column = pa.array([visible(p) for p in pages], pa.string())
        ll = shared.value.likelihoods(*text_column(column))
        ends = np.arange(len(ll) + 1, dtype=np.int32) * ll.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ll.ravel()))
        return pa.StructArray.from_arrays([lists, pa.array(declared, pa.string())], _EVIDENCE.names)

    return add_struct(rows, text, into, _EVIDENCE, judge)


def _pick(scores: Sequence[Column], names: Sequence[str]) -> Column:
    """The name of the highest score, the first of equals."""
    best = F.greatest(*scores)
    out = F.lit(None).cast("string")
    for s, n in reversed(list(zip(scores, names))):
        out = F.when(s == best, F.lit(n)).otherwise(out)
    return out


def _priors(votes: DataFrame, names: Sequence[str]) -> DataFrame:
    """(host, p0, p1, ...): log priors of the languages from (host, domain, vote) of every row."""
    count = [F.sum((F.col("vote") == n).cast("long")).alias(f"n{k}") for k, n in enumerate(names)]
    hosts = materialize(votes.groupBy("host", "domain").agg(*count), "language-hosts")
    total = hosts.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"t{k}") for k in range(len(names))]).first()
    whole = sum(total) + len(names)
    everywhere = [(t + 1) / whole for t in total]
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{k}").alias(f"d{k}") for k in range(len(names))])
    all_d = sum((F.col(f"d{k}") for k in range(len(names))), F.lit(0))
    domains = domains.select("domain", *[((F.col(f"d{k}") + PRIOR * p) / (all_d + PRIOR)).alias(f"d{k}") for k, p in enumerate(everywhere)])
    all_n = sum((F.col(f"n{k}") for k in range(len(names))), F.lit(0))
    joined = hosts.join(domains, hosts.domain.eqNullSafe(domains.domain)).drop(domains.domain)
    return joined.select("host", *[F.log((F.col(f"n{k}") + PRIOR * F.col(f"d{k}")) / (all_n + PRIOR)).alias(f"p{k}") for k in range(len(names))])


def _says(value: Column, names: Sequence[str], k: int, right: float) -> Column:
    """Log likelihood that evidence names ``value`` if the language is names[k]; zero where it says nothing."""
    n = len(names) - 1
    if names[k] == UNKNOWN:
        likely = F.lit(float(np.log(1 / n)))
    else:
        likely = F.when(value == names[k], float(np.log(right))).otherwise(float(np.log((1 - right) / (n - 1))))
    return F.when(value.isin(*names[:-1]), likely).otherwise(0.0)


def identify(
    rows: DataFrame,
    into: str,
    model: Model,
    text: str = "text",
    declared: str | None = None,
    host: Column | None = None,
    domain: Column | None = None,
    suffix: Column | None = None,
    markup: bool = False,
) -> DataFrame:
    """``rows`` with a struct ``into`` of lang, confidence and text_lang; lang is ``und`` where none fits.

    ``declared`` names a column with a declared language; pages (``markup``) bring their own.
    """
    names = model.names
    found, key, group = spare(rows, into), spare(rows, into + "_host"), spare(rows, into + "_domain")
    nowhere = F.lit(None).cast("string")
    seen = evidence(rows, found, model, text, markup)
    seen = seen.withColumn(key, F.coalesce(nowhere if host is None else host, F.lit(""))).withColumn(group, nowhere if domain is None else domain)
    ll = [F.col(found)["ll"][k] for k in range(len(names))]
    by_text = _pick(ll, names)
    lit = F.col(found)["ll"]
    blank = F.forall(lit, lambda x: x == 0)
    by_text = F.when(blank, F.lit(UNKNOWN)).otherwise(by_text)
    priors = _priors(seen.select(F.col(key).alias("host"), F.col(group).alias("domain"), by_text.alias("vote")), names)
    priors = materialize(priors, "language-priors")
    few = priors.count() <= FEW_HOSTS
    priors = priors.select(F.col("host").alias(key), *[F.col(f"p{k}").alias(f"{into}_p{k}") for k in range(len(names))])
    said = F.col(found)["declared"] if declared is None else F.lower(F.substring(declared, 1, 2))
    place = nowhere if suffix is None else suffix
    joined = seen.join(F.broadcast(priors) if few else priors, key, "left")
    scores = [
        ll[k] + F.coalesce(F.col(f"{into}_p{k}"), F.lit(0.0)) + _says(said, names, k, DECLARED) + _says(place, names, k, SUFFIXED)
        for k in range(len(names))
    ]
    every = F.array(*scores)
    top = F.array_max(every)
    share = 1 / F.aggregate(every, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    lang = F.when(blank, F.lit(UNKNOWN)).otherwise(_pick(scores, names))
    out = F.struct(lang.alias("lang"), F.round(share, 6).alias("confidence"), by_text.alias("text_lang"))
    return joined.select(*[F.col(c) for c in rows.columns], out.alias(into))


def suffix_language(host: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SUFFIX.items() for x in pair])
    return F.try_element_at(table, F.regexp_extract(host, r"\.([a-z]+)$", 1))


def query(spark, sf_dir: str) -> DataFrame:
    """The language of every page, by a model of the labelled documents."""
    from flowguard.llm.common import documents, table
    from flowguard.llm.url_filter import host_of

    host = host_of(F.col("url"))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = identify(pages, "found", fit(documents(spark, sf_dir)), "html", None, host, domain, suffix_language(host), markup=True)
    f = F.col("found")
    return found.select("page_id", f.lang.alias("lang"), f.confidence.alias("confidence"), f.text_lang.alias("text_lang"), (f.lang != UNKNOWN).alias("accepted"))
