"""Language-model scores: interpolated modified Kneser-Ney over word pairs, counted in Spark.

Three jobs over the texts: single tokens, pairs of neighbours, scores. A task counts what it sees
before anything is shuffled and sends its counts packed, as arrays, to parts of bounded size: single
tokens by hash, pairs by the hash of their first word. A first word that makes up more of all tokens than
an eighth of a part is spread over as many parts as it has eighths, by the hash of the pair, and its totals
are added up afterwards: no word is a hot key, and there are no more than sixteen rows of such totals for
each part, however many parts there are.

A part merges its counts into sorted hash arrays in the shared folder (``hashstore``): occurrences of
words, pairs with their counts, histories with their totals and how many successors they had once,
twice or more, and words with the number of different words before them. The scoring tasks map these
files into memory and read a document's words once; nothing is shuffled there, and no task or driver
holds a table that grows with the corpus.

Counts follow every training document; there is no limit on vocabulary, pairs or counts. The order is
two: the shuffle of triples is above the disk that the check allows (see README).

Defined results: a null or empty text is its end token alone; a null id is taken as the empty string;
equal rows are scored each; without training documents every token is unknown and has probability one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowguard.llm.common import materialize
from flowguard.llm.hashstore import Store, mounted_folder
from flowguard.llm.words import NOT_SPACE, Words, mix, slices, text_column

#: Tokens that a task counts before it sends them.
GROUP = 1 << 22
#: Bytes of text for each part.
PART_BYTES = 16 << 20
#: A first word is spread in shares of a part's tokens divided by this.
FINE = 8
END, BEGIN = (int(x) for x in mix(np.array([1, 2], np.uint64)))
#: Counts of pairs from here on have a store of their own.
LARGE = 255
#: Hashes of words in pairs have 48 bits.
SHORT = 48

_PACKS = "part int, v binary, run binary, w binary, n binary"
_MERGED = "kind string, part int, ids binary, counts binary"


def _words(column: pa.Array) -> Words:
    return Words(*text_column(column), NOT_SPACE, lower=True)


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and ends of all rows, and the token before each."""
    h = w.hashes()
    return np.insert(h, w.first[1:], np.uint64(END)), np.insert(h, w.first[:-1], np.uint64(BEGIN))


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0x9E3779B97F4A7C15) + mix(w))


def _pack(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _parts(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal parts."""
    edge = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(part)]):
        if b > a:
            yield int(part[a]), slice(a, b)


def _gathered(batches: Iterator[pa.RecordBatch], take) -> Iterator[tuple]:
    """What ``take`` gives for slices of texts, joined to groups of about GROUP tokens."""
    held, n = [], 0
    for part in slices(batches, 0):
        held.append(take(_words(part.column(0))))
        n += len(held[-1][0])
        if n >= GROUP:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _count_words(store: Store):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (h,) in _gathered(batches, lambda w: _tokens(w)[:1]):
            ids, n = np.unique(h, return_counts=True)
            rows = [(p, ids[s].tobytes(), n[s].astype(np.uint32).tobytes()) for p, s in _parts(store.part(ids))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                ["part", "w", "n"],
            )

    return run


def _sum_by(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids)
    ids, n = ids[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], np.add.reduceat(n.astype(np.int64), first) if len(first) else n.astype(np.int64)


def _frombuffers(column, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()])


def _home(v: np.ndarray, key: np.ndarray, bits: int, hot: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The part of each pair: that of its first word, or one of the parts after it if the word is spread."""
    if not bits:
        return np.zeros(len(v), np.uint64)
    home = v >> np.uint64(SHORT - bits)
    at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
    own = hot[at] == v
    step = (key[own] >> np.uint64(32)) % spread[at[own]]
    home[own] = (home[own] + step) & np.uint64((1 << bits) - 1)
    return home


def _merge_words(store: Store):
    """One part: its words to a file; how many, their tokens, and the most frequent ones."""
    most = FINE << store.bits

    def run(group: pa.Table) -> pa.Table:
        ids, n = _sum_by(_frombuffers(group["w"], np.uint64), _frombuffers(group["n"], np.uint32))
        store.write(group["part"][0].as_py(), ids, n)
        top = np.argsort(-n, kind="stable")[:most]
        return pa.table(
            {"words": pa.array([len(ids)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()),
             "top": pa.array([ids[top].view(np.int64)], pa.list_(pa.int64())), "n": pa.array([n[top]], pa.list_(pa.int64()))}
        )

    return run


def _count_pairs(bits: int, hot: np.ndarray, spread: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = np.uint64(64 - SHORT)
        for w, v in _gathered(batches, lambda x: tuple(t >> short for t in _tokens(x))):
            key = pair_key(v, w)
            home = _home(v, key, bits, hot, spread)
            # by part, then by first word: equal pairs meet, and a first word is sent once
            rest = np.uint64(32 - bits)
            order = np.argsort((home << np.uint64(64 - bits) if bits else home) | ((v & np.uint64((1 << int(rest)) - 1)) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF)))
            v, w, home = v[order], w[order], home[order]
            new = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(v))).astype(np.uint32)
            v, w, home = v[at], w[at], home[at]
            out = [[], [], [], [], []]
            for p, s in _parts(home.astype(np.int64)):
                own = v[s]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                run_ = np.diff(np.append(first, len(own))).astype(np.uint32)
                for column, value in zip(out, (p, _pack(own[first]), run_.tobytes(), _pack(w[s]), n[s].tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["part", "v", "run", "w", "n"])

    return run


def _merge_pairs(pairs: Store, large: Store, histories: Store, words: Store, hot: np.ndarray):
    """One part: pairs and histories to files; on go the totals of spread words and the words before each word."""

    def run(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        runs = _frombuffers(group["run"], np.uint32)
        v = np.repeat(np.concatenate([_unpack(x) for x in group["v"].to_pylist()]), runs)
        w = np.concatenate([_unpack(x) for x in group["w"].to_pylist()])
        n = _frombuffers(group["n"], np.uint32).astype(np.int64)
        key = pair_key(v, w)
        order = np.argsort(key)
        key, v, w, n = key[order], v[order], w[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, v, w, n = key[at], v[at], w[at], np.add.reduceat(n, at)
        # nearly all counts fit in a byte; those that don't lie in a store of their own
        pairs.write(part, key, np.minimum(n, LARGE))
        large.write(part, key[n >= LARGE], n[n >= LARGE])
        ids, back = np.unique(v, return_inverse=True)
        stats = np.stack([np.bincount(back, x, len(ids)).astype(np.int64) for x in (n, n == 1, n == 2, n > 2)], axis=1)
        spread = np.isin(ids, hot)
        histories.write(part, ids[~spread], stats[~spread])
        rows = [("hot", 0, ids[spread].tobytes(), stats[spread].tobytes()), ("counts", 0, b"", np.bincount(np.minimum(n, 5), minlength=6).astype(np.int64).tobytes())]
        after, before = np.unique(w, return_counts=True)
        rows += [("before", p, _pack(after[s]), before[s].astype(np.uint32).tobytes()) for p, s in _parts(words.part(after))]
        kind, where, a, b = zip(*rows)
        return pa.table({"kind": pa.array(kind), "part": pa.array(where, pa.int32()), "ids": pa.array(a, pa.binary()), "counts": pa.array(b, pa.binary())})

    return run


def _merge_before(words: Store):
    def run(group: pa.Table) -> pa.Table:
        ids = np.concatenate([_unpack(x) for x in group["ids"].to_pylist()])
        ids, n = _sum_by(ids, _frombuffers(group["counts"], np.uint32))
        words.write(group["part"][0].as_py(), ids, n)
        return pa.table({"counts": pa.array([np.bincount(np.minimum(n, 5), minlength=6).astype(np.int64)], pa.list_(pa.int64())), "total": pa.array([int(n.sum())], pa.int64())})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What is taken off counts of one, two, and three or more; half of them where the corpus is too small to tell."""
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(found)]


def _taken(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


@dataclass
class Model:
    """Stores in the shared folder and the few numbers beside them."""

    singles: Store
    pairs: Store
    large: Store
    histories: Store
    befores: Store
    bits: int
    tokens: int
    words: int
    hot: np.ndarray
    spread: np.ndarray
    hot_stats: np.ndarray
    d2: list[float]
    d1: list[float]
    before_total: int
    before_words: int
    lower_weight: float

    def lower(self, w: np.ndarray) -> np.ndarray:
        """Probability of a word by the different words before it, mixed with an equal share for all and the unknown."""
        n = self.befores.look_up_all(w)[:, 0].astype(np.int64)
        if not self.before_total:
            return np.ones(len(w))
        return np.maximum(n - _taken(n, self.d1), 0) / self.before_total + self.lower_weight / (self.before_words + 1)

    def _history(self, v: np.ndarray) -> np.ndarray:
        stats = self.histories.look_up_all(v).astype(np.int64)
        k = np.minimum(np.searchsorted(self.hot, v), max(len(self.hot) - 1, 0))
        if len(self.hot):
            spread = self.hot[k] == v
            stats[spread] = self.hot_stats[k[spread]]
        return stats

    def probability(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of each token w after v, both as short hashes."""
        lower = self.lower(w)
        stats = self._history(v)
        key = pair_key(v, w)
        home = _home(v, key, self.bits, self.hot, self.spread)
        n = np.zeros(len(v), np.int64)
        order = np.lexsort((key, home))
        for p, s in _parts(home[order].astype(np.int64)):
            found = self.pairs.look_in(p, key[order[s]])[:, 0].astype(np.int64)
            full = found == LARGE
            if full.any():
                found[full] = self.large.look_in(p, key[order[s]][full])[:, 0].astype(np.int64)
            n[order[s]] = found
        seen = stats[:, 0] > 0
        total = np.where(seen, stats[:, 0], 1)
        weight = np.where(seen, stats[:, 1:] @ np.array(self.d2) / total, 1.0)
        return np.maximum(n - _taken(n, self.d2), 0) / total + weight * lower

    def score(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and log10 probability of each row."""
        token, before = _tokens(w)
        row = np.repeat(np.arange(len(w.count)), w.count + 1)
        n = self.singles.look_up_all(token)[:, 0].astype(np.int64)
        base = np.log10((n + 0.5) / (self.tokens + 0.5 * (self.words + 1)))
        short = np.uint64(64 - SHORT)
        log = np.log10(self.probability(before >> short, token >> short))
        rows = len(w.count)
        return np.bincount(row, n > 0, rows).astype(np.int64), np.bincount(row, base, rows), np.bincount(row, log, rows)


def fit(texts: DataFrame, text: str = "text") -> Model:
    """Count all texts of ``texts`` and leave the model in the shared folder."""
    spark = texts.sparkSession
    texts = texts.select(F.col(text).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*")).first()[0]
    bits = max(0, math.ceil(math.log2(max(1, size / PART_BYTES))))
    folder = mounted_folder(spark, "lm")
    singles = Store(folder, "single", bits, 64)
    counted = texts.mapInArrow(_count_words(singles), "part int, w binary, n binary").groupBy("part")
    merged = materialize(counted.applyInArrow(_merge_words(singles), "words long, tokens long, top array<long>, n array<long>"), "lm-words")
    words, tokens = merged.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    parts = 1 << bits
    top = merged.select(F.explode(F.arrays_zip("top", "n")).alias("x")).where(F.col("x.n") * (FINE * parts) > tokens).select("x.top", "x.n")
    short = np.uint64(64 - SHORT)
    # fewer than FINE for each part, as each makes up more than its share of the tokens; every document has a beginning
    often = [(int(np.int64(r.top).view(np.uint64) >> short), r.n) for r in top.collect()] + [(int(np.uint64(BEGIN) >> short), tokens)]
    hot = np.unique(np.array([w for w, _ in often], np.uint64))
    spread = np.ones(len(hot), np.uint64)
    for w, n in often:
        k = int(np.searchsorted(hot, np.uint64(w)))
        spread[k] = max(int(spread[k]), min(parts, -(-n * FINE * parts // max(1, tokens))))
    pairs, large = Store(folder, "pair", bits, 64, dtype="u1"), Store(folder, "large", bits, 64)
    # single precision keeps counts exact up to 16 million, and probabilities to seven digits beyond
    befores, histories = Store(folder, "before", bits, SHORT, dtype="f4"), Store(folder, "history", bits, SHORT, 4, "f4")
    dealt = texts.mapInArrow(_count_pairs(bits, hot, spread), _PACKS).groupBy("part")
    merged = materialize(dealt.applyInArrow(_merge_pairs(pairs, large, histories, befores, hot), _MERGED), "lm-pairs")
    return _finish(merged, Model(singles, pairs, large, histories, befores, bits, tokens, words, hot, spread, np.zeros((len(hot), 4), np.int64), [], [], 0, 0, 0.0))


def _finish(merged: DataFrame, model: Model) -> Model:
    numbers = np.zeros(6, np.int64)
    # a few numbers for each part, and a row of totals for each spread word
    for r in _long_sums(merged.where("kind = 'counts'")):
        numbers[r.k] = r.n
    for r in _hot_sums(merged.where("kind = 'hot'")):
        k = int(np.searchsorted(model.hot, np.uint64(r.id)))
        model.hot_stats[k] = [r.total, r.once, r.twice, r.more]
    before = merged.where("kind = 'before'").select("part", "ids", "counts").groupBy("part")
    done = materialize(before.applyInArrow(_merge_before(model.befores), "counts array<long>, total long"), "lm-before")
    sums = done.agg(*[F.coalesce(F.sum(F.col("counts")[k]), F.lit(0)) for k in range(6)], F.coalesce(F.sum("total"), F.lit(0))).first()
    model.d2, model.d1 = discounts(*numbers[1:5].tolist()), discounts(*sums[1:5])
    model.before_total, model.before_words = sums[6], sum(sums[1:6])
    once, twice, more = sums[1], sums[2], sum(sums[3:6])
    model.lower_weight = (model.d1[0] * once + model.d1[1] * twice + model.d1[2] * more) / max(1, sums[6])
    return model


def _long_sums(rows: DataFrame):
    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(range(6), pa.int32()), pa.array(np.frombuffer(raw, np.int64))], ["k", "n"])

    return rows.select("counts").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()


def _hot_sums(rows: DataFrame):
    def run(batches):
        for b in batches:
            for ids, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                stats = np.frombuffer(raw, np.int64).reshape(-1, 4)
                columns = [pa.array(np.frombuffer(ids, np.int64)), *(pa.array(np.ascontiguousarray(stats[:, k])) for k in range(4))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "total", "once", "twice", "more"])

    sums = rows.select("ids", "counts").mapInArrow(run, "id long, total long, once long, twice long, more long")
    return sums.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("total", "once", "twice", "more")]).collect()


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(id).alias("doc_id")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 4 << 20):
            w = _words(part.column(1))
            known, base, log = shared.value.score(w)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(w.count + 1, pa.int64()), pa.array(known), pa.array(base), pa.array(log)],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    named = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return named.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 5 == 1


def query(spark, sf_dir: str) -> DataFrame:
    """Every document by a model of the documents whose crc32 is not 1 modulo 5."""
    from flowguard.llm.common import documents

    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = score(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
