"""Substring deduplication with a compressed FM-index per shard.

A window is 20 consecutive words of a document; every word that a window covers whose words also
start earlier (smaller doc_id, or an earlier start in the same document) is removed.

1. Consecutive windows with the same minimiser (the least hash of their 8-word grams) form a segment.
   Equal windows have equal minimisers, so all places of a window meet in one minimiser's segments.
   Copies of a segment inside a task keep the earliest; all others are repeats already. What is left
   is dealt by minimiser and read in order: further copies are repeats, and segments that share a
   minimiser with a different one stay in question. Most text ends here, its minimisers being unique.
2. Words of segments in question are fetched and dealt by minimiser into shards of about
   ``SHARD_WORDS`` words. Each shard is an FM-index (``fmindex``) over its segments in order of
   document and start; the documents' segments are streamed backwards through it. Backward search over
   the wavelet matrix gives, for each place, the length of the longest match (matching statistics) and
   its interval, whose first suffix is the earliest place of the window. Matches of 20 words whose
   earliest place is another one are reported.
3. The reported intervals go back to the documents, which are cut.

A minimiser whose different segments outgrow a shard (a phrase that very many documents use differently) is
no group of one task: its windows are compared by 128-bit hashes, with minima by group (``_by_window``).

Segments are at most ``CUT`` windows long, so repetitive texts spread over a document's segments, and a
passage that many documents share shrinks to one segment per task before anything is shuffled.

Defined results: a null or empty text has no words; rows that repeat an id and its text are one
document; texts that differ under one id are documents of their own, told apart and ordered by a 64-bit hash of
the text (``sub``); null is the smallest id; an empty table gives an empty one. Ids that are no integers are ordered as their
own type orders them, by ranks counted over range partitions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from flowguard.functions.encode import value_ranks
from flowguard.llm.common import materialize
from flowguard.llm.fmindex import FMIndex
from flowguard.llm.words import NOT_SPACE, Words, grams, mix, running, slices, span_hash, text_column

WINDOW = 20
GRAM = 8
#: Most windows of a segment.
CUT = 256
SHARD_WORDS = 1 << 18
#: Words of one minimiser from which its windows are compared by hash; an index of so many fits a task.
HEAVY_WORDS = 1 << 20
#: Bytes of text in which copies of segments are collapsed before the shuffle.
SLICE = 4 << 20
NULL_ID = -(1 << 63)

_SEGMENTS = "m long, s long, doc long, sub long, start int, n int, twice boolean, repeat boolean"
_FOUND = "m long, doc long, sub long, start int, n int, repeat boolean"
_WORDS = "m long, doc long, sub long, start int, n int, text string, heavy boolean"
_WINDOWS = "a long, b long, doc long, sub long, start int"
_SPANS = "doc long, sub long, start int, n int"


def _segments(w: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(minimiser, hash of the words, first word, windows, whether it holds the minimiser twice) of each segment."""
    h = w.hashes()
    g = grams(h, gram)
    least = running(g, window - gram + 1)
    at = np.flatnonzero(w.left >= window)
    if not len(at):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1) | (w.row[at[1:]] != w.row[at[:-1]])
    begin = np.flatnonzero(new)
    run = np.repeat(begin, np.diff(np.append(begin, len(at))))
    new |= (np.arange(len(at)) - run) % CUT == 0
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    start = at[begin]
    m = value[begin]
    # only a segment that holds its minimiser twice can hold a window twice
    length = n + window - gram
    first = np.cumsum(length) - length
    inside = np.arange(length.sum()) + np.repeat(start - first, length)
    twice = np.add.reduceat(g[inside] == np.repeat(m, length), first, dtype=np.int64) > 1
    return m, span_hash(h, start, start + n + window - 1), start, n, twice


def _scan(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, SLICE):
            w = Words(*text_column(part.column(2)), NOT_SPACE, lower=False)
            m, s, start, n, twice = _segments(w, window, gram)
            row = w.row[start] if len(start) else start
            doc, sub = part.column(0).to_numpy()[row], part.column(1).to_numpy()[row]
            own = start - w.first[row]
            # the first of equal segments stays in question, the others are repeats
            order = np.lexsort((own, sub, doc, n, s, m))
            a, b = order[1:], order[:-1]
            same = (m[a] == m[b]) & (s[a] == s[b]) & (n[a] == n[b])
            place = ~((doc[a] == doc[b]) & (sub[a] == sub[b]) & (own[a] == own[b]))  # not the same place in a repeated row
            repeat = np.zeros(len(m), bool)
            repeat[a] = same & place
            yield pa.RecordBatch.from_arrays(
                [pa.array(m.view(np.int64)), pa.array(s.view(np.int64)), pa.array(doc), pa.array(sub), pa.array(own.astype(np.int32)),
                 pa.array(n.astype(np.int32)), pa.array(twice), pa.array(repeat)],
                ["m", "s", "doc", "sub", "start", "n", "twice", "repeat"],
            )

    return run


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (m, s, n, doc, sub, start): repeats, and segments that share a minimiser or hold it twice."""
    held = None  # the last first-of-its-kind, of which it is open whether another shares its minimiser
    shared = False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        if held is not None:
            columns = [np.concatenate([[x], y]) for x, y in zip(held, columns)]
        m, s, doc, sub, start, n, twice = columns
        first = np.ones(len(m), bool)
        first[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1])
        lead = np.flatnonzero(first)
        with_next = np.append(m[lead[1:]] == m[lead[:-1]], False)
        with_last = np.concatenate([[shared], m[lead[1:]] == m[lead[:-1]]])
        open_ = lead[with_next | with_last | twice[lead]]
        # copies of a first: repeats unless they are the same place of a repeated row
        head = lead[np.cumsum(first) - 1]
        copy = ~first & ~((doc == doc[head]) & (sub == sub[head]) & (start == start[head]))
        final = lead[-1]
        held, shared = [x[final] for x in columns], bool(with_last[-1])
        keep = np.concatenate([open_[open_ != final], np.flatnonzero(copy)])
        if len(keep):
            yield _found(m, doc, sub, start, n, keep, copy[keep])
    if held is not None and (shared or held[6]):
        one = [np.array([x]) for x in held]
        yield _found(one[0], one[2], one[3], one[4], one[5], np.array([0]), np.array([False]))


def _found(m, doc, sub, start, n, keep, repeat) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(m[keep]), pa.array(doc[keep]), pa.array(sub[keep]), pa.array(start[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32)), pa.array(repeat)],
        ["m", "doc", "sub", "start", "n", "repeat"],
    )


def _fetch(window: int):
    """The words of the segments in question of each document, once however many rows repeat it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # repeated rows meet in a task; those of others only add words
        for part in slices(batches, 2):
            asked = part.column(3).to_pylist()
            if not any(asked):
                continue
            w = Words(*text_column(part.column(2)), NOT_SPACE, lower=False)
            out = [[], [], [], [], [], [], []]
            for r, (doc, sub) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                if not asked[r] or (doc, sub) in seen:
                    continue
                seen.add((doc, sub))
                for one in asked[r]:
                    a = int(w.first[r]) + one["start"]
                    text = w.text(a, a + one["n"] + window - 1)
                    for column, value in zip(out, (one["m"], doc, sub, one["start"], one["n"], text.decode(), one["heavy"])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32()),
                 pa.array(out[5], pa.string()), pa.array(out[6], pa.bool_())], ["m", "doc", "sub", "start", "n", "text", "heavy"],
            )

    return run


def repeats(doc: np.ndarray, sub: np.ndarray, start: np.ndarray, texts: list[str], window: int) -> list[tuple[int, int, int, int]]:
    """(doc, sub, start, windows) of the windows of segments that stand earlier among them."""
    order = np.lexsort((start, sub, doc))
    doc, sub, start = doc[order], sub[order], start[order]
    words, length = [], []
    for k in order.tolist():
        own = texts[k].split(" ")
        words += own
        length.append(len(own))
    names: dict[str, int] = {}
    symbols = np.fromiter((names.setdefault(x, len(names) + 2) for x in words), np.int64, len(words))
    length = np.array(length)
    ends = np.cumsum(length)
    # in the index a mark of its own (1) ends each segment, so no match reaches into the next
    text = np.insert(symbols, ends, 1)
    segment = np.repeat(np.arange(len(length)), length)
    index = FMIndex(text, window)
    mark = np.append(np.repeat(np.arange(len(length)), length + 1), len(length))
    first_of = ends - length
    hits = np.zeros(len(symbols), bool)
    for at, long, lo, _ in index.stream(symbols, ends, int(length.max())):
        full = long == window
        spot, place = at[full], index.suffix[lo[full]]
        here, there = segment[spot], mark[place]
        own = start[here] + spot - first_of[here]
        other = start[there] + place - there - first_of[there]
        same = (doc[there] == doc[here]) & (sub[there] == sub[here])
        # segments stand in order of their documents
        hits[spot] = np.where(same, other < own, there < here)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hits, [False]]).astype(np.int8)))
    out = []
    for a, b in edge.reshape(-1, 2).tolist():
        while a < b:  # runs end with their segment
            k = int(segment[a])
            to = min(b, int(ends[k]))
            out.append((int(doc[k]), int(sub[k]), int(start[k] + a - first_of[k]), to - a))
            a = to
    return out


def _each_window(window: int):
    """Two 64-bit hashes of each window of the segments, and where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 5):
            w = Words(*text_column(part.column(5)), NOT_SPACE, lower=False)
            h = w.hashes()
            at = np.flatnonzero(w.left >= window)
            a, b = grams(h, window)[at], grams(mix(h + np.uint64(1)), window)[at]
            row = w.row[at]
            start = part.column(3).to_numpy()[row] + at - w.first[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(part.column(1).to_numpy()[row]),
                 pa.array(part.column(2).to_numpy()[row]), pa.array(start.astype(np.int32))], ["a", "b", "doc", "sub", "start"],
            )

    return run


def _by_window(words: DataFrame, window: int) -> DataFrame:
    """Repeats among the segments of a minimiser that outgrows a shard: by 128-bit hashes of the windows.

    First places are minima, which are pre-aggregated; the join back by hash is split where it is skewed.
    """
    windows = materialize(words.mapInArrow(_each_window(window), _WINDOWS), "substrings-windows")
    first = windows.groupBy("a", "b").agg(F.min(F.struct("doc", "sub", "start")).alias("first"), F.count("*").alias("k")).where("k > 1")
    again = windows.join(first.drop("k"), ["a", "b"]).where(F.struct("doc", "sub", "start") > F.col("first"))
    return again.select("doc", "sub", "start", F.lit(1).alias("n"))


def _index(window: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        found = repeats(group["doc"].to_numpy(), group["sub"].to_numpy(), group["start"].to_numpy().astype(np.int64), group["text"].to_pylist(), window)
        a, b, c, d = zip(*found) if found else ((), (), (), ())
        return pa.table({"doc": pa.array(a, pa.int64()), "sub": pa.array(b, pa.int64()), "start": pa.array(c, pa.int32()), "n": pa.array(d, pa.int32())})

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            w = Words(*text_column(part.column(1)), NOT_SPACE, lower=False)
            spans = part.column(2).to_pylist()
            gone, digest = [], []
            for r, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                cover = np.zeros(b - a + 1, np.int64)
                for one in spans[r] or ():
                    if one["start"] < b - a:
                        cover[one["start"]] += 1
                        cover[min(one["start"] + one["n"] + window - 1, b - a)] -= 1
                keep = np.flatnonzero(np.cumsum(cover[:-1]) == 0) + a
                gone.append(b - a - len(keep))
                kept = w.text(a, b) if not gone[-1] else b" ".join(
                    [w.data[s:e].tobytes() for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist())]
                )
                digest.append((kept, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(w.count, pa.int64()), pa.array(gone, pa.int64()), pa.array([d.decode() for d, _ in digest], pa.string()),
                 pa.array([x for _, x in digest], pa.string())], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return run


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256): each document without the words of repeated windows."""
    kind = docs.schema[id].dataType
    rows, names = docs.select(F.col(id).alias("id"), F.col(text).alias("text")), None
    if not isinstance(kind, IntegralType):  # the order is that of the ids' own type
        names = materialize(value_ranks(rows.select("id").where("id IS NOT NULL").distinct(), [], "id"), "substrings-ids")
        rows = rows.join(names, "id", "left").select(F.col("rank").alias("id"), "text")
    named = rows.select(F.coalesce(F.col("id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("sub"), "text")
    segments = named.mapInArrow(_scan(window, gram), _SEGMENTS)
    # repeats need no meeting; they are dealt evenly
    key = F.when(F.col("repeat"), F.xxhash64("doc", "sub", "start")).otherwise(F.col("m"))
    dealt = segments.withColumn("key", key).repartition("key").sortWithinPartitions("repeat", "m", "s", "n", "doc", "sub", "start")
    found = materialize(dealt.drop("key").mapInArrow(_split, _FOUND), "substrings-found")
    asked = found.where("NOT repeat")
    words = asked.groupBy("m").agg(F.sum(F.col("n") + window).alias("words"))
    words = words.withColumn("heavy", F.col("words") > HEAVY_WORDS)
    heavy = materialize(words.where("heavy").select("m", "heavy"), "substrings-heavy")
    total = words.where("NOT heavy").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / SHARD_WORDS))
    any_heavy = not heavy.isEmpty()
    asked = asked.join(heavy, "m", "left") if any_heavy else asked.withColumn("heavy", F.lit(False))
    asked = asked.withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    wanted = asked.groupBy("doc", "sub").agg(F.collect_list(F.struct("m", "start", "n", "heavy")).alias("asked"))
    # an outer join, so that this exchange of the texts equals the one below and is made once
    words = named.join(wanted, ["doc", "sub"], "left").select("doc", "sub", "text", "asked").mapInArrow(_fetch(window), _WORDS)
    by_shard = words.where("NOT heavy").withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards))).groupBy("shard")
    indexed = by_shard.applyInArrow(_index(window), _SPANS)
    spans = found.where("repeat").select("doc", "sub", "start", "n").unionByName(indexed)
    if any_heavy:
        spans = spans.unionByName(_by_window(words.where("heavy"), window))
    spans = spans.groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    cut = named.join(spans, ["doc", "sub"], "left").select("doc", "text", "spans").mapInArrow(_cut(window), schema)
    cut = cut.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
    if names is None:
        return cut.withColumn("doc_id", F.col("doc_id").cast(kind))
    named_rows = cut.join(names.withColumnRenamed("rank", "doc_id"), "doc_id", "left").drop("doc_id")
    return named_rows.select(F.col("id").alias("doc_id"), *cut.columns[1:])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is known to be a repeat passes; the rest, which comes first, is sifted."""
    known = []

    def open_rows():
        for batch in batches:
            repeat = batch.column(7).to_numpy(zero_copy_only=False)
            if not repeat.any():
                yield batch
                continue
            at = int(np.argmax(repeat))
            if at:
                yield batch.slice(0, at)
            known.append(batch.slice(at))
            return

    yield from _sift(open_rows())
    for batch in chain(known, batches):
        yield batch.select(["m", "doc", "sub", "start", "n", "repeat"])


def query(spark, sf_dir: str) -> DataFrame:
    """Every document without what stands in an earlier place."""
    from flowguard.llm.common import documents

    return deduplicate(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
