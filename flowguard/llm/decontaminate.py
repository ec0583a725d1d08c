"""Benchmark decontamination by winnowing.

Every run of 13 words of a text holds, among its seven 7-word grams, one of least hash; these least
grams are the text's fingerprints. Two texts that share 13 words in a row therefore share a
fingerprint: the guarantee of winnowing. Test fingerprints are joined with those of the documents,
and each meeting is extended to the 13-word windows around it, which must equal a test window word
for word. A test item of fewer than 13 words is one window of its own length; its only fingerprint
is the window itself.

The test side is broadcast in blocks of at most ``BLOCK_BYTES`` of text (one item at least), however
large the benchmark is: each block is one narrow pass over the documents, and passes follow each
other in the same stage. Documents are never shuffled, so no hot passage can gather rows in a task.

Defined results: a null or empty text has no words, no hits and is not contaminated; items without text have
no window; words that only an item without id hits are hit, but it is not among the names; equal items all count; equal documents are judged each on its own; an empty benchmark
leaves everything clean. Extra columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from flowguard.llm.common import add_struct, digest_of, spare
from flowguard.llm.words import ALNUM, Words, grams, running, text_column

WINDOW = 13
GRAM = 7
BLOCK_BYTES = 2 << 20
#: Bits of the first filter of fingerprints.
FILTER_BITS = 22

HITS = (
    StructType().add("n_words", LongType()).add("n_hit", LongType()).add("items", ArrayType(StringType())).add("hit", BinaryType())
)


def _words(column: pa.Array) -> Words:
    return Words(*text_column(column), ALNUM, lower=True)


def fingerprints(w: Words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the least grams of all windows."""
    g = grams(h, gram)
    inner = window - gram + 1
    least = running(g, inner)
    least[w.left < window] = 0
    # a gram is chosen if it is the least of any of the windows that hold it
    chosen = running(least[::-1], inner, np.maximum)[::-1] >= g
    at = np.flatnonzero(chosen & (w.left >= gram) & _near_window(w, window, inner))
    return at, g[at]


def _near_window(w: Words, window: int, inner: int) -> np.ndarray:
    """Whether a word lies at most ``inner - 1`` words after the start of a whole window of its row."""
    whole = (w.left >= window).astype(np.uint8)
    return running(whole[::-1], inner, np.maximum)[::-1] > 0


class Block:
    """Fingerprints and windows of some test items, as sorted arrays."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int, gram: int):
        w = _words(pa.array(texts, pa.string()))
        h = w.hashes()
        self.window, self.gram = window, gram
        self.prints = np.unique(fingerprints(w, h, window, gram)[1])
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.prints >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        windows: dict[tuple[int, bytes], set[str | None]] = {}
        for r, name in enumerate(ids):
            a, b = int(w.first[r]), int(w.first[r + 1])
            n = min(window, b - a)
            for s in range(a, b - n + 1) if n else ():
                windows.setdefault((n, w.text(s, s + n)), set()).add(name)
        #: By length of window: sorted hashes, and for each hash what windows have it.
        self.by_length: dict[int, tuple[np.ndarray, list[list[tuple[bytes, set[str | None]]]]]] = {}
        for n in sorted({n for n, _ in windows}):
            own = [(text, names) for (m, text), names in windows.items() if m == n]
            pieces = _words(pa.array([t.decode() for t, _ in own], pa.string()))
            keys = grams(pieces.hashes(), n)[pieces.first[:-1]]
            hashes, back = np.unique(keys, return_inverse=True)
            at: list[list[tuple[bytes, set[str | None]]]] = [[] for _ in hashes]
            for k, pair in zip(back, own):
                at[k].append(pair)
            self.by_length[n] = hashes, at

    def candidates(self, w: Words, h: np.ndarray, n: int) -> np.ndarray:
        """Where windows of n words may equal a test window."""
        if n < self.window:
            return np.flatnonzero(w.left >= n)
        at, g = fingerprints(w, h, self.window, self.gram)
        at, g = (x[self.filter[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]] for x in (at, g))
        at = at[np.isin(g, self.prints)]
        near = np.unique((at[:, None] - np.arange(self.window - self.gram + 1)).ravel())
        near = near[near >= 0]
        return near[w.left[near] >= n]

    def meet(self, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Whether each word is hit, and the items of each row that has any."""
        hit, items = np.zeros(len(w) + 1, np.int64), {}
        h = w.hashes()
        for n, (hashes, at) in self.by_length.items():
            spots = self.candidates(w, h, n)
            if not len(spots):
                continue
            keys = window_hash(h, spots, n)
            k = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
            same = hashes[k] == keys
            for s, j in zip(spots[same].tolist(), k[same].tolist()):
                text = w.text(s, s + n)
                for own, names in at[j]:
                    if own == text:
                        hit[s] += 1
                        hit[s + n] -= 1
                        items.setdefault(int(w.row[s]), set()).update(names - {None})
        return np.cumsum(hit)[:-1] > 0, items


def window_hash(h: np.ndarray, spots: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words at ``spots``, equal to ``grams`` there."""
    around = grams(np.ascontiguousarray(h[(spots[:, None] + np.arange(n)).ravel()]), n)
    return around[::n]


def _pass(docs: DataFrame, text: str, before: str | None, into: str, block: Block | None) -> DataFrame:
    """One block over all documents, added to what earlier blocks found in ``before``."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    at, last = docs.columns.index(text), docs.columns.index(before) if before else None

    def judge(part: pa.RecordBatch) -> pa.StructArray:
        w = _words(part.column(at))
        hit, items = shared.value.meet(w) if shared.value else (np.zeros(len(w), bool), {})
        if last is not None:
            for r, old in enumerate(part.column(last).to_pylist()):
                if old["hit"]:
                    a, b = w.first[r], w.first[r + 1]
                    hit[a:b] |= np.unpackbits(np.frombuffer(old["hit"], np.uint8), count=b - a).astype(bool)
                    items.setdefault(r, set()).update(old["items"])
        marks, names = [None] * len(w.count), [[]] * len(w.count)
        for r, found in items.items():
            marks[r] = np.packbits(hit[w.first[r] : w.first[r + 1]]).tobytes()
            names[r] = sorted(found)
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit = total[w.first[1:]] - total[w.first[:-1]]
        return pa.StructArray.from_arrays(
            [pa.array(w.count, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())),
             pa.array(marks, pa.binary())],
            HITS.names,
        )

    return add_struct(docs, text, into, HITS, judge)


def _blocks(benchmark: DataFrame, item: str, text: str, most: int):
    """Test items in blocks of about ``most`` bytes of text, dealt by hash; one block is on the driver at a time."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    rows = rows.where("text IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / most))
    dealt = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for b in range(n):
        yield [(r.item, r.text) for r in rows.where(dealt == b).collect()]


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    into: str,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``into`` of n_words, n_hit, items (sorted item ids) and contaminated."""
    found, last = docs, None
    for rows in _blocks(benchmark, item, item_text, block_bytes):
        block = Block([i for i, _ in rows], [t for _, t in rows], window, gram) if rows else None
        found, last = _pass(found, text, last, name := spare(found, into), block), name
    f = F.col(last)
    bad = (f.n_hit > 0) & (f.n_hit * 20 >= f.n_words)
    out = F.struct(f.n_words.alias("n_words"), f.n_hit.alias("n_hit"), f["items"].alias("items"), bad.alias("contaminated"))
    return found.select(*docs.columns, out.alias(into))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    from flowguard.llm.common import documents, table

    found = mark(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "found")
    f = F.col("found")
    return found.select(
        "doc_id",
        f.n_words.alias("n_words"),
        f.n_hit.alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        digest_of(f["items"]).alias("items_sha256"),
        f.contaminated.alias("contaminated"),
    )
