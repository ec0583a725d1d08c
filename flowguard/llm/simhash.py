"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is split into four blocks of 16 bits. Two fingerprints that differ in at most
two bits agree in at least two whole blocks, so each fingerprint enters six joins, one for each pair
of blocks it may share (32 equal bits), and every meeting is verified by its Hamming distance.

Copies collapse to one row per fingerprint before anything is joined. A group of near copies can
still put many different fingerprints under one pair of blocks; there the pairs are not spelled out.
Bits left and right of the meeting then differ in at most two places, so both sides share a
neighbour at distance one or less: such a bucket is joined on these neighbours, and links each
fingerprint to the least one that has the neighbour. Nothing is capped or dropped.

Components follow from the links by label propagation with pointer jumping on tables in the shared
folder.

Defined results: a null, empty or blank text has fingerprint zero, and zero links like any other;
fewer than three words are one shingle; repeated rows are members like others; an empty table gives
an empty one. Rows with null ids take part, but can't name a component unless all of its ids are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from flowguard.llm.common import add_struct, materialize, spare
from flowguard.llm.components import components
from flowguard.llm.words import NOT_SPACE, Words, text_column

SHINGLE = 3
SEED = 42
BITS = 2
#: Different fingerprints under one pair of blocks up to which pairs are compared directly.
BUCKET = 32
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def _fingerprints(column: pa.Array, shingle: int) -> np.ndarray:
    w = Words(*text_column(column), NOT_SPACE, lower=True)
    out = np.zeros(len(w.count), np.uint64)
    for r in np.flatnonzero(w.count).tolist():
        out[r] = _fingerprint(w, int(w.first[r]), int(w.first[r + 1]), shingle)
    return out


def _fingerprint(w: Words, a: int, b: int, shingle: int) -> int:
    n = min(shingle, b - a)
    total = b - a - n + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(a, a + total, CHUNK):
        to = min(at + CHUNK, a + total)
        # shingles are cut out of the words joined by single spaces
        start, end = w.start[at : to + n - 1], w.end[at : to + n - 1]
        long = end - start + 1
        begin = np.cumsum(long) - long
        text = w.text(at, to + n - 1)
        stop = (begin + long - 1)[n - 1 :].tolist()
        h = np.array([digest(text[x:y], SEED) for x, y in zip(begin[: to - at].tolist(), stop)], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, into: str, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of the whole text, as the signed long of its bits, in ``into``."""
    at = docs.columns.index(text)
    holder = spare(docs, into)
    kind = StructType().add("fingerprint", LongType())

    def judge(part: pa.RecordBatch) -> pa.StructArray:
        found = _fingerprints(part.column(at), shingle).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(found)], ["fingerprint"])

    found = add_struct(docs, text, holder, kind, judge)
    return found.select(*docs.columns, F.col(holder).fingerprint.alias(into))


def _masks() -> list[int]:
    """For each pair of blocks, the bits of both."""
    block = [0xFFFF << (16 * i) for i in range(4)]
    both = [block[i] | block[j] for i in range(4) for j in range(i + 1, 4)]
    return [m - (1 << 64) if m >> 63 else m for m in both]


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints of ``prints`` (one column, distinct) at two bits or less.

    They connect the same fingerprints as all close pairs do, yet need not be all of them: in large
    buckets a fingerprint is linked to the least of those with which it shares a neighbour.
    """
    masks = _masks()
    kept = F.array(*[F.lit(m).bitwiseAND(F.col("f")) for m in masks])
    rows = prints.toDF("f").select("f", F.posexplode(kept).alias("pair", "key"))
    sizes = rows.groupBy("pair", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = materialize(rows.join(sizes, ["pair", "key"]), "simhash-buckets")
    small = rows.where(F.col("n") <= BUCKET)
    a = small.select("pair", "key", F.col("f").alias("a"))
    b = small.select("pair", "key", F.col("f").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    direct = a.join(b, ["pair", "key"]).where((F.col("a") < F.col("b")) & close).select("a", "b")
    large = rows.where(F.col("n") > BUCKET).select("f").distinct()
    one = [1 << i for i in range(63)] + [-(1 << 63)]
    near = F.transform(F.array(F.lit(0).cast("long"), *[F.lit(x).cast("long") for x in one]), lambda x: x.bitwiseXOR(F.col("f")))
    seen = large.select("f", F.explode(near).alias("at"))
    least = seen.groupBy("at").agg(F.min("f").alias("a"), F.count("*").alias("n")).where("n > 1").select("at", "a")
    star = seen.join(least, "at").where("f != a").select("a", F.col("f").alias("b"))
    return direct.unionByName(star).distinct()


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; fingerprint as a signed long."""
    marked = with_fingerprint(docs.select(id, text), "fingerprint" if id.lower() != "fingerprint" else "fingerprint_", text, shingle)
    named = marked.select(F.col(id).alias("doc_id"), F.col(marked.columns[-1]).alias("fingerprint"))
    rows = materialize(named, "simhash-prints")
    prints = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    label = components(links(prints.select("fingerprint")))
    # the least id of a component, over its fingerprints
    of = prints.join(label, prints.fingerprint == label.node, "left")
    of = of.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    root = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = of.join(root, "root").select("fingerprint", "component_id")
    return rows.join(of, "fingerprint").select("doc_id", "fingerprint", "component_id")


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def query(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from flowguard.llm.common import documents

    found = groups(documents(spark, sf_dir))
    return found.select("doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")
