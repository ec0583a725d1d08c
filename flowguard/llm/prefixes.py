"""Conversation prefix trie: each distinct sequence of first turns is a node, held in hash tables without gaps.

Turns get their place in one pass over range-partitioned, sorted rows, so a conversation may be spread over
tasks. The digest of a prefix is the sum, in two lanes of 64 bits, of one hash for each (place, turn); it needs no order and
is carried over from one part of a conversation to the next as a sum.

The rows (conversation, depth) are dealt into shards of about ``SHARD`` rows, by conversation and band of ``BAND`` turns. In
a shard the distinct digests get the slots of a minimal perfect hash; the digest that a slot holds is compared in
full with each digest that was sent there. Counts are scattered into flat arrays by slot. What the shards
found is summed by digest: members, least member (the node's owner) and parent; children are counted by parent.

Subtree sums are gathered the same way: every node's value goes once, to its owner's shard, and each shard adds the
values of its slots to their parents' slots, deepest level first. A node that several shards hold is the sum of
what they found, as each value was counted in one of them. Where conversations are longer than a band, the nodes at the
ends of bands form a trie of their own (bands grow with the root of the longest conversation, so it is no deeper than a
band); it is summed first, in the same way, and its sums enter those nodes as what lies below them.

The ids of the conversations that end at a node are put together in blocks of ``BLOCK`` ids, and their digest is fed block after
block, so one node may have any number of them.

Defined results: turns are ordered by turn (null first), then role and text; null role or text is empty; rows
without conv_id belong to no conversation; repeated rows are turns of their own; an empty table has no nodes, not even a root. Columns
other than the four named ones are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from flowguard.llm.common import materialize
from flowguard.llm.words import mix

HEADS = 5
#: Rows that a shard holds about, turns of one conversation that go to the same shard, and ids of a block.
SHARD = 1 << 18
BAND = 1 << 12
BLOCK = 1 << 16

_U = np.uint64
TURN = "conv long, k long, part int, ta long, tb long, size long"
LOCAL = "shard long, kind int, a long, b long, pa long, pb long, xa long, xb long, depth long, n long, conv long, size long"
#: What a row of a shard stands for: a node, the end of a conversation in its band, a conversation at the end of a whole band.
NODE, END, WHOLE = 0, 1, 2
SUMMED = ("n_leaves", "saved_tokens")
SUMS = "a long, b long, n_leaves long, saved_tokens long"
HALVES = ("a1", "a0", "b1", "b0")


class SlotTable:
    """A minimal perfect hash over distinct pairs of 64-bit keys: n keys take the slots 0 to n - 1.

    On each level the keys left over are dealt into a bit array; keys that are alone in their place
    stay, the others go on to the next level. A slot is the number of occupied places before its own.
    """

    LOAD = 2

    def __init__(self, a: np.ndarray, b: np.ndarray):
        salt = 0
        while True:
            folded = self._fold(a, b, salt)
            if len(np.unique(folded)) == len(folded):
                break
            salt += 1  # two pairs fell on one key
        self.salt, self.levels = salt, []
        left, taken = folded, 0
        while len(left):
            m = self.LOAD * len(left) + 1
            at = self._place(left, m)
            alone = np.bincount(at, minlength=m)[at] == 1
            used = np.zeros(m, bool)
            used[at[alone]] = True
            self.levels.append((m, used, taken + np.cumsum(used) - 1))
            taken += int(alone.sum())
            left = left[~alone]
        self.a, self.b = np.zeros(len(a), _U), np.zeros(len(a), _U)
        slot = self._walk(a, b)
        self.a[slot], self.b[slot] = a, b
        if (self.a[slot] != a).any() or (self.b[slot] != b).any():
            raise AssertionError("two digests share a slot")

    @staticmethod
    def _fold(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        return mix(a + _U(salt)) ^ (b * _U(2 * salt + 1))

    def _place(self, keys: np.ndarray, m: int) -> np.ndarray:
        return (mix(keys + _U(0x632BE59BD9B4E019 * (len(self.levels) + 1) % (1 << 64))) % _U(m)).astype(np.int64)

    def _walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = self._fold(a, b, self.salt)
        slot, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        levels, self.levels = self.levels, []
        for m, used, rank in levels:
            at = self._place(keys[open_], m)
            hit = used[at]
            slot[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
            self.levels.append((m, used, rank))
        return slot

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 for pairs that the table does not hold."""
        slot = self._walk(a, b)
        held = slot >= 0
        held[held] = (self.a[slot[held]] == a[held]) & (self.b[slot[held]] == b[held])
        return np.where(held, slot, -1)


def accumulate(values: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """``values`` (a row for each slot) with those of all slots below added, deepest level first; parent -1: none."""
    out = values.copy()
    order = np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, edges):
        level = level[parent[level] >= 0]
        np.add.at(out, parent[level], out[level])
    return out


def _numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.to_numpy(zero_copy_only=False)


def _turn_hash(role: str | None, text: str | None) -> tuple[int, int]:
    role = (role or "").encode()
    h = hashlib.blake2b(len(role).to_bytes(8, "little") + role + (text or "").encode(), digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def turns(rows: DataFrame) -> DataFrame:
    """(conv, i, ta, tb, size) for each row (conv_id, turn, role, text): place from 1, digest and code points of the turn."""
    blank = F.lit("")
    rows = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    )
    ordered = rows.repartitionByRange("conv", "turn").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, k = None, 0
        for batch in batches:
            out = []
            part = batch.column("part").to_pylist()
            for p, c, role, text in zip(part, *(batch.column(n).to_pylist() for n in ("conv", "role", "text"))):
                k = k + 1 if c == last else 1
                last = c
                out.append((c, k, p, *_turn_hash(role, text), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["conv", "k", "part", "ta", "tb", "size"])

    made = materialize(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, TURN), "prefixes-turns")
    # a conversation that runs over several tasks goes on counting
    here = made.groupBy("conv", "part").agg(F.max("k").alias("most"))
    split = here.groupBy("conv").agg(F.collect_list(F.struct("part", "most")).alias("parts")).where(F.size("parts") > 1)
    add = split.select("conv", "parts", F.explode("parts").alias("p"))
    before = F.aggregate(F.filter("parts", lambda x: x.part < F.col("p.part")), F.lit(0).cast("long"), lambda s, x: s + x.most)
    add = add.select("conv", F.col("p.part").alias("part"), before.alias("add"))
    placed = made.join(add, ["conv", "part"], "left")
    return placed.select("conv", (F.col("k") + F.coalesce("add", F.lit(0))).alias("i"), "ta", "tb", "size")


def rebuilt(placed: DataFrame) -> DataFrame:
    """(conv, depth, ta, tb, size) of rebuilt conversations, from placed turns; each conversation has a row of depth 0.

    The first h turns come from the conversation whose id is the next lower multiple of 100.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (HEADS + 1)
    turn = F.struct("i", "ta", "tb", "size")
    heads = placed.where((F.col("conv") % 100 == 0) & (F.col("i") <= HEADS)).groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("head"))
    convs = placed.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % 100).alias("base"), h.alias("h"))
    convs = convs.join(heads.withColumnRenamed("conv", "base"), "base", "left")
    head = F.filter(F.coalesce("head", F.array().cast("array<struct<i:long,ta:long,tb:long,size:long>>")), lambda x: x.i <= F.col("h"))
    convs = convs.select("conv", "h", head.alias("head"))
    zero = F.lit(0).cast("long")
    root = F.array(F.struct(zero.alias("i"), zero.alias("ta"), zero.alias("tb"), zero.alias("size")))
    first = convs.select("conv", F.inline(F.concat(root, "head"))).withColumnRenamed("i", "depth")
    own = placed.join(convs.select("conv", F.col("h").alias("cut"), F.size("head").cast("long").alias("have")), "conv")
    own = own.where(F.col("i") > F.col("cut")).select("conv", (F.col("i") - F.col("cut") + F.col("have")).alias("depth"), "ta", "tb", "size")
    return first.unionByName(own)


def _place_hash(depth: np.ndarray, ta: np.ndarray, tb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two lanes for a turn in its place; nothing for the root."""
    d = depth.astype(_U)
    a = mix(mix(ta.view(_U) + d) ^ tb.view(_U))
    b = mix(mix(tb.view(_U) ^ mix(d)) + ta.view(_U))
    a[depth == 0] = b[depth == 0] = 0
    return a, b


def _deal(rows: DataFrame, shards: int, band: int) -> DataFrame:
    """``rows`` (conv, depth, ...) with the number of their band and shard."""
    at = F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / band).cast("long")
    rows = rows.withColumn("band", at)
    return rows.withColumn("shard", F.pmod(F.xxhash64("conv", "band"), F.lit(shards)))


def _carried(rows: DataFrame) -> DataFrame:
    """``rows`` with the digest of all that their conversation has in earlier bands (``ca``, ``cb``), zero in the first."""

    def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, ta, tb = (_numbers(batch, n) for n in ("depth", "ta", "tb"))
            parts = [x for lane in _place_hash(depth, ta, tb) for x in ((lane >> _U(32)).astype(np.int64), (lane & _U(0xFFFFFFFF)).astype(np.int64))]
            own = [batch.column(batch.schema.get_field_index(n)) for n in ("conv", "band")]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, parts)], ["conv", "band", *HALVES])

    kinds = "conv long, band long, a1 long, a0 long, b1 long, b0 long"
    half = rows.select("conv", "band", "depth", "ta", "tb").mapInArrow(lanes, kinds)
    # sums of halves stay far from overflow; whole lanes wrap around
    total = half.groupBy("conv", "band").agg(*[F.sum(x).alias(x) for x in HALVES])
    before = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("conv", "band", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in HALVES])
    return rows.join(total, ["conv", "band"])


def _shard_nodes(table: pa.Table, band: int) -> pa.Table:
    """The rows of one shard: its nodes, a row for each slot, then ends of conversations and of whole bands."""
    table = table.take(pc.sort_indices(table, [("conv", "ascending"), ("depth", "ascending")]))
    shard, conv, depth, size, ta, tb, at = (_numbers(table, x) for x in ("shard", "conv", "depth", "size", "ta", "tb", "band"))
    fresh = np.ones(len(conv), bool)
    fresh[1:] = (conv[1:] != conv[:-1]) | (at[1:] != at[:-1])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(conv)), 0))
    own, before, above = [], [], []
    for lane, high, low in zip(_place_hash(depth, ta, tb), ("a1", "b1"), ("a0", "b0")):
        carried = (_numbers(table, high).astype(_U) << _U(32)) + _numbers(table, low).astype(_U)
        run = np.cumsum(lane)
        digest = run - (run - lane)[begin] + carried
        own.append(digest)
        above.append(carried)
        before.append(np.where(fresh, carried, np.roll(digest, 1)))
    a, b = own
    keys, first = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True)
    slots = SlotTable(np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]))
    slot = slots.find(a, b)
    m = len(keys)
    members = np.bincount(slot, minlength=m)
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, conv)
    of = np.zeros(m, np.int64)
    of[slot[first]] = first
    if (slot < 0).any() or (depth[of][slot] != depth).any() or (size[of][slot] != size).any():
        raise AssertionError("two prefixes share a digest")
    ends = np.flatnonzero(np.append(fresh[1:], True))
    whole = np.flatnonzero((depth > 0) & (depth % band == 0))
    rows = np.concatenate([of, ends, whole])
    one = np.ones(len(ends) + len(whole), np.int64)
    columns = {
        "shard": shard[rows],
        "kind": np.repeat(np.array([NODE, END, WHOLE], np.int32), [m, len(ends), len(whole)]),
        **{n: x[rows].view(np.int64) for n, x in zip(("a", "b", "pa", "pb", "xa", "xb"), (a, b, *before, *above))},
        "depth": depth[rows],
        "n": np.concatenate([members, one]),
        "conv": np.concatenate([least, conv[ends], conv[whole]]),
        "size": size[rows],
    }
    return pa.table(columns)


def _shard_sums(shard: pa.Table, owned: pa.Table, band: int) -> pa.Table:
    """What the owned values of one shard come to at each of its nodes, within their band."""
    a, b, above_a, above_b = (_numbers(shard, x).view(_U) for x in ("a", "b", "pa", "pb"))
    slots = SlotTable(a, b)
    slot = slots.find(a, b)
    depth, parent = np.zeros(len(a), np.int64), np.full(len(a), -1, np.int64)
    depth[slot] = _numbers(shard, "depth")
    parent[slot] = slots.find(above_a, above_b)
    parent[(depth == 0) | ((depth > band) & ((depth - 1) % band == 0))] = -1
    values = np.zeros((len(a), 2), np.int64)
    to = slots.find(*(_numbers(owned, x).view(_U) for x in ("a", "b")))
    if (to < 0).any():
        raise AssertionError("a node is missing in its owner's shard")
    for k, x in enumerate(SUMMED):
        np.add.at(values[:, k], to, _numbers(owned, x))
    values = accumulate(values, parent, depth)
    some = values.any(axis=1)
    columns = [slots.a[some].view(np.int64), slots.b[some].view(np.int64), *values[some].T]
    return pa.table(dict(zip(("a", "b", *SUMMED), map(np.ascontiguousarray, columns))))


def _gathered(nodes: DataFrame, values: DataFrame, band: int) -> DataFrame:
    """(a, b, n_leaves, saved_tokens): what ``values`` come to at each node, from the shards that both are dealt into."""
    both = nodes.groupBy("shard").cogroup(values.groupBy("shard"))
    found = both.applyInArrow(lambda x, y: _shard_sums(x, y, band), SUMS)
    return found.groupBy("a", "b").agg(*[F.sum(x).alias(x) for x in SUMMED])


def _subtrees(local: DataFrame, nodes: DataFrame, shards: int, band: int, deepest: int) -> DataFrame:
    """(a, b, n_leaves, saved_tokens) summed over the subtree of each of ``nodes``, which hold these values of their own."""
    values = nodes.select("a", "b", "conv", "depth", *SUMMED)
    if deepest > band:
        whole = local.where(F.col("kind") == WHOLE).withColumn("shard", F.pmod(F.xxhash64("conv"), F.lit(shards)))
        whole = whole.select("shard", "a", "b", F.col("xa").alias("pa"), F.col("xb").alias("pb"), (F.col("depth") / band).cast("long").alias("depth"))
        # what lies in the next band below the end of a band, in the shard of that node's owner
        next_ = nodes.where(F.col("depth") > band).groupBy(F.col("xa").alias("a"), F.col("xb").alias("b")).agg(*[F.sum(x).alias(x) for x in SUMMED])
        next_ = next_.join(nodes.select("a", "b", "conv"), ["a", "b"]).withColumn("shard", F.pmod(F.xxhash64("conv"), F.lit(shards)))
        below = _gathered(whole.distinct(), next_, deepest)
        below = below.join(nodes.select("a", "b", "conv", "depth"), ["a", "b"])
        values = values.unionByName(below.select(values.columns))
    kept = local.where(F.col("kind") == NODE).select("shard", "a", "b", "pa", "pb", "depth")
    return _gathered(kept, _deal(values, shards, band), band)


def _ends(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): digest of the ascending ids of ``ends`` (conv, a, b) at each node, fed block by block."""
    text = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")))
    parts = ends.groupBy("a", "b", F.floor(F.col("conv") / BLOCK).alias("block")).agg(text.alias("ids"))
    parts = parts.repartition("a", "b").sortWithinPartitions("a", "b", "block").select("a", "b", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []

        def give() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[], [], []]
            kinds = [pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", "ends_sha256"])

        for batch in batches:
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (a, b) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield give()
            out = []
        if node:
            out.append((*node, state.hexdigest()))
            yield give()

    return parts.mapInArrow(run, "a long, b long, ends_sha256 string")


def trie(rows: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), from rows (conv_id, turn, role, text).
    """
    spark = rows.sparkSession
    steps = materialize(rebuilt(turns(rows)), "prefixes-steps")
    total = steps.agg(F.count("*").alias("n"), F.max("depth").alias("deepest")).first()
    deepest = total.deepest or 0
    band = max(band, math.isqrt(deepest) + 1)
    shards = max(math.ceil(total.n / shard), spark.sparkContext.defaultParallelism)
    dealt = _deal(steps, shards, band)
    if deepest > band:
        dealt = _carried(dealt)
    else:
        dealt = dealt.select("*", *[F.lit(0).cast("long").alias(x) for x in HALVES])
    local = dealt.groupBy("shard").applyInArrow(lambda x: _shard_nodes(x, band), LOCAL)
    local = materialize(local, "prefixes-local")
    least = [F.min(x).alias(x) for x in ("pa", "pb", "xa", "xb", "depth", "size", "conv")]
    nodes = local.where(F.col("kind") == NODE).groupBy("a", "b").agg(F.sum("n").alias("n_convs"), *least)
    nodes = materialize(nodes, "prefixes-nodes")
    kids = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    leaf = (F.col("n_children") == 0).cast("long").alias("n_leaves")
    saved = ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")
    nodes = materialize(nodes.select("*", leaf, saved), "prefixes-valued")
    sums = _subtrees(local, nodes, shards, band, deepest)
    last = local.where(F.col("kind") == END).groupBy("conv").agg(F.max(F.struct("depth", "a", "b")).alias("end"))
    ends = _ends(last.select("conv", "end.a", "end.b"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent"))
    out = nodes.drop(*SUMMED).join(sums, ["a", "b"], "left").join(ends, ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        *[F.coalesce(x, zero).alias(x) for x in SUMMED],
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Every node of the conversations' prefix trie."""
    from flowguard.llm.common import table

    return trie(table(spark, sf_dir, "conversations"))
