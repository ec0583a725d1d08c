"""Spelling variants: words at one edit from each other, each led to its most frequent near word.

Words of whole texts are counted with built-in functions. A pair at one inserted, deleted or replaced code point shares
either the first half of the shorter word or its last half, so each word enters two groups for its own
length and two for a length one less: those of its first and of its last half. Inside a group
only what is not shared differs, by one edit again.

A group is a sorted list (read backwards where the end is shared), and a query walks along it with the
banded rows of the edit matrix: a row for each character of the list's word, three cells wide. Neighbours in the list keep the
rows of their common prefix; once all cells of a row exceed one edit, the whole range of words with
that prefix is skipped.

A group above ``GROUP`` words is split again by the halves of what is not yet shared, until it is
small or one character remains, where the alphabet bounds it. A pair is counted in the one group where its
first difference lies, so nothing is counted twice. Groups give one row for each word (how many near words, the
best of them), never pairs, and those rows are summed. Leaders of leaders follow by pointer jumping over tables in the
shared folder; each form is at least ``RATIO`` times as frequent, so chains have logarithmic length.

Defined results: a null or empty text has no words; a null id counts as an empty one in the digest that decides a
deletion; repeated rows count as often as they occur; words of one n are ordered by code points; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowguard.functions.once import once
from flowguard.llm.common import materialize

SHORTEST = 6
OCCURRENCES = 5
RATIO = 5
#: Of each word's occurrences, the share of one in so many loses a character.
DELETION = 199
#: Words of a group up to which it is not split further.
GROUP = 1024
#: A character above all others.
LAST = "\U0010ffff"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FOUND = "word string, n_near bigint, form_n bigint, form string"


def _lowered(word: Column) -> Column:
    """A-Z in small letters, others as they are; only words of A-Z and small Latin-1 letters may take the quick way."""
    return F.when(word.rlike("[À-Þ]"), F.translate(word, UPPER, LOWER)).otherwise(F.lower(word))


def occurrences(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, deletion: int = DELETION) -> DataFrame:
    """One row (word) for each run of letters that has ``shortest`` code points after its deletion, if any."""
    runs = F.regexp_extract_all(F.col(text), F.lit("[A-Za-zÀ-ÿ]{%d,}" % shortest), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = once(rows.select("id", _lowered(F.col("run")).alias("run")), h=F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % deletion == 0, less).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= shortest)


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words that occur at least ``least`` times in all."""
    return occurrences(docs, id, text, shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the key of their group: its length class, what is shared, and where."""
    head = F.substr("word", F.lit(1), F.col("a"))
    tail = F.right(F.col("word"), F.col("b"))
    return rows.withColumn("key", F.concat_ws(":", "m", "a", "b", head, tail))


def _groups(words: DataFrame, shortest: int, most: int) -> DataFrame:
    """(word, n, m, a, b, key): each word in its groups of length class m, whose words share a first and b last characters."""
    long = F.length("word")
    rows = words.withColumn("m", F.explode(F.array(long, long - 1))).where(F.col("m") >= shortest)
    half = F.floor(F.col("m") / 2).cast("int")
    zero = F.lit(0)
    side = F.array(F.struct(half.alias("a"), zero.alias("b")), F.struct(zero.alias("a"), (F.col("m") - half).alias("b")))
    open_ = materialize(_keyed(rows.select("*", F.inline(side))), "variants-groups")
    done = []
    while True:
        size = open_.groupBy("key").agg(F.count("*").alias("n_key"))
        left = F.col("m") - F.col("a") - F.col("b")
        large = size.where(F.col("n_key") > most).select("key")
        if large.isEmpty():
            done.append(open_)
            break
        done.append(open_.join(large, "key", "left_anti").select(open_.columns))
        hot = open_.join(large, "key", "left_semi").select(open_.columns)
        done.append(hot.where(left <= 1))
        h = F.floor(left / 2).cast("int")
        parts = F.array(
            F.struct((F.col("a") + h).alias("a2"), F.col("b").alias("b2")),
            F.struct(F.col("a").alias("a2"), (F.col("b") + left - h).alias("b2")),
        )
        parted = hot.where(left > 1).select("word", "n", "m", F.inline(parts)).withColumnsRenamed({"a2": "a", "b2": "b"})
        open_ = materialize(_keyed(parted).select(open_.columns), "variants-groups")
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def near_in(words: list[str], queries: list[int], lcp: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """(query, place) for each word of the sorted list ``words`` at exactly one edit from the query, itself a place in the list.

    ``rows[d]`` holds the cells d-1, d and d+1 of the edit matrix's row for the first d characters of the word.
    """
    if lcp is None:
        lcp = prefixes(words)
    count = len(words)
    for k in queries:
        q = words[k]
        long = len(q)
        rows, depth = [(9, 0, 1 if long else 9)], 0
        i = 0
        while i < count:
            word = words[i]
            if depth > lcp[i]:
                depth = lcp[i]
                del rows[depth + 1 :]
            size = len(word)
            left, middle, right = rows[depth]
            while depth < size:
                c = word[depth]
                # cells of the next row: columns depth, depth + 1 and depth + 2
                x = left + (depth == 0 or depth > long or q[depth - 1] != c) if depth else 9
                if middle + 1 < x:
                    x = middle + 1
                y = middle + (depth >= long or q[depth] != c)
                if x + 1 < y:
                    y = x + 1
                if right + 1 < y:
                    y = right + 1
                z = right + (depth + 1 >= long or q[depth + 1] != c)
                if y + 1 < z:
                    z = y + 1
                depth += 1
                left = x if depth - 1 <= long else 9
                middle = y if depth <= long else 9
                right = z if depth + 1 <= long else 9
                rows.append((left, middle, right))
                if left > 1 and middle > 1 and right > 1:
                    break
            if left > 1 and middle > 1 and right > 1:
                # no word that begins like this is near
                i = bisect_left(words, word[:depth] + LAST, i + 1)
                continue
            at = long - size
            if i != k and -1 <= at <= 1 and (left, middle, right)[at + 1] == 1:
                yield k, i
            i += 1


def _shared(a: str, b: str) -> int:
    most = min(len(a), len(b))
    k = 0
    while k < most and a[k] == b[k]:
        k += 1
    return k


def prefixes(words: list[str]) -> list[int]:
    """Length of the prefix that each word shares with the one before it."""
    return [0, *map(_shared, words, words[1:])] if words else []


def _scan(m: int, a: int, b: int, words: list[str], n: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, n of the best, the best) for the words of one group."""
    rest = [w[a : len(w) - b] for w in words]
    if b:
        rest = [r[::-1] for r in rest]
    order = sorted(range(len(rest)), key=rest.__getitem__)
    listed = [rest[i] for i in order]
    free = m - a - b
    own = [k for k, r in enumerate(listed) if len(r) == free]
    if not own or len(listed) < 2:
        return
    found: dict[int, list] = {}

    def meet(i: int, j: int) -> None:
        best = (-n[j], words[j])
        have = found.setdefault(i, [0, best])
        have[0] += 1
        if best < have[1]:
            have[1] = best

    for k, j in near_in(listed, own):
        u, v = order[k], order[j]
        if b and len(listed[j]) > free and listed[j].endswith(listed[k]):
            continue  # the first difference lies behind: another group has this pair
        meet(u, v)
        if len(listed[j]) > free:
            meet(v, u)
    for i, (count, best) in found.items():
        yield words[i], count, -best[0], best[1]


def neighbours(words: DataFrame, shortest: int = SHORTEST, most: int = GROUP) -> DataFrame:
    """(word, n_near, form_n, form) for each of ``words`` (word, n; distinct) that has near words; form: the most frequent one."""
    rows = _groups(words, shortest, most)
    rows = rows.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, out = None, ([], []), []

        def flush() -> None:
            if len(kept[0]) > 1:
                m, a, b = map(int, key.split(":", 3)[:3])
                out.extend(_scan(m, a, b, *kept))

        def give() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[], [], [], []]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n_near", "form_n", "form"])

        for batch in batches:
            for w, c, k in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if k != key:
                    flush()
                    key, kept = k, ([], [])
                kept[0].append(w)
                kept[1].append(c)
            if len(out) > 10000:
                yield give()
                out = []
        flush()
        yield give()

    found = rows.select("word", "n", "key").mapInArrow(run, FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the links (word, form) of words that have a form: the last word that forms lead to."""
    jump = materialize(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        on = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if jump.join(on, "root", "left_semi").isEmpty():
            return jump
        jump = materialize(jump.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variants-roots")


def group(words: DataFrame, shortest: int = SHORTEST, ratio: int = RATIO, most: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every one of ``words`` (word, n; distinct)."""
    words = materialize(words.select("word", "n"), "variants-words")
    found = materialize(words.join(neighbours(words, shortest, most), "word", "left"), "variants-near")
    leads = F.col("form_n") >= ratio * F.col("n")
    root = roots(found.where(leads).select("word", "form"))
    out = found.join(root, "word", "left")
    return out.select(
        "word",
        F.when(leads, F.col("form")).alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(leads, F.col("form_n")).alias("form_n"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word of the documents."""
    from flowguard.llm.common import documents

    return group(vocabulary(documents(spark, sf_dir)))
