"""Where a pattern matches, as built-in column functions: spans in code points without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = "array<struct<start:int,stop:int,value:string>>"
#: Matches that are placed by one fold; longer lists are folded chunk by chunk.
CHUNK = 128


def spans(text: Column, pattern: str, hint: Column) -> Column:
    """Non-overlapping matches of ``pattern``, leftmost first, as (start, stop, value); [] where ``hint`` is false.

    The text between the matches and the matches themselves give the places, by running sums of their
    lengths: inside chunks, and over the sums of chunks, so that many matches in a text stay cheap.
    """
    between = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(value, between, lambda v, b: F.struct(F.coalesce(F.length(b), F.lit(0)).alias("gap"), v.alias("value")))
    pairs = F.filter(pairs, lambda p: p.value.isNotNull())
    found = _bind(pairs, _place)
    return F.when(hint, found).otherwise(F.array().cast(SPAN))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _long(p: Column) -> Column:
    return p["gap"] + F.length(p["value"])


def _place(pairs: Column) -> Column:
    chunks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int"))),
        lambda k: F.slice(pairs, k * CHUNK + 1, CHUNK),
    )

    def fold(state: Column, chunk: Column) -> Column:
        start = F.struct(state["at"].alias("at"), F.array().cast(SPAN).alias("found"))
        done = F.aggregate(
            chunk,
            start,
            lambda s, p: F.struct(
                (s["at"] + _long(p)).alias("at"),
                F.concat(
                    s["found"],
                    F.array(F.struct((s["at"] + p["gap"]).alias("start"), (s["at"] + _long(p)).alias("stop"), p["value"].alias("value"))),
                ).alias("found"),
            ),
        )
        return _bind(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["found"], d["found"]).alias("found")))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
    return F.aggregate(chunks, empty, fold, lambda s: s["found"])
