"""Running values in row order, without ever sorting a whole group in one task.

``Window.partitionBy(group)`` sends a group to a single task, which fails once one flow, host or
sensor holds a large share of the rows.  ``scan`` gives the same running sums and carried values
level by level instead:

1. the order key is cut into blocks of ``2**BLOCK_BITS``; as the key is unique within its group,
   no block can hold more rows than that, whatever the skew;
2. one partially aggregated row per block, the same per ``2**SUPER_BITS`` blocks, and once more: with four digits of
   16 bits every 64-bit key is covered, so that no window sees more than 65 536 rows, however far apart the keys are;
3. prefixes go back down, level by level; that of the block joins the rows and a window over (group,
   block) finishes the work.  Join and window share one exchange of the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_BITS = 16
SUPER_BITS = 16
LEVELS = 2  # above the blocks


@dataclass(frozen=True)
class Sum:
    """Running sum; ``before`` leaves the row itself out."""

    value: Column
    before: bool = False


@dataclass(frozen=True)
class Last:
    """Most recent non-null value; ``before`` leaves the row itself out."""

    value: Column
    before: bool = False


@dataclass(frozen=True)
class Total:
    """Sum over the whole group, on every row of it."""

    value: Column


Running = Sum | Last | Total


def scan(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    block_bits: int = BLOCK_BITS,
    super_bits: int = SUPER_BITS,
    **out: Running,
) -> DataFrame:
    """Add one running column per keyword to ``df``.

    ``order`` is an integer column that is unique within a group, and the ``group`` columns are
    not null.  An empty ``group`` scans the whole table as one sequence.
    """
    group = list(group)
    rows = df.select(
        "*",
        F.coalesce(F.shiftright(F.col(order).cast("long"), block_bits), F.lit(0)).alias("_blk"),
        *[r.value.alias(f"_v_{name}") for name, r in out.items()],
    )

    def folded(position: str):
        """Aggregates that sum up a range of rows, or of blocks, for the next level."""
        for name, r in out.items():
            v = F.col(f"_v_{name}")
            if isinstance(r, Last):
                yield F.max_by(v, F.when(v.isNotNull(), F.col(position))).alias(f"_v_{name}")
            else:
                yield F.sum(v).alias(f"_v_{name}")

    def earlier(window):
        """Values of all ranges before this one, within the window."""
        for name, r in out.items():
            v = F.col(f"_v_{name}")
            if isinstance(r, Last):
                yield F.last(v, ignorenulls=True).over(window).alias(f"_e_{name}")
            elif isinstance(r, Sum):
                yield F.sum(v).over(window).alias(f"_e_{name}")

    def with_above():
        """Those values, and what lies before the range of the next level; totals as they are."""
        for name, r in out.items():
            e, p = F.col(f"_e_{name}"), F.col(f"_p_{name}")
            if isinstance(r, Last):
                yield F.coalesce(e, p).alias(f"_p_{name}")
            elif isinstance(r, Sum):
                yield (F.coalesce(e, F.lit(0)) + F.coalesce(p, F.lit(0))).alias(f"_p_{name}")
            else:
                yield F.col(f"_t_{name}")

    # level 0 are the blocks, each further level is coarser
    at = ["_blk", *[f"_sup{k}" for k in range(1, LEVELS + 1)]]
    levels = [rows.groupBy(*group, "_blk").agg(*folded(order))]
    for fine, coarse in zip(at, at[1:]):
        levels[-1] = levels[-1].withColumn(coarse, F.shiftright(fine, super_bits))
        levels.append(levels[-1].groupBy(*group, coarse).agg(*folded(fine)))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = whole.orderBy(at[-1]).rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.sum(f"_v_{n}").over(whole).alias(f"_t_{n}") for n, r in out.items() if isinstance(r, Total)]
    prefixes = levels[-1].select(*group, at[-1], *earlier(before), *totals)
    prefixes = prefixes.withColumnsRenamed({f"_e_{n}": f"_p_{n}" for n in out})
    for k in reversed(range(LEVELS)):
        fine, coarse = at[k], at[k + 1]
        before = Window.partitionBy(*group, coarse).orderBy(fine).rowsBetween(Window.unboundedPreceding, -1)
        finer = levels[k].select(*group, fine, coarse, *earlier(before))
        prefixes = finer.join(prefixes, [*group, coarse]).select(*group, fine, *with_above())

    in_block = Window.partitionBy(*group, "_blk").orderBy(order)

    def finished(name: str, r: Running) -> Column:
        if isinstance(r, Total):
            return F.col(f"_t_{name}")
        window = in_block.rowsBetween(Window.unboundedPreceding, -1 if r.before else 0)
        v = F.col(f"_v_{name}")
        if isinstance(r, Last):
            return F.coalesce(F.last(v, ignorenulls=True).over(window), F.col(f"_p_{name}"))
        return F.coalesce(F.sum(v).over(window), F.lit(0)) + F.col(f"_p_{name}")

    return rows.join(prefixes, [*group, "_blk"]).select(
        *df.columns, *[finished(name, r).alias(name) for name, r in out.items()]
    )
