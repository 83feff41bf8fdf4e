"""Ordered per-key computations cut into time slices.

A plain window over a key puts all rows of that key into one task, so a key
that holds a third of the table would stall the job. The helpers here give the
same result from windows over (key, time slice):

* ``lag_within`` copies the rows near the end of a slice into the slices they
  can still influence. One shuffle; exact whenever the caller only uses a
  previous row that is at most ``horizon`` older.
* ``running_sum`` and ``carry_last`` have no such bound. They work in three
  levels: inside each slice, over the summaries of a block of ``BLOCK`` slices,
  and over one row per (key, block). A history of n slices thus has no window of
  more than ``BLOCK`` or n / ``BLOCK`` summaries.

Key columns must not be NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions.timegrid import grid_index

SLICES_PER_HORIZON = 8
BLOCK = 4096


def default_width(horizon: int) -> int:
    """At most an eighth of the rows is copied once."""
    return max(1, SLICES_PER_HORIZON * int(horizon))


def with_halo(df: DataFrame, time_col: str, horizon: int, width: int | None = None) -> DataFrame:
    """Add ``_own`` (the row's slice) and ``_slice`` (each slice it is copied to)."""
    width = width or default_width(horizon)
    t = F.col(time_col)
    return df.withColumn("_own", grid_index(t, width)).withColumn(
        "_slice", F.explode(F.sequence(F.col("_own"), grid_index(t + F.lit(int(horizon)), width)))
    )


def lag_within(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    ties: Sequence[str],
    values: dict[str, str],
    horizon: int,
    width: int | None = None,
) -> DataFrame:
    """Previous row of the key as ``{output: input column}``.

    The output is the true previous row if that row is within ``horizon``;
    otherwise it is NULL or an older row, so test the distance before use.
    """
    window = W.partitionBy(*keys, "_slice").orderBy(time_col, *ties)
    out = with_halo(df, time_col, horizon, width)
    for name, source in values.items():
        out = out.withColumn(name, F.lag(source).over(window))
    return out.where(F.col("_slice") == F.col("_own")).drop("_slice", "_own")


def _slice_join(inside: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    return inside.join(summary, [*keys, "_slice"], "left")


def _earlier(
    summary: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    over: Callable[[str], Column],
    whole: Column,
    join: Callable[[Column, Column], Column],
) -> DataFrame:
    """(keys, _slice, out): what the slices before each slice of its key come to.

    ``over`` folds a column over a window, ``whole`` folds ``value`` over a
    block, ``join`` puts together the fold of the block's earlier slices and
    that of the earlier blocks.
    """
    blocked = summary.withColumn("_block", grid_index(F.col("_slice"), BLOCK))
    ahead = (W.unboundedPreceding, -1)
    near = over(value).over(W.partitionBy(*keys, "_block").orderBy("_slice").rowsBetween(*ahead))
    far = over("_whole").over(W.partitionBy(*keys).orderBy("_block").rowsBetween(*ahead))
    blocks = blocked.groupBy(*keys, "_block").agg(whole.alias("_whole")).select(*keys, "_block", far.alias("_far"))
    joined = blocked.withColumn("_near", near).join(blocks, [*keys, "_block"], "left")
    return joined.select(*keys, "_slice", join(F.col("_near"), F.col("_far")).alias(out))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    ties: Sequence[str],
    value: Column | str,
    out: str,
    width: int,
    kind: str = "bigint",
) -> DataFrame:
    """Sum of ``value`` over the key's rows up to and including this one."""
    value = F.col(value) if isinstance(value, str) else value
    sliced = df.withColumn("_slice", grid_index(F.col(time_col), width)).withColumn("_v", value)
    inside = sliced.withColumn(
        "_in",
        F.sum("_v").over(
            W.partitionBy(*keys, "_slice")
            .orderBy(time_col, *ties)
            .rowsBetween(W.unboundedPreceding, W.currentRow)
        ),
    )
    summary = _earlier(
        sliced.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_total")), keys, "_total", "_base",
        F.sum, F.sum("_total"), lambda near, far: F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0)),
    )
    total = F.coalesce(F.col("_base"), F.lit(0)) + F.coalesce(F.col("_in"), F.lit(0))
    return (
        _slice_join(inside, summary, keys)
        .withColumn(out, total.cast(kind))
        .drop("_slice", "_v", "_in", "_base")
    )


def next_value(
    df: DataFrame, keys: Sequence[str], time_col: str, value: str, out: str, width: int
) -> DataFrame:
    """``value`` of the key's next row; rows of a key must differ in time."""
    turned = df.withColumn("_back", -F.col(time_col))
    return carry_last(turned, keys, "_back", [], value, out, width, include_current=False).drop("_back")


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    ties: Sequence[str],
    value: Column | str,
    out: str,
    width: int,
    include_current: bool = True,
) -> DataFrame:
    """Newest non-NULL ``value`` of the key at, or only before, this row."""
    value = F.col(value) if isinstance(value, str) else value
    sliced = df.withColumn("_slice", grid_index(F.col(time_col), width)).withColumn("_v", value)
    last_row = W.currentRow if include_current else -1
    inside = sliced.withColumn(
        "_in",
        F.last("_v", ignorenulls=True).over(
            W.partitionBy(*keys, "_slice")
            .orderBy(time_col, *ties)
            .rowsBetween(W.unboundedPreceding, last_row)
        ),
    )
    order = F.when(F.col("_v").isNotNull(), F.struct(time_col, *ties))
    summary = _earlier(
        sliced.groupBy(*keys, "_slice").agg(F.max_by("_v", order).alias("_end")), keys, "_end", "_carry",
        lambda c: F.last(c, ignorenulls=True),
        F.max_by("_end", F.when(F.col("_end").isNotNull(), F.col("_slice"))),
        F.coalesce,
    )
    return (
        _slice_join(inside, summary, keys)
        .withColumn(out, F.coalesce("_in", "_carry"))
        .drop("_slice", "_v", "_in", "_carry")
    )
