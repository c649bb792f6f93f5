"""Exact ranks without a single-task window.

``row_number() OVER (ORDER BY ...)`` with no ``PARTITION BY`` (or with a partition that holds
a third of all rows) sorts everything in one task.  ``row_numbers`` computes the same
numbers in a distributed way:

1. range-partition on the full key ``(partition cols, order cols)`` -- the sampled bounds
   split even a single huge group across many tasks -- and sort inside each partition;
2. number rows inside each partition (``monotonically_increasing_id`` carries the partition
   id in its upper bits and the position in its lower 33 bits); the numbered rows are
   checkpointed to the shared checkpoint folder so every consumer sees the same numbering,
   even after an executor is lost;
3. count rows per ``(group, partition)`` -- at most groups x partitions rows -- and turn the
   counts into offsets with a running sum per group;
4. join the offsets back: ``rank = offset + position - first position of the group + 1``.

The order columns must form a total order (end with a unique key), as every ranking here does.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlens.session import ensure_checkpoint_dir

_LOW_BITS = (1 << 33) - 1


def _window(partition: Sequence[str]):
    return Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))


def numbered_partitions(df: DataFrame, order: Sequence[Column | str],
                        partition: Sequence[str] = (), num_partitions: int | None = None
                        ) -> DataFrame:
    """Steps 1-2: range-partitioned, sorted, numbered and checkpointed rows with ``_pid``
    (range partition) and ``_idx`` (position inside it)."""
    ensure_checkpoint_dir(df.sparkSession)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [F.col(c) for c in partition] + order
    # without an explicit count, adaptive execution sizes the ranges: it only merges
    # adjacent small ranges, so every partition still holds one contiguous key range
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions
              else df.repartitionByRange(*keys))
    return (ranged.sortWithinPartitions(*keys)
            .withColumn("_mid", F.monotonically_increasing_id())
            .checkpoint(eager=True)
            .withColumn("_pid", F.shiftright("_mid", 33))
            .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))))


def with_row_numbers(numbered: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """Steps 3-4 on the output of ``numbered_partitions``: add ``_rn`` and ``_n`` (the
    ``_pid`` / ``_idx`` columns are kept for further scans)."""
    blocks = (numbered.groupBy(*partition, "_pid")
              .agg(F.count(F.lit(1)).alias("_cnt"), F.min("_idx").alias("_first")))
    w = _window(partition)
    before = F.sum("_cnt").over(w.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    blocks = (blocks.withColumn("_before", F.coalesce(before, F.lit(0)))
              .withColumn("_n", F.sum("_cnt").over(w))
              .select(*[F.col(c).alias(f"_bk{i}") for i, c in enumerate(partition)],
                      F.col("_pid").alias("_bpid"), "_first", "_before", "_n"))
    joined = numbered.join(blocks, _block_cond(partition))
    return (joined.withColumn("_rn", F.col("_before") + F.col("_idx") - F.col("_first") + 1)
            .drop("_bpid", "_first", "_before", *[f"_bk{i}" for i in range(len(partition))]))


def _block_cond(partition: Sequence[str]):
    cond = [F.col("_pid") == F.col("_bpid")] + [
        F.col(c).eqNullSafe(F.col(f"_bk{i}")) for i, c in enumerate(partition)]
    return reduce(lambda x, y: x & y, cond)


def row_numbers(df: DataFrame, order: Sequence[Column | str], partition: Sequence[str] = (),
                num_partitions: int | None = None) -> DataFrame:
    """Add ``_rn`` (1-based position in ``order`` within ``partition``) and ``_n`` (group size)."""
    numbered = numbered_partitions(df, order, partition, num_partitions)
    return with_row_numbers(numbered, partition).select(*df.columns, "_rn", "_n")


def running(numbered: DataFrame, col: str, out: str, how: str = "max",
            partition: Sequence[str] = (), reverse: bool = False) -> DataFrame:
    """Running max / min of ``col`` along the numbered order (``reverse``: from the last row
    backwards), without a window over a whole group: a window inside each range partition,
    combined with the extreme of all earlier (later) partitions from a per-partition table."""
    agg = F.max if how == "max" else F.min
    pick = F.greatest if how == "max" else F.least
    idx = F.col("_idx").desc() if reverse else F.col("_idx")
    inside = Window.partitionBy(*partition, "_pid").orderBy(idx) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = numbered.withColumn("_within", agg(col).over(inside))
    pid = F.col("_pid").desc() if reverse else F.col("_pid")
    earlier = _window(partition).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (numbered.groupBy(*partition, "_pid").agg(agg(col).alias("_bv"))
              .withColumn("_outside", agg("_bv").over(earlier))
              .select(*[F.col(c).alias(f"_bk{i}") for i, c in enumerate(partition)],
                      F.col("_pid").alias("_bpid"), "_outside"))
    j = x.join(blocks, _block_cond(partition))
    return (j.withColumn(out, pick("_outside", "_within"))
            .drop("_within", "_outside", "_bpid", *[f"_bk{i}" for i in range(len(partition))]))


def ntile_of(rn: Column | str, n: Column | str, buckets: int) -> Column:
    """SQL ``ntile(buckets)`` from a row number and the group size: the first ``n % buckets``
    tiles hold one row more than the others."""
    rn = F.col(rn) if isinstance(rn, str) else rn
    n = F.col(n) if isinstance(n, str) else n
    q = F.floor(n / buckets)
    rem = n - q * buckets
    big = rem * (q + 1)
    return (F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1)
            .otherwise(rem + F.floor((rn - big - 1) / q) + 1)).cast("int")


def ntile(df: DataFrame, order: Sequence[Column | str], buckets: int, out: str,
          partition: Sequence[str] = ()) -> DataFrame:
    r = row_numbers(df, order, partition)
    return r.withColumn(out, ntile_of("_rn", "_n", buckets)).drop("_rn", "_n")


def percent_rank(df: DataFrame, value: str, tiebreak: Sequence[str], out: str,
                 partition: Sequence[str] = ()) -> DataFrame:
    """SQL ``percent_rank() OVER ([PARTITION BY p] ORDER BY value)``: ``(rank - 1) / (n - 1)``,
    where tied values share the smallest row number of their run (NULLs tie and come first).

    The rank is the running maximum of the row numbers at which the value changes, so no rows are
    joined on a value that a third of them may share."""
    numbered = numbered_partitions(df, [value, *tiebreak], partition)
    row = F.struct(*partition, value)
    ends = numbered.groupBy("_pid").agg(F.max_by(row, "_idx").alias("_end"))
    ends = ends.select(F.col("_pid").alias("_epid"), F.lag("_end").over(_window(()).orderBy("_pid")).alias("_end"),
                       (~F.lag(F.lit(True), 1, False).over(_window(()).orderBy("_pid"))).alias("_top"))
    before = F.lag(row).over(Window.partitionBy("_pid").orderBy("_idx"))
    x = with_row_numbers(numbered, partition).withColumn("_before", before)
    x = x.join(ends, F.col("_pid") == F.col("_epid"))
    same = F.when(F.col("_idx") > 0, row.eqNullSafe(F.col("_before"))).otherwise(~F.col("_top") & row.eqNullSafe(F.col("_end")))
    x = x.withColumn("_start", F.when(~same, F.col("_rn"))).drop("_before", "_end", "_top", "_epid")
    j = running(x, "_start", "_rank", "max", partition)
    pr = F.when(F.col("_n") <= 1, F.lit(0.0)).otherwise(
        (F.col("_rank") - 1).cast("double") / (F.col("_n") - 1))
    return j.withColumn(out, pr).select(*df.columns, out)
