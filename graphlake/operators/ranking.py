"""Row numbers over a global order without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import names
from ..session import cut

#: Rows that a task of a ranking takes at least, and the most tasks used.
ROWS_PER_TASK, MAX_TASKS = 50_000, 20_000


def number_rows(df: DataFrame, order: list[Column], name: str, tasks: int | None = None) -> DataFrame:
    """Adds `name`: the row's place (from 0) in the given order.

    Rows are range-partitioned by the order and sorted within; what stands before a partition is a sum over one row
    per partition. Rows equal in all order columns are in one partition and numbered in any order. The bounds of
    range partitions come from a sample that isn't the same each time, so the sorted rows are checkpointed: numbers
    stay what they are whatever is computed again.
    """
    tasks = tasks or _tasks(df)
    low = (1 << 33) - 1
    at, part, row, size, start = map(names.hidden, ("at", "in", "row", "size", "start"))
    placed = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = cut(placed).withColumn(part, F.shiftright(at, 33)).withColumn(row, F.col(at).bitwiseAND(F.lit(low)))
    sizes = placed.groupBy(part).agg((F.max(row) + 1).alias(size))
    before = F.coalesce(F.sum(size).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    starts = sizes.select(part, before.alias(start))
    return placed.join(F.broadcast(starts), part).withColumn(name, (F.col(start) + F.col(row)).cast("long")).drop(at, part, row, start)


def _tasks(df: DataFrame) -> int:
    """Partitions by what the plan knows of the input's size, else the session's number."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # statistics are a hint; plans without any use the session's number
        return conf
    return max(1, min(conf, MAX_TASKS, -(-size // (ROWS_PER_TASK * 64))))


def number_within(df: DataFrame, group: list[Column], order: list[Column], name: str) -> DataFrame:
    """Adds `name`: the row's place (from 0) in the order within its group; large groups span many tasks.

    A group's first place is a minimum over its rows, joined back; there are as many as groups.
    """
    keys, place, least = [names.hidden(f"g{i}") for i in range(len(group))], names.hidden("place"), names.hidden("first")
    named = df.withColumns(dict(zip(keys, group, strict=True)))
    ranked = number_rows(named, [*(F.col(k) for k in keys), *order], place)  # checkpointed, so both uses agree
    first = ranked.groupBy(*(F.col(k).alias(f"{k}f") for k in keys)).agg(F.min(place).alias(least))
    same = [F.col(k).eqNullSafe(F.col(f"{k}f")) for k in keys]
    return ranked.join(first, same).withColumn(name, F.col(place) - F.col(least)).drop(place, least, *keys, *(f"{k}f" for k in keys))
