"""Tables in key order: directories of key ranges, and the first key of each as a list for the driver.

A look-up finds the directories by bisection and reads no other. A range holds a task's worth of rows, so the list has
one entry for some hundred megabytes of the table.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (number of a range, its first key), in order of the keys.
Ranges = list[list]
#: A key interval, both ends included.
Interval = tuple[str, str]


def write_ordered(rows: DataFrame, key: str, path: str) -> Ranges:
    """Write ``rows`` in order of ``key`` (a string without nulls) and return where each range begins."""
    placed = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("range", F.spark_partition_id())
    placed.write.mode("overwrite").partitionBy("range").parquet(path)
    schema = f"{key} string, range int"
    first = rows.sparkSession.read.schema(schema).parquet(path).groupBy("range").agg(F.min(key).alias("first"))
    return sorted(([r["range"], r["first"]] for r in first.collect()), key=lambda r: r[1])


def met(ranges: Ranges, intervals: list[Interval]) -> list[int]:
    """Numbers of the ranges that may hold a key of some interval."""
    firsts = [first for _, first in ranges]
    found = set()
    for low, high in intervals:
        # a key may end one range and begin the next
        start, stop = max(0, bisect_left(firsts, low) - 1), bisect_right(firsts, high)
        found.update(number for number, _ in ranges[start:stop])
    return sorted(found)


def within(table: DataFrame, directory: dict[str, Ranges], intervals: list[Interval]) -> DataFrame:
    """Rows of the ranges that meet the intervals; ``directory`` has the ranges of each part of the table."""
    tests = [
        (F.col("part") == part) & F.col("range").isin(numbers)
        for part, ranges in directory.items()
        if (numbers := met(ranges, intervals))
    ]
    return table.filter(reduce(Column.__or__, tests, F.lit(False)))


def beneath(prefix: str) -> list[Interval]:
    """A folder's own key, and all keys below it."""
    return [(prefix, prefix), (prefix + "/", prefix + chr(ord("/") + 1))]
