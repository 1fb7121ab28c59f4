"""Top-k per group and global numbering without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusqa.session import materialise


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their 0-based rank.

    Spark limits each group inside every task before the shuffle, so a group that holds a large
    share of the rows sends at most ``k`` of them per task.
    """
    numbered = df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return numbered.where(F.col(rank) <= k).withColumn(rank, F.col(rank) - 1)


def number_rows(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "row_no") -> DataFrame:
    """0-based position of each row in ``order``, per ``group`` if one is given.

    A range-partitioned sort plus the row counts of the partitions before: no group, not even the
    whole table, has to pass through one task. The sorted table is written once, so that both uses
    of it see the same partitions even if an executor is lost in between.
    """
    keys = [*group, *order]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # numbers run on inside a partition, where the rows of a group lie side by side
    place, piece = f"{name}_place", f"{name}_piece"
    marked = ordered.withColumn(place, F.monotonically_increasing_id()).withColumn(piece, F.spark_partition_id())
    marked = materialise(marked, "numbered")
    # a row per (partition, group) that meet; the running sum of a group walks over its partitions
    sizes = marked.groupBy(piece, *group).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    before = W.partitionBy(*group).orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(piece, *group, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    offsets = materialise(offsets, "offsets")
    return marked.join(offsets, [piece, *group]).withColumn(name, F.col(place) + F.col("shift")).drop(place, piece, "shift")
