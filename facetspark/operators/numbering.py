"""Dense numbers over a whole table without a window that holds the table: range partitions, counted, and offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.operators.graph import written

#: Bits of monotonically_increasing_id that count within a partition.
WITHIN = (1 << 33) - 1


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "number", start: int = 0, partitions: int | None = None) -> DataFrame:
    """df with a column name (long): start, start + 1, ... in the order of order, nulls first unless order says otherwise.

    Rows are dealt by ranges of order, sorted within their partition and written; a partition's offset is the number of
    rows in those before it. The driver reads one count for each partition, and no task holds more than a range. Rows
    that are equal in order take their numbers in any sequence; a drawn number, behind order, deals them over several
    ranges, so that one value with a third of all rows is no hot partition.
    """
    spark = df.sparkSession
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    taken = {c.lower() for c in df.columns}
    part, at, tie = (next(n for n in (base + "_" * k for k in range(len(taken) + 1)) if n not in taken) for base in ("_part", "_at", "_tie"))
    drawn = df.withColumn(tie, F.rand(7))
    keys = [*order, F.col(tie)]
    dealt = drawn.repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    table = written(dealt.drop(tie).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit(WITHIN))))
    offsets, before = [], start
    for p, n in sorted((r[0], r[1]) for r in table.groupBy(part).count().collect()):  # a row for each partition
        offsets.append((p, before))
        before += n
    base = spark.createDataFrame(offsets, f"`{part}` int, _before long")
    out = table.join(F.broadcast(base), part)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(at) + F.col("_before")).alias(name))
