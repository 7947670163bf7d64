"""Work on small inputs that lie in fewer files than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Inputs of more bytes are left as they lie: their files split well enough, and moving them would cost a shuffle.
SMALL = 256 << 20


def spread(rows: DataFrame) -> DataFrame:
    """A small table from few files dealt over all cores, before costly work on each row; any other table as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if not 0 < len(rows.inputFiles()) < cores:
        return rows
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if 1 << 20 < size <= SMALL else rows


#: Bytes of input, as the plan estimates them, that one partition of a dealt table should hold about.
PART = 1 << 20


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """A table dealt by a key over as many partitions as its size asks for, at least the session's shuffle partitions, before several joins by that key; a small one as it is.

    Adaptive execution joins partitions by their packed size, and keys and states pack so well that one task would sort many millions of rows, in each join anew."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size <= 8 * PART or size >= 1 << 60:  # the latter: unknown
        return rows
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 14, -(-size // PART))), key)
