"""How many tasks rows are dealt to, so that a task's memory doesn't grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task; twice that are some hundreds of megabytes in a sort or a hash table.
TASK_ROWS = 500_000


def tasks_for(rows: DataFrame, n_rows: int) -> int:
    """The session's number of partitions, or more where there are more rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // TASK_ROWS))


def dealt(rows: DataFrame, n_rows: int, *keys: str, fixed: bool = False) -> DataFrame:
    """Rows by hash of ``keys``.

    The number of partitions is left to Spark, which may merge them, only where one task could
    hold all rows, unless it is to be ``fixed``. Spark merges by bytes in the shuffle, where these
    rows take some fifteen each: millions of them would make one task, however many partitions the session has.
    """
    return rows.repartition(tasks_for(rows, n_rows), *keys) if fixed or n_rows > TASK_ROWS else rows.repartition(*keys)
