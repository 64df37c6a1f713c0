"""How rows lie in partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out if it lies in fewer files than there are cores, for work that is heavy row by row.

    A file's row group is read by one task, so a table of one file would keep one core busy. Tables of many files, all
    large ones among them, aren't shuffled. What was made in memory has no files and stays as it is.
    """
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    return df.repartition(cores) if 0 < files < cores else df
