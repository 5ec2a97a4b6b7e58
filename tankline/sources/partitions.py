"""Partitioned tables that are written over partition by partition."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# The characters that partition folders hold as a percent sign and two digits.
_ESCAPED = re.compile(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def folder(key: str, value) -> str:
    """Folder of a partition, with the value written as Spark's reader undoes it."""
    text = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", "" if value is None else str(value))
    return f"{key}={text or '__HIVE_DEFAULT_PARTITION__'}"


def write_partitions(
    df: DataFrame,
    path: str,
    by: list[str],
    fixed: dict | None = None,
    mode: str = "overwrite",
    sort: tuple[str, ...] = (),
) -> None:
    """Write ``df`` partitioned by ``by``, replacing the partitions it touches (``mode="append"``
    adds to them). Where all rows share the ``fixed`` partition values that one partition is
    replaced as a whole, also by nothing. Rows are ordered by ``sort`` inside each file."""
    fixed = fixed or {}
    if [*fixed] == by:
        path = "/".join([path, *[folder(k, v) for k, v in fixed.items()]])
        one = df.sortWithinPartitions(*sort) if sort else df
        one.drop(*by).write.mode(mode).parquet(path)
        return
    # Rebalancing gathers each partition's rows into few files and, under AQE, splits a partition
    # that is far bigger than the others instead of leaving it to one task.
    writer = df.hint("rebalance", *by).sortWithinPartitions(*by, *sort).write.partitionBy(*by).mode(mode)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
