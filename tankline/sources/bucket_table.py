"""Keyed tables in buckets: a merge reads and writes the buckets of the changed keys, and nothing else.

The rows of a table lie in folders ``bucket=…`` by a hash of the key. A change brings its own rows; the
buckets their keys fall in are read, merged by any function that works key by key (``upsert_cars``,
``upsert``, ``update_where``, a delete) and written over. The merged rows are written aside first, so a
merge that stops leaves the old buckets, and one that is done again gives the same. One job at a time
may merge into a table.

The driver sees the numbers of the touched buckets, at most ``buckets``; these are a condition on folders,
so the scan lists no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metric_store import has_path, remove_path
from .partitions import write_partitions
from .scratch import written_once

BUCKETS = 64


class BucketTable:
    """A table at ``path`` with the columns of ``schema``. ``buckets`` is fixed for the life of the table."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names).withColumn("bucket", self._bucket(F.col(self.key)))

    def create(self, rows: DataFrame) -> None:
        write_partitions(self._placed(rows), self.path, ["bucket"], sort=(self.key,))

    def _all(self) -> DataFrame:
        kinds = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(kinds).parquet(self.path) if has_path(self.spark, self.path) else self.spark.createDataFrame([], kinds)

    def read(self) -> DataFrame:
        return self._all().drop("bucket")

    def find(self, *keys) -> DataFrame:
        """The rows of some keys, from their buckets."""
        here = self._all()
        wanted = [F.lit(k).cast(self.schema[self.key].dataType) for k in keys]
        return here.filter(F.col("bucket").isin(*(self._bucket(k) for k in wanted)) & F.col(self.key).isin(*wanted)).drop("bucket")

    def merge(self, changes: DataFrame, by: str, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Put ``merged(rows of the touched buckets, changes)`` in place of these rows; returns the buckets.

        ``by`` is the column of ``changes`` that holds the key. ``merged`` gives rows of the touched buckets
        only: a key it adds must be one that ``changes`` names.
        """
        changes = written_once(changes, "changes")
        touched = sorted(r[0] for r in changes.select(self._bucket(F.col(by))).distinct().toLocalIterator())
        if not touched:
            return []
        old = self._all().filter(F.col("bucket").isin(touched)).drop("bucket")
        new = written_once(self._placed(merged(old, changes)), "merged")
        astray = new.filter(~F.col("bucket").isin(touched)).limit(1).count()
        if astray:
            raise ValueError("the merge gave a key that the changes do not name")
        write_partitions(new, self.path, ["bucket"], sort=(self.key,))
        left = {r[0] for r in new.select("bucket").distinct().toLocalIterator()}
        for bucket in set(touched) - left:
            remove_path(self.spark, f"{self.path}/bucket={bucket}")
        return touched
