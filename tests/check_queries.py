"""Command line: check_queries.py <data dir> [name part ...] compares queries with their SQL."""

import os
import sys
import time

sys.path[:0] = [__file__.rsplit("/", 2)[0], __file__.rsplit("/", 1)[0]]

from compare import connect, differences  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main(d, *parts):
    builder = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    bad = 0
    sql = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, d)
            if name in sql:
                problem = differences(df, con, sql[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed = problem is not None
        bad += failed
        if os.environ.get("COUNTS"):
            problem = f"{problem or ''} rows={df.count()}"
        print(f"{'BAD' if failed else 'ok '} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
