"""Line de-duplication over levelled sorted runs of line hashes.

Batches of documents arrive one after the other. A batch becomes a run: its line keys (128 bits of
hash) with the number of documents they are in, sorted. The keys of the new batch are merged against
the runs and those that are already frequent (seen in ``min_docs`` documents) are left out by an
anti-join, as nothing more has to be known about them; the rest is added as a run of its own. When a
level holds ``fan`` runs they are compacted into one run of the next level, counts added up. In the
end the runs are folded once more and every line whose key is frequent goes from every document.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z in lower case; empty keys are
never frequent. NULL and empty texts are one empty line. Every row is a document, also where ids
repeat or are NULL. Other columns are not looked at. An empty table gives no rows.

A very long text is split by one task; lines that share a key, of any number, are counted once for each document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, row_key, saved

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashed(line: Column) -> Column:
    """128 bits of a line's key; NULL for an empty one."""
    return let(line_key(line), lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))


class LineRuns:
    """The levelled store of line counts."""

    def __init__(self, min_docs: int, fan: int = 3):
        self.min_docs, self.fan = min_docs, fan
        self.levels: list[list[DataFrame]] = [[]]

    def _all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _fold(self, runs: list[DataFrame]) -> DataFrame:
        if len(runs) == 1:
            return runs[0]
        return reduce(DataFrame.unionByName, runs).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        return self._fold(self._all()).filter(F.col("n") >= self.min_docs).select("h1", "h2")

    def add(self, batch: DataFrame) -> None:
        """Merge a batch (h1, h2, n) against the runs and add what is not yet frequent as a run."""
        known = [run.filter(F.col("n") >= self.min_docs).select("h1", "h2") for run in self._all()]
        for run in known:
            batch = batch.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        self._put(0, batch)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(saved(run.sortWithinPartitions("h1", "h2"), f"run{level}"))
        if len(self.levels[level]) >= self.fan:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._fold(runs))


def line_batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """Line keys with their document counts, by batch; one pass over the texts for all batches."""
    rows = plain(docs, "doc_id", "text").select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch"),
        F.explode(F.array_distinct(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), _hashed), lambda x: x.isNotNull()))).alias("k"),
    )
    counts = rows.groupBy("batch", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.count("*").alias("n"))
    stored = saved(counts, "line-batches", ["batch"])
    return [stored.filter(F.col("batch") == b).select("h1", "h2", "n") for b in range(batches)]


def frequent_lines(docs: DataFrame, *, min_docs: int = 10, batches: int = 4, fan: int = 3) -> DataFrame:
    """Keys (h1, h2) of the lines found in at least ``min_docs`` documents."""
    runs = LineRuns(min_docs, fan)
    for batch in line_batches(docs, batches):
        runs.add(batch)
    return runs.frequent()


def line_drops(docs: DataFrame, *, min_docs: int = 10, batches: int = 4, fan: int = 3) -> DataFrame:
    """(row_id, drop): for rows that hold frequent lines, by ``row_key``, the places of these lines."""
    frequent = saved(frequent_lines(docs, min_docs=min_docs, batches=batches, fan=fan), "frequent-lines")
    rows = plain(docs, "doc_id", "text").select(row_key().alias("row_id"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    lines = rows.select("row_id", F.posexplode(F.transform("lines", _hashed)).alias("at", "k")).filter("k is not null")
    found = lines.select("row_id", "at", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).join(frequent, ["h1", "h2"], "left_semi")
    return found.groupBy("row_id").agg(F.collect_set("at").alias("drop"))


def without_lines(text: Column, drop: Column) -> Column:
    """The text without the lines at these places; as it is where they are NULL."""
    kept = let(
        F.split(text, "\n"),
        lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), drop), lambda i: F.get(ls, i)), "\n"),
    )
    return F.when(drop.isNull(), text).otherwise(kept)


def drop_frequent_lines(docs: DataFrame, **options) -> DataFrame:
    """Per row: row_id, doc_id, text (cleaned), n_lines, n_dropped. Rows equal in id and text share a row_id."""
    rows = plain(docs, "doc_id", "text").select(row_key().alias("row_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(line_drops(docs, **options), "row_id", "left").select(
        "row_id", "doc_id",
        without_lines(F.col("text"), F.col("drop")).alias("text"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_digests(docs: DataFrame, *, min_docs: int = 10) -> DataFrame:
    out = drop_frequent_lines(docs, min_docs=min_docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
