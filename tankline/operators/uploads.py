"""Upload bookkeeping: duplicates, prerequisites, waiting work.

An upload row: id, organization, status, filename, size, type, file_hash. Statuses go created ->
pending -> completed or error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPLOAD_TYPES = ("raw", "auto")
SAME_FILE = ["filename", "size", "type", "file_hash"]

# Media type by file extension.
MEDIA_TYPES = {
    "csv": "text/csv",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


def file_kind(path: Column) -> Column:
    """File extension in lower case."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_type(path: Column) -> Column:
    kind = file_kind(path)
    col = F
    for ext, label in MEDIA_TYPES.items():
        col = col.when(kind == ext, F.lit(label))
    return col.otherwise(F.lit(None).cast("string"))


def split_by_type(files: DataFrame, allowed=UPLOAD_TYPES) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): a known upload type and a known file extension."""
    good = F.col("type").isin(*allowed) & file_kind(F.col("filename")).isin(*MEDIA_TYPES)
    good = F.coalesce(good, F.lit(False))
    return files.filter(good), files.filter(~good)


def new_uploads(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """Candidates that were not processed before: no completed upload has the same name, size, type
    and hash. A failed or unfinished one may be tried again.

    Completed uploads are reduced to their distinct keys first. A key shared by very many candidates
    meets one partner row, which lets AQE split it.
    """
    done = manifest.filter(F.col("status") == "completed").select(*SAME_FILE).distinct()
    return candidates.join(done, SAME_FILE, "left_anti")


def register_uploads(candidates: DataFrame, manifest: DataFrame, org: str | Column) -> DataFrame:
    """Manifest rows for the new uploads, all with status created."""
    org = F.lit(org) if isinstance(org, str) else org
    fresh = new_uploads(candidates, manifest)
    return fresh.select(
        "id",
        org.alias("organization"),
        F.lit("created").alias("status"),
        media_type(F.col("filename")).alias("media_type"),
        *SAME_FILE,
    )


def has_completed(uploads: DataFrame, kind: str) -> DataFrame:
    """Tenants with at least one completed upload of this type."""
    done = uploads.filter((F.col("type") == kind) & (F.col("status") == "completed"))
    return done.select("organization").distinct()


def ready(df: DataFrame, uploads: DataFrame, *kinds: str) -> DataFrame:
    """Rows whose tenant has completed an upload of every type in ``kinds``."""
    for kind in kinds:
        df = df.join(has_completed(uploads, kind), "organization", "left_semi")
    return df


def pending_uploads(uploads: DataFrame) -> DataFrame:
    """Per tenant the waiting raw upload that is next (greatest id), if vehicles and norms are in."""
    waiting = uploads.filter(
        (F.col("type") == "raw")
        & (F.col("status") == "created")
        & ~F.col("status").isin("completed", "error")
    )
    rest = [c for c in uploads.columns if c != "organization"]
    first = waiting.groupBy("organization").agg(F.max_by(F.struct(*rest), "id").alias("_row"))
    first = first.select("organization", "_row.*")
    return ready(first, uploads, "auto", "norm")


def advance(uploads: DataFrame, cond: Column, status: str) -> DataFrame:
    """Move matching uploads to ``status``, only along created -> pending -> completed or error."""
    came_from = {"pending": ["created"], "completed": ["created", "pending"], "error": ["created", "pending"]}
    if status not in came_from:
        raise ValueError(f"unknown status {status!r}")
    from .upsert import update_where

    return update_where(uploads, cond & F.col("status").isin(*came_from[status]), status=status)


def run_ready(uploads: DataFrame, process, needs: tuple[str, ...] = ("auto", "norm"), failures: tuple = (Exception,)) -> DataFrame:
    """Process the next waiting raw upload of every tenant, one after the other, and keep its status.

    An upload whose tenant has not completed the types it ``needs`` stays as it is. The others go to
    pending, then ``process(upload id)`` runs, and they are completed, or in error if it raises one of
    ``failures``; the rest goes on. The driver sees the ids of these uploads: one for each tenant.
    """
    waiting = uploads.filter((F.col("type") == "raw") & (F.col("status") == "created"))
    first = waiting.groupBy("organization").agg(F.max("id").alias("id"))
    ids = sorted(r.id for r in ready(first, uploads, *needs).toLocalIterator())
    now = advance(uploads, F.col("id").isin(ids), "pending")
    failed = []
    for one in ids:
        try:
            process(one)
        except failures:
            failed.append(one)
    now = advance(now, F.col("id").isin(failed), "error")
    return advance(now, F.col("id").isin(ids), "completed")


# ---- status as events ---------------------------------------------------------------------------

# How far a status is along created -> pending -> completed or error.
STEPS = {"created": 0, "pending": 1, "completed": 2, "error": 2}


def status_events(ids: DataFrame, status: str | Column, load_seq: int, reason: Column | None = None) -> DataFrame:
    """(id, status, reason, load_seq): one step of every upload in ``ids``."""
    status = F.lit(status) if isinstance(status, str) else status
    return ids.select("id", status.alias("status"), (F.lit(None) if reason is None else reason).cast("string").alias("reason"), F.lit(load_seq).cast("long").alias("load_seq"))


def folded(uploads: DataFrame, events: DataFrame) -> DataFrame:
    """``uploads`` with the status that the events lead to, and the ``reason`` of an error.

    Events of an upload may come in any order, and twice. The furthest step counts, of two final ones the
    first (least load_seq, completed before error); a status never goes back. Combines map-side.
    """
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in STEPS.items() for x in pair)), F.col("status"))
    own = uploads.select("id", F.col("status"), F.lit(None).cast("string").alias("reason"), F.lit(-1).cast("long").alias("load_seq"))
    both = own.unionByName(events.select("id", "status", "reason", "load_seq"))
    first = F.struct(rank.alias("step"), (-F.col("load_seq")).alias("early"), (F.col("status") == "completed").alias("done"))
    now = both.groupBy("id").agg(F.max_by(F.struct("status", "reason"), first).alias("_now"))
    return uploads.drop("status").join(now, "id").select(*[c if c != "status" else F.col("_now.status").alias("status") for c in uploads.columns], F.col("_now.reason").alias("reason"))
