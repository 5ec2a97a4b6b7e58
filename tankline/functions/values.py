"""Small column expressions shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(col: Column) -> Column:
    """A missing number is NULL everywhere: Spark sorts NaN above all values, which would flag it."""
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def clock(ts: Column) -> Column:
    """Wall-clock time to the second as text. date_format would take it through the session zone,
    which changes times that a clock change leaves out."""
    return F.substring(ts.cast("timestamp_ntz").cast("string"), 1, 19)


def mask_tail(col: Column, keep: int = 4, default: str = "Не указан") -> Column:
    """Hide all but the last ``keep`` characters; an absent or empty value gives ``default``."""
    shown = F.concat(F.lit("****"), F.right(col, F.lit(keep)))
    return F.when(F.length(col) > 0, shown).otherwise(F.lit(default))


def car_label(make: str, model: str, vin: str, plate: str) -> Column:
    """Display name: make, model and VIN spaced, the plate glued to the VIN."""
    part = [F.coalesce(F.col(c), F.lit("")) for c in (make, model, vin, plate)]
    return F.concat(part[0], F.lit(" "), part[1], F.lit(" "), part[2], part[3])


def trimmed(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit(""))


def split_terms(text: str) -> list[str]:
    """Search terms: split at blanks and commas, quotes keep a phrase together."""
    found = re.findall(r'"([^"]+)"|\'([^\']+)\'|([^\s,]+)', text or "")
    return [a or b or c for a, b, c in found]


def matches(fields: list[Column], text: str) -> Column:
    """Every term must occur, ignoring case, in at least one of ``fields``."""
    cond = F.lit(True)
    for term in split_terms(text):
        hit = F.lit(False)
        for f in fields:
            found = F.contains(F.lower(f.cast("string")), F.lit(term.lower()))
            hit = hit | F.coalesce(found, F.lit(False))
        cond = cond & hit
    return cond


def require_columns(df: DataFrame, wanted) -> list[str]:
    """Names in ``wanted`` that ``df`` lacks, in the order given."""
    have = set(df.columns)
    return [c for c in wanted if c not in have]


def need(df: DataFrame, wanted) -> DataFrame:
    missing = require_columns(df, wanted)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
