"""The time of a run, passed in as text or column so that results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def moment(value: str | Column | None) -> Column:
    """A timestamp column; the current time when none is given."""
    if value is None:
        return F.current_timestamp()
    return (F.lit(value) if isinstance(value, str) else value).cast("timestamp")
