"""Timestamp parameters and their text form."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType


def normalise_iso(value: str | datetime | None) -> str | None:
    """Checked ISO-8601 text of a parameter; blank means no bound."""
    if value is None:
        return None
    if isinstance(value, datetime):
        return value.isoformat()
    text = value.strip()
    if not text:
        return None
    if text.endswith("Z"):
        text = text.removesuffix("Z") + "+00:00"
    try:
        datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"not an ISO timestamp: {value!r}") from None
    return text


def iso_timestamp(col: Column) -> Column:
    """Column form: NULL for blank, failure for text that is no timestamp."""
    text = F.trim(col)
    parsed = text.try_cast("timestamp")
    bad = (text != "") & parsed.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("not an ISO timestamp: "), text)).cast("timestamp")) \
        .otherwise(parsed)


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def within(messages: DataFrame, date_from: str | None, date_to: str | None) -> list[Column]:
    """Inclusive bounds on ``ts``; a date-only upper bound means its midnight.

    The literal takes the column's own type, so the comparison reaches the scan.
    """
    kind = messages.schema["ts"].dataType

    def bound(text: str) -> Column:
        moment = datetime.fromisoformat(text)
        if moment.tzinfo is not None:
            moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
        zone = "" if isinstance(kind, TimestampNTZType) else "Z"
        return F.lit(moment.isoformat(sep=" ") + zone).cast(kind)

    lower = [F.col("ts") >= bound(date_from)] if date_from is not None else []
    upper = [F.col("ts") <= bound(date_to)] if date_to is not None else []
    return lower + upper
