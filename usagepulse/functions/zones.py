"""The day of a point in time, in a stated zone whatever the session's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "UTC"


def day_of(frame: DataFrame, name: str, zone: str = ZONE) -> Column:
    """Date of column ``name``. Only points in time (``timestamp``) have a zone to choose;
    dates, zone-free timestamps and text name their day themselves."""
    if frame.schema[name].dataType.typeName() != "timestamp":
        return F.to_date(name)
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(name), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))
