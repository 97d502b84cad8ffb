"""Events as structured JSON lines, with secrets taken out before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.provider import scrub


def log_lines(events: DataFrame, *, time: Column, level: Column, event: Column, request_id: Column, fields: Column) -> DataFrame:
    """One column ``value`` with a JSON object for each row; ``fields`` is a map of strings."""
    row = F.struct(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), level.alias("level"), event.alias("event"), request_id.alias("request_id"), scrub(fields).alias("fields"))
    return events.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def write_log(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)
