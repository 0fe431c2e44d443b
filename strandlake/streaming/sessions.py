"""Coordinate sessions as session windows, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coordinate_sessions(anchors: DataFrame, start: str, key: list[str], gap: int, late: int | None = None) -> DataFrame:
    """Stretches of anchors whose starts are at most `gap` apart: key, from, to, anchors.

    Coordinates become seconds, so the session window of Structured Streaming applies. Windows that only
    touch are joined too, so a window lasts half a second over the gap. `late` sets a watermark for a
    stream whose anchors come in rough order.
    """
    timed = anchors.withColumn("_ts", F.timestamp_seconds(F.col(start)))
    if late is not None:
        timed = timed.withWatermark("_ts", f"{late} seconds")
    window = F.session_window("_ts", f"{gap * 1000 + 500} milliseconds")
    out = timed.groupBy(*key, window.alias("w")).agg(F.count(F.lit(1)).alias("anchors"))
    return out.select(*key, F.unix_seconds("w.start").alias("from"), (F.unix_seconds("w.end") - gap + 1).alias("to"), "anchors")
