"""Incremental insert: a stream of vectors into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.table import VectorTable


def insert_stream(stream: DataFrame, table: VectorTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Inserts each micro-batch of (rowid, vector) rows.

    The number of the last batch is committed with its rows, so a batch that is delivered
    again after a failure is not inserted twice; ids that are there already are skipped.
    """

    def batch(rows: DataFrame, number: int) -> None:
        table.refresh()
        if table.manifest.get("batch", -1) >= number:
            return
        fresh = rows.dropDuplicates(["rowid"]).join(table.stored().select("rowid"), "rowid", "left_anti") if "rowid" in rows.columns else rows
        table.begin()
        try:
            if not fresh.isEmpty():
                table.insert(fresh)
            table.state["batch"] = number
        except BaseException:
            table.rollback()
            raise
        table.commit()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per tumbling window and keys, with a watermark; works on streams and tables alike."""
    window = F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")
