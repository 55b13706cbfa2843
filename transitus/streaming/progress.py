"""Progress accounting: what each batch of a stream read, and how many rows came too late for its watermark."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PROGRESS = "query string, run string, batch bigint, input_rows bigint, dropped_rows bigint, state_rows bigint, watermark string"
# Seconds between two looks at a running query; it remembers its last hundred batches.
LOOK = 2


def progress_rows(query: StreamingQuery, name: str, after: int = -1) -> list[tuple]:
    """Rows of `PROGRESS` for the batches with a number above `after` that the query still remembers.

    `dropped_rows` is what all state operators of the query refused because it lay behind the watermark. An operator
    counts what reaches it: events for clocks, joins and deduplication; groups of a task for an aggregate, which
    are summed up before it sees them.
    """
    rows = []
    for told in query.recentProgress:
        if told["batchId"] > after:
            states = told["stateOperators"]
            rows.append((
                name, str(told["runId"]), told["batchId"], told["numInputRows"], sum(s["numRowsDroppedByWatermark"] for s in states),
                sum(s["numRowsTotal"] for s in states), (told.get("eventTime") or {}).get("watermark"),
            ))
    # a batch without data may be told several times while the query waits
    return sorted({row[2]: row for row in rows}.values(), key=lambda row: row[2])


def batches(query: StreamingQuery, name: str, look: float = LOOK) -> Iterator[list[tuple]]:
    """The progress of a query while it runs, in lots; a gap in the batches is an error, not a silent loss."""
    last = None
    done = False
    while not done:
        done = query.awaitTermination(look)
        fresh = progress_rows(query, name, -1 if last is None else last)
        if not fresh:
            continue
        if last is not None and fresh[0][2] != last + 1:
            raise RuntimeError(f"{name}: progress of batches {last + 1} to {fresh[0][2] - 1} was missed")
        last = fresh[-1][2]
        yield fresh


def record(query: StreamingQuery, name: str, path: str, look: float = LOOK) -> None:
    """Append the progress of `query` to a table, lot by lot, until it ends; one row per batch, counted by the driver."""
    spark = SparkSession.active()
    for lot in batches(query, name, look):
        spark.createDataFrame(lot, PROGRESS).coalesce(1).write.mode("append").parquet(path)


def run_recorded(df: DataFrame, name: str, out: str, checkpoint: str, progress: str) -> None:
    """`jobs.run_available` with the progress of its batches appended to the table `progress`."""
    query = (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    record(query, name, progress)


def late_report(progress: DataFrame) -> DataFrame:
    """Per query: batches with input, rows read and rows dropped behind the watermark.

    A batch that was run again after a failure is counted once, by its last run.
    """
    last = progress.groupBy("query", "batch").agg(F.max_by(F.struct("input_rows", "dropped_rows"), "input_rows").alias("_b"))
    return last.filter("_b.input_rows > 0 or _b.dropped_rows > 0").groupBy("query").agg(
        F.count(F.lit(1)).cast("bigint").alias("batches"), F.sum("_b.input_rows").alias("input_rows"), F.sum("_b.dropped_rows").alias("dropped_rows")
    )
