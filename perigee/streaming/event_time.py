"""Event-time features of live telemetry: watermark, repeated deliveries, sliding and session windows, late rows.

The same functions run on a batch and on a stream.  On a stream rows first pass a state that forgets with the
watermark: it drops a row delivered again and a row that comes after its time, one by one, and counts both (``Accounts``).  Windows
above it therefore only see rows in time.  A window is emitted once, when the watermark has passed its end.

Counting distinct messages needs no set in the state: rows are first summed by (window, key, message), and those sums
by (window, key).  Both steps merge in the map tasks, so a key with a third of all rows sends each reducer one row per task and window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

WINDOW, SLIDE, GAP, DELAY = "10 minutes", "5 minutes", "2 minutes", "5 minutes"


def in_time(rows: DataFrame, ts: str = "ts", key: str = "seq", delay: str = DELAY) -> DataFrame:
    """Each row once: repeated ``key`` within the delay are dropped, and on a stream rows older than the watermark.

    State is bounded by the keys of the last ``delay`` of event time.  A batch turns away what is older than the watermark that the batch
    before it began with, so lateness takes effect one batch after the rows that moved the watermark.  A row without a time or a key is dropped by neither rule in a batch;
    on a stream it has no place in event time: ``timeless`` sets such rows apart first.
    """
    rows = rows.withWatermark(ts, delay)
    return rows.dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def timeless(rows: DataFrame, ts: str = "ts", key: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(rows with a time and a key, rows without): the second part goes to a quarantine."""
    whole = F.col(ts).isNotNull() & F.col(key).isNotNull()
    return rows.where(whole), rows.where(~whole)


def window_features(
    rows: DataFrame, key: str = "ApId", message: str = "MsgId", length: str = "MsgLength", ts: str = "ts",
    size: str = WINDOW, slide: str | None = SLIDE,
) -> DataFrame:
    """Traffic features of each key in sliding windows, under the names of the telemetry features.

    Deviation is that of the population; the interval is the mean between the first and the last message (NULL for one
    message).  A NULL key is a key; a NULL length counts as a message and adds no length.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    value = F.col(length).cast("double")
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    by_message = rows.groupBy(window.alias("window"), F.col(key).alias(key), F.col(message).alias("_message")).agg(
        F.count(F.lit(1)).alias("n"), F.count(length).alias("with_length"), F.sum(value).alias("total"), F.sum(value * value).alias("squares"),
        F.min(micros).alias("first"), F.max(micros).alias("last"),
    )
    whole = by_message.groupBy("window", key).agg(
        F.sum("n").alias("n"), F.count("_message").alias("messages"), F.sum("with_length").alias("with_length"),
        F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.sum("squares").alias("squares"), F.min("first").alias("first"), F.max("last").alias("last"),
    )
    n, mean = F.nullif(F.col("with_length"), F.lit(0)), F.col("total") / F.nullif(F.col("with_length"), F.lit(0))
    span = (F.unix_micros("window.end") - F.unix_micros("window.start")).cast("double") / 1e6
    return whole.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key,
        F.col("total").alias("FlowLengthInWindow"), F.col("n").alias("MessageCountInWindow"), F.col("messages").alias("UniqueMessageIDsInWindow"),
        mean.alias("AverageMessageLengthInWindow"), (F.col("n") / span).alias("MessageRateInWindow"),
        F.sqrt(F.greatest(F.col("squares") / n - mean * mean, F.lit(0.0))).alias("StdDevMessageLengthInWindow"),
        F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / 1e6 / (F.col("n") - 1)).alias("SlidingWindowMeanIntervalSec"),
    )


def sessions(rows: DataFrame, key: str = "ApId", length: str = "MsgLength", ts: str = "ts", gap: str = GAP) -> DataFrame:
    """Bursts of each key: rows that follow one another within ``gap``."""
    return rows.groupBy(F.session_window(ts, gap).alias("session"), F.col(key).alias(key)).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(length).cast("double")), F.lit(0.0)).alias("total")
    ).select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), key, "n", "total")


@dataclass
class Accounts:
    """What became of the rows of a stream: each is late, repeated, or has gone on to the windows."""

    seen: int = 0
    late: int = 0
    repeated: int = 0

    @property
    def used(self) -> int:
        return self.seen - self.late - self.repeated


def accounts(query: StreamingQuery, before: Accounts | None = None) -> Accounts:
    """Sums over the progress of a query behind ``in_time``; ``before`` are those of earlier runs from its checkpoint.

    The counts are those of the row-wise state of ``in_time``, not of the windows, which would count partial sums.
    """
    found = before or Accounts()
    found = Accounts(found.seen, found.late, found.repeated)
    for progress in query.recentProgress:
        found.seen += progress["numInputRows"]
        for state in progress["stateOperators"]:
            if state["operatorName"] == "dedupeWithinWatermark":
                found.late += state["numRowsDroppedByWatermark"]
                found.repeated += state["customMetrics"].get("numDroppedDuplicateRows", 0)
    return found
