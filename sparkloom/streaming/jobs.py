"""Jobs on streams of files: event-time counts, first deliveries, numbers per key. Each runs on what is there and resumes from its checkpoint."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The Parquet files of a folder, or of one file's folder, as a stream; the schema is read from the data."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n, total): rows that arrive later than ``late`` behind the newest are dropped, closed windows are emitted once."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), key, "n", "total")


def first_deliveries(events: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Repeats of a key within the watermark's reach are dropped."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def numbered(events: DataFrame, key: str, columns: list[str], schema: str) -> DataFrame:
    """``no``: a number counted on per key over all batches, kept in state.

    Within a micro-batch a key's rows are numbered in the order of ``columns``, all of them, however many Arrow batches they come in; rows
    of a later micro-batch come after those of earlier ones. A key's rows of one micro-batch are held at once (its columns only): bound
    them by the rows that a trigger takes.
    """

    def run(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        pdf = pd.concat(pdf[[key, *columns]] for pdf in batches).sort_values(columns, kind="stable")
        state.update((n + len(pdf),))
        yield pdf.assign(no=range(n + 1, n + 1 + len(pdf)))

    return events.groupBy(key).applyInPandasWithState(run, f"{schema}, no long", "n long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs the stream on all that is there, writes Parquet once per batch, and reads it back."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)
