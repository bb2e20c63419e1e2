"""Incremental feeds: de-duplication, side outputs, windowed counts, runs of failures with state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kelindan.session import scratch


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into a table of the shared folder, and reads that table. Sink and checkpoint make a restart go on where it stopped."""
    base = scratch(stream.sparkSession, f"stream-{name}")
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/table").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/table")


def first_seen(stream: DataFrame, keys: list[str], time: str | None = None, within: str | None = None) -> DataFrame:
    """Rows whose keys were not seen before; with ``time`` and ``within`` the state is bounded, and what comes later than that counts as new."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys) if time and within else stream.dropDuplicates(keys)


def split_sinks(stream: DataFrame, keep: Any, path: str, aside: str, checkpoint: str) -> StreamingQuery:
    """Writes rows that satisfy ``keep`` to one table and the others to another, a batch at a time. A batch that is repeated after a failure replaces
    its own part of both, so each row is written once."""

    def both(batch: DataFrame, number: int) -> None:
        for where, to in ((F.coalesce(keep, F.lit(False)), path), (~F.coalesce(keep, F.lit(False)), aside)):
            batch.where(where).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Counts per window and keys; a window is final, and comes out, once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("begins"), *keys, "n")


def failure_islands(stream: DataFrame, key: str, order: str, failed: str, least: int = 3) -> DataFrame:
    """(key, run, length) of every run of failures of at least ``least`` that a success has ended; runs that are still open stay in the state. Rows of a
    key must come in order between batches; within one they are sorted here. Only the open run is kept per key."""
    kind = stream.schema[key].dataType.simpleString()

    def advance(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, length = state.get if state.exists else (0, 0)
        out = []
        for bad in pd.concat(list(batches)).sort_values(order)[failed]:
            if bad:
                length += 1
                continue
            if length >= least:
                out.append((k[0], run, length))
            run, length = run + 1, 0
        state.update((run, length))
        if out:
            yield pd.DataFrame(out, columns=[key, "run", "length"])

    return stream.groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, run long, length long", "run long, length long", "append", GroupStateTimeout.NoTimeout)


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A landed table as a stream of its files, whether it is one file or a folder of them. All that is landed is one batch, as files are in no order of time: cut into
    batches, rows of a late file would fall behind the watermark of an early one."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # As a glob, which a file source takes for a file as well as for a folder.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")
