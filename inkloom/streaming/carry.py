"""Streams of state changes: carried values per key, and resuming by what is done."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def carried_stream(events: DataFrame, key: str, order: str, name: str, value: str, watched: Sequence[str]) -> DataFrame:
    """As the batch operator: each event with the last earlier values of the watched states, kept per key across batches.

    Within a batch events are taken in order; an event that comes in a later
    batch counts as later.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    columns = [key, order, name, value]
    output = ", ".join([f"{c} {kinds[c]}" for c in columns] + [f"carried_{s} {kinds[value]}" for s in watched])
    state_type = ", ".join(f"s{i} {kinds[value]}" for i in range(len(watched)))

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [None] * len(watched)
        frame = pd.concat(list(frames)).sort_values(order, kind="stable")
        carried: list[list] = []
        for state_name, v in zip(frame[name], frame[value]):
            carried.append(list(held))
            if state_name in watched and not pd.isna(v):
                held[list(watched).index(state_name)] = v
        state.update(tuple(held))
        out = frame[columns].reset_index(drop=True)
        for i, s in enumerate(watched):
            out[f"carried_{s}"] = pd.Series([c[i] for c in carried], dtype=object if not len(carried) else None)
        yield out

    return events.groupBy(key).applyInPandasWithState(run, output, state_type, "append", GroupStateTimeout.NoTimeout)


def new_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of results that are appended to a folder of JSON lines, each file read once."""
    return spark.readStream.schema(schema).json(folder)


def latest_results(results: DataFrame, keys: Sequence[str], at: str, delay: str) -> DataFrame:
    """A stream without repeated results of a unit, late ones within the delay included."""
    return results.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append"):
    """Process what is there and stop; started again, only what came since."""
    return stream.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def activity(events: DataFrame, at: str, key: str, window: str, delay: str) -> DataFrame:
    """Events of a key in tumbling windows of event time, with late ones within the delay."""
    return events.withWatermark(at, delay).groupBy(F.window(at, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
