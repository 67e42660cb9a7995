"""Streams of frames: decimation with the last result, frame rates, and detection by micro-batch."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Events as they arrive in a folder, with a time that watermarks accept."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def rates(events: DataFrame, seconds: int = 1, late: str | None = None) -> DataFrame:
    """(start, frames, fps) by tumbling windows; late: how long a stream waits for late rows."""
    timed = events.withWatermark("ts", late) if late else events
    grouped = timed.groupBy(F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("frames"))
    return grouped.select(F.col("window.start").alias("start"), "frames", (F.col("frames") / float(seconds)).alias("fps"))


def decimate(events: DataFrame, every: int = 2) -> DataFrame:
    """Batch form: of each stream (user_id) every every-th frame is taken, and its value stays until the next.

    (user_id, event_id, frame, taken, shown); shown is null before the first taken frame.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    counted = events.withColumn("frame", F.row_number().over(order)).withColumn("taken", F.col("frame") % every == 0)
    shown = F.last(F.when(F.col("taken"), F.col("value")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return counted.select("user_id", "event_id", "frame", "taken", shown.alias("shown"))


def decimate_stream(events: DataFrame, every: int = 2) -> DataFrame:
    """The same over a stream: a stream's state is its frame counter and its last value."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame, shown = state.get if state.exists else (0, None)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for event_id, value in zip(rows["event_id"], rows["value"]):
            frame += 1
            taken = frame % every == 0
            shown = float(value) if taken else shown
            out.append((key[0], event_id, frame, taken, shown))
        state.update((frame, shown))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "frame", "taken", "shown"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, frame int, taken boolean, shown double", "frame int, shown double", "append", GroupStateTimeout.NoTimeout)


def detect_stream(frames: DataFrame, detector: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, config: Callable[[], dict] | None = None) -> StreamingQuery:
    """Each micro-batch of frames goes through the batch detector; config is read anew for each batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(detector(batch, **config()) if config else detector(batch), batch_id)

    return frames.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def stats(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """(img_id, faces, h, w) of each frame, for the interface's statistics."""
    counted = boxes.groupBy("img_id").agg(F.count("*").alias("n"))
    sizes = (F.coalesce(c, F.lit(0)).alias(c) for c in ("h", "w"))  # a frame that could not be read has none
    return frames.select("img_id", "h", "w").join(counted, "img_id", "left").select("img_id", F.coalesce("n", F.lit(0)).alias("faces"), *sizes)


FRAME = "img_id long, h int, w int, px array<int>"


@dataclass
class _Range(InputPartition):
    first: int
    end: int


def frame_source(name: str, count: Callable[[], int], grab: Callable[[int], tuple[int, int, list[int]] | None], frames_per_task: int = 16, tries: int = 20, wait: float = 0.1) -> type[DataSource]:
    """A streaming source of numbered frames (img_id, h, w, px), to be registered and then read by its name.

    count tells how many frames there are by now; grab reads one, and is called in a task. A read that fails, by an
    OSError or None, is tried again after a wait; a frame that cannot be read at all comes without pixels, so the stream
    goes on. Offsets are frame numbers: a query that is restarted reads the frames of an unfinished batch again and
    goes on after its last one.
    """

    class Reader(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"frame": 0}

        def latestOffset(self) -> dict:
            return {"frame": count()}

        def partitions(self, start: dict, end: dict) -> list[_Range]:
            return [_Range(k, min(k + frames_per_task, end["frame"])) for k in range(start["frame"], end["frame"], frames_per_task)]

        def read(self, partition: _Range) -> Iterator[tuple]:
            for k in range(partition.first, partition.end):
                yield (k, *(_grabbed(grab, k, tries, wait) or (None, None, None)))

        def commit(self, end: dict) -> None:
            """Frames are numbered and kept by the camera, so nothing is let go."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return FRAME

        def streamReader(self, schema) -> Reader:
            return Reader()

    return Source


def _grabbed(grab: Callable[[int], tuple | None], k: int, tries: int, wait: float) -> tuple | None:
    for again in range(tries):
        with contextlib.suppress(OSError):
            if (got := grab(k)) is not None:
                return got
        if again + 1 < tries:
            time.sleep(wait)
    return None
