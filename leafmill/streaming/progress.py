"""Progress events as a stream: debounce, front page, running items, page counter.

Event time is the ingestion stamp.  State is per item and bounded by its pages.
"""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LAST_STAGE = "purchase"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event files of a folder as a stream of (item, page, stage, ts, event_id)."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(folder)
    return raw.select(F.col("user_id").alias("item"), (F.col("event_id") % 8).alias("page"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def debounced(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of events of an item with quiet times below ``gap``."""
    return stream.withWatermark("ts", "1 hour").groupBy("item", F.session_window("ts", gap)).agg(F.count("*").alias("edits"), F.max("ts").alias("last"))


def counted(stream: DataFrame) -> DataFrame:
    """Pages written per item."""
    return stream.where(F.col("stage") == LAST_STAGE).groupBy("item").agg(F.count("*").alias("written"))


def running(stream: DataFrame) -> DataFrame:
    """Items that started more often than they ended."""
    step = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    return stream.groupBy("item").agg(F.sum(step).alias("running"))


def front_pages(stream: DataFrame) -> DataFrame:
    """Per item the lowest page not written yet, with its last stage, kept in state as events come."""

    def fold(key, frames, state):
        pages = {int(p): (s, int(e)) for p, s, e in state.get[0]} if state.exists else {}
        for f in frames:
            for p, s, e in zip(f["page"], f["stage"], f["event_id"], strict=True):
                if int(p) not in pages or pages[int(p)][1] <= int(e):
                    pages[int(p)] = (s, int(e))
        state.update(([(p, s, e) for p, (s, e) in pages.items()],))
        open_ = sorted(p for p, (s, _) in pages.items() if s != LAST_STAGE)
        yield pd.DataFrame({"item": [key[0]], "page": [open_[0] if open_ else -1], "stage": [pages[open_[0]][0] if open_ else ""]})

    return stream.groupBy("item").applyInPandasWithState(fold, "item long, page long, stage string", "pages array<struct<page:long,stage:string,event:long>>", "update", "NoTimeout")


def drain(frame: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and give its result: each batch is a folder of files, written again if it is run again.

    Files and the stream's checkpoint lie below spark.checkpoint.dir (in local mode a temporary folder where that is unset).
    """
    spark = frame.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    root, done = f"{base}/stream-{uuid.uuid4().hex}", []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{number}")
        done.append(number)

    frame.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], frame.schema)
    # in complete mode the last batch is the whole result
    return spark.read.parquet(*[f"{root}/out/{n}" for n in (done[-1:] if mode == "complete" else sorted(set(done)))])
