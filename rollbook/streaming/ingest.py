"""Incremental ingest: file streams with checkpoints, window ledgers, keyed replacement.

Resume skips terminal states only. A stream's progress is its checkpoint in the shared folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators.relational import last_row, unseen

TERMINAL = ("complete", "downloaded", "metadata_only")


def shared(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where all of it is one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return named or f"file://{tempfile.mkdtemp(prefix='rollbook-')}"


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file or folder as a stream; local timestamps become instants for watermarks."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false")
    # one table of a folder of tables: the glob names it, be it a file or a folder of parts
    rows = stream.parquet(f"{folder}/{name[:-1]}[{name[-1]}]")
    return rows.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.simpleString() == "timestamp_ntz" else F.col(f.name) for f in schema))


def tumbling(rows: DataFrame, at: str, width: str, *keys: str, late: str = "1 day") -> DataFrame:
    """Counts by window and keys; rows later than the watermark are left out in append mode."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def run_available(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run a plan over all that is there now, then stop; the result as a batch table."""
    base = f"{shared(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int):
        # a whole result replaces the last one; appended rows get a folder for each epoch, so that
        # an epoch that runs again replaces its own
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/epoch={epoch}")

    planned = plan(file_stream(spark, path))
    stream = planned.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    stream.awaitTermination()
    out = spark.read.schema(planned.schema).parquet(f"{base}/out")
    return out.select(*planned.columns)


def open_windows(rows: DataFrame, ledger: DataFrame, window: str) -> DataFrame:
    """Rows of windows whose last ledger entry is not terminal."""
    done = last_row(ledger, [window], ["recorded_at"]).where(F.col("status").isin(*TERMINAL))
    return unseen(rows, done, [window])


def resume_status(rows: DataFrame) -> DataFrame:
    """The status that resume goes by: a legacy 'ok' is downloaded or metadata_only by whether a
    path is there."""
    return rows.withColumn("status", F.when(F.col("status") == "ok", F.when(F.coalesce(F.trim("path"), F.lit("")) != "", "downloaded").otherwise("metadata_only")).otherwise(F.col("status")))


def changed(rows: DataFrame, manifest: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """New keys and changed contents: a corrected record replaces the stale one under its key."""
    return unseen(rows, manifest, [key, fingerprint])


def status_change_stream(rows: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """A row for each change of a key's status, the first among them, with state for each key."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, frames, state):
        before = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(frames).sort_values(at).itertuples(index=False):
            now = getattr(row, status)
            if now != before:
                out.append((k[0], before, now, getattr(row, at)))
                before = now
        state.update((before,))
        yield pd.DataFrame(out, columns=["key", "before", "now", "at"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, status, at).groupBy(key).applyInPandasWithState(step, f"key {kind}, before string, now string, at timestamp", "before string", "append", GroupStateTimeout.NoTimeout)
