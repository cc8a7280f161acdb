"""Incremental pipelines: file events, stages that hand on what changed, rates and heartbeats.

A stage is a streaming query with `foreachBatch`; the checkpoint takes the place of
claims, acknowledgements and orphan recovery: a batch that fails is run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, ArithmeticException, IllegalArgumentException, NumberFormatException, PythonException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lithoscope.functions.text import dirname
from lithoscope.session import scratch_path


def debounced(events: DataFrame, gap: str = "2 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Streaming: `path, flushed, event`: per path the last event of each burst, once the burst has been over for `gap`."""
    return events.withWatermark("ts", lateness).groupBy("path", F.session_window("ts", gap)).agg(F.max_by("event", F.struct("ts", "event")).alias("event")).select("path", F.col("session_window.end").alias("flushed"), "event")


def as_upserts(events: DataFrame) -> DataFrame:
    """Moves as a removal of the source and a creation of the destination; other events unchanged."""
    both = F.when(F.col("event") == "move", F.array(F.struct(F.col("path").alias("path"), F.lit("remove").alias("event")), F.struct(F.col("dest").alias("path"), F.lit("create").alias("event")))).otherwise(F.array(F.struct(F.col("path").alias("path"), F.col("event").alias("event"))))
    return events.select("ts", F.explode(both).alias("e")).select("ts", "e.path", "e.event")


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """`path, event` between two snapshots (path, hash): create, modify or remove. A file stream tells no removals."""
    a, b = old.groupBy("path").agg(F.max("hash").alias("was")), new.groupBy("path").agg(F.max("hash").alias("now"))
    both = a.withColumn("had", F.lit(True)).join(b.withColumn("has", F.lit(True)), "path", "full_outer")
    event = F.when(F.col("had").isNull(), "create").when(F.col("has").isNull(), "remove").when(~F.col("was").eqNullSafe(F.col("now")), "modify")
    return both.select("path", event.alias("event")).where("event is not null")


def direct_files(files: DataFrame, created: DataFrame) -> DataFrame:
    """Of files(path) those that lie directly in created(dir): what a new directory queues."""
    return files.withColumn("dir", dirname("path")).join(created.select(F.regexp_replace(F.replace("dir", F.lit("\\"), F.lit("/")), "/+$", "").alias("dir")).distinct(), "dir", "left_semi").select("path").distinct()


def rate(events: DataFrame, key: str, window: str = "60 seconds", slide: str = "10 seconds", lateness: str = "60 seconds") -> DataFrame:
    """Streaming: events per sliding window and key."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window, slide), key).agg(F.count("*").alias("n")).select(F.col("window.end").alias("at"), key, "n")


def of_the_data(error: Exception) -> bool:
    """Whether an error comes from the rows or the work on them: analysis, conversion, arithmetic, or user code in Python."""
    if isinstance(error, (AnalysisException, ArithmeticException, NumberFormatException, IllegalArgumentException, PythonException, SparkRuntimeException, ValueError, TypeError, KeyError)):
        return True
    return False


def stage(source: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: list[str], attempts: int = 3) -> StreamingQuery:
    """Run `work` over each batch of new rows and append its output, deduplicated by key, to a table of parquet files.

    A batch that its own data make fail goes to `<sink>-failed` as it is, and the row
    (batch, rows, error) to `<sink>-failed-log`, so that one bad batch doesn't stop the
    stage. An error of the cluster (a lost executor, a full disk) stops the stream; the
    batch is run again from the checkpoint.
    """

    def each(batch: DataFrame, number: int) -> None:
        for attempt in range(1, attempts + 1):
            try:
                work(batch).dropDuplicates(key).withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/_b={number}")
                return
            except Exception as e:
                if not of_the_data(e):
                    raise
                if attempt == attempts:
                    batch.write.mode("overwrite").parquet(f"{sink}-failed/_b={number}")
                    log = batch.groupBy().agg(F.count("*").alias("rows")).select(F.lit(number).alias("batch"), "rows", F.lit(str(e)[:500]).alias("error"))
                    log.write.mode("overwrite").parquet(f"{sink}-failed-log/_b={number}")

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, sink: str, key: list[str]) -> DataFrame:
    """The newest row of each key in a stage's output."""
    df = spark.read.parquet(sink)
    rest = [c for c in df.columns if c not in (*key, "_batch", "_b")]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*key, "r.*")


def drain_to_table(spark: SparkSession, stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its output as a table in the shared folder."""
    out, checkpoint = scratch_path(spark, tag), scratch_path(spark, f"{tag}-state")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    else:
        stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder as a stream, be it a file or a folder."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    files = df.inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith(f"/{name}.parquet"):  # the table is one file: a stream reads folders
        return spark.readStream.schema(df.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return spark.readStream.schema(df.schema).parquet(path)
