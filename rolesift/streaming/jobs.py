"""Stream jobs. Each runs over the files that are there and returns (``availableNow``)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rolesift.functions.timing import as_event_time, as_naive_utc
from rolesift.operators.dedup import first_per_key

def table_stream(
    spark: SparkSession, path: str, schema: T.StructType, per_batch: int | None = None
) -> DataFrame:
    """A stream of a Parquet table: a folder of part files, or a single file.

    A stream source has to be a folder, so a single file is read from its own with a
    filter on its name. A path without any file raises instead of giving no rows.
    """
    files = spark.read.schema(schema).parquet(path).inputFiles()
    if not files:
        raise ValueError(f"no Parquet file in {path}")
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if len(files) == 1 and files[0].rpartition("/")[2] == name:
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _run(
    stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None], mode: str
) -> None:
    query: StreamingQuery = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each_batch)
        .start()
    )
    query.awaitTermination()


def _opened(spark: SparkSession, folder: str, schema: T.StructType) -> None:
    """Make the folder of a stream's results, with an empty batch, so that it can be read at once."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/batch=-1")


def _written(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """What the stream has written so far; batches are folders, so a repeat replaces itself."""
    columns = T.StructType([*schema, T.StructField("batch", T.LongType())])
    return spark.read.schema(columns).parquet(folder)


def land_stream(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    key: str,
    order: Sequence[Column],
    recent: tuple[str, str] | None = None,
) -> DataFrame:
    """Land each key once: the first copy, in the given order, of the first batch that has it.

    What was landed before is kept out by an anti-join, however old it is. A batch
    writes its own folder, so one that is run again replaces its rows.

    ``recent`` = (event time column, delay) first drops copies that follow within the
    delay by stream state. It takes load off the join where feeds repeat themselves
    quickly, but which copy of a batch survives is then up to arrival, and rows later
    than the delay are left out.
    """
    schema = stream.schema
    if recent is not None:
        column, delay = recent
        timed = stream.withColumn("_at", as_event_time(F.col(column)))
        stream = timed.withWatermark("_at", delay).dropDuplicatesWithinWatermark([key])

    _opened(stream.sparkSession, target, schema)

    def land(batch: DataFrame, number: int) -> None:
        done = _written(batch.sparkSession, target, schema)  # only its key column is read
        earlier = done.filter(F.col("batch") < number).select(key)
        rows = first_per_key(batch, [key], order)
        rows.join(earlier, key, "left_anti").select(schema.names).write.mode(
            "overwrite"
        ).parquet(f"{target}/batch={number}")

    _run(stream, checkpoint, land, "append")
    return _written(stream.sparkSession, target, schema).drop("batch")


def upsert_stream(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[Column],
) -> DataFrame:
    """Keep the newest row per key: batches append, reading picks the newest.

    Writing a batch touches only that batch; ``order`` (newest first) decides between
    copies, and a later batch wins a tie.
    """
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        newest = first_per_key(batch, keys, order)
        newest.write.mode("overwrite").parquet(f"{target}/batch={number}")

    _opened(stream.sparkSession, target, schema)
    _run(stream, checkpoint, write, "append")
    rows = _written(stream.sparkSession, target, schema)
    return first_per_key(rows, keys, [*order, F.col("batch").desc()]).drop("batch")


def windowed_counts(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    event_time: str,
    keys: Sequence[str],
    window: str = "1 day",
    delay: str | None = None,
) -> DataFrame:
    """Rows per time window and key, however late they come.

    The stream emits only the windows a batch has changed; the newest count of each
    window is its result. ``delay`` is for feeds without end: windows older than it are
    dropped from the state, and rows that come later than that are left out.
    """
    timed = stream.withColumn("_at", as_event_time(F.col(event_time)))
    if delay is not None:
        timed = timed.withWatermark("_at", delay)
    counts = (
        timed.groupBy(F.window("_at", window).alias("_window"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(as_naive_utc(F.col("_window.start")).alias("window_start"), *keys, "n")
    )
    schema = counts.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    _opened(stream.sparkSession, target, schema)
    _run(counts, checkpoint, write, "update")
    rows = _written(stream.sparkSession, target, schema)
    return first_per_key(rows, ["window_start", *keys], [F.col("batch").desc()]).drop("batch")
