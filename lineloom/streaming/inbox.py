"""Structured Streaming (K1-K3)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lineloom.functions.text import plain_dashes
from lineloom.sources import publish


def inbox_rows(raw: DataFrame) -> DataFrame:
    """K1: raw(path, ts, text), the path ending in <date>-<slug>.txt, as (path, ts, day, slug, text, hash), dashes made plain."""
    raw = raw.withColumn("text", plain_dashes("text"))
    name = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    return raw.select("path", "ts", F.try_to_date(F.left(name, F.lit(10)), "yyyy-MM-dd").alias("day"), F.regexp_replace(name, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}-", "").alias("slug"), "text", F.sha2("text", 256).alias("hash"))


def stream_inbox(spark: SparkSession, path: str) -> DataFrame:
    """K1: inbox_rows of the whole text files of a drop folder."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    return inbox_rows(files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("ts"), F.col("value").alias("text")))


def stream_table(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream, a bounded number of files a batch if given."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a plain path would have to be a folder, a pattern needn't


def drain(query: DataStreamWriter, checkpoint: str) -> None:
    """Runs a query until all that is there now has been taken, and raises its error if it fails."""
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drop_repeats(stream: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """K2: the same content under the same key counts once within the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key, "hash"])


def latest_per_key(batch: DataFrame, key: str) -> DataFrame:
    """K2: the last row of each key; of rows at the same time the one with the largest hash."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", "hash")).alias("r")).select(key, "r.*")


def upsert_latest(path: str, key: str, merge_every: int = 20) -> Callable[[DataFrame, int], None]:
    """K2: for foreachBatch: a batch writes its own last rows only, as a version; read_latest takes the last of all.

    Every merge_every batches the version holds all live ones before it too; those stay for readers until the next merge and
    are deleted then. Only versions that the pointer names are read, so a batch that failed half way is written again, and
    one that runs again after it was published adds the same rows once more, which changes nothing. One stream a table.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, new = batch.sparkSession, latest_per_key(batch, key)
        says = publish.read_pointer(spark, path) or {"live": [], "retired": []}
        live, name = says["live"], f"version={batch_id}"
        again = name in live + says["retired"]
        if again:
            name = f"again={batch_id}-{uuid.uuid4().hex}"
        merges = (batch_id + 1) % merge_every == 0 and not again
        if merges and live:
            new = latest_per_key(read_versions(spark, path, live).unionByName(new), key)
        new.write.mode("overwrite").parquet(f"{path}/{name}")
        if merges:
            for old in says["retired"]:
                publish.delete(spark, f"{path}/{old}")
        publish.write_pointer(spark, path, {"live": [name], "retired": live} if merges else {"live": [*live, name], "retired": says["retired"]})

    return run


def read_versions(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.parquet(*(f"{path}/{n}" for n in names))


def read_latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """K2: the last row of each key over all live versions; an error where no batch was published yet."""
    return latest_per_key(publish.read_current(spark, path), key)


def stream_hit_counts(hits: DataFrame, tag: str = "tag", delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """K3: hits(ts, tag) counted by day; rows later than the delay are dropped. Works on a batch table as well."""
    out = hits.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), tag).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("day"), tag, "n")
