"""Published tables: a small pointer file names the folders that hold the present version.

A version is written first and pointed at afterwards, and the pointer is replaced by a rename, so a reader sees the old
version whole or the new one whole, and a publication that fails leaves the old one. One writer a table.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current.json"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lineloom-")
    return base.rstrip("/")


def fresh_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/lineloom-tables/{tag}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    """What the table's pointer says, or None where nothing was published yet."""
    fs, place = _place(spark, f"{path}/{POINTER}")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_pointer(spark: SparkSession, path: str, says: dict) -> None:
    """Replaces the pointer; `live` lists the version's folders below the table's."""
    target = f"{path}/{POINTER}"
    fs, temporary = _place(spark, f"{path}/_pointer-{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(says).encode()))
    out.close()
    over = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(over, 1)
    how[0] = over.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(temporary, spark._jvm.org.apache.hadoop.fs.Path(target), how)


def publish(df: DataFrame, path: str, name: str) -> None:
    """Makes the rows the table's version `name`. A version of that name that is live, or was, is kept as it is."""
    spark = df.sparkSession
    says = read_pointer(spark, path) or {"live": [], "done": []}
    if name not in says["done"]:
        df.write.mode("overwrite").parquet(f"{path}/{name}")  # what a publication that failed left isn't read by anyone
        says["done"].append(name)
    write_pointer(spark, path, says | {"live": [name]})


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the present version; an error where nothing was published yet."""
    says = read_pointer(spark, path)
    if says is None:
        raise ValueError(f"nothing is published in {path}")
    return spark.read.parquet(*(f"{path}/{name}" for name in says["live"]))
