"""What the operators of this package share: table reading, scratch tables and Arrow batch sizes."""

from __future__ import annotations

import contextlib
import contextvars
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif sc.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="lineloom-")
            sc.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base.rstrip("/")


#: The scope that scratch folders are named in, if any.
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("lineloom_scope", default=None)


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """The scratch folders that are named inside, by this thread, as a list: remove() deletes them once their readers are
    done."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)


def fresh() -> str:
    return uuid.uuid4().hex


def scratch(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/lineloom/{tag}-{fresh()}"
    own = _scope.get()
    if own is not None:
        own.append(path)
    return path


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def input_mark(df: DataFrame) -> str:
    """A name for the files that df reads: their paths, sizes and times."""
    spark, lines = df.sparkSession, []
    for path in sorted(df.inputFiles()):
        fs, place = _place(spark, path)
        status = fs.getFileStatus(place)
        lines.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:32]


def claim(spark: SparkSession, path: str, prefix: str) -> None:
    """Makes the empty file `path`; an error if another one of its prefix is there."""
    fs, place = _place(spark, path)
    if fs.exists(place):
        return
    other = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{prefix}*"))
    if other is not None and len(other):
        raise ValueError(f"{prefix} was made from other input")
    fs.create(place).close()


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch folders whose readers are done."""
    while paths:
        delete(spark, paths.pop())


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes in an Arrow batch.
BATCH_BYTES = 16 << 20


def batch_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Rows and bytes in an Arrow batch: bounds what a Python worker holds when texts are long. The options hold for the
    session, as results are lazy; both only cut batches and change no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def bucket(col: str | Column, modulus: int) -> Column:
    """crc32 of the value's text, mod modulus: a stable split of rows (null counts as the empty text)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus
