"""Helpers that the training-data operators share: durable cuts of lineage, row packing, text rules."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import durable, shared_folder

#: White space of the word and line rules: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
#: A word is a longest run of other characters (Java and Python syntax alike).
WORD = r"[^\x20\x09-\x0D]+"

#: Ids made inside a task: the partition's number above, a counter below.
ID_BITS = 40

#: Bytes of an Arrow batch on its way to or from Python.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_scratch: list[tuple[SparkSession, str]] = []


checkpointed = durable


def shared_table(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the application ends in good order."""
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_clean)
    _scratch.append((spark, path))
    return path


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Like checkpointed, as a Parquet table: for wide rows of which readers want some columns."""
    spark, path = df.sparkSession, shared_table(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _scratch:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone by now
            return


def as_row(df: DataFrame, name: str = "row") -> F.Column:
    """All columns of df as one struct, so that an operator's own columns can't clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session's Arrow batches are held to BATCH_BYTES, unless the session names a bound itself: long texts make wide rows."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, "1").rstrip("b") == "1":  # the default given here, so it isn't set
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def slices(batch, rows: int = 500):
    """A record batch in parts of so many rows, so that only a part's texts are Python objects at a time."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def task_id_base() -> int:
    """First id of the running task; ids of different tasks never meet."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << ID_BITS
