"""Session settings and lineage cutting."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, app: str = "codeloom") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder; on a cluster that folder would vanish
    with the machine, so a missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="codeloom-ckpt-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are done.

    Spark deletes them when the driver's garbage collector finds that no query refers
    to them any more, which on a driver with room to spare may be long after.
    """
    gc.collect()
    spark._jvm.System.gc()


#: Rows that are joined at a time, and how many times a table is read for that at most.
SLICE_ROWS = 2_000_000
MOST_SLICES = 8


def slices(rows: int) -> int:
    """In how many slices to join so many rows."""
    return max(1, min(MOST_SLICES, -(-rows // SLICE_ROWS)))


def in_slice(table: DataFrame, key: str, i: int, number: int) -> DataFrame:
    """Slice ``i`` of a table by the hash of a key; a missing key is in one of them too."""
    return table if number == 1 else table.filter(F.pmod(F.xxhash64(key), F.lit(number)) == i)


def _write(parts: Sequence[DataFrame], path: str) -> DataFrame:
    spark = parts[0].sparkSession
    for df in parts:
        df.write.mode("append").option("compression", "zstd").parquet(path)
        if len(parts) > 1:
            release_shuffles(spark)
    return spark.read.schema(parts[0].schema).parquet(path)


def kept(*parts: DataFrame) -> DataFrame:
    """``parts``, one written after the other, as a compressed table below the shared folder, which lazy results go on reading."""
    return _write(parts, f"{shared_dir(parts[0].sparkSession)}/kept-{uuid.uuid4().hex}")


@contextmanager
def written(*parts: DataFrame) -> Iterator[DataFrame]:
    """As :func:`kept`, for a table that several jobs read; it goes at the end."""
    spark = parts[0].sparkSession
    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    try:
        yield _write(parts, path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
