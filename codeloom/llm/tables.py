"""Reading the given tables and writing intermediate ones where all executors see them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import shared_dir

#: A word is a run of anything but ASCII white space. Fixed value, from the contract.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths written in the scopes of :func:`temporary` that are open, innermost last.
_OPEN: list[list[str]] = []


def stored(df: DataFrame, name: str, result: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a reread and not a second
    computation, and gives the planner the true size of the table. A ``result``
    outlives the innermost scope of :func:`temporary`, other tables do not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    scopes = _OPEN[:-1] if result else _OPEN
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that this library has written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what :func:`stored` has written in this scope, results excepted.

    What leaves the scope must not read those tables any more.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            discard(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold ``BATCH_BYTES`` of rows at most.

    The setting of the session bounds what a task and its Python worker hold of
    whole texts at once, however long they are; a smaller one of the user stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if given < 1 or given > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def word_count(text: Column) -> Column:
    """Number of words; null counts as the empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
