"""Tables that cut a long plan: what several steps read is worked out once, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. On one machine (a local master) it may be unset: then it is a temporary folder; on a cluster
    that is an error, as others couldn't read such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='evidra-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_KEPT: list[str] = []


#: Bytes of code up to which the JVM compiles a method. Spark makes one method of a stage, and a longer one is interpreted.
COMPILED, LIMIT = 8000, "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def _compiled(spark: SparkSession) -> Iterator[None]:
    """Within, stages whose method would be too long to be compiled run operator by operator, which is faster by far."""
    former = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, min(COMPILED, int(former)))
    try:
        yield
    finally:
        spark.conf.set(LIMIT, former)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again. It survives lost executors and stays until drop_kept()."""
    path = f"{shared_dir(df.sparkSession)}/evidra-{name}-{uuid.uuid4().hex}"
    _KEPT.append(path)
    with _compiled(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession) -> int:
    """Deletes the tables that kept() has made in this process, and returns how many these were. For when the DataFrames that
    stand on them have been written or collected."""
    n = 0
    while _KEPT:
        at = spark._jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        n += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    return n
