"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. On one machine (a local master) it may be unset: then it is a
    temporary one; on a cluster that is an error, as others couldn't read such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='evidra-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again. It survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/evidra-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files behind tables made by written()."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def released(spark: SparkSession) -> None:
    """Lets the driver find the shuffles that no plan needs any more, so that their files go before the next step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_hash_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in a batch that Spark sends to Python: a batch of texts takes memory on both sides, and texts may be long.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends STEP_ROWS rows at a time to Python."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH)) not in range(1, STEP_ROWS + 1):
        conf.set(BATCH, str(STEP_ROWS))
    return df


def released_after(run):
    """A function over batches that gives what it has freed back to the system as it ends: Spark keeps its worker."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow() in small batches."""
    return in_small_batches(df).mapInArrow(released_after(run), schema)


class Memo(dict):
    """What a task has worked out by word, bounded in bytes: trim() empties it beyond, and a task starts with a new one."""

    def __init__(self, most_bytes: int, entry_bytes: int):
        super().__init__()
        self.most = most_bytes // entry_bytes

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_columns(docs: DataFrame, made: dict[str, str], run, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all unless told) and those made (name: type) from its text. run(text, n) gives a function
    over Arrow batches that returns their first n columns and those made; text is the text's place in a batch. The text
    is shipped once and comes back only if kept; a kept column that has a made one's name is replaced."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    sent = names if "text" in names else [*names, "text"]
    rows = docs.select(*(F.col(quoted(c)) for c in sent))
    fields = [f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema][: len(names)]
    return map_batches(rows, run(sent.index("text"), len(names)), ", ".join([*fields, *(f"{k} {v}" for k, v in made.items())]))


def strings(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def grouped(batches, rows: int, most_bytes: int):
    """Batches put together to so many rows or bytes, for work that has a cost of its own for each call."""
    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + len(batch), size + batch.nbytes
        if n >= rows or size >= most_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


#: Rows and bytes of text that a Python operator handles at once, whatever the size of Arrow's batches.
STEP_ROWS, STEP_BYTES = 512, 1_000_000


def steps(batch: pa.RecordBatch, text: int | str = "text"):
    """Slices of a batch that hold at most STEP_ROWS rows and, beyond one row, STEP_BYTES bytes of text."""
    lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
    begin, size = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and (i - begin >= STEP_ROWS or size + n > STEP_BYTES):
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield batch.slice(begin)
