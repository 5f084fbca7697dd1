"""What the corpus operators share: places for intermediate tables and text handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for written tables and checkpoints.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only a local
    session that names none gets a temporary folder of its own.
    """
    context = spark.sparkContext
    if (named := context.getCheckpointDir()) is not None:
        return named
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tarn-checkpoint-")
        _gone_at_exit(spark, f"file://{folder}")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver's JVM ends, however the session ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def checkpointed(frame: DataFrame) -> DataFrame:
    """A frame cut from its lineage by files in the shared folder.

    They go when nothing refers to the frame, if the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``; else when the driver ends.
    """
    spark = frame.sparkSession
    shared_folder(spark)
    fixed = frame.checkpoint(eager=True)
    if (file := fixed._jdf.queryExecution().analyzed().rdd().getCheckpointFile()).isDefined():
        _gone_at_exit(spark, file.get())
    return fixed


class Workspace:
    """Intermediate tables of one operator call, written to the shared folder.

    Written tables cut the lineage: a lost executor costs a re-read, not a
    recomputation.  All of them are deleted on leaving the ``with`` block, so a
    result that reads from them goes through :meth:`deliver` first.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.made = 0

    def __enter__(self) -> Workspace:
        return self

    def table(self, frame: DataFrame) -> DataFrame:
        """Write a frame and return the frame that reads it back."""
        path = f"{self.root}/{self.made}"
        self.made += 1
        frame.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def deliver(self, frame: DataFrame) -> DataFrame:
        """A result that no longer needs the tables."""
        return checkpointed(frame)

    def __exit__(self, *_: object) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Type of a row's address.
ROW = "struct<file:bigint,at:bigint>"


def position(docs: DataFrame, name: str) -> int:
    """Where the column of a name stands: the one spelled so, else the first that differs by case alone."""
    names = docs.columns
    if name in names:
        return names.index(name)
    folded = [n.lower() for n in names]
    if name.lower() not in folded:
        raise ValueError(f"there is no column {name!r} among {names}")
    return folded.index(name.lower())


def by_place(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named by place, so that no name clashes with another, whatever its case."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def picked(docs: DataFrame, **wanted: str) -> DataFrame:
    """The columns of ``docs`` named by the arguments' values, under the arguments' names."""
    placed = by_place(docs)
    return placed.select(*(F.col(f"c{position(docs, name)}").alias(new) for new, name in wanted.items()))


@dataclass
class Rows:
    """A table's rows with an address each, which is the same in every read of them.

    ``frame`` has the columns by place and ``row``, so a column of any name,
    ``row`` too, is kept as it is.
    """

    frame: DataFrame
    docs: DataFrame

    def pick(self, **wanted: str) -> DataFrame:
        """``row`` and the columns named by the arguments' values, under the arguments' names."""
        return self.frame.select("row", *(F.col(f"c{position(self.docs, name)}").alias(new) for new, name in wanted.items()))

    def texts(self, id_col: str, text_col: str) -> DataFrame:
        """(row, doc_id, text)."""
        return self.pick(doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))

    def keep(self, kept: DataFrame) -> DataFrame:
        """The rows whose address is in ``kept`` (row), all columns under their names; texts are moved once and not sorted."""
        found = self.frame.join(kept.select("row").hint("shuffle_hash"), "row", "left_semi").drop("row")
        return found.toDF(*self.docs.columns)


def addressed(docs: DataFrame) -> Rows:
    """Give each row an address.

    Rows of files are named by file and position, however the files are split
    over tasks; any other frame is checkpointed first and numbered.
    """
    placed = by_place(docs)
    try:
        file, at = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index").cast("long")
        return Rows(placed.withColumn("row", F.struct(file.alias("file"), at.alias("at"))), docs)
    except AnalysisException:
        fixed = checkpointed(placed)
        at = F.monotonically_increasing_id()
        return Rows(fixed.withColumn("row", F.struct(F.lit(0).cast("long").alias("file"), at.alias("at"))), docs)


#: Keys that a join treats apart, at most; see ``join_groups``.
HEAVY = 1 << 14


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group, of which there is one a key (an inner join).

    ``size`` is how many of the ``total`` rows a key has.  Fewer than ``HEAVY``
    keys can have more than that part of all rows, at any size of the table;
    these are broadcast, so their rows stay where they are, and no key that is
    shuffled has more than its part.  ``groups`` is best a written table.
    """
    keys = [key] if isinstance(key, str) else key
    heavy = groups.where(F.col(size) * HEAVY > total)
    light = groups.where(F.col(size) * HEAVY <= total)
    here = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return here.unionByName(rest)


def texts_as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column as UTF-8 byte strings; null becomes the empty text."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in raw.to_pylist()]


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 512, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that few decoded texts are held at once: ``rows`` and about ``size`` bytes, or one row."""
    for batch in batches:
        held = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                held += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(held), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(at, upto - at)
            at = upto


def map_rows(
    frame: DataFrame, schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """``mapInArrow``; Spark retries a lost task from its input, ``work`` keeps no state outside."""
    return frame.mapInArrow(work, schema)
