"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words; a word is a maximal run of anything else.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str) -> F.Column:
    """True where crc32(id as text) mod 5 is 0; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-stage-")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it again.

    This cuts the lineage: an executor lost later costs no recomputation of
    what is written. The folder is the session's ``spark.checkpoint.dir``; where
    that is unset, a master on this machine alone gets a temporary folder, and
    any other is refused. The table goes when the application ends.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder()
    path = f"{folder}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged_at = path
    return found


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def unstaged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing still to be evaluated reads."""
    for table in tables:
        files, where = _files(table.sparkSession, table.__dict__.pop("_staged_at"))
        files.delete(where, True)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column, null as empty."""
    return [x or "" for x in column.to_pylist()]


@lru_cache(maxsize=1)
def _allocator():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def _give_back() -> None:
    """Return freed memory to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _allocator():
        _allocator()(0)


def in_small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most ``rows`` rows and about ``size`` bytes of text.

    A slice has one row at least, so what it expands to is bounded by the
    parameters or by its one text. After the last slice, freed memory is
    given back.
    """
    for batch in batches:
        held = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                held += np.asarray(pc.fill_null(pc.binary_length(column), 0))
        ends, start = np.cumsum(held), 0
        while start < batch.num_rows:
            most = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right"))
            end = min(batch.num_rows, start + rows, max(start + 1, most))
            yield batch.slice(start, end - start)
            start = end
    _give_back()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b).

    ``component`` is the smallest node reachable. Each round takes the least
    label among a node's neighbours and then the label of that label, so long
    chains shrink geometrically. Labels live in shared staged tables; the driver
    sees only how many changed. Nodes without edges do not appear.
    """
    both = staged(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    )
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    held = labels
    while True:
        # both sides are shuffled for the join alone, so adaptive execution can split a node of very many edges
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy("a")
            .agg(F.min("component").alias("low"))
        )
        taken = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "low").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        moved = staged(taken.join(jump, "mid", "left").select("node", "old", F.least("mid", "far").alias("component")))
        changed = moved.where("component <> old").limit(1).count()
        unstaged(held)
        labels, held = moved.select("node", "component"), moved
        if not changed:
            unstaged(both)
            return labels


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]
