"""Small helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Characters that separate words: [\x20\x09-\x0D], the set bytes.split() uses.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    The folder is the session's spark.checkpoint.dir. Only where none is set
    and all runs on one machine is a temporary folder used; on a cluster that
    is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def parts_for(n_rows: int, rows_per_part: int) -> int:
    """How many parts hold n_rows at rows_per_part each, one at least."""
    return max(1, -(-int(n_rows) // rows_per_part))


def small(batches, rows: int = 500):
    """The batches in slices of few rows, so that what a slice grows into stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def groups_of(batches, key: int):
    """Split a stream of record batches sorted by column ``key`` into runs.

    Yields (key value, table) for each run of equal keys; a run may cross
    batches. Only one run is held at a time.
    """
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(values[1:] != values[:-1]) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True):
            if held and values[lo] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = values[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield current, pa.Table.from_batches(held)


def fresh(columns: list[str], name: str) -> str:
    """A column name like ``name`` that none of columns has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add."""
    mine = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in mine])


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the SplitMix64 finaliser)."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared checkpoint folder and read again, and the path."""
    spark = df.sparkSession
    cut(spark.range(0))  # makes sure of the folder
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` has written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
