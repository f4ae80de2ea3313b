"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The most bytes of a batch that goes to a Python worker. Spark's own limit is 64 MB, which both sides hold several times.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the limit of a batch to BATCH_BYTES for the session, unless it has been set by hand."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset and everything runs on this machine."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    own = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df written once as Parquet to the shared folder and read again: cuts lineage and survives lost executors. compression: None for Spark's own setting."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a stored() table that is no longer needed."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: str) -> DataFrame:
    """mapInArrow for a function that turns a batch into columns by name (or several such dicts)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    out = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1024)):
            made = each(batch)
            for columns in [made] if isinstance(made, dict) else made or ():
                yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    values = batch.column(column).cast(pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary())
    return [x or b"" for x in values.to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in parts of a few rows, for functions that hold several times the size of their input."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches together, of about size bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def joined(parts: pa.LargeBinaryArray, groups: np.ndarray) -> pa.LargeBinaryArray:
    """Consecutive parts joined, as many as each group says. parts: not a slice."""
    _, offsets, data = parts.buffers()
    offsets = np.frombuffer(offsets, "<i8", len(parts) + 1) if len(parts) else np.zeros(1, np.int64)
    ends = offsets[np.concatenate([[0], np.cumsum(groups)])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(groups), [None, pa.py_buffer(ends), data])


def unused(name: str, columns: list[str]) -> str:
    """name, with as many underscores in front as set it apart from columns (whose case doesn't count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
