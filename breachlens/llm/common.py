"""What several operators share: staging, text rules as columns, and Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from breachlens.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the contracts: blank and \x09 to \x0D. Bytes.split() knows the same set.
SPACES = " \t\n\x0b\f\r"
_LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    This cuts the lineage: a lost executor loses no finished step, and what is computed
    once cannot come out differently when it is read twice.
    """
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bloom_joins(spark: SparkSession) -> Iterator[None]:
    """Inner joins that are run within may drop rows without a partner before they shuffle, by a
    Bloom filter of a fixed size, also if the large side has less than the usual 10 GB."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "0")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind: they go as soon as it is written, and
    not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def lower_bytes(text: str | bytes | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null is empty."""
    plain = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return plain.translate(_LOWER_BYTES)


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]],
    schema: str,
) -> DataFrame:
    """Run a batch function over a frame. `make` is called once in each task.

    Batches are small, so that a worker holds few texts at a time however long they are.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(task, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """To be called by the driver; tasks get the result."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, type=f.type)
         for f in schema for c in [columns[f.name]]],
        schema=schema,
    )


class Memo(dict):
    """A bounded memo: values are made for missing keys; when full it starts anew."""

    def __init__(self, make: Callable, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the folder of a frame that `staged` returned and that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
