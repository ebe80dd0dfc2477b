"""The seven tables as DataFrames, and where they can be read from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from breachlens import schemas


@dataclass(frozen=True)
class Tables:
    folder: DataFrame
    scan: DataFrame
    scan_run: DataFrame
    host: DataFrame
    host_vuln: DataFrame
    plugin: DataFrame
    vuln_output: DataFrame

    @property
    def finding_key(self) -> tuple[str, ...]:
        return schemas.finding_key(self.vuln_output.columns)

    @property
    def spark(self) -> SparkSession:
        return self.scan_run.sparkSession

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in schemas.TABLES}


class LazyTables(Tables):
    """Tables that are defined when first asked for; a report needs only some of them."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        object.__setattr__(self, "_makers", makers)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in schemas.TABLES:
            raise AttributeError(name)
        frame = self._makers[name]()
        object.__setattr__(self, name, frame)
        return frame


def from_parquet(spark: SparkSession, root: str) -> Tables:
    """One parquet folder or file per table, `<root>/<table>`."""
    return Tables(**{
        name: spark.read.parquet(f"{root.rstrip('/')}/{name}") for name in schemas.TABLES
    })


def from_catalog(spark: SparkSession, database: str) -> Tables:
    return Tables(**{name: spark.table(f"{database}.{name}") for name in schemas.TABLES})


def from_jdbc(
    spark: SparkSession,
    url: str,
    options: dict[str, str] | None = None,
    renames: dict[str, str] | None = None,
    splits: dict[str, tuple[str, int, int, int]] | None = None,
) -> Tables:
    """Read the tables from a relational database.

    `renames` maps a column name there to ours. `splits` gives, for a table,
    (numeric column, lowest, highest, partitions), so that large tables are read by
    many tasks; filters and column lists are pushed into the database by Spark.
    """
    frames = {}
    for name in schemas.TABLES:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        if splits and name in splits:
            column, low, high, parts = splits[name]
            reader = (
                reader.option("partitionColumn", column)
                .option("lowerBound", low)
                .option("upperBound", high)
                .option("numPartitions", parts)
            )
        frame = reader.options(**(options or {})).load()
        frames[name] = frame.withColumnsRenamed(renames or {})
    return Tables(**frames)
