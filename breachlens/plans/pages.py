"""A sorted result that is stored once and opened at any page.

The rows are sorted over all partitions and written in that order, with a number, `row`, that tells
the range (the partition) and the place within it. Rows per range are counted once. So any page is
known by the numbers of its rows, and reading it opens the row groups that hold these and no others,
however deep it lies. Equal rows have numbers of their own, so that pages neither overlap
nor miss any.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breachlens.plans.details import PAGE_SIZE, page_order

ROW = "row"
#: A row's number is its place in its range, from 0, plus the range times this: Spark's increasing ids.
_RANGE, _PLACE = 33, (1 << 33) - 1


def store_pages(df: DataFrame, path: str, sort: list[tuple[str, bool]] | None = None) -> Pages:
    """Write `df` below `path`, sorted by (column, ascending) pairs; the other columns complete
    the order. A stored result is replaced."""
    if ROW in df.columns:
        raise ValueError(f"the result has a column {ROW!r} of its own")
    spark, order = df.sparkSession, page_order(df, sort)
    ordered = df.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order.items()])
    ordered.withColumn(ROW, F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    counts = rows.groupBy(F.shiftright(ROW, _RANGE).alias("range")).agg(F.count("*").alias("n"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
    return Pages(spark, path)


@dataclass(frozen=True)
class Pages:
    """A stored result. There are as many ranges as it had partitions."""

    spark: SparkSession
    path: str

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _ranges(self) -> list[tuple[int, int]]:
        ranges = self.spark.read.schema("range BIGINT, n BIGINT").parquet(f"{self.path}/ranges").collect()
        return sorted((r["range"], r["n"]) for r in ranges)

    def count(self) -> int:
        return sum(n for _, n in self._ranges())

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        """Page `number`, from 0, in order, with the numbers of its rows."""
        if number < 0 or size < 1:
            raise ValueError("a page has a number from 0 and at least one row")
        return self._between(number * size, size)

    def _between(self, start: int, size: int) -> DataFrame:
        """So many rows from a place in the whole result on."""
        stop, before, wanted = start + size, 0, F.lit(False)
        for range_, n in self._ranges():
            low, high = max(start - before, 0), min(stop - before, n)
            if low < high:
                base = range_ << _RANGE
                wanted = wanted | F.col(ROW).between(base + low, base + high - 1)
            before += n
        return self._rows().filter(wanted).orderBy(ROW)

    def after(self, row: int | None, size: int = PAGE_SIZE) -> DataFrame:
        """The rows that follow the row of a number; the first ones without it."""
        if row is None:
            return self.page(0, size)
        return self._between(sum(n for r, n in self._ranges() if r < row >> _RANGE) + (row & _PLACE) + 1, size)
