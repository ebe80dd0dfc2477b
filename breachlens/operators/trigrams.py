"""Searching texts for what they contain by the groups of three characters they hold.

An index has a row for every text and different group of three lower-cased characters in it, sorted
by group. A text that contains a term holds all the term's groups, so only texts that have all
of them are read, and tested with the very condition that a scan would use. A pattern's groups
are those of the stretches between its wildcards. Terms without any group, which are short or
all wildcards, are looked for in all texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachlens.operators.filters import contains_text

#: Between the texts of one key, so that no group spans two of them.
_APART = "\x00"
#: Characters of the texts that one task takes apart.
CHARACTERS = 2_000_000


def _folded(df: DataFrame, text: str) -> str:
    """A text as Spark's lower() has it, which is what conditions compare."""
    return df.sparkSession.range(1).select(F.lower(F.lit(text)).alias("t")).first()["t"]


def groups_of(text: str) -> list[str]:
    return sorted({text[i:i + 3] for i in range(len(text) - 2)})


def pattern_stretches(pattern: str) -> list[str]:
    """The stretches of a pattern that a text must contain as they stand. `%` and `_` are
    wildcards unless a backslash is before them; any other backslash is a plain character."""
    stretches, stretch = [], ""
    for part in re.findall(r"\\[%_\\]|.", pattern, re.DOTALL):
        if part in ("%", "_"):
            stretches.append(stretch)
            stretch = ""
        else:
            stretch += part[-1] if len(part) > 1 else part
    return [s for s in (*stretches, stretch) if s]


@dataclass(frozen=True)
class TextIndex:
    """(gram, key): which texts hold a group of three characters."""

    postings: DataFrame
    key: str

    def having(self, stretches: list[str]) -> DataFrame | None:
        """The keys of texts that hold all groups of all stretches; None if there are no groups."""
        wanted = sorted({g for s in stretches for g in groups_of(_folded(self.postings, s))})
        if not wanted:
            return None
        held = self.postings.filter(F.col("gram").isin(wanted))
        return held.groupBy(self.key).agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select(self.key)

    def search(self, texts: DataFrame, stretches: list[str], condition: Column) -> DataFrame:
        """The rows of `texts` that meet a condition which those without a stretch cannot meet."""
        keys = self.having(stretches)
        return (texts if keys is None else texts.join(keys, self.key, "left_semi")).filter(condition)

    def matching(self, texts: DataFrame, column: str, pattern: str) -> DataFrame:
        """The rows whose text matches a filter's pattern, as FilterSpec has it."""
        return self.search(texts, pattern_stretches(pattern), contains_text(column, pattern))


def postings(texts: DataFrame, key: str, *columns: str) -> DataFrame:
    """(gram, key) of the different groups in the given columns. A NULL text has none."""
    joined = F.lower(F.concat_ws(_APART, *[F.col(c).cast("string") for c in columns]))
    grams = F.transform(
        F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.substring(F.col("text"), i, F.lit(3))
    )
    held = texts.select(key, joined.alias("text")).filter(F.length("text") >= 3)
    # A text has far more groups than rows it is read in, so texts are dealt out by their lengths first. The rows
    # of a key are then together, and no group is shuffled to find the different ones.
    characters = held.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = held.repartition(characters // CHARACTERS + 1, key)
    every = dealt.select(key, F.explode(F.array_distinct(grams)).alias("gram")).filter(~F.col("gram").contains(_APART))
    return every.select("gram", key).distinct()


def write_index(texts: DataFrame, path: str, key: str, *columns: str) -> TextIndex:
    """Store the index of the given columns below `path`, so that a search reads the row groups of
    its groups alone. A key may have several rows."""
    rows = postings(texts, key, *columns)
    rows.sort("gram", key).write.mode("overwrite").option("parquet.bloom.filter.enabled#gram", "true").parquet(path)
    return TextIndex(texts.sparkSession.read.schema(rows.schema).parquet(path), key)
