"""Counts for a table of saved filters, however many, in one pass over the findings.

Filters are numbered. Of each of the five conditions the different ones are tested against the
different values they look at: names of scans and plugins, levels, addresses, port numbers. Values
that meet the same conditions are one class, and findings are counted by their classes. A class is
met by a set of filters, as a bitmap of which only words with bits are kept, a row for each. The
counts, not the findings, are joined with the words of their scan names, whose bits are then ANDed
with the words of one condition after the other and added up per filter. Work on findings does not
grow with the filters, no row holds a whole bitmap, and neither findings nor filters go through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachlens.functions.scalars import port_number, severity_list_text
from breachlens.operators.filters import FilterSpec
from breachlens.operators.findings import findings, outputs, scope
from breachlens.operators.sizing import FEW_ROWS, broadcast_if, checkpointed
from breachlens.sources.tables import Tables

#: Bits of a word of a bitmap.
BITS = 64
_RANGE = r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$"


def _numbered(filters: DataFrame) -> DataFrame:
    """With a number, and empty conditions as NULL. Filters with equal conditions are numbered next
    to each other, so that a condition's bits lie in few words; numbers have gaps between tasks."""
    texts = ("scan_name", "vulnerability_name", "ip_address", "port")
    plain = filters.select(
        "filter_name", F.when(F.size("severity") > 0, F.col("severity")).alias("severity"),
        *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in texts],
    )
    ordered = plain.orderBy(*texts, "severity", "filter_name")
    return checkpointed(ordered.withColumn("number", F.monotonically_increasing_id()))


def _words(filters: DataFrame, condition: Column) -> DataFrame:
    """(condition, word, bits): which filters have a condition, only words with some of them."""
    word, bit = F.expr(f"number DIV {BITS}"), F.expr(f"shiftleft(1L, CAST(number % {BITS} AS INT))")
    rows = filters.select(condition.alias("condition"), word.alias("word"), bit.alias("bit"))
    return rows.filter("condition IS NOT NULL").groupBy("condition", "word").agg(F.bit_or("bit").alias("bits"))


def _sets(held: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From values with the set of conditions they meet, `held`: the different sets as (held, class),
    and (class, word, bits) of the filters that have one of a set's conditions."""
    classes = checkpointed(held.select("held").distinct().withColumn("class", F.monotonically_increasing_id()))
    each = classes.select("class", F.explode("held").alias("condition")).join(words, "condition")
    return classes, each.groupBy("class", "word").agg(F.bit_or("bits").alias("bits"))


def _classes(met: DataFrame, value: str, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (value, condition), a row for each condition a value meets: (value, class), and the
    classes' bits. Values that meet no condition have no class."""
    held = checkpointed(met.groupBy(value).agg(F.sort_array(F.collect_set("condition")).alias("held")))
    classes, bits = _sets(held, words)
    return broadcast_if(held.join(classes, "held").select(value, "class"), held.count() <= FEW_ROWS), bits


def _containing(values: DataFrame, words: DataFrame, value: str) -> DataFrame:
    """(value, condition) for the texts that contain a condition's text, as FilterSpec has it. Different
    texts are compared, each pair once."""
    escaped = F.regexp_replace("condition", r"\\(?![%_\\])", r"\\\\\\\\")
    texts = words.select("condition").distinct()
    patterns = texts.withColumn("pattern", F.concat(F.lit("%"), escaped, F.lit("%")))
    return values.join(patterns, F.expr(f"{value} ILIKE pattern")).select(value, "condition")


def _in_ranges(values: DataFrame, words: DataFrame) -> DataFrame:
    """(port, condition) for the ports whose number lies in a condition's ranges."""
    conditions = words.select("condition").distinct()
    parts = conditions.select("condition", F.explode(F.split("condition", ",")).alias("part"))
    bad = F.raise_error(F.concat(F.lit("not a port or a port range: "), F.col("part"))).cast("string")
    low = F.when(F.col("part").rlike(_RANGE), F.regexp_extract("part", _RANGE, 1)).otherwise(bad)
    high = F.regexp_extract("part", _RANGE, 2)
    ranges = parts.select("condition", low.cast("double").alias("low"), F.when(high != "", high).cast("double").alias("high"))
    ranges = ranges.withColumn("high", F.coalesce("high", "low"))
    numbers = values.select("port", port_number("port").alias("n")).filter(F.col("n") == F.floor("n"))
    return numbers.join(ranges, F.col("n").between(F.col("low"), F.col("high"))).select("port", "condition")


def _narrowed(rows: DataFrame, name: str, bits: DataFrame, filters: DataFrame, condition: str) -> DataFrame:
    """Of counts (classes, n, word, bits) the filters that meet one more condition: those that have it
    and whose set of values a class is, and those that do not have it. Counts that differ in this class
    alone are then added up."""
    without = _words(filters.filter(F.col(condition).isNull()), F.lit(True))
    of = bits.select(F.col("class").alias(f"{name}_class"), "word", F.col("bits").alias("held"))
    met = rows.join(of, [f"{name}_class", "word"], "left").join(
        without.select("word", F.col("bits").alias("free")), "word", "left"
    )
    either = F.coalesce("held", F.lit(0).cast("bigint")).bitwiseOR(F.coalesce("free", F.lit(0).cast("bigint")))
    left = met.withColumn("bits", F.col("bits").bitwiseAND(either)).filter("bits <> 0")
    others = [c for c in rows.columns if c not in (f"{name}_class", "n")]
    return left.groupBy(*others).agg(F.sum("n").alias("n"))


def filter_counts(tables: Tables, filters: DataFrame) -> DataFrame:
    """(filter_name, severity_labels, finding_count) for each row of `filters`, whose columns are
    filter_name, severity (an array of levels), scan_name, vulnerability_name, ip_address and port.

    A condition that is NULL or empty is none. Equal rows are filters of their own.
    """
    filters = _numbered(filters)
    sc = scope(tables, FilterSpec())
    if filters.isEmpty():
        return filters.select("filter_name", F.lit("").alias("severity_labels"), F.lit(0).cast("bigint").alias("finding_count"))

    columns = {"scan_name": "scan_name", "host_ip": "ip_address", "name": "vulnerability_name", "severity": "severity", "port": "port"}
    words = {name: _words(filters, F.explode(c) if name == "severity" else F.col(c)) for name, c in columns.items()}
    levels = tables.plugin.select("severity").distinct()
    met = {
        # dimension -> values with the conditions they meet
        "scan_name": _containing(sc.runs.select("scan_name").distinct(), words["scan_name"], "scan_name"),
        "host_ip": _containing(sc.hosts.select("host_ip").distinct(), words["host_ip"], "host_ip"),
        "name": _containing(tables.plugin.select("name").distinct(), words["name"], "name"),
        "severity": levels.join(words["severity"].select("condition").distinct(), F.col("severity") == F.col("condition")),
    }
    found, bits = findings(sc), {}
    for name, rows in met.items():
        of_value, bits[name] = _classes(rows, name, words[name])
        found = found.join(of_value.withColumnRenamed("class", f"{name}_class"), name, "left")
    # A finding meets what any of its ports meets: its class is the set of its ports' classes.
    key = list(sc.tables.finding_key)
    shown = outputs(sc, "port").filter("port IS NOT NULL")
    of_port, port_bits = _classes(_in_ranges(shown.select("port").distinct(), words["port"]), "port", words["port"])
    of_finding = shown.join(of_port, "port").groupBy(*key).agg(F.sort_array(F.collect_set("class")).alias("held"))
    found = found.join(of_finding, key, "left")

    counted = checkpointed(found.groupBy(*[f"{name}_class" for name in met], "held").agg(F.count("*").alias("n")))
    sets, bits["port"] = _sets(counted.filter("held IS NOT NULL"), port_bits.withColumnRenamed("class", "condition"))
    counted = counted.join(sets.withColumnRenamed("class", "port_class"), "held", "left").drop("held")

    # The filters on scans' names give the words to begin with. Those without one begin with all their words.
    first, *rest = columns
    others = [f"{name}_class" for name in rest]
    begun = bits[first].withColumnRenamed("class", f"{first}_class")
    free = _words(filters.filter(F.col(columns[first]).isNull()), F.lit(True)).select("word", "bits")
    rows = counted.join(begun, f"{first}_class").groupBy(*others, "word", "bits").agg(F.sum("n").alias("n"))
    rows = rows.unionByName(counted.groupBy(*others).agg(F.sum("n").alias("n")).crossJoin(free))
    for name in rest:
        rows = _narrowed(rows, name, bits[name], filters, columns[name])

    passed = rows.select("n", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit")).filter(
        "(shiftright(bits, bit) & 1) = 1"
    )
    sums = passed.groupBy((F.col("word") * BITS + F.col("bit")).alias("number")).agg(F.sum("n").alias("n"))
    return filters.join(sums, "number", "left").select(
        "filter_name",
        severity_list_text(F.coalesce("severity", F.array().cast("array<int>"))).alias("severity_labels"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("finding_count"),
    )
