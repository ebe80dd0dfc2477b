"""Many saved filters answered in one pass over the findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachlens.functions.links import build_link, parse_link
from breachlens.functions.scalars import severity_list_text
from breachlens.operators.filters import FilterSpec
from breachlens.operators.findings import findings, outputs, scope
from breachlens.sources.tables import Tables


def saved_filter_counts(tables: Tables, filters: dict[str, FilterSpec]) -> DataFrame:
    """Findings that pass each filter.

    The findings are read once, and each filter is one conditional count over them, so
    findings are not paired with filters. Conditions on ports look at all outputs of a
    finding and are settled per finding first.
    """
    sc = scope(tables, FilterSpec())
    key = list(tables.finding_key)
    found = findings(sc)
    port_flags = {
        f"port_{i}": spec.port_condition("port") for i, spec in enumerate(filters.values()) if spec.port
    }
    if port_flags:
        flags = outputs(sc, "port").groupBy(*key).agg(
            *[F.max(condition).alias(name) for name, condition in port_flags.items()]
        )
        found = found.join(flags, key, "left")

    counts = []
    for i, spec in enumerate(filters.values()):
        conditions = [
            spec.scan_condition("scan_name"),
            spec.host_condition("host_ip"),
            spec.plugin_condition("severity", "name"),
            F.col(f"port_{i}") if spec.port else None,
        ]
        passed = reduce(Column.__and__, [c for c in conditions if c is not None], F.lit(True))
        counts.append(F.count_if(passed).alias(f"n_{i}"))
    rows = [
        F.struct(
            F.lit(name).alias("filter_name"),
            severity_list_text(F.lit(list(spec.severity)).cast("array<int>")).alias("severity_labels"),
            F.col(f"n_{i}").alias("finding_count"),
        )
        for i, (name, spec) in enumerate(filters.items())
    ]
    return found.agg(*counts).select(F.inline(F.array(*rows)))


def link_table(filters: DataFrame) -> DataFrame:
    """A link for every row of filter columns; `severity` is an array of levels."""
    link = build_link(
        F.col("severity"), F.col("scan_name"), F.col("vulnerability_name"),
        F.col("ip_address"), F.col("port"),
    )
    return filters.withColumn("link", link)


def parsed_links(links: DataFrame, column: str = "link") -> DataFrame:
    """The filters that each link carries, and its severities in words."""
    parsed = links.withColumn("parsed", parse_link(F.col(column)))
    return parsed.select(
        *links.columns, "parsed.*", severity_list_text(F.col("parsed.severity")).alias("severity_labels")
    )
