"""Two-level totals for sunburst charts: a root and its children."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breachlens.functions.scalars import ROOT_COLOR, severity_color, short_label
from breachlens.operators.filters import FilterSpec
from breachlens.plans.summaries import severity_totals
from breachlens.plans.tops import TOP, top_ports, top_vulnerabilities
from breachlens.sources.tables import Tables

# Names of the roots.
SEVERITY_ROOT = "Total"
VULNERABILITY_ROOT = "Most Occurent 10 Vulnerabilities"
PORT_ROOT = "Most Used 10 Ports"
# End of fixed values.


def severity_hierarchy(tables: Tables, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """The four levels above informational, and their total."""
    totals = severity_totals(tables, spec).filter(F.col("severity").between(1, 4))
    is_root = F.grouping("severity") == 1
    return (
        totals.rollup("severity")
        .agg(
            F.when(is_root, F.lit(SEVERITY_ROOT)).otherwise(F.max("severity_name")).alias("label"),
            F.when(is_root, F.lit("")).otherwise(F.lit(SEVERITY_ROOT)).alias("parent"),
            F.sum("finding_count").alias("value"),
            F.when(is_root, F.lit(ROOT_COLOR)).otherwise(F.max("color")).alias("color"),
        )
        .orderBy(F.desc_nulls_first("severity"))
        .drop("severity")
    )


def top_vulnerability_hierarchy(
    tables: Tables, spec: FilterSpec = FilterSpec(), k: int = TOP
) -> DataFrame:
    """The top vulnerabilities under one root; nothing at all if there are none."""
    # A window without partition, over no more than k rows.
    order = Window.orderBy(
        F.desc("finding_count"), "folder_name", "scan_name", "vulnerability_name", "severity"
    )
    ranked = top_vulnerabilities(tables, spec, k).withColumn("rank", F.row_number().over(order) - 1)
    name = F.max("vulnerability_name")
    is_root = F.grouping("rank") == 1

    def root_or(root, child):
        return F.when(is_root, F.lit(root)).otherwise(child)

    return (
        ranked.rollup("rank")
        .agg(
            root_or(VULNERABILITY_ROOT, F.concat(F.lit("vuln_"), F.col("rank").cast("string"))).alias("id"),
            root_or(VULNERABILITY_ROOT, short_label(name)).alias("label"),
            root_or("", F.lit(VULNERABILITY_ROOT)).alias("parent"),
            F.sum("finding_count").alias("value"),
            root_or(ROOT_COLOR, severity_color(F.max("severity"))).alias("color"),
            root_or(VULNERABILITY_ROOT, name).alias("full_name"),
        )
        .orderBy(F.asc_nulls_first("rank"))
        .drop("rank")
    )


def top_port_hierarchy(
    tables: Tables, spec: FilterSpec = FilterSpec(), k: int = TOP
) -> DataFrame:
    """The top ports under one root, which is there even if there are none."""
    # The empty row makes the root exist and adds nothing to it.
    none = tables.spark.range(1).select(
        F.lit(None).cast("string").alias("port"), F.lit(0).cast("bigint").alias("finding_count")
    )
    ports = top_ports(tables, spec, k).unionByName(none)
    is_root = F.grouping("port") == 1
    rows = ports.rollup("port").agg(
        F.when(is_root, F.lit(PORT_ROOT)).otherwise(F.concat(F.lit("port_"), "port")).alias("id"),
        F.when(is_root, F.lit(PORT_ROOT)).otherwise(F.concat(F.lit("Port "), "port")).alias("label"),
        F.when(is_root, F.lit("")).otherwise(F.lit(PORT_ROOT)).alias("parent"),
        F.sum("finding_count").alias("value"),
    )
    # Top ports are never NULL, so the only row without an id is the empty one's.
    return rows.filter(F.col("id").isNotNull()).orderBy(F.desc("value"), "port").drop("port")
