"""Totals per scan, per severity and per host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachlens.functions.scalars import SEVERITIES, severity_dim
from breachlens.operators.filters import FilterSpec
from breachlens.operators.findings import (
    Scope, findings, idle_hosts, located_findings, outputs, scope, with_plugin,
)
from breachlens.plans.tops import merged_case
from breachlens.sources.tables import Tables

TOTALS = {level: f"total_{name.lower()}" for level, _, name, _ in SEVERITIES}


def sums_by_severity(weight: str, names: dict[int, str]):
    """One sum of `weight` per severity level; 0 where there is nothing to add."""
    return [
        F.expr(f"sum(if(severity = {level}, {weight}, 0))").alias(name)
        for level, name in names.items()
    ]


def _with_hosts(found: DataFrame, sc: Scope) -> DataFrame:
    """Let hosts without a matching finding count, unless a filter is on findings."""
    if sc.spec.on_finding:
        return found
    hosts = sc.hosts.select(*[c for c in found.columns if c in sc.hosts.columns])
    return found.unionByName(hosts, allowMissingColumns=True)


def _summary(found: DataFrame, sc: Scope, merge_case: bool) -> DataFrame:
    columns = ["scan_name", "folder_name", "host_ip", "scan_start", "severity", "weight"]
    rows = _with_hosts(found.select(*columns), sc)
    group = ["scan_name", "folder_name"]
    shown = []
    if merge_case:
        rows = rows.withColumns({f"{c}_key": F.lower(c) for c in group})
        shown = [F.min(c).alias(c) for c in group]
        group = [f"{c}_key" for c in group]
    # Distinct addresses by grouping twice: COUNT(DISTINCT) next to sums would copy rows.
    per_address = rows.groupBy(*group, "host_ip").agg(
        *shown, F.max("scan_start").alias("scan_start"), *sums_by_severity("weight", TOTALS)
    )
    per_scan = per_address.groupBy(*group).agg(
        *shown,
        F.timestamp_seconds(F.max("scan_start")).alias("last_scan_date"),
        F.count("host_ip").alias("total_hosts"),
        *[F.sum(name).alias(name) for name in TOTALS.values()],
    )
    return ordered_summary(
        per_scan.select("scan_name", "folder_name", "last_scan_date", "total_hosts", *TOTALS.values()),
        sc.spec,
    )


def ordered_summary(summary: DataFrame, spec: FilterSpec) -> DataFrame:
    """By the total of the highest level filtered for, else newest first."""
    chosen = [TOTALS[level] for level in TOTALS if level in spec.severity]
    if spec.severity and not chosen:
        first = []
    else:
        first = [F.desc(chosen[0] if chosen else "last_scan_date")]
    return summary.orderBy(*first, "scan_name", "folder_name")


def scan_summary(tables: Tables, spec: FilterSpec = FilterSpec(), merge_case: bool = False) -> DataFrame:
    """Per scan name and folder: last run, hosts, and findings per severity.

    Scans with equal names in one folder are merged; with `merge_case` names that
    differ only in case are, too.
    """
    sc = scope(tables, spec, folder="left")
    return _summary(findings(sc).withColumn("weight", F.lit(1)), sc, merge_case)


def scan_summary_rows(
    tables: Tables, spec: FilterSpec = FilterSpec(), merge_case: bool = False
) -> DataFrame:
    """As scan_summary, but a finding counts once per output, and once without any."""
    sc = scope(tables, spec, folder="left")
    key = list(tables.finding_key)
    per_finding = outputs(sc).groupBy(*key).agg(F.count("*").alias("weight"))
    how = "inner" if spec.port else "left"
    found = findings(sc, match_ports=False).join(per_finding, key, how)
    return _summary(found.withColumn("weight", F.coalesce("weight", F.lit(1))), sc, merge_case)


def severity_distribution(tables: Tables, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Findings per severity. Findings without a known plugin form the NULL group."""
    sc = scope(tables, spec)
    per_plugin = located_findings(sc).groupBy("plugin_id").agg(F.count("*").alias("n"))
    counted = with_plugin(per_plugin, sc).select("severity", "n")
    if not spec.on_finding:
        # A host without findings makes the NULL group exist, with nothing to count.
        none = idle_hosts(sc).select(F.lit(None).cast("int").alias("severity"), F.lit(0).alias("n"))
        counted = counted.unionByName(none.limit(1))
    return counted.groupBy("severity").agg(F.sum("n").alias("finding_count"))


def severity_totals(tables: Tables, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Findings for each of the five levels, 0 included, highest first."""
    return all_levels(severity_distribution(tables, spec))


def all_levels(counts: DataFrame) -> DataFrame:
    return (
        severity_dim(counts.sparkSession)
        .join(counts, "severity", "left")
        .withColumn("finding_count", F.coalesce("finding_count", F.lit(0)))
        .orderBy(F.desc("severity"))
    )


HOST_COUNTS = {level: f"{name.lower()}_count" for level, _, name, _ in SEVERITIES}


def host_report(
    tables: Tables, spec: FilterSpec = FilterSpec(), merge_case: bool = False
) -> DataFrame:
    """Findings per severity of every host of a filed scan, newest run first."""
    sc = scope(tables, spec, folder="inner")
    group = ["host_ip", "host_fqdn", "scan_name", "folder_name", "scan_start"]
    found = findings(sc).select(*group, "severity", F.lit(1).alias("weight"))
    counted = merged_case(
        _with_hosts(found, sc), group[:4], group[4:], *sums_by_severity("weight", HOST_COUNTS),
        F.count("weight").alias("total_vulnerabilities"), merge=merge_case,
    )
    order = [F.desc("scan_start"), F.desc("total_vulnerabilities"), *group[:4]]
    return counted.orderBy(*order).select(
        *group[:4],
        F.timestamp_seconds("scan_start").alias("last_scan_date"),
        *HOST_COUNTS.values(),
        "total_vulnerabilities",
    )
