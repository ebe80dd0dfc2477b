"""Totals per scan and per severity from partial sums, so that a refresh reads no finding.

What a run adds to the totals does not change once it is loaded, but for the severity of its
plugins, which later loads may change. So a load keeps, for every run, the findings of each plugin
and the addresses of its hosts. A report merges these over the latest runs: its work
grows with the plugins and addresses of a run, not with its findings and outputs.

They answer reports without filters, or with one on scan names; those on severities and
vulnerability names too where only findings are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachlens.operators.filters import FilterSpec
from breachlens.operators.findings import LOAD, Scope, scope, with_plugin
from breachlens.operators.partials import Partials
from breachlens.operators.sizing import broadcast_if
from breachlens.plans.summaries import TOTALS, all_levels, ordered_summary, sums_by_severity
from breachlens.sources.tables import Tables

def answers(spec: FilterSpec, hosts: bool) -> bool:
    """Whether partial sums can answer a report; `hosts` is whether it counts hosts."""
    return not (spec.ip_address or spec.port or (hosts and spec.on_plugin))


def _refuse(spec: FilterSpec, hosts: bool) -> None:
    if not answers(spec, hosts):
        raise ValueError("partial sums cannot answer these filters")


def _of_runs(df: DataFrame, sc: Scope) -> DataFrame:
    """With the latest runs' columns; partitions of other loads are skipped."""
    runs = sc.runs if LOAD in df.columns else sc.runs.drop(LOAD)
    if LOAD in runs.columns:
        runs = runs.filter(F.col(LOAD) >= 0)
    key = [c for c in (LOAD, "scan_run_id") if c in runs.columns]
    return df.join(broadcast_if(runs, sc.few_runs), key)


def scan_summary(tables: Tables, parts: Partials, spec: FilterSpec = FilterSpec(), by_rows: bool = False) -> DataFrame:
    """As summaries.scan_summary or, `by_rows`, scan_summary_rows. Of `tables` only folders, scans,
    runs and plugins are read."""
    _refuse(spec, hosts=True)
    sc = scope(tables, spec, folder="left")
    group = ["scan_name", "folder_name"]
    weight = "n_rows" if by_rows else "n_findings"
    per_plugin = _of_runs(parts.run_plugin, sc).groupBy(*group, "plugin_id").agg(F.sum(weight).alias("weight"))
    found = with_plugin(per_plugin, sc).groupBy(*group).agg(*sums_by_severity("weight", TOTALS))
    addresses = _of_runs(parts.run_address, sc).groupBy(*group, "host_ip").agg(F.max("scan_start").alias("scan_start"))
    hosts = addresses.groupBy(*group).agg(F.max("scan_start").alias("scan_start"), F.count("host_ip").alias("total_hosts"))
    both = hosts.unionByName(found, allowMissingColumns=True).groupBy(*group).agg(
        F.timestamp_seconds(F.max("scan_start")).alias("last_scan_date"), F.max("total_hosts").alias("total_hosts"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in TOTALS.values()],
    )
    return ordered_summary(both, spec)


def severity_distribution(tables: Tables, parts: Partials, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """As summaries.severity_distribution."""
    _refuse(spec, hosts=False)
    sc = scope(tables, spec)
    per_plugin = _of_runs(parts.run_plugin, sc).groupBy("plugin_id").agg(F.sum("n_findings").alias("n"))
    counted = with_plugin(per_plugin, sc).select("severity", "n")
    if not spec.on_finding:
        idle = _of_runs(parts.run_address, sc).filter("n_idle > 0")
        none = idle.select(F.lit(None).cast("int").alias("severity"), F.lit(0).cast("bigint").alias("n"))
        counted = counted.unionByName(none.limit(1))
    return counted.groupBy("severity").agg(F.sum("n").alias("finding_count"))


def severity_totals(tables: Tables, parts: Partials, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """As summaries.severity_totals."""
    return all_levels(severity_distribution(tables, parts, spec))
