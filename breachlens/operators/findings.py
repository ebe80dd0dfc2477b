"""The rows that reports are made of: latest runs, their hosts, findings and outputs.

All reports look at the latest run of each scan. Their rows are, in effect, hosts
left-joined to findings, plugins and outputs, and then filtered. Written that way the
large side of the outer join cannot be split when one key is hot, so the same rows
are built here from inner joins plus, where a report needs them, the host rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachlens.operators.filters import FilterSpec
from breachlens.operators.sizing import broadcast_if, fits_broadcast
from breachlens.schemas import HOST_KEY
from breachlens.sources.tables import Tables


def latest_runs(scan_run: DataFrame) -> DataFrame:
    """The run with the highest id of every scan, its start, and its load if that is known."""
    kept = [c for c in ("scan_start", LOAD) if c in scan_run.columns]
    return scan_run.groupBy("scan_id").agg(
        F.max("scan_run_id").alias("scan_run_id"),
        *[F.max_by(c, "scan_run_id").alias(c) for c in kept],
    )


#: Numbers of a bitmap, which takes 4 KB, and how many bitmaps may be broadcast: 64 MB.
BITS, BITMAPS = 32_768, 16_384

# The column that tables of our own store are partitioned by.
LOAD = "load_id"


@dataclass(frozen=True)
class Scope:
    """What a filter leaves of the latest runs, and of the hosts in them."""

    tables: Tables
    spec: FilterSpec
    runs: DataFrame
    few_runs: bool

    @cached_property
    def bitmaps(self) -> DataFrame | None:
        """The runs in scope as bitmaps of BITS numbers each, or None if the numbers of all runs
        spread over more than BITMAPS of them, which would be too much to broadcast."""
        bucket = F.bitmap_bucket_number("scan_run_id")
        span = self.tables.scan_run.agg(F.min(bucket).alias("low"), F.max(bucket).alias("high")).first()
        if span.low is None or span.high - span.low >= BITMAPS:
            return None
        return self.runs.groupBy(bucket.alias("run_bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("scan_run_id")).alias("run_bits")
        )

    def prune(self, df: DataFrame) -> DataFrame:
        """Drop the rows of other runs before any shuffle.

        Where the runs themselves can be broadcast, they are, with their loads, so that other
        loads are not even read. Else they are broadcast as bitmaps, which take one bit for each
        number between the lowest and the highest run, and no row but those of runs in scope is
        shuffled. Only if run numbers are spread too far for that are all rows kept; then
        the join with the hosts drops them, as a shuffle by run alone would cost as much, and
        one run may hold a large share of all rows.
        """
        if "scan_run_id" not in df.columns:
            return df
        if not self.few_runs:
            return self._by_bitmaps(df)
        key = [c for c in (LOAD, "scan_run_id") if c in df.columns and c in self.runs.columns]
        runs = self.runs.select(*key)
        if LOAD in key:
            # All loads pass. Spark skips partitions only for the sake of a side that is filtered.
            runs = runs.filter(F.col(LOAD) >= 0)
        return df.join(F.broadcast(runs), key, "left_semi")

    def _by_bitmaps(self, df: DataFrame) -> DataFrame:
        if self.bitmaps is None:
            return df
        at = F.bitmap_bit_position("scan_run_id").cast("int")
        byte = F.conv(F.hex(F.substring("run_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.expr("run_byte").bitwiseAND(F.expr("shiftleft(1, run_bit)")) != 0
        met = df.withColumn("run_bucket", F.bitmap_bucket_number("scan_run_id")).join(F.broadcast(self.bitmaps), "run_bucket")
        found = met.withColumns({"run_byte": byte, "run_bit": at.bitwiseAND(F.lit(7))}).filter(bit)
        return found.select(*df.columns)

    @cached_property
    def hosts(self) -> DataFrame:
        """Hosts that pass the filters on scans and addresses, with their scan."""
        hosts = self.prune(self.tables.host).select(*HOST_KEY, "host_ip", "host_fqdn")
        condition = self.spec.host_condition("host_ip")
        if condition is not None:
            hosts = hosts.filter(condition)
        return hosts.join(broadcast_if(self.runs.drop(LOAD), self.few_runs), "scan_run_id")


def scope(tables: Tables, spec: FilterSpec, folder: str | None = None) -> Scope:
    """`folder` is how scans meet their folder: 'left', 'inner', or not at all."""
    scans = tables.scan.select("scan_id", "folder_id", F.col("name").alias("scan_name"))
    # A scan has one latest run, so the runs are no more than the scans.
    few_runs = fits_broadcast(scans)
    condition = spec.scan_condition("scan_name")
    if condition is not None:
        scans = scans.filter(condition)
    runs = latest_runs(tables.scan_run).join(scans, "scan_id")
    columns = [*([LOAD] if LOAD in runs.columns else []), "scan_run_id", "scan_start", "scan_name"]
    if folder:
        folders = tables.folder.select("folder_id", F.col("name").alias("folder_name"))
        runs = runs.join(folders, "folder_id", folder)
        columns.append("folder_name")
    return Scope(tables, spec, runs.select(*columns), few_runs)


def _key_columns(sc: Scope) -> list[str]:
    return list(dict.fromkeys((*sc.tables.finding_key, *HOST_KEY, "plugin_id")))


def outputs(sc: Scope, *columns: str) -> DataFrame:
    """Outputs of the runs in scope that pass the port filter: finding key and `columns`."""
    found = sc.prune(matching_outputs(sc.tables, sc.spec))
    return found.select(*sc.tables.finding_key, *columns)


def matching_outputs(tables: Tables, spec: FilterSpec) -> DataFrame:
    """All outputs that pass the port filter, by the stored port number where there is one."""
    found = tables.vuln_output
    stored = F.col("port_number") if "port_number" in found.columns else None
    condition = spec.port_condition("port", stored)
    return found if condition is None else found.filter(condition)


def located_findings(sc: Scope, match_ports: bool = True) -> DataFrame:
    """One row per finding on a host in scope, before its plugin is known."""
    found = sc.prune(sc.tables.host_vuln).select(*_key_columns(sc))
    found = found.join(sc.hosts, list(HOST_KEY))
    if sc.spec.port and match_ports:
        # distinct() merges a finding's outputs before the shuffle the join needs anyway.
        matching = outputs(sc).distinct()
        found = found.join(matching, list(sc.tables.finding_key), "left_semi")
    return found


def with_plugin(df: DataFrame, sc: Scope, *columns: str, required: bool = False) -> DataFrame:
    """Add plugin columns, and apply the filters on plugins.

    Findings whose plugin is missing stay, with NULLs, unless a filter or `required`
    asks for the plugin. The plugin is on the right side, so that a hot plugin's
    findings can be split.
    """
    wanted = dict.fromkeys(("plugin_id", "severity", "name", *columns))
    plugins = sc.tables.plugin.select(*wanted, F.col("plugin_id").alias("known_plugin_id"))
    condition = sc.spec.plugin_condition("severity", "name")
    if condition is not None:
        plugins = plugins.filter(condition)
    how = "inner" if required or condition is not None else "left"
    return df.join(plugins, "plugin_id", how)


def findings(sc: Scope, *columns: str, required: bool = False, match_ports: bool = True) -> DataFrame:
    """One row per finding in scope that passes all filters."""
    return with_plugin(located_findings(sc, match_ports), sc, *columns, required=required)


def idle_hosts(sc: Scope) -> DataFrame:
    """Hosts in scope without any finding."""
    busy = sc.prune(sc.tables.host_vuln).select(*HOST_KEY).distinct()
    return sc.hosts.join(busy, list(HOST_KEY), "left_anti")


def with_outputs(found: DataFrame, sc: Scope, *columns: str) -> DataFrame:
    """One row per finding and output; a finding without output keeps one row.

    An outer join could not split a finding that has a large share of all outputs.
    The inner join can, as outputs are its left side, and the findings it leaves out
    are added.
    """
    key = list(sc.tables.finding_key)
    rows = outputs(sc, *columns).join(found, key)
    if sc.spec.port:
        return rows
    silent = found.join(outputs(sc).distinct(), key, "left_anti")
    return rows.unionByName(silent, allowMissingColumns=True)
