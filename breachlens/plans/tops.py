"""The most frequent vulnerabilities and ports, and lists of names and ports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachlens.functions.scalars import severity_label, usable_port, vulnerability_name
from breachlens.operators.filters import FilterSpec
from breachlens.operators.findings import (
    LOAD, idle_hosts, located_findings, outputs, scope, with_plugin,
)
from breachlens.operators.sizing import FEW_ROWS, broadcast_if
from breachlens.schemas import HOST_KEY
from breachlens.sources.tables import Tables

TOP = 10


def merged_case(df: DataFrame, texts: list[str], others: list[str], *counts: Column, merge: bool = True) -> DataFrame:
    """Group by texts and other columns; with `merge`, texts that differ only in case are one,
    shown as the smallest of them."""
    if not merge:
        return df.groupBy(*texts, *others).agg(*counts)
    keys = {c: f"{c}_key" for c in texts}
    grouped = df.withColumns({key: F.lower(c) for c, key in keys.items()}).groupBy(*keys.values(), *others)
    return grouped.agg(*[F.min(c).alias(c) for c in texts], *counts).drop(*keys.values())


def top_vulnerabilities(
    tables: Tables, spec: FilterSpec = FilterSpec(), k: int = TOP, merge_case: bool = False
) -> DataFrame:
    """The vulnerabilities with most findings per filed scan.

    Findings are counted per plugin before plugins are joined. Ties are cut by the
    full group key. With `merge_case` names that differ only in case are one.
    """
    sc = scope(tables, spec, folder="inner")
    scan = ["folder_name", "scan_name"]
    per_plugin = located_findings(sc).groupBy(*scan, "plugin_id").agg(F.count("*").alias("n"))
    named = with_plugin(per_plugin, sc).select(*scan, "known_plugin_id", "name", "severity", "n")
    if not spec.on_finding:
        # Scans that have a host without findings show up with an unknown one, counted 0.
        none = idle_hosts(sc).select(*scan).distinct().withColumn("n", F.lit(0).cast("bigint"))
        named = named.unionByName(none, allowMissingColumns=True)
    group = [*scan, "known_plugin_id", "name", "severity"]
    return (
        merged_case(
            named, [*scan, "name"], ["known_plugin_id", "severity"], F.sum("n").alias("finding_count"), merge=merge_case
        )
        .orderBy(F.desc("finding_count"), *group)
        .limit(k)
        .select(
            *scan,
            vulnerability_name("name").alias("vulnerability_name"),
            "severity",
            severity_label().alias("severity_text"),
            "finding_count",
        )
    )


def port_counts(tables: Tables, spec: FilterSpec = FilterSpec(), merge_case: bool = False) -> DataFrame:
    """Findings per port text. A finding counts once per port, however many outputs."""
    sc = scope(tables, spec)
    key = list(tables.finding_key)
    found = located_findings(sc, match_ports=False)
    if spec.on_plugin:
        found = with_plugin(found, sc)
    shown = outputs(sc, "port").filter(F.col("port").isNotNull())
    shown = shown.join(found.select(*key), key, "left_semi")
    per_finding = merged_case(shown, ["port"], key, F.count("*").alias("n")) if merge_case else shown.distinct()
    return merged_case(per_finding, ["port"], [], F.count("*").alias("finding_count"), merge=merge_case)


def top_ports(
    tables: Tables, spec: FilterSpec = FilterSpec(), k: int = TOP, merge_case: bool = False
) -> DataFrame:
    return port_counts(tables, spec, merge_case).orderBy(F.desc("finding_count"), "port").limit(k)


def scan_names(tables: Tables, merge_case: bool = False) -> DataFrame:
    """Names of the scans that have a run."""
    started = tables.scan_run.select("scan_id").distinct()
    names = tables.scan.join(started, "scan_id", "left_semi").select(F.col("name").alias("scan_name"))
    return _distinct(names, "scan_name", merge_case).orderBy("scan_name")


def _distinct(df: DataFrame, column: str, merge_case: bool) -> DataFrame:
    if not merge_case:
        return df.select(column).distinct()
    return merged_case(df, [column], [], F.count("*").alias("n")).select(column)


#: An address of at most so many hosts, counted once for each run, is looked up by their keys, and if
#: they are in at most so many runs, by these in the files.
KEYS, RUNS = 10_000, 100


def of_address(tables: Tables, ip_address: str) -> tuple[DataFrame, DataFrame]:
    """(findings, outputs) that may belong to exactly this address, in any run, found by look-up.

    The hosts come first: their files tell by Bloom filters whether they have the address. If there
    are few, the numbers of their loads and runs go to the files of findings and outputs, so
    that partitions and row groups without them are skipped, and no other row is shuffled. If
    there are more, their keys are broadcast as long as their number allows it.

    Tables that are not of our own store have no such files. Their findings are joined with the
    hosts, without a look-up, and all outputs are returned.
    """
    hosts = tables.host.filter(F.col("host_ip") == ip_address)
    loads = [LOAD] if all(LOAD in df.columns for df in (tables.host, tables.host_vuln, tables.vuln_output)) else []
    keys = hosts.select(*loads, *HOST_KEY).distinct()
    if not loads:
        return tables.host_vuln.join(keys, list(HOST_KEY), "left_semi"), tables.vuln_output
    first = keys.limit(KEYS + 1).collect()
    known = len(first) <= KEYS
    few = known or keys.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    if known:
        keys = tables.spark.createDataFrame(first, keys.schema)

    def of_hosts(df: DataFrame) -> DataFrame:
        if known:
            for column in (LOAD, "scan_run_id"):
                values = sorted({r[column] for r in first})
                if column == LOAD or len(values) <= RUNS:
                    df = df.filter(F.col(column).isin(values))
        # All loads pass. Spark skips partitions only for the sake of a side that is filtered.
        return df.join(broadcast_if(keys.filter(F.col(LOAD) >= 0), few), [LOAD, *HOST_KEY], "left_semi")

    return of_hosts(tables.host_vuln), of_hosts(tables.vuln_output)


def ip_ports(tables: Tables, ip_address: str, merge_case: bool = False) -> DataFrame:
    """All ports ever seen on exactly this address, in any run, in text order."""
    key = list(tables.finding_key)
    found, shown = of_address(tables, ip_address)
    ports = shown.select(*key, "port").join(found.select(*key), key, "left_semi")
    return _distinct(ports, "port", merge_case).orderBy("port")


def usable_ip_ports(tables: Tables, ip_address: str) -> DataFrame:
    """The ports of an address without missing ones and placeholders."""
    return ip_ports(tables, ip_address).filter(usable_port(F.col("port")))
