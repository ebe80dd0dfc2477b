"""What each run adds to the totals of reports, summed up once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachlens.schemas import HOST_KEY, NATURAL_FINDING_KEY, finding_key


@dataclass(frozen=True)
class Partials:
    run_plugin: DataFrame
    run_address: DataFrame


def partials(host: DataFrame, host_vuln: DataFrame, vuln_output: DataFrame) -> Partials:
    """The partial sums of some runs, of which all hosts, findings and outputs are given."""
    hosts = host.select(*HOST_KEY, "host_ip")
    key = list(finding_key(vuln_output.columns))
    found = host_vuln.select(*dict.fromkeys((*key, *NATURAL_FINDING_KEY))).join(hosts.select(*HOST_KEY), list(HOST_KEY), "left_semi")
    # Rows of an outer join with the outputs, without that join: every finding once, and each
    # output after the first once more. All are sums, so a plugin on every host is no hot key.
    outputs = vuln_output.select(*key).groupBy(*key).agg(F.count("*").alias("n"))
    several = outputs.filter("n > 1").join(found, key).groupBy("scan_run_id", "plugin_id").agg(F.sum(F.col("n") - 1).alias("more"))
    counted = found.groupBy("scan_run_id", "plugin_id").agg(F.count("*").alias("n_findings"))
    # By union, as an outer join could not be split at a run with very many plugins.
    both = counted.withColumn("more", F.lit(0).cast("bigint")).unionByName(
        several.withColumn("n_findings", F.lit(0).cast("bigint"))
    )
    run_plugin = both.groupBy("scan_run_id", "plugin_id").agg(
        F.sum("n_findings").alias("n_findings"), (F.sum("n_findings") + F.sum("more")).alias("n_rows")
    )
    busy = found.select(*HOST_KEY).distinct()
    idle = hosts.join(busy, list(HOST_KEY), "left_anti").select("scan_run_id", "host_ip", F.lit(1).alias("idle"))
    run_address = hosts.select("scan_run_id", "host_ip", F.lit(0).alias("idle")).unionAll(idle).groupBy(
        "scan_run_id", "host_ip"
    ).agg(F.count_if(F.col("idle") == 0).alias("n_hosts"), F.sum("idle").alias("n_idle"))
    return Partials(run_plugin, run_address)
