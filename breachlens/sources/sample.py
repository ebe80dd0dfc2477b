"""The star-schema test tables seen as scan data.

Every frame reads the given parquet files with an explicit schema, so that building
a report starts no job, and leaves pruning and pushdown to Catalyst.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from breachlens.sources.tables import LazyTables, Tables

SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE",
    "events": "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE",
}


def path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(path(sf_dir, name))


def folder(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return nations.join(read(spark, sf_dir, "region"), "r_regionkey").selectExpr(
        "n_nationkey AS folder_id", "r_name AS type", "n_name AS name"
    )


def scan(spark, sf_dir):
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS scan_id",
        "if(c_custkey % 17 = 0, NULL, c_nationkey) AS folder_id",
        "c_mktsegment AS type",
        "c_mktsegment || '-' || (c_custkey % 40) AS name",
    )


def scan_run(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS scan_run_id",
        "o_custkey AS scan_id",
        "unix_timestamp(o_orderdate) AS scan_start",
        "unix_timestamp(o_orderdate) + 3600 AS scan_end",
        "o_orderpriority AS targets",
    )


#: What a host's address and name are made of.
ADDRESS = {
    "host_ip": "'10.0.' || (scanner_host_id % 4) || '.' || (scanner_host_id % 250)",
    "host_fqdn": "if(scanner_host_id % 9 = 0, NULL, 'h' || scanner_host_id || '.example.org')",
}


def lines(spark, sf_dir):
    """The lines of all runs: hosts, plugins, and whether the plugin is a finding there."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS scan_run_id", "l_suppkey AS scanner_host_id", "l_partkey AS plugin_id", "l_quantity > 5 AS is_finding"
    )


def host(spark, sf_dir):
    """Joined before made distinct: both then need the lines of a run together."""
    lines = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS scan_run_id", "l_suppkey AS scanner_host_id"
    )
    runs = scan_run(spark, sf_dir).select("scan_run_id", "scan_id")
    return lines.join(runs, "scan_run_id").distinct().selectExpr(
        "scanner_host_id",
        "scan_run_id",
        "scan_id",
        *[f"{text} AS {name}" for name, text in ADDRESS.items()],
    )


def host_vuln(spark, sf_dir):
    return (
        read(spark, sf_dir, "lineitem")
        .filter("l_quantity > 5")
        .selectExpr("l_suppkey AS scanner_host_id", "l_orderkey AS scan_run_id", "l_partkey AS plugin_id")
        .distinct()
    )


def plugin(spark, sf_dir):
    return read(spark, sf_dir, "part").filter("p_partkey % 50 <> 0").selectExpr(
        "p_partkey AS plugin_id",
        "p_size % 5 AS severity",
        "p_name || ' #' || (p_partkey % 100) AS name",
        "p_type AS family",
        "p_brand AS synopsis",
        "if(p_partkey % 13 = 0, NULL, 'About ' || p_name) AS description",
        "'Fix ' || p_brand AS solution",
        "CAST(NULL AS DOUBLE) AS cvss_base_score",
        "if(p_size % 7 = 0, NULL, CAST(p_size % 11 AS DOUBLE)) AS cvss3_base_score",
        "CAST(NULL AS STRING) AS cvss_vector",
        "CAST(NULL AS STRING) AS cvss3_vector",
        "if(p_partkey % 3 = 0, NULL, 'http://a/' || p_partkey || '\\n \\nhttp://b/' || p_brand) AS ref",
        "CAST(NULL AS STRING) AS pub_date",
        "CAST(2000 + p_size % 20 AS STRING) AS mod_date",
    )


# The outputs of a finding: number, condition on its plugin, port.
OUTPUTS = (
    (0, "plugin_id % 3 >= 1", """CASE plugin_id % 6 WHEN 0 THEN '443 / tcp / www'
        WHEN 1 THEN '22 / tcp / ssh' WHEN 2 THEN '0 / tcp' WHEN 3 THEN '80 / tcp / www'
        WHEN 4 THEN '8080' ELSE '445 / tcp / cifs' END"""),
    (1, "plugin_id % 3 = 2", """CASE plugin_id % 4 WHEN 0 THEN '3389 / tcp'
        WHEN 1 THEN '161 / udp / snmp' WHEN 2 THEN '0 / icmp' END"""),
)


def vuln_output(spark, sf_dir):
    """A union and no explode: filters and semi-joins go through it to the scans."""
    first, second = (
        host_vuln(spark, sf_dir).filter(condition).selectExpr(
            "scanner_host_id", "scan_run_id", "plugin_id", f"{number} AS output_no", f"{port} AS port"
        )
        for number, condition, port in OUTPUTS
    )
    return first.unionByName(second)


def load(spark: SparkSession, sf_dir: str) -> Tables:
    makers = (folder, scan, scan_run, host, host_vuln, plugin, vuln_output)
    return LazyTables({make.__name__: partial(make, spark, sf_dir) for make in makers})


# Feeds for the loading operators.

# Orders as the run history of scans; a P means the run is not over.
HISTORY = (
    "o_custkey AS scan_id",
    "o_orderkey AS history_id",
    "unix_timestamp(o_orderdate) AS creation_date",
    "if(o_orderstatus = 'P', 'running', 'completed') AS status",
)


def history(spark, sf_dir):
    """All known runs of every scan, finished or not."""
    return read(spark, sf_dir, "orders").selectExpr(*HISTORY)


def vulnerability_counts(spark, sf_dir):
    """What a scanner reports for each finding: a severity and a number of hits."""
    known = plugin(spark, sf_dir).select("plugin_id", "severity")
    return host_vuln(spark, sf_dir).join(known, "plugin_id").selectExpr(
        "scan_run_id", "scanner_host_id", "plugin_id", "severity", "1 + plugin_id % 3 AS n"
    )


def plugin_feed(spark, sf_dir):
    """Plugin versions in order of arrival."""
    return read(spark, sf_dir, "events").selectExpr(
        "user_id AS plugin_id",
        "event_id AS seq",
        "if(event_type = 'error', NULL, event_type) AS mod_date",
        "value AS payload",
    )


def plugin_stored(spark, sf_dir):
    """Plugin versions held before the feed arrives."""
    events = read(spark, sf_dir, "events").filter("user_id % 2 = 0")
    return events.selectExpr("user_id AS plugin_id").distinct().selectExpr(
        "plugin_id", "'click' AS mod_date", "0D AS payload"
    )


def folder_stored(spark, sf_dir):
    return folder(spark, sf_dir).filter("folder_id < 15")


def folder_feed(spark, sf_dir):
    """Overlaps what is stored: some folders are new, some renamed, some unchanged."""
    return folder(spark, sf_dir).filter("folder_id >= 10").selectExpr(
        "folder_id", "type", "if(folder_id % 4 = 0, name || '*', name) AS name"
    )


def scan_stored(spark, sf_dir):
    """The scans known before the feed; every third one is new in the feed."""
    return scan(spark, sf_dir).filter("scan_id % 3 <> 0")


def scan_feed(spark, sf_dir):
    """All scans; some have lost their folder, some have a new name."""
    return scan(spark, sf_dir).selectExpr(
        "scan_id",
        "if(scan_id % 7 = 1, NULL, folder_id) AS folder_id",
        "type",
        "if(scan_id % 5 = 0, name || '*', name) AS name",
    )
