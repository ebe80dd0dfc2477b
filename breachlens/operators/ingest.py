"""From scanner payloads to table rows. Each function is one projection or one join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breachlens.functions.scalars import port_number, reference_list
from breachlens.schemas import COUNT_COLUMNS, REQUEST_IDS


def _with_landing(payload: DataFrame) -> list[str]:
    return ["landed_at"] if "landed_at" in payload.columns else []


def folders(payload: DataFrame) -> DataFrame:
    found = payload.select(F.inline("folders"), *_with_landing(payload))
    return found.select(F.col("id").alias("folder_id"), "type", "name", *_with_landing(payload))


def scans(payload: DataFrame) -> DataFrame:
    """The listed scans; `position` is their place in the list."""
    landed = _with_landing(payload)
    return payload.select(F.posexplode("scans").alias("position", "scan"), *landed).select(
        F.col("scan.id").alias("scan_id"), "scan.folder_id", "scan.type", "scan.name", "position", *landed
    )


def history(payload: DataFrame) -> DataFrame:
    """One row per known run. A scan without history has none."""
    return payload.select("scan_id", F.inline("history"), *_with_landing(payload))


def newest_listed(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows that were listed several times the newest listing, without its time; of equal
    times the largest row."""
    if "landed_at" not in rows.columns:
        return rows
    others = [c for c in rows.columns if c not in (*key, "landed_at")]
    newest = F.max(F.struct("landed_at", *others)).alias("newest")
    return rows.groupBy(*key).agg(newest).select(*key, *[f"newest.{c}" for c in others])


def asked_again(payload: DataFrame, *request: str) -> bool:
    """Whether some request has several answers. Looks at requests alone."""
    return not payload.groupBy(*request).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def newest_payloads(payload: DataFrame, *request: str) -> DataFrame:
    """Of several answers to one request the newest; of equal times the largest text.

    Requests and times are counted without the answers. Only answers to requests that
    have several are shuffled and compared.
    """
    if "landed_at" not in payload.columns:
        return payload
    asked = payload.groupBy(*request).agg(F.max("landed_at").alias("newest"), F.count("*").alias("answers"))
    again = asked.filter("answers > 1").drop("answers")
    others = [c for c in payload.columns if c not in (*request, "landed_at")]
    once = payload.join(again.select(*request), list(request), "left_anti")
    newest = payload.join(again, list(request)).filter(F.col("landed_at") == F.col("newest"))
    place = Window.partitionBy(*request).orderBy(F.desc("text"))
    newest = newest.withColumn("text", F.to_json(F.struct(*others))).withColumn("place", F.row_number().over(place))
    columns = [*request, *others]
    return once.select(*columns).union(newest.filter("place = 1").select(*columns))


def severity_counts(vulnerabilities="vulnerabilities") -> Column:
    """Hits per severity in one payload, as a struct. Adds the `count` fields, not the entries;
    the entries are gone through once."""
    start = F.struct(*[F.lit(0).cast("bigint").alias(name) for name in COUNT_COLUMNS])

    def add(sofar, v):
        return F.struct(*[
            F.when(v["severity"] == 4 - i, sofar[name] + v["count"]).otherwise(sofar[name]).alias(name)
            for i, name in enumerate(COUNT_COLUMNS)
        ])

    entries = F.col(vulnerabilities)
    return F.coalesce(F.aggregate(entries, start, add), start).alias("hits")


def count_severities(payload: DataFrame, *key: str) -> DataFrame:
    """Hits per severity over all payloads of a run or host."""
    hits = payload.select(*key, severity_counts())
    return hits.groupBy(*key).agg(*[F.sum(f"hits.{name}").alias(name) for name in COUNT_COLUMNS])


def skip_folders(folder_rows: DataFrame, names: list[str]) -> DataFrame:
    """Drop folders by name. A folder without a name is kept."""
    return folder_rows.filter(F.coalesce(~F.col("name").isin(*names), F.lit(True)))


def skip_scans(scan_rows: DataFrame, folder_rows: DataFrame, names: list[str]) -> DataFrame:
    """Drop the scans of skipped folders. A scan in no known folder is kept."""
    skipped = folder_rows.filter(F.col("name").isin(*names)).select("folder_id").distinct()
    return scan_rows.join(skipped, "folder_id", "left_anti").select(*scan_rows.columns)


def newest_runs(history_rows: DataFrame) -> DataFrame:
    """The newest run of every scan, in the state it was last listed in; equal dates go to the
    higher id."""
    history_rows = newest_listed(history_rows, "scan_id", "history_id")
    newest = F.max(F.struct("creation_date", "history_id", "status"))
    return history_rows.groupBy("scan_id").agg(newest.alias("newest")).select("scan_id", "newest.*")


def completed_runs(newest: DataFrame) -> DataFrame:
    """Only of newest runs: an unfinished newest run hides the finished ones before it."""
    return newest.filter(F.col("status") == "completed")


def unloaded_runs(runs: DataFrame, loaded: DataFrame) -> DataFrame:
    return runs.join(
        loaded.select(F.col("scan_run_id").alias("history_id")), "history_id", "left_anti"
    ).select(*runs.columns)


def run_rows(payload: DataFrame) -> DataFrame:
    return payload.select("*", severity_counts()).select(
        F.col("history_id").alias("scan_run_id"),
        "scan_id",
        F.col("info.scanner_start").alias("scan_start"),
        F.col("info.scanner_end").alias("scan_end"),
        "info.targets",
        F.col("info.hostcount").alias("host_count"),
        "hits.*",
    )


def surrogate_key(*natural: str) -> Column:
    """A single-column id for tools that want one; joins use the natural key.

    64 bits can collide among billions of rows, which key_collisions() finds.
    """
    return F.xxhash64(*natural)


def host_rows(payload: DataFrame) -> DataFrame:
    rows = payload.select("*", severity_counts()).select(
        F.col("host_id").alias("scanner_host_id"),
        F.col("history_id").alias("scan_run_id"),
        "scan_id",
        F.col("info.host-ip").alias("host_ip"),
        F.col("info.host-fqdn").alias("host_fqdn"),
        "info.host_start",
        "info.host_end",
        F.col("info.operating-system").alias("os"),
        "hits.*",
    )
    return rows.select(surrogate_key("scan_run_id", "scanner_host_id").alias("host_id"), "*")


def finding_rows(payload: DataFrame) -> DataFrame:
    """One row per host payload entry; `position` is its place in the list."""
    rows = payload.select(
        F.col("host_id").alias("scanner_host_id"),
        F.col("history_id").alias("scan_run_id"),
        F.posexplode("vulnerabilities").alias("position", "v"),
    ).select("scanner_host_id", "scan_run_id", F.col("v.plugin_id").alias("plugin_id"), "position")
    key = surrogate_key("scan_run_id", "scanner_host_id", "plugin_id")
    return rows.select(key.alias("host_vuln_id"), "*")


def plugin_rows(payload: DataFrame) -> DataFrame:
    """The plugin version each finding payload carries, with the ids of its request."""
    plugin = F.col("info.plugindescription")
    attributes = plugin["pluginattributes"]
    risk, versions = attributes["risk_information"], attributes["plugin_information"]
    return payload.select(
        F.col("host_id").alias("scanner_host_id"),
        F.col("history_id").alias("scan_run_id"),
        F.col("plugin_id").alias("requested_plugin_id"),
        plugin["pluginid"].alias("plugin_id"),
        plugin["severity"].alias("severity"),
        plugin["pluginname"].alias("name"),
        plugin["pluginfamily"].alias("family"),
        attributes["synopsis"].alias("synopsis"),
        attributes["description"].alias("description"),
        attributes["solution"].alias("solution"),
        risk["cvss_base_score"].try_cast("double").alias("cvss_base_score"),
        risk["cvss3_base_score"].try_cast("double").alias("cvss3_base_score"),
        risk["cvss_vector"].alias("cvss_vector"),
        risk["cvss3_vector"].alias("cvss3_vector"),
        reference_list(attributes["see_also"]).alias("ref"),
        versions["plugin_publication_date"].alias("pub_date"),
        versions["plugin_modification_date"].alias("mod_date"),
    )


def output_rows(payload: DataFrame) -> DataFrame:
    """One row per output and port of a finding. An output without ports has none."""
    # The outer form, as Spark adds a test of the array's size to the other one, for which
    # it would parse payloads that come as text a second time.
    rows = payload.select(
        F.col("host_id").alias("scanner_host_id"),
        F.col("history_id").alias("scan_run_id"),
        "plugin_id",
        F.posexplode_outer("outputs").alias("output_no", "o"),
    ).select(
        "scanner_host_id", "scan_run_id", "plugin_id", "output_no",
        F.explode(F.map_keys("o.ports")).alias("port"),
        F.col("o.plugin_output").alias("output"),
    )
    finding = ("scan_run_id", "scanner_host_id", "plugin_id")
    return rows.select(
        surrogate_key(*finding, "output_no", "port").alias("vuln_output_id"),
        surrogate_key(*finding).alias("host_vuln_id"),
        "*",
        port_number("port").alias("port_number"),
    )


_ENTRIES = "vulnerabilities"
_PLUGIN = "info.plugindescription"

# Fields without which a payload cannot be loaded.
REQUIRED = {
    "run": ["info.scanner_start", "info.scanner_end", "info.targets", "info.hostcount", _ENTRIES, "hosts"],
    "host": ["info.host-ip", _ENTRIES],
    "finding": [
        f"{_PLUGIN}.pluginid", f"{_PLUGIN}.severity", f"{_PLUGIN}.pluginname", f"{_PLUGIN}.pluginfamily",
        *[f"{_PLUGIN}.pluginattributes.{name}" for name in (
            "synopsis", "description", "solution", "risk_information", "plugin_information",
        )],
        "outputs",
    ],
}


def _missing(kind: str) -> Column:
    """The first required field a payload lacks, or NULL."""
    tests = [F.when(F.col(path).isNull(), F.lit(path)) for path in REQUIRED[kind]]
    if kind in ("run", "host"):
        incomplete = F.exists(
            _ENTRIES,
            lambda v: v["severity"].isNull() | ~v["severity"].between(0, 4) | v["count"].isNull()
            | (v["plugin_id"].isNull() if kind == "host" else F.lit(False)),
        )
        tests.append(F.when(incomplete, F.lit(f"{_ENTRIES}[]")))
    return F.coalesce(*tests)


def split_required(payload: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(complete payloads, rejected requests with the missing field as reason)."""
    reason = _missing(kind)
    request = [
        (F.col(name) if name in REQUEST_IDS[kind] else F.lit(None).cast("bigint")).alias(name)
        for name in REQUEST_IDS["finding"]
    ]
    rejects = payload.select(F.lit(kind).alias("payload"), *request, reason.alias("reason"))
    return payload.filter(reason.isNull()), rejects.filter(F.col("reason").isNotNull())


def unanswered(run: DataFrame, host: DataFrame, finding: DataFrame) -> DataFrame:
    """Hosts and findings that are listed but whose payload is not there."""
    listed_hosts = run.select("scan_id", "history_id", F.explode("hosts.host_id").alias("host_id"))
    listed = host.select(
        "scan_id", "history_id", "host_id", F.explode(f"{_ENTRIES}.plugin_id").alias("plugin_id")
    )
    no_host = listed_hosts.join(
        host.select("history_id", "host_id").distinct(), ["history_id", "host_id"], "left_anti"
    )
    no_finding = listed.join(
        finding.select("history_id", "host_id", "plugin_id").distinct(),
        ["history_id", "host_id", "plugin_id"], "left_anti",
    )
    kinds = {"host": no_host, "finding": no_finding}
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumns({"payload": F.lit(k), "reason": F.lit("no answer")}) for k, df in kinds.items()],
    ).select("payload", *REQUEST_IDS["finding"], "reason")


def ingest_metrics(**stages: DataFrame) -> DataFrame:
    """How many rows each stage of a loading pass has."""
    counted = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
        for name, df in stages.items()
    ]
    return reduce(DataFrame.unionByName, counted)
