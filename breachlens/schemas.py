"""The data model: seven tables, their keys, and the JSON payloads they are loaded from."""

from __future__ import annotations

COUNT_COLUMNS = ("critical_count", "high_count", "medium_count", "low_count", "info_count")
_COUNTS = ", ".join(f"{name} BIGINT" for name in COUNT_COLUMNS)

TABLES = {
    "folder": "folder_id INT, type STRING, name STRING",
    "scan": "scan_id BIGINT, folder_id INT, type STRING, name STRING",
    "scan_run": "scan_run_id BIGINT, scan_id BIGINT, scan_start BIGINT, scan_end BIGINT, "
    f"targets STRING, host_count BIGINT, {_COUNTS}",
    "host": "host_id BIGINT, scanner_host_id BIGINT, scan_run_id BIGINT, scan_id BIGINT, "
    f"host_ip STRING, host_fqdn STRING, host_start STRING, host_end STRING, os STRING, {_COUNTS}",
    "host_vuln": "host_vuln_id BIGINT, scanner_host_id BIGINT, scan_run_id BIGINT, plugin_id BIGINT",
    "plugin": "plugin_id BIGINT, severity INT, name STRING, family STRING, synopsis STRING, "
    "description STRING, solution STRING, cvss_base_score DOUBLE, cvss3_base_score DOUBLE, "
    "cvss_vector STRING, cvss3_vector STRING, ref STRING, pub_date STRING, mod_date STRING",
    "vuln_output": "vuln_output_id BIGINT, host_vuln_id BIGINT, scanner_host_id BIGINT, "
    "scan_run_id BIGINT, plugin_id BIGINT, output_no INT, port STRING, port_number DOUBLE, "
    "output STRING",
}

#: Findings of a plugin in a run, and rows of these joined with their outputs; hosts of an address
#: in a run, and how many of them have no finding.
PARTIALS = {
    "run_plugin": "scan_run_id BIGINT, plugin_id BIGINT, n_findings BIGINT, n_rows BIGINT",
    "run_address": "scan_run_id BIGINT, host_ip STRING, n_hosts BIGINT, n_idle BIGINT",
}

# One host row per host and run, one finding per host, run and plugin.
HOST_KEY = ("scan_run_id", "scanner_host_id")
NATURAL_FINDING_KEY = (*HOST_KEY, "plugin_id")


def finding_key(output_columns: list[str]) -> tuple[str, ...]:
    """How outputs refer to their finding.

    Our own store keeps the natural key on every output. It cannot collide, and it
    lets outputs be cut to the latest runs before any shuffle. Tables that carry
    only the single id are joined on that.
    """
    if set(NATURAL_FINDING_KEY) <= set(output_columns):
        return NATURAL_FINDING_KEY
    return ("host_vuln_id",)


def primary_keys(key: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
    natural = key == NATURAL_FINDING_KEY
    return {
        "folder": ("folder_id",),
        "scan": ("scan_id",),
        "scan_run": ("scan_run_id",),
        "host": HOST_KEY,
        "host_vuln": key,
        "plugin": ("plugin_id",),
        "vuln_output": (*key, "output_no", "port") if natural else ("vuln_output_id",),
    }


def foreign_keys(key: tuple[str, ...]) -> dict[str, tuple[str, tuple[str, ...], str]]:
    """Constraint name -> (child table, shared columns, parent table)."""
    return {
        "scan_folder": ("scan", ("folder_id",), "folder"),
        "scan_run_scan": ("scan_run", ("scan_id",), "scan"),
        "host_scan": ("host", ("scan_id",), "scan"),
        "host_scan_run": ("host", ("scan_run_id",), "scan_run"),
        "host_vuln_host": ("host_vuln", ("scanner_host_id",), "host"),
        "host_vuln_scan_run": ("host_vuln", ("scan_run_id",), "scan_run"),
        "host_vuln_plugin": ("host_vuln", ("plugin_id",), "plugin"),
        "vuln_output_host_vuln": ("vuln_output", key, "host_vuln"),
    }


_VULNERABILITIES = "vulnerabilities ARRAY<STRUCT<severity: INT, count: BIGINT, plugin_id: BIGINT>>"

PAYLOADS = {
    "folders": "folders ARRAY<STRUCT<id: INT, type: STRING, name: STRING>>",
    "scans": "scans ARRAY<STRUCT<id: BIGINT, folder_id: INT, type: STRING, name: STRING>>",
    "history": "history ARRAY<STRUCT<history_id: BIGINT, creation_date: BIGINT, status: STRING>>",
    "run": "info STRUCT<scanner_start: BIGINT, scanner_end: BIGINT, targets: STRING, "
    f"hostcount: BIGINT>, {_VULNERABILITIES}, hosts ARRAY<STRUCT<host_id: BIGINT>>",
    "host": "info STRUCT<`host-ip`: STRING, `host-fqdn`: STRING, host_start: STRING, "
    f"host_end: STRING, `operating-system`: STRING>, {_VULNERABILITIES}",
    # Port names are data, so they must be a map: inference would make them columns.
    "finding": "info STRUCT<plugindescription: STRUCT<pluginid: BIGINT, severity: INT, "
    "pluginname: STRING, pluginfamily: STRING, pluginattributes: STRUCT<synopsis: STRING, "
    "description: STRING, solution: STRING, see_also: ARRAY<STRING>, "
    "risk_information: STRUCT<cvss_base_score: STRING, cvss3_base_score: STRING, "
    "cvss_vector: STRING, cvss3_vector: STRING>, "
    "plugin_information: STRUCT<plugin_publication_date: STRING, "
    "plugin_modification_date: STRING>>>>, "
    "outputs ARRAY<STRUCT<plugin_output: STRING, "
    "ports: MAP<STRING, ARRAY<STRUCT<hostname: STRING>>>>>",
}

# The ids of the request a payload answers; payloads do not repeat them.
REQUEST_IDS = {
    "folders": (),
    "scans": (),
    "history": ("scan_id",),
    "run": ("scan_id", "history_id"),
    "host": ("scan_id", "history_id", "host_id"),
    "finding": ("scan_id", "history_id", "host_id", "plugin_id"),
}
