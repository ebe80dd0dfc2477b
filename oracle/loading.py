"""Expected results of the loading operators, checks and streams."""

from oracle.domain import over

_HISTORY = """
    SELECT o_custkey AS scan_id, o_orderkey AS history_id, CAST(epoch(o_orderdate) AS BIGINT) AS creation_date,
           CASE WHEN o_orderstatus = 'P' THEN 'running' ELSE 'completed' END AS status
    FROM orders"""

_NEWEST = """
    SELECT scan_id, history_id, creation_date, status FROM history
    QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY creation_date DESC, history_id DESC) = 1"""

_NEW = """
    SELECT scan_id, history_id FROM newest
    WHERE status = 'completed'
      AND history_id NOT IN (SELECT scan_run_id FROM scan_run WHERE scan_run_id % 2 = 0)"""

# Two entries per finding payload: its own hits, and one hit one level up.
_ENTRIES = """
    SELECT scan_run_id, scanner_host_id, severity, 1 + plugin_id % 3 AS n
    FROM host_vuln JOIN plugin USING (plugin_id)
    UNION ALL
    SELECT scan_run_id, scanner_host_id, (severity + 1) % 5, 1
    FROM host_vuln JOIN plugin USING (plugin_id)"""


def _counts(key: str) -> str:
    names = {4: "critical", 3: "high", 2: "medium", 1: "low", 0: "info"}
    sums = ", ".join(
        f"CAST(COALESCE(SUM(n) FILTER (WHERE severity = {level}), 0) AS BIGINT) AS {name}_count"
        for level, name in names.items()
    )
    return over(f"SELECT {key}, {sums} FROM entries GROUP BY {key}", entries=_ENTRIES)


_FOLDERS = {
    "stored": "SELECT folder_id, type, name FROM folder WHERE folder_id < 15",
    "feed": """SELECT folder_id, type, CASE WHEN folder_id % 4 = 0 THEN name || '*' ELSE name END AS name
               FROM folder WHERE folder_id >= 10""",
}
_SCANS = {
    "stored": "SELECT * FROM scan WHERE scan_id % 3 <> 0",
    "feed": """SELECT scan_id, CASE WHEN scan_id % 7 = 1 THEN NULL ELSE folder_id END AS folder_id, type,
                      CASE WHEN scan_id % 5 = 0 THEN name || '*' ELSE name END AS name
               FROM scan""",
}


def _upsert(key: str, parts: dict[str, str]) -> str:
    return over(f"""
        SELECT * FROM feed UNION ALL SELECT * FROM stored WHERE {key} NOT IN (SELECT {key} FROM feed)""",
        **parts)


def _metrics(key: str, columns: list[str], parts: dict[str, str]) -> str:
    same = " AND ".join(f"s.{c} IS NOT DISTINCT FROM f.{c}" for c in columns)
    return over(f"""
        SELECT CASE WHEN s.{key} IS NULL THEN 'inserted' WHEN {same} THEN 'same' ELSE 'changed' END AS status,
               COUNT(*) AS n
        FROM feed f LEFT JOIN stored s ON s.{key} = f.{key} GROUP BY 1""", **parts)


_PLUGIN_UPSERT = """
    WITH steps AS (
        SELECT DISTINCT user_id AS plugin_id, CAST(-1 AS BIGINT) AS seq, 'click' AS mod_date,
               CAST(0 AS DOUBLE) AS payload
        FROM events WHERE user_id % 2 = 0
        UNION ALL
        SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, value
        FROM events),
    marked AS (
        SELECT *, lag(mod_date) OVER w AS before, row_number() OVER w AS place
        FROM steps WINDOW w AS (PARTITION BY plugin_id ORDER BY seq))
    SELECT plugin_id, mod_date, payload FROM marked
    WHERE place = 1 OR mod_date IS DISTINCT FROM before
    QUALIFY row_number() OVER (PARTITION BY plugin_id ORDER BY seq DESC) = 1"""

_REFERENCES = {
    "scan_folder": ("scan", "folder_id", "folder"),
    "scan_run_scan": ("scan_run", "scan_id", "scan"),
    "host_scan": ("host", "scan_id", "scan"),
    "host_scan_run": ("host", "scan_run_id", "scan_run"),
    "host_vuln_host": ("host_vuln", "scanner_host_id", "host"),
    "host_vuln_scan_run": ("host_vuln", "scan_run_id", "scan_run"),
    "host_vuln_plugin": ("host_vuln", "plugin_id", "plugin"),
}

_KEYS = {
    "folder": "folder_id",
    "scan": "scan_id",
    "scan_run": "scan_run_id",
    "host": "scan_run_id, scanner_host_id",
    "host_vuln": "scan_run_id, scanner_host_id, plugin_id",
    "plugin": "plugin_id",
    "vuln_output": "scan_run_id, scanner_host_id, plugin_id, output_no, port",
}


# What a loading pass over the landed test tables stores: of each scan outside of the skipped
# folders the newest run, if it is completed and all its findings have a known plugin.
_KEPT = {
    "kept_scan": """
        SELECT s.* FROM scan s LEFT JOIN folder f ON f.folder_id = s.folder_id
        WHERE COALESCE(f.name NOT IN ('NATION_3', 'NATION_12', 'NATION_99'), TRUE)""",
    "history": _HISTORY,
    "newest": _NEWEST,
    "due": """SELECT scan_id, history_id AS scan_run_id FROM newest
              WHERE status = 'completed' AND scan_id IN (SELECT scan_id FROM kept_scan)""",
    "broken": "SELECT DISTINCT scan_run_id FROM host_vuln WHERE plugin_id NOT IN (SELECT plugin_id FROM plugin)",
    "kept": "SELECT * FROM due WHERE scan_run_id NOT IN (SELECT scan_run_id FROM broken)",
    "hits": """SELECT scan_run_id, scanner_host_id, severity, 1 + plugin_id % 3 AS n
               FROM host_vuln JOIN plugin USING (plugin_id)""",
}


def _hits(key: str) -> str:
    names = {4: "critical", 3: "high", 2: "medium", 1: "low", 0: "info"}
    sums = ", ".join(
        f"CAST(COALESCE(SUM(n) FILTER (WHERE severity = {level}), 0) AS BIGINT) AS {name}_count"
        for level, name in names.items()
    )
    return f"SELECT {key}, {sums} FROM hits GROUP BY {key}"


_NAMES = ["critical_count", "high_count", "medium_count", "low_count", "info_count"]
_ZEROED = ", ".join(f"COALESCE({name}, 0) AS {name}" for name in _NAMES)


def _stored() -> dict[str, str]:
    return {
        "loaded_folders": "SELECT * FROM folder WHERE name NOT IN ('NATION_3', 'NATION_12', 'NATION_99')",
        "loaded_scans": "SELECT * FROM kept_scan",
        "loaded_runs": f"""
            SELECT scan_run_id, r.scan_id, scan_start, scan_end, targets, host_count, {_ZEROED}
            FROM kept JOIN scan_run r USING (scan_run_id)
            JOIN (SELECT scan_run_id, COUNT(*) AS host_count FROM host GROUP BY scan_run_id) USING (scan_run_id)
            LEFT JOIN ({_hits("scan_run_id")}) USING (scan_run_id)""",
        "loaded_hosts": f"""
            SELECT scanner_host_id, scan_run_id, h.scan_id, host_ip, host_fqdn, {_ZEROED}
            FROM kept JOIN host h USING (scan_run_id)
            LEFT JOIN ({_hits("scan_run_id, scanner_host_id")}) USING (scan_run_id, scanner_host_id)""",
        "loaded_findings": "SELECT scanner_host_id, scan_run_id, plugin_id FROM host_vuln JOIN kept USING (scan_run_id)",
        "loaded_plugins": """
            SELECT plugin_id, CAST(severity AS INTEGER) AS severity, name, family, synopsis,
                   COALESCE(description, '') AS description, solution, cvss3_base_score, ref, mod_date
            FROM plugin WHERE plugin_id IN (SELECT plugin_id FROM host_vuln JOIN kept USING (scan_run_id))""",
        "loaded_outputs": r"""
            SELECT scanner_host_id, scan_run_id, plugin_id,
                   CAST(CASE WHEN plugin_id % 3 = 2 THEN output_no ELSE 0 END AS INTEGER) AS output_no, port,
                   CAST(regexp_extract(port, '^\d+') AS DOUBLE) AS port_number,
                   'output ' || CAST(output_no AS VARCHAR) AS output
            FROM vuln_output JOIN kept USING (scan_run_id) WHERE port IS NOT NULL""",
        # A run without hosts was not answered.
        "rejected_runs": """
            SELECT scan_run_id FROM due WHERE scan_run_id IN (SELECT scan_run_id FROM broken)
               OR scan_run_id NOT IN (SELECT scan_run_id FROM host)""",
    }


def _seen(stored: dict[str, str]) -> str:
    """Names in the merged tables, and rows per run in the others."""
    of = {"folder": "folders", "scan": "scans", "plugin": "plugins"}
    merged = [
        f"SELECT '{t}' AS table_name, CAST({t}_id AS BIGINT) AS key, name AS seen FROM ({stored[f'loaded_{rows}']})"
        for t, rows in of.items()
    ]
    of = {"scan_run": "runs", "host": "hosts", "host_vuln": "findings", "vuln_output": "outputs"}
    growing = [
        f"SELECT '{t}', scan_run_id, CAST(COUNT(*) AS VARCHAR) FROM ({stored[f'loaded_{rows}']}) GROUP BY scan_run_id"
        for t, rows in of.items()
    ]
    return " UNION ALL ".join([*merged, *growing])


def _ids(stored: dict[str, str]) -> str:
    of = {"host_id": "hosts", "host_vuln_id": "findings", "vuln_output_id": "outputs"}
    return " UNION ALL ".join(
        f"SELECT '{i}' AS id, COUNT(*) AS n_rows, COUNT(*) AS n_ids, 0 AS n_collisions FROM ({stored[f'loaded_{rows}']})"
        for i, rows in of.items()
    )


def loading() -> dict[str, str]:
    orphans = [
        f"""SELECT '{name}' AS constraint_name, CAST({column} AS VARCHAR) AS key_value, COUNT(*) AS n
            FROM {child} WHERE {column} NOT IN (SELECT {column} FROM {parent}) GROUP BY {column}"""
        for name, (child, column, parent) in _REFERENCES.items()
    ]
    orphans.append("""
        SELECT 'vuln_output_host_vuln', CAST(host_vuln_id AS VARCHAR), COUNT(*) FROM vuln_output
        WHERE host_vuln_id NOT IN (SELECT host_vuln_id FROM host_vuln) GROUP BY host_vuln_id""")
    duplicates = [
        f"""SELECT '{table}' AS table_name, CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) AS n_keys,
                   COUNT(*) FILTER (WHERE n > 1) AS n_duplicate_keys
            FROM (SELECT COUNT(*) AS n FROM {table} GROUP BY {key})"""
        for table, key in _KEYS.items()
    ]
    runs = {"history": _HISTORY, "newest": _NEWEST}
    return {
        "fk_orphans": over(" UNION ALL ".join(orphans)),
        "pk_duplicates": over(" UNION ALL ".join(duplicates)),
        "ingest_run_counts": _counts("scan_run_id"),
        "ingest_host_counts": _counts("scan_run_id, scanner_host_id"),
        "ingest_ports": over(r"""
            SELECT scanner_host_id, scan_run_id, plugin_id,
                   CAST(regexp_extract(port, '^\d+') AS DOUBLE) AS port_number,
                   CAST(CASE WHEN plugin_id % 3 = 2 THEN output_no ELSE 0 END AS INTEGER) AS output_no,
                   port, 'output ' || CAST(output_no AS VARCHAR) AS output
            FROM vuln_output WHERE port IS NOT NULL"""),
        "ingest_metrics": over("""
            SELECT 'folders' AS stage, COUNT(*) AS n FROM folder
            UNION ALL SELECT 'scans', COUNT(*) FROM scan
            UNION ALL SELECT 'chosen_runs', COUNT(*) FROM chosen""", **runs, chosen=_NEW),
        "newest_run": over("SELECT * FROM newest", **runs),
        "newest_completed_run": over("SELECT * FROM newest WHERE status = 'completed'", **runs),
        "new_runs_only": over(_NEW, **runs),
        "skip_folders": over("""
            SELECT s.* FROM scan s LEFT JOIN folder f ON f.folder_id = s.folder_id
            WHERE COALESCE(f.name NOT IN ('NATION_3', 'NATION_12', 'NATION_99'), TRUE)"""),
        "upsert_folder": _upsert("folder_id", _FOLDERS),
        "upsert_folder_metrics": _metrics("folder_id", ["type", "name"], _FOLDERS),
        "upsert_scan": _upsert("scan_id", _SCANS),
        "upsert_scan_metrics": _metrics("scan_id", ["folder_id", "type", "name"], _SCANS),
        "plugin_upsert": _PLUGIN_UPSERT,
        **{name: over(sql, **_KEPT) for name, sql in _stored().items()},
        "after_a_broken_load": over(_seen(_stored()), **_KEPT),
        "surrogate_keys": over(_ids(_stored()), **_KEPT),
        "stream_latest_run": over(
            "SELECT scan_id, MAX(scan_run_id) AS scan_run_id FROM scan_run GROUP BY scan_id"
        ),
        "stream_severity_counts": over("""
            SELECT severity, CAST(SUM(1 + l_partkey % 3) AS BIGINT) AS n
            FROM lineitem JOIN plugin ON plugin_id = l_partkey WHERE l_quantity > 5 GROUP BY severity"""),
        "stream_new_runs": over(_NEW, **runs),
        "stream_loaded_runs": over(_stored()["loaded_runs"], **_KEPT),
    }
