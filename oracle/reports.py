"""Expected results of the reports and of the filters."""

from oracle.domain import COLOR, DOMAIN, LABEL, LEVELS, at, over, turkish_date

# The filters used by the registered queries, as conditions on the fact rows.
FILTERS = {
    "filter_severity": "severity IN (3, 4)",
    "filter_severity_zero": "severity IN (0)",
    "filter_scan_name": "scan_name ILIKE '%build%'",
    "filter_vuln_name": "plugin_name ILIKE '%WIDGET #_%'",
    "filter_ip": "host_ip ILIKE '%10.0.1.%'",
    "filter_port": "(port_number = 22 OR port_number BETWEEN 400 AND 500)",
    "filter_all": "severity IN (3, 4) AND scan_name ILIKE '%-1%' AND plugin_name ILIKE '%a%' "
    "AND host_ip ILIKE '%10.0%' AND port_number BETWEEN 1 AND 500",
}


def _levels(count: str) -> str:
    names = {4: "critical", 3: "high", 2: "medium", 1: "low", 0: "info"}
    return ", ".join(count.format(level=level, name=name) for level, name in names.items())


def summary(where: str = "TRUE", rows: bool = False) -> str:
    per_level = (
        "CAST(SUM(CASE WHEN severity = {level} THEN 1 ELSE 0 END) AS BIGINT) AS total_{name}"
        if rows
        else "COUNT(DISTINCT host_vuln_id) FILTER (WHERE severity = {level}) AS total_{name}"
    )
    return over(f"""
        SELECT scan_name, folder_name, {at("MAX(scan_start)")} AS last_scan_date,
               COUNT(DISTINCT host_ip) AS total_hosts, {_levels(per_level)}
        FROM fact WHERE {where} GROUP BY scan_name, folder_name""")


def distribution(where: str = "TRUE") -> str:
    return over(f"""
        SELECT severity, COUNT(DISTINCT host_vuln_id) AS finding_count
        FROM fact WHERE {where} GROUP BY severity""")


_TOP_VULNERABILITIES = """
    SELECT folder_name, scan_name, COALESCE(plugin_name, 'Bilinmeyen Zafiyet') AS vulnerability_name,
           severity, COUNT(DISTINCT host_vuln_id) AS finding_count
    FROM fact WHERE folder_name IS NOT NULL AND {where}
    GROUP BY folder_name, scan_name, plugin_id, plugin_name, severity
    ORDER BY finding_count DESC, folder_name NULLS FIRST, scan_name NULLS FIRST,
             plugin_id NULLS FIRST, plugin_name NULLS FIRST, severity NULLS FIRST
    LIMIT 10"""

_TOP_PORTS = """
    SELECT port, COUNT(DISTINCT host_vuln_id) AS finding_count
    FROM fact WHERE port IS NOT NULL AND {where}
    GROUP BY port ORDER BY finding_count DESC, port LIMIT 10"""


def top_vulnerabilities(where: str = "TRUE") -> str:
    top = _TOP_VULNERABILITIES.format(where=where)
    return over(f"SELECT *, {LABEL} AS severity_text FROM ({top})")


def top_ports(where: str = "TRUE") -> str:
    return over(_TOP_PORTS.format(where=where))


_TOTALS = f"""
    SELECT l.severity, severity_text, severity_name, color, COALESCE(n, 0) AS finding_count
    FROM {LEVELS} LEFT JOIN
         (SELECT severity, COUNT(DISTINCT host_vuln_id) AS n FROM fact GROUP BY severity) c
         ON c.severity = levels.severity""".replace("l.severity", "levels.severity", 1)

_DETAIL = f"""
    SELECT scan_name, host_ip, host_fqdn, COALESCE(plugin_name, 'Bilinmeyen Zafiyet') AS vulnerability_name,
           severity, {LABEL} AS severity_text, family AS plugin_family, port, cvss3_base_score,
           {at("scan_start")} AS scan_date, {turkish_date(at("scan_start"))} AS scan_date_text,
           description, solution, CAST(NULL AS VARCHAR) AS cvss3_vector, ref,
           CAST(NULL AS VARCHAR) AS pub_date, mod_date, plugin_id, host_vuln_id, scan_start
    FROM fact WHERE plugin_id IS NOT NULL AND {{where}}
    ORDER BY severity DESC, scan_start DESC, host_vuln_id, port NULLS FIRST"""

_PAGED = "scan_name, host_ip, host_fqdn, vulnerability_name, severity, severity_text, port"
_BASE = """scan_name, host_ip, host_fqdn, vulnerability_name, severity, severity_text, plugin_family,
    port, cvss3_base_score, scan_date, scan_date_text"""
_EXTENDED = f"{_BASE}, description, solution, cvss3_vector, ref, pub_date, mod_date, plugin_id"


def detail(columns: str = _BASE, where: str = "TRUE") -> str:
    return over(f"SELECT {columns} FROM ({_DETAIL.format(where=where)} LIMIT 1000)")


_SEARCHED = [
    "scan_name", "host_ip", "host_fqdn", "vulnerability_name", "severity", "severity_text",
    "plugin_family", "port", "cvss3_base_score", "scan_date_text", "description", "solution",
    "ref", "mod_date", "plugin_id",
]


def search(term: str, limit: int | None = None) -> str:
    """The term is looked for in all rows; a limit keeps the first hits."""
    hit = " OR ".join(f"COALESCE(contains(lower(CAST({c} AS VARCHAR)), '{term}'), FALSE)" for c in _SEARCHED)
    kept = f"LIMIT {limit}" if limit else ""
    return over(f"""
        SELECT {_EXTENDED} FROM (SELECT * FROM ({_DETAIL.format(where="TRUE")}) WHERE {hit}
        ORDER BY severity DESC, scan_start DESC, host_vuln_id, port NULLS FIRST {kept})""")


_PORTS_OF_IP = """
    SELECT DISTINCT port FROM host JOIN host_vuln USING (scan_run_id, scanner_host_id)
    JOIN vuln_output USING (host_vuln_id) WHERE host_ip = '10.0.1.1'"""


def _band(missing: str, values: tuple[str, str, str, str]) -> str:
    critical, high, medium, low = values
    return f"""CASE WHEN cvss3_base_score IS NULL THEN '{missing}'
        WHEN cvss3_base_score >= 9 THEN '{critical}' WHEN cvss3_base_score >= 7 THEN '{high}'
        WHEN cvss3_base_score >= 4 THEN '{medium}' ELSE '{low}' END"""


_BANDS = ("critical", "high", "medium", "low")
_COLORS = ("#e74c3c", "#e67e22", "#f1c40f", "#2ecc71")

_SAVED = {
    "critical_or_high": ("severity IN (4, 3)", "Kritik, Yüksek"),
    "informational": ("severity IN (0)", "Bilgi"),
    "office_scans": ("scan_name ILIKE '%furn%'", ""),
    "widgets_on_web": ("plugin_name ILIKE '%widget%' AND port_number IN (80, 443)", ""),
    "subnet_two": ("host_ip ILIKE '%10.0.2.%'", ""),
    "all_conditions": (FILTERS["filter_all"], "Yüksek, Kritik"),
    "everything": ("TRUE", ""),
}


# Tables in which every third scan's name, and every other run's ports, are in the other case.
_MIXED = {
    "scan": f"""SELECT * REPLACE (CASE WHEN scan_id % 3 = 0 THEN lower(name) ELSE name END AS name)
                FROM ({DOMAIN["scan"]})""",
    "vuln_output": f"""SELECT * REPLACE (CASE WHEN scan_run_id % 2 = 0 THEN upper(port) ELSE port END AS port)
                       FROM ({DOMAIN["vuln_output"]})""",
}


def _merged_case() -> dict[str, str]:
    """Texts that differ only in case are one group, shown as the smallest of them."""
    distinct = "COUNT(DISTINCT host_vuln_id) FILTER (WHERE severity = {level}) AS "
    found = {
        "scan_summary_merge_case": f"""
            SELECT MIN(scan_name) AS scan_name, MIN(folder_name) AS folder_name,
                   {at("MAX(scan_start)")} AS last_scan_date, COUNT(DISTINCT host_ip) AS total_hosts,
                   {_levels(distinct + "total_{name}")}
            FROM fact GROUP BY lower(scan_name), lower(folder_name)""",
        "top_vulnerabilities_merge_case": f"""
            SELECT *, {LABEL} AS severity_text FROM (
                SELECT MIN(folder_name) AS folder_name, MIN(scan_name) AS scan_name,
                       COALESCE(MIN(plugin_name), 'Bilinmeyen Zafiyet') AS vulnerability_name,
                       severity, COUNT(DISTINCT host_vuln_id) AS finding_count
                FROM fact WHERE folder_name IS NOT NULL
                GROUP BY lower(folder_name), lower(scan_name), plugin_id, lower(plugin_name), severity
                ORDER BY finding_count DESC, folder_name NULLS FIRST, scan_name NULLS FIRST,
                         plugin_id NULLS FIRST, MIN(plugin_name) NULLS FIRST, severity NULLS FIRST
                LIMIT 10)""",
        "scan_names_merge_case": """
            SELECT MIN(name) AS scan_name FROM scan WHERE scan_id IN (SELECT scan_id FROM scan_run)
            GROUP BY lower(name)""",
        "top_ports_merge_case": """
            SELECT MIN(port) AS port, COUNT(DISTINCT host_vuln_id) AS finding_count
            FROM fact WHERE port IS NOT NULL
            GROUP BY lower(port) ORDER BY finding_count DESC, port LIMIT 10""",
        "ip_ports_merge_case": """
            SELECT MIN(port) AS port FROM host JOIN host_vuln USING (scan_run_id, scanner_host_id)
            JOIN vuln_output USING (host_vuln_id) WHERE host_ip = '10.0.1.1' GROUP BY lower(port)""",
        "host_report_merge_case": f"""
            SELECT MIN(host_ip) AS host_ip, MIN(host_fqdn) AS host_fqdn, MIN(scan_name) AS scan_name,
                   MIN(folder_name) AS folder_name, {at("scan_start")} AS last_scan_date,
                   {_levels(distinct + "{name}_count")}, COUNT(DISTINCT host_vuln_id) AS total_vulnerabilities
            FROM fact WHERE folder_name IS NOT NULL
            GROUP BY lower(host_ip), lower(host_fqdn), lower(scan_name), lower(folder_name), scan_start""",
    }
    return {name: over(sql, **_MIXED) for name, sql in found.items()}


def reports() -> dict[str, str]:
    by_filter = {name: distribution(where) for name, where in FILTERS.items()}
    pages = f"ORDER BY severity DESC NULLS LAST, host_ip NULLS FIRST, " + ", ".join(
        f"{c} NULLS FIRST" for c in (
            "scan_name", "host_fqdn", "vulnerability_name", "severity_text", "plugin_family", "port",
            "cvss3_base_score", "scan_date", "scan_date_text",
        )
    )
    return {
        "latest_runs": over("""
            SELECT scan_id, max(scan_run_id) AS scan_run_id, arg_max(scan_start, scan_run_id) AS scan_start
            FROM scan_run GROUP BY scan_id"""),
        "latest_runs_sql": over("""
            SELECT s.scan_id, r.scan_run_id FROM scan s JOIN scan_run r ON r.scan_id = s.scan_id
            WHERE r.scan_run_id = (SELECT MAX(x.scan_run_id) FROM scan_run x WHERE x.scan_id = s.scan_id)"""),
        **by_filter,
        **_merged_case(),
        "scan_summary": summary(),
        "scan_summary_by_severity": summary("severity IN (3, 2)"),
        "scan_summary_filtered": summary(FILTERS["filter_all"]),
        "scan_summary_port": summary(FILTERS["filter_port"]),
        "scan_summary_rows": summary(rows=True),
        "scan_summary_rows_port": summary(FILTERS["filter_port"], rows=True),
        "severity_distribution": distribution(),
        "severity_totals": over(_TOTALS),
        "scan_summary_partials": summary(),
        "scan_summary_rows_partials": summary(rows=True),
        "severity_distribution_partials": distribution(),
        "severity_totals_partials": over(_TOTALS),
        "filter_severity_partials": by_filter["filter_severity"],
        "vulnerability_detail": detail(),
        "vulnerability_detail_port": detail(where=FILTERS["filter_port"]),
        "vulnerability_detail_extended": detail(_EXTENDED),
        "vulnerability_list": over(f"""
            SELECT scan_name, host_ip, host_fqdn, plugin_name AS vulnerability_name, severity,
                   family AS plugin_family, port, cvss3_base_score, {at("scan_start")} AS scan_date
            FROM fact WHERE plugin_id IS NOT NULL"""),
        "vulnerability_list_filtered": over(f"""
            SELECT scan_name, host_ip, host_fqdn, plugin_name AS vulnerability_name, severity,
                   family AS plugin_family, port, cvss3_base_score, {at("scan_start")} AS scan_date
            FROM fact WHERE plugin_id IS NOT NULL AND {FILTERS["filter_all"]}"""),
        "top_vulnerabilities": top_vulnerabilities(),
        "top_vulnerabilities_filtered": top_vulnerabilities(FILTERS["filter_severity"]),
        "scan_names": over("""
            SELECT DISTINCT name AS scan_name FROM scan WHERE scan_id IN (SELECT scan_id FROM scan_run)"""),
        "top_ports": top_ports(),
        "top_ports_filtered": top_ports(FILTERS["filter_all"]),
        "ip_ports": over(_PORTS_OF_IP),
        "ip_ports_valid": over(
            f"SELECT port FROM ({_PORTS_OF_IP}) WHERE port NOT IN ('', 'null') AND port NOT LIKE '0%'"
        ),
        "severity_hierarchy": over("""
            SELECT 'Total' AS label, '' AS parent, CAST(SUM(finding_count) AS BIGINT) AS value,
                   '#2c3e50' AS color FROM totals WHERE severity > 0
            UNION ALL
            SELECT severity_name, 'Total', finding_count, color FROM totals WHERE severity > 0""",
            totals=_TOTALS),
        "top_vulnerability_hierarchy": over(f"""
            SELECT 'Most Occurent 10 Vulnerabilities' AS id, 'Most Occurent 10 Vulnerabilities' AS label,
                   '' AS parent, CAST(SUM(finding_count) AS BIGINT) AS value, '#2c3e50' AS color,
                   'Most Occurent 10 Vulnerabilities' AS full_name
            FROM top HAVING COUNT(*) > 0
            UNION ALL
            SELECT 'vuln_' || CAST(row_number() OVER (ORDER BY finding_count DESC, folder_name, scan_name,
                       vulnerability_name, severity NULLS FIRST) - 1 AS VARCHAR),
                   CASE WHEN length(vulnerability_name) > 20 THEN substring(vulnerability_name, 1, 20) || '...'
                        ELSE vulnerability_name END,
                   'Most Occurent 10 Vulnerabilities', finding_count, {COLOR}, vulnerability_name
            FROM top""", top=_TOP_VULNERABILITIES.format(where="TRUE")),
        "top_port_hierarchy": over("""
            SELECT 'Most Used 10 Ports' AS id, 'Most Used 10 Ports' AS label, '' AS parent,
                   CAST(COALESCE(SUM(finding_count), 0) AS BIGINT) AS value FROM top
            UNION ALL
            SELECT 'port_' || port, 'Port ' || port, 'Most Used 10 Ports', finding_count FROM top""",
            top=_TOP_PORTS.format(where="TRUE")),
        "host_report": over(f"""
            SELECT host_ip, host_fqdn, scan_name, folder_name, {at("scan_start")} AS last_scan_date,
                   {_levels("COUNT(DISTINCT host_vuln_id) FILTER (WHERE severity = {level}) AS {name}_count")},
                   COUNT(DISTINCT host_vuln_id) AS total_vulnerabilities
            FROM fact WHERE folder_name IS NOT NULL
            GROUP BY host_ip, host_fqdn, scan_name, folder_name, scan_start"""),
        "plugin_detail": over(f"""
            SELECT plugin_id, COALESCE(name, 'Bilinmeyen Zafiyet') AS vulnerability_name,
                   COALESCE(description, 'Açıklama mevcut değil.') AS description,
                   COALESCE(solution, 'Çözüm önerisi mevcut değil.') AS solution,
                   'CVSS3 vektörü mevcut değil.' AS cvss3_vector,
                   COALESCE(CAST(cvss3_base_score AS VARCHAR), 'N/A') AS cvss3_base_score,
                   COALESCE(ref, 'Referans mevcut değil.') AS ref,
                   'Yayın tarihi belirtilmemiş.' AS pub_date,
                   COALESCE(mod_date, 'Güncelleme tarihi belirtilmemiş.') AS mod_date,
                   {_band("medium", _BANDS)} AS cvss_band, {_band("#f1c40f", _COLORS)} AS cvss_color
            FROM plugin"""),
        "cvss_band": over(f"""
            SELECT plugin_id, cvss3_base_score,
                   {_band("medium", _BANDS)} AS cvss_band, {_band("#f1c40f", _COLORS)} AS cvss_color,
                   {_band("low", _BANDS)} AS cvss_band_missing_low,
                   {_band("#2ecc71", _COLORS)} AS cvss_color_missing_low
            FROM plugin"""),
        "reference_links": over("""
            SELECT plugin_id, CAST(row_number() OVER (PARTITION BY plugin_id ORDER BY i) - 1 AS INTEGER)
                       AS position, link
            FROM (SELECT plugin_id, unnest(string_split(ref, chr(10))) AS link,
                         generate_subscripts(string_split(ref, chr(10)), 1) AS i
                  FROM plugin WHERE ref IS NOT NULL)
            WHERE trim(link) <> ''"""),
        "detail_search": search("widget"),
        "detail_search_indexed": search("widget"),
        "detail_search_all": search("h7.example", 1000),
        "detail_column_filter": over(f"""
            SELECT {_BASE} FROM ({_DETAIL.format(where="TRUE")})
            WHERE cvss3_base_score >= 5 AND contains(lower(port), 'tcp') AND plugin_family <> 'SMALL'"""),
        "detail_page": over(f"""
            SELECT {_BASE} FROM ({_DETAIL.format(where="TRUE")}) {pages} LIMIT 50 OFFSET 100"""),
        "detail_page_stored": over(f"""
            SELECT {_BASE} FROM ({_DETAIL.format(where="TRUE")}) {pages} LIMIT 50 OFFSET 100"""),
        "detail_page_after": over(f"""
            SELECT {_PAGED}, row_number() OVER (PARTITION BY {_PAGED})::INTEGER AS copy
            FROM ({_DETAIL.format(where="TRUE")})
            WHERE severity < 2 OR severity IS NULL OR (severity = 2 AND host_ip > '10.0.2.1')
               OR (severity = 2 AND host_ip = '10.0.2.1' AND scan_name IS NOT NULL)
            ORDER BY severity DESC NULLS LAST, host_ip NULLS FIRST, scan_name NULLS FIRST, host_fqdn NULLS FIRST,
                     vulnerability_name NULLS FIRST, severity_text NULLS FIRST, port NULLS FIRST, copy
            LIMIT 50"""),
        "turkish_dates": over(f"""
            SELECT scan_run_id, {turkish_date(at("scan_start"))} AS date_text,
                   {turkish_date(at("scan_start"))} || strftime({at("scan_start")}, ' %H:%M') AS datetime_text
            FROM scan_run"""),
        "run_times": over(f"""
            SELECT scan_run_id, strftime({at("scan_start")}, '%d %b %Y, %H:%M:%S') AS start_text,
                   CASE WHEN scan_run_id % 10 = 0 THEN 'Bilinmiyor'
                        ELSE strftime({at("scan_end")}, '%d %b %Y, %H:%M:%S') END AS end_text
            FROM scan_run"""),
        "saved_filter_counts": over(" UNION ALL ".join(
            f"SELECT '{name}' AS filter_name, '{label}' AS severity_labels, "
            f"COUNT(DISTINCT host_vuln_id) AS finding_count FROM fact WHERE {where}"
            for name, (where, label) in _SAVED.items()
        )),
        "saved_filter_table": over(" UNION ALL ".join(
            f"SELECT '{name}' AS filter_name, '{label}' AS severity_labels, "
            f"COUNT(DISTINCT host_vuln_id) AS finding_count FROM fact WHERE {where}"
            for name, (where, label) in _SAVED.items()
        )),
        "name_search": over(" UNION ALL ".join(
            f"SELECT '{p}' AS pattern, plugin_id FROM plugin WHERE name ILIKE '%{p}%' ESCAPE '\\'"
            for p in ("widget #1", "W_dget%#2", "ii", "%", "small%7", "no such name", "100\\%")
        )),
        "scan_filter_counts": over(r"""
            SELECT CAST(s.scan_id AS VARCHAR) AS filter_name, COUNT(DISTINCT f.host_vuln_id) AS finding_count
            FROM scan s LEFT JOIN (
                SELECT *, CASE WHEN port IS NOT NULL THEN COALESCE(TRY_CAST(regexp_extract(port, '^\s*(\d+)', 1) AS BIGINT), 0) END AS number
                FROM fact
            ) f ON f.scan_name ILIKE '%' || s.name || '%' AND f.severity IN (s.scan_id % 5, (s.scan_id + 2) % 5)
               AND (s.scan_id % 3 <> 0 OR f.host_ip LIKE '%10.0.' || CAST(s.scan_id % 4 AS VARCHAR) || '.%')
               AND (s.scan_id % 2 <> 0 OR f.number = 22 OR f.number BETWEEN 80 + s.scan_id % 400 AND 445)
            GROUP BY s.scan_id"""),
        "saved_links": over(r"""
            SELECT scan_id, '/detailed-analysis?' ||
                   CASE WHEN scan_id % 4 = 0 THEN ''
                        WHEN scan_id % 4 = 1 THEN 'severity=' || CAST(scan_id % 5 AS VARCHAR) || '&'
                        ELSE 'severity=' || CAST(scan_id % 5 AS VARCHAR) || '%2C7&' END ||
                   'scan_name=' || name || '&vulnerability_name=a+%26+b%3D%25+' || type || '%2A~%C3%BC' ||
                   CASE WHEN scan_id % 3 = 0 THEN '' ELSE '&ip_address=10.0.' || CAST(scan_id % 4 AS VARCHAR) || '.' END ||
                   '&port=22%2C400-500' AS link,
                   CASE WHEN scan_id % 4 = 0 THEN ''
                        WHEN scan_id % 4 = 1 THEN CAST(scan_id % 5 AS VARCHAR)
                        ELSE CAST(scan_id % 5 AS VARCHAR) || ',7' END AS severity,
                   CASE WHEN scan_id % 4 = 0 THEN '' ELSE
                        CASE scan_id % 5 WHEN 4 THEN 'Kritik' WHEN 3 THEN 'Yüksek' WHEN 2 THEN 'Orta'
                             WHEN 1 THEN 'Düşük' ELSE 'Bilgi' END END AS severity_labels,
                   name AS scan_name, 'a & b=% ' || type || '*~ü' AS vulnerability_name,
                   CASE WHEN scan_id % 3 <> 0 THEN '10.0.' || CAST(scan_id % 4 AS VARCHAR) || '.' END AS ip_address,
                   '22,400-500' AS port
            FROM scan"""),
    }
