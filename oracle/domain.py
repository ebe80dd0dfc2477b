"""The test tables as scan data, and the outer-joined rows that filters apply to."""

DOMAIN = {
    "folder": """
        SELECT n_nationkey AS folder_id, r_name AS type, n_name AS name
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "scan": """
        SELECT c_custkey AS scan_id,
               CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_nationkey END AS folder_id,
               c_mktsegment AS type,
               c_mktsegment || '-' || CAST(c_custkey % 40 AS VARCHAR) AS name
        FROM customer""",
    "scan_run": """
        SELECT o_orderkey AS scan_run_id, o_custkey AS scan_id,
               CAST(epoch(o_orderdate) AS BIGINT) AS scan_start,
               CAST(epoch(o_orderdate) AS BIGINT) + 3600 AS scan_end,
               o_orderpriority AS targets
        FROM orders""",
    "host": """
        SELECT DISTINCT l_suppkey AS scanner_host_id, l_orderkey AS scan_run_id, o_custkey AS scan_id,
               '10.0.' || CAST(l_suppkey % 4 AS VARCHAR) || '.' || CAST(l_suppkey % 250 AS VARCHAR) AS host_ip,
               CASE WHEN l_suppkey % 9 = 0 THEN NULL
                    ELSE 'h' || CAST(l_suppkey AS VARCHAR) || '.example.org' END AS host_fqdn
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "host_vuln": """
        SELECT DISTINCT l_suppkey AS scanner_host_id, l_orderkey AS scan_run_id, l_partkey AS plugin_id,
               (CAST(l_orderkey AS HUGEINT) * 1000000000000 + l_suppkey) * 1000000000000 + l_partkey
                   AS host_vuln_id
        FROM lineitem WHERE l_quantity > 5""",
    "plugin": """
        SELECT p_partkey AS plugin_id, p_size % 5 AS severity,
               p_name || ' #' || CAST(p_partkey % 100 AS VARCHAR) AS name,
               p_type AS family, p_brand AS synopsis,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 'About ' || p_name END AS description,
               'Fix ' || p_brand AS solution,
               CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size % 11 AS DOUBLE) END AS cvss3_base_score,
               CASE WHEN p_partkey % 3 = 0 THEN NULL
                    ELSE 'http://a/' || CAST(p_partkey AS VARCHAR) || chr(10) || ' ' || chr(10)
                         || 'http://b/' || p_brand END AS ref,
               CAST(2000 + p_size % 20 AS VARCHAR) AS mod_date
        FROM part WHERE p_partkey % 50 <> 0""",
    "vuln_output": """
        SELECT host_vuln_id, scan_run_id, scanner_host_id, plugin_id, 0 AS output_no,
               CASE plugin_id % 6 WHEN 0 THEN '443 / tcp / www' WHEN 1 THEN '22 / tcp / ssh'
                    WHEN 2 THEN '0 / tcp' WHEN 3 THEN '80 / tcp / www' WHEN 4 THEN '8080'
                    ELSE '445 / tcp / cifs' END AS port
        FROM host_vuln WHERE plugin_id % 3 >= 1
        UNION ALL
        SELECT host_vuln_id, scan_run_id, scanner_host_id, plugin_id, 1,
               CASE plugin_id % 4 WHEN 0 THEN '3389 / tcp' WHEN 1 THEN '161 / udp / snmp'
                    WHEN 2 THEN '0 / icmp' END
        FROM host_vuln WHERE plugin_id % 3 = 2""",
    # One row per host, finding and output of each scan's latest run.
    "fact": r"""
        SELECT s.name AS scan_name, s.folder_id, f.name AS folder_name,
               r.scan_run_id, r.scan_start, h.host_ip, h.host_fqdn,
               v.host_vuln_id, v.scanner_host_id, v.plugin_id AS found_plugin_id,
               p.*, o.port, o.output_no,
               CASE WHEN o.port IS NULL THEN NULL
                    ELSE COALESCE(TRY_CAST(regexp_extract(o.port, '^\s*(\d+)', 1) AS BIGINT), 0)
               END AS port_number
        FROM (SELECT arg_max(scan_run_id, scan_run_id) AS scan_run_id FROM scan_run GROUP BY scan_id) top
        JOIN scan_run r ON r.scan_run_id = top.scan_run_id
        JOIN scan s ON s.scan_id = r.scan_id
        LEFT JOIN folder f ON f.folder_id = s.folder_id
        JOIN host h ON h.scan_run_id = r.scan_run_id
        LEFT JOIN host_vuln v ON v.scan_run_id = h.scan_run_id AND v.scanner_host_id = h.scanner_host_id
        LEFT JOIN (SELECT plugin_id, severity, name AS plugin_name, family, description, solution,
                          cvss3_base_score, ref, mod_date FROM plugin) p ON p.plugin_id = v.plugin_id
        LEFT JOIN vuln_output o ON o.host_vuln_id = v.host_vuln_id""",
}


def over(select: str, **more: str) -> str:
    """`select` over the domain tables; `more` adds named subqueries of its own."""
    parts = {**DOMAIN, **more}
    named = ",\n".join(f"{name} AS ({body})" for name, body in parts.items())
    return f"WITH {named}\n{select}"


LABEL = """CASE severity WHEN 4 THEN 'Kritik' WHEN 3 THEN 'Yüksek' WHEN 2 THEN 'Orta'
    WHEN 1 THEN 'Düşük' WHEN 0 THEN 'Bilgi' ELSE 'Bilinmeyen' END"""

COLOR = """CASE severity WHEN 4 THEN '#e74c3c' WHEN 3 THEN '#e67e22' WHEN 2 THEN '#f1c40f'
    WHEN 1 THEN '#2ecc71' WHEN 0 THEN '#3498db' ELSE '#95a5a6' END"""

LEVELS = """(VALUES (4, 'Kritik', 'Critical', '#e74c3c'), (3, 'Yüksek', 'High', '#e67e22'),
    (2, 'Orta', 'Medium', '#f1c40f'), (1, 'Düşük', 'Low', '#2ecc71'), (0, 'Bilgi', 'Info', '#3498db'))
    AS levels(severity, severity_text, severity_name, color)"""


def at(epoch: str) -> str:
    return f"make_timestamp(CAST({epoch} AS BIGINT) * 1000000)"


def turkish_date(ts: str) -> str:
    months = "['Ocak','Şubat','Mart','Nisan','Mayıs','Haziran','Temmuz','Ağustos','Eylül','Ekim','Kasım','Aralık']"
    return f"strftime({ts}, '%d') || ' ' || ({months})[month({ts})] || ' ' || strftime({ts}, '%Y')"
