"""Lists of single findings: newest and worst first, searched, filtered and paged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breachlens.functions.scalars import (
    cvss_band, cvss_color, reference_lines, severity_label, turkish_date, vulnerability_name,
)
from breachlens.operators.filters import FilterSpec
from breachlens.operators.findings import Scope, findings, matching_outputs, scope, with_outputs
from breachlens.operators.sizing import FEW_ROWS, broadcast_if
from breachlens.operators.trigrams import TextIndex, write_index
from breachlens.sources.tables import Tables

DETAIL_LIMIT = 1000
PAGE_SIZE = 50

BASE_COLUMNS = (
    "scan_name", "host_ip", "host_fqdn", "vulnerability_name", "severity", "severity_text",
    "plugin_family", "port", "cvss3_base_score", "scan_date", "scan_date_text",
)
EXTENDED_COLUMNS = (
    *BASE_COLUMNS,
    "description", "solution", "cvss3_vector", "ref", "pub_date", "mod_date", "plugin_id",
)

# What a detail shows for a missing field.
DETAIL_DEFAULTS = {
    "vulnerability_name": "Bilinmeyen Zafiyet",
    "description": "Açıklama mevcut değil.",
    "solution": "Çözüm önerisi mevcut değil.",
    "cvss3_vector": "CVSS3 vektörü mevcut değil.",
    "cvss3_base_score": "N/A",
    "ref": "Referans mevcut değil.",
    "pub_date": "Yayın tarihi belirtilmemiş.",
    "mod_date": "Güncelleme tarihi belirtilmemiş.",
}
# End of fixed values.


def _ordering(sc: Scope, *last: str) -> list:
    return [F.desc("severity"), F.desc("scan_start"), *sc.tables.finding_key, *last]


def _described(rows: DataFrame, sc: Scope) -> DataFrame:
    """Add the shown plugin texts and dates to rows that carry a plugin_id."""
    texts = sc.tables.plugin.select(
        "plugin_id", "name", "severity", F.col("family").alias("plugin_family"),
        "cvss3_base_score", "description", "solution", "cvss3_vector", "ref", "pub_date", "mod_date",
    )
    scan_date = F.timestamp_seconds("scan_start")
    return rows.drop("severity", "name", "known_plugin_id").join(texts, "plugin_id").withColumns({
        "vulnerability_name": vulnerability_name("name"),
        "severity_text": severity_label(),
        "scan_date": scan_date,
        "scan_date_text": turkish_date(scan_date),
    })


def _narrow(sc: Scope) -> DataFrame:
    """Findings with a known plugin, with no more than the report order needs."""
    narrow = list(dict.fromkeys((
        *sc.tables.finding_key, "plugin_id", "severity", "scan_start", "scan_name", "host_ip", "host_fqdn",
    )))
    return findings(sc, required=True).select(*narrow)


def _limited(tables: Tables, spec: FilterSpec, limit: int) -> tuple[DataFrame, Scope]:
    """The first `limit` rows in report order, with plugin texts.

    Every finding has at least one row, so the first rows come from the first
    findings. These are chosen on narrow columns and kept, as they are read twice. Their
    outputs, however many, and the plugin texts are then found by broadcasting no more than
    `limit` rows. Nothing runs before the result is asked for.
    """
    if limit < 1:
        raise ValueError(f"limit must be at least 1, not {limit}")
    sc = scope(tables, spec)
    key, few = list(tables.finding_key), limit <= FEW_ROWS
    order = _ordering(sc, "port")
    first = _narrow(sc).orderBy(*_ordering(sc)).limit(limit).persist()
    shown = matching_outputs(tables, spec).select(*key, "port").join(broadcast_if(first, few), key)
    shown = shown.orderBy(*order).limit(limit)
    if not spec.port:
        # A finding whose outputs all lie beyond the limit looks silent here, but its
        # row then lies beyond the limit, too.
        shown = shown.persist()
        silent = first.join(shown.select(*key).distinct(), key, "left_anti")
        shown = shown.unionByName(silent, allowMissingColumns=True).orderBy(*order).limit(limit)
    return _described(broadcast_if(shown, few), sc).orderBy(*order), sc


def _rows(tables: Tables, spec: FilterSpec, limit: int | None) -> tuple[DataFrame, Scope]:
    """The first `limit` rows of the detail, or all of them, unordered."""
    if limit is not None:
        return _limited(tables, spec, limit)
    sc = scope(tables, spec)
    return _described(with_outputs(_narrow(sc), sc, "port"), sc), sc


def vulnerability_detail(
    tables: Tables, spec: FilterSpec = FilterSpec(), limit: int | None = DETAIL_LIMIT
) -> DataFrame:
    """The worst and newest findings, a row per output; without a limit all, in no order."""
    return _rows(tables, spec, limit)[0].select(*BASE_COLUMNS)


def vulnerability_detail_extended(
    tables: Tables, spec: FilterSpec = FilterSpec(), limit: int | None = DETAIL_LIMIT
) -> DataFrame:
    """As vulnerability_detail, with descriptions, references and dates of the plugin."""
    return _rows(tables, spec, limit)[0].select(*EXTENDED_COLUMNS)


def vulnerability_list(tables: Tables, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """All findings, a row per output: worst first, then by scan and address."""
    sc = scope(tables, spec)
    found = findings(sc, "family", "cvss3_base_score", required=True)
    rows = with_outputs(found, sc, "port")
    order = [F.desc("severity"), "scan_name", "host_ip", *tables.finding_key, "port"]
    return rows.orderBy(*order).select(
        "scan_name", "host_ip", "host_fqdn", F.col("name").alias("vulnerability_name"), "severity",
        F.col("family").alias("plugin_family"), "port", "cvss3_base_score",
        F.timestamp_seconds("scan_start").alias("scan_date"),
    )


def matches_anywhere(term: str, columns) -> Column:
    """Whether the text of any column contains the term, in any case. NULLs never match."""
    term = term.lower()
    tests = [
        F.coalesce(F.lower(F.col(c).cast("string")).contains(term), F.lit(False)) for c in columns
    ]
    return reduce(Column.__or__, tests)


# Which of the searched columns belong to a row, and which to its plugin.
_ROW_TEXTS = ("scan_name", "host_ip", "host_fqdn", "port", "scan_date_text")
_PLUGIN_TEXTS = tuple(c for c in EXTENDED_COLUMNS if c not in (*_ROW_TEXTS, "scan_date"))


def _plugin_texts(plugin: DataFrame) -> DataFrame:
    """The texts of plugins as the detail shows them."""
    return plugin.select(
        "plugin_id", "severity", severity_label().alias("severity_text"),
        vulnerability_name("name").alias("vulnerability_name"), F.col("family").alias("plugin_family"),
        "cvss3_base_score", "description", "solution", "cvss3_vector", "ref", "pub_date", "mod_date",
    )


def write_search_index(tables: Tables, path: str) -> TextIndex:
    """An index of all that the detail shows of plugins, for `detail_search`. It is one of these
    plugins as they are now; a table that has changed needs a new one."""
    return write_index(_plugin_texts(tables.plugin), path, "plugin_id", *_PLUGIN_TEXTS)


def detail_search(
    tables: Tables, term: str, spec: FilterSpec = FilterSpec(), limit: int | None = None,
    index: TextIndex | None = None,
) -> DataFrame:
    """Rows of the extended detail that contain a term in any shown text, in report order.

    The term is looked for in all rows; a limit keeps the first hits. Every plugin's texts
    are searched once, not once per finding, and join the hits last. With an index of the
    plugins only the texts that may contain the term are read.
    """
    sc = scope(tables, spec)
    rows = with_outputs(_narrow(sc), sc, "port")
    if term:
        texts, hit = _plugin_texts(tables.plugin), matches_anywhere(term, _PLUGIN_TEXTS)
        if index is None:
            hits = texts.select("plugin_id", hit.alias("hit"))
        else:
            found = index.search(texts, [term], hit).select("plugin_id").distinct().withColumn("found", F.lit(True))
            hits = tables.plugin.select("plugin_id").join(found, "plugin_id", "left").select(
                "plugin_id", F.coalesce("found", F.lit(False)).alias("hit")
            )
        dated = rows.withColumn("scan_date_text", turkish_date(F.timestamp_seconds("scan_start")))
        rows = dated.join(hits, "plugin_id").filter(F.col("hit") | matches_anywhere(term, _ROW_TEXTS))
        rows = rows.drop("hit", "scan_date_text")
    if limit is not None:
        rows = rows.orderBy(*_ordering(sc, "port")).limit(limit)
    return _described(rows, sc).orderBy(*_ordering(sc, "port")).select(*EXTENDED_COLUMNS)


_COMPARISONS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "contains": lambda c, v: F.lower(c.cast("string")).contains(str(v).lower()),
    "datestartswith": lambda c, v: c.cast("string").startswith(str(v)),
}


def filter_columns(df: DataFrame, conditions: list[tuple[str, str, object]]) -> DataFrame:
    """Keep rows for which all (column, comparison, value) conditions hold."""
    for column, comparison, value in conditions:
        if column not in df.columns:
            raise ValueError(f"no such column: {column!r}")
        if comparison not in _COMPARISONS:
            raise ValueError(f"no such comparison: {comparison!r}")
        df = df.filter(_COMPARISONS[comparison](F.col(column), value))
    return df


def page_order(df: DataFrame, sort: list[tuple[str, bool]] | None) -> dict[str, bool]:
    """All columns with whether they ascend; those not asked for complete the order."""
    chosen = dict(sort or [])
    unknown = set(chosen) - set(df.columns)
    if unknown:
        raise ValueError(f"no such column: {sorted(unknown)}")
    return chosen | {c: True for c in df.columns if c not in chosen}


def page(
    df: DataFrame, number: int, size: int = PAGE_SIZE, sort: list[tuple[str, bool]] | None = None
) -> DataFrame:
    """Page `number` (from 0) of `df` sorted by (column, ascending) pairs.

    The other columns complete the order, so that pages neither overlap nor miss rows. All
    rows up to the page's end are ranked, so for deep pages `page_after` is the better way.
    """
    order = page_order(df, sort)
    return df.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order.items()]).offset(number * size).limit(size)


def page_after(
    df: DataFrame, last: dict[str, object] | None, size: int = PAGE_SIZE,
    sort: list[tuple[str, bool]] | None = None,
) -> DataFrame:
    """The `size` rows that follow the row `last`, however deep; the first ones without it.

    Rows have a number among equal rows, `copy` (from 1), so that each has a place of its
    own; `last` is a row of the page before as a dict. A NULL sorts before all values.
    """
    equal = Window.partitionBy(*df.columns).orderBy(F.lit(1))
    order = page_order(df, sort) | {"copy": True}
    if last is not None:
        missing = set(order) - set(last)
        if missing:
            raise ValueError(f"the last row lacks {sorted(missing)}")
        # All columns before are as in the last row, and this one comes later.
        past, same = F.lit(False), F.lit(True)
        for column, up in order.items():
            value = F.lit(last[column])
            if column == "copy":
                break
            past = past | (same & _later(F.col(column), value, last[column] is None, up))
            same = same & F.col(column).eqNullSafe(value)
        df = df.filter(past | same)
        df = df.withColumn("copy", F.row_number().over(equal)).filter(past | (F.col("copy") > last["copy"]))
    else:
        df = df.withColumn("copy", F.row_number().over(equal))
    return df.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order.items()]).limit(size)


def _later(column: Column, value: Column, is_null: bool, up: bool) -> Column:
    if up:
        return column.isNotNull() if is_null else F.coalesce(column > value, F.lit(False))
    return F.lit(False) if is_null else column.isNull() | F.coalesce(column < value, F.lit(False))


def plugin_detail(tables: Tables, plugin_ids: list[int] | None = None) -> DataFrame:
    """The full view of plugins, with defaults for missing fields and the CVSS band."""
    plugins = tables.plugin
    if plugin_ids is not None:
        plugins = plugins.filter(F.col("plugin_id").isin(*plugin_ids))
    score = F.col("cvss3_base_score")
    shown = {
        column: F.coalesce(
            F.col("name" if column == "vulnerability_name" else column).cast("string"),
            F.lit(default),
        )
        for column, default in DETAIL_DEFAULTS.items()
    }
    return plugins.select(
        "plugin_id",
        *[value.alias(column) for column, value in shown.items()],
        cvss_band(score).alias("cvss_band"),
        cvss_color(score).alias("cvss_color"),
    )


def cvss_bands(tables: Tables) -> DataFrame:
    """The band of every plugin's score, under both readings of a missing score."""
    score = F.col("cvss3_base_score")
    return tables.plugin.select(
        "plugin_id",
        "cvss3_base_score",
        cvss_band(score).alias("cvss_band"),
        cvss_color(score).alias("cvss_color"),
        cvss_band(score, missing="low").alias("cvss_band_missing_low"),
        cvss_color(score, missing="low").alias("cvss_color_missing_low"),
    )


def reference_links(tables: Tables) -> DataFrame:
    """One row per reference address of a plugin, numbered from 0."""
    return tables.plugin.select(
        "plugin_id", F.posexplode(reference_lines("ref")).alias("position", "link")
    )
