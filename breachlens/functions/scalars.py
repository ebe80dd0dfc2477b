"""Labels, dates, ports and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts, colours and thresholds that results must show exactly.
SEVERITIES = (
    # level, Turkish label, English label, colour
    (4, "Kritik", "Critical", "#e74c3c"),
    (3, "Yüksek", "High", "#e67e22"),
    (2, "Orta", "Medium", "#f1c40f"),
    (1, "Düşük", "Low", "#2ecc71"),
    (0, "Bilgi", "Info", "#3498db"),
)
UNKNOWN_SEVERITY = "Bilinmeyen"
UNKNOWN_SEVERITY_COLOR = "#95a5a6"
UNKNOWN_VULNERABILITY = "Bilinmeyen Zafiyet"
UNKNOWN_TIME = "Bilinmiyor"
ROOT_COLOR = "#2c3e50"
MONTHS = (
    "Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran",
    "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık",
)
CVSS_BANDS = (
    # lowest score, band, severity level that lends its colour
    (9.0, "critical", 4),
    (7.0, "high", 3),
    (4.0, "medium", 2),
    (None, "low", 1),
)
LABEL_LENGTH = 20
# End of fixed values.

COLOR_OF = {level: color for level, _, _, color in SEVERITIES}


def _by_severity(column, values: dict[int, str], default: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    lookup = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.element_at(lookup, column), F.lit(default))


def severity_label(severity="severity") -> Column:
    return _by_severity(severity, {s[0]: s[1] for s in SEVERITIES}, UNKNOWN_SEVERITY)


def severity_color(severity="severity") -> Column:
    return _by_severity(severity, COLOR_OF, UNKNOWN_SEVERITY_COLOR)


def severity_list_text(levels) -> Column:
    """The labels of an array of levels, unknown levels left out."""
    known = F.filter(levels, lambda level: level.isin(*COLOR_OF))
    return F.array_join(F.transform(known, severity_label), ", ")


def severity_dim(spark: SparkSession) -> DataFrame:
    """The five levels as a table: five rows, so always small enough to broadcast."""
    rows = ", ".join(f"({level}, '{tr}', '{en}', '{color}')" for level, tr, en, color in SEVERITIES)
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS levels(severity, severity_text, severity_name, color)"
    )


def vulnerability_name(name) -> Column:
    return F.coalesce(name, F.lit(UNKNOWN_VULNERABILITY))


def turkish_date(ts) -> Column:
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(ts))
    return F.concat(F.date_format(ts, "dd "), month, F.date_format(ts, " yyyy"))


def turkish_datetime(ts) -> Column:
    return F.concat(turkish_date(ts), F.date_format(ts, " HH:mm"))


def run_time_text(epoch) -> Column:
    """A run's start or end for display; missing and zero both mean unknown."""
    epoch = F.col(epoch) if isinstance(epoch, str) else epoch
    text = F.date_format(F.timestamp_seconds(epoch), "dd MMM yyyy, HH:mm:ss")
    return F.coalesce(F.when(epoch != 0, text), F.lit(UNKNOWN_TIME))


def cvss_band(score, missing: str = "medium") -> Column:
    bands = F.when(score.isNull(), F.lit(missing))
    for lowest, band, _ in CVSS_BANDS:
        bands = bands.otherwise(band) if lowest is None else bands.when(score >= lowest, band)
    return bands


def cvss_color(score, missing: str = "medium") -> Column:
    colors = {band: COLOR_OF[level] for _, band, level in CVSS_BANDS}
    lookup = F.create_map(*[F.lit(x) for pair in colors.items() for x in pair])
    return F.element_at(lookup, cvss_band(score, missing))


def short_label(text) -> Column:
    cut = F.concat(F.substring(text, 1, LABEL_LENGTH), F.lit("..."))
    return F.when(F.length(text) > LABEL_LENGTH, cut).otherwise(text)


_NUMBER_AT_START = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def port_number(port) -> Column:
    """A port text as a number: what it starts with, 0 if that is no number.

    NULL stays NULL. A plain cast would fail on '443 / tcp / www' in ANSI mode.
    """
    port = F.col(port) if isinstance(port, str) else port
    number = F.regexp_extract(port, _NUMBER_AT_START, 1).try_cast("double")
    return F.coalesce(number, F.when(port.isNotNull(), F.lit(0.0)))


def usable_port(port) -> Column:
    """Neither missing nor a placeholder; '0', '0 / tcp' and the like start with 0."""
    return port.isNotNull() & ~port.isin("", "null") & ~port.startswith("0")


def reference_list(urls) -> Column:
    """Reference addresses as one text, a line each; a missing list stays NULL."""
    return F.array_join(urls, "\n")


def reference_lines(text) -> Column:
    """The addresses in a reference text, blank lines left out."""
    return F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
