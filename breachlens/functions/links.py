"""Filters as the query part of a link, and back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path and parameter names of a saved link.
LINK_PATH = "/detailed-analysis?"
SEVERITY_PARAMETER = "severity"
TEXT_PARAMETERS = ("scan_name", "vulnerability_name", "ip_address", "port")
# End of fixed values.


def _encode(text) -> Column:
    """Form encoding. Java and the usual web form differ in the treatment of * and ~."""
    return F.replace(
        F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def build_link(severity, scan_name, vulnerability_name, ip_address, port) -> Column:
    """A link that carries the filters that are set; `severity` is an array of levels."""
    texts = dict(zip(TEXT_PARAMETERS, (scan_name, vulnerability_name, ip_address, port)))
    levels = F.when(F.size(severity) > 0, F.array_join(severity.cast("array<string>"), ","))
    parts = [
        F.when(value != "", F.concat(F.lit(f"{name}="), _encode(value)))
        for name, value in {SEVERITY_PARAMETER: levels, **texts}.items()
    ]
    return F.concat(F.lit(LINK_PATH), F.concat_ws("&", *parts))


def _parameter(link, name: str) -> Column:
    """The first non-empty value of a parameter, decoded; NULL if there is none."""
    query = F.regexp_replace(link, r"^[^?]*\?", "")
    prefix = f"{name}="
    found = F.filter(
        F.split(query, "&"), lambda p: p.startswith(prefix) & (F.length(p) > len(prefix))
    )
    raw = F.substr(F.get(found, F.lit(0)), F.lit(len(prefix) + 1))
    return F.coalesce(F.try_url_decode(raw), raw)


def parse_link(link) -> Column:
    """A struct of the five filters. Levels that are not whole numbers are dropped."""
    levels = F.filter(
        F.split(_parameter(link, SEVERITY_PARAMETER), ","), lambda x: x.rlike(r"^\d+$")
    )
    return F.struct(
        F.coalesce(levels.cast("array<int>"), F.array().cast("array<int>")).alias("severity"),
        *[_parameter(link, name).alias(name) for name in TEXT_PARAMETERS],
    )
