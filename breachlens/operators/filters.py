"""The filter model that all reports share."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

from breachlens.functions.links import LINK_PATH
from breachlens.functions.scalars import port_number


def port_ranges(text: str) -> list[tuple[int, int]]:
    """'22,80,400-500' as sorted, disjoint, inclusive ranges.

    A reversed range holds nothing. Anything that is not a number or a pair of
    numbers is refused by name.
    """
    ranges = []
    for part in text.split(","):
        match = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not match:
            raise ValueError(f"not a port or a port range: {part!r}")
        low = int(match[1])
        high = int(match[2] or low)
        if low <= high:
            ranges.append((low, high))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def contains_text(column: str, text: str, fold_accents: bool = False) -> Column:
    """Case-insensitive containment. % and _ in `text` are wildcards.

    A backslash escapes a wildcard and is an ordinary character elsewhere. With
    `fold_accents` letters also match their accented forms, and there are no wildcards.
    """
    if fold_accents:
        return F.contains(F.collate(F.col(column), "UNICODE_CI_AI"),
                          F.collate(F.lit(text), "UNICODE_CI_AI"))
    pattern = re.sub(r"\\(?![%_\\])", r"\\\\", text)
    return F.col(column).ilike(f"%{pattern}%")


@dataclass(frozen=True)
class FilterSpec:
    """Five optional conditions that must all hold. Empty means no condition."""

    severity: tuple[int, ...] = ()
    scan_name: str | None = None
    vulnerability_name: str | None = None
    ip_address: str | None = None
    port: str | None = None
    fold_accents: bool = False

    def __post_init__(self):
        levels = () if self.severity is None else self.severity
        if not isinstance(levels, Iterable) or isinstance(levels, str):
            raise TypeError("severity must be a list of levels")
        object.__setattr__(self, "severity", tuple(int(level) for level in levels))
        if self.port:
            port_ranges(self.port)

    @property
    def on_plugin(self) -> bool:
        return bool(self.severity or self.vulnerability_name)

    @property
    def on_finding(self) -> bool:
        """Whether a host that has no matching finding falls out of the reports.

        The conditions apply to the outer-joined rows, so one on a plugin or a port
        drops the rows in which these are missing.
        """
        return self.on_plugin or bool(self.port)

    def _contains(self, column: str, text: str) -> Column:
        return contains_text(column, text, self.fold_accents)

    def scan_condition(self, column: str) -> Column | None:
        return self._contains(column, self.scan_name) if self.scan_name else None

    def host_condition(self, column: str) -> Column | None:
        return self._contains(column, self.ip_address) if self.ip_address else None

    def plugin_condition(self, severity: str, name: str) -> Column | None:
        conditions = []
        if self.severity:
            conditions.append(F.col(severity).isin(*self.severity))
        if self.vulnerability_name:
            conditions.append(self._contains(name, self.vulnerability_name))
        return reduce(Column.__and__, conditions) if conditions else None

    def port_condition(self, column: str, number: Column | None = None) -> Column | None:
        """On the port text in `column`, or on its number if that is at hand already."""
        if not self.port:
            return None
        if number is None:
            # In an array, the text is turned into a number once for all ranges.
            return F.exists(F.array(port_number(column)), self._in_port_ranges)
        return self._in_port_ranges(number)

    def _in_port_ranges(self, number: Column) -> Column:
        ranges = port_ranges(self.port)
        single = [low for low, high in ranges if low == high]
        whole = number == F.floor(number)
        tests = [number.between(low, high) & whole for low, high in ranges if low < high]
        if single:
            tests.append(number.isin(*single))
        return reduce(Column.__or__, tests) if tests else F.lit(False)

    def to_link(self) -> str:
        values = {
            "severity": ",".join(map(str, self.severity)),
            "scan_name": self.scan_name,
            "vulnerability_name": self.vulnerability_name,
            "ip_address": self.ip_address,
            "port": self.port,
        }
        return LINK_PATH + urlencode({name: value for name, value in values.items() if value})

    @classmethod
    def from_link(cls, link: str) -> FilterSpec:
        values = {name: found[0] for name, found in parse_qs(link.rpartition("?")[2]).items()}
        levels = [x for x in values.pop("severity", "").split(",") if re.fullmatch(r"\d+", x)]
        known = ("scan_name", "vulnerability_name", "ip_address", "port")
        return cls(severity=tuple(levels), **{k: v for k, v in values.items() if k in known})
