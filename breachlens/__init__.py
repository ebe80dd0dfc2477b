"""Analytics over vulnerability-scan findings, written as Spark DataFrame jobs."""

from breachlens.operators.filters import FilterSpec
from breachlens.sources.tables import Tables

__all__ = ["FilterSpec", "Tables"]
