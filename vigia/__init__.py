"""Incident analytics on Spark DataFrames."""

from vigia.model import DEFAULT, Columns
from vigia.operators.filters import FilterSpec, default_filter, in_scope

__all__ = ["DEFAULT", "Columns", "FilterSpec", "default_filter", "in_scope"]
