"""Sources: delimited text records and the parquet driver tables."""

from segstats.sources.records import DEFAULT_NA_VALUES, preview, read_records
from segstats.sources.tables import TABLES, load_table

__all__ = ["DEFAULT_NA_VALUES", "TABLES", "load_table", "preview", "read_records"]
