"""segstats: outcome rates per segment, distribution summaries and data-quality
evidence over Spark DataFrames, computed with Spark's own expressions."""

from segstats.operators import *  # noqa: F401,F403
from segstats.operators import __all__ as _ops
from segstats.sources import load_table, preview, read_records

__all__ = [*_ops, "load_table", "preview", "read_records"]
