"""Materialising a small intermediate once so an operator scans its input once.

Operators that must refuse bad input at call time (a ``ValueError`` before any
result is returned) aggregate the input ONCE into a small intermediate, write
it with a reliable ``checkpoint()`` into the cluster's shared checkpoint
folder, validate from it, and derive their result from it. The lineage is cut
there, so a lost executor never re-runs the scan of the input for the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from segstats.session import ensure_checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
