"""Operators of a training-data pipeline: packing, token files, benchmark decontamination, near-duplicates,
token counts, quality, main text of pages, exact search, secrets and URL filters."""
