"""Scans and sinks: CSV / Parquet tables with the reference's column checks."""

from semcode.sources.tables import (load_corpus, load_reference, load_labeled, read_table,
                                    null_report, require_columns)
from semcode.sources.sinks import save_results, save_reference_set, load_reference_set

__all__ = ["load_corpus", "load_reference", "load_labeled", "read_table", "null_report",
           "require_columns", "save_results", "save_reference_set", "load_reference_set"]
