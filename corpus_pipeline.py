"""The corpus pipeline; its stages are in the subpackage of training-data operators."""

from maskwright.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, near_dedup, pack, quality_filter, redact_private, remove_benchmark, run, stored

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "near_dedup", "pack", "quality_filter", "redact_private", "remove_benchmark", "run", "stored"]
