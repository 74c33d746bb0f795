"""The corpus pipeline: five stages from documents to packed training sequences, defined in caseloom.llm.pipeline."""

from caseloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
