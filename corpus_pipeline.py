"""The corpus pipeline: ``STAGES``, ``run`` and ``ORACLE_SQL``, which belong to the training-data operators."""

from lakequill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
