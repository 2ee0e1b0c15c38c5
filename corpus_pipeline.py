"""The training-data pipeline over documents; its stages are in canopyq.llm.pipeline."""

from canopyq.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
