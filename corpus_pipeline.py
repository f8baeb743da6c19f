"""The corpus pipeline: its stages, its SQL (none can express it) and a run over all of them."""

from tidewake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
