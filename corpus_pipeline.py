"""The corpus pipeline's stages, its SQL (none) and run(); written out in letterloom.llm.pipeline."""

from letterloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
