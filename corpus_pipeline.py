"""A training-data pipeline over the documents; its stages live with the operators that they call."""

from lodestone.llm.stages import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
