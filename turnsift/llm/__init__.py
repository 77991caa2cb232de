"""Operators for training-data pipelines; see ``turnsift.llm.queries`` for the registered queries."""
