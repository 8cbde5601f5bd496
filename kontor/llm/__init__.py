"""Training-data operators: one module per operator, queries in :mod:`kontor.llm.queries`."""
