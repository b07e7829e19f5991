"""Training-data pipeline operators.

Nothing else in the library imports this subpackage.  Each module holds one operator
with its own general interface; :mod:`scrubjay.llm.queries` holds the thin registered
queries that derive the contract columns from the operators' outputs.
"""
