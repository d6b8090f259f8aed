"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()`` live in
``paperloom.llm.catalog``; every operator module keeps its own general interface.
"""
