"""Operators for preparing training corpora.

Nothing outside this subpackage imports it. ``queries()`` and ``oracle_sql()`` in
``parlora.llm.registry`` list the runnable queries.
"""
