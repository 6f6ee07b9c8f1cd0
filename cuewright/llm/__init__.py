"""Training-data operators.

Nothing outside this package imports it.  Each module holds one operator with
a general interface; :mod:`cuewright.llm.registry` holds the thin
``opN_<name>`` queries and their SQL.
"""
