"""Training-data operators.

Nothing outside this package imports it.  The queries over the standard tables
are in :mod:`siftstone.llm.queries`.
"""
