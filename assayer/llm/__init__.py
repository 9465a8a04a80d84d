"""Operations of a training-data pipeline over the ``documents`` table.

Nothing outside this folder imports it.  Every module holds one operator with
its own general interface; ``queries`` holds the thin registered queries.
"""
