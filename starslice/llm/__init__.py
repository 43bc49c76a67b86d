"""Operators for preparing training text, and their registered queries.

Nothing else in the library imports this package. ``queries`` and ``oracle_sql`` are added by ``__spark_entry__``.
"""


def queries() -> dict:
    from starslice.llm import registered

    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    from starslice.llm import registered

    return dict(registered.SQL)
