"""Operators for training text; nothing else in the library imports this subpackage."""


def query_modules() -> list:
    """The modules with QUERIES and SQL."""
    from quillon.llm import queries

    return [queries]
