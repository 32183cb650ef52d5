"""Queries over the given tables, one or more per operator, with their SQL."""


def all_checks() -> None:
    """Import the modules that register queries."""
    from checks import aggregates, basics, cleaning, joins, models, scans, sequences, streams  # noqa: F401
