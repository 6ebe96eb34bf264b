"""Small helpers of the meter tests; a name of its own, as two folders have a ``conftest``."""

import datetime as dt


def utc(text):
    return dt.datetime.fromisoformat(text)


def tuples(df, *columns):
    """Sorted rows as tuples."""
    selected = df.select(*columns) if columns else df
    return sorted(tuple(row) for row in selected.collect())
